"""Scoring arrivals as they come."""
