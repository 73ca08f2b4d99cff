"""The numbered queries and, where SQL can express them, their DuckDB equivalents."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from weftline.llm import bpe, decontaminate, html, infill, langid, licenses, lines, lm, runs, sharding, simhash, substrings, topk


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_line_dedup": lines.op1_line_dedup,
        "op2_byte_bpe": bpe.op2_byte_bpe,
        "op3_sharding": sharding.op3_sharding,
        "op4_exact_topk": topk.op4_exact_topk,
        "op5_language_id": langid.op5_language_id,
        "op6_decontamination": decontaminate.op6_decontamination,
        "op7_simhash": simhash.op7_simhash,
        "op8_html_text": html.op8_html_text,
        "op9_lm_score": lm.op9_lm_score,
        "op10_suffix_dedup": substrings.op10_suffix_dedup,
        "op11_license_scan": licenses.op11_license_scan,
        "op12_periodic_runs": runs.op12_periodic_runs,
        "op13_fill_in_middle": infill.op13_fill_in_middle,
    }


def oracle_sql() -> dict[str, str]:
    return {"op1_line_dedup": lines.OP1_SQL, "op4_exact_topk": topk.OP4_SQL, "op11_license_scan": licenses.OP11_SQL, "op13_fill_in_middle": infill.OP13_SQL}
