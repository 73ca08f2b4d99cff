"""Running a registered query and its SQL side by side."""

from __future__ import annotations

import duckdb
import pandas as pd

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir: str):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def canonical(df: pd.DataFrame) -> list[tuple]:
    def plain(x):
        if x is None or (isinstance(x, float) and x != x) or x is pd.NA:
            return None
        return round(float(x), 5) if isinstance(x, float) else int(x) if hasattr(x, "__index__") else str(x)

    cols = sorted(df.columns)
    return sorted((tuple(plain(v) for v in row) for row in df[cols].astype(object).itertuples(index=False)), key=repr)
