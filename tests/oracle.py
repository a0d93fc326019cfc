"""Compare a query with its SQL in DuckDB on the same tables."""

from __future__ import annotations

from pathlib import Path

import duckdb
import pandas as pd

DATA = "/root/testdata/sf0.001"


def rows(frame: pd.DataFrame) -> list[str]:
    columns = sorted(frame.columns)
    return sorted(frame[columns].convert_dtypes().astype(str).agg("|".join, axis=1)) if len(frame) else []


def by_duckdb(sql: str, folder: str = DATA) -> pd.DataFrame:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for path in Path(folder).iterdir():
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    return con.execute(sql).df()
