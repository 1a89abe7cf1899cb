"""Compare a Spark result with a DuckDB statement over the same tables, order aside."""

import math

import duckdb
import pandas as pd

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def duck(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return con


def plain(v):
    if v is None or v is pd.NaT or v is pd.NA or (isinstance(v, float) and math.isnan(v)):
        return None
    if hasattr(v, "item"):
        return plain(v.item())
    if isinstance(v, bool):
        return v
    return round(float(v), 9) + 0.0 if isinstance(v, int | float) else str(v)


def rows(frame: pd.DataFrame) -> list[str]:
    columns = sorted(frame.columns)
    return sorted(repr([plain(v) for v in r]) for r in frame[columns].itertuples(index=False))


def check(df, statement: str, sf_dir: str) -> int:
    ours, theirs = df.toPandas(), duck(sf_dir).sql(statement).df()
    assert sorted(ours.columns) == sorted(theirs.columns)
    assert rows(ours) == rows(theirs)
    return len(ours)
