"""Run queries and their SQL side by side: python -m tests.compare [sf_dir] [query ...]"""

from __future__ import annotations

import sys
import time

import duckdb
import numpy as np
import pandas as pd

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def duckdb_rows(sql: str, sf_dir: str) -> pd.DataFrame:
    with duckdb.connect() as con:
        for table in TABLES:
            con.sql(f"create view {table} as select * from '{sf_dir}/{table}.parquet'")
        return con.sql(sql).df()


def plain(value: object) -> object:
    if pd.isna(value):
        return None
    if isinstance(value, bool | np.bool_):
        return bool(value)
    if isinstance(value, np.integer) or (isinstance(value, float) and value.is_integer()):
        return int(value)
    return value


def normalized(rows: pd.DataFrame) -> list[tuple]:
    columns = sorted(rows.columns)
    values = [
        tuple(plain(v) for v in row) for row in rows[columns].itertuples(index=False, name=None)
    ]
    return sorted(values, key=repr)


def differences(spark_rows: pd.DataFrame, sql_rows: pd.DataFrame) -> str | None:
    if sorted(spark_rows.columns) != sorted(sql_rows.columns):
        return f"columns {sorted(spark_rows.columns)} / {sorted(sql_rows.columns)}"
    ours, theirs = normalized(spark_rows), normalized(sql_rows)
    if ours == theirs:
        return None
    extra, missing = list(set(ours) - set(theirs))[:3], list(set(theirs) - set(ours))[:3]
    return f"{len(ours)} / {len(theirs)} rows; only ours {extra}; only SQL {missing}"


if __name__ == "__main__":
    from __spark_entry__ import oracle_sql, queries
    from tests.conftest import build_session

    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    wanted = sys.argv[2:] or list(queries())
    spark = build_session()
    for name in wanted:
        started = time.time()
        rows = queries()[name](spark, sf_dir).toPandas()
        took = time.time() - started
        sql = oracle_sql().get(name)
        verdict = "no SQL" if sql is None else differences(rows, duckdb_rows(sql, sf_dir)) or "same"
        print(f"{name:24} {len(rows):7} rows {took:6.2f}s  {verdict}", flush=True)
