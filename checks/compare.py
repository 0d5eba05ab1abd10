"""Run registered queries beside their SQL counterparts and compare the values.

    python -m checks.compare [--sf DIR] [query ...]
"""

from __future__ import annotations

import argparse
import glob
import os
import time

import duckdb
import pandas as pd
from pyspark.sql import SparkSession

from checks.oracle import oracle_queries
from checks.queries import QUERIES


def oracle_connection(sf_dir: str) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    for path in sorted(glob.glob(f"{sf_dir}/*.parquet")):
        name = os.path.splitext(os.path.basename(path))[0]
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return connection


def _kind(series: pd.Series) -> str:
    kind = series.dtype.kind
    return "text" if kind not in "iufb" else {"i": "int", "u": "int", "f": "float", "b": "bool"}[kind]


def canonical(frame: pd.DataFrame) -> pd.DataFrame:
    frame = frame[sorted(frame.columns)]
    text = frame.apply(lambda c: c.map(lambda v: "<null>" if v is pd.NA or pd.isna(v) else repr(float(v)) if isinstance(v, float) else str(v)))
    return text.sort_values(list(text.columns)).reset_index(drop=True)


def difference(mine: pd.DataFrame, theirs: pd.DataFrame) -> str | None:
    """None when both hold the same rows, else a short description."""
    if sorted(mine.columns) != sorted(theirs.columns):
        return f"columns {sorted(mine.columns)} != {sorted(theirs.columns)}"
    if len(mine) != len(theirs):
        return f"rows {len(mine)} != {len(theirs)}"
    for column in mine.columns:
        if str(theirs[column].dtype) in ("Int32", "Int64") and mine[column].dtype.kind == "f" and mine[column].isna().any():
            mine = mine.assign(**{column: mine[column].astype("Int64")})  # whole numbers and nulls come as floats
        if _kind(mine[column]) != _kind(theirs[column]):
            return f"kind of {column}: {mine[column].dtype} != {theirs[column].dtype}"
    a, b = canonical(mine), canonical(theirs)
    unequal = (a != b).any(axis=1)
    if unequal.any():
        at = unequal.idxmax()
        return f"{int(unequal.sum())} rows differ, first\n  {a.loc[at].to_dict()}\n  {b.loc[at].to_dict()}"
    return None


def main() -> None:
    parser = argparse.ArgumentParser()
    parser.add_argument("--sf", default="/root/testdata/sf0.01")
    parser.add_argument("names", nargs="*")
    args = parser.parse_args()
    spark = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    connection = oracle_connection(args.sf)
    oracle = oracle_queries()
    failed = []
    for name in args.names or QUERIES:
        start = time.time()
        try:
            mine = QUERIES[name](spark, args.sf).toPandas()
            seconds = time.time() - start
            problem = difference(mine, connection.execute(oracle[name]).df()) if name in oracle else None
        except Exception as error:  # noqa: BLE001
            seconds, problem, mine = time.time() - start, f"{type(error).__name__}: {str(error)[:600]}", []
        verdict = "FAIL" if problem else ("ok" if name in oracle else "rows")
        print(f"{verdict:5} {name:28} {len(mine):7} rows {seconds:6.1f}s {problem or ''}", flush=True)
        if problem:
            failed.append(name)
        spark.catalog.clearCache()
    print(f"{len(failed)} failed: {failed}")
    spark.stop()


if __name__ == "__main__":
    main()
