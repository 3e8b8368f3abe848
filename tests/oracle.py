"""Run registered queries against DuckDB. As a script: ``python tests/oracle.py [scale-dir] [query ...]``."""

from __future__ import annotations

import sys
import tempfile
import time
from pathlib import Path

import duckdb
import pandas as pd

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

import __spark_entry__ as entry  # noqa: E402


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for file in sorted(Path(sf_dir).glob("*.parquet")):
        con.execute(f"CREATE VIEW {file.stem} AS SELECT * FROM '{file}'")
    return con


def _ordered(df: pd.DataFrame) -> pd.DataFrame:
    df = df[sorted(df.columns)]
    return df.sort_values(list(df.columns)).reset_index(drop=True)


def compare(spark, con, sf_dir: str, name: str) -> tuple[int, float]:
    """Rows of the result and seconds taken; raises if the two engines differ in columns, types or any value."""
    start = time.time()
    got = _ordered(entry.queries()[name](spark, sf_dir).toPandas())
    seconds = time.time() - start
    expected = _ordered(con.execute(entry.oracle_sql()[name]).df())
    pd.testing.assert_frame_equal(got, expected, check_exact=True, check_dtype=True)
    return len(got), seconds


if __name__ == "__main__":
    from pyspark.sql import SparkSession

    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    names = sys.argv[2:] or list(entry.queries())
    spark = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "12g")
        .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="oracle-"))
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    failed = 0
    for name in names:
        try:
            rows, seconds = compare(spark, con, sf_dir, name)
            print(f"ok   {name:28s} {rows:8d} rows {seconds:6.2f} s", flush=True)
        except Exception as error:  # report all, then fail
            failed += 1
            print(f"FAIL {name:28s} {str(error)[:600]}", flush=True)
    sys.exit(1 if failed else 0)
