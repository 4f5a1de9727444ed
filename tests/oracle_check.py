"""Run registered queries and their SQL on one data folder and compare whole results."""

from __future__ import annotations

import sys
import time
from collections import Counter
from pathlib import Path

import duckdb

TESTDATA = Path("/root/testdata")


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for path in sorted(Path(sf_dir).glob("*.parquet")):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    return con


def rows_of(columns: list[str], rows: list[tuple]) -> Counter:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return Counter(tuple(repr(row[i]) for i in order) for row in rows)


def compare(spark, con, name: str, query, sql: str, sf_dir: str) -> str | None:
    """None if equal, else what differs."""
    df = query(spark, sf_dir)
    ours = rows_of(df.columns, [tuple(r) for r in df.collect()])
    cursor = con.execute(sql)
    names = [d[0] for d in cursor.description]
    theirs = rows_of(names, cursor.fetchall())
    if sorted(names) != sorted(df.columns):
        return f"{name}: columns {sorted(df.columns)} != {sorted(names)}"
    if ours != theirs:
        extra, lacking = ours - theirs, theirs - ours
        cut = lambda c: [tuple(v[:60] for v in row) for row in list(c)[:3]]
        return (
            f"{name}: {sum(ours.values())} rows against {sum(theirs.values())}, "
            f"{sum(extra.values())} only ours {cut(extra)}, {sum(lacking.values())} only theirs {cut(lacking)}"
        )
    return None if ours else f"{name}: empty"


def main(argv: list[str]) -> None:
    sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
    import __spark_entry__ as entry
    from pyspark.sql import SparkSession

    sf_dir = str(TESTDATA / (argv[1] if len(argv) > 1 else "sf0.001"))
    spark = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    sql = entry.oracle_sql()
    chosen = argv[2:] or list(sql)
    for name in chosen:
        start = time.time()
        try:
            found = compare(spark, con, name, entry.queries()[name], sql[name], sf_dir)
        except Exception as error:
            found = f"{name}: {type(error).__name__} {str(error)[:900]}"
        print(f"{time.time() - start:6.2f}s {'ok   ' + name if found is None else 'FAIL ' + found}", flush=True)


if __name__ == "__main__":
    main(sys.argv)
