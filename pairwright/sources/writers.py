"""Writers: JSONL with explicit nulls, and tables split by judge."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairwright.functions.labels import safe_name


def write_jsonl(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """JSONL in which every row spells out every column, nulls included."""
    df.drop("row_ordinal").write.mode(mode).option("ignoreNullFields", "false").json(path)


def write_table(
    df: DataFrame, path: str, by_judge: bool = False, fmt: str = "parquet", mode: str = "errorifexists"
) -> None:
    """Metric or matched table; with ``by_judge`` one folder per judge.

    Folders are written by all tasks at once, so a judge with most of the rows
    does not wait on a single writer.
    """
    out = df.withColumn("model_slug", safe_name(F.col("model"))) if by_judge else df
    writer = out.write.mode(mode).format(fmt)
    if by_judge:
        writer = writer.partitionBy("model_slug")
    if fmt == "csv":
        # Empty text and null stay apart; quotes are doubled as in the input files.
        writer = writer.option("header", True).option("escape", '"')
    writer.save(path)


def write_judgments(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Judgements in folders by prompt and order: matching two conditions reads only those two."""
    df.write.mode(mode).partitionBy("prompt_version", "swap_order").parquet(path)
