"""Small hand-made tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from pairwright import schemas
from pairwright.functions.parsing import score

VERDICTS = (
    "sample_id string, lang_code string, model string, prompt_version string, swap_order boolean,"
    " gold_winner string, parsed_winner string, row_ordinal long"
)


def judged(spark: SparkSession, rows: list[tuple]) -> DataFrame:
    """Scored judgements from (id, language, judge, prompt, swapped, gold, winner)."""
    numbered = [(*row, i) for i, row in enumerate(rows)]
    return score(spark.createDataFrame(numbered, VERDICTS))


def items(spark: SparkSession, ids: list[tuple[str, str | None]]) -> DataFrame:
    """Items from (id, language)."""
    rows = [(i, lang, f"src {i}", f"a {i}", f"b {i}", "A", "text1", None, None) for i, lang in ids]
    return spark.createDataFrame(rows, schemas.ITEMS)


def rows(df: DataFrame, *columns: str) -> list[tuple]:
    df = df.select(*columns) if columns else df
    return sorted((tuple(r) for r in df.collect()), key=repr)
