"""Explicit schemas of the tables the library reads and writes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import types as T

_S, _B = T.StringType(), T.BooleanType()


def _struct(*fields: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(name, kind, True) for name, kind in fields])


# Fixed names: the columns of the files of an evaluation.
HUMAN_REQUIRED = ["sample_id", "lang_code", "source", "text1", "text2", "choice"]

ITEMS = _struct(
    ("sample_id", _S),
    ("lang_code", _S),
    ("source", _S),
    ("translation_a", _S),
    ("translation_b", _S),
    ("gold_winner", _S),
    ("choice", _S),
    ("issues", _S),
    ("comment", _S),
)

# Items of a diagnostic subset carry the reason they were picked.
SUBSET_ITEMS = _struct(
    *((f.name, f.dataType) for f in ITEMS),
    ("comment_case_type", _S),
    ("comment_target_model", _S),
)

JUDGMENTS = _struct(
    ("sample_id", _S),
    ("lang_code", _S),
    ("model", _S),
    ("tier", _S),
    ("prompt_version", _S),
    ("swap_order", _B),
    ("gold_winner", _S),
    ("parsed_winner", _S),
    ("parse_success", _B),
    ("is_correct", _B),
    ("raw_response", _S),
    ("error", _S),
)

COMMENTS = _struct(
    ("sample_id", _S),
    ("comment_case_type", _S),
    ("lang_code", _S),
    ("model", _S),
    ("tier", _S),
    ("prompt_version", _S),
    ("gold_winner", _S),
    ("parsed_winner", _S),
    ("parse_success", _B),
    ("is_correct", _B),
    ("comment", _S),
    ("raw_response", _S),
    ("error", _S),
)

JUDGE_CONFIG = T.MapType(_S, T.ArrayType(_struct(("name", _S), ("tier", _S))))


def require(df: DataFrame, columns: list[str]) -> DataFrame:
    """Return ``df`` unchanged, or raise when a column is missing. Runs no job."""
    missing = sorted(set(columns) - set(df.columns))
    if missing:
        raise ValueError(f"the table lacks columns {missing}")
    return df
