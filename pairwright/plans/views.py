"""The library's input tables, derived row by row from ``documents``.

Every document becomes one annotated item with two candidate texts. Replies of
five judges follow from hashes of the row, so the tables grow with the documents,
need no join and no sort, and can be restated in SQL (see ``oracle.py``).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairwright.functions.parsing import parse_winner, score
from pairwright.operators.items import build_items, judge_list, swap_items

# A judge config as it comes from a file; the last one has no tier.
CONFIG = {
    "primary": [
        {"name": "north/judge-1.0", "tier": "primary"},
        {"name": "south/judge-2.1", "tier": "primary"},
        {"name": "east/judge-3", "tier": "primary"},
    ],
    "exploratory": [
        {"name": "west/judge 4:free", "tier": "exploratory"},
        {"name": "centre/judge-5.5"},
    ],
}
JUDGES = [name for name, _ in judge_list(CONFIG)]
# Share of replies (percent) in which each judge sides with the humans.
SKILL = dict(zip(JUDGES, (95, 90, 86, 78, 64), strict=True))

MAIN, SWAPPED, MINIMAL = ("main", False), ("main", True), ("minimal", False)
CONDITIONS = [MAIN, SWAPPED, MINIMAL]

PROMPTS = {
    "main": 'Judge which translation is better. Return only JSON: {"winner":"A"} or {"winner":"B"}',
    "minimal": 'Choose the better translation. Return only JSON: {"winner":"A"} or {"winner":"B"}',
    "comment": 'Return only JSON: {"winner":"A","comment":"<one or two sentences>"}',
}

# Dimension -> terms that stand for it (frequent words of the documents).
LEXICON = {
    "faithfulness": ["that", "qui", "von", "in the", "de la"],
    "fluency": ["was", "pour", "zu"],
    "style": ["with", "avec", "ein"],
    "literalness": ["for", "sur", "que"],
    "mistranslation": ["not", "pas", "nicht"],
    "word_choice": ["and", "et", "und"],
    "awkwardness": ["are", "les", "los"],
    "context": ["this", "dans", "mit"],
}


def lexicon(spark: SparkSession) -> DataFrame:
    rows = [(dimension, term) for dimension, terms in LEXICON.items() for term in terms]
    return spark.createDataFrame(rows, "dimension string, term string")


def bucket(salt: str, key: str, size: int) -> str:
    """SQL for a hash of ``key`` below ``size``."""
    return f"CAST(conv(substr(md5(concat('{salt}/', {key})), 1, 8), 16, 10) AS BIGINT) % {size}"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def spread(table: DataFrame) -> DataFrame:
    """Deal the rows out when the files have fewer splits than there are cores.

    A table stored as one row group is read by one task, and everything up to the
    next shuffle would run in it. Large tables have splits enough and stay as they are.
    """
    cores = table.sparkSession.sparkContext.defaultParallelism
    return table if table.rdd.getNumPartitions() >= cores else table.repartition(cores)


def languages(spark: SparkSession, sf_dir: str) -> list[str]:
    """The languages of the documents, from that column alone; a handful, however many documents there are."""
    found = spark.read.parquet(f"{sf_dir}/documents.parquet").select("lang").distinct().collect()
    return sorted(r[0] for r in found if r[0] is not None)


def _said(text: str) -> str:
    """SQL for a whole text as a comment; rare control characters become blanks."""
    return f"regexp_replace({text}, '[\\\\x00-\\\\x08\\\\x0b\\\\x0c\\\\x0e-\\\\x1f]', ' ')"


def _escaped(text: str) -> str:
    """SQL for a text inside a JSON string."""
    for raw, escape in (("\\\\", "\\\\\\\\"), ('"', '\\\\"'), ("\\n", "\\\\n"), ("\\r", "\\\\r"), ("\\t", "\\\\t")):
        text = f"replace({text}, '{raw}', '{escape}')"
    return text


_SAMPLE_ID = "concat('s_', lang, '_', doc_id)"


def human(spark: SparkSession, sf_dir: str, by_item: bool = False) -> DataFrame:
    """Annotations: a choice (a few typos and nulls), a gold that conflicts now and then.

    With ``by_item`` the documents are dealt out by the item they become. Views that are joined by item share that
    one shuffle of each text, as they follow from the same columns of a document, and need no other.
    """
    if by_item:
        dealt = spark.read.parquet(f"{sf_dir}/documents.parquet").repartition(F.expr(_SAMPLE_ID))
    else:
        dealt = documents(spark, sf_dir)
    return (
        dealt.selectExpr("*", f"{_SAMPLE_ID} AS sample_id")
        .selectExpr("*", f"{bucket('choice', 'sample_id', 100)} AS mood")
        .selectExpr(
            "sample_id",
            "lang AS lang_code",
            "text AS source",
            "replace(text, '\\n', ' ') AS text1",
            "replace(text, ', ', ' ') AS text2",
            "CASE WHEN mood < 52 THEN 'text1' WHEN mood < 97 THEN 'text2' WHEN mood < 99 THEN 'txt2' END"
            " AS choice",
            f"IF(mood < 99 AND (mood < 52) = ({bucket('gold', 'sample_id', 100)} >= 5), 'text1', 'text2')"
            " AS gold",
            f"IF({bucket('issue', 'sample_id', 10)} < 2, 'tone', NULL) AS issues",
            f"IF({bucket('cm', 'sample_id', 10)} >= 3, {_said('text')}, NULL) AS commet",
            "doc_id AS row_ordinal",
        )
        .withColumn("comment_len", F.length("commet"))
    )


def items(spark: SparkSession, sf_dir: str, by_item: bool = False) -> DataFrame:
    return build_items(human(spark, sf_dir, by_item))


def _calls(
    spark: SparkSession, sf_dir: str, conditions: Sequence[tuple[str, bool]], by_item: bool = False
) -> DataFrame:
    """Items x judges x conditions with ``key`` and the side the judge takes (``_side``)."""
    tiers = dict(judge_list(CONFIG))
    calls = ", ".join(
        f"struct('{model}' AS model, '{tiers[model]}' AS tier, '{prompt}' AS prompt_version,"
        f" {swap} AS swap_order, {SKILL[model]} AS _skill,"
        f" {10 * CONDITIONS.index((prompt, swap)) + j} AS _call)"
        for prompt, swap in conditions
        for j, model in enumerate(JUDGES)
    )
    annotated = human(spark, sf_dir, by_item).withColumn("commet", F.expr(_escaped(_said("source"))))
    calls_per_item = build_items(annotated).withColumnRenamed("comment", "words")
    return (
        swap_items(
            calls_per_item.selectExpr("*", f"inline(array({calls}))"), F.col("swap_order")
        )
        .selectExpr(
            "*",
            "concat_ws('/', sample_id, model, prompt_version, IF(swap_order, 't', 'f')) AS key",
            "IF(gold_winner = 'B', 'A', 'B') AS _other",
        )
        .selectExpr(
            "* EXCEPT (row_ordinal)",
            "row_ordinal * 100 + _call AS row_ordinal",
            f"IF({bucket('ok', 'key', 100)} < _skill, gold_winner, _other) AS _side",
        )
    )


def replies(
    spark: SparkSession, sf_dir: str, conditions: Sequence[tuple[str, bool]] = tuple(CONDITIONS)
) -> DataFrame:
    """Unparsed judge replies in many shapes, empty replies and failed calls included."""
    raw = r"""CASE
        WHEN _shape < 70 THEN concat('{"winner":"', _side, '"}')
        WHEN _shape < 76 THEN concat('```json\n{ "winner" : "', _side, '" }\n```')
        WHEN _shape < 80 THEN concat('{"winner":"', _side, '"} because it reads well')
        WHEN _shape < 83 THEN concat('["', _side, '"]')
        WHEN _shape < 85 THEN concat('{"winner":"\\u004', IF(_side = 'A', '1', '2'), '"}')
        WHEN _shape < 91 THEN concat('Translation ', _side, ' reads better')
        WHEN _shape < 94 THEN 'no verdict'
        WHEN _shape < 96 THEN '' END"""
    shaped = _calls(spark, sf_dir, conditions).selectExpr("*", f"{bucket('fmt', 'key', 100)} AS _shape")
    return shaped.selectExpr(
        "sample_id", "lang_code", "model", "tier", "prompt_version", "swap_order", "gold_winner",
        f"{raw} AS raw_response",
        "IF(_shape >= 98, '429 Too Many Requests', NULL) AS error",
        "row_ordinal",
    )


def judgments(
    spark: SparkSession, sf_dir: str, conditions: Sequence[tuple[str, bool]] = tuple(CONDITIONS)
) -> DataFrame:
    return score(parse_winner(replies(spark, sf_dir, conditions)))


def comment_replies(spark: SparkSession, sf_dir: str, by_item: bool = False) -> DataFrame:
    """Unparsed replies with comments; the comment is the whole text of the document."""
    raw = r"""CASE
        WHEN _shape < 60 THEN concat(_head, words, '"}')
        WHEN _shape < 70 THEN concat(_head, 'so \\"fine\\": ', words, '"}')
        WHEN _shape < 80 THEN concat('Sure. ', _head, ' ', words, ' \n" }')
        WHEN _shape < 90 THEN concat(_head, words)
        WHEN _shape < 95 THEN concat('Translation ', _side, ' is better') END"""
    shaped = _calls(spark, sf_dir, [MAIN], by_item).selectExpr(
        "*",
        f"{bucket('cfmt', 'key', 100)} AS _shape",
        """concat('{"winner":"', _side, '","comment":"') AS _head""",
    )
    case = f"get(array('incorrect', 'unstable', 'control'), {bucket('case', 'key', 3)})"
    return shaped.selectExpr(
        "sample_id", f"{case} AS comment_case_type", "lang_code", "model", "tier",
        "'comment' AS prompt_version", "gold_winner", f"{raw} AS raw_response", "row_ordinal",
    )
