"""Building items from human annotations, and requests from items."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pairwright.functions.labels import gold_winner, opposite
from pairwright.schemas import HUMAN_REQUIRED, JUDGE_CONFIG, require


def _optional(df: DataFrame, *names: str) -> Column:
    """First of the named columns that the table has, else a null string."""
    for name in names:
        if name in df.columns:
            return F.col(name)
    return F.lit(None).cast("string")


def dedupe_first(df: DataFrame, keys: Sequence[str], ordinal: str = "row_ordinal") -> DataFrame:
    """Keep the first row of every key in file order.

    The literal bound on the row number makes Spark cut each key to one row per
    task before the shuffle, so a key that fills a third of the table is harmless.
    """
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(ordinal))
    return df.withColumn("_rn", rank).filter("_rn = 1").drop("_rn")


def build_items(human: DataFrame) -> DataFrame:
    """Annotation rows as items: two displayed texts and the side humans preferred.

    A row ordinal, if the table has one, is passed on.
    """
    require(human, HUMAN_REQUIRED)
    ordinal = ["row_ordinal"] if "row_ordinal" in human.columns else []
    return human.select(
        "sample_id",
        "lang_code",
        "source",
        F.col("text1").alias("translation_a"),
        F.col("text2").alias("translation_b"),
        gold_winner(F.col("choice")).alias("gold_winner"),
        "choice",
        _optional(human, "issues").alias("issues"),
        _optional(human, "commet").alias("comment"),
        *ordinal,
    )


def flag_conflicts(human: DataFrame) -> DataFrame:
    """Annotation rows whose choice and gold differ; a missing one counts as different."""
    require(human, ["choice", "gold"])
    return human.filter(F.coalesce(F.col("choice") != F.col("gold"), F.lit(True)))


def swap_items(items: DataFrame, swap: Column | bool = True) -> DataFrame:
    """Exchange the two texts and the gold label where ``swap`` holds."""
    swap = F.lit(swap) if isinstance(swap, bool) else swap
    a, b, gold = F.col("translation_a"), F.col("translation_b"), F.col("gold_winner")
    return items.withColumns(
        {
            "translation_a": F.when(swap, b).otherwise(a),
            "translation_b": F.when(swap, a).otherwise(b),
            "gold_winner": F.when(swap, opposite(gold)).otherwise(gold),
        }
    )


def user_message(source: Column, a: Column, b: Column) -> Column:
    """Text of a judge request (fixed wording)."""
    shown = [F.coalesce(c, F.lit("None")) for c in (source, a, b)]
    return F.concat(
        F.lit("Source passage:\n"), shown[0],
        F.lit("\n\nTranslation A:\n"), shown[1],
        F.lit("\n\nTranslation B:\n"), shown[2],
        F.lit("\n\nWhich translation is better overall?"),
    )


def judge_list(config: Mapping[str, Sequence[Mapping[str, str]]]) -> list[tuple[str, str]]:
    """(name, tier) of every judge in a parsed config, groups in order; no tier and a null one are ``unknown``."""
    return [
        (judge["name"], "unknown" if judge.get("tier") is None else judge["tier"])
        for group in config.values()
        for judge in group
    ]


def judges(spark: SparkSession, config: Mapping[str, Sequence[Mapping[str, str]]]) -> DataFrame:
    """The parsed config as rows (judge_group, model, tier)."""
    rows = {g: [(j["name"], j.get("tier")) for j in js] for g, js in config.items()}
    schema = T.StructType([T.StructField("config", JUDGE_CONFIG)])
    nested = spark.createDataFrame([(rows,)], schema)
    return (
        nested.select(F.explode("config").alias("judge_group", "judges"))
        .select("judge_group", F.inline("judges").alias("model", "tier"))
        .withColumn("tier", F.coalesce("tier", F.lit("unknown")))
    )


def for_each_judge(df: DataFrame, roster: Sequence[tuple[str, str]]) -> DataFrame:
    """Every row once per judge, with ``model`` and ``tier``.

    The roster is configuration, so it is unfolded inside each task from a
    constant array: no join and no shuffle.
    """
    entries = F.array(
        *[F.struct(F.lit(name).alias("model"), F.lit(tier).alias("tier")) for name, tier in roster]
    )
    return df.select("*", F.inline(entries))


def judge_requests(
    items: DataFrame,
    roster: Sequence[tuple[str, str]],
    prompt_version: str,
    system_prompt: str,
    swap: bool = False,
    answered: DataFrame | None = None,
) -> DataFrame:
    """One request per item and judge for one prompt version and order.

    ``gold_winner`` is in the space of the displayed labels. A case label, if the
    items carry one, is passed on. ``answered`` (sample_id, models) lists the judges
    to leave out per item; it is joined before the items are multiplied by judges.
    """
    left_out = []
    if answered is not None:
        items = items.join(answered.select("sample_id", "models"), "sample_id", "left")
        left_out = ["models"]
    shown = swap_items(items, True) if swap else items
    case = ["comment_case_type"] if "comment_case_type" in items.columns else []
    prepared = shown.select(
        "sample_id",
        *case,
        "lang_code",
        F.lit(prompt_version).alias("prompt_version"),
        F.lit(swap).alias("swap_order"),
        "gold_winner",
        F.lit(system_prompt).alias("system_prompt"),
        user_message(*map(F.col, ("source", "translation_a", "translation_b"))).alias("user_message"),
        *left_out,
    )
    requests = for_each_judge(prepared, roster)
    if answered is None:
        return requests
    return requests.filter("NOT coalesce(array_contains(models, model), false)").drop("models")


def requests_per_judge(items: DataFrame, roster: Sequence[tuple[str, str]]) -> DataFrame:
    """How many requests each judge of the roster gets."""
    return for_each_judge(items.select("sample_id"), roster).groupBy("model", "tier").agg(
        F.count("*").alias("requests")
    )
