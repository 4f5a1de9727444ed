"""Matching the verdicts of two conditions.

The reference behaviour is an inner join on a key that is assumed, never
enforced, to be unique; a repeated key pairs every left row with every right
row. Here both sides are counted per key in one aggregation, and a pair of
verdicts carries the number of row pairs it stands for in ``pairs``. Results are
those of the join, but a key repeated a million times costs a handful of
counters per task instead of 10^12 rows. Grouping treats null keys as equal, as
the join does.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pairwright.functions.labels import prompt_consistent, swap_consistent

SWAP_KEYS = ["sample_id", "model", "prompt_version"]
PROMPT_KEYS = ["sample_id", "model"]

# Counter suffix -> verdict it counts, as SQL.
_CLASSES = {"a": "'A'", "b": "'B'", "none": "CAST(NULL AS STRING)"}


def valid(judgments: DataFrame, swap: bool | None = None) -> DataFrame:
    """Parsed rows only; with ``swap``, only those of one order if the table tells the order."""
    kept = judgments.filter(F.col("parse_success"))
    if swap is None or "swap_order" not in judgments.columns:
        return kept
    return kept.filter(F.col("swap_order") == swap)


def count_verdicts(prefix: str, where: str) -> list[Column]:
    """Counters ``<prefix>_a``, ``_b`` and ``_none`` over the rows where ``where`` holds."""
    classes = {
        "a": "parsed_winner = 'A'",
        "b": "parsed_winner = 'B'",
        "none": "parsed_winner IS NULL OR parsed_winner NOT IN ('A', 'B')",
    }
    return [F.expr(f"count_if(({where}) AND ({c}))").alias(f"{prefix}_{s}") for s, c in classes.items()]


def total(prefix: str) -> str:
    return f"({prefix}_a + {prefix}_b + {prefix}_none)"


def product(left: str, right: str) -> str:
    """Row pairs of two counters; a repeated key has more of them than a bigint holds."""
    return f"(CAST({left} AS DECIMAL(19, 0)) * CAST({right} AS DECIMAL(19, 0)))"


def listed(column: str, values: Sequence[str]) -> Column:
    """The place of the column's value in ``values``, their number for null; any other value is an error."""
    place = F.when(F.col(column).isNull(), F.lit(len(values)))
    for i, value in enumerate(values):
        place = place.when(F.col(column) == value, F.lit(i))
    message = F.concat(F.lit(f"unlisted {column}: "), F.col(column))
    return place.otherwise(F.raise_error(message).cast("int"))


def _counts_by_value(
    left: DataFrame, right: DataFrame, keys: Sequence[str], carry: str, values: Sequence[str]
) -> DataFrame:
    """``pair_counts`` where the values of ``carry`` are listed: a counter for each of them, so one shuffle does."""

    def side(df: DataFrame, slot: Column) -> DataFrame:
        return df.select(*keys, "parsed_winner", slot.alias("_slot"))

    slots = [*values, None]
    place = listed(carry, values) if carry in left.columns else F.lit(len(values))
    counts = (
        side(left, place)
        .unionByName(side(right, F.lit(-1)))
        .groupBy(*keys)
        .agg(
            *[c for i in range(len(slots)) for c in count_verdicts(f"left{i}", f"_slot = {i}")],
            *count_verdicts("right", "_slot = -1"),
        )
        .filter(f"{total('right')} > 0")
    )
    rows = [
        F.struct(F.lit(v).cast("string").alias(carry), *[F.col(f"left{i}_{s}").alias(f"left_{s}") for s in _CLASSES])
        for i, v in enumerate(slots)
    ]
    right_side = [f"right_{s}" for s in _CLASSES]
    return counts.select(*keys, *right_side, F.inline(F.array(*rows))).filter(f"{total('left')} > 0")


def pair_counts(
    left: DataFrame,
    right: DataFrame,
    keys: Sequence[str],
    carry: str | None = None,
    values: Sequence[str] | None = None,
) -> DataFrame:
    """Per key, verdict counters of both sides; only keys present on both.

    ``carry`` names a column that comes from the left side (the language). It
    splits the left counters. Where its ``values`` are listed, each has counters of
    its own and verdicts are shuffled once; a value that is not listed is an error.
    Otherwise rows are counted per key and value, and the right counters are
    then summed over the key in a second shuffle.
    """
    if carry and values is not None:
        return _counts_by_value(left, right, keys, carry, values)
    names = [*keys, "parsed_winner"] + ([carry] if carry else [])

    def side(df: DataFrame, is_left: bool) -> DataFrame:
        missing = [carry] if carry and carry not in df.columns else []
        for name in missing:
            df = df.withColumn(name, F.lit(None).cast("string"))
        return df.select(*names, F.lit(is_left).alias("_left"))

    both = side(left, True).unionByName(side(right, False))
    counts = both.groupBy(*keys, *([carry] if carry else [])).agg(
        *count_verdicts("left", "_left"), *count_verdicts("right", "NOT _left")
    )
    if carry:
        whole_key = Window.partitionBy(*keys)
        counts = counts.withColumns(
            {f"right_{s}": F.sum(f"right_{s}").over(whole_key) for s in _CLASSES}
        )
    return counts.filter(f"{total('left')} > 0 AND {total('right')} > 0")


def pairs_with(counts: DataFrame, flag: str, *kept: str) -> DataFrame:
    """``kept`` columns, row pairs with a flag (``n``) and consistent ones (``k``) per key."""
    n_k = {
        # A pair has this flag only if both verdicts exist.
        "swap_consistent": (
            product("left_a + left_b", "right_a + right_b"),
            f"{product('left_a', 'right_b')} + {product('left_b', 'right_a')}",
        ),
        "prompt_consistent": (
            product(total("left"), total("right")),
            f"{product('left_a', 'right_a')} + {product('left_b', 'right_b')}",
        ),
    }
    n, k = n_k[flag]
    return counts.selectExpr(*kept, f"{n} AS n", f"{k} AS k")


def matched_pairs(counts: DataFrame, left: str, right: str) -> DataFrame:
    """One row per key and pair of verdicts, with the number of row ``pairs``."""
    options = ", ".join(
        f"struct({v} AS {left}, {w} AS {right}, {product(f'left_{i}', f'right_{j}')} AS pairs)"
        for i, v in _CLASSES.items()
        for j, w in _CLASSES.items()
    )
    counters = [f"{side}_{s}" for side in ("left", "right") for s in _CLASSES]
    kept = [c for c in counts.columns if c not in counters]
    return counts.selectExpr(*kept, f"inline(array({options}))").filter("pairs > 0")


def swap_counts(main: DataFrame, swapped: DataFrame, languages: Sequence[str] | None = None) -> DataFrame:
    known = F.col("model").isNotNull()
    return pair_counts(
        valid(main, False).filter(known), valid(swapped, True).filter(known), SWAP_KEYS, "lang_code", languages
    )


def prompt_counts(main: DataFrame, other: DataFrame, languages: Sequence[str] | None = None) -> DataFrame:
    known = F.col("model").isNotNull()
    return pair_counts(
        valid(main, False).filter(known), valid(other, False).filter(known), PROMPT_KEYS, "lang_code", languages
    )


def swap_matched(main: DataFrame, swapped: DataFrame, languages: Sequence[str] | None = None) -> DataFrame:
    """Verdicts in plain and swapped order side by side, with ``swap_consistent``.

    ``languages``, where known, saves a shuffle; see ``pair_counts``.
    """
    matched = matched_pairs(swap_counts(main, swapped, languages), "winner_main", "winner_swap")
    return matched.select(
        *SWAP_KEYS,
        "winner_main",
        "lang_code",
        "winner_swap",
        swap_consistent(F.col("winner_main"), F.col("winner_swap")).alias("swap_consistent"),
        "pairs",
    )


def prompt_matched(main: DataFrame, other: DataFrame, languages: Sequence[str] | None = None) -> DataFrame:
    """Verdicts under two prompts side by side, with ``prompt_consistent``; ``languages`` as in ``swap_matched``."""
    matched = matched_pairs(prompt_counts(main, other, languages), "winner_main", "winner_minimal")
    return matched.select(
        *PROMPT_KEYS,
        "winner_main",
        "lang_code",
        "winner_minimal",
        prompt_consistent(F.col("winner_main"), F.col("winner_minimal")).alias("prompt_consistent"),
        "pairs",
    )


def expand_pairs(matched: DataFrame) -> DataFrame:
    """One row per row pair, as the plain join would give. Grows with the repeats of a key."""
    block = 100_000
    # Blocks first, then the rows of a block: no array grows with the repeats, and blocks may be spread.
    blocks = matched.withColumn("_b", F.explode(F.expr(f"sequence(0L, (CAST(pairs AS BIGINT) - 1) DIV {block})")))
    rows = blocks.withColumn("_i", F.explode(F.expr(f"sequence(1L, least({block}, CAST(pairs AS BIGINT) - _b * {block}))")))
    return rows.drop("_b", "_i", "pairs")


def judge_disagreement(judgments: DataFrame, first: str, second: str) -> DataFrame:
    """Items on which two judges differ, verdicts side by side; a missing verdict differs from all."""
    rows = valid(judgments)
    counts = pair_counts(
        rows.filter(F.col("model") == first), rows.filter(F.col("model") == second), ["sample_id"]
    )
    pairs = matched_pairs(counts, "first_winner", "second_winner")
    return pairs.filter(F.coalesce(F.col("first_winner") != F.col("second_winner"), F.lit(True)))


def common_judges(main: DataFrame, other: DataFrame) -> DataFrame:
    """Judges present in both tables, sorted."""
    return _judge_rows(main, other).filter("n_main > 0 AND n_other > 0").select("model").orderBy("model")


def _judge_rows(main: DataFrame, other: DataFrame) -> DataFrame:
    sides = main.select("model", F.lit(True).alias("_main")).unionByName(
        other.select("model", F.lit(False).alias("_main"))
    )
    return sides.groupBy("model").agg(
        F.count_if("_main").alias("n_main"), F.count_if(~F.col("_main")).alias("n_other")
    )


def run_summary(main: DataFrame, other: DataFrame) -> DataFrame:
    """One row: rows of either table and the sorted judges they have in common."""
    compared = F.when((F.col("n_main") > 0) & (F.col("n_other") > 0), F.col("model"))
    return _judge_rows(main, other).agg(
        F.coalesce(F.sum("n_main"), F.lit(0)).alias("n_main_rows"),
        F.coalesce(F.sum("n_other"), F.lit(0)).alias("n_other_rows"),
        F.array_sort(F.collect_set(compared)).alias("models_compared"),
    )


def union_runs(*runs: DataFrame) -> DataFrame:
    """Result tables under one another, by column name; absent columns become null."""
    first, *rest = runs
    for run in rest:
        first = first.unionByName(run, allowMissingColumns=True)
    return first
