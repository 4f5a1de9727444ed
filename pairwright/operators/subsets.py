"""Diagnostic subsets: which items a judge got wrong, wavered on, or handled well."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairwright.operators.pairing import count_verdicts, total, union_runs, valid
from pairwright.operators.sampling import bounded, draw_cases

JUDGE_QUOTAS = {"incorrect": 12, "unstable": 12, "control": 6}
SHARED_QUOTAS = {"incorrect": 10, "unstable": 10, "disagreement": 10, "control": 5}


def incorrect_items(judgments: DataFrame) -> DataFrame:
    """(model, sample_id) with a parsed but wrong verdict; an unknown one is not wrong."""
    return valid(judgments).filter(~F.col("is_correct")).select("model", "sample_id").distinct()


def incorrect_any_judge(judgments: DataFrame, judges: Sequence[str]) -> DataFrame:
    """Items that at least one of the judges got wrong."""
    wrong = valid(judgments).filter(~F.col("is_correct") & F.col("model").isin(*judges))
    return wrong.select("sample_id").distinct()


def _both_orders(main: DataFrame, swapped: DataFrame) -> DataFrame:
    columns = ["model", "sample_id", "parsed_winner", "is_correct"]
    return (
        valid(main)
        .select(*columns, F.lit(False).alias("_swap"))
        .unionByName(valid(swapped).select(*columns, F.lit(True).alias("_swap")))
    )


def _is_unstable(main: str, swapped: str) -> str:
    """True if some swapped verdict is not the opposite of some main verdict."""
    not_b, not_a = f"{swapped}_a + {swapped}_none", f"{swapped}_b + {swapped}_none"
    return f"({main}_a > 0 AND {not_b} > 0 OR {main}_b + {main}_none > 0 AND {not_a} > 0)"


def case_flags(main: DataFrame, swapped: DataFrame) -> DataFrame:
    """Per judge and item: ``incorrect``, ``unstable`` and ``tested`` (verdicts in both orders).

    One aggregation over both tables. Orders are matched by item only; prompt
    versions are not part of the key.
    """
    counts = (
        _both_orders(main, swapped)
        .filter(F.col("model").isNotNull())
        .groupBy("model", "sample_id")
        .agg(
            *count_verdicts("main", "NOT _swap"),
            *count_verdicts("swap", "_swap"),
            F.expr("count_if(NOT _swap AND NOT is_correct)").alias("_wrong"),
        )
    )
    return counts.selectExpr(
        "model",
        "sample_id",
        "_wrong > 0 AS incorrect",
        f"{_is_unstable('main', 'swap')} AS unstable",
        f"{total('main')} > 0 AND {total('swap')} > 0 AS tested",
    )


def unstable_items(main: DataFrame, swapped: DataFrame) -> DataFrame:
    """(model, sample_id) whose swapped verdict is not the opposite of the main one."""
    return case_flags(main, swapped).filter("unstable").select("model", "sample_id")


#: Judges in one bitmap of a bigint.
_BITS = 63


def case_bits(main: DataFrame, swapped: DataFrame, judges: Sequence[str]) -> DataFrame:
    """Per item, one row with bitmaps over the judges: what verdicts there are in either order.

    Cases only ask whether there is such a verdict, so a bit per judge is all that is kept of any number of rows,
    in buffers of a fixed width. Judges beyond 63 have bitmaps of their own.
    """
    if not judges:
        raise ValueError("no judges are listed")
    rows = _both_orders(main, swapped).filter(F.col("model").isin(*judges))
    place = F.coalesce(*[F.when(F.col("model") == j, F.lit(i)) for i, j in enumerate(judges)])
    placed = rows.withColumn("_place", place).selectExpr(
        "*", f"_place DIV {_BITS} AS _map", f"shiftleft(1L, _place % {_BITS}) AS _bit"
    )
    where = {
        "wrong": "NOT _swap AND NOT is_correct",
        "main_a": "NOT _swap AND parsed_winner <=> 'A'",
        "main_other": "NOT _swap AND NOT parsed_winner <=> 'A'",
        "swap_other": "_swap AND NOT parsed_winner <=> 'B'",
        "swap_b": "_swap AND parsed_winner <=> 'B'",
        "swap_not_a": "_swap AND NOT parsed_winner <=> 'A'",
    }
    maps = range((len(judges) + _BITS - 1) // _BITS)
    return placed.groupBy("sample_id").agg(
        *[
            F.coalesce(F.bit_or(F.expr(f"CASE WHEN _map = {m} AND {condition} THEN _bit END")), F.lit(0)).alias(f"_{name}{m}")
            for m in maps
            for name, condition in where.items()
        ]
    )


def _per_judge(bits: DataFrame, judges: Sequence[str], *kept: str) -> DataFrame:
    """``kept``, and for each judge ``incorrect``, ``unstable`` and ``tested``; unfolded inside the task, no shuffle.

    Cases are found for all judges of a bitmap at once; a constant array then gives each judge a bit to look at.
    """
    maps = range((len(judges) + _BITS - 1) // _BITS)
    cases = {
        "incorrect": "_wrong{0}",
        "unstable": "(_main_a{0} & _swap_other{0}) | (_main_other{0} & _swap_not_a{0})",
        "tested": "(_main_a{0} | _main_other{0}) & (_swap_b{0} | _swap_other{0})",
    }
    arrays = [
        f"array({', '.join(f'coalesce({found.format(m)}, 0L)' for m in maps)}) AS _{case}" for case, found in cases.items()
    ]
    places = F.array(
        *[
            F.struct(F.lit(j).alias("model"), F.lit(i // _BITS).alias("_map"), F.lit(1 << i % _BITS).cast("long").alias("_bit"))
            for i, j in enumerate(judges)
        ]
    ).cast("array<struct<model:string,_map:int,_bit:bigint>>")
    unfolded = bits.selectExpr(*kept, *arrays).select("*", F.inline(places))
    return unfolded.selectExpr(*kept, "model", *[f"get(_{c}, _map) & _bit <> 0 AS {c}" for c in cases])


def control_pool(
    items: DataFrame,
    main: DataFrame,
    swapped: DataFrame,
    judges: Sequence[str],
    require_tested: bool = False,
) -> DataFrame:
    """(model, sample_id) of items that are neither incorrect nor unstable for the judge.

    Items never judged count too, unless ``require_tested``. Items meet one row of bitmaps each; they are
    multiplied by the judges after that.
    """
    joined = items.select("sample_id").join(case_bits(main, swapped, judges), "sample_id", "left")
    clean = _per_judge(joined, judges, "sample_id").filter("NOT incorrect AND NOT unstable")
    return (clean.filter("tested") if require_tested else clean).select("model", "sample_id")


def _as_pool(flags: DataFrame, keys: Sequence[str], cases: Sequence[str]) -> DataFrame:
    """One row per id and case that holds for it."""
    held = F.array_compact(F.array(*[F.when(F.col(c), F.lit(c)) for c in cases]))
    return flags.select(*keys, F.explode(held).alias("case"))


def _first_case(picked: DataFrame, keys: Sequence[str], priority: Sequence[str]) -> DataFrame:
    """One label per id: the first in ``priority``. Quotas are not refilled."""
    rank = F.coalesce(*[F.when(F.col("case") == c, F.lit(i)) for i, c in enumerate(priority)])
    names = F.array(*[F.lit(c) for c in priority])
    best = picked.groupBy(*keys).agg(F.min(rank).alias("_rank"))
    return best.select(*keys, F.get(names, F.col("_rank")).alias("comment_case_type"))


def comment_subset_judge(
    items: DataFrame,
    main: DataFrame,
    swapped: DataFrame,
    judges: Sequence[str],
    quotas: Mapping[str, int] = JUDGE_QUOTAS,
    seed: int = 42,
    require_tested: bool = False,
) -> DataFrame:
    """Items to comment on, for every judge in one job.

    ``quotas`` maps incorrect, unstable and control to the most ids drawn of each,
    in order of priority. A judge without rows in the results gets controls only; `silent_judges` names those.
    """
    keys = ["model", "sample_id"]
    # Verdicts on unknown items count as incorrect and unstable cases, items without verdicts as controls.
    known = items.select("sample_id", F.lit(True).alias("_item"))
    everything = known.join(case_bits(main, swapped, judges), "sample_id", "full")
    clean = "_item AND NOT incorrect AND NOT unstable" + (" AND tested" if require_tested else "")
    flags = _per_judge(everything, judges, "sample_id", "_item").selectExpr("*", f"coalesce({clean}, false) AS control")
    pool = _as_pool(flags, keys, ["incorrect", "unstable", "control"])
    most = sum(quotas.values()) * len(judges)
    labelled = _first_case(draw_cases(pool, quotas, ["model"], seed, most), keys, list(quotas))
    chosen = labelled.withColumnRenamed("model", "comment_target_model")
    return items.join(bounded(chosen, most), "sample_id")


def silent_judges(judges: Sequence[str], *tables: DataFrame) -> DataFrame:
    """(model, rows) of the judges without a valid row in any of the tables, who would get controls only."""
    rows = union_runs(*[valid(t).select("model") for t in tables]).filter(F.col("model").isin(*judges))
    counted = rows.groupBy("model").agg(F.count("*").alias("rows"))
    asked = counted.sparkSession.createDataFrame([(j,) for j in judges], "model string")
    return asked.join(counted, "model", "left").filter("rows IS NULL").select("model", F.lit(0).cast("long").alias("rows"))


def comment_subset_shared(
    items: DataFrame,
    main: DataFrame,
    swapped: DataFrame,
    first: str,
    second: str,
    quotas: Mapping[str, int] = SHARED_QUOTAS,
    seed: int = 42,
) -> DataFrame:
    """Items to comment on for two judges together, with disagreements as a case of their own."""
    who = F.when(F.col("model") == first, 1).when(F.col("model") == second, 2)
    counts = (
        _both_orders(main, swapped)
        .withColumn("_who", who)
        .filter("_who IS NOT NULL")
        .groupBy("sample_id")
        .agg(
            *count_verdicts("m1", "_who = 1 AND NOT _swap"),
            *count_verdicts("m2", "_who = 2 AND NOT _swap"),
            *count_verdicts("s1", "_who = 1 AND _swap"),
            *count_verdicts("s2", "_who = 2 AND _swap"),
            F.expr("count_if(NOT _swap AND NOT is_correct)").alias("_wrong"),
        )
    )
    flags = counts.selectExpr(
        "sample_id",
        "_wrong > 0 AS incorrect",
        f"{_is_unstable('m1', 's1')} OR {_is_unstable('m2', 's2')} AS unstable",
        f"{total('m1')} * {total('m2')} > m1_a * m2_a + m1_b * m2_b AS disagreement",
    )
    bad = flags.filter("incorrect OR unstable OR disagreement").select("sample_id")
    controls = items.select("sample_id").join(bad, "sample_id", "left_anti")
    pool = _as_pool(flags, ["sample_id"], ["incorrect", "unstable", "disagreement"]).unionByName(
        controls.withColumn("case", F.lit("control"))
    )
    most = sum(quotas.values())
    labelled = _first_case(draw_cases(pool, quotas, [], seed, most), ["sample_id"], list(quotas))
    return items.join(bounded(labelled, most), "sample_id")
