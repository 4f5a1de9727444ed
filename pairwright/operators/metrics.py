"""Agreement with humans and stability, per judge.

Every metric reduces the judgements to (n, k) per group first; intervals and
tests are computed on those few rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pairwright.functions.labels import swap_consistent, verdict
from pairwright.functions.statistics import with_binom_test, with_bootstrap_ci
from pairwright.operators.pairing import (
    SWAP_KEYS,
    count_verdicts,
    listed,
    pairs_with,
    product,
    prompt_counts,
    swap_counts,
    total,
    union_runs,
    valid,
)
from pairwright.operators.sampling import bounded


def _rate(counted: DataFrame, name: str) -> DataFrame:
    """Turn ``n``/``k`` into the rate and its interval; groups without a usable row vanish."""
    return with_bootstrap_ci(
        counted.filter("n > 0").withColumn(name, F.try_divide(F.col("k").cast("double"), F.col("n").cast("double")))
    )


def agreement_counts(judgments: DataFrame, *by: str) -> DataFrame:
    """Scored rows ``n`` and correct ones ``k`` per group; rows with a null group drop out."""
    rows = valid(judgments)
    for name in by:
        rows = rows.filter(F.col(name).isNotNull())
    return rows.groupBy(*by).agg(
        F.count("is_correct").alias("n"), F.count_if("is_correct").alias("k")
    )


def agreement_by_model(judgments: DataFrame) -> DataFrame:
    """Validity per judge: rate, bootstrap interval and exact test against chance."""
    rated = with_binom_test(_rate(agreement_counts(judgments, "model"), "agreement_rate"))
    return rated.select(
        "model", "n", "agreement_rate", "ci_lower", "ci_upper", "binom_pvalue", "binom_log10_p"
    ).orderBy(F.desc("agreement_rate"), "model")


def _summary(counts: DataFrame, flag: str, rate: str) -> DataFrame:
    """Rows ``overall`` and ``lang=xx`` per judge.

    The table is aggregated once by judge and language; the overall rows are
    grouping sets over that small result, not over the judgements.
    """
    per_language = (
        pairs_with(counts, flag, "model", "lang_code")
        .groupBy("model", "lang_code")
        .agg(F.sum("n").alias("n"), F.sum("k").alias("k"))
    )
    model, lang = F.col("model"), F.col("lang_code")
    grouped = per_language.groupingSets([[model], [model, lang]], model, lang).agg(
        F.grouping("lang_code").alias("is_overall"), F.sum("n").alias("n"), F.sum("k").alias("k")
    )
    labelled = grouped.filter("is_overall = 1 OR lang_code IS NOT NULL").withColumn(
        "group", F.when(F.col("is_overall") == 1, "overall").otherwise(F.concat(F.lit("lang="), lang))
    )
    return (
        _rate(labelled, rate)
        .orderBy("model", F.desc("is_overall"), "group")
        .select("group", "model", "n", rate, "ci_lower", "ci_upper")
    )


def swap_consistency(main: DataFrame, swapped: DataFrame, languages: Sequence[str] | None = None) -> DataFrame:
    """Share of verdicts that follow the texts when their order is swapped.

    ``languages``, where known, saves a shuffle; see ``pair_counts``.
    """
    return _summary(swap_counts(main, swapped, languages), "swap_consistent", "swap_consistency_rate")


def prompt_consistency(main: DataFrame, other: DataFrame, languages: Sequence[str] | None = None) -> DataFrame:
    """Share of verdicts that stay when the prompt is reworded; ``languages`` as in ``swap_consistency``."""
    return _summary(prompt_counts(main, other, languages), "prompt_consistent", "prompt_consistency_rate")


def first_verdict(ordinal: str, where: Column | None = None) -> Column:
    """Aggregate: first verdict in file order, rows without one skipped.

    Two minima of the ordinal stand in for ``min_by``: with a whole-number ordinal
    their buffers are fixed-width, so Spark aggregates by hash instead of by sort.
    """
    found = verdict(F.col("parsed_winner"))
    found = found if where is None else F.when(where, found)
    a = F.min(F.when(found == "A", F.col(ordinal)))
    b = F.min(F.when(found == "B", F.col(ordinal)))
    return F.when(a.isNotNull() & (b.isNull() | (a < b)), "A").when(b.isNotNull(), "B")


def verdict_pivot(judgments: DataFrame, ordinal: str = "row_ordinal") -> DataFrame:
    """First verdict per item, judge and prompt, one column per answer order."""
    rows = valid(judgments)
    for name in SWAP_KEYS:
        rows = rows.filter(F.col(name).isNotNull())
    wide = rows.groupBy(*SWAP_KEYS).agg(
        first_verdict(ordinal, ~F.col("swap_order")).alias("winner_plain"),
        first_verdict(ordinal, F.col("swap_order")).alias("winner_swapped"),
    )
    return wide.filter(F.coalesce("winner_plain", "winner_swapped").isNotNull())


def swap_single_file(judgments: DataFrame, ordinal: str = "row_ordinal") -> DataFrame:
    """Swap consistency per judge from one table that mixes both orders."""
    flag = swap_consistent(F.col("winner_plain"), F.col("winner_swapped"))
    counted = (
        verdict_pivot(judgments, ordinal)
        .groupBy("model")
        .agg(F.count(flag).alias("n"), F.count_if(flag == 1).alias("k"))
    )
    return (
        _rate(counted, "swap_consistency_rate")
        .select("model", "n", "swap_consistency_rate", "ci_lower", "ci_upper")
        .orderBy(F.desc("swap_consistency_rate"), "model")
    )


def _prompt_pairs(rows: DataFrame, ordinal: str, prompts: Sequence[str]) -> DataFrame:
    """(model, base_prompt, other_prompt, n, k) where the prompts are listed.

    The first verdicts of an item and judge stand side by side, a column per prompt, so pairs are compared inside
    a row and summed per judge: verdicts are shuffled once, and then one row per judge and task.
    """
    names = sorted(prompts)
    slot = rows.withColumn("_slot", listed("prompt_version", names))
    wide = slot.groupBy("model", "sample_id").agg(
        *[first_verdict(ordinal, F.col("_slot") == i).alias(f"_w{i}") for i in range(len(names))]
    )
    pairs = [(i, j) for i in range(len(names)) for j in range(i, len(names))]
    counted = wide.groupBy("model").agg(
        *[F.count_if(F.col(f"_w{i}").isNotNull() & F.col(f"_w{j}").isNotNull()).alias(f"_n{i}_{j}") for i, j in pairs],
        *[F.count_if(F.col(f"_w{i}") == F.col(f"_w{j}")).alias(f"_k{i}_{j}") for i, j in pairs],
    )
    # A prompt paired with itself tells whether the judge has it; the first of those is the base.
    base = F.coalesce(*[F.when(F.col(f"_n{i}_{i}") > 0, F.lit(i)) for i in range(len(names))])
    rows_of = [
        F.struct(
            F.lit(i).alias("_base"), F.lit(names[i]).alias("base_prompt"), F.lit(names[j]).alias("other_prompt"),
            F.col(f"_n{i}_{j}").alias("n"), F.col(f"_k{i}_{j}").alias("k"),
        )
        for i, j in pairs
        if i < j
    ]
    if not rows_of:
        rows_of = [F.lit(None).cast("struct<_base:int,base_prompt:string,other_prompt:string,n:bigint,k:bigint>")]
    unfolded = counted.withColumn("_first", base).select("model", "_first", F.inline(F.array(*rows_of)))
    return unfolded.filter("_base = _first AND n > 0").drop("_base", "_first")


def prompt_single_file(
    judgments: DataFrame,
    ordinal: str = "row_ordinal",
    swap: bool | None = None,
    judges: Sequence[str] | None = None,
    prompts: Sequence[str] | None = None,
) -> DataFrame:
    """Consistency of every prompt with the alphabetically first one of the judge.

    As in the reference behaviour both answer orders count unless ``swap`` picks one.
    ``judges`` restricts the judges and bounds the table of their first prompts,
    which is then broadcast; without it Spark chooses the join. Where the ``prompts``
    are listed no join is needed; a prompt that is not listed is an error.
    """
    rows = valid(judgments, swap)
    if judges is not None:
        rows = rows.filter(F.col("model").isin(*judges))
    for name in SWAP_KEYS:
        rows = rows.filter(F.col(name).isNotNull())
    if prompts is not None:
        counted = _prompt_pairs(rows, ordinal, prompts)
    else:
        first = (
            rows.groupBy(*SWAP_KEYS)
            .agg(first_verdict(ordinal).alias("winner"))
            .filter("winner IS NOT NULL")
        )
        base = first.groupBy("model").agg(F.min("prompt_version").alias("base_prompt"))
        per_item = Window.partitionBy("model", "sample_id")
        is_base = F.col("prompt_version") == F.col("base_prompt")
        compared = (
            first.join(bounded(base, None if judges is None else len(judges)), "model")
            .withColumn("base_winner", F.max(F.when(is_base, F.col("winner"))).over(per_item))
            .filter(~is_base & F.col("base_winner").isNotNull())
        )
        counted = compared.groupBy(
            "model", "base_prompt", F.col("prompt_version").alias("other_prompt")
        ).agg(F.count("*").alias("n"), F.count_if(F.col("winner") == F.col("base_winner")).alias("k"))
    return (
        _rate(counted, "prompt_consistency_rate")
        .select(
            "model", "base_prompt", "other_prompt", "n", "prompt_consistency_rate", "ci_lower", "ci_upper"
        )
        .orderBy("model", F.desc("prompt_consistency_rate"), "other_prompt")
    )


def parse_coverage(judgments: DataFrame) -> DataFrame:
    """Rows, replies, errors and effective n per judge and condition."""
    return judgments.groupBy("model", "prompt_version", "swap_order").agg(
        F.count("*").alias("n_rows"),
        F.count("raw_response").alias("n_replies"),
        F.count_if(F.col("raw_response").isNull() & F.col("error").isNull()).alias("n_empty"),
        F.count("error").alias("n_errors"),
        F.count_if("parse_success").alias("n_effective"),
        F.avg(F.col("parse_success").cast("double")).alias("parse_rate"),
    )


def parse_method_mix(parsed: DataFrame) -> DataFrame:
    """How often each parsing rule decided, per judge."""
    return parsed.groupBy("model", "parse_method").agg(F.count("*").alias("n"))


def _board_counts(main: DataFrame, swapped: DataFrame, other_prompt: DataFrame) -> DataFrame:
    """Per judge, ``n`` and ``k`` of validity, swap and prompt pairs.

    The three tables are read once and counted together by item, judge and prompt. Swap pairs are products within
    such a row, prompt pairs products of its sums over the prompts.
    """
    plain = ~F.col("swap_order") if "swap_order" in main.columns else F.lit(True)

    def side(rows: DataFrame, tag: int, is_plain: Column) -> DataFrame:
        return rows.filter(F.col("model").isNotNull()).select(
            *SWAP_KEYS, "parsed_winner", "is_correct", F.lit(tag).alias("_table"), is_plain.alias("_plain")
        )

    sides = [
        side(valid(main), 0, plain),
        side(valid(swapped, True), 1, F.lit(True)),
        side(valid(other_prompt, False), 2, F.lit(True)),
    ]
    counts = union_runs(*sides).groupBy(*SWAP_KEYS).agg(
        *count_verdicts("main", "_table = 0 AND _plain"),
        *count_verdicts("swap", "_table = 1"),
        *count_verdicts("other", "_table = 2"),
        F.expr("count_if(_table = 0 AND is_correct IS NOT NULL)").alias("validity_n"),
        F.expr("count_if(_table = 0 AND is_correct)").alias("validity_k"),
    )
    swaps = counts.selectExpr(
        "*",
        f"{product('main_a + main_b', 'swap_a + swap_b')} AS swap_n",
        f"{product('main_a', 'swap_b')} + {product('main_b', 'swap_a')} AS swap_k",
    )
    summed = [f"{side}_{s}" for side in ("main", "other") for s in ("a", "b", "none")]
    summed += ["validity_n", "validity_k", "swap_n", "swap_k"]
    items = swaps.groupBy("sample_id", "model").agg(*[F.sum(c).alias(c) for c in summed])
    pairs = items.selectExpr(
        "*",
        f"{product(total('main'), total('other'))} AS prompt_n",
        f"{product('main_a', 'other_a')} + {product('main_b', 'other_b')} AS prompt_k",
    )
    rates = [f"{p}_{c}" for p in ("validity", "swap", "prompt") for c in "nk"]
    return pairs.groupBy("model").agg(*[F.sum(c).alias(c) for c in rates]).filter("validity_n > 0")


def judge_leaderboard(
    main: DataFrame, swapped: DataFrame, other_prompt: DataFrame
) -> DataFrame:
    """Validity, swap and prompt stability side by side, in percent with one decimal; nulls where nothing matches."""
    board = _board_counts(main, swapped, other_prompt)
    columns = ["model"]
    for part in ("validity", "swap", "prompt"):
        n, k = f"{part}_n", f"{part}_k"
        share = F.try_divide(F.col(k).cast("double"), F.col(n).cast("double"))
        rated = with_bootstrap_ci(board.withColumn(f"{part}_pct", share), n, k)
        bounds = {f"{part}_{b}_pct": F.round(100 * F.col(b), 1) for b in ("ci_lower", "ci_upper")}
        board = rated.withColumns(
            {f"{part}_pct": F.round(100 * F.col(f"{part}_pct"), 1), **bounds, n: F.when(F.col(n) > 0, F.col(n))}
        ).drop("ci_lower", "ci_upper", k)
        columns += [f"{part}_pct", *bounds, n]
    return board.select(*columns).orderBy(F.desc("validity_pct"), "model")


def metrics_summary(main: DataFrame, swap: DataFrame, prompt: DataFrame) -> DataFrame:
    """One row: how many rows each metric table has."""
    tables = {"main": main, "swap": swap, "prompt": prompt}
    tags = [t.select(F.lit(name).alias("metric")) for name, t in tables.items()]
    return union_runs(*tags).agg(
        *[F.count_if(F.col("metric") == name).alias(f"{name}_metrics_rows") for name in tables]
    )
