"""Reproducible sampling without sorting the table or gathering a stratum.

A draw takes the rows with the smallest hash keys. Draws of a bounded size rank rows
under a literal bound, by which Spark cuts every stratum in each task before the shuffle.

For larger ones, rows are counted per stratum and key prefix; the counts tell how many
rows to take under each prefix. Rows are then matched and ranked per stratum *and
prefix*; prefixes get longer with the table, so that neither a huge stratum nor a huge
quota ends up in one task.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pairwright.functions.hashing import draw_key

# Rows of the table under one key prefix, if keys were spread over a single stratum.
PREFIX_ROWS = 100_000
# Tables that provably have no more rows than this are broadcast, larger ones are not.
BROADCAST_ROWS = 100_000


def bounded(df: DataFrame, most: int | None) -> DataFrame:
    """Mark ``df`` for broadcast if it cannot exceed ``most`` rows and that is few."""
    return F.broadcast(df) if most is not None and most <= BROADCAST_ROWS else df


def _takes(keyed: DataFrame, strata: Sequence[str], quota: Column) -> DataFrame:
    """How many rows to take per stratum and key prefix, for the prefixes that are needed.

    ``quota`` may refer to the stratum columns and to ``stratum_size``.
    """
    counts = keyed.groupBy(*strata, "_prefix").agg(F.count("*").alias("_cnt"))
    in_stratum = Window.partitionBy(*strata)
    running = F.sum("_cnt").over(in_stratum.orderBy("_prefix"))
    return (
        counts.withColumns({"_upto": running, "stratum_size": F.sum("_cnt").over(in_stratum)})
        .withColumn("_take", quota.cast("long") - F.col("_upto") + F.col("_cnt"))
        .filter("_take > 0")
        .select(*strata, "_prefix", "_take")
    )


def _ranked(df: DataFrame, by: Sequence[str], key: str, id_col: str, most: int) -> DataFrame:
    """The ``most`` rows of smallest key per group with their rank ``_rn``, cut in every task before the shuffle."""
    rank = F.row_number().over(Window.partitionBy(*by).orderBy(key, id_col))
    return df.withColumn("_rn", rank).filter(F.col("_rn") <= most)


def draw_bounded(
    df: DataFrame, key: Column, quota: Column, strata: Sequence[str], most: int, id_col: str = "sample_id"
) -> DataFrame:
    """``draw`` for quotas of at most ``most`` rows, a literal: the table is read once and nothing is counted."""
    columns = df.columns
    for name in strata:
        df = df.filter(F.col(name).isNotNull())
    ranked = _ranked(df.withColumn("_key", key), strata, "_key", id_col, most)
    return ranked.filter(F.col("_rn") <= quota).select(*columns)


def draw(
    df: DataFrame,
    key: Column,
    quota: Column,
    strata: Sequence[str] = (),
    most: int | None = None,
    id_col: str = "sample_id",
) -> DataFrame:
    """Rows with the smallest ``key`` in each stratum, ``quota`` of them or all if fewer.

    ``df`` should be narrow (ids and strata) with unique ids per stratum; ties of
    the key go by ``id_col``. Rows with a null stratum are left out. ``most``, where
    known, bounds the rows drawn over all strata and so the prefixes they fall
    under; few prefixes are broadcast and only rows under them are shuffled. The table
    is counted first, which tells how long a prefix has to be.
    """
    columns = df.columns
    for name in strata:
        df = df.filter(F.col(name).isNotNull())
    by = list(strata) or ["_all"]
    digits = max(1, math.ceil(math.log(max(df.count() / PREFIX_ROWS, 1), 16)))
    keyed = df if strata else df.withColumn("_all", F.lit(0))
    keyed = keyed.withColumn("_key", key).withColumn("_prefix", F.substring("_key", 1, digits))
    group = [*by, "_prefix"]
    rank = F.row_number().over(Window.partitionBy(*group).orderBy("_key", id_col))
    ranked = keyed.join(bounded(_takes(keyed, by, quota), most), group).withColumn("_rn", rank)
    if most is not None:
        # A literal bound, by which Spark cuts each group before the shuffle.
        ranked = ranked.filter(F.col("_rn") <= most)
    return ranked.filter(F.col("_rn") <= F.col("_take")).select(*columns)


def _enough(items: DataFrame, n: int) -> DataFrame:
    """``items``, or an error when there are fewer than n; reads on only until n rows are found."""
    one = items.select(F.lit(1))
    rows = len(one.take(n)) if n <= BROADCAST_ROWS else one.limit(n).count()
    if rows < n:
        raise ValueError(f"asked for {n} rows of {rows}")
    return items


def simple_sample(items: DataFrame, n: int, seed: int = 42) -> DataFrame:
    """Exactly n items, each equally likely; an error if there are fewer."""
    ids = _enough(items, n).select("sample_id")
    key = draw_key(seed, "sample_id")
    if n <= BROADCAST_ROWS:
        picked = ids.orderBy(key, "sample_id").limit(n)
    else:
        picked = draw(ids, key, F.lit(n), most=n)
    return items.join(bounded(picked, n), "sample_id", "left_semi")


def _quotas(ids: DataFrame, n: int, by: str) -> DataFrame:
    """(stratum, quota): the half-even share of n, at least one. Rows without a stratum count in the shares."""
    sizes = ids.groupBy(by).agg(F.count("*").alias("_size"))
    # A row per stratum is all that this window sees.
    total = F.sum("_size").over(Window.partitionBy(F.lit(0)))
    quota = F.greatest(F.lit(1.0), F.bround(n * F.col("_size") / total)).cast("long")
    return sizes.select(by, quota.alias("_quota")).filter(F.col(by).isNotNull())


def stratified_ids(items: DataFrame, n: int, seed: int = 42, by: str = "lang_code") -> DataFrame:
    """(sample_id, stratum) of a proportional sample: half-even share of n per stratum, at least one.

    Rounding can make the total differ from n; items without a stratum count in
    the shares but are not drawn. An error if there are fewer than n items.
    """
    ids = _enough(items, n).select("sample_id", by)
    key = draw_key(seed, by, "sample_id")
    if n <= BROADCAST_ROWS:
        ranked = _ranked(ids.filter(F.col(by).isNotNull()).withColumn("_key", key), [by], "_key", "sample_id", max(n, 1))
        drawn = ranked.join(_quotas(ids, n, by), by).filter(F.col("_rn") <= F.col("_quota"))
        return drawn.select("sample_id", by)
    rows = ids.agg(F.count("*").alias("rows")).scalar()
    share = F.bround(n * F.col("stratum_size") / rows)
    return draw(ids, key, F.greatest(F.lit(1.0), share), [by])


def stratified_sample(items: DataFrame, n: int, seed: int = 42, by: str = "lang_code") -> DataFrame:
    """Items of ``stratified_ids``."""
    return items.join(stratified_ids(items, n, seed, by).select("sample_id"), "sample_id", "left_semi")


def stratified_exact(items: DataFrame, n: int, seed: int = 42, by: str = "lang_code") -> DataFrame:
    """Proportional sample of exactly n items.

    Drawn items come first and the rest after them, both in hash order; the first
    n are kept. That trims a draw that is too large and tops up one too small. A draw of
    fewer than n leaves at least as many of the 2 n smallest keys as are lacking, so only
    those are looked at.
    """
    picked = stratified_ids(items, n, seed, by).select("sample_id", F.lit("0").alias("_class"))
    key = draw_key(seed, F.lit("exact"), "sample_id")
    ids = items.select("sample_id")
    if n <= BROADCAST_ROWS:
        rest = ids.orderBy(key, "sample_id").limit(2 * n)
        ranked = rest.join(picked, "sample_id", "full").withColumn("_class", F.coalesce("_class", F.lit("1")))
        kept = ranked.orderBy("_class", key, "sample_id").limit(n)
    else:
        ranked = ids.join(picked, "sample_id", "left").withColumn("_class", F.coalesce("_class", F.lit("1")))
        kept = draw(ranked, F.concat("_class", key), F.lit(n), most=n)
    return items.join(bounded(kept.select("sample_id"), n), "sample_id", "left_semi")


def draw_cases(
    pool: DataFrame, quotas: Mapping[str, int], strata: Sequence[str], seed: int, most: int
) -> DataFrame:
    """Up to ``quotas[case]`` ids per stratum and ``case``, ``most`` in all; the pool has no repeated ids."""
    quota = F.coalesce(*[F.when(F.col("case") == c, F.lit(n)) for c, n in quotas.items()])
    key = draw_key(seed, *strata, "case", "sample_id")
    largest = max(quotas.values())
    if largest <= BROADCAST_ROWS:
        return draw_bounded(pool, key, quota, [*strata, "case"], max(largest, 1))
    return draw(pool, key, quota, [*strata, "case"], most)


def distribution(df: DataFrame, column: str) -> DataFrame:
    """Rows per value, most frequent first; nulls are not listed."""
    return (
        df.filter(F.col(column).isNotNull())
        .groupBy(column)
        .agg(F.count("*").alias("n"))
        .orderBy(F.desc("n"), column)
    )
