"""Mixing sources to target weights along a curriculum."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pairwright.llm.tables import column, cut

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (3.0, 1.0, 2.0)
#: How a source's share changes over training, by the rank of the source: (time, relative weight) at the
#: ends of straight pieces, here rising, even and falling.
SCHEDULES = (((0.0, 0.5), (1.0, 1.5)), ((0.0, 1.0), (1.0, 1.0)), ((0.0, 1.5), (1.0, 0.5)))


def sizes(docs: DataFrame) -> DataFrame:
    """(doc_id, source, size): the words of every whole text; null texts have none."""
    return docs.select(
        column(docs, "doc_id", "bigint"),
        column(docs, "source", "string"),
        F.coalesce(F.regexp_count(F.col("text").cast("string"), F.lit(WORD)), F.lit(0)).cast("bigint").alias("size"),
    )


def targets(sized: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = 1.5, most: float = 2.0) -> DataFrame:
    """(source, rank, source_size, target) per source of (source, size).

    The sources by code point, null last, take `weights` in turn and share `share` times all words; none gets
    over `most` times its own, and what is left goes to the others by weight. With the sources in order of
    their limit per unit of weight, the first j are at their limits for the smallest j for which the share of
    the others stays under theirs. Sums of whole numbers are exact, so reruns agree.
    """
    if min(weights) <= 0:
        raise ValueError("weights must be above 0")
    per = sized.groupBy("source").agg(F.sum("size").cast("bigint").alias("source_size"))
    turn = F.array(*(F.lit(float(w)) for w in weights))
    per = per.withColumn("rank", F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1)
    per = per.withColumn("_weight", F.element_at(turn, F.col("rank") % len(weights) + 1))
    per = per.withColumn("_full", F.lit(float(most)) * F.col("source_size"))
    by_limit = W.orderBy(F.col("_full") / F.col("_weight"), "rank")
    before = by_limit.rowsBetween(W.unboundedPreceding, -1)
    every = W.orderBy("rank").rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    # The level per unit of weight if exactly the sources before this one are at their limits.
    per = per.withColumn(
        "_level",
        (F.lit(float(share)) * F.sum("source_size").over(every) - F.coalesce(F.sum("_full").over(before), F.lit(0.0)))
        / (F.sum("_weight").over(every) - F.coalesce(F.sum("_weight").over(before), F.lit(0.0))),
    )
    fits = F.col("_level") * F.col("_weight") <= F.col("_full")
    first = F.struct((F.col("_full") / F.col("_weight")).alias("limit"), F.col("rank").alias("at"), F.col("_level").alias("level"))
    per = per.withColumn("_first", F.min(F.when(fits, first)).over(every))
    shared = F.coalesce(F.col("_first.level") * F.col("_weight"), F.col("_full"))
    return per.select("source", "rank", "source_size", F.least(shared, "_full").alias("target"))


def mix(
    docs: DataFrame,
    weights: Sequence[float] = WEIGHTS,
    share: float = 1.5,
    most: float = 2.0,
    schedules: Sequence[Sequence[tuple[float, float]]] = SCHEDULES,
    rows_per_bucket: int = 256,
) -> DataFrame:
    """(doc_id, source, size, source_size, target, taken, position), by position.

    Within a source the documents stand in the order of a hash and form a stream of its words, which the mix
    takes from the start, again after its end, up to the target: `taken` is what it takes of a document, at
    most `most` times its size. A source's schedule says how densely its words lie over training time; its
    integral is the demand up to a time, and inverting that gives the time of each word. `position` is the
    number of words, of all sources, before the time of a document's first taken word; null if none is taken.

    Offsets are sums over hash buckets first and over the rows of a bucket then, so no task sees a whole
    source. Null texts and texts without words have size 0 and are never taken; a null source is a source, a
    null doc_id is hashed as an empty string; rows that are alike in all three columns stand next to each
    other, in either order. An empty table gives an empty table; further columns of `docs` are not read.
    """
    placed = _placed(docs, weights, share, most, schedules, rows_per_bucket)
    out = placed.select(
        "doc_id", "source", "size", "source_size", "target", "taken",
        F.when(F.col("taken") > 0, _position(F.col("_offset"), schedules)).alias("position"),
    )
    return out.orderBy(F.col("position").asc_nulls_last(), _hash(), "doc_id", "size")


def _placed(docs, weights, share, most, schedules, rows_per_bucket) -> DataFrame:
    """The rows of `mix` with what their positions follow from: `_offset`, the words before a row in its source, and demands."""
    sized = cut(sizes(docs))
    digits, rows = 1, sized.count()
    while rows > rows_per_bucket * 16**digits and digits < 8:
        digits += 1
    sized = sized.withColumn("_hash", _hash()).withColumn("_bucket", F.substring("_hash", 1, digits))
    sized = sized.withColumn("_key", _key())

    whole = targets(sized, weights, share, most).withColumn("_key", _key())
    every = W.orderBy("rank").rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    for i in range(len(schedules)):
        mine = F.when(F.col("rank") % len(schedules) == i, F.col("target"))
        whole = whole.withColumn(f"_sum{i}", F.coalesce(F.sum(mine).over(every), F.lit(0.0)))

    up_to = W.partitionBy("_key").orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)
    buckets = sized.groupBy("_key", "_bucket").agg(F.sum("size").alias("_size"))
    buckets = buckets.withColumn("_before", F.coalesce(F.sum("_size").over(up_to), F.lit(0)))
    offsets = buckets.drop("_size").join(whole.drop("source"), "_key")

    inside = W.partitionBy("_key", "_bucket").orderBy("_hash", F.col("doc_id").asc_nulls_first(), "size")
    inside = inside.rowsBetween(W.unboundedPreceding, -1)
    placed = sized.withColumn("_in", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    placed = placed.join(offsets, ["_key", "_bucket"])
    placed = placed.withColumn("_offset", F.col("_before") + F.col("_in"))
    takes = F.round("target").cast("bigint")
    rounds = F.when(F.col("source_size") > 0, F.expr("cast(round(target) as bigint) div source_size")).otherwise(F.lit(0))
    rest = takes - rounds * F.col("source_size")
    taken = F.col("size") * rounds + F.greatest(F.lit(0), F.least(F.col("size"), rest - F.col("_offset")))
    return placed.withColumn("taken", taken.cast("bigint"))


def _position(offset, schedules):
    """The words of all sources before the time at which a row's source has given out `offset` words, repeats included."""
    return F.floor(_demand(_time(offset / F.col("target"), F.col("rank"), schedules), schedules))


def _hash():
    return F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")))


def _key():
    """A source as a key that is never null."""
    return F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit("n"))


def _pieces(schedule: Sequence[tuple[float, float]]) -> list[tuple[float, float, float, float, float]]:
    """(start, length, weight, slope, demand before) of each piece, scaled to an integral of 1."""
    area = sum((b[0] - a[0]) * (a[1] + b[1]) / 2 for a, b in zip(schedule, schedule[1:]))
    if schedule[0][0] != 0 or schedule[-1][0] != 1 or area <= 0 or min(w for _, w in schedule) < 0:
        raise ValueError("a schedule runs from 0 to 1, with weights of 0 or more and some above")
    out, before = [], 0.0
    for a, b in zip(schedule, schedule[1:]):
        length = b[0] - a[0]
        out.append((a[0], length, a[1] / area, (b[1] - a[1]) / area / length, before))
        before += length * (a[1] + b[1]) / 2 / area
    return out


def _time(share, rank, schedules):
    """The time at which a source has demanded this share of its target: its integrated schedule, inverted."""

    def one(schedule):
        out = None
        for start, length, weight, slope, before in reversed(_pieces(schedule)):
            left = share - F.lit(before)
            if slope:
                root = F.sqrt(F.greatest(F.lit(0.0), F.lit(weight * weight) + F.lit(2 * slope) * left))
                at = F.lit(start) + (root - F.lit(weight)) / F.lit(slope)
            else:
                at = F.lit(start) + left / F.lit(weight) if weight else F.lit(start + length)
            end = F.lit(before + length * (weight + slope * length / 2))
            out = at if out is None else F.when(share < end, at).otherwise(out)
        return out

    return F.element_at(F.array(*(one(s) for s in schedules)), rank % len(schedules) + 1)


def _demand(time, schedules):
    """The words that all sources have demanded by this time."""
    total = F.lit(0.0)
    for i, schedule in enumerate(schedules):
        part = None
        for start, length, weight, slope, before in reversed(_pieces(schedule)):
            x = time - F.lit(start)
            by_now = F.lit(before) + F.lit(weight) * x + F.lit(slope / 2) * x * x
            part = by_now if part is None else F.when(time < F.lit(start + length), by_now).otherwise(part)
        total = total + F.col(f"_sum{i}") * part
    return total


def passes(
    docs: DataFrame,
    weights: Sequence[float] = WEIGHTS,
    share: float = 1.5,
    most: float = 2.0,
    schedules: Sequence[Sequence[tuple[float, float]]] = SCHEDULES,
    rows_per_bucket: int = 256,
) -> DataFrame:
    """`docs` as the mix takes them, its columns kept: a row for each time a document is taken as a whole.

    A document of which the mix takes a part counts as taken if that is half of it or more. Rows come in the
    order of training positions, and each pass has its own: in round p of a source a document begins p times
    the source's words after its first place, and the demand for that many words is inverted as in `mix`.
    Documents without words, of which nothing can be taken, are left out.
    """
    return _timed(docs, weights, share, most, schedules, rows_per_bucket).orderBy("_pw_position", "_pw_pass").select([F.col(f"`{c}`") for c in docs.columns])


def _timed(docs, weights, share, most, schedules, rows_per_bucket) -> DataFrame:
    """The rows of `passes`, unsorted, with `_pw_pass` from 0 and `_pw_position` beside the columns of `docs`."""
    plan = _placed(docs, weights, share, most, schedules, rows_per_bucket).where(F.col("taken") > 0)
    plan = plan.withColumn("_times", F.floor(F.col("taken") / F.col("size") + F.lit(0.5)).cast("int")).where(F.col("_times") > 0)
    # Rows alike in id, source and size stand next to each other and share one row of the plan, with as many passes as they have together.
    fixed = ["source_size", "target", "rank", *(f"_sum{i}" for i in range(len(schedules)))]
    plan = plan.groupBy(F.col("doc_id").alias("_pw_id"), F.col("_key").alias("_pw_key"), F.col("size").alias("_pw_size")).agg(
        *(F.first(c).alias(c) for c in fixed), F.min("_offset").alias("_offset"), F.ceil(F.sum("_times") / F.count("*")).cast("int").alias("_all")
    )
    plan = plan.withColumn("_pw_pass", F.explode(F.sequence(F.lit(0), F.col("_all") - 1)))
    position = _position(F.col("_offset") + F.col("_pw_pass") * F.col("source_size"), schedules)
    plan = cut(plan.select("_pw_id", "_pw_key", "_pw_size", "_pw_pass", position.alias("_pw_position")))
    words = F.coalesce(F.regexp_count(F.col("text").cast("string"), F.lit(WORD)), F.lit(0)).cast("bigint")
    on = (
        F.col("`doc_id`").cast("bigint").eqNullSafe(F.col("_pw_id"))
        & (F.coalesce(F.concat(F.lit("s"), F.col("`source`").cast("string")), F.lit("n")) == F.col("_pw_key"))
        & (words == F.col("_pw_size"))
    )
    return docs.join(plan, on)
