"""How filters interact: what each removes in every order of applying them.

A document counts by the mask of the filters it fails. Every mask stands for one
big integer, whose 64-bit fields hold what happens to such a document at each of the
five steps of each of the 120 orders: 600 steps of six counters. The integers of a
part's documents are summed, and the fields of the sum are the part's counts: a
field holds 2**64, more than there are documents, so none carries into the next.
"""

from __future__ import annotations

from functools import lru_cache
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairwright.llm.tables import column, cut, ship

FILTERS = "ABCDE"
ORDERS = ["".join(p) for p in permutations(FILTERS)]
STEPS = [(order, step) for order in ORDERS for step in range(len(FILTERS))]
FIELDS = ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost"]
#: Bits of a field.
BITS = 64
RESULT = "part string, filter_order string, step int, " + ", ".join(f"{f} bigint" for f in [*FIELDS, "shapley"])
#: Parts into which rows without an id are dealt where rows are matched by id.
_SPREAD = 4096


def outcomes(mask: int, good: bool, toxic: bool) -> list[tuple[int, ...]]:
    """The six counters of one document at every step; bit i of the mask is the i-th filter."""
    found = []
    for order, step in STEPS:
        own = 1 << FILTERS.index(order[step])
        before = sum(1 << FILTERS.index(f) for f in order[:step])
        gone, fails = bool(mask & before), bool(mask & own)
        removed = fails and not gone
        found.append(
            (not gone and not fails, removed, gone and fails, mask == own, removed and good, removed and toxic)
        )
    return [tuple(map(int, row)) for row in found]


@lru_cache(maxsize=None)
def packed(mask: int, good: bool, toxic: bool) -> int:
    """All counters of one document in one integer, a field each."""
    flat = np.array(outcomes(mask, good, toxic), "<u8")
    return int.from_bytes(flat.tobytes(), "little")


def unpack(total: int) -> np.ndarray:
    """The counters [step, field] of a sum of such integers."""
    size = len(STEPS) * len(FIELDS)
    return np.frombuffer(total.to_bytes(size * BITS // 8, "little"), "<u8").astype(np.int64).reshape(-1, len(FIELDS))


def _report(key: tuple, table: pa.Table) -> pa.Table:
    total = 0
    for mask, good, toxic, n in zip(*(table.column(c).to_pylist() for c in ("mask", "good", "toxic", "n"))):
        total += n * packed(mask, good, toxic)
    counts = unpack(total)
    at = np.array([FILTERS.index(order[step]) for order, step in STEPS])
    removed = counts[:, FIELDS.index("removed")]
    shapley = np.array([removed[at == f].sum() for f in range(len(FILTERS))])
    columns = [
        pa.array([key[0].as_py()] * len(STEPS), pa.string()),
        pa.array([order for order, _ in STEPS], pa.string()),
        pa.array([step + 1 for _, step in STEPS], pa.int32()),
        *(pa.array(counts[:, i], pa.int64()) for i in range(len(FIELDS))),
        pa.array(shapley[at], pa.int64()),
    ]
    return pa.Table.from_arrays(columns, names=[f.split()[0] for f in RESULT.split(", ")])


def _text_mask() -> str:
    """The filters that look at one text alone, as SQL over ``t``, ``_n`` words and ``_different`` of them."""
    conditions = [
        "_n < 50",
        "100 * _different < 65 * _n",
        r"100 * (length(t) - length(regexp_replace(t, '[A-Z]+', ''))) > 5 * length(t)",
        "t RLIKE '[#$%&*|]'",
    ]
    return " + ".join(f"IF({c}, {1 << i}, 0)" for i, c in enumerate(conditions))


def failures(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, mask, good, toxic, n): how many documents fail which filters, by part and label.

    Texts are read once and reduced to a hash, an id and a mask. The first id of every text is found by an
    aggregation; a row that is not that one repeats a smaller id's text. Matching goes by text and id, so
    neither a text of many copies nor rows without an id meet in one task.
    """
    texts = docs.select(
        column(docs, "doc_id", "bigint"),
        F.coalesce(F.col("`source`").cast("string"), F.lit("")).alias("part"),
        F.coalesce(F.col("`text`").cast("string"), F.lit("")).alias("t"),
    )
    words = texts.withColumn("_words", F.split(F.btrim("t", F.lit(" \t\n\x0b\f\r")), r"[ \t-\r]+"))
    counted = words.selectExpr(
        "*", "IF(_words[0] = '', 0, size(_words)) AS _n", "IF(_words[0] = '', 0, size(array_distinct(_words))) AS _different"
    )
    masked = cut(counted.selectExpr("doc_id", "part", "unhex(sha2(t, 256)) AS text_id", f"{_text_mask()} AS mask"))
    first = masked.where("doc_id IS NOT NULL").groupBy("text_id").agg(F.min("doc_id").alias("doc_id"))
    marked = masked.join(first.withColumn("_first", F.lit(True)), ["text_id", "doc_id"], "left")
    repeated = F.col("doc_id").isNotNull() & F.col("_first").isNull()
    rows = marked.select(
        "doc_id", "part", (F.col("mask") + F.when(repeated, 16).otherwise(0)).alias("mask"),
        F.when(F.col("doc_id").isNull(), 1 + F.pmod(F.xxhash64("text_id", "part"), F.lit(_SPREAD))).otherwise(0).alias("_salt"),
    )
    told = labels.select(
        column(labels, "doc_id", "bigint"), column(labels, "quality", "bigint"), column(labels, "toxic", "bigint")
    )
    judged = told.where("doc_id IS NOT NULL").groupBy("doc_id").agg(
        F.bool_or(F.coalesce(F.col("quality") == 1, F.lit(False))).alias("good"),
        F.bool_or(F.coalesce(F.col("toxic") == 1, F.lit(False))).alias("toxic"),
    )
    joined = rows.join(judged.withColumn("_salt", F.lit(0).cast("bigint")), ["doc_id", "_salt"], "left")
    flags = [F.coalesce(F.col(c), F.lit(False)).alias(c) for c in ("good", "toxic")]
    return joined.groupBy("part", "mask", *flags).agg(F.count("*").alias("n"))


def interactions(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per part, order of the filters and step; see `RESULT`.

    ``docs`` has (doc_id, text, source), ``labels`` (doc_id, quality, toxic). Filters: A under 50 words, B fewer
    than 65 % different words, C more than 5 % letters A-Z, D any of #$%&*|, E the text of a smaller doc_id
    anywhere. A part is a source. Null texts count as empty, null sources as the empty one. A row without a
    doc_id repeats nothing, nothing repeats it, and no label is its own; rows that repeat a doc_id count each and
    don't repeat each other; of several labels of a doc_id any 1 counts. Other columns are not read. An empty
    table has no parts. Documents are counted by mask where they are read, so a part is at most 128 rows when its
    integers are summed, however many documents it has.
    """
    ship(docs.sparkSession)
    return failures(docs, labels).groupBy("part").applyInArrow(_report, RESULT)
