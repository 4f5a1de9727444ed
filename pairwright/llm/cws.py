"""Document fingerprints by consistent weighted sampling."""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pairwright.llm.batches import slices
from pairwright.llm.tables import column, cut, map_arrow

SAMPLES = 64
_GOLDEN = np.uint64(0x9E3779B97F4A7C15)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def term_hashes(terms: list[str]) -> np.ndarray:
    return np.array([int.from_bytes(hashlib.blake2b(t.encode("utf-8", "replace"), digest_size=8).digest(), "little") for t in terms], np.uint64)


def draws(terms: np.ndarray, weights: np.ndarray, samples: int = SAMPLES) -> tuple[np.ndarray, np.ndarray]:
    """For each weighted term and sample: the log of its arrival, of which the least wins, and what it then stands for.

    r and c are gamma(2, 1) and b is uniform, all fixed by term and sample. A weight w falls into the step
    t = floor(ln w / r + b) of the term, starts at y = exp(r (t - b)) there, and arrives at c / (y exp(r)):
    so equal steps of a term arrive alike in all documents, and two documents agree on a sample with the
    probability of their generalised Jaccard similarity.
    """
    seeds = _mixed(terms)[:, None] + np.arange(1, samples + 1, dtype=np.uint64)[None, :] * _GOLDEN
    one, two, three = _mixed(seeds), _mixed(seeds ^ np.uint64(0xA5A5A5A5A5A5A5A5)), _mixed(seeds + np.uint64(0x632BE59BD9B4E019))
    half, low = np.uint64(32), np.uint64(0xFFFFFFFF)

    def uniform(x):
        return (x.astype(np.float32) + np.float32(0.5)) * np.float32(2.0**-32)

    r = -np.log(np.maximum(uniform(one >> half) * uniform(one & low), np.float32(1e-30)))
    c = -np.log(np.maximum(uniform(two >> half) * uniform(two & low), np.float32(1e-30)))
    b = uniform(three >> half)
    step = np.floor(np.log(weights.astype(np.float32))[:, None] / r + b)
    arrival = np.log(np.maximum(c, np.float32(1e-30))) - r * (step - b) - r
    code = _mixed(seeds ^ (step.astype(np.int64).astype(np.uint64) * _GOLDEN)) >> np.uint64(48)
    return arrival, code.astype(np.uint16)


def signatures(texts: list[str], samples: int = SAMPLES) -> tuple[np.ndarray, np.ndarray]:
    """(a row of codes per text, whether it has terms). Terms are the lower-case words, weighed by their number.

    Every (term, weight) of the batch is drawn once, in blocks.
    """
    number: dict[tuple[str, int], int] = {}
    which, sizes = [], []
    for text in texts:
        counted = Counter(text.lower().split())
        which += [number.setdefault(item, len(number)) for item in counted.items()]
        sizes.append(len(counted))
    out = np.zeros((len(texts), samples), np.uint16)
    sizes = np.array(sizes, np.int64)
    if number:
        terms, weights = term_hashes([t for t, _ in number]), np.array([w for _, w in number], np.float64)
        arrival = np.empty((len(number), samples), np.float32)
        code = np.empty((len(number), samples), np.uint16)
        for at in range(0, len(number), 8192):
            arrival[at : at + 8192], code[at : at + 8192] = draws(terms[at : at + 8192], weights[at : at + 8192], samples)
        which, ends = np.array(which, np.int64), np.cumsum(sizes)
        for i in np.flatnonzero(sizes).tolist():
            mine = which[ends[i] - sizes[i] : ends[i]]
            best = mine[arrival[mine].argmin(0)]
            out[i] = code[best, np.arange(samples)]
    return out, sizes > 0


def likeness(a: np.ndarray, b: np.ndarray, a_has: np.ndarray, b_has: np.ndarray) -> np.ndarray:
    """The share of equal samples by row; texts without terms are like each other and unlike all others."""
    return np.where(a_has & b_has, (a == b).mean(1), (a_has == b_has).astype(np.float64))


def fingerprint(docs: DataFrame, samples: int = SAMPLES) -> DataFrame:
    """(doc_id, fingerprint) per row of (doc_id, text): the codes in hexadecimal, empty for texts without words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", 2_000_000):
            codes, has = signatures([t or "" for t in batch.column("text").to_pylist()], samples)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(_hex(codes, has), pa.string())], names=["doc_id", "fingerprint"])

    own = docs.select(column(docs, "doc_id", "bigint"), column(docs, "text", "string"))
    return map_arrow(own, run, "doc_id bigint, fingerprint string")


def _hex(codes: np.ndarray, has: np.ndarray) -> list[str]:
    return [row.astype(">u2").tobytes().hex() if ok else "" for row, ok in zip(codes, has.tolist())]


EDITED = (
    "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, "
    "near_edited double, near_next double"
)


def in_order(docs: DataFrame, rows_per_part: int = 5000) -> DataFrame:
    """(doc_id, text) in ranges of descending doc_id, a task each, sorted within.

    The ranges are of some `rows_per_part` rows. Rows of one id come in the order of their texts' hashes, and so
    do null ids, which come last: either may be in many ranges. Null texts are empty.
    """
    own = docs.select(column(docs, "doc_id", "bigint"), F.coalesce(column(docs, "text", "string"), F.lit("")).alias("text"))
    keys = F.col("doc_id").desc_nulls_last(), F.col("tie").asc()
    parts = max(1, -(-docs.count() // rows_per_part))
    return own.withColumn("tie", F.xxhash64("text")).repartitionByRange(parts, *keys).sortWithinPartitions(*keys).select("doc_id", "text")


#: What a task over a range gives: finished rows, and its first and last row as ends.
IN_RANGE = EDITED + ", part int, end string, text string"


def compare_edited(docs: DataFrame, samples: int = SAMPLES, rows_per_part: int = 5000) -> DataFrame:
    """Fingerprints of every text and of an edit of it, and how alike they and the next text are.

    The edit replaces the last half of a text (rounded down) by as many first code points of the next
    document by descending doc_id, or by all of it if it is shorter; the last document is followed by the
    first. Rows of one id are neighbours of each other; a single row is its own next one. Texts are shuffled
    once, into ranges of ids. The last row of a range waits for the first one of the next range; these rows,
    one a range, are joined afterwards.
    """
    names = [f.split()[0] for f in EDITED.split(", ")]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64(), pa.int32(), pa.string(), pa.string()]

    def end(part: int, side: str, row: tuple) -> pa.RecordBatch:
        values = [row[0], *[None] * (len(names) - 1), part, side, row[1]]
        return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(values, kinds)], names=[*names, "part", "end", "text"])

    def within(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, before = TaskContext.get().partitionId(), None
        for batch in slices(batches, "text", 2_000_000):
            pairs = []
            for row in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                if before is None:
                    yield end(part, "first", row)
                else:
                    pairs.append((*before, row[1]))
                before = row
            if pairs:
                done = _compared(pairs, samples)
                yield pa.RecordBatch.from_arrays([*done.columns, *(pa.nulls(len(pairs), k) for k in kinds[len(names) :])], names=[*names, "part", "end", "text"])
        if before is not None:
            yield end(part, "last", before)

    def across(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", 2_000_000):
            # Each pair by itself: two rows of ends may lie anywhere.
            for pair in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text", "after"))):
                yield _compared([pair], samples)

    found = cut(map_arrow(in_order(docs, rows_per_part), within, IN_RANGE))
    # The numbers of ranges are ordered in one task, without texts; after the last non-empty range comes the first.
    parts = found.where("end = 'first'").select("part")
    following = parts.select("part", F.coalesce(F.lead("part").over(W.orderBy("part")), F.min("part").over(W.partitionBy())).alias("next"))
    firsts = found.where("end = 'first'").select(F.col("part").alias("next"), F.col("text").alias("after"))
    pairs = found.where("end = 'last'").select("part", "doc_id", "text").join(following, "part").join(firsts, "next")
    return found.where("end is null").select(*names).union(map_arrow(pairs.select("doc_id", "text", "after"), across, EDITED))


def _compared(pairs: list[tuple], samples: int) -> pa.RecordBatch:
    edited = []
    for _, text, after in pairs:
        half = len(text) // 2
        edited.append(text[: len(text) - half] + after[:half])
    n = len(pairs)
    codes, has = signatures([text for _, text, _ in pairs] + edited + [pairs[-1][2]], samples)
    # The next text of a pair is the text of the pair after it, except where a range ends.
    following = np.arange(1, n + 1)
    following[-1] = 2 * n
    ends = [i for i in range(n - 1) if pairs[i][2] != pairs[i + 1][1]]
    if ends:
        more, more_has = signatures([pairs[i][2] for i in ends], samples)
        following[ends] = len(codes) + np.arange(len(ends))
        codes, has = np.concatenate([codes, more]), np.concatenate([has, more_has])
    own, own_has = codes[:n], has[:n]
    columns = [
        pa.array([d for d, _, _ in pairs], pa.int64()),
        pa.array([len(t) for _, t, _ in pairs], pa.int64()),
        pa.array([hashlib.sha256(e.encode("utf-8", "replace")).hexdigest() for e in edited], pa.string()),
        pa.array(_hex(own, own_has), pa.string()),
        pa.array(_hex(codes[n : 2 * n], has[n : 2 * n]), pa.string()),
        pa.array(likeness(own, codes[n : 2 * n], own_has, has[n : 2 * n])),
        pa.array(likeness(own, codes[following], own_has, has[following])),
    ]
    return pa.RecordBatch.from_arrays(columns, names=[f.split()[0] for f in EDITED.split(", ")])
