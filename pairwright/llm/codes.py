"""Compression of vectors to codes, one entry of a small codebook per part.

The nearest entries of a codebook are found by slicing and intersecting: in every
dimension the coordinates of the entries are sorted, and beside them stand the masks
of the entries before each place. A distance to some entry gives an initial radius;
in each dimension the entries within it are a range of the sorted coordinates, whose
mask is the difference of two prefix masks. The masks of all dimensions ANDed leave
the entries within the radius in every one of them, the nearest and its ties among
them, and only those are measured.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairwright.llm.tables import column, cut, map_arrow

#: Parts of a vector and entries of a codebook; a mask of entries is one uint64.
PARTS = 16
ENTRIES = 64
ROUNDS = 2
SCALE = 256
#: Quantised components are below this.
LIMIT = 1 << 62
#: Rows worked on at once, and vectors that propose the initial radius of a part.
BLOCK = 8192
GUESSES = 4
#: Totals of so few labels are broadcast.
FEW_LABELS = 100_000

_isqrt = np.frompyfunc(math.isqrt, 1, 1)


def _roots(squares: np.ndarray) -> np.ndarray:
    """The whole square roots, rounded down."""
    if squares.dtype == object:
        return _isqrt(squares)
    roots = np.sqrt(squares.astype(np.float64)).astype(np.int64)
    roots -= roots * roots > squares
    return roots + ((roots + 1) * (roots + 1) <= squares)


class Codebook:
    """The entries of one part, with sorted coordinates and prefix masks per dimension."""

    def __init__(self, entries: np.ndarray) -> None:
        self.entries = entries
        self.order = np.argsort(entries, axis=0, kind="stable")
        self.sorted = np.take_along_axis(entries, self.order, axis=0)
        bits = np.uint64(1) << self.order.astype(np.uint64)
        none = np.zeros((1, entries.shape[1]), np.uint64)
        self.prefix = np.concatenate([none, np.bitwise_or.accumulate(bits, axis=0)])
        spread = self.sorted[-1] - self.sorted[0] if len(entries) else np.zeros(entries.shape[1], np.int64)
        # The dimensions in which the entries differ most propose the first radius.
        self.widest = np.argsort(-spread.astype(np.float64), kind="stable")[:GUESSES]

    def candidates(self, values: np.ndarray) -> np.ndarray:
        """Per row the mask of the entries that may be nearest: all within the radius in each dimension."""
        least = None
        for j in self.widest:
            place = np.minimum(np.searchsorted(self.sorted[:, j], values[:, j]), len(self.entries) - 1)
            squares = ((values - self.entries[self.order[place, j]]) ** 2).sum(1)
            least = squares if least is None else np.minimum(least, squares)
        radius = _roots(least)
        masks = np.full(len(values), ~np.uint64(0))
        for j in range(values.shape[1]):
            low = np.searchsorted(self.sorted[:, j], values[:, j] - radius, "left")
            high = np.searchsorted(self.sorted[:, j], values[:, j] + radius, "right")
            masks &= self.prefix[high, j] ^ self.prefix[low, j]
        return masks

    def nearest(self, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(entry, squared distance) per row; of several nearest entries the first."""
        found = np.zeros(len(values), np.int64)
        if not values.shape[1]:
            return found, np.zeros(len(values), np.int64)
        masks = self.candidates(values)
        best = np.full(len(values), -1, values.dtype)
        for e, entry in enumerate(self.entries):
            rows = np.flatnonzero(masks >> np.uint64(e) & np.uint64(1))
            squares = ((values[rows] - entry) ** 2).sum(1)
            closer = (best[rows] < 0) | (squares < best[rows])
            best[rows[closer]] = squares[closer]
            found[rows[closer]] = e
        return found, best


def _quantised(vectors: pa.Array, dims: int) -> tuple[np.ndarray, np.ndarray]:
    """(rows that take part, their integer components padded with zeros to ``dims``)."""
    if isinstance(vectors, pa.ChunkedArray):
        vectors = vectors.combine_chunks()
    flat = vectors.flatten()
    values = flat.to_numpy(zero_copy_only=False).astype(np.float64)  # nulls become nan
    sizes = pa.compute.fill_null(pa.compute.list_value_length(vectors), 0).to_numpy(zero_copy_only=False)
    present = pa.compute.is_valid(vectors).to_numpy(zero_copy_only=False)
    whose = np.repeat(np.arange(len(sizes)), sizes)
    bad = np.bincount(whose[~np.isfinite(values)], minlength=len(sizes)) > 0
    kept = present & ~bad
    mine = kept[whose]
    row = (np.cumsum(kept) - 1)[whose[mine]]
    place = (np.arange(len(whose)) - np.repeat(np.cumsum(sizes) - sizes, sizes))[mine]
    floors = np.floor(SCALE * values[mine])
    if len(floors) and np.abs(floors).max() >= LIMIT:
        raise ValueError(f"quantised components must be below {LIMIT}")
    out = np.zeros((int(kept.sum()), dims), np.int64)
    out[row, place] = floors.astype(np.int64)
    return np.flatnonzero(kept), out


def _assigned(books: list[Codebook], values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(entries [rows, parts], summed squared distances) of quantised vectors."""
    width = values.shape[1] // PARTS
    codes = np.zeros((len(values), PARTS), np.int64)
    errors = np.zeros(len(values), values.dtype)
    for p, book in enumerate(books):
        codes[:, p], distances = book.nearest(values[:, p * width : (p + 1) * width])
        errors = errors + distances
    return codes, errors


def _exact(values: np.ndarray, books: list[Codebook]) -> np.ndarray:
    """``values`` as they are if squared distances surely fit 64 bits, else as unbounded integers."""
    largest = max([int(np.abs(values).max(initial=0))] + [int(np.abs(b.entries).max(initial=0)) for b in books])
    return values if (2 * largest) ** 2 * max(values.shape[1], 1) < 2**63 else values.astype(object)


def _blocks(batches: Iterator[pa.RecordBatch], dims: int):
    for batch in batches:
        for at in range(0, len(batch), BLOCK):
            part = batch.slice(at, BLOCK)
            kept, values = _quantised(part.column("embedding"), dims)
            if len(kept):
                yield part, kept, values


def _summing(books: list[Codebook], dims: int):
    width = dims // PARTS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(PARTS * ENTRIES, np.int64)
        sums = np.zeros((PARTS * ENTRIES, width), object)
        for _, _, values in _blocks(batches, dims):
            codes, _ = _assigned(books, _exact(values, books))
            for p in range(PARTS):
                counts[p * ENTRIES : (p + 1) * ENTRIES] += np.bincount(codes[:, p], minlength=ENTRIES)
                own = values[:, p * width : (p + 1) * width]
                for e in np.unique(codes[:, p]):
                    # Halves of the components, so that the sums of a block fit 64 bits.
                    mine = own[codes[:, p] == e]
                    high, low = (mine >> 31).sum(0), (mine & 0x7FFFFFFF).sum(0)
                    sums[p * ENTRIES + e] += high.astype(object) * (1 << 31) + low.astype(object)
        used = np.flatnonzero(counts)
        rows = [(int(s), -1, str(counts[s])) for s in used]
        rows += [(int(s), j, str(sums[s, j])) for s in used for j in range(width)]
        if rows:
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(zip(*rows), (pa.int32(), pa.int32(), pa.string()))],
                names=["slot", "place", "total"],
            )

    return run


def _encoding(books: list[Codebook], dims: int):
    digits = np.array([list(f"{e:02x}".encode()) for e in range(ENTRIES)], np.uint8)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, kept, values in _blocks(batches, dims):
            codes, errors = _assigned(books, _exact(values, books))
            text = digits[codes].reshape(len(kept), -1).view(f"S{2 * PARTS}")[:, 0].astype(str)
            rows = pa.array(kept)
            yield pa.RecordBatch.from_arrays(
                [
                    part.column("vec_id").take(rows),
                    part.column("label").take(rows),
                    pa.array(text, pa.string()),
                    pa.array(errors.tolist(), pa.int64()),
                ],
                names=["vec_id", "label", "code", "error"],
            )

    return run


def _books(entries: np.ndarray) -> list[Codebook]:
    width = entries.shape[2]
    wide = len(entries) and (2 * int(np.abs(entries).max(initial=0))) ** 2 * max(width, 1) >= 2**63
    return [Codebook(part.astype(object) if wide else part) for part in entries]


def digest(books: list[Codebook]) -> str:
    """The hash of all components by part, entry and position."""
    numbers = ",".join(str(int(x)) for book in books for entry in book.entries for x in entry)
    return hashlib.sha256(numbers.encode()).hexdigest()


def _label_errors(coded: DataFrame) -> DataFrame:
    """``coded`` with ``label_error``, the sum over its label."""
    totals = coded.groupBy("label").agg(F.sum("error").alias("label_error"), F.count("*").alias("_rows"))
    same = F.col("label").eqNullSafe(F.col("_label"))

    def joined(rows: DataFrame, sums: DataFrame) -> DataFrame:
        return rows.join(sums.select(F.col("label").alias("_label"), "label_error"), same).drop("_label")

    if totals.limit(FEW_LABELS + 1).count() <= FEW_LABELS:
        return joined(coded, F.broadcast(totals))
    # Labels of more than a thousandth of the rows, 999 at most, are broadcast; the others are no hot keys.
    common = totals.where(F.col("_rows") * 1000 > totals.agg(F.sum("_rows")).scalar())
    hot = F.broadcast(common)
    cold = coded.join(F.broadcast(common.select(F.col("label").alias("_label"))), same, "left_anti")
    return joined(coded, hot).unionByName(joined(cold, totals))


def compress(vectors: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """(vec_id, code, error, label_error, codebooks_sha256) per row of (vec_id, embedding, label).

    Components become floor(256 * x). The codebook of a part starts as that part of the 64 rows of smallest
    vec_id; in each round all parts are assigned to their nearest entries, ties to the lower one, and used
    entries become the floored means of their parts. After the last round parts are assigned once more. A task
    sums its rows per entry; what is shuffled and collected are at most 64 x 16 sums of a part, whatever the rows.

    Vectors that are null or hold a null, infinite or undefined component are left out. Shorter vectors count as
    followed by zeros, up to a multiple of 16 that holds the longest. Rows that repeat a vec_id are rows of their
    own, and a null vec_id comes after all others; among the 64 first rows ties go by vector. Null labels are one
    label. Fewer than 64 rows give smaller codebooks, none an empty result. Quantised components of 2**62 and more
    and summed errors beyond a bigint are errors.
    """
    rows = vectors.select(
        column(vectors, "vec_id", "bigint"),
        F.col("`embedding`").cast("array<double>").alias("embedding"),
        column(vectors, "label", "string"),
    ).where("embedding IS NOT NULL")
    undefined = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    usable = rows.where(~undefined)
    longest = usable.agg(F.max(F.size("embedding"))).first()[0] or 0
    dims = -(-longest // PARTS) * PARTS
    first = usable.orderBy(F.col("vec_id").asc_nulls_last(), "embedding").limit(ENTRIES).select("embedding").collect()
    _, start = _quantised(pa.array([r[0] for r in first], pa.list_(pa.float64())), dims)
    entries = start.reshape(len(start), PARTS, dims // PARTS).transpose(1, 0, 2)
    # An empty table has no entries, and no row that would need one.
    for _ in range(rounds if len(start) else 0):
        partial = map_arrow(rows, _summing(_books(entries), dims), "slot int, place int, total string")
        sums = partial.groupBy("slot", "place").agg(F.sum(F.col("total").cast("decimal(38, 0)")).alias("total"))
        found = {(r.slot, r.place): int(r.total) for r in sums.collect()}
        entries = entries.copy()
        for (slot, place), total in found.items():
            if place >= 0:
                entries[slot // ENTRIES, slot % ENTRIES, place] = total // found[slot, -1]
    books = _books(entries)
    out = "vec_id bigint, label string, code string, error bigint"
    coded = cut(map_arrow(rows, _encoding(books, dims), out))
    return _label_errors(coded).select(
        "vec_id", "code", "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256")
    )
