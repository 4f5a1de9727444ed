"""Removal of passages that repeat anywhere, by prefix-free parsing.

A window of 200 bytes is repeated if the same bytes also start elsewhere. A rolling
hash over 12 bytes triggers the starts of phrases, so that equal windows are parsed
alike wherever they stand: each belongs to the first trigger inside it, or, where
there is none, to the smallest rolling hash inside it. Around that anchor all of its
equals share at least 100 bytes, the key of the phrase, which here is the stretch of
all windows of one anchor. The parse of the corpus is ordered by key; a phrase whose
key is alone ends the search, which is what happens to most text. Phrases that occur
more than once are repeated as they are. The different phrases under a key are its
dictionary, the suffixes of which are ordered by their first 200 bytes: a window is
repeated if a neighbour is equal. The order is that of hashes, not of the alphabet:
only equality of 200 bytes matters here.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairwright.llm.batches import freed
from pairwright.llm.tables import column, cut, cut_in_buckets, map_arrow

#: Bytes of a passage, of a trigger, and mean bytes of a phrase.
LENGTH = 200
TRIGGER = 12
PHRASE = 96
#: Bytes shared around an anchor by windows that are equal: before it if it lies beyond this, else after it.
SIDE = 100
#: Bytes worked on at once; longer texts are parsed in overlapping blocks.
BLOCK = 1 << 18
#: Different phrases under one key that are compared within a task, in some 100 MB. Windows of larger groups are
#: counted one by one.
LARGE = 20_000

_REACH = LENGTH - TRIGGER
_BASES = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)


@lru_cache(maxsize=4)
def _powers(size: int, base: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base and of its inverse, modulo 2**64."""
    up, down = np.full(size, base, np.uint64), np.full(size, pow(base, -1, 1 << 64), np.uint64)
    up[0] = down[0] = 1
    return np.cumprod(up), np.cumprod(down)


@lru_cache(maxsize=None)
def _byte_values(base: int) -> np.ndarray:
    return np.frombuffer(hashlib.shake_256(str(base).encode()).digest(256 * 8), "<u8").astype(np.uint64)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(32))


class Rolling:
    """Hashes of any stretch of a buffer, from sums of its bytes' values times powers of a base."""

    def __init__(self, data: np.ndarray, base: int) -> None:
        size = max(2 * BLOCK, 1 << int(len(data)).bit_length())
        up, self.down = _powers(size, base)
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(_byte_values(base)[data] * up[: len(data)], out=self.sums[1:])

    def at(self, begin: np.ndarray, length: int | np.ndarray) -> np.ndarray:
        return _mixed((self.sums[begin + length] - self.sums[begin]) * self.down[begin])


def _pieces(texts: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(text numbers, offsets, lengths) of groups of blocks with about `BLOCK` bytes.

    The blocks of a text overlap so that every window lies in exactly one of them. Shorter texts have no window.
    """
    group, held = [], 0
    for i, text in enumerate(texts):
        for at in range(0, max(0, len(text) - LENGTH + 1), BLOCK):
            size = min(BLOCK + LENGTH - 1, len(text) - at)
            if group and held + size > BLOCK + LENGTH:
                yield tuple(np.array(c, np.int64) for c in zip(*group))
                group, held = [], 0
            group.append((i, at, size))
            held += size
    if group:
        yield tuple(np.array(c, np.int64) for c in zip(*group))


def anchors(data: np.ndarray, begin: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, ...]:
    """(block, anchor, first, last) of blocks laid out one after the other: the windows [first, last] of an anchor.

    Every window of a block belongs to one anchor, which depends on the window's bytes only.
    """
    end = begin + size
    rolling = Rolling(data, _BASES[0])
    triggers = rolling.at(np.arange(len(data) - TRIGGER + 1), TRIGGER)
    whose = np.repeat(np.arange(len(begin)), size)
    starts = np.flatnonzero(triggers % np.uint64(PHRASE) == 0)
    starts = starts[starts + TRIGGER <= end[whose[starts]]]
    before = np.concatenate([[-1], starts[:-1]])
    block = whose[starts]
    first = np.maximum(np.maximum(before + 1, starts - _REACH), begin[block])
    last = np.minimum(starts, end[block] - LENGTH)
    some = first <= last
    block, starts, first, last = block[some], starts[some], first[some], last[some]

    free = np.zeros(len(data) + 1, np.int32)
    np.add.at(free, begin, 1)
    np.add.at(free, end - LENGTH + 1, -1)
    np.add.at(free, first, -1)
    np.add.at(free, last + 1, 1)
    alone = np.flatnonzero(np.cumsum(free[:-1]) > 0)
    if len(alone):
        inside = np.lib.stride_tricks.sliding_window_view(triggers, _REACH + 1)
        least = np.concatenate([inside[alone[a : a + 4096]].argmin(1) for a in range(0, len(alone), 4096)]) + alone
        new = np.flatnonzero((np.diff(least, prepend=-1) != 0) | (np.diff(alone, prepend=-2) != 1))
        block = np.concatenate([block, whose[alone[new]]])
        starts = np.concatenate([starts, least[new]])
        first = np.concatenate([first, alone[new]])
        last = np.concatenate([last, alone[np.append(new[1:], len(alone)) - 1]])
    return block, starts, first, last


def _keyed(data: np.ndarray, begin: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, ...]:
    """(block, key, word, first, last): phrases by the hash of bytes that all equal windows share, and their own hash."""
    block, anchor, first, last = anchors(data, begin, size)
    rolling = Rolling(data, _BASES[1])
    near, far = np.maximum(first, anchor - SIDE), np.minimum(last, anchor - SIDE - 1)
    a, b = np.flatnonzero(near <= last), np.flatnonzero(first <= far)
    after = rolling.at(anchor[a], SIDE)
    around = rolling.at(anchor[b] - SIDE, SIDE + TRIGGER) ^ np.uint64(_BASES[0])
    first, last = np.concatenate([near[a], first[b]]), np.concatenate([last[a], far[b]])
    word = rolling.at(first, last - first + LENGTH).view(np.int64)
    return np.concatenate([block[a], block[b]]), np.concatenate([after, around]).view(np.int64), word, first, last


def _parsed(texts: list[bytes]) -> Iterator[tuple[np.ndarray, ...]]:
    """(text number, key, word, first window, last window), places counted within the text."""
    for number, offset, size in _pieces(texts):
        begin = np.cumsum(size) - size
        data = np.frombuffer(b"".join([texts[i][a : a + n] for i, a, n in zip(number, offset, size)]), np.uint8)
        block, key, word, first, last = _keyed(data, begin, size)
        shift = offset[block] - begin[block]
        yield number[block], key, word, first + shift, last + shift


PHRASES = "key bigint, word bigint, id bigint, place bigint"


def _place(tag: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """A stretch of windows in one number, with the text's tag in front: 24, 32 and 8 bits."""
    return (tag.astype(np.int64) << 40) | (first << 8) | (last - first)


#: Its parts in SQL.
_PLACE = [
    "CAST(shiftrightunsigned(place, 40) AS INT) AS tag",
    "CAST(shiftright(place, 8) & 4294967295L AS INT) AS first",
    "CAST((shiftright(place, 8) & 4294967295L) + (place & 255) AS INT) AS last",
]


def _sliced(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Rows with their texts, in slices of about a block, or one text if that is longer."""
    for batch in batches:
        if not len(batch):
            continue
        lengths = pa.compute.binary_length(batch.column("text")).to_numpy(zero_copy_only=False)
        cuts = (np.flatnonzero(np.diff(np.cumsum(lengths) // BLOCK)) + 1).tolist()
        for a, b in zip([0, *cuts], [*cuts, len(batch)]):
            part = batch.slice(a, b - a)
            yield part, part.column("text").cast(pa.large_binary()).to_pylist()
        freed()


def _batch(names: str, *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [c if isinstance(c, pa.Array) else pa.array(c) for c in columns], names=[n.split()[0] for n in names.split(", ")]
    )


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch, texts in _sliced(batches):
        ids, tags = (batch.column(c).to_numpy() for c in ("id", "tag"))
        for number, key, word, first, last in _parsed(texts):
            yield _batch(PHRASES, key, word, ids[number], _place(tags[number], first, last))


DICTIONARY = "key bigint, id bigint, tag int, first int, content binary"


def _contents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The bytes of the windows of every phrase found under its key."""
    for batch, texts in _sliced(batches):
        found = batch.column("found")
        rows = found.flatten()
        keys, firsts, lasts = (rows.field(c).to_numpy() for c in ("key", "first", "last"))
        whose = np.repeat(np.arange(len(batch)), pa.compute.list_value_length(found).to_numpy())
        ids, tags = (batch.column(c).to_numpy() for c in ("id", "tag"))
        for a in range(0, len(keys), 1000):
            part = slice(a, a + 1000)
            stretches = zip(whose[part].tolist(), firsts[part].tolist(), lasts[part].tolist())
            content = pa.array([texts[i][x : y + LENGTH] for i, x, y in stretches], pa.binary())
            yield _batch(DICTIONARY, keys[part], ids[whose[part]], tags[whose[part]], firsts[part], content)


def _window_hashes(contents: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(content number, offset, two hashes) of every window of the contents, taken from about a block at once."""
    size = np.array([len(c) for c in contents], np.int64)
    n = size - LENGTH + 1
    whose = np.repeat(np.arange(len(contents), dtype=np.int32), n)
    offset = (np.arange(len(whose)) - np.repeat(np.cumsum(n) - n, n)).astype(np.int32)
    hashes = np.empty((2, len(whose)), np.uint64)
    cuts = (np.flatnonzero(np.diff(np.cumsum(size) // BLOCK)) + 1).tolist()
    done = 0
    for a, b in zip([0, *cuts], [*cuts, len(contents)]):
        data = np.frombuffer(b"".join(contents[a:b]), np.uint8)
        begin, rows = np.cumsum(size[a:b]) - size[a:b], slice(done, done + int(n[a:b].sum()))
        at = begin[whose[rows] - a] + offset[rows]
        for hash_, base in zip(hashes, _BASES):
            hash_[rows] = Rolling(data, base).at(at, LENGTH)
        done = rows.stop
    return whose, offset, *hashes


SPANS = "id bigint, tag int, first int, last int"


def _extents(contents: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(content number, first and last offset of a repeated window) where there is one.

    The suffixes of all contents are ordered by the hashes of their first 200 bytes; neighbours are compared.
    """
    whose, offset, one, two = _window_hashes(contents)
    order = np.lexsort((two, one))
    one, two = one[order], two[order]
    equal = (one[1:] == one[:-1]) & (two[1:] == two[:-1])
    repeated = np.zeros(len(order), bool)
    repeated[order[1:]] = equal
    repeated[order[:-1]] |= equal
    found, at = whose[repeated], offset[repeated]
    if not len(found):
        return found, at, at
    new = np.flatnonzero(np.diff(found, prepend=-1))
    return found[new], at[new], at[np.append(new[1:], len(found)) - 1]


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by key: all rows of some keys are compared at once."""
    held: list[pa.RecordBatch] = []
    size = 0

    def flush(whole: pa.Table) -> Iterator[pa.RecordBatch]:
        if len(whole):
            number, low, high = _extents(whole.column("content").to_pylist())
            ids, tags, first = (whole.column(c).to_numpy()[number] for c in ("id", "tag", "first"))
            yield _batch(SPANS, ids, tags, (first + low).astype(np.int32), (first + high).astype(np.int32))

    for batch in batches:
        held.append(batch)
        size += batch.nbytes
        if size < 2 * BLOCK:
            continue
        whole = pa.Table.from_batches(held)
        keys = whole.column("key").to_numpy()
        # The last key may go on in the next batch.
        done = int(np.searchsorted(keys, keys[-1], "left"))
        yield from flush(whole.slice(0, done))
        held, size = whole.slice(done).combine_chunks().to_batches(), 0
    if held:
        yield from flush(pa.Table.from_batches(held))


WINDOWS = "one bigint, two bigint, id bigint, tag int, first int, at int"


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Every window of the contents as a row of its own."""
    for batch in batches:
        for a in range(0, len(batch), 1000):
            part = batch.slice(a, 1000)
            whose, offset, one, two = _window_hashes(part.column("content").to_pylist())
            ids, tags, first = (part.column(c).to_numpy()[whose] for c in ("id", "tag", "first"))
            yield _batch(WINDOWS, one.view(np.int64), two.view(np.int64), ids, tags, first, (first + offset).astype(np.int32))


def _merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Runs of covered bytes from the first and last repeated windows."""
    out: list[tuple[int, int]] = []
    for first, last in sorted(spans):
        if out and first <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], last + LENGTH))
        else:
            out.append((first, last + LENGTH))
    return out


CUT = "id bigint, tag int, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string"


def _apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch, texts in _sliced(batches):
        rows = []
        copies, spans = batch.column("copies").to_pylist(), batch.column("spans").to_pylist()
        for text, n, found in zip(texts, copies, spans):
            if n > 1 and len(text) >= LENGTH:
                runs = [(0, len(text))]
            else:
                runs = _merged([(s["first"], s["last"]) for s in found or ()])
            kept, at = hashlib.sha256(), 0
            for a, b in runs:
                kept.update(text[at:a])
                at = b
            kept.update(text[at:])
            rows.append((len(text), sum(b - a for a, b in runs), len(runs), kept.hexdigest()))
        yield _batch(CUT, batch.column("id"), batch.column("tag"), *zip(*rows))


def repeated_spans(texts: DataFrame, large: int = LARGE) -> DataFrame:
    """(id, tag, first, last): windows that also start elsewhere, of (id, tag, text) with different texts.

    A row stands for windows that overlap each other: the first and the last repeated one of an anchor.
    """
    long_ones = texts.where(F.octet_length("text") >= LENGTH).select("id", "tag", "text")
    phrases = cut(map_arrow(long_ones, _parse, PHRASES))
    shared = phrases.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key")
    found = cut(phrases.join(shared, "key"))
    words = cut(found.groupBy("key", "word").agg(F.count("*").alias("n"), F.min(F.struct("id", "place")).alias("one")))
    often = words.where("n > 1").select("key", "word")
    repeated = found.join(often, ["key", "word"]).selectExpr("id", *_PLACE)
    # One of each phrase meets the others under its key, if there are any.
    several = cut(words.groupBy("key").agg(F.count("*").alias("words")).where("words > 1"))
    dictionary = words.join(several, "key").selectExpr("key", "words", "one.id AS id", "one.place AS place")

    def contents(rows: DataFrame) -> DataFrame:
        stretches = rows.selectExpr("id", "key", *_PLACE)
        by_text = stretches.groupBy("id", "tag").agg(F.collect_list(F.struct("key", "first", "last")).alias("found"))
        return map_arrow(long_ones.join(by_text, ["id", "tag"]), _contents, DICTIONARY)

    small = contents(dictionary.where(F.col("words") <= large))
    compared = map_arrow(small.repartition("key").sortWithinPartitions("key"), _compare, SPANS)
    spans = repeated.unionByName(compared)
    if several.where(F.col("words") > large).isEmpty():
        return spans
    # Groups of any size: equal windows are counted where they are made and matched by their hashes.
    windows = cut(map_arrow(contents(dictionary.where(F.col("words") > large)), _windows, WINDOWS))
    equal = windows.groupBy("one", "two").agg(F.count("*").alias("n")).where("n > 1").drop("n")
    matched = windows.join(equal, ["one", "two"])
    extents = matched.groupBy("id", "tag", "first").agg(F.min("at").alias("low"), F.max("at").alias("high"))
    return spans.unionByName(extents.select("id", "tag", F.col("low").alias("first"), F.col("high").alias("last")))


def remove_repeats(docs: DataFrame, large: int = LARGE) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) per row of (doc_id, text), whole texts as UTF-8 bytes.

    Removed is every byte of a 200-byte string that also starts anywhere else, in another text or the same one,
    overlaps included. Equal texts are worked on once: one that occurs more than once and has 200 bytes goes as
    a whole, and so do rows that repeat. A null text counts as empty; texts under 200 bytes stay; doc_id may be null or
    repeat and only names the row. Other columns are not read; an empty table gives an empty one. Strings count as
    equal if their 128-bit hashes are, whole texts if 88 bits are. Texts are parsed in blocks of 256 KB; a task holds the text it works on,
    whatever its length, and never a whole group of equal strings.
    """
    rows = docs.select(
        column(docs, "doc_id", "bigint"), F.coalesce(F.col("`text`").cast("string"), F.lit("")).alias("text")
    )
    # A text goes by 88 bits of its hash.
    digits = rows.withColumn("_md5", F.md5("text"))
    named = digits.selectExpr(
        "doc_id", "CAST(conv(substr(_md5, 1, 16), 16, -10) AS BIGINT) AS id",
        "CAST(conv(substr(_md5, 17, 6), 16, 10) AS INT) AS tag", "text",
    )
    counted = named.groupBy("id", "tag").agg(F.first("text").alias("text"), F.count("*").alias("copies"))
    distinct = cut_in_buckets(counted, "id", "tag")
    spans = repeated_spans(distinct, large)
    by_text = spans.groupBy("id", "tag").agg(F.collect_list(F.struct("first", "last")).alias("spans"))
    results = map_arrow(distinct.join(by_text, ["id", "tag"], "left"), _apply, CUT)
    return named.drop("text").join(results, ["id", "tag"]).drop("id", "tag")
