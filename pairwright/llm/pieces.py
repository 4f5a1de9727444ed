"""SentencePiece encoding and decoding by batched Viterbi over sorted piece hashes."""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from pairwright.llm.batches import slices, words_in_lists
from pairwright.llm.tables import column, map_arrow

SPACE = "▁"
#: Stands for a mark that is part of a text; no text holds a lone surrogate.
LITERAL = "\udc81"
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
#: Code points of Latin, Greek and Cyrillic letters, after which texts are cut into words where the pieces allow it.
SCRIPTS = ((0x41, 0x250), (0x370, 0x530))
#: What a character that no piece covers scores below the worst piece, as in the public implementation.
UNKNOWN_PENALTY = 10.0
#: Table entries (positions times piece lengths) that are worked on at once.
BLOCK = 1 << 21
#: Words whose pieces a task keeps; the store is emptied when full, which changes no result.
KEPT_WORDS = 200_000


@dataclass
class Model:
    """Pieces sorted by hash, and what is needed to decode them. Small and fixed: it is sent to every executor."""

    keys: np.ndarray  # sorted hashes of the pieces that text can match
    ids: np.ndarray
    lengths: np.ndarray
    scores: np.ndarray
    codes: np.ndarray  # their code points, padded with 0
    maybe: np.ndarray  # which leading bits of a hash occur among the keys
    byte_ids: np.ndarray  # by byte value
    byte_of: np.ndarray  # by id; -1 for others
    text: np.ndarray  # the bytes that all pieces decode to, one after the other
    text_begin: np.ndarray  # by id
    text_length: np.ndarray
    word: str  # an expression for stretches that no piece reaches out of
    unknown_score: float
    longest: int


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def load(path: str) -> Model:
    """Read a model file on the driver.

    The scores of a unigram model are its log-probabilities. A model of merges has ranks for scores, which are
    no weights for a best path; the piece of rank r gets the log of a probability in proportion to 1 / r.
    Without pieces for all bytes, or with pieces over a word boundary, a model is refused.
    """
    import sentencepiece

    p = sentencepiece.SentencePieceProcessor(model_file=path)
    n = p.get_piece_size()
    pieces = [p.id_to_piece(i) for i in range(n)]
    byte_of = np.full(n, -1, np.int64)
    normal = []
    for i, piece in enumerate(pieces):
        if p.is_byte(i):
            byte_of[i] = int(piece[1:-1], 16)
        elif not (p.is_control(i) or p.is_unknown(i) or p.is_unused(i)):
            normal.append(i)
    byte_ids = np.full(256, -1, np.int64)
    byte_ids[byte_of[byte_of >= 0]] = np.flatnonzero(byte_of >= 0)
    if (byte_ids < 0).any():
        raise ValueError("the model lacks pieces for bytes")
    word = _word_pattern([pieces[i] for i in normal])
    scores = np.array([p.get_score(i) for i in normal], np.float64)
    if is_ranked(scores):
        rank = np.empty(len(scores))
        rank[np.argsort(-scores, kind="stable")] = np.arange(1, len(scores) + 1)
        scores = -np.log(rank * (1 / rank).sum())
    hashes = np.array([_hash(pieces[i]) for i in normal], np.uint64)
    order = np.argsort(hashes)
    if (np.diff(hashes[order]) == 0).any():
        raise ValueError("two pieces share a hash")
    known = set(normal)
    longest = max(len(pieces[i]) for i in normal)
    codes = np.zeros((len(normal), longest), np.uint32)
    for row, i in enumerate(np.array(normal)[order].tolist()):
        codes[row, : len(pieces[i])] = [ord(c) for c in pieces[i]]
    maybe = np.zeros(1 << 20, bool)
    maybe[hashes >> np.uint64(44)] = True
    plain = [bytes([byte_of[i]]) if byte_of[i] >= 0 else piece.replace(SPACE, " ").encode() if i in known else b"" for i, piece in enumerate(pieces)]
    lengths = np.array([len(x) for x in plain], np.int64)
    return Model(
        hashes[order],
        np.array(normal, np.int64)[order],
        np.array([len(pieces[i]) for i in normal], np.int64)[order],
        scores[order],
        codes,
        maybe,
        byte_ids,
        byte_of,
        np.frombuffer(b"".join(plain), np.uint8),
        np.cumsum(lengths) - lengths,
        lengths,
        word,
        float(scores.min()) - UNKNOWN_PENALTY,
        longest,
    )


def _word_pattern(pieces: list[str]) -> str:
    """An expression that cuts texts where no piece of the model can lie across the cut.

    That is before a mark that follows another character, and after a letter that is followed by something
    else than a letter; letters for which some piece says otherwise, or of other scripts, don't count as letters.
    """
    if any(re.search(f"[^{SPACE}]{SPACE}", piece) for piece in pieces):
        raise ValueError("the model has pieces over word boundaries")
    pairs = {pair for piece in pieces for pair in zip(piece, piece[1:])}
    letters = {c for a, b in SCRIPTS for c in map(chr, range(a, b)) if c.isalpha()}
    while more := {a for a, b in pairs if a in letters and b not in letters}:
        letters -= more
    letter = "".join(sorted(letters))
    return f"{SPACE}*[^{SPACE}{letter}]*[{letter}]+|{SPACE}*[^{SPACE}{letter}]+|{SPACE}+"


def is_ranked(scores: np.ndarray) -> bool:
    """Whether the scores are whole numbers, the order of merges, and no logarithms."""
    return len(scores) > 1 and bool((scores == np.rint(scores)).all())


def _hash(piece: str) -> int:
    value = 0
    for c in piece:
        value = (value * int(_MULTIPLIER) + ord(c) + 1) % 2**64
    return value


def _substring_scores(model: Model, codes: np.ndarray, first: int, last: int) -> tuple[np.ndarray, np.ndarray]:
    """Scores and piece indexes [word, end - first, longest - length] of the pieces that end at first < e <= last."""
    n, most = codes.shape[0], model.longest
    scores = np.full((n, last - first, most), -np.inf)
    which = np.full((n, last - first, most), -1, np.int32)
    low = max(0, first - most + 1)
    part = codes[:, low:last].astype(np.uint64) + np.uint64(1)
    value = part
    for length in range(1, min(most, part.shape[1]) + 1):
        # value[:, i] is the hash of the substring of this length that starts at low + i
        width = part.shape[1] - length + 1
        if length > 1:
            value = value[:, :width] * _MULTIPLIER + part[:, length - 1 :]
        skip = max(0, first + 1 - length - low)
        probe = value[:, skip:]
        row, col = np.nonzero(model.maybe[probe >> np.uint64(44)])
        probe = probe[row, col]
        at = np.searchsorted(model.keys, probe)
        at[at == len(model.keys)] = 0
        hit = (model.keys[at] == probe) & (model.lengths[at] == length)
        row, col, at = row[hit], col[hit] + (low + skip + length - first - 1), at[hit]
        scores[row, col, most - length] = model.scores[at]
        which[row, col, most - length] = at
    alone = which[:, :, most - 1] < 0
    scores[:, :, most - 1] = np.where(alone, model.unknown_score, scores[:, :, most - 1])
    return scores, which


def _viterbi(model: Model, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Backpointers (piece lengths) and piece indexes per position, for words of one length at once.

    All words advance by one position together; the maximum over the lengths of the last piece is taken in
    one operation, and of equal paths the one with the longest last piece is kept. Positions are worked on
    in blocks, so a word of any length takes memory for its backpointers only.
    """
    n, size = codes.shape
    most = model.longest
    back = np.zeros((n, size), np.uint8)
    piece = np.full((n, size), -1, np.int32)
    # best[:, most - 1 - k] is the best score of a path that ends k positions before the current one
    best = np.full((n, most), -np.inf)
    best[:, -1] = 0.0
    rows = np.arange(n)
    step = max(1, BLOCK // (n * most))
    for first in range(0, size, step):
        last = min(size, first + step)
        scores, which = _substring_scores(model, codes, first, last)
        for e in range(last - first):
            reach = best + scores[:, e]
            at = reach.argmax(1)
            back[:, first + e] = most - at
            piece[:, first + e] = which[rows, e, at]
            best[:, :-1] = best[:, 1:]
            best[:, -1] = reach[rows, at]
    return back, piece


def encode_words(model: Model, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(ids, lengths): the piece ids of all words in order, and how many each has. Words aren't empty."""
    sizes = np.array([len(w) for w in words], np.int64)
    order = np.argsort(sizes, kind="stable")
    flats, lengths = [], np.zeros(len(words), np.int64)
    at = 0
    while at < len(order):
        size = int(sizes[order[at]])
        group = max(1, min(4096, BLOCK // (size * model.longest)))
        of = order[at : at + group]
        of = of[sizes[of] == size]
        raw = "".join([words[i] for i in of]).encode("utf-32-le", "surrogatepass")
        codes = np.frombuffer(raw, np.uint32).reshape(len(of), size)
        ids, n = _paths(model, codes, *_viterbi(model, codes))
        lengths[of] = n
        flats.append(ids)
        at += len(of)
    flat = np.concatenate(flats) if flats else np.zeros(0, np.int32)
    # The words were worked on by length; back into their own order.
    begin = np.zeros(len(words), np.int64)
    begin[order] = np.cumsum(lengths[order]) - lengths[order]
    return _gather(flat, begin, lengths), lengths


def _gather(flat: np.ndarray, begin: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The stretches flat[begin : begin + length], one after the other."""
    start = np.cumsum(lengths) - lengths
    return flat[np.repeat(begin - start, lengths) + np.arange(int(lengths.sum()))]


def _paths(model: Model, codes: np.ndarray, back: np.ndarray, piece: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Follow the backpointers of all words at once; characters without a piece become their bytes."""
    n, size = codes.shape
    rows, end = np.arange(n), np.full(n, size)
    starts, chosen, whose = [], [], []
    while len(rows):
        length = back[rows, end - 1].astype(np.int64)
        whose.append(rows)
        chosen.append(piece[rows, end - 1])
        end = end - length
        starts.append(end)
        on = end > 0
        rows, end = rows[on], end[on]
    whose, chosen, starts = map(np.concatenate, (whose, chosen, starts))
    order = np.lexsort((starts, whose))
    whose, chosen, starts = whose[order], chosen[order], starts[order]
    unknown = chosen < 0
    # A piece was found by its hash; see that it is the very substring.
    on = np.flatnonzero(~unknown)
    for j in range(model.longest):
        on = on[model.lengths[chosen[on]] > j]
        if not np.array_equal(codes[whose[on], starts[on] + j], model.codes[chosen[on], j]):
            raise ValueError("the hashes of a piece and of another string are equal")
    ids = model.ids[chosen].astype(np.int32)
    if not unknown.any():
        return ids, np.bincount(whose, minlength=n)
    code = codes[whose, starts].astype(np.int64)
    code[code == ord(LITERAL)] = ord(SPACE)
    width = np.where(unknown, 1 + (code >= 0x80) + (code >= 0x800) + (code >= 0x10000), 1)
    first = np.cumsum(width) - width
    out = np.repeat(ids, width)
    lead = np.array([0, 0, 0xC0, 0xE0, 0xF0])
    for j in range(4):
        of = np.flatnonzero(unknown & (width > j))
        shifted = code[of] >> (6 * (width[of] - 1 - j))
        value = np.where(j == 0, lead[width[of]] + shifted, 0x80 + (shifted & 0x3F))
        out[first[of] + j] = model.byte_ids[value]
    return out, np.bincount(whose, weights=width, minlength=n).astype(np.int64)


class Store:
    """The pieces of the words that a task has seen."""

    def __init__(self, model: Model) -> None:
        self.model = model
        self.clear()

    def clear(self) -> None:
        self.at: defaultdict[str, int] = defaultdict()
        self.at.default_factory = self.at.__len__  # a new word gets the next number
        self.flat, self.begin, self.lengths = np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def number(self, words: list[str]) -> np.ndarray:
        """The number of every word; new ones get the next numbers."""
        return np.fromiter(map(self.at.__getitem__, words), np.int64, len(words))

    def find_pieces(self) -> None:
        """Find the pieces of the words that got a number since the last time."""
        before = len(self.lengths)
        if len(self.at) > before:
            ids, lengths = encode_words(self.model, list(islice(reversed(self.at), len(self.at) - before))[::-1])
            self.begin = np.concatenate([self.begin, len(self.flat) + np.cumsum(lengths) - lengths])
            self.lengths = np.concatenate([self.lengths, lengths])
            self.flat = np.concatenate([self.flat, ids])


#: The store of a Python worker, which serves the tasks that come after each other.
_STORE: list[Store] = []


def store_of(model: Model) -> Store:
    if not _STORE or _STORE[0].model is not model:
        _STORE[:] = [Store(model)]
    return _STORE[0]


def encode_batch(store: Store, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(ids, lengths) of whole texts. Spaces are marked and one is put in front, nothing else is normalised.

    The mark itself, if it occurs in a text, is encoded by its bytes, so that decoding gives the text again.
    """
    if len(store.at) > KEPT_WORDS:
        store.clear()
    word = re.compile(store.model.word)
    numbers = [np.zeros(0, np.int64)]
    counts = np.zeros(len(texts), np.int64)
    for i, text in enumerate(texts):
        if text:
            for words in words_in_lists(word, SPACE + text.replace(SPACE, LITERAL).replace(" ", SPACE)):
                numbers.append(store.number(words))
                counts[i] += len(words)
    store.find_pieces()
    which = np.concatenate(numbers)
    ids = _gather(store.flat, store.begin[which], store.lengths[which])
    ends = np.concatenate([[0], np.cumsum(store.lengths[which])])
    doc = np.concatenate([[0], np.cumsum(counts)])
    return ids, np.diff(ends[doc])


def decode_batch(model: Model, ids: np.ndarray, lengths: np.ndarray) -> list[str]:
    """The texts of sequences of piece ids: marks are spaces, byte pieces are UTF-8, and the space in front goes."""
    data = _gather(model.text, model.text_begin[ids], model.text_length[ids]).tobytes()
    ends = np.concatenate([[0], np.cumsum(model.text_length[ids])])[np.concatenate([[0], np.cumsum(lengths)])].tolist()
    return [data[a + 1 : b].decode("utf-8", "replace") for a, b in zip(ends, ends[1:])]


ENCODED = "doc_id bigint, n_chars bigint, n_tokens bigint, n_bytes bigint, ids array<int>"


def encode(docs: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, n_chars, n_tokens, n_bytes, ids) per row of (doc_id, text), whole texts; n_bytes counts byte pieces.

    Words are encoded once per task and looked up after that. A null text counts as empty, which has no
    pieces; repeated rows are encoded alike, other columns are not read. One pass without a shuffle, with
    memory for a slice of a few MB of text, or one text if that is longer.
    """
    model = docs.sparkSession.sparkContext.broadcast(load(path or default_path()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store = store_of(model.value)
        for batch in slices(batches, "text"):
            texts = [t or "" for t in batch.column("text").to_pylist()]
            ids, sizes = encode_batch(store, texts)
            ends = np.concatenate([[0], np.cumsum(sizes)])
            n_bytes = np.diff(np.concatenate([[0], np.cumsum(store.model.byte_of[ids] >= 0)])[ends])
            flat = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(ids, pa.int32()))
            counts = [pa.array(x, pa.int64()) for x in ([len(t) for t in texts], sizes, n_bytes)]
            names = [f.split()[0] for f in ENCODED.split(", ")]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *counts, flat], names=names)

    return map_arrow(docs.select(column(docs, "doc_id", "bigint"), column(docs, "text", "string")), run, ENCODED)


#: Piece ids that are decoded at once, or those of one row if it has more.
DECODED_IDS = 500_000


def decode(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """`encoded` without `ids`, but with the `text` they decode to; null ids and no ids give an empty text.

    Rows that repeat are decoded alike, an empty table gives an empty one. One pass, with memory for half a million
    ids, or those of one text if it has more.
    """
    model = encoded.sparkSession.sparkContext.broadcast(load(path or default_path()))
    kept = [c for c in encoded.columns if c not in ("ids", "text")]
    out = T.StructType([encoded.schema[c] for c in kept]).add("text", "string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = pa.compute.fill_null(pa.compute.list_value_length(batch.column("ids")), 0).to_numpy(zero_copy_only=False)
            cuts = (np.flatnonzero(np.diff(np.cumsum(sizes) // DECODED_IDS)) + 1).tolist()
            for a, b in zip([0, *cuts], [*cuts, len(batch)]):
                if a == b:
                    continue
                part = batch.slice(a, b - a)
                flat = part.column("ids").flatten().to_numpy(zero_copy_only=False).astype(np.int64)
                texts = pa.array(decode_batch(model.value, flat, sizes[a:b].astype(np.int64)), pa.string())
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in kept), texts], names=[*kept, "text"])

    return map_arrow(encoded, run, out)
