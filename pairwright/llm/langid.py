"""Language identification with Kneser-Ney character models in sorted hash arrays."""

from __future__ import annotations

import re
import sys
import unicodedata
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pairwright.llm.batches import slices, words_in_lists
from pairwright.llm.tables import column, map_arrow, ship

ORDER = 5
UNKNOWN = "und"
#: The sample that the models are taken from: rows per language, and code points per row at most. Of four rows
#: three are fitted on and one calibrates scores and rejection, however many there are.
FIT_ROWS, FIT_CHARS = 1200, 50_000
#: Lengths, in characters, at which rejection is calibrated; in between the limit is interpolated.
BANDS = (8, 16, 32, 64, 128, 256, 512, 1024, 2048, 4096)
#: Shares of texts of the learned languages over the limit of a band, and of foreign ones under it, that are aimed at.
LOST, MISSED = 0.001, 0.01
#: With fewer calibration rows, or beside a single language, nothing is rejected for being unlike.
LEAST_ROWS = 20
#: Words whose scores a task keeps; the store is emptied when it has more.
KEPT_WORDS = 200_000
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


#: Letters, in texts without combining marks and without numerals that are no digits.
_PLAIN_WORD = re.compile(r"[^\W\d_]+")


@lru_cache(maxsize=None)
def _of_category(first: str) -> list[int]:
    return [c for c in range(sys.maxunicode + 1) if unicodedata.category(chr(c)).startswith(tuple(first.split()))]


@lru_cache(maxsize=None)
def _odd() -> frozenset[str]:
    return frozenset(map(chr, _of_category("M No Nl")))


@lru_cache(maxsize=None)
def _any_word() -> re.Pattern:
    """An expression for a letter and the letters and combining marks that follow it, numerals left out."""

    def ranges(first: str) -> str:
        of = _of_category(first)
        cuts = [0, *(i for i in range(1, len(of)) if of[i] != of[i - 1] + 1), len(of)]
        return "".join(f"{chr(of[a])}-{chr(of[b - 1])}" for a, b in zip(cuts, cuts[1:]))

    return re.compile(f"[{ranges('L')}][{ranges('L M')}]*")


def _word(text: str) -> re.Pattern:
    """The expression for the words of this text: the plain one, which is faster, where both match alike."""
    return _PLAIN_WORD if text.isascii() or _odd().isdisjoint(text) else _any_word()


def words_of(text: str) -> list[str]:
    """The lower-case words of a text, letters with their marks, which are what the models read."""
    text = text.lower()
    return _word(text).findall(text)


@dataclass
class Grams:
    """The n-grams of one order: sorted hashes, and for each a row with a column per language."""

    keys: np.ndarray
    log_p: np.ndarray
    contexts: np.ndarray  # sorted hashes of the n-grams' contexts
    log_back: np.ndarray  # what a context keeps for n-grams it was not seen with


@dataclass
class Model:
    """Interpolated Kneser-Ney models of all languages; bounded by the sample they are fitted on."""

    languages: list[str]
    base: np.ndarray  # log-probability of a letter never seen
    grams: list[Grams]  # by order, from 1
    sharpness: float = 50.0
    limits: np.ndarray | None = None  # by band: the cross-entropy from which a text is rejected; None if not calibrated

    def limit(self, chars: np.ndarray) -> np.ndarray:
        if self.limits is None:
            return np.full(len(chars), np.inf)
        return np.interp(np.log(np.maximum(chars, 1)), np.log(BANDS), self.limits)


def _hashes(words: list[str]) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """Hashes of the n-grams that end at each character, by order, with 0 where a word is too short for one.

    Each word stands between spaces, and n-grams begin at the first of them or later. Also the number of
    characters from that space on at every place, and where the words begin.
    """
    joined = " " + "  ".join(words) + " "
    codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64) + np.uint64(1)
    sizes = np.array([len(w) + 2 for w in words], np.int64)
    begin = np.cumsum(sizes) - sizes
    reach = np.arange(len(codes)) - np.repeat(begin, sizes) + 1
    out, value = [], np.zeros(len(codes), np.uint64)
    for order in range(1, ORDER + 1):
        if order == 1:
            value = codes.copy()
        else:
            longer = np.zeros_like(value)
            # The hash of the n-gram without its last character stands one place before.
            longer[1:] = value[:-1] * _MULTIPLIER + codes[1:]
            value = longer
        out.append(np.where(reach >= order, _mixed(value + np.uint64(order)), np.uint64(0)))
    return out, reach, begin


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return (x ^ (x >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)


def fit(counts: dict[str, Counter]) -> Model:
    """Models of word counts by language. Only n-grams that begin a word, and the longest, count by occurrence; the
    others count what can stand before them."""
    languages = sorted(counts)
    # kinds[order - 1][language]: hashes, counts, hashes of the contexts and of the n-grams without their first character
    kinds: list[list[tuple]] = [[] for _ in range(ORDER)]
    for language in languages:
        words = list(counts[language])
        many = np.array([counts[language][w] for w in words], np.float64)
        hashes, reach, begin = _hashes(words)
        sizes = np.diff(np.append(begin, len(reach)))
        weight = np.repeat(many, sizes)
        longer_suffix = None
        for order in range(ORDER, 0, -1):
            # The space before a word is never predicted.
            at = np.flatnonzero((reach >= max(order, 2)))
            keys, first, inverse = np.unique(hashes[order - 1][at], return_index=True, return_inverse=True)
            place = at[first]
            n = np.bincount(inverse, weights=weight[at], minlength=len(keys))
            if order < ORDER:
                kinds_before = np.zeros(len(keys))
                found, left = np.unique(longer_suffix, return_counts=True)
                kinds_before[np.searchsorted(keys, found)] = left
                n = np.where(reach[place] == order, n, kinds_before)
            context = hashes[order - 2][place - 1] if order > 1 else np.zeros(len(keys), np.uint64)
            suffix = hashes[order - 2][place] if order > 1 else np.zeros(len(keys), np.uint64)
            kinds[order - 1].append((keys, n, context, suffix))
            longer_suffix = suffix
    letters = len(np.unique(np.concatenate([k[0] for k in kinds[0]]))) if languages else 0
    base = np.full(len(languages), -np.log(letters + 1.0))
    grams: list[Grams] = []
    lower_p = None
    for order in range(1, ORDER + 1):
        of = kinds[order - 1]
        keys, first = np.unique(np.concatenate([k[0] for k in of]), return_index=True)
        context = np.concatenate([k[2] for k in of])[first]
        suffix = np.concatenate([k[3] for k in of])[first]
        contexts = np.unique(context)
        back = np.ones((len(contexts), len(languages)))
        own = np.zeros((len(keys), len(languages)))
        for i, (k, n, c, _) in enumerate(of):
            discount = _discount(n)
            where = np.searchsorted(contexts, c)
            total = np.bincount(where, weights=n, minlength=len(contexts))
            types = np.bincount(where, minlength=len(contexts))
            seen = total > 0
            back[seen, i] = discount * types[seen] / total[seen]
            own[np.searchsorted(keys, k), i] = np.maximum(n - discount, 0) / total[where]
        of_context = np.searchsorted(contexts, context)
        lower = np.exp(base)[None, :] if order == 1 else lower_p[np.searchsorted(grams[-1].keys, suffix)]
        p = own + back[of_context] * lower
        grams.append(Grams(keys, np.log(p).astype(np.float32), contexts, np.log(back).astype(np.float32)))
        lower_p = p
    return Model(languages, base + grams[0].log_back[0], grams)


def _discount(n: np.ndarray) -> float:
    once, twice = float((n == 1).sum()), float((n == 2).sum())
    return once / (once + 2 * twice) if once and twice else 0.5


def score_words(model: Model, words: list[str]) -> np.ndarray:
    """Log-probability of each word and the end of it, by language."""
    hashes, reach, begin = _hashes(words)
    predicted = reach >= 2
    log_p = np.where(predicted[:, None], model.base[None, :], 0.0)
    for order, g in enumerate(model.grams, 1):
        at = np.flatnonzero(reach >= max(order, 2))
        row = np.searchsorted(g.keys, hashes[order - 1][at])
        row[row == len(g.keys)] = 0
        hit = g.keys[row] == hashes[order - 1][at]
        log_p[at[hit]] = g.log_p[row[hit]]
        if order > 1:
            at = at[~hit]
            context = hashes[order - 2][at - 1]
            row = np.searchsorted(g.contexts, context)
            row[row == len(g.contexts)] = 0
            hit = g.contexts[row] == context
            log_p[at[hit]] += g.log_back[row[hit]]
    return np.add.reduceat(log_p, begin, axis=0)


class Store:
    """The scores of the words that a task has seen."""

    def __init__(self, model: Model) -> None:
        self.model = model
        self.clear()

    def clear(self) -> None:
        self.at: defaultdict[str, int] = defaultdict()
        self.at.default_factory = self.at.__len__
        self.scores = np.zeros((1 << 16, len(self.model.languages)), np.float64)

    def entropies(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Cross-entropy, nats a character, by text and language; and the characters. Texts without letters have 0."""
        if len(self.at) > KEPT_WORDS:
            self.clear()
        numbers, lengths = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        counts = np.zeros(len(texts), np.int64)
        before = len(self.at)
        for i, text in enumerate(texts):
            lower = (text or "").lower()
            for words in words_in_lists(_word(lower), lower):
                numbers.append(np.fromiter(map(self.at.__getitem__, words), np.int64, len(words)))
                lengths.append(np.fromiter(map(len, words), np.int64, len(words)))
                counts[i] += len(words)
        which = np.concatenate(numbers)
        new = list(islice(reversed(self.at), len(self.at) - before))[::-1]
        if len(self.at) > len(self.scores):
            grown = np.zeros((2 * len(self.at), self.scores.shape[1]))
            grown[:before] = self.scores[:before]
            self.scores = grown
        for at in range(0, len(new), 50_000):
            part = score_words(self.model, new[at : at + 50_000])
            self.scores[before + at : before + at + len(part)] = part
        sizes = np.concatenate(lengths) + 1
        ends = np.cumsum(counts)
        full = np.flatnonzero(counts > 0)
        total = np.zeros((len(texts), self.scores.shape[1]))
        chars = np.zeros(len(texts), np.int64)
        if len(full):
            start = (ends - counts)[full]
            total[full] = np.add.reduceat(self.scores[which], start, axis=0)
            chars[full] = np.add.reduceat(sizes, start)
        return -total / np.maximum(chars, 1)[:, None], chars


def predict(store: Store, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(language index, -1 if none; score; cross-entropy; rejected) by text."""
    model = store.model
    entropy, chars = store.entropies(texts)
    if not model.languages:
        none = np.zeros(len(texts))
        return none.astype(np.int64) - 1, none, none, none == 0
    best = entropy.argmin(1)
    low = entropy[np.arange(len(texts)), best]
    score = 1 / np.exp(-model.sharpness * (entropy - low[:, None])).sum(1)
    rejected = (chars == 0) | (low > model.limit(chars))
    return np.where(chars == 0, -1, best), np.where(chars == 0, 0.0, score), np.where(chars == 0, 0.0, low), rejected


def calibrate(model: Model, rows: list[tuple[str, str]]) -> Model:
    """Set the sharpness of scores and the limits of rejection by (language, text) rows not fitted on.

    For every band each row gives a stretch of that length. Its lowest cross-entropy is one of a known language;
    the lowest without its own language's model is one of a foreign text. The limit stands in the middle between
    the quantile that loses a share of `LOST` of the known and the one that misses `MISSED` of the foreign, or at the
    first where they overlap, as for a word or two.
    """
    store = Store(model)
    entropy, chars = store.entropies([t for _, t in rows])
    truth = np.array([model.languages.index(x) for x, _ in rows], np.int64)
    good = chars > 0
    if good.any():
        low = entropy.min(1, keepdims=True)
        worth = []
        for sharpness in (1, 2, 5, 10, 20, 50, 100, 200):
            p = np.exp(-sharpness * (entropy - low))
            worth.append((np.log(p[np.arange(len(rows)), truth] / p.sum(1))[good].mean(), sharpness))
        model.sharpness = float(max(worth)[1])
    if good.sum() < LEAST_ROWS or len(model.languages) < 2:
        return model
    words = [words_of(t) for _, t in rows]
    ends = [np.cumsum([len(w) + 1 for w in own]) for own in words]
    limits: list[float | None] = []
    for band in BANDS:
        of = [i for i, e in enumerate(ends) if len(e) and e[-1] >= band]
        if len(of) < LEAST_ROWS:
            limits.append(None)
            continue
        stretches = [" ".join(words[i][: int(np.searchsorted(ends[i], band)) + 1]) for i in of]
        found = store.entropies(stretches)[0]
        known = np.quantile(found.min(1), 1 - LOST)
        found[np.arange(len(of)), truth[of]] = np.inf
        foreign = np.quantile(found.min(1), MISSED)
        limits.append(float(max(known, (known + foreign) / 2)))
    if all(x is None for x in limits):
        return model
    # A band without stretches has the limit of the next shorter one, or else the next longer.
    for order in (range(1, len(BANDS)), range(len(BANDS) - 2, -1, -1)):
        step = 1 if order.step > 0 else -1
        for i in order:
            limits[i] = limits[i - step] if limits[i] is None else limits[i]
    model.limits = np.array(limits)
    return model


def _fold():
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4


def train(docs: DataFrame, fit_rows: int = FIT_ROWS, fit_chars: int = FIT_CHARS) -> Model:
    """Fit and calibrate on labelled rows outside the held-out quarter.

    Languages are counted, rows are thinned by a hash to about twice what is needed and cut to exactly
    `fit_rows` by rank, so no task sorts all rows of a language; every fourth rank calibrates. Words are counted in
    parallel; the driver gets the word counts of the sample, at most `fit_rows` times `fit_chars` characters
    a language. Rows without a language, text or doc_id, and longer ones, don't take part.
    """
    own = docs.select(column(docs, "doc_id", "bigint"), column(docs, "lang", "string"), column(docs, "text", "string"))
    rows = own.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & (_fold() != 2))
    rows = rows.where(F.char_length("text") <= fit_chars)
    per_language = {r[0]: r[1] for r in rows.groupBy("lang").count().collect()}
    if not per_language:
        return Model([], np.zeros(0), [])
    scale = 1 << 30
    cuts = F.create_map(*(F.lit(x) for k, n in per_language.items() for x in (k, min(scale, scale * 2 * fit_rows // n + 1))))
    draw = F.xxhash64("doc_id")
    rows = rows.where(F.pmod(draw, F.lit(scale)) < F.element_at(cuts, F.col("lang")))
    rank = F.row_number().over(W.partitionBy("lang").orderBy(draw, "doc_id", F.xxhash64("text")))
    sample = rows.withColumn("_rank", rank).where(F.col("_rank") <= fit_rows)
    sample = sample.withColumn("fit", F.col("_rank") % 4 != 0)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(iter([batch]), "text"):
                of: dict[str, Counter] = defaultdict(Counter)
                checks = []
                for language, text, fits in zip(*(part.column(c).to_pylist() for c in ("lang", "text", "fit"))):
                    if fits:
                        of[language].update(words_of(text))
                    else:
                        checks.append((language, text))
                out = [(k, w, n, None) for k, c in of.items() for w, n in c.items()] + [(k, None, 0, t) for k, t in checks]
                kinds = (pa.string(), pa.string(), pa.int64(), pa.string())
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(zip(*out), kinds)], names=["lang", "word", "n", "text"])

    counted = map_arrow(
        sample.select("lang", "text", "fit").repartition("lang", F.xxhash64("text") % 16), count, "lang string, word string, n bigint, text string"
    )
    counts: dict[str, Counter] = defaultdict(Counter)
    checks: list[tuple[str, str]] = []
    for row in counted.toLocalIterator():
        if row["word"] is None:
            checks.append((row["lang"], row["text"]))
        else:
            counts[row["lang"]][row["word"]] += row["n"]
    if not counts:
        return Model([], np.zeros(0), [])
    checks = sorted(c for c in checks if c[0] in counts)
    return calibrate(fit({k: Counter(dict(sorted(c.items()))) for k, c in counts.items()}), checks)


_STORE: list[Store] = []


def store_of(model: Model) -> Store:
    """The store of a Python worker, which serves the tasks that come after each other."""
    if not _STORE or _STORE[0].model is not model:
        _STORE[:] = [Store(model)]
    return _STORE[0]


def forget() -> None:
    """Free the store: the worker goes on to the tasks of later stages, which need the memory."""
    _STORE.clear()


PREDICTED = "doc_id bigint, held_out boolean, lang_pred string, score double, cross_entropy double, rejected boolean, calibrated boolean"


def identify(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """A row per row of (doc_id, lang, text): the language with the lowest cross-entropy a character.

    The model is fitted on `docs` unless given. `score` is the calibrated probability of the prediction.
    `rejected` says that the text is unlike all languages, or has no letters. Only without letters, as for null
    texts, the prediction is `und` and the score 0. `calibrated` is false where there were too few labelled rows,
    or one language only, to tell what is unlike: then letters are never rejected. Whole texts are read, in one pass; equal texts get equal results. A null
    doc_id is not held out. Tables without usable labels give `und` everywhere, empty ones no rows.
    """
    model = train(docs) if model is None else model
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        for batch in slices(batches, "text"):
            best, score, entropy, rejected = predict(store_of(m), batch.column("text").to_pylist())
            names = [m.languages[i] if i >= 0 else UNKNOWN for i in best.tolist()]
            known = pa.array([m.limits is not None] * len(names), pa.bool_())
            columns = [pa.array(names, pa.string()), pa.array(score), pa.array(entropy), pa.array(rejected), known]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("held_out"), *columns], names=[f.split()[0] for f in PREDICTED.split(", ")]
            )

    own = docs.select(column(docs, "doc_id", "bigint"), column(docs, "text", "string"))
    held = F.coalesce(_fold() == 2, F.lit(False))
    return map_arrow(own.select("doc_id", held.alias("held_out"), "text"), run, PREDICTED)


def keep_identified(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """The rows of `docs`, all columns, that are not rejected; see `identify`.

    Null and empty texts and those without letters go, however often they occur; an empty table stays one. Python
    gets the texts in slices and returns a flag, the rows stay where they are; a text of any length is one slice.
    """
    model = train(docs) if model is None else model
    ship(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("boolean")
    def rejected(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            whole = pa.RecordBatch.from_arrays([texts], names=["text"])
            flags = [predict(store_of(sent.value), part.column(0).to_pylist())[3] for part in slices(iter([whole]), "text")]
            yield pa.array(np.concatenate(flags) if flags else np.zeros(0, bool), pa.bool_())
        forget()

    return docs.where(~rejected(F.col("`text`").cast("string")))
