"""Secret scans: keyword automaton, anchored expressions near its hits, checksums inside the tokens."""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator
from functools import cache
from itertools import product

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairwright.llm.tables import column, map_arrow, ship

#: Kinds in the order of reports; the first three are the base.
KINDS = ("assign", "access", "hex", "github", "npm")
BASE = 3
#: Prefixes of tokens that end in a checksum of their body, 30 and 6 digits to base 62.
PREFIXES = {"github": (b"ghp_", b"gho_", b"ghu_", b"ghs_", b"ghr_"), "npm": (b"npm_",)}
DIGITS = b"0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
KEYWORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")

# Letters of the keywords match in either case; spelled out, as ignoring case would also fold other letters.
_EITHER = "|".join("".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in k) for k in KEYWORDS)
_ASSIGN = re.compile(rf"""(?:{_EITHER})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""".encode())
_ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
_HEX = re.compile(rb"[0-9a-f]+")
_CHECKED = re.compile(rb"(?:gh[pousr]|npm)_([0-9A-Za-z]{30})([0-9A-Za-z]{6})(?![0-9A-Za-z])")

SCHEMA = (
    "doc_id bigint, n_assign bigint, n_access bigint, n_hex bigint, base_sha256 string, spans string, n_checked bigint"
)


@cache
def _automaton() -> ahocorasick.Automaton:
    """Keywords in lower case to (kind, length). A run of 24 hex digits holds no word, but only four-digit hex strings."""
    out = ahocorasick.Automaton()
    for word in KEYWORDS:
        out.add_word(word, (0, len(word)))
    out.add_word("akia", (1, 4))
    for digits in product("0123456789abcdef", repeat=4):
        out.add_word("".join(digits), (2, 4))
    for kind, prefixes in PREFIXES.items():
        for prefix in prefixes:
            out.add_word(prefix.decode(), (KINDS.index(kind), len(prefix)))
    out.make_automaton()
    return out


def checksum(body: bytes) -> bytes:
    """CRC-32 of `body` as six digits to base 62."""
    value, out = zlib.crc32(body), b""
    for _ in range(6):
        value, digit = divmod(value, 62)
        out = DIGITS[digit : digit + 1] + out
    return out


def spans_of(text: bytes) -> list[tuple[int, int, int]]:
    """(start, kind, end) in bytes, by start and then kind, of every secret in a UTF-8 text.

    The automaton runs once over the whole text, and an expression is tried only where it reports a keyword
    of its kind. A match that is then dropped, as too short or for its checksum, still takes its characters.
    """
    ends = [0] * len(KINDS)
    found: list[tuple[int, int, int]] = []
    # Lower-casing bytes changes A-Z only, so every byte keeps its place.
    for last, (kind, size) in _automaton().iter(text.lower().decode("latin-1")):
        at = last - size + 1
        if at < ends[kind]:
            continue
        if kind == 0:
            if m := _ASSIGN.match(text, at):
                ends[0] = m.end()
                if m.end() - m.start(1) >= 6:
                    found.append((at, 0, m.end()))
        elif kind == 1:
            if m := _ACCESS.match(text, at):
                ends[1] = m.end()
                if m.end() - at >= 20:
                    found.append((at, 1, m.end()))
        elif kind == 2:
            if m := _HEX.match(text, at):
                ends[2] = m.end()
                if m.end() - at >= 24:
                    found.append((at, 2, m.end()))
        elif (at == 0 or not text[at - 1 : at].isalnum()) and (m := _CHECKED.match(text, at)):
            ends[kind] = m.end()
            if checksum(m[1]) == m[2]:
                found.append((at, kind, m.end()))
    return sorted(found)


def code_points(text: bytes, spans: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """The spans with offsets in code points. Spans start and end next to ASCII, never inside a character."""
    if not spans or text.isascii():
        return spans
    places, at, count = {}, 0, 0
    for place in sorted({p for start, _, end in spans for p in (start, end)}):
        count += len(text[at:place].decode("utf-8", "replace"))
        at = place
        places[place] = count
    return [(places[start], kind, places[end]) for start, kind, end in spans]


def _joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[kind]}:{start}:{end}" for start, kind, end in spans)


def scan(docs: DataFrame) -> DataFrame:
    """A row per row of (doc_id, text): counts per base kind, a digest of the base spans, and all spans.

    Base kinds are assignments, access keys and long hex strings; tokens of two further kinds are reported if
    the checksum they carry is right. Offsets are code points. Null and empty texts have no spans; their
    digest is that of an empty string. Repeated rows are reported once each; other columns are not read. One
    pass, without a shuffle, with memory for one batch of texts; an empty table gives an empty table.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text in batch.column("text"):
                text = text.as_py() or b""
                spans = code_points(text, spans_of(text))
                base = [s for s in spans if s[1] < BASE]
                n = [0] * len(KINDS)
                for _, kind, _ in spans:
                    n[kind] += 1
                rows.append((*n[:BASE], hashlib.sha256(_joined(base).encode()).hexdigest(), _joined(spans), sum(n[BASE:])))
            columns = [batch.column("doc_id")]
            for values, kind in zip(zip(*rows), (pa.int64(),) * 3 + (pa.string(),) * 2 + (pa.int64(),)):
                columns.append(pa.array(values, kind))
            if rows:
                yield pa.RecordBatch.from_arrays(columns, names=[f.split()[0] for f in SCHEMA.split(", ")])

    return map_arrow(docs.select(column(docs, "doc_id", "bigint"), F.col("`text`").cast("binary").alias("text")), run, SCHEMA)


def redact(docs: DataFrame, mark: str = "[SECRET]") -> DataFrame:
    """`docs` with every secret in `text` replaced by `mark`; spans that overlap become one mark.

    Other columns stay, but `n_chars`, if there, follows a changed text. Texts without secrets, null and empty
    ones among them, are unchanged; rows that repeat are changed alike, and an empty table stays one. Python gets
    the texts of a batch, whatever their length, and returns only those it has changed.
    """
    ship(docs.sparkSession)

    @F.arrow_udf("string")
    def hidden(texts: pa.Array) -> pa.Array:
        out = []
        for text in texts.cast(pa.binary()):
            text = text.as_py()
            spans = spans_of(text) if text else None
            out.append(_hidden(text, spans, mark.encode()).decode("utf-8", "replace") if spans else None)
        return pa.array(out, pa.string())

    changed = F.col("_pw_changed")
    found = docs.withColumn("_pw_changed", hidden(F.col("`text`").cast("string")))
    kinds = dict(docs.dtypes)
    out = {"text": F.coalesce(changed, F.col("`text`")).cast(kinds["text"])}
    if "n_chars" in kinds:
        out["n_chars"] = F.when(changed.isNotNull(), F.char_length(changed)).otherwise(F.col("`n_chars`")).cast(kinds["n_chars"])
    return found.select(*(out.get(c, F.col(f"`{c}`")).alias(c) for c in docs.columns))


def _hidden(text: bytes, spans: list[tuple[int, int, int]], mark: bytes) -> bytes:
    parts, at = [], 0
    for start, _, end in spans:
        if start >= at:
            parts += [text[at:start], mark]
        at = max(at, end)
    return b"".join([*parts, text[at:]])
