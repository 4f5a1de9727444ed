"""Parsing raw judge replies with native expressions.

A reply counts as strict JSON only if the *whole* reply is one JSON object.
Spark's JSON reader stops at the end of the first value, so the reply is first put
inside an envelope whose last key, named by a hash of the reply, comes after it. The
envelope has exactly its own two keys only if nothing but the object stands between them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed patterns. White space and word characters are spelled out as Unicode
# classes so that they do not depend on the regex engine's ASCII defaults. Each
# pattern starts with literal characters: compound classes are slow to test, and
# slower still from many threads at once, so no text is scanned with one.
_WS = r"[\s\x1c-\x1f\x85\p{Z}]"
_WORD = r"[\p{L}\p{N}_]"
_WINNER_KEY = rf'"winner"{_WS}*:{_WS}*"([AB])"'
_BARE_LETTER = rf"([AB])(?<!{_WORD}[AB])(?!{_WORD})"
_COMMENT_KEY = rf'(?s)"comment"{_WS}*:{_WS}*"(.+?)"{_WS}*\}}'
# Every character that counts as white space.
_SPACES = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008"
    "\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)

_REPLY = "winner string, comment string"
_STRICT_JSON = {"mode": "PERMISSIVE", "allowSingleQuotes": "false"}


def strip(text: Column) -> Column:
    """Remove every kind of white space from both ends (plain ``trim`` removes only blanks)."""
    return F.btrim(text, F.lit(_SPACES))


def _group(raw: Column, pattern: str) -> Column:
    found = F.regexp_extract(raw, pattern, 1)
    return F.when(found != "", found)


def strict_json(raw: Column) -> Column:
    """Struct with ``winner`` and ``comment`` of a reply that is one JSON object; see the module text."""
    mark = F.concat(F.lit("end"), F.md5(raw))
    # The keys are read by stricter rules than the reply, which may hold these numbers; what stands in
    # strings doesn't matter here.
    numbers = F.replace(F.replace(raw, F.lit("NaN"), F.lit("0")), F.lit("Infinity"), F.lit("0"))
    enclosed = F.concat(F.lit('{"reply":'), numbers, F.lit(',"'), mark, F.lit('":1}'))
    whole = F.json_object_keys(enclosed).eqNullSafe(F.array(F.lit("reply"), mark))
    return F.when(raw.rlike(r"^[ \t\n\r]*\{") & whole, F.from_json(raw, _REPLY, _STRICT_JSON))


def _with_json(df: DataFrame, raw: str) -> DataFrame:
    # A column of its own: from_json runs once per row although several fields are read.
    return df.withColumn("_json", strict_json(F.col(raw)))


def _json_winner() -> Column:
    winner = F.col("_json.winner")
    return F.when(winner.isin("A", "B"), winner)


def _with_results(df: DataFrame, **results: Column) -> DataFrame:
    """Add columns that later filters read but must not recompute.

    Spark moves a filter below the projection it reads from and repeats the
    projected expressions in it. The output of a generator stays where it is, so
    a one-row generator keeps each reply parsed once.
    """
    row = F.struct(*[column.alias(name) for name, column in results.items()])
    kept = [c for c in df.columns if c not in results]
    return df.select(*kept, F.inline(F.array(row)))


def parse_winner(df: DataFrame, raw: str = "raw_response", strict: bool = False) -> DataFrame:
    """Add ``parsed_winner`` and ``parse_method`` (json, key_regex, bare_letter, none).

    The first rule that yields A or B wins. The last rule takes any standalone A or
    B in prose, an article included; ``strict`` switches it off.
    """
    rules = {"json": _json_winner(), "key_regex": _group(F.col(raw), _WINNER_KEY)}
    if not strict:
        rules["bare_letter"] = _group(F.col(raw), _BARE_LETTER)
    found = F.coalesce(*[F.concat(winner, F.lit(name)) for name, winner in rules.items()])
    parsed = _with_results(_with_json(df, raw), _found=F.coalesce(found, F.lit("")))
    verdict = F.substring("_found", 1, 1)
    method = F.expr("substring(_found, 2)")
    return parsed.withColumns(
        {
            "parsed_winner": F.when(verdict != "", verdict),
            "parse_method": F.when(verdict != "", method).otherwise("none"),
        }
    ).drop("_json", "_found")


def parse_winner_comment(df: DataFrame, raw: str = "raw_response") -> DataFrame:
    """Add ``parsed_winner`` and ``comment``.

    A JSON reply with a verdict gives both. Otherwise each comes from its own
    pattern; such a comment is not unescaped, and a truncated reply has none.
    """
    text, winner, said = F.col(raw), F.col("_winner"), F.col("_said")
    staged = _with_json(df, raw).withColumn("_winner", _json_winner())
    # A column of its own, like _json: a generator would search the reply once for each use of what is found.
    staged = staged.withColumn("_said", F.when(winner.isNull(), F.regexp_extract(text, _COMMENT_KEY, 1)))
    return _with_results(
        staged,
        parsed_winner=F.coalesce(winner, _group(text, _WINNER_KEY)),
        comment=F.when(winner.isNotNull(), F.col("_json.comment")).otherwise(strip(F.when(said != "", said))),
    ).drop("_json", "_winner", "_said")


def score(df: DataFrame) -> DataFrame:
    """Add ``parse_success`` and the three-valued ``is_correct`` (null if unparsed)."""
    parsed = F.coalesce(F.col("parsed_winner").isin("A", "B"), F.lit(False))
    correct = F.col("parsed_winner").eqNullSafe(F.col("gold_winner"))
    return df.withColumns({"parse_success": parsed, "is_correct": F.when(parsed, correct)})
