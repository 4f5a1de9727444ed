"""Merging human and judge comments, and counting what they talk about."""

from __future__ import annotations

import re
from collections.abc import Sequence
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pairwright.functions.labels import judge_slug_of
from pairwright.schemas import require

# Fixed names: the item columns of the wide table, and the suffix each column of a comment table gets in it.
_ITEM_COLUMNS = ["lang_code", "source", "translation_a", "translation_b", "gold_winner"]
_JUDGE_COLUMNS = {
    "comment_case_type": "comment_case_type",
    "parsed_winner": "winner",
    "comment": "comment",
    "is_correct": "is_correct",
    "model": "model",
    "lang_code": "lang_code",
    "parse_success": "parse_success",
}
# Fixed order of the leading columns of the wide table.
_LEADING = [
    "sample_id", "lang_code", "source", "translation_a", "translation_b", "gold_winner",
    "human_comment", "human_issues", "human_comment_len",
]
_LEADING_SLUGS = ["deepseek", "gemini", "grok", "claude", "gpt54"]
_LEADING_SUFFIXES = [
    "comment_case_type", "winner", "comment", "is_correct", "parse_success", "model",
]

# Human rows of one item that are joined in one place; an item with more of them is copied in proportion.
ROWS_PER_COPY = 100_000
# Items that are copied at most: those with the most human rows. Each of the others has fewer rows than any of them.
MOST_COPIED = 100_000
# Terms of a lexicon, which is configuration and becomes part of the expressions.
MOST_TERMS = 10_000
# Up to so many terms each is looked for by itself, which is faster; more would make too many expressions.
TERMS_APART = 200


def human_columns(human: DataFrame, extra: Sequence[str] = ()) -> DataFrame:
    """The human side of the wide table; which columns it has depends on the table. ``extra`` columns come last.

    The comment is the first *column* present of ``commet`` and ``comment``, not the
    first non-null value.
    """
    require(human, ["sample_id"])
    renamed = {"issues": "human_issues", "comment_len": "human_comment_len"}
    comment = next((c for c in ("commet", "comment") if c in human.columns), None)
    if comment:
        renamed = {comment: "human_comment", **renamed}
    kept = ["choice", "gold", "winner", "winner_field"]
    language = [F.col("lang_code").alias("_human_lang")] if "lang_code" in human.columns else []
    return human.select(
        "sample_id",
        *language,
        *[F.col(c).alias(name) for c, name in renamed.items() if c in human.columns],
        *[c for c in kept if c in human.columns],
        *extra,
    )


def slugs(models: Sequence[str]) -> dict[str, str]:
    """Column prefix per judge; an error when two judges would share one."""
    prefixes = {model: judge_slug_of(model) for model in models}
    if len(set(prefixes.values())) != len(prefixes):
        raise ValueError(f"judges share a column prefix: {prefixes}")
    return prefixes


def pivot_comments(
    comments: DataFrame,
    models: Sequence[str],
    ordinal: str = "row_ordinal",
    keys: Sequence[str] = ("sample_id",),
) -> DataFrame:
    """One row per item with the first row of every judge, columns prefixed by judge.

    First-row-wins and the pivot share one aggregation, whatever the number of
    judges. Repeats of an item are reduced before the shuffle. A comment of a judge that is not
    in ``models``, or of none, is an error that names it.
    """
    prefixes = slugs(models)
    message = F.concat(F.lit("a comment of an unlisted judge: "), F.coalesce("model", F.lit("null")))
    known = F.when(F.col("model").isin(*models), F.lit(True)).otherwise(F.raise_error(message).cast("boolean"))
    present = [c for c in _JUDGE_COLUMNS if c in comments.columns]
    row = F.struct(*present)
    wide = (
        comments.filter(known)
        .groupBy(*keys)
        .agg(
            *[
                F.min_by(row, F.when(F.col("model") == model, F.col(ordinal))).alias(prefix)
                for model, prefix in prefixes.items()
            ]
        )
    )
    return wide.select(
        *keys,
        *[
            F.col(f"`{prefix}`.{c}").alias(f"{prefix}_{_JUDGE_COLUMNS[c]}")
            for prefix in prefixes.values()
            for c in present
        ],
    )


def merge_comments(
    items: DataFrame,
    human: DataFrame,
    comments: DataFrame,
    models: Sequence[str],
    ordinal: str = "row_ordinal",
    rows_per_copy: int = ROWS_PER_COPY,
) -> DataFrame:
    """Items that have a judge comment, with the human and all judges' columns beside them.

    Judges' columns are pivoted once and joined once. Items without any judge
    comment are dropped before the human join. The human side may repeat an item;
    each repeat gives a row. ``lang_code`` is the item's, else the human table's.

    An item with many human rows is copied, as one wide row, a number of times in proportion to them; each human row
    goes to the copy that a hash of its own columns names, its ordinal included, so a task that runs again
    deals them the same way. Only items with more than ``rows_per_copy`` rows are listed for that, the ``MOST_COPIED``
    with the most rows. That bounds the list, which goes to all tasks: no human row is shuffled before its copy is
    known. Equal rows without an ordinal stay together. The wide rows of all other items are joined where they are:
    only copies are shuffled again.
    """
    kept = [c for c in _ITEM_COLUMNS if c in items.columns]
    people = human_columns(human)
    position = [ordinal] if ordinal in human.columns else []
    counts = human.groupBy("sample_id").agg(F.count("*").alias("_cnt"))
    copies = F.ceil(F.col("_cnt") / rows_per_copy).cast("int").alias("_copies")
    hottest = counts.filter(F.col("_cnt") > rows_per_copy).orderBy(F.desc("_cnt"), "sample_id").limit(MOST_COPIED)
    many = F.broadcast(hottest.select("sample_id", copies))

    merged = items.select("sample_id", *kept)
    if models:
        wide = pivot_comments(comments, models, ordinal)
        commented = [F.col(f"{p}_comment") for p in slugs(models).values()]
        merged = merged.join(wide.filter(F.coalesce(*commented).isNotNull()), "sample_id")
    merged = merged.join(many, "sample_id", "left")
    said = human_columns(human, position).withColumnRenamed(ordinal, "_position") if position else people
    single = merged.filter("_copies IS NULL").drop("_copies").join(
        people.join(many, "sample_id", "left_anti"), "sample_id", "left"
    )
    own = F.xxhash64(*[F.col(c) for c in said.columns])
    dealt = said.join(many, "sample_id").withColumn("_copy", F.pmod(own, F.col("_copies")).cast("int"))
    copied = merged.filter("_copies IS NOT NULL").selectExpr("*", "explode(sequence(0, _copies - 1)) AS _copy")
    # Each row of these finds the one copy it is dealt to; a copy may get none.
    copied = copied.drop("_copies").join(dealt.drop("_copies", "_position"), ["sample_id", "_copy"])
    merged = single.unionByName(copied.drop("_copy"))

    if "_human_lang" in people.columns:
        sources = ["lang_code", "_human_lang"] if "lang_code" in kept else ["_human_lang"]
        merged = merged.withColumn("lang_code", F.coalesce(*sources))
    merged = merged.drop("_human_lang")
    leading = _LEADING + [f"{p}_{s}" for p in _LEADING_SLUGS for s in _LEADING_SUFFIXES]
    ordered = [c for c in leading if c in merged.columns]
    human_rest = [c for c in people.columns if c in merged.columns and c not in ordered]
    rest = [c for c in merged.columns if c not in ordered and c not in human_rest]
    return merged.select(*ordered, *human_rest, *rest)


_LETTER = r"[\p{L}\p{M}]"


def _mentions(terms: Sequence[str]) -> str:
    """A pattern for any of the terms as whole words; words of a phrase may stand apart by anything but letters.

    Terms begin the pattern and are looked back at, so a text is searched for literals only.
    """
    found = []
    for term in sorted(terms):
        first, *rest = term.split(" ")
        words = "".join(rf"[^\p{{L}}\p{{M}}]+{re.escape(w)}" for w in rest)
        found.append(f"{re.escape(first)}(?<!{_LETTER}{re.escape(first)}){words}")
    return f"(?:{'|'.join(found)})(?!{_LETTER})"


def _mentioned(text: Column, terms: Sequence[str], apart: bool) -> Column:
    """Whether the text mentions any of the terms. The pattern of a term is run only on texts that hold its first word."""
    if not apart:
        return text.rlike(_mentions(terms))
    return reduce(or_, [text.contains(term.split(" ")[0]) & text.rlike(_mentions([term])) for term in terms])


def lexicon_terms(lexicon: DataFrame) -> dict[str, list[str]]:
    """The terms of each dimension of a (dimension, term) table: lower case, words one space apart, each once.

    A lexicon is configuration, at most ``MOST_TERMS`` rows; more are an error, as is a term without a letter.
    """
    rows = lexicon.select("dimension", "term").limit(MOST_TERMS + 1).collect()
    if len(rows) > MOST_TERMS:
        raise ValueError(f"a lexicon has at most {MOST_TERMS} terms")
    terms: dict[str, set[str]] = {}
    for dimension, term in rows:
        words = re.findall(r"[^\W\d_]+", (term or "").lower())
        if not words:
            raise ValueError(f"a term without a letter: {term!r}")
        terms.setdefault(dimension, set()).add(" ".join(words))
    return {dimension: sorted(found) for dimension, found in sorted(terms.items())}


def dimension_counts(comments: DataFrame, lexicon: DataFrame) -> DataFrame:
    """Distinct commented items per (source, dimension), zeros included.

    ``comments`` has source, sample_id and comment; ``lexicon`` is a table of (dimension, term), a term being one
    or several words. Texts are reduced to one flag per dimension where they are read, by a search that
    stops at the first term it finds; only flags are shuffled. A row without a comment mentions nothing.
    """
    terms = lexicon_terms(lexicon)
    names = list(terms)
    text, apart = F.col("_text"), sum(map(len, terms.values())) <= TERMS_APART
    flags = [
        F.coalesce(_mentioned(text, found, apart), F.lit(False)).alias(f"_d{i}") for i, found in enumerate(terms.values())
    ]
    lowered = comments.select("source", "sample_id", F.lower("comment").alias("_text"))
    per_item = lowered.select("source", "sample_id", *flags).groupBy("source", "sample_id").agg(
        *[F.bool_or(f"_d{i}").alias(f"_d{i}") for i in range(len(names))]
    )
    per_source = per_item.groupBy("source").agg(
        *[F.count_if(F.col(f"_d{i}")).alias(name) for i, name in enumerate(names)]
    )
    return per_source.unpivot("source", names, "dimension", "cnt")


def dimension_share(counts: DataFrame) -> DataFrame:
    """Share of each dimension in the mentions of its source; null if it has none."""
    in_source = F.sum("cnt").over(Window.partitionBy("source"))
    return counts.withColumn("share", F.try_divide("cnt", in_source))


def dimension_axis(shares: DataFrame, levels: int = 5) -> DataFrame:
    """Axis bound common to all sources, as evenly spaced ticks from the first to the bound."""
    bound = shares.agg((F.max("share") + 0.005).alias("upper"))
    ticks = F.explode(F.sequence(F.lit(1), F.lit(levels))).alias("level")
    return bound.select("upper", ticks).withColumn("tick", F.col("upper") * F.col("level") / levels)
