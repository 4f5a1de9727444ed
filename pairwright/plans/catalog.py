"""Registered queries: every operator over the whole given tables.

Rates are rounded to six decimals and logarithms of p to four, so that the last
bits of floating-point arithmetic do not decide a comparison.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairwright.functions.labels import judge_slug, safe_name
from pairwright.functions.parsing import parse_winner, parse_winner_comment, score
from pairwright.functions.statistics import (
    bootstrap_by_resampling,
    bootstrap_mean,
    with_binom_test,
    with_bootstrap_ci,
)
from pairwright.operators import comments as comment_ops
from pairwright.operators import items as item_ops
from pairwright.operators import judging, metrics, pairing, sampling, subsets
from pairwright.plans import scratch, views
from pairwright.plans.views import CONDITIONS, CONFIG, JUDGES, MAIN, MINIMAL, PROMPTS, SWAPPED
from pairwright.schemas import JUDGMENTS
from pairwright.sources import readers, writers

Query = Callable[[SparkSession, str], DataFrame]
SEED = 42
SAMPLE_N = 45
ROSTER = item_ops.judge_list(CONFIG)
VERDICT_PROMPTS = sorted({prompt for prompt, _ in CONDITIONS})

_QUERIES: dict[str, Query] = {}


def _query(function: Query) -> Query:
    """Register a query under its name; a leading ``query_`` only avoids a clash of names."""
    _QUERIES[function.__name__.removeprefix("query_")] = function
    return function


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def _rounded(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c in columns})


def _whole(df: DataFrame, *columns: str) -> DataFrame:
    """Pair counts as bigint: keys that hardly repeat have hardly more pairs than rows."""
    return df.withColumns({c: F.col(c).cast("long") for c in columns})


def _rates(df: DataFrame, rate: str) -> DataFrame:
    return _rounded(df, rate, "ci_lower", "ci_upper")


def _judged(spark: SparkSession, sf: str, *conditions: tuple[str, bool]) -> DataFrame:
    return views.judgments(spark, sf, conditions or tuple(CONDITIONS))


def _main_and_swapped(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    return _judged(spark, sf, MAIN), _judged(spark, sf, SWAPPED)


def _items(spark: SparkSession, sf: str) -> DataFrame:
    return views.items(spark, sf).drop("row_ordinal")


# Items and requests


@_query
def build_items(spark, sf):
    return _items(spark, sf)


@_query
def swapped_items(spark, sf):
    return item_ops.swap_items(_items(spark, sf), True)


@_query
def dedupe_first(spark, sf):
    """Documents with the same text are one item; the first one stays."""
    docs = views.documents(spark, sf).withColumn("sample_id", F.md5("text"))
    first = item_ops.dedupe_first(docs.drop("text"), ["sample_id"], "doc_id")
    return first.select("sample_id", "doc_id", "lang", "source", "n_chars")


@_query
def flag_conflicts(spark, sf):
    return item_ops.flag_conflicts(views.human(spark, sf)).drop("row_ordinal")


@_query
def judge_requests(spark, sf):
    return item_ops.judge_requests(_items(spark, sf), ROSTER, "main", PROMPTS["main"], swap=True)


@_query
def judge_roster(spark, sf):
    """The configured judges with the number of requests each gets."""
    return item_ops.requests_per_judge(_items(spark, sf), ROSTER)


@_query
def model_safe_name(spark, sf):
    return _names(spark, sf).withColumn("safe_name", safe_name(F.col("model")))


@_query
def query_judge_slug(spark, sf):
    return _names(spark, sf).withColumn("slug", judge_slug(F.col("model")))


def _names(spark: SparkSession, sf: str) -> DataFrame:
    """A judge name per document: known names and odd ones."""
    key = F.col("doc_id").cast("string")
    odd = F.concat("source", F.lit("/"), F.initcap("lang"), F.lit("-v"), key, F.lit(".1 pro:free\\x"))
    kind = F.expr(views.bucket("name", "doc_id", 4))
    model = F.when(kind == 0, "openai/gpt-5.4-pro").when(kind == 1, "x-ai/grok-4.20-beta").otherwise(odd)
    return views.documents(spark, sf).select("doc_id", model.alias("model"))


# Files


@_query
def jsonl_round_trip(spark, sf):
    """Judgements written as JSONL and read again, then as tables by judge and read again."""
    folder = scratch.folder(spark)
    judged = _judged(spark, sf, MAIN).select(*JUDGMENTS.fieldNames())
    writers.write_jsonl(judged, f"{folder}/jsonl")
    back = readers.read_judgments(spark, f"{folder}/jsonl").drop("row_ordinal")
    writers.write_table(back, f"{folder}/judges", by_judge=True)
    return spark.read.parquet(f"{folder}/judges").drop("model_slug")


# Judging


@_query
def run_judges(spark, sf):
    """A whole run with a judge that needs no network."""

    def make_judge():
        def judge(model, prompt, message):
            digit = hashlib.md5(f"{model}|{message}".encode()).hexdigest()[0]
            if digit == "f":
                raise RuntimeError("429 Too Many Requests")
            return '{"winner":"A"}' if digit < "8" else '{"winner":"B"}'

        return judge

    requests = item_ops.judge_requests(_items(spark, sf), ROSTER, "main", PROMPTS["main"])
    return judging.judgments_from_replies(judging.collect_replies(requests, make_judge))


@_query
def run_comment_judges(spark, sf):
    """A run for comments on items that carry a case label."""

    def make_judge():
        def judge(model, prompt, message):
            digit = hashlib.md5(f"{model}|{message}".encode()).hexdigest()[0]
            if digit == "f":
                raise RuntimeError("429 Too Many Requests")
            return f'{{"winner":"{"A" if digit < "8" else "B"}","comment":"because of {digit}"}}'

        return judge

    case = F.expr(f"get(array('incorrect', 'unstable', 'control'), {views.bucket('case', 'sample_id', 3)})")
    picked = _items(spark, sf).withColumn("comment_case_type", case)
    requests = item_ops.judge_requests(picked, ROSTER, "comment", PROMPTS["comment"])
    return judging.comments_from_replies(judging.collect_replies(requests, make_judge, concurrency=4))


@_query
def pending_requests(spark, sf):
    pending = judging.pending_requests(
        _items(spark, sf), ROSTER, "main", PROMPTS["main"], _judged(spark, sf, MAIN)
    )
    return pending.select("sample_id", "lang_code", "model", "tier", "prompt_version", "swap_order")


# Parsing


@_query
def query_parse_winner(spark, sf):
    parsed = parse_winner(views.replies(spark, sf))
    return parsed.select(*pairing.SWAP_KEYS, "swap_order", "raw_response", "parsed_winner", "parse_method")


@_query
def parse_winner_strict(spark, sf):
    parsed = parse_winner(views.replies(spark, sf), strict=True)
    return parsed.select(*pairing.SWAP_KEYS, "swap_order", "parsed_winner", "parse_method")


@_query
def parse_method_mix(spark, sf):
    return metrics.parse_method_mix(_judged(spark, sf))


@_query
def parse_comment(spark, sf):
    parsed = parse_winner_comment(views.comment_replies(spark, sf))
    return parsed.select("sample_id", "model", "parsed_winner", "comment")


@_query
def score_judgments(spark, sf):
    return _judged(spark, sf).select(
        *pairing.SWAP_KEYS, "swap_order", "gold_winner", "parsed_winner", "parse_success", "is_correct"
    )


@_query
def parse_coverage(spark, sf):
    return _rounded(metrics.parse_coverage(_judged(spark, sf)), "parse_rate")


# Metrics


@_query
def agreement_by_model(spark, sf):
    rated = metrics.agreement_by_model(_judged(spark, sf, MAIN))
    return _rates(rated, "agreement_rate").select(
        "model", "n", "agreement_rate", "ci_lower", "ci_upper",
        F.round("binom_log10_p", 4).alias("binom_log10_p"),
    )


@_query
def swap_matched(spark, sf):
    return _whole(pairing.swap_matched(*_main_and_swapped(spark, sf), views.languages(spark, sf)), "pairs")


@_query
def swap_matched_rows(spark, sf):
    """One row per pair of rows, as a join gives them."""
    pairs = pairing.swap_matched(*_main_and_swapped(spark, sf), views.languages(spark, sf))
    return pairing.expand_pairs(pairs)


@_query
def swap_matched_repeated(spark, sf):
    """Matching when the key is far from unique: one key per document source."""
    matched = pairing.swap_matched(*_repeated(spark, sf), views.languages(spark, sf))
    return matched.withColumn("pairs", F.col("pairs").cast("double"))


@_query
def swap_consistency_repeated(spark, sf):
    rated = metrics.swap_consistency(*_repeated(spark, sf), views.languages(spark, sf))
    return _rates(rated, "swap_consistency_rate").withColumn("n", F.col("n").cast("double"))


def _repeated(spark: SparkSession, sf: str) -> list[DataFrame]:
    key = F.concat(F.lit("q_"), (F.col("row_ordinal") / 100).cast("long") % 7)
    return [t.withColumn("sample_id", key) for t in _main_and_swapped(spark, sf)]


@_query
def prompt_matched(spark, sf):
    tables = _judged(spark, sf, MAIN), _judged(spark, sf, MINIMAL)
    return _whole(pairing.prompt_matched(*tables, views.languages(spark, sf)), "pairs")


@_query
def swap_consistency(spark, sf):
    rated = metrics.swap_consistency(*_main_and_swapped(spark, sf), views.languages(spark, sf))
    return _whole(_rates(rated, "swap_consistency_rate"), "n")


@_query
def prompt_consistency(spark, sf):
    tables = _judged(spark, sf, MAIN), _judged(spark, sf, MINIMAL)
    rated = metrics.prompt_consistency(*tables, views.languages(spark, sf))
    return _whole(_rates(rated, "prompt_consistency_rate"), "n")


@_query
def swap_single_file(spark, sf):
    return _rates(metrics.swap_single_file(_judged(spark, sf)), "swap_consistency_rate")


@_query
def prompt_single_file(spark, sf):
    rated = metrics.prompt_single_file(_judged(spark, sf), judges=JUDGES, prompts=VERDICT_PROMPTS)
    return _rates(rated, "prompt_consistency_rate")


@_query
def verdict_pivot(spark, sf):
    return metrics.verdict_pivot(_judged(spark, sf))


@_query
def judge_leaderboard(spark, sf):
    board = metrics.judge_leaderboard(*_main_and_swapped(spark, sf), _judged(spark, sf, MINIMAL))
    return _whole(board, "swap_n", "prompt_n")


@_query
def common_judges(spark, sf):
    """Judges in both runs when each run covers only some documents' judges."""
    main, swapped = _main_and_swapped(spark, sf)
    return pairing.common_judges(main.filter("tier <> 'unknown'"), swapped.filter("model <> 'east/judge-3'"))


@_query
def run_summary(spark, sf):
    summary = pairing.run_summary(*_main_and_swapped(spark, sf))
    return summary.withColumn("models_compared", F.array_join("models_compared", "; "))


@_query
def metrics_summary(spark, sf):
    judged = _judged(spark, sf)
    return metrics.metrics_summary(
        metrics.agreement_by_model(_judged(spark, sf, MAIN)),
        metrics.swap_single_file(judged),
        metrics.prompt_single_file(judged, judges=JUDGES, prompts=VERDICT_PROMPTS),
    )


@_query
def union_runs(spark, sf):
    """Verdict runs and comment runs under one another; comment runs know no order."""
    comments = score(parse_winner_comment(views.comment_replies(spark, sf)))
    both = pairing.union_runs(_judged(spark, sf), comments)
    return both.select(
        "sample_id", "model", "prompt_version", "swap_order", "parsed_winner", "comment_case_type"
    )


# Statistics


def _counts(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.agreement_counts(_judged(spark, sf), "model", "prompt_version", "lang_code")


@_query
def binom_test(spark, sf):
    tested = with_binom_test(_counts(spark, sf))
    return tested.withColumn("binom_log10_p", F.round("binom_log10_p", 4)).drop("binom_pvalue")


@_query
def bootstrap_ci_exact(spark, sf):
    return _rounded(with_bootstrap_ci(_counts(spark, sf)), "ci_lower", "ci_upper")


@_query
def bootstrap_ci_hash(spark, sf):
    counts = metrics.agreement_counts(_judged(spark, sf, MAIN), "model")
    return _rounded(bootstrap_by_resampling(counts, ["model"], seed=SEED), "ci_lower", "ci_upper")


@_query
def bootstrap_ci_numeric(spark, sf):
    """The mean length of human comments per language, with its interval."""
    rated = bootstrap_mean(views.human(spark, sf), ["lang_code"], "comment_len", seed=SEED)
    return _rounded(rated, "mean", "ci_lower", "ci_upper")


# Sampling and subsets


@_query
def simple_sample(spark, sf):
    return sampling.simple_sample(_items(spark, sf), SAMPLE_N, SEED)


@_query
def stratified_sample(spark, sf):
    return sampling.stratified_sample(_items(spark, sf), SAMPLE_N, SEED)


@_query
def stratified_exact(spark, sf):
    return sampling.stratified_exact(_items(spark, sf), SAMPLE_N, SEED)


@_query
def subset_distribution(spark, sf):
    return sampling.distribution(sampling.stratified_exact(_items(spark, sf), SAMPLE_N, SEED), "lang_code")


@_query
def incorrect_items(spark, sf):
    return subsets.incorrect_items(_judged(spark, sf, MAIN))


@_query
def incorrect_any_judge(spark, sf):
    return subsets.incorrect_any_judge(_judged(spark, sf, MAIN), JUDGES[:2])


@_query
def unstable_items(spark, sf):
    return subsets.unstable_items(*_main_and_swapped(spark, sf))


@_query
def judge_disagreement(spark, sf):
    return _whole(pairing.judge_disagreement(_judged(spark, sf, MAIN), JUDGES[0], JUDGES[1]), "pairs")


@_query
def control_pool(spark, sf):
    return subsets.control_pool(_items(spark, sf), *_main_and_swapped(spark, sf), JUDGES)


@_query
def silent_judges(spark, sf):
    """Judges of the roster without a verdict in tables that lack some of them."""
    main, swapped = _main_and_swapped(spark, sf)
    some = [t.filter("tier <> 'unknown' AND model <> 'east/judge-3'") for t in (main, swapped)]
    return subsets.silent_judges(JUDGES, *some)


@_query
def comment_subset_judge(spark, sf):
    picked = subsets.comment_subset_judge(_items(spark, sf), *_main_and_swapped(spark, sf), JUDGES, seed=SEED)
    return picked.select("comment_target_model", "sample_id", "lang_code", "gold_winner", "comment_case_type")


@_query
def comment_subset_shared(spark, sf):
    picked = subsets.comment_subset_shared(
        _items(spark, sf), *_main_and_swapped(spark, sf), JUDGES[0], JUDGES[1], seed=SEED
    )
    return picked.select("sample_id", "lang_code", "gold_winner", "comment_case_type")


# Comments


def _comments(spark: SparkSession, sf: str, by_item: bool = False) -> DataFrame:
    return score(parse_winner_comment(views.comment_replies(spark, sf, by_item)))


@_query
def merge_comments(spark, sf):
    """The three tables are dealt by item together, so each text is shuffled once before it is multiplied."""
    people = views.human(spark, sf, by_item=True).drop("row_ordinal")
    base = views.items(spark, sf, by_item=True).drop("row_ordinal")
    return comment_ops.merge_comments(base, people, _comments(spark, sf, by_item=True), JUDGES)


@_query
def merge_comments_hot(spark, sf):
    """A third of the human rows are about one item."""
    people = views.human(spark, sf)
    first = people.agg(F.min_by("sample_id", "row_ordinal")).first()[0]
    hot = F.expr(f"{views.bucket('hot', 'sample_id', 3)} = 0")
    people = people.withColumn("sample_id", F.when(hot, F.lit(first)).otherwise(F.col("sample_id")))
    merged = comment_ops.merge_comments(_items(spark, sf), people, _comments(spark, sf), JUDGES, rows_per_copy=50)
    return merged.select("sample_id", "human_comment", "human_issues", "choice", "north_judge_1_0_winner")


def _dimension_counts(spark: SparkSession, sf: str) -> DataFrame:
    people = views.human(spark, sf).select(
        F.lit("human").alias("source"), "sample_id", F.col("commet").alias("comment")
    )
    judges = _comments(spark, sf).select(
        judge_slug(F.col("model")).alias("source"), "sample_id", "comment"
    )
    return comment_ops.dimension_counts(people.unionByName(judges), views.lexicon(spark))


@_query
def dimension_counts(spark, sf):
    return _dimension_counts(spark, sf)


@_query
def dimension_share(spark, sf):
    return _rounded(comment_ops.dimension_share(_dimension_counts(spark, sf)), "share")


@_query
def dimension_axis(spark, sf):
    shares = comment_ops.dimension_share(_dimension_counts(spark, sf))
    return _rounded(comment_ops.dimension_axis(shares), "upper", "tick")
