"""Matching, consistency and agreement on hand-made tables and brute force."""

import random

import pytest
from helpers import judged, rows

from pairwright.functions.labels import judge_slug, judge_slug_of, safe_name
from pairwright.operators import metrics, pairing
from pyspark.sql import functions as F

M, N = "main", "minimal"


def split(table):
    return table.filter("NOT swap_order"), table.filter("swap_order")


def test_swap_matched_flags(spark):
    table = judged(spark, [
        ("i1", "de", "j", M, False, "A", "A"), ("i1", "de", "j", M, True, "B", "B"),
        ("i2", "de", "j", M, False, "A", "A"), ("i2", "de", "j", M, True, "B", "A"),
        ("i3", "de", "j", M, False, "A", "A"),
        ("i4", "de", "j", M, False, "A", None), ("i4", "de", "j", M, True, "B", "A"),
        ("i5", "de", "j", M, False, "A", "B"), ("i5", "de", "j", N, True, "B", "A"),
    ])
    found = rows(pairing.swap_matched(*split(table)))
    assert found == [
        ("i1", "j", M, "A", "de", "B", 1, 1),
        ("i2", "j", M, "A", "de", "A", 0, 1),
    ]


def test_prompt_matched_ignores_swapped_rows(spark):
    main = judged(spark, [
        ("i1", "de", "j", M, False, "A", "A"), ("i1", "de", "j", M, True, "A", "B"),
        ("i2", "fr", "j", M, False, "A", "B"),
    ])
    other = judged(spark, [
        ("i1", "de", "j", N, False, "A", "A"), ("i2", "fr", "j", N, False, "A", "A"),
        ("i2", "fr", "k", N, False, "A", "B"),
    ])
    assert rows(pairing.prompt_matched(main, other)) == [
        ("i1", "j", "A", "de", "A", 1, 1),
        ("i2", "j", "B", "fr", "A", 0, 1),
    ]


def brute_pairs(left, right, keys):
    """The plain nested-loop join, nulls equal to each other."""
    return [(m, s) for m in left for s in right if all(m[k] == s[k] for k in keys)]


def random_rows(seed, count):
    rng = random.Random(seed)
    return [
        (
            rng.choice(["i1", "i2", "i3", None]),
            rng.choice(["de", "fr", None]),
            rng.choice(["j", "k"]),
            rng.choice([M, N]),
            rng.random() < 0.5,
            "A",
            rng.choice(["A", "B", None]),
        )
        for _ in range(count)
    ]


@pytest.mark.parametrize("seed", [1, 2])
def test_repeated_keys_count_like_the_join(spark, seed):
    table = judged(spark, random_rows(seed, 120))
    main, swapped = split(table)
    left = [r.asDict() for r in pairing.valid(main).collect()]
    right = [r.asDict() for r in pairing.valid(swapped).collect()]
    brute = brute_pairs(left, right, pairing.SWAP_KEYS)
    expected = sorted(
        (
            (
                m["sample_id"], m["model"], m["prompt_version"], m["parsed_winner"], m["lang_code"],
                s["parsed_winner"], int(m["parsed_winner"] != s["parsed_winner"]),
            )
            for m, s in brute
        ),
        key=repr,
    )
    matched = pairing.swap_matched(main, swapped)
    assert rows(pairing.expand_pairs(matched)) == expected
    assert matched.agg(F.sum("pairs")).first()[0] == len(brute)

    summary = {(r.group, r.model): (r.n, r.swap_consistency_rate) for r in
               metrics.swap_consistency(main, swapped).collect()}
    flags = {}
    for e in expected:
        flags.setdefault(("overall", e[1]), []).append(e[6])
        if e[4] is not None:  # a null language has no row of its own
            flags.setdefault((f"lang={e[4]}", e[1]), []).append(e[6])
    assert summary == {g: (len(f), pytest.approx(sum(f) / len(f))) for g, f in flags.items()}


def test_hot_key_stays_small(spark):
    """A key repeated 20,000 times on both sides stands for 4 x 10^8 pairs in a few rows."""
    hot = spark.range(40_000).select(
        F.lit("hot").alias("sample_id"), F.lit("de").alias("lang_code"), F.lit("j").alias("model"),
        F.lit(M).alias("prompt_version"), (F.col("id") % 2 == 1).alias("swap_order"),
        F.when(F.col("id") % 8 < 6, "A").otherwise("B").alias("parsed_winner"),
        F.lit(True).alias("parse_success"),
    )
    main, swapped = split(hot)
    found = {(r.winner_main, r.winner_swap): r.pairs for r in pairing.swap_matched(main, swapped).collect()}
    assert sum(found.values()) == 20_000**2 and len(found) == 4
    overall = metrics.swap_consistency(main, swapped).filter("group = 'overall'").first()
    assert overall.n == 20_000**2 and overall.swap_consistency_rate == pytest.approx(0.375)


def test_consistency_is_symmetric(spark):
    table = judged(spark, random_rows(5, 200))
    main, other = table.filter("prompt_version = 'main'"), table.filter("prompt_version = 'minimal'")
    one = rows(metrics.prompt_consistency(main, other).filter("group = 'overall'"))
    two = rows(metrics.prompt_consistency(other, main).filter("group = 'overall'"))
    assert one == two


def test_foreign_verdicts(spark):
    """A parsed row without A or B has no swap flag and is never prompt-consistent."""
    base = judged(spark, [("i1", "de", "j", M, False, "A", "A"), ("i1", "de", "j", M, True, "A", "B")])
    odd = base.withColumns({"parsed_winner": F.lit("C"), "parse_success": F.lit(True)})
    main, swapped = split(odd)
    assert rows(pairing.swap_matched(main, swapped), "winner_main", "swap_consistent") == [(None, None)]
    assert rows(pairing.prompt_matched(main, main), "prompt_consistent") == [(0,)]
    assert metrics.swap_consistency(main, swapped).count() == 0


def test_agreement(spark):
    table = judged(spark, [
        ("i1", "de", "j", M, False, "A", "A"), ("i2", "de", "j", M, False, "A", "B"),
        ("i3", "de", "j", M, False, "A", None), ("i1", "de", "k", M, False, "B", "B"),
        ("i1", "de", None, M, False, "B", "B"),
    ])
    found = metrics.agreement_by_model(table).collect()
    assert [(r.model, r.n, r.agreement_rate) for r in found] == [("k", 1, 1.0), ("j", 2, 0.5)]
    assert found[0].binom_pvalue == pytest.approx(0.5) and found[1].binom_pvalue == pytest.approx(0.75)
    assert (found[0].ci_lower, found[1].ci_lower, found[1].ci_upper) == (1.0, 0.0, 1.0)


def test_no_rows_give_an_empty_table(spark):
    empty = judged(spark, [("i", "de", "j", M, False, "A", None)])
    for table, columns in [
        (metrics.agreement_by_model(empty), 7),
        (metrics.swap_consistency(empty, empty), 6),
        (metrics.swap_single_file(empty), 5),
        (metrics.prompt_single_file(empty), 7),
    ]:
        assert table.collect() == [] and len(table.columns) == columns


def test_single_file_takes_first_verdict(spark):
    table = judged(spark, [
        ("i1", "de", "j", M, False, "A", None), ("i1", "de", "j", M, False, "A", "B"),
        ("i1", "de", "j", M, False, "A", "A"), ("i1", "de", "j", M, True, "A", "A"),
        ("i2", "de", "j", M, False, "A", "A"), ("i3", "de", "j", M, True, "A", "A"),
        (None, "de", "j", M, False, "A", "A"), (None, "de", "j", M, True, "A", "B"),
    ])
    for data in (table, table.repartition(5)):
        assert rows(metrics.verdict_pivot(data)) == [
            ("i1", "j", M, "B", "A"), ("i2", "j", M, "A", None), ("i3", "j", M, None, "A"),
        ]
    only = metrics.swap_single_file(table).first()
    assert (only.n, only.swap_consistency_rate) == (1, 1.0)


def test_first_verdict_with_structured_ordinal(spark):
    """Files give an ordinal of several fields; the result is the same."""
    table = judged(spark, random_rows(9, 150))
    composed = table.withColumn(
        "row_ordinal", F.struct((F.col("row_ordinal") / 50).cast("int"), F.col("row_ordinal"))
    )
    assert rows(metrics.verdict_pivot(table)) == rows(metrics.verdict_pivot(composed))


@pytest.mark.parametrize("judges", [None, ["j", "k"]])
def test_prompt_single_file_any_number_of_prompts(spark, judges):
    data = [r for r in random_rows(11, 400) if r[0] is not None]
    rng = random.Random(4)
    data = [(*r[:3], rng.choice(["c", "a2", "b", "d"]) if r[2] == "j" else rng.choice(["c", "d"]), *r[4:])
            for r in data]
    table = judged(spark, data)
    first = {}
    for r in data:
        if r[6] is not None:
            first.setdefault((r[2], r[0], r[3]), r[6])
    expected = []
    for model in ("j", "k"):
        prompts = sorted({p for m, _, p in first if m == model})
        ids = {i for m, i, _ in first if m == model}
        for other in prompts[1:]:
            both = [i for i in ids if (model, i, prompts[0]) in first and (model, i, other) in first]
            same = sum(first[model, i, prompts[0]] == first[model, i, other] for i in both)
            if both:
                expected.append((model, prompts[0], other, len(both), pytest.approx(same / len(both))))
    found = rows(
        metrics.prompt_single_file(table, judges=judges),
        "model", "base_prompt", "other_prompt", "n", "prompt_consistency_rate",
    )
    assert found == sorted(expected, key=lambda e: repr(e[:3]))


def test_disagreement(spark):
    table = judged(spark, [
        ("i1", "de", "j", M, False, "A", "A"), ("i1", "de", "k", M, False, "A", "B"),
        ("i2", "de", "j", M, False, "A", "A"), ("i2", "de", "k", M, False, "A", "A"),
        ("i3", "de", "j", M, False, "A", "A"), ("i3", "de", "k", M, False, "A", None),
    ])
    assert rows(pairing.judge_disagreement(table, "j", "k")) == [("i1", "A", "B", 1)]


def test_run_summary_and_common_judges(spark):
    main = judged(spark, [("i", "de", m, M, False, "A", "A") for m in ("k", "j", "j")])
    other = judged(spark, [("i", "de", m, M, True, "A", None) for m in ("j", "x")])
    assert rows(pairing.run_summary(main, other)) == [(3, 2, ["j"])]
    assert rows(pairing.common_judges(main, other)) == [("j",)]
    assert rows(pairing.run_summary(main.limit(0), other.limit(0))) == [(0, 0, [])]


def test_metrics_summary_counts_rows(spark):
    one = spark.range(3)
    assert rows(metrics.metrics_summary(one, one.limit(0), spark.range(2))) == [(3, 0, 2)]


def test_union_of_different_runs(spark):
    main = judged(spark, [("i", "de", "j", M, False, "A", "A")])
    comments = main.drop("swap_order").withColumn("comment", F.lit("c"))
    both = pairing.union_runs(main, comments)
    assert rows(both, "swap_order", "comment") == [(False, None), (None, "c")]


def test_coverage(spark):
    table = judged(spark, [("i", "de", "j", M, False, "A", w) for w in ("A", None, None, None)])
    raw = F.element_at(F.array(F.lit("A"), F.lit("??"), F.lit(None), F.lit(None)), (F.col("row_ordinal") + 1).cast("int"))
    table = table.withColumns({"raw_response": raw, "error": F.when(F.col("row_ordinal") == 3, "429")})
    r = metrics.parse_coverage(table).first()
    assert (r.n_rows, r.n_replies, r.n_empty, r.n_errors, r.n_effective, r.parse_rate) == (4, 2, 1, 1, 1, 0.25)


def test_leaderboard_keeps_judges_without_stability_runs(spark):
    main = judged(spark, [("i", "de", m, M, False, "A", "A") for m in ("j", "k")])
    swapped = judged(spark, [("i", "de", "j", M, True, "B", "B")])
    board = {r.model: r for r in metrics.judge_leaderboard(main, swapped, main.limit(0)).collect()}
    assert board["j"].swap_pct == 100.0 and board["j"].swap_n == 1
    assert board["k"].validity_pct == 100.0 and board["k"].swap_pct is None and board["k"].prompt_n is None


def test_results_do_not_depend_on_partitioning(spark):
    table = judged(spark, random_rows(21, 300))
    results = []
    for partitions in ("1", "200"):
        spark.conf.set("spark.sql.shuffle.partitions", partitions)
        main, swapped = split(table.repartition(3))
        results.append([
            rows(metrics.swap_consistency(main, swapped)),
            rows(metrics.swap_single_file(table.repartition(7))),
            rows(metrics.prompt_single_file(table)),
        ])
    spark.conf.set("spark.sql.shuffle.partitions", "8")
    assert results[0] == results[1]


def test_names(spark):
    names = ["openai/gpt-5.4", "Openai/GPT-5.4", "Org/My-Model.1", "a b:c", None]
    frame = spark.createDataFrame([(n,) for n in names], "m string")
    found = [r[0] for r in frame.select(judge_slug(F.col("m"))).collect()]
    assert found == ["gpt54", "openai_gpt_5_4", "org_my_model_1", "a_b_c", None]
    assert [judge_slug_of(n) for n in names[:4]] == found[:4]
    assert frame.select(safe_name(F.lit("a/b:c\\d-e"))).first()[0] == "a_b_c_d-e"


def test_expanded_pairs_span_blocks(spark):
    from pairwright.operators.pairing import expand_pairs

    frame = spark.createDataFrame([("a", 250_001), ("b", 1)], "key string, pairs long")
    assert {tuple(r) for r in expand_pairs(frame).groupBy("key").count().collect()} == {("a", 250_001), ("b", 1)}


def test_counts_beyond_a_bigint(spark):
    """Keys with billions of rows a side stand for more pairs than a bigint holds."""
    many = 4 * 10**9
    counts = spark.createDataFrame(
        [("j", "de", i, many, many, 0, many, 0, 0) for i in range(7)],
        "model string, lang_code string, i int, left_a long, left_b long, left_none long,"
        " right_a long, right_b long, right_none long",
    )
    matched = pairing.matched_pairs(counts, "one", "other").agg(F.sum("pairs")).first()[0]
    assert matched == 7 * 2 * many**2
    rated = metrics._summary(counts, "swap_consistent", "rate").filter("group = 'overall'").first()
    assert rated.n == 7 * 2 * many**2 and rated.rate == pytest.approx(0.5)
    assert rated.ci_lower == pytest.approx(0.5, abs=1e-8) and rated.ci_upper == pytest.approx(0.5, abs=1e-8)


def mixed_tables(spark):
    """Keys that repeat, on several languages and none, with verdicts of all kinds."""
    rng = random.Random(3)
    made = []
    for swap in (False, True):
        made.append([
            (f"i{rng.randrange(40)}", rng.choice(["de", "fr", None]), rng.choice(["j", "k", None]), rng.choice(["main", "minimal"]),
             swap, rng.choice("AB"), rng.choice(["A", "B", "A", None]))
            for _ in range(400)
        ])
    return judged(spark, made[0]), judged(spark, made[1])


def hash_exchanges(df):
    text = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[-1]
    return text.count("Exchange hashpartitioning(")


def test_listed_languages_change_the_plan_only(spark):
    main, swapped = mixed_tables(spark)
    for matched in (pairing.swap_matched, pairing.prompt_matched):
        other = swapped if matched is pairing.swap_matched else main
        listed = matched(main, other, ["de", "fr", "unused"])
        assert rows(listed) == rows(matched(main, other)) and listed.count() > 50
        assert hash_exchanges(listed) == 1 and hash_exchanges(matched(main, other)) == 2
    assert rows(metrics.swap_consistency(main, swapped, ["fr", "de"])) == rows(metrics.swap_consistency(main, swapped))
    with pytest.raises(Exception, match="unlisted lang_code: fr"):
        pairing.swap_matched(main, swapped, ["de"]).collect()
    assert pairing.swap_matched(main.limit(0), swapped, ["de"]).count() == 0


def test_listed_prompts_change_the_plan_only(spark):
    main, swapped = mixed_tables(spark)
    both = main.unionByName(swapped)
    listed = metrics.prompt_single_file(both, prompts=["minimal", "main", "other"])
    assert rows(listed) == rows(metrics.prompt_single_file(both)) and listed.count() == 2
    assert hash_exchanges(metrics._prompt_pairs(both, "row_ordinal", ["main", "minimal"])) == 2
    only = both.filter("prompt_version = 'minimal'")
    assert metrics.prompt_single_file(only, prompts=["main", "minimal"]).count() == 0
    assert metrics.prompt_single_file(only, prompts=["minimal"]).count() == 0
    with pytest.raises(Exception, match="unlisted prompt_version: minimal"):
        metrics.prompt_single_file(both, prompts=["main"]).collect()


def test_leaderboard_is_its_parts(spark):
    main, swapped = mixed_tables(spark)
    other = main.filter("prompt_version = 'minimal'")
    board = {r.model: r for r in metrics.judge_leaderboard(main, swapped, other).collect()}
    parts = {
        "validity": (metrics.agreement_by_model(main), "agreement_rate"),
        "swap": (metrics.swap_consistency(main, swapped).filter("group = 'overall'"), "swap_consistency_rate"),
        "prompt": (metrics.prompt_consistency(main, other).filter("group = 'overall'"), "prompt_consistency_rate"),
    }
    assert set(board) == {"j", "k"}
    for part, (table, rate) in parts.items():
        for r in table.collect():
            of = board[r.model]
            assert of[f"{part}_n"] == r.n and of[f"{part}_pct"] == pytest.approx(100 * r[rate], abs=0.0501)
            assert of[f"{part}_ci_lower_pct"] == pytest.approx(100 * r.ci_lower, abs=0.0501)
    alone = metrics.judge_leaderboard(main, swapped.limit(0), other.limit(0)).first()
    assert alone.swap_n is None and alone.prompt_pct is None and alone.validity_n > 0
