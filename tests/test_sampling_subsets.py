"""Draws and diagnostic subsets."""

import hashlib

import pytest
from helpers import items, judged, rows

from pairwright.operators import sampling, subsets
from pyspark.sql import functions as F

M = "main"


def languages(spark, **sizes):
    return items(spark, [(f"{lang}{i:03}", lang) for lang, n in sizes.items() for i in range(n)])


def counts(df):
    return {r.lang_code: r["count"] for r in df.groupBy("lang_code").count().collect()}


def key(*parts):
    return hashlib.md5("|".join(parts).encode()).hexdigest()


def test_published_quotas(spark):
    table = languages(spark, de=41, fr=35, ru=23)
    assert counts(sampling.stratified_sample(table, 45)) == {"de": 19, "fr": 16, "ru": 10}
    assert rows(sampling.distribution(table, "lang_code")) == [("de", 41), ("fr", 35), ("ru", 23)]


def test_draw_is_the_smallest_keys(spark):
    table = languages(spark, de=41, fr=35, ru=23)
    expected = []
    for lang, n, quota in [("de", 41, 19), ("fr", 35, 16), ("ru", 23, 10)]:
        ids = [f"{lang}{i:03}" for i in range(n)]
        expected += sorted(ids, key=lambda i: key("42", lang, i))[:quota]  # noqa: B023
    for data in (table, table.repartition(6)):
        assert [r[0] for r in rows(sampling.stratified_sample(data, 45), "sample_id")] == sorted(expected)


@pytest.mark.parametrize("limit", [0, 10**6])
def test_draws_do_not_depend_on_the_join(spark, monkeypatch, limit):
    """The same rows whether the small side is broadcast or not."""
    monkeypatch.setattr(sampling, "BROADCAST_ROWS", limit)
    table = languages(spark, de=300, fr=20)
    ids = [f"de{i:03}" for i in range(300)] + [f"fr{i:03}" for i in range(20)]
    expected = sorted(sorted(ids, key=lambda i: key("7", i))[:150])
    assert [r[0] for r in rows(sampling.simple_sample(table, 150, seed=7), "sample_id")] == expected
    assert sampling.stratified_exact(table, 60, seed=7).count() == 60


def test_exact_size_by_trim_and_top_up(spark):
    lopsided = languages(spark, de=1, fr=98)
    assert counts(sampling.stratified_sample(lopsided, 2)) == {"de": 1, "fr": 2}
    assert sampling.stratified_exact(lopsided, 2).count() == 2
    thirds = languages(spark, de=10, fr=10, ru=10)
    assert sampling.stratified_sample(thirds, 10).count() == 9
    topped = sampling.stratified_exact(thirds, 10)
    assert topped.count() == 10
    drawn = {r[0] for r in rows(sampling.stratified_sample(thirds, 10), "sample_id")}
    assert drawn < {r[0] for r in rows(topped, "sample_id")}


def test_half_goes_to_even(spark):
    halves = languages(spark, de=5, fr=15)
    assert counts(sampling.stratified_sample(halves, 10)) == {"de": 2, "fr": 8}


def test_null_language_only_tops_up(spark):
    table = items(spark, [(f"d{i}", "de") for i in range(4)] + [(f"n{i}", None) for i in range(4)])
    assert counts(sampling.stratified_sample(table, 8)) == {"de": 4}
    assert sampling.stratified_exact(table, 8).count() == 8


def test_too_large_a_sample_is_an_error(spark):
    table = languages(spark, de=3)
    for sample in (sampling.simple_sample, sampling.stratified_sample, sampling.stratified_exact):
        assert sample(table, 3).count() == 3
        with pytest.raises(Exception, match="asked for 4 rows of 3"):
            sample(table, 4).collect()
        with pytest.raises(Exception, match="asked for 4 rows of 0"):
            sample(table.limit(0), 4).collect()


def verdicts(spark):
    """Ten items, one judge: i0-i3 wrong, i2-i5 unstable, i9 not swap-tested."""
    main = [(f"i{i}", "de", "j", M, False, "A", "B" if i < 4 else "A") for i in range(10)]
    opposite = {"A": "B", "B": "A"}
    swapped = []
    for sid, lang, judge, prompt, _, _, winner in main[:9]:
        unstable = sid in ("i2", "i3", "i4", "i5")
        swapped.append((sid, lang, judge, prompt, True, "B", winner if unstable else opposite[winner]))
    return judged(spark, main), judged(spark, swapped)


def test_cases(spark):
    main, swapped = verdicts(spark)
    assert [r[1] for r in rows(subsets.incorrect_items(main))] == ["i0", "i1", "i2", "i3"]
    assert [r[0] for r in rows(subsets.incorrect_any_judge(main, ["j"]))] == ["i0", "i1", "i2", "i3"]
    assert [r[1] for r in rows(subsets.unstable_items(main, swapped))] == ["i2", "i3", "i4", "i5"]
    table = items(spark, [(f"i{i}", "de") for i in range(11)])
    pool = [r[1] for r in rows(subsets.control_pool(table, main, swapped, ["j"]))]
    assert pool == ["i10", "i6", "i7", "i8", "i9"]
    tested = [r[1] for r in rows(subsets.control_pool(table, main, swapped, ["j"], require_tested=True))]
    assert tested == ["i6", "i7", "i8"]


def test_priority_without_refill(spark):
    main, swapped = verdicts(spark)
    table = items(spark, [(f"i{i}", "de") for i in range(11)])
    quotas = {"incorrect": 4, "unstable": 4, "control": 2}
    picked = subsets.comment_subset_judge(table, main, swapped, ["j", "silent"], quotas)
    of_judge = {r.sample_id: r.comment_case_type for r in picked.filter("comment_target_model = 'j'").collect()}
    labels = sorted(of_judge.values())
    assert labels == ["control"] * 2 + ["incorrect"] * 4 + ["unstable"] * 2
    assert {i for i, c in of_judge.items() if c == "unstable"} == {"i4", "i5"}
    silent = picked.filter("comment_target_model = 'silent'")
    assert rows(silent, "comment_case_type") == [("control",)] * 2


def test_items_outside_the_table_are_not_returned(spark):
    main, swapped = verdicts(spark)
    table = items(spark, [("i0", "de"), ("i6", "de")])
    picked = subsets.comment_subset_judge(table, main, swapped, ["j"])
    assert rows(picked, "sample_id", "comment_case_type") == [("i0", "incorrect"), ("i6", "control")]


def test_shared_subset(spark):
    main, swapped = verdicts(spark)
    other = main.withColumn("model", F.lit("k"))
    flipped = F.when(F.col("sample_id") == "i7", "B").otherwise(F.col("parsed_winner"))
    other = other.withColumn("parsed_winner", flipped).withColumn(
        "is_correct", F.when(F.col("sample_id") == "i7", None).otherwise(F.col("is_correct"))
    )
    table = items(spark, [(f"i{i}", "de") for i in range(11)])
    both = main.unionByName(other)
    picked = subsets.comment_subset_shared(table, both, swapped, "j", "k")
    labels = {r.sample_id: r.comment_case_type for r in picked.collect()}
    assert {i for i, c in labels.items() if c == "incorrect"} == {"i0", "i1", "i2", "i3"}
    assert {i for i, c in labels.items() if c == "unstable"} == {"i4", "i5"}
    assert {i for i, c in labels.items() if c == "disagreement"} == {"i7"}
    assert {i for i, c in labels.items() if c == "control"} == {"i10", "i6", "i8", "i9"}
    fewer = subsets.comment_subset_shared(table, both, swapped, "j", "k", {**subsets.SHARED_QUOTAS, "control": 1})
    assert sum(r.comment_case_type == "control" for r in fewer.collect()) == 1


def scans(df):
    """Reads of the table in the first plan, before exchanges are reused."""
    return df._jdf.queryExecution().executedPlan().toString().split("== Final Plan ==")[0].count("FileScan")


def test_samples_and_subsets_read_their_tables_a_few_times(spark, tmp_path):
    main, swapped = verdicts(spark)
    table = items(spark, [(f"i{i}", "de") for i in range(11)])
    stored = []
    for name, df in {"items": table, "main": main, "swapped": swapped}.items():
        df.write.parquet(str(tmp_path / name))
        stored.append(spark.read.parquet(str(tmp_path / name)))
    assert scans(sampling.stratified_exact(stored[0], 4)) <= 4
    assert scans(sampling.stratified_sample(stored[0], 4)) <= 3
    assert scans(subsets.control_pool(*stored, ["j"])) == 3
    assert scans(subsets.comment_subset_judge(*stored, ["j", "k"])) == 4
    assert rows(subsets.comment_subset_judge(*stored, ["j"])) == rows(subsets.comment_subset_judge(table, main, swapped, ["j"]))


def test_large_samples_equal_small_ones(spark, monkeypatch):
    """Draws beyond the bounded size count prefixes, one digit or several, and give the same rows."""
    table = languages(spark, de=300, fr=200, ru=1)
    small = [rows(f(table, 200), "sample_id") for f in (sampling.simple_sample, sampling.stratified_sample, sampling.stratified_exact)]
    monkeypatch.setattr(sampling, "BROADCAST_ROWS", 0)
    for prefix_rows in (100_000, 3):
        monkeypatch.setattr(sampling, "PREFIX_ROWS", prefix_rows)
        large = [rows(f(table, 200), "sample_id") for f in (sampling.simple_sample, sampling.stratified_sample, sampling.stratified_exact)]
        assert large == small


def test_bitmaps_hold_more_judges_than_bits(spark):
    main, swapped = verdicts(spark)
    judges = [f"judge {i} it's" for i in range(70)] + ["j"]
    last = main.withColumn("model", F.lit(judges[69])), swapped.withColumn("model", F.lit(judges[69]))
    table = items(spark, [(f"i{i}", "de") for i in range(11)])
    pool = subsets.control_pool(table, main.unionByName(last[0]), swapped.unionByName(last[1]), judges)
    of = {}
    for model, item in rows(pool, "model", "sample_id"):
        of.setdefault(model, []).append(item)
    assert of["j"] == of[judges[69]] == ["i10", "i6", "i7", "i8", "i9"] and len(of[judges[5]]) == 11 and len(of) == 71
    flags = subsets.case_flags(main, swapped)
    bits = subsets._per_judge(subsets.case_bits(main, swapped, judges), judges, "sample_id").filter("model = 'j'")
    assert rows(bits, "sample_id", "incorrect", "unstable", "tested") == rows(flags, "sample_id", "incorrect", "unstable", "tested")
    with pytest.raises(ValueError, match="no judges"):
        subsets.control_pool(table, main, swapped, [])


def test_silent_judges_are_named(spark):
    main, swapped = verdicts(spark)
    assert rows(subsets.silent_judges(["j", "k", "l"], main, swapped)) == [("k", 0), ("l", 0)]
