"""Items, requests, running a judge, resuming."""

import pytest
from helpers import items, judged, rows
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from pairwright import schemas
from pairwright.operators import items as ops
from pairwright.operators import judging
from pyspark.sql import functions as F

ROSTER = [("org/one", "primary"), ("org/two", "unknown")]


def human(spark, choices):
    data = [(f"s{i}", "de", "src", "t1", "t2", c) for i, c in enumerate(choices)]
    return spark.createDataFrame(data, "sample_id string, lang_code string, source string, text1 string, text2 string, choice string")


def test_gold_is_b_unless_text1(spark):
    built = ops.build_items(human(spark, ["text1", "text2", "Text1", None]))
    assert built.columns == schemas.ITEMS.fieldNames()
    assert [r.gold_winner for r in built.orderBy("sample_id").collect()] == ["A", "B", "B", "B"]
    assert rows(built, "issues", "comment") == [(None, None)] * 4


def test_item_comment_comes_from_the_misspelt_column_only(spark):
    people = human(spark, ["text1"]).withColumn("comment", F.lit("x"))
    assert ops.build_items(people).first().comment is None
    assert ops.build_items(people.withColumn("commet", F.lit("y"))).first().comment == "y"


def test_missing_columns_are_named(spark):
    with pytest.raises(ValueError, match=r"\['choice', 'text2'\]"):
        ops.build_items(human(spark, ["text1"]).drop("choice", "text2"))


@settings(max_examples=5, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.sampled_from(["text1", "text2"]), min_size=1, max_size=5))
def test_swapping_twice_changes_nothing(spark, choices):
    built = ops.build_items(human(spark, choices))
    assert rows(ops.swap_items(ops.swap_items(built))) == rows(built)
    swapped = ops.swap_items(built).first()
    assert (swapped.translation_a, swapped.translation_b) == ("t2", "t1")


def test_dedupe_keeps_the_first_and_stays_small_for_a_hot_key(spark):
    table = spark.range(50_000).select(
        F.when(F.col("id") % 3 == 0, "hot").otherwise(F.col("id").cast("string")).alias("k"),
        (50_000 - F.col("id")).alias("row_ordinal"),
    )
    first = ops.dedupe_first(table.repartition(8), ["k"])
    assert first.filter("k = 'hot'").first().row_ordinal == 50_000 - 49_998
    assert first.count() == table.select("k").distinct().count()
    plan = first._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2  # cut once before the shuffle, once after


def test_conflicts(spark):
    table = human(spark, ["text1", "text2", None, "text1"]).withColumn(
        "gold", F.element_at(F.array(F.lit("text1"), F.lit("text1"), F.lit("text1"), F.lit(None)),
                             F.substring("sample_id", 2, 1).cast("int") + 1)
    )
    assert [r[0] for r in rows(ops.flag_conflicts(table), "sample_id")] == ["s1", "s2", "s3"]


CONFIG = {"first": [{"name": "a", "tier": "primary"}, {"name": "b"}], "second": [{"name": "c", "tier": "x"}]}


def test_roster(spark):
    expected = [("a", "primary"), ("b", "unknown"), ("c", "x")]
    assert ops.judge_list(CONFIG) == expected
    assert rows(ops.judges(spark, CONFIG), "model", "tier") == expected
    assert rows(ops.judges(spark, CONFIG), "judge_group") == [("first",), ("first",), ("second",)]


def test_request_text(spark):
    table = items(spark, [("i", "de")])
    request = ops.judge_requests(table, ROSTER, "main", "sys", swap=True).filter("model = 'org/two'").first()
    assert request.user_message == (
        "Source passage:\nsrc i\n\nTranslation A:\nb i\n\nTranslation B:\na i\n\n"
        "Which translation is better overall?"
    )
    assert (request.gold_winner, request.swap_order, request.tier, request.system_prompt) == ("B", True, "unknown", "sys")


def test_requests_need_no_join(spark):
    plan = ops.judge_requests(items(spark, [("i", "de")]), ROSTER, "main", "sys")
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in text and "Exchange" not in text
    assert rows(ops.requests_per_judge(items(spark, [("i", "de"), ("j", "de")]), ROSTER)) == [
        ("org/one", "primary", 2), ("org/two", "unknown", 2),
    ]


def judge_maker():
    """Nested functions travel to the workers by value."""

    def make_judge():
        def judge(model, prompt, message):
            if "src bad" in message:
                raise TimeoutError("no answer")
            if "src null" in message:
                return None
            return '{"winner":"A","comment":"fine"}' if model == "org/one" else "I prefer B"

        return judge

    return make_judge


def test_judging_goes_on_after_failures(spark):
    table = items(spark, [("good", "de"), ("bad", "de"), ("null", "fr")])
    requests = ops.judge_requests(table, ROSTER, "main", "sys")
    replies = judging.collect_replies(requests, judge_maker(), parallelism=3, pause=0.001)
    found = judging.judgments_from_replies(replies)
    assert found.schema.fieldNames() == schemas.JUDGMENTS.fieldNames()
    assert rows(found, "sample_id", "model", "parsed_winner", "parse_success", "is_correct", "error") == [
        ("bad", "org/one", None, False, None, "no answer"),
        ("bad", "org/two", None, False, None, "no answer"),
        ("good", "org/one", "A", True, True, None),
        ("good", "org/two", "B", True, False, None),
        ("null", "org/one", None, False, None, None),
        ("null", "org/two", None, False, None, None),
    ]


def test_comment_run_keeps_the_case(spark):
    table = items(spark, [("good", "de")]).withColumn("comment_case_type", F.lit("control"))
    replies = judging.collect_replies(ops.judge_requests(table, ROSTER, "comment", "sys"), judge_maker())
    found = judging.comments_from_replies(replies)
    assert found.columns == schemas.COMMENTS.fieldNames()
    assert rows(found, "model", "comment_case_type", "parsed_winner", "comment") == [
        ("org/one", "control", "A", "fine"), ("org/two", "control", None, None),
    ]


def test_only_open_requests_are_sent_again(spark):
    table = items(spark, [("i1", "de"), ("i2", "de")])
    done = judged(spark, [
        ("i1", "de", "org/one", "main", False, "A", "A"), ("i1", "de", "org/one", "main", False, "A", None),
        ("i1", "de", "org/two", "main", False, "A", None), ("i2", "de", "org/one", "main", True, "A", "A"),
        ("i2", "de", "org/two", "minimal", False, "A", "A"), ("i2", "de", "other", "main", False, "A", "A"),
    ])
    pending = judging.pending_requests(table, ROSTER, "main", "sys", done)
    assert rows(pending, "sample_id", "model") == [("i1", "org/two"), ("i2", "org/one"), ("i2", "org/two")]
    assert pending.columns == ops.judge_requests(table, ROSTER, "main", "sys").columns
    swapped = judging.pending_requests(table, ROSTER, "main", "sys", done, swap=True)
    assert rows(swapped, "sample_id", "model") == [("i1", "org/one"), ("i1", "org/two"), ("i2", "org/two")]


def test_replies_are_handed_on_before_later_calls_begin():
    """What has been yielded is out of reach of a later call, even one that ends the task."""
    import pandas as pd

    made = []

    def make_judge():
        def judge(model, prompt, message):
            made.append(message)
            if message == "40":
                raise SystemExit("the worker is lost")
            return message

        return judge

    batch = pd.DataFrame({"model": "m", "system_prompt": "s", "user_message": [str(i) for i in range(60)]})
    found = judging.answering(make_judge, ["user_message"], concurrency=4, rows=16)(iter([batch]))
    first, second = next(found), next(found)
    assert list(first.raw_response) + list(second.raw_response) == [str(i) for i in range(32)]
    assert len(made) == 32
    with pytest.raises(SystemExit):
        next(found)


def test_threads_share_one_pace():
    import time

    import pandas as pd

    begun = []

    def make_judge():
        def judge(model, prompt, message):
            begun.append(time.monotonic())
            time.sleep(0.05)
            if message == "3":
                raise RuntimeError("429")
            return message

        return judge

    batch = pd.DataFrame({"model": "m", "system_prompt": "s", "user_message": [str(i) for i in range(12)]})
    start = time.monotonic()
    (found,) = judging.answering(make_judge, ["user_message"], concurrency=6, pause=0.02)(iter([batch]))
    took = time.monotonic() - start
    assert found.raw_response.tolist() == [None if i == 3 else str(i) for i in range(12)]
    assert found.error.tolist() == ["429" if i == 3 else None for i in range(12)]
    # One at a time the calls alone would take 0.6 s; begun together they would take 0.1 s.
    assert 0.22 < took < 0.6 and min(b - a for a, b in zip(sorted(begun), sorted(begun)[1:])) > 0.01


def test_a_null_tier_is_unknown_in_both_forms(spark):
    config = {"g": [{"name": "a", "tier": None}, {"name": "b"}, {"name": "c", "tier": "x"}]}
    assert ops.judge_list(config) == [("a", "unknown"), ("b", "unknown"), ("c", "x")]
    assert rows(ops.judges(spark, config), "model", "tier") == ops.judge_list(config)
