"""Reply parsing against hand cases and against a plain Python reading of the rules."""

import json
import re

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from pairwright.functions.parsing import parse_winner, parse_winner_comment, score

# raw, winner, method, winner by the comment parser
CASES = [
    ('{"winner":"A"}', "A", "json", "A"),
    (' \n{"winner" : "B"}\t', "B", "json", "B"),
    ('{"winner":"A"} trailing B', "A", "key_regex", "A"),
    ('```json\n{"winner":"B"}\n```', "B", "key_regex", "B"),
    ('{"winner":"C"} then B', "B", "bare_letter", None),
    ('{"winner":"A","winner":"B"}', "B", "json", "B"),
    ('{"winner":"\\u0041"}', "A", "json", "A"),
    ('{"winner":"\\u0041"} x', None, "none", None),
    ('{"winner":"\\u0041"}] {}', None, "none", None),
    ('{"winner":"\\u0041"}} {}', None, "none", None),
    ('{"winner":"\\u0041"} {"x":1}', None, "none", None),
    ('["A"]', "A", "bare_letter", None),
    ('{"winner":["A"]}', "A", "bare_letter", None),
    ('{"r":{"winner":"B"}}', "B", "key_regex", "B"),
    ("Translation A is", "A", "bare_letter", None),
    ("Ab AB xA", None, "none", None),
    ("éA B", "B", "bare_letter", None),
    ("Á B", "A", "bare_letter", None),
    ("{'winner':'A'}", "A", "bare_letter", None),
    ('"winner" : "B"', "B", "key_regex", "B"),
    ("", None, "none", None),
    (None, None, "none", None),
    ("   ", None, "none", None),
    ("null", None, "none", None),
    ("7", None, "none", None),
    ('{"winner":"B","comment":"cut off', "B", "key_regex", "B"),
]

COMMENT_CASES = [
    ('{"winner":"A","comment":"so \\"fine\\""}', 'so "fine"'),
    ('{"winner":"A","comment":null}', None),
    ('{"winner":"A","comment":""}', ""),
    ('{"winner":"B","comment":"cut off', None),
    ('x {"winner":"B","comment":" two\nlines "}', "two\nlines"),
    ('x {"winner":"B","comment":" a\\"b "}', 'a\\"b'),
    ('{"comment":"no verdict"}', "no verdict"),
    ("plain", None),
    (None, None),
]


def parse(spark, texts):
    frame = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, raw_response string")
    rows = parse_winner(frame).orderBy("i").collect()
    return [(r.parsed_winner, r.parse_method) for r in rows]


def test_winner_cases(spark):
    found = parse(spark, [c[0] for c in CASES])
    assert found == [(c[1], c[2]) for c in CASES]


def test_comment_parser_cases(spark):
    frame = spark.createDataFrame([(i, c[0]) for i, c in enumerate(CASES)], "i int, raw_response string")
    rows = parse_winner_comment(frame).orderBy("i").collect()
    assert [r.parsed_winner for r in rows] == [c[3] for c in CASES]
    frame = spark.createDataFrame([(i, c[0]) for i, c in enumerate(COMMENT_CASES)], "i int, raw_response string")
    rows = parse_winner_comment(frame).orderBy("i").collect()
    assert [r.comment for r in rows] == [c[1] for c in COMMENT_CASES]


def test_strict_leaves_prose_unread(spark):
    frame = spark.createDataFrame([("Translation A is",), ('{"winner":"B"}',)], "raw_response string")
    assert [r.parsed_winner for r in parse_winner(frame, strict=True).collect()] == [None, "B"]


def test_whole_reply_counts(spark):
    """A verdict after a long text is found; nothing is cut off."""
    assert parse(spark, ["x " * 200_000 + '{"winner":"B"}']) == [("B", "key_regex")]


def expected_winner(raw):
    """The rules once more, in Python."""
    if not raw:
        return None
    try:
        value = json.loads(raw)
        if isinstance(value, dict) and isinstance(value.get("winner"), str) and value["winner"] in ("A", "B"):
            return value["winner"]
    except ValueError:
        pass
    for pattern in (r'"winner"\s*:\s*"([AB])"', r"\b([AB])\b"):
        found = re.search(pattern, raw)
        if found:
            return found.group(1)
    return None


pieces = st.lists(
    st.sampled_from(
        ['{', '}', '"winner"', ':', '"A"', '"B"', '"C"', ',', '"comment"', ' ', '\n', 'A', 'B', 'é', 'x',
         '},"reply":{', ',"z":1', '"__reply_end__"', '[', ']', '1', '_', '"', '\\', '\\u0041', '"reply":', '},"reply":{', '"__reply_end__"', ',"z":1', ' ', 'null', '{"winner":"A"}', '{"winner":"B"']
    ),
    max_size=12,
).map("".join)


@settings(max_examples=3, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(pieces, min_size=400, max_size=400))
def test_winner_agrees_with_python(spark, texts):
    found = [winner for winner, _ in parse(spark, texts)]
    assert found == [expected_winner(t) for t in texts]


def test_score_is_three_valued(spark):
    frame = spark.createDataFrame(
        [("A", "A"), ("A", "B"), (None, "A"), ("C", "A"), ("B", None)], "parsed_winner string, gold_winner string"
    )
    rows = score(frame).collect()
    assert [r.parse_success for r in rows] == [True, True, False, False, True]
    assert [r.is_correct for r in rows] == [True, False, None, None, False]


def test_reply_is_parsed_once(spark):
    """A filter on the verdict must not repeat the parsing below it."""
    frame = spark.createDataFrame([("x",)], "raw_response string")
    filtered = parse_winner(frame).filter("parsed_winner = 'A'")
    plan = filtered._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("from_json") == 1


@pytest.mark.parametrize("raw", ['{"winner":"A","x":NaN}', '{"winner":"A","x":{"y":[1,2,{"z":"}"}]}}'])
def test_json_with_more_in_it(spark, raw):
    assert parse(spark, [raw]) == [("A", "json")]


@pytest.mark.parametrize(
    "raw,winner,method",
    [
        ('{"winner":"A"},"reply":{"winner":"B"}', "A", "key_regex"),
        ('{"winner":"\\u0041"},"z":1', None, "none"),
        ('{"winner":"\\u0041","c":"__reply_end__"}', "A", "json"),
        ('{"winner":"\\u0041"}', "A", "json"),
        ('{"winner":"AB"}', None, "none"),
    ],
)
def test_only_whole_replies_are_json(spark, raw, winner, method):
    assert parse(spark, [raw]) == [(winner, method)]


def test_a_reply_is_searched_for_its_comment_once(spark):
    """A generator would evaluate the pattern for the test and again for the value."""
    frame = spark.createDataFrame([('x "comment": " why " }',), ('"comment": "cut',), (None,)], "raw_response string")
    parsed = parse_winner_comment(frame)
    assert [r.comment for r in parsed.collect()] == ["why", None, None]
    assert parsed._jdf.queryExecution().optimizedPlan().toString().count('"comment"[') == 1
