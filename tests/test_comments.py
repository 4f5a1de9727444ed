"""The wide comment table and the dimension counts."""

from contextlib import contextmanager

import pytest
from helpers import items, rows

from pairwright.operators import comments as ops
from pairwright.plans import catalog
from pyspark.sql import functions as F

ONE, TWO = "x-ai/grok-4.20-beta", "Org/My-Model.1"


def table(spark, data):
    numbered = [(*row, i) for i, row in enumerate(data)]
    return spark.createDataFrame(
        numbered,
        "sample_id string, model string, comment_case_type string, parsed_winner string, comment string,"
        " is_correct boolean, lang_code string, parse_success boolean, row_ordinal long",
    )


@contextmanager
def conf(spark, **values):
    """Settings of the session for a while."""
    before = {key: spark.conf.get(key) for key in values}
    for key, value in values.items():
        spark.conf.set(key, value)
    try:
        yield
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)


def people(spark, data, comment="commet"):
    return spark.createDataFrame(
        data, f"sample_id string, lang_code string, {comment} string, issues string, choice string"
    )


def test_merge(spark):
    judged = table(spark, [
        ("i1", ONE, "incorrect", "A", None, True, "de", True),
        ("i1", ONE, "control", "B", "second row is ignored", True, "de", True),
        ("i1", TWO, "control", "B", "why", False, "de", True),
        ("i2", ONE, "control", "A", None, True, "de", True),
    ])
    human = people(spark, [("i1", "de", "nice", "tone", "text1"), ("i1", "de", "again", None, "text2")])
    base = items(spark, [("i1", None), ("i2", "de"), ("i3", "de")])
    for data in (judged, judged.repartition(4)):
        merged = ops.merge_comments(base, human, data, [ONE, TWO])
        assert merged.columns == [
            "sample_id", "lang_code", "source", "translation_a", "translation_b", "gold_winner",
            "human_comment", "human_issues",
            "grok_comment_case_type", "grok_winner", "grok_comment", "grok_is_correct",
            "grok_parse_success", "grok_model",
            "choice",
            "grok_lang_code",
            "org_my_model_1_comment_case_type", "org_my_model_1_winner", "org_my_model_1_comment",
            "org_my_model_1_is_correct", "org_my_model_1_model", "org_my_model_1_lang_code",
            "org_my_model_1_parse_success",
        ]
        assert rows(
            merged, "sample_id", "lang_code", "human_comment", "grok_comment", "grok_winner",
            "org_my_model_1_comment",
        ) == [("i1", "de", "again", None, "A", "why"), ("i1", "de", "nice", None, "A", "why")]


@pytest.mark.parametrize("rows_per_copy", [1, 10, 100_000])
def test_hot_item_keeps_all_rows(spark, rows_per_copy):
    """Copied or not: every human row once, items without one stay, few rows leave copies empty."""
    judged = table(spark, [(i, ONE, "control", "A", f"why {i}", True, "de", True) for i in ("i1", "i2", "i2", "i3")])
    many = spark.range(3000).select(F.lit("i1").alias("sample_id"), F.col("id").cast("string").alias("commet"))
    few = spark.range(12).select(F.lit("i3").alias("sample_id"), F.lit("same").alias("commet"))
    human = many.unionByName(few).withColumn("lang_code", F.lit("fr"))
    base = items(spark, [("i1", "de"), ("i2", None), ("i3", None)])
    merged = ops.merge_comments(base, human, judged, [ONE], rows_per_copy=rows_per_copy)
    first = merged.filter("sample_id = 'i1'")
    assert first.count() == 3000 and first.select("human_comment").distinct().count() == 3000
    assert rows(merged.filter("sample_id = 'i2'"), "human_comment", "lang_code", "grok_comment") == [
        (None, None, "why i2")
    ]
    assert rows(merged.filter("sample_id = 'i3'"), "human_comment", "lang_code", "grok_comment") == [
        ("same", "fr", "why i3")
    ] * 12
    nobody = ops.merge_comments(base, human, judged, [], rows_per_copy=rows_per_copy)
    assert nobody.count() == 3013


def test_human_rows_are_dealt_before_they_are_shuffled(spark, monkeypatch):
    """The bounded list of hot items goes to the rows, so no task gets all human rows of an item; unlisted items stay whole."""
    judged = table(spark, [(i, ONE, "control", "A", "why", True, "de", True) for i in ("i1", "i2", "i3")])
    human = spark.range(90).selectExpr("if(id < 60, 'i1', 'i2') AS sample_id", "concat('c', id) AS commet")
    base = items(spark, [("i1", "de"), ("i2", "de"), ("i3", "de")])
    for listed in (1, 100_000):
        monkeypatch.setattr(ops, "MOST_COPIED", listed)
        assert rows(ops.merge_comments(base, human, judged, [ONE], rows_per_copy=4), "sample_id", "human_comment") == sorted(
            [("i1" if i < 60 else "i2", f"c{i}") for i in range(90)] + [("i3", None)], key=repr
        )
    with conf(spark, **{"spark.sql.adaptive.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1"}):
        merged = ops.merge_comments(base, human, judged, [ONE], rows_per_copy=4).select("sample_id", "human_comment")
        plan = merged._jdf.queryExecution().executedPlan().toString()
    # The joins with the list, of the human rows and of the items.
    assert plan.count("BroadcastHashJoin") >= 2


@pytest.mark.parametrize("hot", [0, 60])
def test_wide_rows_are_shuffled_once(spark, hot):
    """By item only; hot items add a shuffle of their copies and of their human rows."""
    judged = table(spark, [(i, ONE, "control", "A", "why", True, "de", True) for i in ("i1", "i2", "i3")])
    human = spark.range(90).selectExpr(f"if(id < {hot}, 'i1', 'x' || id) AS sample_id", "'c' || id AS commet")
    human = human.unionByName(spark.createDataFrame([("i2", "d")], human.schema))
    base = items(spark, [("i1", "de"), ("i2", "de"), ("i3", "de")])
    with conf(spark, **{"spark.sql.autoBroadcastJoinThreshold": "-1"}):
        merged = ops.merge_comments(base, human, judged, [ONE], rows_per_copy=4).select(
            "sample_id", "human_comment", "translation_a", "grok_comment"
        )
        found = sorted(merged.collect(), key=repr)
        plan = merged._jdf.queryExecution().executedPlan().toString().partition("Initial Plan")[0]
    said = {"i1": [f"c{i}" for i in range(hot)] or [None], "i2": ["d"], "i3": [None]}
    assert found == sorted([(i, c, f"a {i}", "why") for i, cs in said.items() for c in cs], key=repr)
    again = [x for x in plan.splitlines() if " Exchange hashpartitioning(sample_id" in x and "_copy" in x]
    assert len(again) == (2 if hot else 0)


def test_the_query_shuffles_documents_once(spark, tmp_path):
    """Items, human rows and comments are dealt by item before the texts are multiplied."""
    docs = spark.range(40).selectExpr("id AS doc_id", "concat('a text, no ', id) AS text", "'de' AS lang", "'web' AS source", "12L AS n_chars")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    with conf(spark, **{"spark.sql.autoBroadcastJoinThreshold": "-1"}):
        merged = catalog.queries()["merge_comments"](spark, str(tmp_path))
        assert 0 < len(merged.collect()) <= 40
        plan = merged._jdf.queryExecution().executedPlan().toString().partition("Initial Plan")[0]
    assert " Exchange hashpartitioning(sample_id" not in plan and "REPARTITION_BY_COL" in plan


def test_comments_of_unlisted_judges_are_an_error(spark):
    human = people(spark, [("i1", "de", "nice", None, "text1")])
    base = items(spark, [("i1", "de")])
    for stranger, name in (("someone/else", "someone/else"), (None, "null")):
        judged = table(spark, [("i1", ONE, "control", "A", "why", True, "de", True), ("i9", stranger, "control", "A", "x", True, "de", True)])
        with pytest.raises(Exception, match=f"unlisted judge: {name}"):
            ops.merge_comments(base, human, judged, [ONE]).collect()


def test_rows_of_a_hot_item_are_dealt_by_their_own_columns(spark):
    """However the human table is cut, the same rows go to the same copies: a task that runs again loses none."""
    human = spark.range(900).selectExpr("'i1' AS sample_id", "concat('c', id % 300) AS commet", "id AS row_ordinal")
    judged = table(spark, [("i1", ONE, "control", "A", "why", True, "de", True)])
    base = items(spark, [("i1", "de")])
    merged = [ops.merge_comments(base, h, judged, [ONE], rows_per_copy=40) for h in (human.coalesce(1), human.repartition(7))]
    assert rows(merged[0]) == rows(merged[1]) and merged[0].count() == 900
    assert merged[0].select("human_comment").distinct().count() == 300
    # Copies are in proportion to the rows, and hold about as many each.
    plan = merged[1].select("sample_id")
    assert plan.count() == 900


def test_human_comment_is_the_first_column_present(spark):
    human = people(spark, [("i1", "de", None, None, "text1")]).withColumn("comment", F.lit("other"))
    assert ops.human_columns(human).first().human_comment is None
    plain = people(spark, [("i1", "de", "c", None, "text1")], comment="comment")
    assert ops.human_columns(plain).first().human_comment == "c"
    assert ops.human_columns(plain.select("sample_id")).columns == ["sample_id"]


def test_judges_with_one_prefix_are_refused(spark):
    with pytest.raises(ValueError, match="share a column prefix"):
        ops.slugs(["openai/gpt-5.4", "openai/gpt-5.4-pro"])


def test_without_judges_all_items_stay(spark):
    human = people(spark, [("i1", "de", "nice", None, "text1")])
    merged = ops.merge_comments(items(spark, [("i1", "de"), ("i2", "fr")]), human, table(spark, []), [])
    assert rows(merged, "sample_id", "human_comment") == [("i1", "nice"), ("i2", None)]


def lexicon(spark, **terms):
    return spark.createDataFrame([(d, t) for d, ts in terms.items() for t in ts], "dimension string, term string")


def test_phrases_of_a_lexicon(spark):
    said = [
        ("h", "1", "Word for\n  WORD."), ("h", "2", "word, for -- word"), ("h", "3", "sword for word"), ("h", "4", "word forword"),
        ("h", "5", "a word for words"), ("h", "6", "über alles und Über-Alles"), ("h", "7", "x+y (a.b)"), ("h", "8", ""), ("h", "8", "forêt"),
    ]
    table = spark.createDataFrame(said, "source string, sample_id string, comment string")
    counts = ops.dimension_counts(table, lexicon(spark, literal=["Word  for word", "word for word"], high=["über ALLES"], tree=["for"]))
    assert rows(counts) == [("h", "high", 1), ("h", "literal", 2), ("h", "tree", 4)]
    for bad in ("", None, "12 ."):
        with pytest.raises(ValueError, match="without a letter"):
            ops.dimension_counts(table, lexicon(spark, d=[bad]))


def test_terms_apart_or_together(spark, monkeypatch):
    """Few terms are looked for one by one, only in texts that hold them; many in one pattern. Both find the same."""
    words = ["for", "forêt", "La Forêt", "before", "in", "in the", "in, the", "inthe", "the in", "", None, "FOR", "x for", "é for é", "pas-pas"]
    table = spark.createDataFrame([("h", str(i), w) for i, w in enumerate(words)], "source string, sample_id string, comment string")
    terms = lexicon(spark, a=["for", "pas"], b=["in the", "zu"], c=["la forêt", "before"])
    counts = []
    for most in (0, 200):
        monkeypatch.setattr(ops, "TERMS_APART", most)
        counted = ops.dimension_counts(table, terms)
        counts.append(rows(counted))
        plan = counted._jdf.queryExecution().optimizedPlan().toString()
        assert ("Contains(" in plan) == (most > 0) and plan.count("lower(") == 1
    assert counts[0] == counts[1] == [("h", "a", 5), ("h", "b", 2), ("h", "c", 2)]


def test_dimensions(spark):
    said = spark.createDataFrame(
        [
            ("human", "1", "The STYLE flows, style!"), ("human", "1", "flows"), ("human", "2", "lifestyle"),
            ("human", "3", None), ("judge", "1", "Word-for-word; style."), ("judge", "2", "nothing here"),
            ("silent", "1", "none"),
        ],
        "source string, sample_id string, comment string",
    )
    counts = ops.dimension_counts(said, lexicon(spark, style=["style"], fluency=["flows", "flowing"], literal=["word"]))
    assert rows(counts) == [
        ("human", "fluency", 1), ("human", "literal", 0), ("human", "style", 1),
        ("judge", "fluency", 0), ("judge", "literal", 1), ("judge", "style", 1),
        ("silent", "fluency", 0), ("silent", "literal", 0), ("silent", "style", 0),
    ]
    shares = {(r.source, r.dimension): r.share for r in ops.dimension_share(counts).collect()}
    assert shares["human", "style"] == 0.5 and shares["silent", "style"] is None
    axis = ops.dimension_axis(ops.dimension_share(counts)).orderBy("level").collect()
    assert [round(r.tick, 4) for r in axis] == [0.101, 0.202, 0.303, 0.404, 0.505]


def test_published_shares(spark):
    """Shares of one published row of counts, and the bound over two of them."""
    human = [13, 11, 7, 13, 9, 18, 11, 5]
    fewer = [3, 8, 3, 3, 2, 4, 5, 0]
    data = [("human", str(i), c) for i, c in enumerate(human)] + [("judge", str(i), c) for i, c in enumerate(fewer)]
    counts = spark.createDataFrame(data, "source string, dimension string, cnt long")
    shares = ops.dimension_share(counts)
    sums = {r.source: r.s for r in shares.groupBy("source").agg(F.sum("share").alias("s")).collect()}
    assert sums == {"human": pytest.approx(1), "judge": pytest.approx(1)}
    upper = ops.dimension_axis(shares).first().upper
    assert upper == pytest.approx(8 / 28 + 0.005)


def test_dimensions_are_whole_words(spark):
    from pairwright.operators.comments import dimension_counts

    said = [("h", "1", "La forêt était belle"), ("h", "2", "for Übel"), ("h", "3", "für"), ("h", "4", None)]
    counts = dimension_counts(spark.createDataFrame(said, "source string, sample_id string, comment string"), lexicon(spark, d=["for", "r", "t"]))
    assert [tuple(r) for r in counts.collect()] == [("h", "d", 1)]
