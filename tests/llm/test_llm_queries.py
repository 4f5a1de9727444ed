"""The registered queries against their SQL, and the pipeline stage by stage."""

import pytest
from oracle_check import TESTDATA, compare, connect

import __spark_entry__ as entry
import corpus_pipeline

SF = str(TESTDATA / "sf0.001")


@pytest.mark.parametrize("name", [n for n in entry.oracle_sql() if n.startswith("op")])
def test_query_equals_sql(spark, name):
    assert compare(spark, connect(SF), name, entry.queries()[name], entry.oracle_sql()[name], SF) is None


@pytest.mark.parametrize("name", [n for n in entry.queries() if n.startswith("op") and n not in entry.oracle_sql()])
def test_query_covers_its_table(spark, name):
    table = "pages" if name.startswith("op8") else "documents"
    assert entry.queries()[name](spark, SF).count() == spark.read.parquet(f"{SF}/{table}.parquet").count()


def test_pipeline(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, before = docs.columns, docs.count()
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        made = stage(spark, docs, SF)
        if i < len(corpus_pipeline.STAGES) - 1:
            assert made.columns == columns, name
        made.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        if name in ("language", "dedup"):
            assert 0.5 * before < docs.count() <= before
        if name == "secrets":
            assert docs.where("text like '%AKIA%'").count() == 0
    assert docs.where("n_tokens = 0").count() == 0 and docs.count() > before / 2
