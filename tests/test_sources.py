"""Readers and writers."""

import json

import pytest
from helpers import items, judged, rows

from pairwright.operators.items import build_items, dedupe_first
from pairwright.sources import readers, writers


def test_annotation_csv(spark, tmp_path):
    text = (
        "\ufeffsample_id,lang_code,source,text1,text2,choice,issues,commet,comment_len\n"
        's1,de,"two\nlines","say ""hi"", now",b,text1,NA,"ok",12\n'
        "s2,fr,x,y,z,text2,nan,,\n"
        "s1,de,dup,dup,dup,text2,none,N/A,7.0\n"
    )
    path = tmp_path / "human.csv"
    path.write_text(text, encoding="utf-8")
    human = readers.read_human(spark, str(path))
    kept = dedupe_first(human, ["sample_id"]).orderBy("sample_id").collect()
    first, second = kept
    assert (first.source, first.text1, first.issues, first.commet) == ("two\nlines", 'say "hi", now', None, "ok")
    assert (first.comment_len, second.comment_len, second.issues, second.commet) == (12, None, None, None)
    assert [r.gold_winner for r in build_items(human).orderBy("sample_id", "source").collect()] == ["B", "A", "B"]
    assert human.filter("issues = 'none'").count() == 1


def test_annotation_csv_without_a_required_column(spark, tmp_path):
    path = tmp_path / "human.csv"
    path.write_text("sample_id,lang_code\n1,de\n")
    with pytest.raises(ValueError, match="lacks columns"):
        readers.read_human(spark, str(path))


def line(sample_id, winner, **more):
    return json.dumps({"sample_id": sample_id, "model": "j", "parsed_winner": winner, "swap_order": False, **more})


def test_jsonl_order_blanks_and_nan(spark, tmp_path):
    one, two = tmp_path / "b.jsonl", tmp_path / "a.jsonl"
    one.write_text(line("s1", "A") + "\n\n" + line("s2", None) + "\n")
    two.write_text(line("s1", "B", extra=1) + "\n")
    table = readers.read_judgments(spark, [str(one), str(two)])
    first = dedupe_first(table.repartition(5), ["sample_id"])
    assert rows(first, "sample_id", "parsed_winner", "error") == [("s1", "A", None), ("s2", None, None)]

    path = tmp_path / "items.jsonl"
    path.write_text('{"sample_id": "s1", "issues": NaN, "comment": "NaN", "choice": "text1"}\n')
    assert rows(readers.read_items(spark, str(path)), "issues", "comment", "choice", "source") == [
        (None, None, "text1", None)
    ]


def test_rows_keep_their_order_across_blocks(spark, tmp_path):
    """Many small blocks per file; the ordinal is still the line number."""
    path = tmp_path / "big.jsonl"
    path.write_text("".join(line(f"{i:06}", "A") + "\n" for i in range(20_000)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "65536")
    table = readers.read_judgments(spark, str(path))
    assert table.rdd.getNumPartitions() > 8
    ids = [r.sample_id for r in table.repartition(3).orderBy("row_ordinal").collect()]
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert ids == sorted(ids) and len(ids) == 20_000


def test_malformed_lines(spark, tmp_path):
    path = tmp_path / "bad.jsonl"
    path.write_text(line("s1", "A") + '\n{"sample_id": \n')
    with pytest.raises(Exception, match="(?i)malformed"):
        readers.read_judgments(spark, str(path)).collect()
    assert rows(readers.read_judgments(spark, str(path), mode="PERMISSIVE"), "sample_id") == [("s1",), (None,)]


def test_jsonl_spells_out_nulls(spark, tmp_path):
    table = items(spark, [("s1", "de"), ("s2", None)])
    writers.write_jsonl(table, str(tmp_path / "out"))
    lines = [x for p in (tmp_path / "out").glob("*.json") for x in p.read_text().splitlines()]
    assert all(set(json.loads(x)) == set(table.columns) for x in lines) and len(lines) == 2
    assert rows(readers.read_items(spark, str(tmp_path / "out")).drop("row_ordinal")) == rows(table)


def test_tables_by_judge(spark, tmp_path):
    table = judged(spark, [("s1", "de", "a/b:c", "main", False, "A", "A"), ("s2", "de", "d", "main", True, "A", None)])
    writers.write_table(table, str(tmp_path / "csv"), by_judge=True, fmt="csv")
    assert {p.name for p in (tmp_path / "csv").iterdir() if p.is_dir()} == {"model_slug=a_b_c", "model_slug=d"}
    back = spark.read.option("header", True).csv(str(tmp_path / "csv"))
    assert rows(back, "sample_id", "parsed_winner") == [("s1", "A"), ("s2", None)]
    writers.write_judgments(table, str(tmp_path / "parquet"))
    swapped = spark.read.parquet(str(tmp_path / "parquet")).filter("swap_order AND prompt_version = 'main'")
    assert rows(swapped, "sample_id") == [("s2",)]
    assert "PartitionFilters: [isnotnull(swap_order" in swapped._jdf.queryExecution().executedPlan().toString()


def test_prompts(spark, tmp_path):
    (tmp_path / "judge_main.txt").write_text("line one\nline two")
    (tmp_path / "other.txt").write_text("x")
    (tmp_path / "note.md").write_text("no prompt")
    assert rows(readers.read_prompts(spark, str(tmp_path))) == [("main", "line one\nline two"), ("other", "x")]


def test_many_files_are_one_scan_in_the_order_listed(spark, tmp_path):
    folder = tmp_path / "many files"
    folder.mkdir()
    paths = []
    for i in range(1000):
        path = folder / f"part {i:04}.jsonl"
        path.write_text(line(f"{i:04}-0", "A") + "\n\n" + line(f"{i:04}-1", "B") + "\n")
        paths.append(str(path))
    listed = paths[500:] + paths[:500]
    table = readers.read_judgments(spark, listed)
    plan = table._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1 and "Union" not in plan
    assert dict(table.dtypes)["row_ordinal"] == "bigint"
    ids = [r.sample_id for r in table.repartition(5).orderBy("row_ordinal").collect()]
    assert ids == [f"{i:04}-{j}" for i in [*range(500, 1000), *range(500)] for j in (0, 1)]
    # A pattern, then a folder that holds the same files and one more place: the first that names a file counts.
    other = tmp_path / "z"
    other.mkdir()
    (other / "a.jsonl").write_text(line("last", "A") + "\n")
    few = readers.read_judgments(spark, [str(folder / "part 099*.jsonl"), str(folder / "part 0003.jsonl"), str(other)])
    assert [r.sample_id[:4] for r in few.orderBy("row_ordinal").collect()][::2] == [f"{i:04}" for i in range(990, 1000)] + ["0003", "last"]


def test_order_holds_with_whole_and_shared_blocks(spark, tmp_path):
    """Files of several blocks, whose last ones share tasks."""
    for i in range(12):
        (tmp_path / f"f{i:02}.jsonl").write_text("".join(line(f"{i:02}-{j:05}", "A") + "\n" for j in range(300 + 170 * i)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "30000")
    spark.conf.set("spark.sql.files.openCostInBytes", "10")
    try:
        ids = [r.sample_id for r in readers.read_judgments(spark, str(tmp_path)).orderBy("row_ordinal").collect()]
        table = readers.read_judgments(spark, str(tmp_path))
        assert table.select("row_ordinal").distinct().count() == len(ids)
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert ids == sorted(ids) and len(ids) == sum(300 + 170 * i for i in range(12))
