"""Readers: annotation CSV, JSONL results and items, prompt texts."""

from __future__ import annotations

import fnmatch
import re
from collections.abc import Sequence
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pairwright import schemas

# Texts that stand for a missing value in annotation files.
MISSING = [
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
]


# Bits of a position within a file; the rank of the file stands above them.
_POSITION_BITS = 43
_MOST_FILES = 1 << 63 - _POSITION_BITS


def _plain(uri: str) -> str:
    """A file's address with one kind of beginning, however many slashes it came with."""
    return re.sub(r"^([a-z0-9]+):/+", r"\1:/", uri)


def _ranked_files(df: DataFrame, paths: Sequence[str]) -> list[str]:
    """The files that ``df`` reads, those of the first listed path first, by name within a path.

    A path is a file, a folder or a pattern of either.
    """
    spark = df.sparkSession
    jvm, conf = spark._jvm, spark._jsparkSession.sessionState().newHadoopConf()
    listed = []
    for path in paths:
        at = jvm.org.apache.hadoop.fs.Path(path)
        listed.append(_plain(at.getFileSystem(conf).makeQualified(at).toString()).rstrip("/"))
    place = {path: i for i, path in reversed(list(enumerate(listed)))}
    patterns = [(i, re.compile(fnmatch.translate(p))) for i, p in enumerate(listed) if re.search(r"[*?\[{]", p)]

    def rank(file: str) -> tuple[int, str]:
        plain = unquote(_plain(file))
        parts = plain.split("/")
        above = ["/".join(parts[:n]) for n in range(len(parts), 0, -1)]
        found = [place[p] for p in above if p in place] + [i for i, p in patterns if any(map(p.match, above[:2]))]
        return min(found, default=len(listed)), plain

    files = sorted(df.inputFiles(), key=rank)
    if len(files) >= _MOST_FILES:
        raise ValueError(f"at most {_MOST_FILES - 1} files can be read in order")
    return files


def _with_ordinal(df: DataFrame, paths: Sequence[str]) -> DataFrame:
    """Add ``row_ordinal``, a bigint: rank of the file as listed, then the row's place in it.

    A block is read front to back by one task, and rows are numbered in a task. Spark fills a task with one block if it
    is a whole one, so numbers start at 0 there, and a block has fewer rows than bytes: its start plus the number
    is below the start of the next. Only a file's last block may share a task and be numbered from further on.
    """
    number = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    placed = df.select(
        "*", F.col("_metadata.file_path").alias("_file"), (F.col("_metadata.file_block_start") + number).alias("_place")
    )
    ranks = [(_plain(file), i) for i, file in enumerate(_ranked_files(df, paths))]
    # As many rows as the driver has listed files to read.
    table = F.broadcast(df.sparkSession.createDataFrame(ranks, "_file string, _rank long"))
    address = F.regexp_replace("_file", "^([a-z0-9]+):/+", "$1:/")
    joined = placed.withColumn("_file", address).join(table, "_file", "left")
    ordinal = F.shiftleft("_rank", _POSITION_BITS).bitwiseOR(F.col("_place"))
    return joined.select(*df.columns, ordinal.alias("row_ordinal"))


def _paths(paths: str | Sequence[str]) -> list[str]:
    return [paths] if isinstance(paths, str) else list(paths)


def _null_out(df: DataFrame, tokens: Sequence[str], columns: Sequence[str]) -> DataFrame:
    return df.withColumns({c: F.when(~F.col(c).isin(*tokens), F.col(c)) for c in columns})


def read_human(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """Annotation CSV, all columns as text except ``comment_len``.

    Quoted fields may span lines, which makes a file the unit of parallelism: keep
    large annotations in many files, or switch ``multi_line`` off if none does.
    """
    raw = (
        spark.read.option("header", True)
        .option("multiLine", multi_line)
        .option("escape", '"')
        .option("encoding", "UTF-8")
        .csv(path)
    )
    columns = raw.columns
    df = _null_out(_with_ordinal(raw, [path]), MISSING, columns)
    schemas.require(df, schemas.HUMAN_REQUIRED)
    if "comment_len" in columns:
        df = df.withColumn("comment_len", F.col("comment_len").try_cast("double").cast("int"))
    return df


def read_jsonl(
    spark: SparkSession, paths: str | Sequence[str], schema: T.StructType, mode: str = "FAILFAST"
) -> DataFrame:
    """JSONL files, folders or patterns as one table with ``row_ordinal``, read by one scan.

    The schema is given, so nothing is inferred and no file is read twice. Blank
    lines are skipped; a malformed line is an error, or with PERMISSIVE a row of
    nulls. The bare token NaN in a text column means missing.
    """
    listed = _paths(paths)
    table = _with_ordinal(spark.read.schema(schema).option("mode", mode).json(listed), listed)
    texts = [f.name for f in schema if isinstance(f.dataType, T.StringType)]
    free_text = [c for c in texts if c in ("choice", "issues", "comment")]
    return _null_out(table, ["NaN"], free_text)


def read_items(spark: SparkSession, paths: str | Sequence[str], **options: str) -> DataFrame:
    return read_jsonl(spark, paths, schemas.ITEMS, **options)


def read_subset(spark: SparkSession, paths: str | Sequence[str], **options: str) -> DataFrame:
    return read_jsonl(spark, paths, schemas.SUBSET_ITEMS, **options)


def read_judgments(spark: SparkSession, paths: str | Sequence[str], **options: str) -> DataFrame:
    return read_jsonl(spark, paths, schemas.JUDGMENTS, **options)


def read_comments(spark: SparkSession, paths: str | Sequence[str], **options: str) -> DataFrame:
    return read_jsonl(spark, paths, schemas.COMMENTS, **options)


def read_prompts(spark: SparkSession, directory: str) -> DataFrame:
    """Prompt files as (prompt_version, template); ``judge_main.txt`` is version ``main``."""
    return spark.read.text(f"{directory}/*.txt", wholetext=True).select(
        F.regexp_extract("_metadata.file_name", r"^(?:judge_)?(.*)\.txt$", 1).alias("prompt_version"),
        F.col("value").alias("template"),
    )
