"""Intermediate tables in the folder that all executors share."""

from __future__ import annotations

import atexit
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import pairwright

_OWN: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """`spark.checkpoint.dir` of the session; a temporary folder where it is unset and all runs on this machine."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith(("local[", "local ")) and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = _OWN.setdefault("dir", "") or _OWN.update(dir=tempfile.mkdtemp(prefix="checkpoints-")) or _OWN["dir"]
    return found.rstrip("/")


def _filesystem(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def cut(df: DataFrame) -> DataFrame:
    """`df` written to the shared folder and read again: later steps start from the files.

    A lost executor then costs the tasks that read from it, not the steps before. The files go when the
    session ends, or with `drop`.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/pairwright-{uuid.uuid4().hex}"
    df.write.parquet(path)
    filesystem, at = _filesystem(spark, path)
    filesystem.deleteOnExit(at)
    out = spark.read.schema(df.schema).parquet(path)
    out.cut_path = path
    return out


def cut_in_buckets(df: DataFrame, *keys: str) -> DataFrame:
    """`cut` for a table that is joined by `keys` more than once: such joins don't shuffle it again.

    The files are in buckets, as many as a shuffle has partitions. Spark reads buckets through a table only, which
    is dropped from the catalog at once; its files stay until the session ends.
    """
    spark = df.sparkSession
    name = f"pairwright_{uuid.uuid4().hex}"
    path = f"{shared_dir(spark)}/{name}"
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    writer = df.write.format("parquet").option("compression", "zstd").option("path", path)
    writer.bucketBy(buckets, *keys).sortBy(*keys).saveAsTable(name)
    filesystem, at = _filesystem(spark, path)
    filesystem.deleteOnExit(at)
    out = spark.table(name)
    out.schema  # resolved before the name goes
    spark.sql(f"DROP TABLE {name}")
    return out


def drop(*frames: DataFrame) -> None:
    """Remove tables made by `cut` that nothing reads any more."""
    for df in frames:
        if path := getattr(df, "cut_path", None):
            filesystem, at = _filesystem(df.sparkSession, path)
            filesystem.delete(at, True)


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, once a session; they need not have it installed."""
    context = spark.sparkContext
    if getattr(context, "_pairwright_shipped", False):
        return
    root = Path(pairwright.__file__).parent
    path = Path(tempfile.mkdtemp(prefix="pairwright-")) / "pairwright-package.zip"
    with zipfile.ZipFile(path, "w") as archive:
        for source in sorted(root.rglob("*.py")):
            archive.write(source, str(source.relative_to(root.parent)))
    context.addPyFile(str(path))
    context._pairwright_shipped = True


def map_arrow(df: DataFrame, run, schema) -> DataFrame:
    """`mapInArrow` with this package at hand on the executors."""
    ship(df.sparkSession)
    return df.mapInArrow(run, schema)


def small(df: DataFrame, rows: int) -> DataFrame:
    """`df` with a broadcast hint if it is counted and found to have at most `rows` rows, else as it is."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


#: Bytes of files up to which `unsent` leaves it to Spark whether a table is broadcast.
SENT_BYTES = 1_000_000


def unsent(df: DataFrame) -> DataFrame:
    """`df`, a table made by `cut`, with a hint against being broadcast if it has over SENT_BYTES of files.

    Spark takes compressed files for the size of a table. As a relation, which the driver builds, numbers take up to
    18 times that, so that a few tables just under the usual limit of 10 MB can fill a driver.
    """
    filesystem, at = _filesystem(df.sparkSession, df.cut_path)
    if filesystem.getContentSummary(at).getLength() <= SENT_BYTES:
        return df
    out = df.hint("merge")
    out.cut_path = df.cut_path
    return out


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def column(df: DataFrame, name: str, kind: str) -> "F.Column":
    """The column of exactly this name as `kind`, also beside columns that differ from it in case only."""
    return F.col(f"`{name}`").cast(kind).alias(name)


@atexit.register
def _forget() -> None:
    _OWN.clear()
