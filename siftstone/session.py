"""Session helpers: where intermediate tables go, and how lineage is cut."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share, read from ``spark.checkpoint.dir``.

    Only a local session may lack the setting; it then gets a temporary folder of its own.
    On a cluster a missing setting is an error, since a machine-local folder would lose data.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if folder:
        return folder.rstrip("/")
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    folder = getattr(spark.sparkContext, "_siftstone_folder", None)
    if folder is None:
        folder = "file://" + tempfile.mkdtemp(prefix="siftstone-")
        spark.sparkContext._siftstone_folder = folder
    return folder


def scratch_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that no other call gets."""
    return f"{shared_folder(spark)}/siftstone/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str, partition_by: list[str] | None = None) -> DataFrame:
    """Write ``df`` as a table in the shared folder and return the reader of it.

    Lineage ends there, so the loss of an executor repeats nothing before it.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    writer = df.write.option("compression", "zstd")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def spread(df: DataFrame) -> DataFrame:
    """Rows of a scan over at least as many tasks as there are cores, for work in Python on files too few to keep them busy.

    Large inputs have more parts than that and stay as they are, without a shuffle.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def sized(df: DataFrame, most: int = 20_000) -> DataFrame:
    """A narrow table to join: broadcast if it has at most ``most`` rows, else merged by a shuffle; never by a guess from file sizes."""
    return F.broadcast(df) if df.count() <= most else df.hint("merge")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
