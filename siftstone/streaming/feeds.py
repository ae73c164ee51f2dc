"""Feeds: findings and marks that arrive as files are folded into a store, batch by batch."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.utils import AnalysisException

from siftstone.operators.store import latest_rows


class VersionedStore:
    """A table kept in buckets of its keys, each in a version of its own; a small list names the versions in force.

    A batch rewrites the buckets that its keys fall into and leaves the others as they are.
    """

    def __init__(self, spark: SparkSession, path: str, keys: list[str], order: list[str], buckets: int = 64):
        self.spark, self.path, self.keys, self.order, self.buckets = spark, path.rstrip("/"), keys, order, buckets

    def _list(self) -> DataFrame:
        return self.spark.read.schema("batch long, version string, bucket int").json(f"{self.path}/versions")

    def _in_force(self) -> dict[int, str]:
        """The version of each bucket: at most ``buckets`` rows."""
        try:
            last = self._list().where("bucket >= 0").groupBy("bucket").agg(F.max_by("version", "batch").alias("version"))
            return {r.bucket: r.version for r in last.collect()}
        except AnalysisException as e:  # the folder does not exist before the first batch
            if "PATH_NOT_FOUND" in str(e):
                return {}
            raise

    def _read(self, versions: dict[int, str]) -> DataFrame:
        return self.spark.read.parquet(*(f"{self.path}/data/{v}/bucket={b}" for b, v in versions.items()))

    def read(self) -> DataFrame | None:
        versions = self._in_force()
        return self._read(versions) if versions else None

    def upsert(self, batch: DataFrame, number: int) -> None:
        """Fold a batch in. A batch number seen before is left out, so a repeated batch changes nothing."""
        versions = self._in_force()
        if versions and self._list().where(f"batch >= {number}").take(1):
            return
        bucket = F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")
        touched = [r.bucket for r in batch.select(bucket.alias("bucket")).distinct().collect()]  # at most ``buckets`` numbers
        held = {b: versions[b] for b in touched if b in versions}
        every = self._read(held).unionByName(batch) if held else batch
        version = uuid.uuid4().hex
        latest_rows(every, self.keys, self.order).withColumn("bucket", bucket).write.partitionBy("bucket").parquet(f"{self.path}/data/{version}")
        rows = [(number, version, b) for b in touched] or [(number, version, -1)]
        self.spark.createDataFrame(rows, "batch long, version string, bucket int").coalesce(1).write.mode("append").json(f"{self.path}/versions")


def fold_feed(feed: DataFrame, store: VersionedStore, checkpoint: str) -> StreamingQuery:
    """Start folding a streaming table into the store; it ends when what is there has been read."""
    return (
        feed.writeStream.foreachBatch(lambda df, number: store.upsert(df, number))
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
