"""Snapshots of a stream, and what changed between consecutive ones.

A *stream* is one (repo, application_id), null being a value of its own. Keys get persistent
ordinals; a snapshot is a bitmap over ordinals, compressed by keeping only words that hold a bit,
and AND-NOT of two bitmaps gives additions and removals. Beside each word lie the facts of its keys
as a vector aligned by ordinal, so common keys compare place by place.

Null keys are no records. An empty table gives no rows. Rows delivered twice set the same bit.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from siftstone.functions.levelling import level_cwe, level_path, level_severity
from siftstone.session import scratch_path, sized, written

#: Keys that one region of ordinals is meant to hold, and its room.
REGION_KEYS, REGION_ROOM = 4096, 65536


def stream_key(repo: Column, application: Column) -> Column:
    return F.concat(F.coalesce(repo, F.lit("\u0000")), F.lit("\u0001"), F.coalesce(application, F.lit("\u0000")))


def snapshots(scans: DataFrame) -> DataFrame:
    """(stream, seq, scan_id, started_at, next_scan_id): completed scans in order of time.

    Neighbours with the same non-null target_sha are one snapshot, for which the last stands.
    The newest snapshot of a stream has no next_scan_id. Ties of started_at go by scan_id.
    """
    done = scans.where(F.col("ended_at").isNotNull() & F.col("started_at").isNotNull() & F.col("scan_id").isNotNull()).select(
        stream_key(F.col("repo"), F.col("application_id")).alias("stream"),
        "scan_id",
        "started_at",
        F.nullif(F.lower(F.trim("target_sha")), F.lit("")).alias("sha"),
    )
    in_time = Window.partitionBy("stream").orderBy("started_at", "scan_id")
    stands = done.withColumn("next_sha", F.lead("sha").over(in_time)).where(
        F.coalesce(F.col("next_sha") != F.col("sha"), F.lit(True))
    )
    return stands.select(
        "stream",
        F.row_number().over(in_time).alias("seq"),
        "scan_id",
        "started_at",
        F.lead("scan_id").over(in_time).alias("next_scan_id"),
    )


def newest(scans: DataFrame) -> DataFrame:
    return snapshots(scans).where("next_scan_id is null").drop("next_scan_id")


def assign_ordinals(keys: DataFrame, space: str, key: str, known: DataFrame | None = None) -> DataFrame:
    """(space, key, ordinal) for every distinct key; keys in ``known`` keep their ordinals.

    A space gets as many regions as its number of new keys asks for, so that no task numbers more
    than one region, however large the space. New regions start behind those in ``known``.
    """
    distinct = keys.select(space, key).where(F.col(space).isNotNull() & F.col(key).isNotNull()).distinct()
    if known is not None:
        distinct = distinct.join(known.select(space, key), [space, key], "left_anti")
        starts = known.groupBy(space).agg((F.max("ordinal") / REGION_ROOM).cast("long").alias("last"))
    sizes = distinct.groupBy(space).agg(F.ceil(F.count("*") / REGION_KEYS).alias("regions"))
    if known is not None:
        sizes = sizes.join(starts, space, "left")
    else:
        sizes = sizes.withColumn("last", F.lit(-1).cast("long"))
    # One row per space.
    placed = distinct.join(sized(written(sizes, "sizes")), space).withColumn(
        "region", F.coalesce("last", F.lit(-1)) + 1 + F.pmod(F.xxhash64(key), F.col("regions"))
    )
    within = Window.partitionBy(space, "region").orderBy(key)
    new = placed.select(
        space, key, (F.col("region") * REGION_ROOM + F.row_number().over(within) - 1).cast("long").alias("ordinal")
    )
    return new if known is None else known.select(space, key, "ordinal").unionByName(new)


class OrdinalStore:
    """Ordinals that last: a folder of (space, key, ordinal), to which each run adds its new keys in a folder of their own.

    A run that ends half-way leaves a folder without the mark of a whole write, which readers pass over.
    """

    def __init__(self, spark: SparkSession, path: str | None = None, key_type: str = "string"):
        self.spark, self.path, self.key_type = spark, (path or scratch_path(spark, "ordinals")).rstrip("/"), key_type

    def read(self) -> DataFrame | None:
        try:
            runs = [r.run for r in self.spark.read.schema("run string").json(f"{self.path}/runs").collect() if r.run]  # one row per run
        except AnalysisException as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
            return None
        schema = f"space string, key {self.key_type}, ordinal long"
        return self.spark.read.schema(schema).parquet(*(f"{self.path}/data/{r}" for r in runs)) if runs else None

    def extend(self, keys: DataFrame, space: str, key: str) -> DataFrame:
        """(space, key, ordinal) of all keys held; those of ``keys`` that are new get theirs first."""
        named = keys.select(F.col(space).alias("space"), F.col(key).alias("key"))
        known = self.read()
        every = assign_ordinals(named, "space", "key", known)
        fresh = every if known is None else every.join(known.select("space", "key"), ["space", "key"], "left_anti")
        run = f"r-{uuid.uuid4().hex}"
        fresh.write.option("compression", "zstd").parquet(f"{self.path}/data/{run}")
        self.spark.createDataFrame([(run,)], "run string").coalesce(1).write.mode("append").json(f"{self.path}/runs")
        return self.read().withColumnsRenamed({"space": space, "key": key})


def snapshot_words(findings: DataFrame, snaps: DataFrame, store: OrdinalStore | None = None) -> DataFrame:
    """One row per (stream, seq, word): the bits set in it and the facts of its keys, by bit.

    Ordinals come from ``store``, which keeps those of new keys for later runs.
    """
    facts = findings.where(F.col("finding_id").isNotNull()).select(
        "scan_id",
        "finding_id",
        level_severity(F.col("severity")).alias("severity"),
        level_cwe(F.col("cwe")).alias("cwe"),
        level_path(F.col("path")).alias("path"),
        F.col("start_line").cast("long").alias("start_line"),
    )
    places = snaps.select("scan_id", "stream", "seq", F.col("next_scan_id").isNotNull().alias("has_next"))
    rows = facts.join(sized(places), "scan_id").drop("scan_id")
    ordinals = (store or OrdinalStore(findings.sparkSession)).extend(rows, "stream", "finding_id")
    # Ordinals grow with the keys, so this join is never a broadcast, whatever their files weigh.
    placed = rows.join(ordinals.hint("merge"), ["stream", "finding_id"]).withColumns(
        {"word": F.expr("ordinal >> 6"), "bit": (F.col("ordinal") % 64).cast("int")}
    )
    # Grouped by less than the keys of the two aggregations below, so both run on this one shuffle.
    spread = placed.repartition("stream", "word")
    return spread.groupBy("stream", "word", "seq", "has_next").agg(
        F.bit_or(F.expr("shiftleft(1L, bit)")).alias("bits"),
        F.collect_set(F.struct("bit", "finding_id", F.struct("severity", "cwe", "path", "start_line").alias("facts"))).alias("vector"),
    )


def compare_words(words: DataFrame) -> DataFrame:
    """(stream, seq, word) with the bits added, removed, common, and both vectors."""
    later = words.where("seq > 1").select("stream", "word", "seq", F.col("bits").alias("cur"), F.lit(0).cast("long").alias("prev"), "vector")
    earlier = words.where("has_next").select(
        "stream", "word", (F.col("seq") + 1).alias("seq"), F.lit(0).cast("long").alias("cur"), F.col("bits").alias("prev"), "vector"
    )
    both = later.withColumn("is_cur", F.lit(True)).unionByName(earlier.withColumn("is_cur", F.lit(False)))
    grouped = both.groupBy("stream", "word", "seq").agg(
        F.bit_or("cur").alias("cur"),
        F.bit_or("prev").alias("prev"),
        F.flatten(F.collect_list(F.when(F.col("is_cur"), F.col("vector")))).alias("cur_vector"),
        F.flatten(F.collect_list(F.when(~F.col("is_cur"), F.col("vector")))).alias("prev_vector"),
    )
    return grouped.withColumns(
        {
            "added": F.expr("cur & ~prev"),
            "removed": F.expr("prev & ~cur"),
            "common": F.expr("cur & prev"),
        }
    )


_CHANGES = """
flatten(array(
  transform(filter(cur_vector, x -> (shiftrightunsigned(added, x.bit) & 1) = 1),
            x -> named_struct('finding_id', x.finding_id, 'change_kind', 'added')),
  transform(filter(prev_vector, x -> (shiftrightunsigned(removed, x.bit) & 1) = 1),
            x -> named_struct('finding_id', x.finding_id, 'change_kind', 'removed')),
  transform(filter(cur_vector, x -> (shiftrightunsigned(common, x.bit) & 1) = 1
                                and not exists(prev_vector, y -> y.bit = x.bit and y.facts <=> x.facts)),
            x -> named_struct('finding_id', x.finding_id, 'change_kind', 'changed'))))
"""


def snapshot_changes(findings: DataFrame, scans: DataFrame, store: OrdinalStore | None = None) -> DataFrame:
    """(scan_id, finding_id, change_kind) between every snapshot and the one before it in its stream.

    ``store`` keeps the ordinals of earlier runs and takes the new ones. A stream's first snapshot gives no rows.
    """
    snaps = written(snapshots(scans), "snapshots")
    changes = compare_words(snapshot_words(findings, snaps, store)).select(
        "stream", "seq", F.explode(F.expr(_CHANGES)).alias("c")
    )
    return changes.join(sized(snaps.select("stream", "seq", "scan_id")), ["stream", "seq"]).select(
        "scan_id", "c.finding_id", "c.change_kind"
    ).distinct()


def snapshot_counts(findings: DataFrame, scans: DataFrame, store: OrdinalStore | None = None) -> DataFrame:
    """Per later snapshot, counts by bitmap alone: added, removed and common keys."""
    snaps = written(snapshots(scans), "snapshots")
    sums = compare_words(snapshot_words(findings, snaps, store)).groupBy("stream", "seq").agg(
        F.sum(F.expr("cast(bit_count(added) as bigint)")).alias("n_added"),
        F.sum(F.expr("cast(bit_count(removed) as bigint)")).alias("n_removed"),
        F.sum(F.expr("cast(bit_count(common) as bigint)")).alias("n_common"),
    )
    return sums.join(sized(snaps.select("stream", "seq", "scan_id")), ["stream", "seq"]).select(
        "scan_id", "n_added", "n_removed", "n_common"
    )
