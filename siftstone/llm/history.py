"""New batches against all accepted history, at a cost that follows the batch.

A flaw's content is the span of code lines around it: ``reach`` lines to either side, each line being
(repo, file, class, line number). Winnowing keeps the least line hash of every ``reach + 1`` consecutive
lines, so two flaws at most ``reach`` lines apart, whose spans share a whole window, always share a
fingerprint. A fingerprint's bucket follows from the stretch of lines that its line lies in, so near flaws fall into few buckets, and
a file that holds any share of all rows spreads over many.

The history is a folder of generations. Each has fingerprints with what was accepted under them, in folders by bucket, and a
blocked Bloom filter for every bucket; both have as many buckets as their size asks for, so a bucket stays small however long
the history. A batch reads the filters of the buckets its fingerprints fall into, and the fingerprints only of those
buckets where a filter says yes; matches verify that the spans share at least ``reach + 1`` lines. ``accept`` adds a generation of what
is not yet held; when there are more than ``most_generations``, the smaller ones are merged into one. A list of the generations in
force is written last, so a job that ends half-way changes nothing, and a later session opens the folder and goes on.

Rows without repo, path or line match nothing. Two missing classes are equal. Equal rows give one case.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from siftstone.functions.levelling import level_cwe, level_path, level_repo, path_tail
from siftstone.operators.snapshots import newest
from siftstone.session import scratch_path, written

BLOCK_BITS, BITS_PER_KEY, HASHES = 32768, 12, 6
#: Lines that a near-duplicate may lie away, and lines of a stretch that shares a bucket.
REACH, STRETCH = 10, 256
#: Rows that a bucket is meant to hold, and generations kept beside each other.
BUCKET_ROWS, MOST_GENERATIONS = 50_000, 8
#: Numbers of buckets are gathered on the driver to name the folders to read; a generation has at most so many.
MOST_BUCKETS = 65_536

_ROWS = "entry_id {entry}, accepted_at timestamp, repo_l string, file_l string, cwe_l int, line_l long, fingerprint long, spot long"


def winnowed_lines(place: list[Column], line: Column, reach: int) -> Column:
    """Distinct (least hash, its line) per window of ``reach + 1`` lines, in the span of ``reach`` lines each way."""
    span = F.transform(F.sequence(line - reach, line + reach), lambda i: F.struct(F.xxhash64(*place, i).alias("fingerprint"), i.alias("at")))
    return F.array_distinct(
        F.transform(F.sequence(F.lit(1), F.lit(reach + 1)), lambda j: F.array_min(F.slice(span, j, reach + 1)))
    )


def _levelled(df: DataFrame) -> dict[str, Column]:
    return {
        "repo_l": level_repo(F.col("repo")),
        "file_l": path_tail(level_path(F.col("path"))),
        "cwe_l": level_cwe(F.col("cwe")),
        "line_l": F.col("start_line").cast("long"),
    }


def _bit_positions() -> Column:
    return F.array(*(F.pmod(F.xxhash64("fingerprint", F.lit(k)), F.lit(BLOCK_BITS)).cast("int") for k in range(HASHES)))


def _block(blocks: int) -> Column:
    return F.pmod(F.xxhash64("fingerprint"), F.lit(blocks)).cast("int")


def _buckets(rows: DataFrame, generation) -> list[int]:
    """The buckets that rows fall into: at most MOST_BUCKETS numbers."""
    return [0] if generation.buckets == 1 else [r.bucket for r in rows.select("bucket").distinct().collect()]


class AcceptedHistory:
    """The persistent fingerprint store of what was accepted, and its Bloom filters. Opening a folder again goes on with it."""

    def __init__(
        self, spark: SparkSession, path: str | None = None, reach: int = REACH, bucket_rows: int = BUCKET_ROWS, most_generations: int = MOST_GENERATIONS
    ):
        self.spark, self.reach, self.bucket_rows, self.most = spark, reach, bucket_rows, most_generations
        self.path = (path or scratch_path(spark, "history")).rstrip("/")
        self.version, self.held = 0, []
        try:
            listed = spark.read.schema("version long, name string, buckets long, blocks long, n_rows long, entry string").json(f"{self.path}/lists").where(
                "version is not null"
            )
            last = listed.agg(F.max("version")).first()[0]
        except AnalysisException as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
            last = None
        if last is not None:
            self.version = last
            # One row per generation in force, at most ``most_generations`` of them.
            self.held = [r for r in listed.where(F.col("version") == last).orderBy("name").collect() if r.name]

    @property
    def generations(self) -> int:
        return len(self.held)

    def _fingerprinted(self, df: DataFrame, keep: list[str]) -> DataFrame:
        """Rows of ``df`` once for each of their fingerprints, with the ``spot`` that buckets follow from."""
        levelled = df.select(*keep, *(c.alias(n) for n, c in _levelled(df).items())).where(
            "repo_l is not null and file_l is not null and line_l is not null"
        )
        place = [F.col("repo_l"), F.col("file_l"), F.coalesce(F.col("cwe_l"), F.lit(-1))]
        each = levelled.withColumn("w", F.explode(winnowed_lines(place, F.col("line_l"), self.reach)))
        return each.withColumns({"fingerprint": F.col("w.fingerprint"), "spot": F.xxhash64(*place, F.floor(F.col("w.at") / STRETCH))}).drop("w")

    def _schema(self, entry: str) -> str:
        return _ROWS.format(entry=entry)

    def _store(self, generation, buckets: list[int] | None = None) -> DataFrame:
        """Rows of a generation; with ``buckets``, only their folders are read."""
        rows = self.spark.read.schema(self._schema(generation.entry) + ", bucket int").parquet(f"{self.path}/rows/{generation.name}")
        return rows if buckets is None else rows.where(F.col("bucket").isin(buckets))

    def _write(self, rows: DataFrame, entry: str, n_rows: int) -> object:
        """A new generation of ``rows`` (without bucket); nothing reads it before it is listed."""
        name = f"g-{uuid.uuid4().hex}"
        buckets = min(MOST_BUCKETS, max(1, -(-n_rows // self.bucket_rows)))
        blocks = max(1, -(-n_rows * BITS_PER_KEY // (buckets * BLOCK_BITS)))
        placed = rows.withColumn("bucket", F.pmod("spot", F.lit(buckets)).cast("int"))
        # A place that many rows share makes a large bucket; rebalancing splits it over tasks and files.
        placed.hint("rebalance", "bucket").write.partitionBy("bucket").option("compression", "zstd").parquet(f"{self.path}/rows/{name}")
        kept = self.spark.read.schema(self._schema(entry) + ", bucket int").parquet(f"{self.path}/rows/{name}")
        ones = kept.select("bucket", _block(blocks).alias("block"), F.explode(_bit_positions()).alias("position"))
        filters = ones.groupBy("bucket", "block").agg(F.bitmap_construct_agg("position").alias("bits"))
        filters.hint("rebalance", "bucket").write.partitionBy("bucket").parquet(f"{self.path}/filters/{name}")
        return self.spark.createDataFrame([(name, buckets, blocks, n_rows, entry)], "name string, buckets long, blocks long, n_rows long, entry string").first()

    def _list(self, held: list) -> None:
        version = self.version + 1
        rows = [(version, r.name, r.buckets, r.blocks, r.n_rows, r.entry) for r in held] or [(version, None, 0, 0, 0, "long")]
        self.spark.createDataFrame(rows, "version long, name string, buckets long, blocks long, n_rows long, entry string").coalesce(1).write.mode("append").json(
            f"{self.path}/lists"
        )
        self.version, self.held = version, held

    def accept(self, entries: DataFrame) -> AcceptedHistory:
        """Add entries (entry_id, repo, path, cwe, start_line, accepted_at) that the history does not hold yet."""
        entry = dict(entries.dtypes)["entry_id"]
        every = self._fingerprinted(entries.where("entry_id is not null"), ["entry_id", "accepted_at"]).select(
            "entry_id", F.col("accepted_at").cast("timestamp").alias("accepted_at"), "repo_l", "file_l", "cwe_l", "line_l", "fingerprint", "spot"
        )
        rows = written(every.distinct(), "accepted")
        if self.held:
            known = self._looked_up(rows.select("fingerprint", "spot", "entry_id"))
            same = known.where("entry_id <=> held_entry_id").select("entry_id", "fingerprint").distinct()
            rows = written(rows.join(same, ["entry_id", "fingerprint"], "left_anti"), "accepted")
        n_rows = rows.count()
        if not n_rows:
            return self
        held = [*self.held, self._write(rows, entry, n_rows)]
        if len(held) > self.most:
            # The smaller generations go into one; each row is rewritten as often as the history grows by a factor, not once a batch.
            held.sort(key=lambda r: -r.n_rows)
            keep, small = held[: self.most // 2], held[self.most // 2 :]
            union = self._store(small[0]).drop("bucket")
            for r in small[1:]:
                union = union.unionByName(self._store(r).drop("bucket"))
            held = [*keep, self._write(union, entry, sum(r.n_rows for r in small))]
        self._list(held)
        return self

    def prescreen(self, fingerprints: DataFrame, generation) -> DataFrame:
        """Rows of ``fingerprints`` (fingerprint, spot, and more) that the filters of a generation don't rule out, with their bucket.

        Only the filters of the buckets that the rows fall into are read.
        """
        probes = written(fingerprints.withColumn("bucket", F.pmod("spot", F.lit(generation.buckets)).cast("int")), "probes")
        filters = self.spark.read.schema("block int, bits binary, bucket int").parquet(f"{self.path}/filters/{generation.name}")
        filters = filters.where(F.col("bucket").isin(_buckets(probes, generation)))
        byte = "cast(conv(hex(substring(bits, p div 8 + 1, 1)), 16, 10) as int)"
        return (
            probes.withColumn("block", _block(generation.blocks))
            .join(filters, ["bucket", "block"])
            .withColumn("positions", _bit_positions())
            .where(F.expr(f"forall(positions, p -> (shiftright({byte}, p % 8) & 1) = 1)"))
            .drop("positions", "bits", "block")
        )

    def _looked_up(self, fingerprints: DataFrame) -> DataFrame:
        """Rows of ``fingerprints`` beside all rows of the history of the same fingerprint, the latter's columns as held_*.

        Rows of the store are read from the buckets where a filter says yes, of each generation.
        """
        out = None
        for generation in self.held:
            positive = written(self.prescreen(fingerprints, generation), "positives")
            store = self._store(generation, _buckets(positive, generation)).select("bucket", "fingerprint", *(F.col(c).alias(f"held_{c}") for c in ("entry_id", "accepted_at", "repo_l", "file_l", "cwe_l", "line_l")))
            found = positive.join(store, ["bucket", "fingerprint"]).drop("bucket")
            out = found if out is None else out.unionByName(found)
        return out

    def matches(self, batch: DataFrame, keys: list[str]) -> DataFrame:
        """(keys, entry_id, accepted_at, line_delta): rows of ``batch`` that repeat what was accepted."""
        fingerprints = self._fingerprinted(batch, keys)
        if not self.held:
            return fingerprints.limit(0).select(
                *keys, F.lit(None).cast("long").alias("entry_id"), F.lit(None).cast("timestamp").alias("accepted_at"), F.lit(0).cast("long").alias("line_delta")
            )
        shared_lines = 2 * self.reach + 1 - F.abs(F.col("line_l") - F.col("held_line_l"))
        verified = self._looked_up(fingerprints).where(
            (F.col("repo_l") == F.col("held_repo_l"))
            & (F.col("file_l") == F.col("held_file_l"))
            & F.col("cwe_l").eqNullSafe(F.col("held_cwe_l"))
            & (shared_lines >= self.reach + 1)
        )
        return verified.select(
            *keys, F.col("held_entry_id").alias("entry_id"), F.col("held_accepted_at").alias("accepted_at"), F.abs(F.col("line_l") - F.col("held_line_l")).alias("line_delta")
        ).distinct()


def newest_findings(findings: DataFrame, scans: DataFrame) -> DataFrame:
    """Findings of each stream's newest snapshot, with the start of its scan."""
    last = newest(scans).select("scan_id", "started_at")
    return findings.select("scan_id", "finding_id", "repo", "path", "cwe", "start_line").join(last, "scan_id")


def repeated_findings(findings: DataFrame, scans: DataFrame, entries: DataFrame, path: str | None = None) -> DataFrame:
    """(scan_id, finding_id, entry_id, line_delta): newest findings that repeat an earlier accepted entry.

    ``path`` is the folder of a history that lasts: entries it does not hold are accepted before the batch is looked up.
    """
    history = AcceptedHistory(entries.sparkSession, path).accept(entries)
    batch = newest_findings(findings, scans)
    return history.matches(batch, ["scan_id", "finding_id", "started_at"]).where("accepted_at < started_at").select(
        "scan_id", "finding_id", "entry_id", "line_delta"
    ).distinct()
