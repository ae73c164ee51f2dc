"""Consensus of several annotators by bipartite message passing.

Labels are edges between items and annotators. For each class, against the rest, items send every annotator
their belief from all other labels, and annotators send every item the weight of their label from all other
items, until the beliefs stand still. An annotator may lean to one class or be wrong more often than right;
its weights follow. Items with the same labels from the same annotators receive the same messages, so
messages are passed once per pattern of labels, counted with its number of items, and results go back to items.

Only an annotator's totals pass between tasks in a round: edges lie once by pattern, and a round reads them where they are. Rounds go
on until the beliefs stand still; when they swing, messages are damped, and a run that does not settle is an error.

Labels outside the classes count as the rest of every class. Null items, annotators and labels are no edges.
Equal labels by one annotator on one item count as often as they stand. Ties go to the first class.
"""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siftstone.functions.levelling import level_verdict, level_word
from siftstone.operators.snapshots import stream_key
from siftstone.session import written

CLASSES = ("confirm", "reject")
#: Added to every count of a label under a class; beliefs that move less than TOLERANCE stand still.
SMOOTHING, TOLERANCE = 1.0, 0.002
#: From the one on, messages are averaged with those before; without standing still by the other, the run fails.
DAMPED_FROM, FAILED_FROM = 20, 300
#: A table is written every so many rounds, which cuts lineage.
WRITTEN_EVERY = 10
BROADCAST_ANNOTATORS = 50_000


def _sigmoid(x):
    return 1.0 / (1.0 + F.exp(-x))


def label_patterns(labels: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(item, sig) and pattern edges (sig, annotator, label, n, items) of labels (item, annotator, label)."""
    edges = written(
        labels.where("item is not null and annotator is not null and label is not null").groupBy("item", "annotator", "label").agg(F.count("*").alias("n")),
        "label-edges",
    )
    # Edges of an item are distinct, so xor of their hashes stands for the set of them.
    signed = edges.groupBy("item").agg(
        F.struct(F.bit_xor(F.xxhash64("annotator", "label", "n")), F.bit_xor(F.xxhash64("annotator", "label", "n", F.lit(1)))).alias("sig")
    )
    items = written(signed, "label-items")
    kinds = items.groupBy("sig").agg(F.count("*").alias("items"), F.min("item").alias("item"))
    return items, written(edges.join(kinds, "item").drop("item"), "label-patterns")


def _beliefs(edges: DataFrame, classes: tuple[str, ...]) -> DataFrame:
    """(sig, class, logit): each class against the rest; all classes pass their messages side by side."""
    spark = edges.sparkSession
    seen = edges.withColumn("class", F.explode(F.array(*map(F.lit, classes)))).withColumn("y", (F.col("label") == F.col("class")).cast("double"))
    of_pattern = Window.partitionBy("sig", "class")
    # The first beliefs are the shares of labels. Edges lie by pattern from here on; windows over them need no shuffle.
    spread = seen.repartition("sig").sortWithinPartitions("sig", "class")
    start = spread.withColumn("p", F.sum(F.col("y") * F.col("n")).over(of_pattern) / F.sum("n").over(of_pattern))
    cavity = start.withColumns({"p_before": F.lit(None).cast("double"), "logit": F.lit(None).cast("double")}).persist(StorageLevel.MEMORY_AND_DISK)
    weight = F.col("items") * F.col("n")
    # Totals have a row per class and annotator; they pass through the driver only up to a checked number of annotators.
    few = edges.select("annotator").distinct().count() <= BROADCAST_ANNOTATORS
    s = F.lit(SMOOTHING)
    own1, own0 = F.col("n") * F.col("p"), F.col("n") * (1 - F.col("p"))
    hit1 = (F.col("hit1") - own1 * F.col("y") + s) / (F.col("all1") - own1 + 2 * s)
    hit0 = (F.col("hit0") - own0 * F.col("y") + s) / (F.col("all0") - own0 + 2 * s)
    base = F.least(F.greatest(F.try_divide(F.col("base1"), F.col("base1") + F.col("base0")), F.lit(0.02)), F.lit(0.98))
    annotator = dict(edges.dtypes)["annotator"]
    rounds, before = 0, None
    while True:
        sums = cavity.groupBy("class", "annotator").agg(
            F.sum(weight * F.col("p") * F.col("y")).alias("hit1"),
            F.sum(weight * F.col("p")).alias("all1"),
            F.sum(weight * (1 - F.col("p")) * F.col("y")).alias("hit0"),
            F.sum(weight * (1 - F.col("p"))).alias("all0"),
            F.max(F.abs(F.col("p") - F.col("p_before"))).alias("moved"),
        )
        if few:
            # The rows also tell whether beliefs moved, so a round is one job; it fills the cache of this round's messages.
            rows = sums.collect()
            moved = max((r.moved for r in rows if r.moved is not None), default=None)
        else:
            totals = written(sums, "totals")
            moved = totals.agg(F.max("moved")).first()[0]
        if before is not None:
            before.unpersist()
        if rounds and (moved is None or moved < TOLERANCE):
            break
        if rounds >= FAILED_FROM:
            raise RuntimeError(f"beliefs still move by {moved} after {rounds} rounds")
        rounds += 1
        if few:
            prior = {c: [sum(x) for x in zip(*((r.all1, r.all0) for r in rows if r["class"] == c))] for c in {r["class"] for r in rows}}
            told = F.broadcast(
                spark.createDataFrame(
                    [(r["class"], r.annotator, r.hit1, r.all1, r.hit0, r.all0, *prior[r["class"]]) for r in rows],
                    f"class string, annotator {annotator}, hit1 double, all1 double, hit0 double, all0 double, base1 double, base0 double",
                )
            )
        else:
            of_class = totals.groupBy("class").agg(F.sum("all1").alias("base1"), F.sum("all0").alias("base0"))
            told = totals.drop("moved").join(F.broadcast(of_class), "class").hint("merge")  # one row per class
        weighed = cavity.drop("p_before", "logit").join(told, ["class", "annotator"]).withColumn(
            "w", F.col("n") * F.when(F.col("y") == 1, F.log(hit1 / hit0)).otherwise(F.log((1 - hit1) / (1 - hit0)))
        )
        fresh = _sigmoid(F.col("logit") - F.col("w"))
        passed = (
            weighed.withColumnRenamed("p", "p_before")
            .withColumn("logit", F.log(base / (1 - base)) + F.sum("w").over(of_pattern))
            .withColumn("p", fresh if rounds < DAMPED_FROM else (fresh + F.col("p_before")) / 2)
            .select(*cavity.columns)
        )
        if not few or rounds % WRITTEN_EVERY == 0:
            passed = written(passed, "messages").repartition("sig").sortWithinPartitions("sig", "class")
        before, cavity = cavity, passed.persist(StorageLevel.MEMORY_AND_DISK)
    result = written(cavity.groupBy("sig", "class").agg(F.first("logit").alias("logit")), "beliefs")
    cavity.unpersist()
    return result


def consensus(labels: DataFrame, classes: tuple[str, ...] = CLASSES) -> tuple[DataFrame, DataFrame]:
    """(item, verdict, confidence) and (annotator, n_labels, reliability) from (item, annotator, label).

    Reliability is the expected share of an annotator's labels that agree with the consensus belief.
    """
    items, edges = label_patterns(labels)
    beliefs = _beliefs(edges, classes)
    order = F.create_map(*(x for k, c in enumerate(classes) for x in (F.lit(c), F.lit(-k))))
    best = beliefs.groupBy("sig").agg(
        F.max_by("class", F.struct("logit", order[F.col("class")])).alias("verdict"),
        F.max("logit").alias("top"),
        F.sum(F.exp(F.least("logit", F.lit(30.0)))).alias("mass"),
    )
    best = written(best.select("sig", "verdict", (F.exp(F.least("top", F.lit(30.0))) / F.col("mass")).alias("confidence")), "verdicts")
    agreeing = F.when(F.col("label") == F.col("verdict"), F.col("confidence")).otherwise(
        F.when(F.col("label").isin(list(classes)), 1 - F.col("confidence")).otherwise(0.0)
    )
    per = edges.join(best, "sig").groupBy("annotator").agg(
        F.sum(F.col("n") * F.col("items")).alias("n_labels"),
        (F.sum(agreeing * F.col("n") * F.col("items")) / F.sum(F.col("n") * F.col("items"))).alias("reliability"),
    )
    return items.join(best, "sig").select("item", "verdict", "confidence"), per


def scan_streams(scans: DataFrame) -> DataFrame:
    """(scan_id, stream), once per scan_id; where rows of one scan differ, the least stream stands."""
    keyed = scans.where("scan_id is not null").select("scan_id", stream_key(F.col("repo"), F.col("application_id")).alias("stream"))
    return keyed.groupBy("scan_id").agg(F.min("stream").alias("stream"))


def vote_labels(votes: DataFrame, findings: DataFrame, scans: DataFrame, opinions: bool = True) -> DataFrame:
    """(item, annotator, label): one label per role and finding, retries once; an item is a flaw of a stream.

    A finding stays itself through the scans of its stream, so their labels come together. Reviewers and
    the validator are annotators too.
    """
    streams = scan_streams(scans)
    cast = votes.where("scan_id is not null and finding_id is not null").select(
        "scan_id", "finding_id", F.coalesce(level_word(F.col("role")), F.lit("nobody")).alias("annotator"),
        level_verdict(F.col("verdict")).alias("label"), "voted_at", "vote_id",
    )
    flaws = cast.join(streams, "scan_id", "left").select("stream", "finding_id").distinct()
    last = cast.groupBy("scan_id", "finding_id", "annotator").agg(F.max_by("label", F.struct("voted_at", "vote_id")).alias("label"))
    if opinions:
        said = findings.where("scan_id is not null and finding_id is not null").select(
            "scan_id",
            "finding_id",
            F.explode(
                F.create_map(
                    F.lit("validator"), level_verdict(F.col("validator_verdict")), F.lit("reviewer"), level_verdict(F.col("reviewer_verdict"))
                )
            ).alias("annotator", "label"),
        )
        of_flaws = said.where("label is not null").distinct().join(streams, "scan_id").join(flaws, ["stream", "finding_id"], "left_semi")
        last = last.unionByName(of_flaws.drop("stream"))
    return last.join(streams, "scan_id", "left").select(
        F.struct(F.coalesce("stream", F.concat(F.lit("scan "), "scan_id")).alias("stream"), "finding_id").alias("item"), "annotator", "label"
    )


def finding_verdicts(votes: DataFrame, findings: DataFrame, scans: DataFrame) -> DataFrame:
    """(scan_id, finding_id, verdict, confidence) for every finding with a row in votes."""
    verdicts, _ = consensus(vote_labels(votes, findings, scans))
    streams = scan_streams(scans)
    voted = votes.where("scan_id is not null and finding_id is not null").select("scan_id", "finding_id").distinct()
    keyed = voted.join(streams, "scan_id", "left").withColumn(
        "item", F.struct(F.coalesce("stream", F.concat(F.lit("scan "), "scan_id")).alias("stream"), "finding_id")
    )
    return keyed.join(verdicts, "item", "left").select(
        "scan_id", "finding_id", F.coalesce("verdict", F.lit(CLASSES[0])).alias("verdict"), F.coalesce("confidence", F.lit(0.5)).alias("confidence")
    )


def agreement(votes: DataFrame) -> DataFrame:
    """(n_findings, n_votes, observed, expected, alpha): nominal agreement of roles beyond chance.

    Over findings with two labels or more; retries count once. Null where nothing can be compared.
    """
    cast = votes.where("scan_id is not null and finding_id is not null").select(
        "scan_id", "finding_id", level_word(F.col("role")).alias("role"), level_verdict(F.col("verdict")).alias("label")
    )
    once = cast.where("label is not null").distinct().groupBy("scan_id", "finding_id", "label").agg(F.count("*").alias("c"))
    units = once.groupBy("scan_id", "finding_id").agg(F.sum("c").alias("m"), F.sum(F.col("c") * (F.col("c") - 1)).alias("same")).where("m > 1")
    observed = units.agg(
        F.count("*").alias("n_findings"), F.sum("m").alias("n_votes"), (F.sum(F.col("same") / (F.col("m") - 1)) / F.sum("m")).alias("observed")
    )
    of_units = once.join(units.select("scan_id", "finding_id"), ["scan_id", "finding_id"], "left_semi").groupBy("label").agg(F.sum("c").alias("c"))
    expected = of_units.agg(F.sum(F.col("c") * (F.col("c") - 1)).alias("same"), F.sum("c").alias("m")).select(
        (F.col("same") / (F.col("m") * (F.col("m") - 1))).alias("expected")
    )
    return observed.crossJoin(expected).withColumn("alpha", 1 - (1 - F.col("observed")) / (1 - F.col("expected")))
