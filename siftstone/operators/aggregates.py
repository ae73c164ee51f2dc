"""Votes, reliability, calibration, merging and clustering.

Every operator returns whole rows with their reason or flag; nothing is dropped silently.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftstone import catalogs as C


def severity_number(levelled: Column) -> Column:
    return F.create_map(*(x for s, n in C.SEVERITIES for x in (F.lit(s), F.lit(n))))[levelled]


def zero_filled_counts(df: DataFrame, column: str, domain: list[str]) -> DataFrame:
    """Counts of every value of ``domain``, zeros included."""
    values = df.sparkSession.createDataFrame([(v, k) for k, v in enumerate(domain)], f"{column} string, place int")
    counts = df.groupBy(column).agg(F.count("*").alias("n"))
    return values.join(counts, column, "left").select(column, "place", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def quorum(votes: DataFrame, keys: list[str], verdict: str, least: int = 2) -> DataFrame:
    """Per key, counts of verdicts and whether at least ``least`` confirm. Unknown verdicts count as uncertain."""
    v = F.coalesce(F.col(verdict), F.lit("uncertain"))
    return votes.groupBy(*keys).agg(
        F.count_if(v == "confirm").alias("confirms"), F.count_if(v == "reject").alias("rejects"), F.count_if(v == "uncertain").alias("uncertain")
    ).withColumn("kept", F.col("confirms") >= least)


def smoothed_reliability(marks: DataFrame, key: str, least: int = 2) -> DataFrame:
    """Per key, tp and fp and the smoothed share (tp + 1) / (tp + fp + 2), null below ``least`` marks."""
    counts = marks.where(F.col(key).isNotNull()).groupBy(key).agg(
        F.count_if(F.col("mark") == "TP").alias("tp"), F.count_if(F.col("mark") == "FP").alias("fp")
    )
    seen = F.col("tp") + F.col("fp")
    return counts.withColumn("reliability", F.when(seen >= least, (F.col("tp") + 1) / (seen + 2)))


def calibrated(findings: DataFrame, by_cwe: DataFrame, by_skill: DataFrame, gain: float = 0.4, most: float = 0.3, dead: float = 0.01) -> DataFrame:
    """Confidence moved by the mean reliability of class and skill, clipped; small moves are left out."""
    joined = findings.join(by_cwe.select("cwe", F.col("reliability").alias("rel_cwe")), "cwe", "left").join(
        by_skill.select("skill", F.col("reliability").alias("rel_skill")), "skill", "left"
    )
    given = F.array_compact(F.array("rel_cwe", "rel_skill"))
    mean = F.when(F.size(given) > 0, F.aggregate(given, F.lit(0.0), lambda a, x: a + x) / F.size(given))
    delta = F.greatest(F.least(gain * (mean - 0.5), F.lit(most)), F.lit(-most))  # passes over nulls, so look at the mean
    moved = F.when(mean.isNotNull() & (F.abs(delta) >= dead), delta).otherwise(0.0)
    return joined.withColumn("delta", moved).withColumn("calibrated", F.greatest(F.least(F.col("confidence") + F.col("delta"), F.lit(1.0)), F.lit(0.0)))


def merged(findings: DataFrame, bucket: list[str], key: str) -> DataFrame:
    """Findings of a bucket that overlap its first one by more than half of the longer span join it.

    The first is the most severe, then most confident, then least key. Rows need sev, confidence,
    line and last_line. Each row comes out with ``primary``: its own key, or the key it merged into.
    """
    least_key = F.struct((-F.col("sev")).alias("s"), (-F.col("confidence")).alias("c"), F.col(key).alias("k"), F.col("line").alias("a"), F.col("last_line").alias("b"))
    first = findings.groupBy(*bucket).agg(F.min(least_key).alias("p"))
    joined = findings.join(first, bucket)
    shared = F.greatest(F.least("last_line", F.col("p.b")) - F.greatest("line", F.col("p.a")) + 1, F.lit(0))
    longer = F.greatest(F.col("last_line") - F.col("line") + 1, F.col("p.b") - F.col("p.a") + 1)
    joins = (F.col(key) == F.col("p.k")) | (shared / longer > 0.5)
    return joined.withColumn("primary", F.when(joins, F.col("p.k")).otherwise(F.col(key))).drop("p")


def systemic(findings: DataFrame, keys: list[str], key: str, least: int = 5) -> DataFrame:
    """Groups of at least ``least`` findings: size, best confidence, up to ten least paths."""
    groups = findings.groupBy(*keys).agg(F.count("*").alias("size"), F.max("confidence").alias("top_confidence"), F.min(key).alias("first_id"))
    large = groups.where(F.col("size") >= least)
    paths = findings.select(*keys, "path").distinct().join(large.select(*keys), keys, "left_semi")
    # Ten least paths of each part first, so no task holds all paths of a group.
    part = F.pmod(F.xxhash64("path"), F.lit(16))
    few = paths.withColumn("part", part).withColumn("r", F.row_number().over(Window.partitionBy(*keys, "part").orderBy("path"))).where("r <= 10")
    ten = few.withColumn("r", F.row_number().over(Window.partitionBy(*keys).orderBy("path"))).where("r <= 10")
    listed = ten.groupBy(*keys).agg(F.array_join(F.array_sort(F.collect_list("path")), ";").alias("paths"))
    return large.join(listed, keys)


def bands(p: Column, reject_below: float = 0.3, confirm_from: float = 0.7) -> Column:
    return F.when(p >= confirm_from, "confirm").when(p < reject_below, "reject").otherwise("uncertain")


def platt(scored: DataFrame, rate: float = 0.5, epochs: int = 2000, least: int = 8) -> tuple[float, float, bool]:
    """(a, b, fitted) of a logistic curve on (score, label), by gradient descent from a = 1, b = 0.

    Rows are counted per distinct (score rounded to 4 places, label) before they reach the driver, which bounds them
    to about 20,000 whatever the data. Unfitted with fewer than ``least`` rows or one class.
    """
    import numpy as np

    rows = (
        scored.where("score is not null and label is not null")
        .groupBy(F.round(F.greatest(F.least("score", F.lit(1.0)), F.lit(0.0)), 4).alias("score"), F.col("label").cast("int").alias("label"))
        .agg(F.count("*").alias("n"))
        .orderBy("score", "label")
        .toPandas()
    )
    n = int(rows.n.sum())
    if n < least or rows.label.nunique() < 2:
        return 1.0, 0.0, False
    x, y, w = rows.score.to_numpy(float), rows.label.to_numpy(float), rows.n.to_numpy(float) / n
    a, b = 1.0, 0.0
    for _ in range(epochs):
        error = (1.0 / (1.0 + np.exp(-(a * x + b))) - y) * w
        a, b = a - rate * float(error @ x), b - rate * float(error.sum())
    return a, b, True
