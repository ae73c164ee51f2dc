"""Exports: flat files, SARIF documents and severity tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftstone.operators.scoring import redacted

# Levels and scores by severity.
SARIF_LEVELS = {"critical": "error", "high": "error", "medium": "warning", "low": "note", "informational": "note"}


def write_flat(df: DataFrame, path: str, kind: str = "csv") -> None:
    """Flat rows as CSV with a header or as JSON lines; lists joined by semicolons, text redacted."""
    flat = df.select(*(F.array_join(c, ";").alias(c) if t.startswith("array") else redacted(F.col(c)).alias(c) if t == "string" else F.col(c) for c, t in df.dtypes))
    writer = flat.write.mode("overwrite")
    writer.option("header", True).csv(path) if kind == "csv" else writer.json(path)


def sarif_results(findings: DataFrame) -> DataFrame:
    """(scan_id, result): one SARIF result per finding with a path as JSON text, redacted. Rows of a scan are written beside each
    other, so a document is the rules and results of one scan; no scan is gathered into one value."""
    place = F.struct(F.struct(F.struct(F.col("path").alias("uri")).alias("artifactLocation"), F.struct(F.col("start_line").alias("startLine")).alias("region")).alias("physicalLocation"))
    return _sarif(findings.where("path is not null"), F.array(place))


def sarif_unlocated(findings: DataFrame) -> DataFrame:
    """(scan_id, result): the results of findings without a path; their list of locations is empty."""
    return _sarif(findings.where("path is null"), F.array().cast("array<string>"))


def _sarif(findings: DataFrame, locations: Column) -> DataFrame:
    level = F.create_map(*(F.lit(x) for kv in SARIF_LEVELS.items() for x in kv))
    result = F.struct(
        F.coalesce(F.col("cwe"), F.lit("unknown")).alias("ruleId"),
        F.coalesce(level[F.col("severity")], F.lit("note")).alias("level"),
        F.struct(redacted(F.col("title")).alias("text")).alias("message"),
        locations.alias("locations"),
    )
    return findings.select("scan_id", F.to_json(result).alias("result"))


def sarif_rules(findings: DataFrame) -> DataFrame:
    """(scan_id, rule): one rule per class of a scan; its text is the least title."""
    rules = findings.groupBy("scan_id", F.coalesce("cwe", F.lit("unknown")).alias("id")).agg(F.min("title").alias("title"))
    return rules.select("scan_id", F.to_json(F.struct("id", F.struct(F.col("title").alias("text")).alias("shortDescription"))).alias("rule"))


def write_partitioned(df: DataFrame, path: str, by: str) -> None:
    """One folder per value of ``by``; a value with many rows spreads over files."""
    df.write.mode("overwrite").partitionBy(by).parquet(path)
