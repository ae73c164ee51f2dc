"""Queries on the operators for training data, and the SQL that checks them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftstone.llm import consensus, credentials, entities, history, leaks, mixing, residue
from siftstone.plans import sqltext as S
from siftstone.session import table

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


_NEWEST = f"""
batch AS (
  SELECT DISTINCT f.scan_id, f.finding_id, s.started_at, {S.repo('f.repo')} AS repo, {S.tail('f.path')} AS file,
         {S.cwe('f.cwe')} AS cwe, f.start_line AS line
  FROM findings f JOIN snaps s USING (scan_id) WHERE s.next_scan_id IS NULL AND {S.path('f.path')} IS NOT NULL)
"""


@query(f"""
WITH {S.SNAPSHOTS}, {_NEWEST},
held AS (SELECT entry_id, accepted_at, {S.repo('repo')} AS repo, {S.tail('path')} AS file, {S.cwe('cwe')} AS cwe, start_line AS line
         FROM baseline_entries WHERE {S.path('path')} IS NOT NULL)
SELECT DISTINCT b.scan_id, b.finding_id, h.entry_id FROM batch b
JOIN held h ON b.repo = h.repo AND b.file = h.file AND b.cwe IS NOT DISTINCT FROM h.cwe
 AND abs(b.line - h.line) <= 10 AND h.accepted_at < b.started_at
""")
def p1_found(spark: SparkSession, d: str) -> DataFrame:
    found = history.repeated_findings(table(spark, d, "findings"), table(spark, d, "scans"), table(spark, d, "baseline_entries"))
    return found.select("scan_id", "finding_id", "entry_id")


@query()
def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return credentials.find_secrets(table(spark, d, "structural_hits")).select("hit_id")


@query()
def p2_redacted(spark: SparkSession, d: str) -> DataFrame:
    return credentials.find_secrets(table(spark, d, "structural_hits"))


_PAIRS = f"""
{S.SNAPSHOTS}, {_NEWEST},
ext AS (SELECT ext_id, {S.repo('repo')} AS repo, {S.path('path')} AS whole, {S.tail('path')} AS file, {S.cwe('cwe')} AS cwe, start_line AS line
        FROM external_findings WHERE {S.path('path')} IS NOT NULL),
pairs AS (
  SELECT DISTINCT b.scan_id, b.finding_id, e.ext_id, abs(b.line - e.line) AS line_delta FROM batch b
  JOIN ext e ON b.file = e.file AND abs(b.line - e.line) <= 3 AND (b.cwe = e.cwe OR b.cwe IS NULL OR e.cwe IS NULL)
   AND (b.repo = e.repo OR e.repo IS NULL AND list_contains(list_reverse(list_reverse(string_split(e.whole, '/'))[4:]), b.repo)))
"""


@query(f"WITH {_PAIRS} SELECT DISTINCT scan_id, finding_id, ext_id FROM pairs")
def p4_found(spark: SparkSession, d: str) -> DataFrame:
    found = entities.matching_pairs(table(spark, d, "findings"), table(spark, d, "scans"), table(spark, d, "external_findings"))
    return found.select("scan_id", "finding_id", "ext_id")


@query()
def p4_matches(spark: SparkSession, d: str) -> DataFrame:
    pairs = entities.matching_pairs(table(spark, d, "findings"), table(spark, d, "scans"), table(spark, d, "external_findings"))
    return entities.one_to_one(pairs, ["scan_id", "finding_id"], "ext_id").select(
        "scan_id", "finding_id", "ext_id", "line_delta", "confidence"
    )


@query()
def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return leaks.leaked_pairs(table(spark, d, "documents"), table(spark, d, "eval_items")).select("doc_id", "item_id")


@query()
def p7_items(spark: SparkSession, d: str) -> DataFrame:
    """Per leaked item, how many documents hold a passage of it, and the longest one."""
    pairs = leaks.leaked_pairs(table(spark, d, "documents"), table(spark, d, "eval_items"))
    return pairs.groupBy("item_id").agg(F.count("*").alias("n_documents"), F.max("n_words").alias("longest"))


@query()
def p6_found(spark: SparkSession, d: str) -> DataFrame:
    found = consensus.finding_verdicts(table(spark, d, "votes"), table(spark, d, "findings"), table(spark, d, "scans"))
    return found.select("scan_id", "finding_id", "verdict")


@query()
def p6_reliability(spark: SparkSession, d: str) -> DataFrame:
    labels = consensus.vote_labels(table(spark, d, "votes"), table(spark, d, "findings"), table(spark, d, "scans"))
    return consensus.consensus(labels)[1]


@query(r"""
WITH cast_ AS (
  SELECT DISTINCT scan_id, finding_id, regexp_replace(lower(trim(role)), '[\s\-]+', '_', 'g') AS role,
    CASE WHEN w IN ('confirm', 'confirmed', 'true positive', 'tp') THEN 'confirm' WHEN w IN ('reject', 'rejected', 'false positive', 'fp') THEN 'reject'
         WHEN w IN ('uncertain', 'unsure', 'unk') THEN 'uncertain' END AS label
  FROM (SELECT *, regexp_replace(trim(coalesce(nullif(regexp_extract(lower(verdict), '"verdict"\s*:\s*"([^"]*)"', 1), ''), lower(verdict))), '[\s_\-]+', ' ', 'g') AS w FROM votes)),
once AS (SELECT scan_id, finding_id, label, count(*) AS c FROM cast_ WHERE label IS NOT NULL GROUP BY ALL),
units AS (SELECT scan_id, finding_id, sum(c) AS m, sum(c * (c - 1)) AS same FROM once GROUP BY ALL HAVING sum(c) > 1),
o AS (SELECT CAST(count(*) AS BIGINT) AS n_findings, CAST(sum(m) AS BIGINT) AS n_votes, sum(same / (m - 1)) / sum(m) AS observed FROM units),
e AS (SELECT sum(c * (c - 1)) / (sum(c) * (sum(c) - 1)) AS expected FROM (SELECT label, sum(c) AS c FROM once SEMI JOIN units USING (scan_id, finding_id) GROUP BY label))
SELECT n_findings, n_votes, round(observed, 9) AS observed, round(expected, 9) AS expected, round(1 - (1 - observed) / (1 - expected), 9) AS alpha FROM o, e
""")
def p6_agreement(spark: SparkSession, d: str) -> DataFrame:
    got = consensus.agreement(table(spark, d, "votes"))
    return got.select("n_findings", "n_votes", *(F.round(c, 9).alias(c) for c in ("observed", "expected", "alpha")))


@query()
def p8_mix(spark: SparkSession, d: str) -> DataFrame:
    return mixing.mix_report(table(spark, d, "documents"), table(spark, d, "mix_targets"))


@query()
def p8_records(spark: SparkSession, d: str) -> DataFrame:
    return mixing.mixed_records(table(spark, d, "documents"), table(spark, d, "mix_targets"))


@query()
def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return residue.residue_documents(table(spark, d, "documents")).select("doc_id")
