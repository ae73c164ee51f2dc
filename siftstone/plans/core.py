"""Queries on the general operators, and the SQL that checks them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftstone.operators import shredding
from siftstone.operators.snapshots import snapshot_changes, snapshot_counts
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


_FACTS = f"""
facts AS (
  SELECT DISTINCT s.stream, s.seq, f.finding_id, {S.severity('f.severity')} AS severity, {S.cwe('f.cwe')} AS cwe,
         {S.path('f.path')} AS path, f.start_line
  FROM findings f JOIN snaps s USING (scan_id) WHERE f.finding_id IS NOT NULL)
"""


@query(f"""
WITH {S.SNAPSHOTS}, {_FACTS},
cur AS (SELECT * FROM facts WHERE seq > 1),
prev AS (SELECT f.* REPLACE (f.seq + 1 AS seq) FROM facts f JOIN snaps s USING (stream, seq) WHERE s.next_scan_id IS NOT NULL),
kinds AS (
  SELECT c.stream, c.seq, c.finding_id, 'added' AS change_kind FROM cur c
  WHERE NOT EXISTS (SELECT 1 FROM prev p WHERE (p.stream, p.seq, p.finding_id) = (c.stream, c.seq, c.finding_id))
  UNION
  SELECT p.stream, p.seq, p.finding_id, 'removed' FROM prev p
  WHERE NOT EXISTS (SELECT 1 FROM cur c WHERE (p.stream, p.seq, p.finding_id) = (c.stream, c.seq, c.finding_id))
  UNION
  SELECT c.stream, c.seq, c.finding_id, 'changed' FROM cur c JOIN prev p USING (stream, seq, finding_id)
  WHERE (c.severity, c.cwe, c.path, c.start_line) IS DISTINCT FROM (p.severity, p.cwe, p.path, p.start_line))
SELECT s.scan_id, k.finding_id, k.change_kind FROM kinds k JOIN snaps s USING (stream, seq)
""")
def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return snapshot_changes(table(spark, d, "findings"), table(spark, d, "scans"))


@query(f"""
WITH {S.SNAPSHOTS}, {_FACTS},
keys AS (SELECT DISTINCT stream, seq, finding_id FROM facts),
prev AS (SELECT k.stream, k.seq + 1 AS seq, k.finding_id FROM keys k JOIN snaps s USING (stream, seq) WHERE s.next_scan_id IS NOT NULL),
sides AS (SELECT stream, seq, finding_id, c.finding_id IS NOT NULL AS in_cur, p.finding_id IS NOT NULL AS in_prev
          FROM (SELECT *, 1 AS one FROM keys WHERE seq > 1) c FULL OUTER JOIN (SELECT *, 1 AS one FROM prev) p USING (stream, seq, finding_id))
SELECT s.scan_id, CAST(count(*) FILTER (in_cur AND NOT in_prev) AS BIGINT) AS n_added,
       CAST(count(*) FILTER (in_prev AND NOT in_cur) AS BIGINT) AS n_removed,
       CAST(count(*) FILTER (in_prev AND in_cur) AS BIGINT) AS n_common
FROM sides JOIN snaps s USING (stream, seq) GROUP BY s.scan_id
""")
def p3_counts(spark: SparkSession, d: str) -> DataFrame:
    return snapshot_counts(table(spark, d, "findings"), table(spark, d, "scans"))


_LISTS = S.records("findings", "scan_id, finding_id", "finding_json", "finding", S.FINDING_LISTS)
_STAGES = S.records("scans", "scan_id", "manifest_json", "manifest", {"stages": ["stages"]})
_STAGE_LISTS = f"""{_STAGES},
inner_lists AS (SELECT scan_id, list_pos AS parent_pos, CASE json_type(list) WHEN 'OBJECT' THEN json_array(list) WHEN 'ARRAY' THEN list END AS list
  FROM (SELECT *, {S.decoded("record -> '$.findings'", 1)} AS list FROM records)),
inner_places AS (SELECT scan_id, parent_pos, list, unnest(range(CAST(json_array_length(list) AS BIGINT))) AS list_pos FROM inner_lists WHERE list IS NOT NULL),
listed AS (SELECT * FROM (SELECT scan_id, parent_pos, CAST(list_pos AS INTEGER) AS list_pos, {S.decoded("json_extract(list, '$[' || list_pos || ']')", 1)} AS record FROM inner_places)
  WHERE json_type(record) = 'OBJECT')
"""


@query(f"""SELECT DISTINCT scan_id, finding_id, list_name, CAST(-1 AS INTEGER) AS parent_pos, list_pos FROM (WITH {_LISTS} SELECT * FROM records)
UNION ALL SELECT DISTINCT scan_id, '', 'stages', -1, list_pos FROM (WITH {_STAGES} SELECT * FROM records)
UNION ALL SELECT DISTINCT scan_id, '', 'findings', parent_pos, list_pos FROM (WITH {_STAGE_LISTS} SELECT * FROM listed)""")
def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return shredding.child_records(table(spark, d, "findings"), table(spark, d, "scans"))


def _entity_sql(name: str, columns: list[str]) -> str:
    picked = ", ".join(f"max({S.scalar('record', c)}) AS rec_{c}" for c in columns)
    return f"WITH {_LISTS} SELECT scan_id, finding_id, CAST(-1 AS INTEGER) AS parent_pos, list_pos, {picked} FROM records WHERE list_name = '{name}' GROUP BY ALL"


_LOCATION, _EVIDENCE = ["path", "start_line", "end_line", "snippet"], ["kind", "check", "detail"]
_STAGE = ["stage_id", "skill", "duration_seconds", "tokens_in", "tokens_out", "cost_usd", "error"]


@query(_entity_sql("locations", _LOCATION))
def p5_locations(spark: SparkSession, d: str) -> DataFrame:
    return shredding.finding_entity(table(spark, d, "findings"), "locations", _LOCATION)


@query(_entity_sql("evidence", _EVIDENCE))
def p5_evidence(spark: SparkSession, d: str) -> DataFrame:
    return shredding.finding_entity(table(spark, d, "findings"), "evidence", _EVIDENCE)


_STAGES_SQL = f"SELECT scan_id, CAST(-1 AS INTEGER) AS parent_pos, list_pos, {', '.join(f'max({S.scalar("record", c)}) AS rec_{c}' for c in _STAGE)} FROM records GROUP BY ALL"


@query(f"WITH {_STAGES} {_STAGES_SQL}")
def p5_stages(spark: SparkSession, d: str) -> DataFrame:
    return shredding.manifest_entity(table(spark, d, "scans"), "stages", _STAGE)


@query(f"""WITH {_STAGES}, t AS ({_STAGES_SQL}) SELECT rec_stage_id, CAST(count(*) AS BIGINT) AS runs, CAST(count(rec_error) AS BIGINT) AS failures,
round(sum(TRY_CAST(rec_duration_seconds AS DECIMAL(18, 6))), 3)::DOUBLE AS seconds, sum(TRY_CAST(rec_tokens_in AS DOUBLE)) AS tokens_in, sum(TRY_CAST(rec_tokens_out AS DOUBLE)) AS tokens_out,
round(sum(TRY_CAST(rec_cost_usd AS DECIMAL(18, 6))), 4)::DOUBLE AS cost FROM t GROUP BY rec_stage_id""")
def stage_metrics(spark: SparkSession, d: str) -> DataFrame:
    """Stages of all runs: how often each ran and failed, its seconds, tokens and cost."""
    number = lambda c: F.expr(f"try_cast({c} as decimal(18, 6))")
    return p5_stages(spark, d).groupBy("rec_stage_id").agg(
        F.count("*").alias("runs"), F.count("rec_error").alias("failures"), F.round(F.sum(number("rec_duration_seconds")), 3).cast("double").alias("seconds"),
        F.sum(F.expr("try_cast(rec_tokens_in as double)")).alias("tokens_in"), F.sum(F.expr("try_cast(rec_tokens_out as double)")).alias("tokens_out"),
        F.round(F.sum(number("rec_cost_usd")), 4).cast("double").alias("cost"),
    )
