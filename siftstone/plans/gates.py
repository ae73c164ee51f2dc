"""Queries on gates and reports: derived findings, demotions, caps, repeated samples and summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siftstone import catalogs as C
from siftstone.functions.levelling import level_word
from siftstone.operators import joins as J
from siftstone.operators import scoring as S
from siftstone.operators.snapshots import newest
from siftstone.plans import core
from siftstone.plans import reference as R
from siftstone.plans import sqltext as Q
from siftstone.session import table

QUERIES: dict = {}
SQL: dict[str, str] = {}
KEY = ["scan_id", "finding_id"]


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


def _json(path: str) -> Column:
    """A value of finding_json, whether or not the finding is wrapped; null where the text is no JSON."""
    value = F.coalesce(F.get_json_object("finding_json", f"$.{path}"), F.get_json_object("finding_json", f"$.finding.{path}"))
    return F.when(F.expr("try_parse_json(finding_json) is not null"), value)


def _json_sql(path: str, op: str = "->>") -> str:
    return f"CASE WHEN json_valid(finding_json) THEN CAST(coalesce(finding_json{op}'$.{path}', finding_json{op}'$.finding.{path}') AS VARCHAR) END"


@query(f"""WITH {R._LINE_HITS}, {R._HITS}, at_ AS (SELECT h.repo, h.path, h.line + l.line_no - 1 AS line, l.hit_class, l.cwe, hit_id FROM line_hits l JOIN h USING (hit_id)),
fed AS (SELECT DISTINCT repo, path FROM at_ WHERE hit_class = 'source'),
d AS (SELECT a.*, fed.path IS NOT NULL AS has_source FROM at_ a LEFT JOIN fed USING (repo, path) WHERE a.repo IS NOT NULL AND a.path IS NOT NULL AND a.line IS NOT NULL)
SELECT repo, path, line, CASE WHEN hit_class = 'secret' THEN 798 ELSE cwe END AS cwe, CASE WHEN hit_class = 'sink' AND cwe = 22 AND NOT has_source THEN 'medium' ELSE 'high' END AS severity,
 min(hit_id) AS hit_id, CAST(count(DISTINCT hit_id) AS BIGINT) AS n_hits
FROM d WHERE hit_class = 'secret' OR hit_class = 'sink' AND (cwe = 22 OR cwe = 89 AND has_source) GROUP BY ALL""")
def derived_findings(spark: SparkSession, d: str) -> DataFrame:
    """Findings that follow from patterns alone: SQL sinks in files with a request source, path sinks and secrets.

    One row per place and class, with its first hit. Hits without repository, path or line give none.
    """
    places = R._hits(spark, d).select("hit_id", "repo", "path", "line").where("repo is not null and path is not null and line is not null")
    hits = R._line_hits(spark, d).where("hit_class in ('source', 'sink', 'secret')")
    at = hits.join(places, "hit_id").withColumn("line", F.col("line") + F.col("line_no") - 1)
    fed = at.where("hit_class = 'source'").select("repo", "path").distinct().withColumn("has_source", F.lit(True))
    judged = at.where("hit_class = 'secret' or cwe in (22, 89)").where("hit_class != 'source'").join(fed, ["repo", "path"], "left")
    kept = judged.where("hit_class = 'secret' or cwe = 22 or has_source")
    open_path = (F.col("hit_class") == "sink") & (F.col("cwe") == 22) & F.col("has_source").isNull()
    return (
        kept.withColumn("severity", F.when(open_path, "medium").otherwise("high"))
        .withColumn("cwe", F.when(F.col("hit_class") == "secret", 798).otherwise(F.col("cwe")))
        .groupBy("repo", "path", "line", "cwe", "severity")
        .agg(F.min("hit_id").alias("hit_id"), F.countDistinct("hit_id").alias("n_hits"))
    )


def squeezed(text: Column) -> Column:
    return F.lower(F.regexp_replace(text, r"\s+", ""))


def quote_grounded(quote: Column, source: Column, least: int = 8) -> Column:
    """Whether a quotation of at least ``least`` letters stands in a source, blanks and case aside; false for nulls."""
    q = squeezed(quote)
    return F.coalesce((F.length(q) >= least) & F.contains(squeezed(source), q), F.lit(False))


_SNIPPETS = Q.records("findings", "scan_id, finding_id", "finding_json", "finding", {"locations": Q.FINDING_LISTS["locations"]})
_SQUEEZE = "lower(regexp_replace({}, '\\s+', '', 'g'))"


@query(f"""WITH {Q.LATEST_JSON}, q AS (SELECT scan_id, finding_id, {_json_sql('taint.sink')} AS quote FROM f),
t AS (SELECT scan_id, finding_id, bool_or(contains({_SQUEEZE.format(Q.scalar('record', 'snippet'))}, {_SQUEEZE.format('quote')})) AS held
  FROM q JOIN (WITH {_SNIPPETS} SELECT * FROM records) USING (scan_id, finding_id) WHERE quote IS NOT NULL GROUP BY ALL)
SELECT scan_id, finding_id, quote, coalesce(length({_SQUEEZE.format('quote')}) >= 8 AND held, false) AS grounded FROM q LEFT JOIN t USING (scan_id, finding_id) WHERE quote IS NOT NULL""")
def quoted_sinks(spark: SparkSession, d: str) -> DataFrame:
    """Whether the sink that a finding names stands in a snippet of one of its locations."""
    f = R.levelled_findings(spark, d, "finding_json").select(*KEY, _json("taint.sink").alias("quote")).where("quote is not null")
    lines = core.shredding.finding_entity(table(spark, d, "findings"), "locations", ["snippet"]).select(*KEY, "rec_snippet")
    held = f.join(lines, KEY).groupBy(*KEY).agg(F.bool_or(quote_grounded(F.col("quote"), F.col("rec_snippet"))).alias("held"))
    return f.join(held, KEY, "left").select(*KEY, "quote", F.coalesce("held", F.lit(False)).alias("grounded"))


# The next lower severity.
DEMOTED = {"critical": "high", "high": "medium", "medium": "low", "low": "informational", "informational": "informational"}


def demoted(severity: Column) -> Column:
    return F.coalesce(*(F.when(severity == a, b) for a, b in DEMOTED.items()))


_PROVEN = f"""trim(coalesce(payload, '')) <> '' AND NOT ({" OR ".join(R._re("payload", p) for p in C.PLACEHOLDER_SIGNS)}) AND ({" OR ".join(R._re("payload", p) for p in C.CONCRETE_SIGNS)})"""


@query(f"""WITH {Q.LATEST_JSON}, q AS (SELECT scan_id, finding_id, severity, {_json_sql('poc.payload')} AS payload, coalesce({_json_sql('tags', '->')}, '') AS tags FROM f),
p AS (SELECT *, contains(tags, '"deterministic"') AS fixed, coalesce({_PROVEN}, false) AS proven FROM q)
SELECT scan_id, finding_id, severity, CASE WHEN proven OR fixed THEN severity ELSE CASE severity {" ".join(f"WHEN '{a}' THEN '{b}'" for a, b in DEMOTED.items())} END END AS gated_severity,
 CASE WHEN proven THEN 'proven' WHEN fixed THEN 'deterministic' ELSE 'missing_poc' END AS reason FROM p""")
def proof_gate(spark: SparkSession, d: str) -> DataFrame:
    """Findings without a concrete proof go down one severity, unless found by patterns alone."""
    f = R.levelled_findings(spark, d, "severity", "finding_json").select(*KEY, "severity", S.is_concrete(_json("poc.payload")).alias("proven"), F.contains(F.coalesce(_json("tags"), F.lit("")), F.lit('"deterministic"')).alias("fixed"))
    kept = F.col("proven") | F.col("fixed")
    reason = F.when(F.col("proven"), "proven").when(F.col("fixed"), "deterministic").otherwise("missing_poc")
    return f.select(*KEY, "severity", F.when(kept, F.col("severity")).otherwise(demoted(F.col("severity"))).alias("gated_severity"), reason.alias("reason"))


@query(f"""WITH {Q.LATEST_JSON}, q AS (SELECT scan_id, finding_id, confidence, validator, coalesce({_json_sql('tags', '->')}, '') AS tags FROM f),
v AS (SELECT *, CASE WHEN contains(tags, '"hallucinated') THEN 'reject' WHEN contains(tags, '"deterministic"') THEN 'confirm' ELSE coalesce(validator, 'uncertain') END AS ruled FROM q)
SELECT scan_id, finding_id, ruled, CASE WHEN ruled = 'uncertain' THEN least(confidence, 0.6) ELSE confidence END AS confidence FROM v WHERE ruled <> 'reject'""")
def validator_gate(spark: SparkSession, d: str) -> DataFrame:
    """Findings the validator lets pass; those found by patterns pass unasked, uncertain ones keep at most 0.6."""
    tags = F.coalesce(_json("tags"), F.lit(""))
    ruled = (
        F.when(F.contains(tags, F.lit('"hallucinated')), "reject")
        .when(F.contains(tags, F.lit('"deterministic"')), "confirm")
        .otherwise(F.coalesce("validator", F.lit("uncertain")))
    )
    f = R.levelled_findings(spark, d, "confidence", "validator", "finding_json").select(*KEY, "confidence", ruled.alias("ruled")).where("ruled != 'reject'")
    capped = F.when((F.col("ruled") == "uncertain") & (F.col("confidence") > 0.6), 0.6).otherwise(F.col("confidence"))
    return f.select(*KEY, "ruled", capped.alias("confidence"))


@query(f"""WITH {R._SIGNAL_ROWS}, g AS (SELECT s.scan_id, s.finding_id, s.grounded, f.confidence FROM s JOIN f USING (scan_id, finding_id))
SELECT scan_id, finding_id, grounded, CASE WHEN grounded THEN confidence ELSE least(confidence, 0.5) END AS confidence FROM g WHERE confidence IS NOT NULL""")
def weak_evidence_cap(spark: SparkSession, d: str) -> DataFrame:
    """Confidence of findings whose evidence has no snippet that matched, held at 0.5."""
    f = R.levelled_findings(spark, d, "confidence").where("confidence is not null")
    matched = core.shredding.finding_entity(table(spark, d, "findings"), "evidence", ["kind", "check"]).where("rec_kind = 'snippet_match' and rec_check = 'pass'")
    g = f.join(matched.select(*KEY).distinct().withColumn("matched", F.lit(True)), KEY, "left").withColumn("grounded", F.coalesce("matched", F.lit(False)))
    return g.select(*KEY, "grounded", F.when(F.col("grounded"), F.col("confidence")).otherwise(F.least("confidence", F.lit(0.5))).alias("confidence"))


@query(f"""WITH {Q.LATEST} SELECT repo, regexp_extract(path, '^([^/]+)', 1) AS module, CAST(count(*) AS BIGINT) AS findings, CAST(count(DISTINCT path) AS BIGINT) AS files,
CAST(count(DISTINCT cwe) AS BIGINT) AS classes, CAST(count(*) FILTER (severity IN ('critical', 'high')) AS BIGINT) AS severe FROM f WHERE path IS NOT NULL GROUP BY ALL""")
def module_counts(spark: SparkSession, d: str) -> DataFrame:
    """Findings, files and classes by repository and first part of the path."""
    f = R.levelled_findings(spark, d, "repo", "path", "cwe", "severity").where("path is not null").withColumn("module", F.substring_index("path", "/", 1))
    return f.groupBy("repo", "module").agg(
        F.count("*").alias("findings"), F.countDistinct("path").alias("files"), F.countDistinct("cwe").alias("classes"), F.count_if(F.col("severity").isin("critical", "high")).alias("severe")
    )


@query(f"""WITH t AS (SELECT {Q.word('lang')} AS lang, CAST(strlen(text) AS BIGINT) AS bytes FROM documents WHERE text IS NOT NULL)
SELECT lang, CAST(count(*) AS BIGINT) AS documents, CAST(sum(bytes) AS BIGINT) AS bytes, round(sum(bytes) / (SELECT sum(bytes) FROM t), 6) AS share FROM t GROUP BY lang""")
def language_mix(spark: SparkSession, d: str) -> DataFrame:
    """Documents, bytes and share of all bytes by stated language."""
    t = table(spark, d, "documents").where("text is not null").select(level_word(F.col("lang")).alias("lang"), F.octet_length("text").cast("long").alias("bytes"))
    by = t.groupBy("lang").agg(F.count("*").alias("documents"), F.sum("bytes").alias("bytes"))
    total = by.agg(F.sum("bytes").alias("total"))
    return by.crossJoin(F.broadcast(total)).select("lang", "documents", "bytes", F.round(F.try_divide(F.col("bytes"), F.col("total")), 6).alias("share"))


@query(f"""WITH {R._EXT}, k AS (SELECT * FROM e WHERE ext_repo IS NOT NULL AND file IS NOT NULL AND other_line IS NOT NULL AND tool IS NOT NULL),
n AS (SELECT a.ext_id, CAST(count(DISTINCT b.tool) AS BIGINT) AS tools FROM k a JOIN k b ON a.ext_repo = b.ext_repo AND a.file = b.file
 AND abs(a.other_line - b.other_line) <= 3 AND (a.ext_cwe = b.ext_cwe OR a.ext_cwe IS NULL OR b.ext_cwe IS NULL) GROUP BY a.ext_id)
SELECT ext_id, tools, tools >= 2 AS consistent FROM n""")
def consistent_reports(spark: SparkSession, d: str) -> DataFrame:
    """How many scanners report each row's place, and whether at least two agree.

    Rows of one place, class and scanner come together before the join, so repeated uploads cost nothing.
    """
    place = ["repo", "file", "line", "cwe"]
    e = R._external(spark, d).select("ext_id", "tool", F.col("ext_repo").alias("repo"), "file", F.col("other_line").alias("line"), F.col("ext_cwe").alias("cwe"))
    known = e.where("repo is not null and file is not null and line is not null and tool is not null")
    left = known.select(*place).distinct()
    right = known.select("repo", "file", F.col("line").alias("other_line"), F.col("cwe").alias("other_cwe"), "tool").distinct()
    same = (F.col("cwe") == F.col("other_cwe")) | F.col("cwe").isNull() | F.col("other_cwe").isNull()
    counts = J.near_pairs(left, right, ["repo", "file"], 3, same).groupBy(*place).agg(F.countDistinct("tool").alias("tools"))
    back = counts.select(F.col("repo").alias("r"), F.col("file").alias("f"), F.col("line").alias("l"), F.col("cwe").alias("c"), "tools")
    at = (F.col("repo") == F.col("r")) & (F.col("file") == F.col("f")) & (F.col("line") == F.col("l")) & F.col("cwe").eqNullSafe(F.col("c"))
    return known.join(back, at).select("ext_id", "tools", (F.col("tools") >= 2).alias("consistent"))


@query(f"WITH p AS ({R.SQL['scanner_precision']}) SELECT tool, precision_, recall_, precision_ >= median(precision_) OVER () AS precise, recall_ >= median(recall_) OVER () AS enough, precision_ >= median(precision_) OVER () AND recall_ >= median(recall_) OVER () AS passed FROM p")
def threshold_gate(spark: SparkSession, d: str) -> DataFrame:
    """Scanners against the median precision and recall of all scanners."""
    p = R.scanner_precision(spark, d)
    least = p.agg(F.median("precision_").alias("least_precision"), F.median("recall_").alias("least_recall"))
    precise, enough = F.col("precision_") >= F.col("least_precision"), F.col("recall_") >= F.col("least_recall")
    both = p.crossJoin(F.broadcast(least))  # one row
    return both.select("tool", "precision_", "recall_", precise.alias("precise"), enough.alias("enough"), (precise & enough).alias("passed"))


@query(f"""WITH k AS (SELECT sha256(concat(coalesce({Q.word('role')}, ''), chr(0), coalesce(model, ''), chr(0), coalesce(rationale, ''))) AS call_key, vote_id FROM votes)
SELECT call_key, CAST(count(*) AS BIGINT) AS calls, min(vote_id) AS first_vote FROM k GROUP BY call_key HAVING count(*) > 1""")
def reused_calls(spark: SparkSession, d: str) -> DataFrame:
    """Votes that a cache keyed by role, model and text would have answered: keys used more than once."""
    parts = [F.coalesce(c, F.lit("")) for c in (level_word(F.col("role")), F.col("model"), F.col("rationale"))]
    keyed = table(spark, d, "votes").select(F.sha2(F.concat_ws("\0", *parts), 256).alias("call_key"), "vote_id")
    return keyed.groupBy("call_key").agg(F.count("*").alias("calls"), F.min("vote_id").alias("first_vote")).where("calls > 1")


@query(f"""WITH {Q.SNAPSHOTS}, {Q.LATEST}, n AS (SELECT scan_id FROM snaps WHERE next_scan_id IS NULL),
c AS (SELECT f.scan_id, f.severity, {Q.SEV_NUM} AS place, count(*) AS n FROM f JOIN n USING (scan_id) WHERE f.severity IS NOT NULL GROUP BY ALL)
SELECT scan_id, CAST(sum(n) AS BIGINT) AS findings, string_agg('| ' || severity || ' | ' || n || ' |', chr(10) ORDER BY place DESC) AS severity_table FROM c GROUP BY scan_id""")
def comment_tables(spark: SparkSession, d: str) -> DataFrame:
    """For the newest snapshot of each stream, the table of severities that a comment on it shows."""
    current = newest(table(spark, d, "scans")).select("scan_id")
    f = R.levelled_findings(spark, d, "severity").where("severity is not null").join(current, "scan_id", "left_semi")
    counts = f.groupBy("scan_id", "severity").agg(F.count("*").alias("n")).withColumn("place", R.A.severity_number(F.col("severity")))
    row = F.format_string("| %s | %d |", "severity", "n")
    rows = F.reverse(F.sort_array(F.collect_list(F.struct("place", row.alias("row")))))
    return counts.groupBy("scan_id").agg(F.sum("n").alias("findings"), F.array_join(F.transform(rows, lambda r: r["row"]), "\n").alias("severity_table"))


def _stage_findings(spark: SparkSession, d: str) -> DataFrame:
    """(scan_id, stage, finding_id): findings that the stages of a manifest list, by the place of the stage."""
    rows = core.shredding.manifest_entity(table(spark, d, "scans"), "findings", ["id"])
    return rows.where("rec_id is not null").select("scan_id", F.col("parent_pos").alias("stage"), F.col("rec_id").alias("finding_id")).distinct()


_STAGE_FINDINGS = f"""{core._STAGE_LISTS},
stage_findings AS (SELECT DISTINCT scan_id, CAST(parent_pos AS INTEGER) AS stage, {Q.scalar('record', 'id')} AS finding_id FROM listed WHERE {Q.scalar('record', 'id')} IS NOT NULL)
"""


@query(f"""WITH {_STAGE_FINDINGS}, n AS (SELECT scan_id, stage, CAST(count(*) AS BIGINT) AS n_findings FROM stage_findings GROUP BY ALL)
SELECT scan_id, max(stage) AS stage, max_by(n_findings, stage) AS n_findings FROM n GROUP BY scan_id""")
def last_listing_stage(spark: SparkSession, d: str) -> DataFrame:
    """Per scan the last stage that lists findings, and how many."""
    by = _stage_findings(spark, d).groupBy("scan_id", "stage").agg(F.count("*").alias("n"))
    return by.groupBy("scan_id").agg(F.max("stage").alias("stage"), F.max_by("n", "stage").alias("n_findings"))


@query(f"""WITH {_STAGE_FINDINGS}, listed_ AS (SELECT scan_id, finding_id, min(stage) AS first_stage, max(stage) AS last_stage FROM stage_findings GROUP BY ALL),
ends AS (SELECT scan_id, max(last_stage) AS final_stage FROM listed_ GROUP BY scan_id),
held AS (SELECT DISTINCT scan_id, finding_id FROM findings WHERE scan_id IS NOT NULL AND finding_id IS NOT NULL)
SELECT coalesce(l.scan_id, h.scan_id) AS scan_id, coalesce(l.finding_id, h.finding_id) AS finding_id, first_stage, last_stage,
 CASE WHEN l.last_stage < e.final_stage THEN 'dropped_between_stages' WHEN h.scan_id IS NULL THEN 'listed_only' WHEN l.scan_id IS NULL THEN 'delivered_only' ELSE 'kept' END AS state
FROM listed_ l LEFT JOIN ends e USING (scan_id) FULL OUTER JOIN (SELECT h.* FROM held h SEMI JOIN ends USING (scan_id)) h ON h.scan_id = l.scan_id AND h.finding_id = l.finding_id""")
def recovered_drops(spark: SparkSession, d: str) -> DataFrame:
    """Findings of each scan with a manifest by what became of them: kept, listed by a stage and lacking in the last listing one, listed
    and never delivered, or delivered though no stage lists them; with the first and last stage that had them.
    """
    listed = _stage_findings(spark, d).groupBy(*KEY).agg(F.min("stage").alias("first_stage"), F.max("stage").alias("last_stage"))
    ends = listed.groupBy("scan_id").agg(F.max("last_stage").alias("final_stage"))
    held = table(spark, d, "findings").where("scan_id is not null and finding_id is not null").select(*KEY).distinct().join(ends.select("scan_id"), "scan_id", "left_semi")
    both = listed.join(ends, "scan_id").join(held.withColumn("held", F.lit(True)), KEY, "full_outer")
    state = (
        F.when(F.col("last_stage") < F.col("final_stage"), "dropped_between_stages")
        .when(F.col("held").isNull(), "listed_only").when(F.col("first_stage").isNull(), "delivered_only").otherwise("kept")
    )
    return both.select(*KEY, "first_stage", "last_stage", state.alias("state"))
