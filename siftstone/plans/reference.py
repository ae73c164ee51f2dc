"""Queries on the record-processing operators: index, joins, gates, votes, scores, merging and exports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siftstone import catalogs as C
from siftstone.functions.levelling import level_cwe, level_path, level_repo, level_severity, level_verdict, level_word, path_tail
from siftstone.operators import aggregates as A
from siftstone.operators import index as X
from siftstone.operators import joins as J
from siftstone.operators import scoring as S
from siftstone.operators import shredding
from siftstone.operators.snapshots import newest, snapshots
from siftstone.operators.store import latest_rows
from siftstone.plans import sqltext as Q
from siftstone.sinks.export import sarif_results, sarif_unlocated
from siftstone.sources.files import byte_budget
from siftstone.session import spread, table, written

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


#: What levelled findings can hold, by the raw column it is made of.
_RAW = {
    "repo": "repo", "severity": "severity", "cwe": "cwe", "path": "path", "file": "path", "line": "start_line", "skill": "skill", "confidence": "confidence",
    "validator": "validator_verdict", "reviewer": "reviewer_verdict", "reviewer_at": "reviewer_at", "finding_json": "finding_json", "title": "title",
    "cvss_score": "cvss_score", "cvss_vector": "cvss_vector",
}


def levelled_findings(spark: SparkSession, d: str, *wanted: str) -> DataFrame:
    """One row per (scan_id, finding_id), the last recorded, with the levelled columns that are ``wanted``; no other column is read
    but those that tell which row is the last.
    """
    order = ["recorded_at", "path", "cwe", "severity"]
    if "finding_json" in wanted:
        order.insert(1, "finding_json")
    raw = list(dict.fromkeys(["scan_id", "finding_id", *(_RAW[w] for w in wanted)]))
    rows = table(spark, d, "findings").where("scan_id is not null and finding_id is not null")
    kept = latest_rows(rows, ["scan_id", "finding_id"], order, raw)
    level = {
        "repo": lambda: level_repo(F.col("repo")), "severity": lambda: level_severity(F.col("severity")), "cwe": lambda: level_cwe(F.col("cwe")),
        "path": lambda: level_path(F.col("path")), "file": lambda: F.substring_index(level_path(F.col("path")), "/", -1), "line": lambda: F.col("start_line").cast("long"),
        "skill": lambda: level_word(F.col("skill")), "validator": lambda: level_verdict(F.col("validator_verdict")), "reviewer": lambda: level_verdict(F.col("reviewer_verdict")),
    }
    return kept.select("scan_id", "finding_id", *(level[w]().alias(w) if w in level else F.col(w) for w in wanted))


def _hits(spark: SparkSession, d: str) -> DataFrame:
    path = level_path(F.col("path"))
    return table(spark, d, "structural_hits").select(
        "hit_id", level_repo(F.col("repo")).alias("repo"), path.alias("path"), F.substring_index(path, "/", -1).alias("file"),
        F.col("line").cast("long").alias("line"), "kind", "pattern_id", level_cwe(F.col("cwe_hint")).alias("cwe"), "reachable_from_source", "snippet",
    )


_HITS = f"""
h AS (SELECT hit_id, {Q.repo('repo')} AS repo, {Q.path('path')} AS path, regexp_extract({Q.path('path')}, '([^/]*)$', 1) AS file,
      CAST(line AS BIGINT) AS line, kind, pattern_id, {Q.cwe('cwe_hint')} AS cwe, reachable_from_source FROM structural_hits)
"""


def _external(spark: SparkSession, d: str) -> DataFrame:
    path = level_path(F.col("path"))
    return table(spark, d, "external_findings").select(
        "ext_id", level_word(F.col("tool")).alias("tool"), "rule_id", level_repo(F.col("repo")).alias("ext_repo"), path.alias("ext_path"),
        F.substring_index(path, "/", -1).alias("file"), F.col("start_line").cast("long").alias("other_line"), level_cwe(F.col("cwe")).alias("ext_cwe"),
        F.col("end_line").cast("long").alias("ext_end"), level_severity(F.col("severity")).alias("ext_severity"),
    )


_EXT = f"""
e AS (SELECT ext_id, {Q.word('tool')} AS tool, rule_id, {Q.repo('repo')} AS ext_repo, {Q.path('path')} AS ext_path,
      regexp_extract({Q.path('path')}, '([^/]*)$', 1) AS file, CAST(start_line AS BIGINT) AS other_line, {Q.cwe('cwe')} AS ext_cwe,
      CAST(end_line AS BIGINT) AS ext_end, {Q.severity('severity')} AS ext_severity FROM external_findings)
"""


def _pattern_sql() -> str:
    rows = []
    for hit_class, kind, cwe, p in X.catalogue():
        unless = C.UNLESS_FOLLOWED.get(kind, "a^")
        texts = ", ".join("'" + t.replace("'", "''") + "'" for t in (hit_class, kind, p, unless))
        rows.append(f"({texts}, {'NULL' if cwe is None else cwe})")
    return "patterns(hit_class, kind, pattern, unless_, cwe) AS (VALUES " + ",\n".join(rows) + ")"


_LINES = r"""
numbered AS (SELECT hit_id, i AS line_no, string_split(snippet, chr(10))[i] AS line_text
  FROM structural_hits, unnest(range(1, len(string_split(snippet, chr(10))) + 1)) AS r(i) WHERE snippet IS NOT NULL),
code AS (SELECT * FROM numbered WHERE NOT regexp_matches(line_text, '^\s*(#|//|/\*|<!--)'))
"""
_LINE_HITS = f"""{_LINES}, {_pattern_sql()},
line_hits AS (SELECT DISTINCT hit_id, CAST(line_no AS INTEGER) AS line_no, p.hit_class, p.kind, CAST(p.cwe AS INTEGER) AS cwe FROM code c JOIN patterns p
  ON regexp_matches(c.line_text, p.pattern) AND NOT regexp_matches(c.line_text, p.unless_))
"""


def _lines(spark: SparkSession, d: str) -> DataFrame:
    return X.lines(spread(table(spark, d, "structural_hits").select("hit_id", "snippet")), ["hit_id"], "snippet")


def _line_hits(spark: SparkSession, d: str) -> DataFrame:
    return X.line_hits(_lines(spark, d)).drop("line_text")


@query(f"WITH {_LINE_HITS} SELECT * FROM line_hits")
def line_index(spark: SparkSession, d: str) -> DataFrame:
    return _line_hits(spark, d)


@query(f"WITH {_LINE_HITS} SELECT hit_class, kind, CAST(count(*) AS BIGINT) AS n FROM line_hits GROUP BY ALL")
def index_counts(spark: SparkSession, d: str) -> DataFrame:
    return _line_hits(spark, d).groupBy("hit_class", "kind").agg(F.count("*").alias("n"))


@query(f"""WITH {_LINE_HITS} SELECT hit_id, line_no, hit_class, kind, cwe, CAST(rank AS INTEGER) AS rank
FROM (SELECT *, row_number() OVER (PARTITION BY hit_class ORDER BY hit_id, line_no, kind) AS rank FROM line_hits) WHERE rank <= 40""")
def index_top_per_class(spark: SparkSession, d: str) -> DataFrame:
    return X.top_per_class(_line_hits(spark, d), ["hit_id", "line_no"])


@query(rf"""WITH {_LINES} SELECT hit_id, CAST(line_no AS INTEGER) AS line_no, route FROM (SELECT hit_id, line_no, substr(coalesce(
  {", ".join("nullif(regexp_extract(line_text, '" + p.replace("'", "''") + "', " + str(2 if p.count("(") - p.count(r"\(") > 1 else 1) + "), '')" for _, p in C.ROUTES)}
  ), 1, 200) AS route FROM code) WHERE route IS NOT NULL""")
def route_values(spark: SparkSession, d: str) -> DataFrame:
    return X.route_values(_lines(spark, d)).select("hit_id", "line_no", "route")


@query(f"""WITH {_LINE_HITS}, s AS (SELECT DISTINCT hit_id, line_no FROM line_hits WHERE hit_class = 'secret')
SELECT s.hit_id, s.line_no, string_agg(n.line_text, chr(10) ORDER BY n.line_no) AS window FROM s JOIN numbered n
ON n.hit_id = s.hit_id AND abs(n.line_no - s.line_no) <= 5 GROUP BY ALL""")
def context_windows(spark: SparkSession, d: str) -> DataFrame:
    numbered = _lines(spark, d)
    around = X.line_hits(numbered).where("hit_class = 'secret'").select("hit_id", "line_no").distinct()
    return X.context(numbered, ["hit_id"], around)


@query(f"""WITH {Q.LATEST} SELECT scan_id, finding_id, repo, severity, cwe, path, line, skill, confidence, validator, reviewer FROM f""")
def upsert_latest(spark: SparkSession, d: str) -> DataFrame:
    return levelled_findings(spark, d, "repo", "severity", "cwe", "path", "line", "skill", "confidence", "validator", "reviewer")


@query(f"""WITH {Q.LATEST}, dim(severity, place) AS (VALUES ('critical', 0), ('high', 1), ('medium', 2), ('low', 3), ('informational', 4))
SELECT d.severity, d.place, CAST(count(f.scan_id) AS BIGINT) AS n FROM dim d LEFT JOIN f ON f.severity = d.severity AND f.reviewer = 'confirm' GROUP BY ALL""")
def severity_counts(spark: SparkSession, d: str) -> DataFrame:
    confirmed = levelled_findings(spark, d, "severity", "reviewer").where("reviewer = 'confirm'")
    return A.zero_filled_counts(confirmed, "severity", [s for s, _ in C.SEVERITIES])


@query(f"""WITH {Q.LATEST} SELECT CAST(count(*) FILTER (validator = 'confirm') AS BIGINT) AS confirmed, CAST(count(*) FILTER (reviewer IS NOT NULL) AS BIGINT) AS reviewed,
CAST(count(*) FILTER (severity IN ('critical', 'high')) AS BIGINT) AS severe, CAST(count(*) AS BIGINT) AS n, repo FROM f GROUP BY repo""")
def conditional_counts(spark: SparkSession, d: str) -> DataFrame:
    return levelled_findings(spark, d, "repo", "validator", "reviewer", "severity").groupBy("repo").agg(
        F.count_if(F.col("validator") == "confirm").alias("confirmed"), F.count_if(F.col("reviewer").isNotNull()).alias("reviewed"),
        F.count_if(F.col("severity").isin("critical", "high")).alias("severe"), F.count("*").alias("n"),
    )


@query(f"""WITH {Q.LATEST} SELECT scan_id, finding_id, severity, confidence FROM f ORDER BY (validator = 'confirm') DESC NULLS LAST,
{Q.SEV_NUM} DESC NULLS LAST, confidence DESC NULLS LAST, scan_id, finding_id LIMIT 100""")
def triage_top(spark: SparkSession, d: str) -> DataFrame:
    """The hundred findings to look at first."""
    f = levelled_findings(spark, d, "severity", "validator", "confidence")
    order = [(F.col("validator") == "confirm").desc_nulls_last(), A.severity_number(F.col("severity")).desc_nulls_last(), F.col("confidence").desc_nulls_last(), "scan_id", "finding_id"]
    return f.orderBy(*order).limit(100).select("scan_id", "finding_id", "severity", "confidence")


@query(f"""WITH {Q.LATEST} SELECT scan_id, finding_id, reviewer, reviewer_at FROM f WHERE reviewer_at IS NOT NULL
ORDER BY reviewer_at DESC, scan_id, finding_id LIMIT 50""")
def newest_feedback(spark: SparkSession, d: str) -> DataFrame:
    """The fifty newest marks of reviewers."""
    f = levelled_findings(spark, d, "reviewer", "reviewer_at").where("reviewer_at is not null")
    return f.orderBy(F.desc("reviewer_at"), "scan_id", "finding_id").limit(50).select("scan_id", "finding_id", "reviewer", "reviewer_at")


def _marks(f: DataFrame) -> DataFrame:
    return f.withColumn("mark", F.when(F.col("reviewer") == "confirm", "TP").when(F.col("reviewer") == "reject", "FP")).where("mark is not null")


@query(f"""WITH {Q.LATEST}, m AS (SELECT *, CASE reviewer WHEN 'confirm' THEN 'TP' WHEN 'reject' THEN 'FP' END AS mark FROM f),
keyed AS (SELECT 'cwe' AS dimension, CAST(cwe AS VARCHAR) AS value, mark FROM m UNION ALL SELECT 'skill', skill, mark FROM m)
SELECT dimension, value, CAST(count(*) FILTER (mark = 'TP') AS BIGINT) AS tp, CAST(count(*) FILTER (mark = 'FP') AS BIGINT) AS fp,
CASE WHEN count(*) >= 2 THEN (count(*) FILTER (mark = 'TP') + 1) / (count(*) + 2) END AS reliability
FROM keyed WHERE mark IS NOT NULL AND value IS NOT NULL GROUP BY ALL""")
def reliability(spark: SparkSession, d: str) -> DataFrame:
    marks = _marks(levelled_findings(spark, d, "cwe", "skill", "reviewer")).withColumn("cwe", F.col("cwe").cast("string"))
    both = [A.smoothed_reliability(marks, k).withColumnRenamed(k, "value").withColumn("dimension", F.lit(k)) for k in ("cwe", "skill")]
    return both[0].unionByName(both[1])


@query(f"""WITH {Q.LATEST}, m AS (SELECT *, CASE reviewer WHEN 'confirm' THEN 'TP' WHEN 'reject' THEN 'FP' END AS mark FROM f),
c AS (SELECT cwe, CASE WHEN count(*) >= 2 THEN (count(*) FILTER (mark = 'TP') + 1) / (count(*) + 2) END AS r FROM m WHERE mark IS NOT NULL AND cwe IS NOT NULL GROUP BY cwe),
s AS (SELECT skill, CASE WHEN count(*) >= 2 THEN (count(*) FILTER (mark = 'TP') + 1) / (count(*) + 2) END AS r FROM m WHERE mark IS NOT NULL AND skill IS NOT NULL GROUP BY skill),
j AS (SELECT f.*, CASE WHEN c.r IS NULL THEN s.r WHEN s.r IS NULL THEN c.r ELSE (c.r + s.r) / 2 END AS mean FROM f LEFT JOIN c USING (cwe) LEFT JOIN s USING (skill)),
x AS (SELECT *, greatest(least(0.4 * (mean - 0.5), 0.3), -0.3) AS raw FROM j)
SELECT scan_id, finding_id, round(greatest(least(confidence + CASE WHEN mean IS NOT NULL AND abs(raw) >= 0.01 THEN raw ELSE 0 END, 1.0), 0.0), 9) AS calibrated FROM x WHERE confidence IS NOT NULL""")
def calibrate_confidence(spark: SparkSession, d: str) -> DataFrame:
    every = levelled_findings(spark, d, "cwe", "skill", "confidence", "reviewer")
    marks = _marks(every)
    moved = A.calibrated(every.where("confidence is not null"), A.smoothed_reliability(marks, "cwe"), A.smoothed_reliability(marks, "skill"))
    return moved.select("scan_id", "finding_id", F.round("calibrated", 9).alias("calibrated"))


@query(f"""WITH v AS (SELECT DISTINCT scan_id, finding_id, {Q.word('role')} AS role, {Q.verdict('verdict')} AS verdict FROM votes)
SELECT scan_id, finding_id, CAST(count(*) FILTER (verdict = 'confirm') AS BIGINT) AS confirms, CAST(count(*) FILTER (verdict = 'reject') AS BIGINT) AS rejects,
CAST(count(*) FILTER (coalesce(verdict, 'uncertain') = 'uncertain') AS BIGINT) AS uncertain, count(*) FILTER (verdict = 'confirm') >= 2 AS kept FROM v GROUP BY ALL""")
def quorum_vote(spark: SparkSession, d: str) -> DataFrame:
    v = table(spark, d, "votes").select("scan_id", "finding_id", level_word(F.col("role")).alias("role"), level_verdict(F.col("verdict")).alias("verdict")).distinct()
    return A.quorum(v, ["scan_id", "finding_id"], "verdict")


@query(f"""WITH {Q.LATEST_JSON}, r AS (SELECT *, CASE WHEN json_valid(finding_json) THEN nullif(coalesce(finding_json->>'$.remediation', finding_json->>'$.finding.remediation'), '') END IS NOT NULL AS remedied FROM f)
SELECT scan_id, finding_id, CASE WHEN coalesce({Q.SEV_NUM}, 0) < 2 THEN 'below_floor'
 WHEN {" OR ".join(f"contains(path, '{p}')" for p in C.TEST_PARTS)} THEN 'test_path'
 WHEN {" OR ".join(f"contains(path, '{p}')" for p in C.VENDOR_PARTS)} THEN 'vendor_path'
 WHEN NOT coalesce(remedied, false) THEN 'no_remediation' END AS drop_reason FROM r""")
def gate_reasons(spark: SparkSession, d: str) -> DataFrame:
    """Every finding with the first gate it fails, null where it passes all."""
    f = levelled_findings(spark, d, "severity", "path", "finding_json")
    has = lambda parts: F.coalesce(F.greatest(*(F.contains("path", F.lit(p)) for p in parts)), F.lit(False))
    remedy = F.nullif(F.coalesce(F.get_json_object("finding_json", "$.remediation"), F.get_json_object("finding_json", "$.finding.remediation")), F.lit(""))
    valid = F.expr("try_parse_json(finding_json) is not null")
    reason = (
        F.when(F.coalesce(A.severity_number(F.col("severity")), F.lit(0)) < 2, "below_floor")
        .when(has(C.TEST_PARTS), "test_path")
        .when(has(C.VENDOR_PARTS), "vendor_path")
        .when(~F.coalesce(valid & remedy.isNotNull(), F.lit(False)), "no_remediation")
    )
    return f.select("scan_id", "finding_id", reason.alias("drop_reason"))


_CORROBORATED = f"""{Q.LATEST}, {_EXT},
near AS (SELECT f.scan_id, f.finding_id, e.ext_id, e.tool, abs(f.line - e.other_line) AS line_delta FROM f JOIN e
  ON f.repo = e.ext_repo AND f.file = e.file AND abs(f.line - e.other_line) <= 3 AND (f.cwe = e.ext_cwe OR f.cwe IS NULL OR e.ext_cwe IS NULL)),
best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY scan_id, finding_id ORDER BY line_delta, ext_id) AS rn FROM near) WHERE rn = 1)
"""


def _corroborated(spark: SparkSession, d: str) -> DataFrame:
    """Per finding the nearest scanner row of its repository, file name and class within three lines."""
    known = "repo is not null and file is not null"
    f = levelled_findings(spark, d, "repo", "file", "line", "cwe").where(known).where("line is not null")
    e = _external(spark, d).withColumnRenamed("ext_repo", "repo").where(known).where("other_line is not null").select("ext_id", "tool", "repo", "file", "other_line", "ext_cwe")
    pairs = J.near_pairs(f, e, ["repo", "file"], 3, F.expr("cwe = ext_cwe or cwe is null or ext_cwe is null"))
    return J.nearest(pairs, ["scan_id", "finding_id"], ["line_delta", "ext_id"], ["line_delta", "ext_id", "tool"])


@query(f"WITH {_CORROBORATED} SELECT scan_id, finding_id, ext_id, tool, line_delta FROM best")
def corroborate_nearest(spark: SparkSession, d: str) -> DataFrame:
    return _corroborated(spark, d)


@query(f"""WITH {_CORROBORATED} SELECT tool, CAST(count(*) AS BIGINT) AS n FROM best GROUP BY tool""")
def tool_counts(spark: SparkSession, d: str) -> DataFrame:
    return _corroborated(spark, d).groupBy("tool").agg(F.count("*").alias("n"))


@query(f"""WITH {Q.LATEST}, {_HITS}, {_EXT}, inventory AS (SELECT repo, file, line FROM h UNION SELECT ext_repo, file, other_line FROM e)
SELECT scan_id, finding_id, EXISTS (SELECT 1 FROM inventory i WHERE i.repo = f.repo AND i.file = f.file AND abs(i.line - f.line) <= 2) AS cited FROM f""")
def closed_set_citation(spark: SparkSession, d: str) -> DataFrame:
    """Whether a finding cites a place of the inventory of its repository (hits and scanner rows), two lines more or less."""
    f = levelled_findings(spark, d, "repo", "file", "line")
    known = "repo is not null and file is not null"
    places = _hits(spark, d).select("repo", "file", "line").unionByName(_external(spark, d).select(F.col("ext_repo").alias("repo"), "file", F.col("other_line").alias("line")))
    inventory = places.where(known).where("line is not null").withColumnRenamed("line", "other_line").distinct()
    near = J.near_pairs(f.where(known).where("line is not null"), inventory, ["repo", "file"], 2).select("scan_id", "finding_id").distinct().withColumn("cited", F.lit(True))
    return f.select("scan_id", "finding_id").join(near, ["scan_id", "finding_id"], "left").na.fill(False, ["cited"])


_PLACES = Q.records("findings", "scan_id, finding_id", "finding_json", "finding", {"locations": Q.FINDING_LISTS["locations"]})


@query(f"""WITH {Q.LATEST}, {_EXT}, own AS (SELECT * FROM f WHERE skill IS DISTINCT FROM 'deterministic_detector'),
more AS (SELECT o.scan_id, o.finding_id, o.repo, o.cwe, {Q.path(Q.scalar('record', 'path'))} AS path, TRY_CAST({Q.scalar('record', 'start_line')} AS BIGINT) AS line
  FROM own o JOIN (WITH {_PLACES} SELECT * FROM records) USING (scan_id, finding_id)),
places AS (SELECT scan_id, finding_id, repo, cwe, path, line FROM own UNION ALL SELECT * FROM more),
tails AS (SELECT *, array_to_string(list_reverse(list_reverse(string_split(path, '/'))[1:3]), '/') AS tail FROM places),
told AS (SELECT ext_repo, array_to_string(list_reverse(list_reverse(string_split(ext_path, '/'))[1:3]), '/') AS tail, ext_cwe, other_line FROM e),
near AS (SELECT t.scan_id, t.finding_id FROM tails t JOIN told ON t.repo = told.ext_repo AND t.tail = told.tail AND t.cwe = told.ext_cwe AND abs(t.line - told.other_line) <= 3
  UNION SELECT p.scan_id, p.finding_id FROM places p JOIN f g ON g.skill = 'deterministic_detector' AND g.scan_id = p.scan_id AND g.path = p.path AND g.cwe = p.cwe AND abs(g.line - p.line) <= 3)
SELECT scan_id, finding_id FROM own ANTI JOIN near USING (scan_id, finding_id)""")
def anti_near_duplicate(spark: SparkSession, d: str) -> DataFrame:
    """Findings of lenses, their skill known or not, that no detector finding of the scan and no scanner row of the repository, of their
    class, is near at any of their locations.
    """
    key = ["scan_id", "finding_id"]
    f = levelled_findings(spark, d, "repo", "cwe", "path", "line", "skill")
    own = f.where("not (skill <=> 'deterministic_detector')")
    listed = shredding.finding_entity(table(spark, d, "findings"), "locations", ["path", "start_line"]).select(
        *key, level_path(F.col("rec_path")).alias("path"), F.expr("try_cast(rec_start_line as bigint)").alias("line")
    )
    more = listed.join(own.select(*key, "repo", "cwe"), key)
    places = own.drop("skill").unionByName(more).where("cwe is not null and path is not null and line is not null").withColumn("tail", path_tail(F.col("path")))
    det = f.where("skill = 'deterministic_detector' and line is not null").select("scan_id", "path", "cwe", F.col("line").alias("other_line"))
    told = _external(spark, d).where("ext_repo is not null and other_line is not null").select(
        F.col("ext_repo").alias("repo"), path_tail(F.col("ext_path")).alias("tail"), F.col("ext_cwe").alias("cwe"), "other_line"
    ).distinct()
    near = J.near_pairs(places, det, ["scan_id", "path", "cwe"], 3).select(*key).unionByName(J.near_pairs(places, told, ["repo", "tail", "cwe"], 3).select(*key)).distinct()
    return own.select(*key).join(near, key, "left_anti")


@query(f"""WITH {Q.LATEST}, {_HITS}, p AS (SELECT f.scan_id, f.finding_id, h.hit_id, NOT coalesce(h.reachable_from_source, false) AS unreached, abs(h.line - f.line) AS line_delta
FROM f JOIN h ON f.repo = h.repo AND f.file = h.file AND f.cwe = h.cwe WHERE h.line IS NOT NULL AND f.line IS NOT NULL)
SELECT scan_id, finding_id, hit_id, unreached, line_delta FROM (SELECT *, row_number() OVER (PARTITION BY scan_id, finding_id ORDER BY unreached, line_delta, hit_id) AS rn FROM p) WHERE rn = 1""")
def nearest_hit(spark: SparkSession, d: str) -> DataFrame:
    """Per finding, the hit of its repository, class and file name that is reached from a source, else nearest."""
    by = ["repo", "file", "cwe"]
    known = "repo is not null and file is not null and cwe is not null and line is not null"
    f = levelled_findings(spark, d, *by, "line").where(known).select(F.struct("scan_id", "finding_id").alias("key"), *by, "line")
    h = _hits(spark, d).where(known).select("hit_id", *by, "line", (~F.coalesce("reachable_from_source", F.lit(False))).alias("unreached"))
    best = J.nearest_either_side(f, h, "key", by, "unreached", "hit_id")
    return best.select("key.scan_id", "key.finding_id", "hit_id", "unreached", "line_delta")


@query(f"""WITH {Q.LATEST}, {_HITS}, {_EXT}, ex AS (SELECT DISTINCT ext_id, tool, rule_id, ext_repo AS repo, ext_path AS path, other_line AS line, ext_cwe FROM e),
own AS (SELECT repo, path, line, hit_id, CAST(NULL AS VARCHAR) AS finding, cwe FROM h WHERE pattern_id = 'sink' UNION ALL SELECT repo, path, line, NULL, scan_id || ' ' || finding_id, cwe FROM f),
n AS (SELECT repo, path, line, max(hit_id) AS hit_id, max(finding) AS finding, coalesce(max_by(cwe, hit_id) FILTER (hit_id IS NOT NULL), max(cwe) FILTER (hit_id IS NULL)) AS cwe FROM own
 WHERE repo IS NOT NULL AND path IS NOT NULL AND line IS NOT NULL GROUP BY ALL),
places AS (SELECT repo, path, line FROM n UNION SELECT repo, path, line FROM ex WHERE repo IS NOT NULL AND path IS NOT NULL AND line IS NOT NULL),
parts AS (SELECT *, string_split(path, '/') AS p FROM ex WHERE repo IS NULL AND path IS NOT NULL AND line IS NOT NULL),
cand AS (SELECT parts.* EXCLUDE (repo, path, p), k, {Q.repo('p[k]')} AS repo, array_to_string(p[k + 1:], '/') AS path FROM parts, unnest(range(1, len(p) + 1)) AS r(k)),
fit AS (SELECT ext_id, max(k) AS k FROM cand SEMI JOIN places USING (repo, path, line) GROUP BY ext_id),
x0 AS (SELECT ext_id, tool, rule_id, ext_cwe, repo, path, line FROM ex WHERE repo IS NOT NULL AND path IS NOT NULL AND line IS NOT NULL
 UNION ALL SELECT ext_id, tool, rule_id, ext_cwe, repo, path, line FROM cand JOIN fit USING (ext_id, k)),
x AS (SELECT repo, path, line, string_agg(DISTINCT concat_ws(':', tool, rule_id), ';' ORDER BY concat_ws(':', tool, rule_id)) AS tools, min_by(ext_cwe, ext_id) FILTER (ext_cwe IS NOT NULL) AS ext_cwe FROM x0 GROUP BY ALL)
SELECT repo, path, line, n.hit_id, n.finding, coalesce(n.cwe, x.ext_cwe) AS cwe, x.tools, CASE WHEN n.repo IS NULL THEN 'added' WHEN x.tools IS NULL THEN 'native' ELSE 'corroborated' END AS origin FROM n FULL OUTER JOIN x USING (repo, path, line)
UNION ALL SELECT DISTINCT repo, path, line, hit_id, finding, cwe, NULL, 'native' FROM own WHERE repo IS NULL OR path IS NULL OR line IS NULL
UNION ALL SELECT repo, path, line, NULL, NULL, ext_cwe, concat_ws(':', tool, rule_id), 'added' FROM ex WHERE path IS NULL OR line IS NULL OR (repo IS NULL AND ext_id NOT IN (SELECT ext_id FROM fit))""")
def merge_sources(spark: SparkSession, d: str) -> DataFrame:
    """Sinks, findings and scanner rows as one set of places: matches corroborate, the rest is added.

    A scanner row without repo takes place and repo from its path where a known place fits. Rows that still lack a
    part of the place can't be compared and come out one by one, with the part null.
    """
    place = ["repo", "path", "line"]
    known = "repo is not null and path is not null and line is not null"
    unknown = "repo is null or path is null or line is null"
    sinks = _hits(spark, d).where("pattern_id = 'sink'").select(*place, "hit_id", F.lit(None).cast("string").alias("finding"), "cwe")
    found = levelled_findings(spark, d, *place, "cwe").select(*place, F.lit(None).cast("long").alias("hit_id"), F.concat_ws(" ", "scan_id", "finding_id").alias("finding"), "cwe")
    own = written(sinks.unionByName(found), "own-places")
    is_hit = F.col("hit_id").isNotNull()
    n = own.where(known).groupBy(*place).agg(
        F.max("hit_id").alias("hit_id"), F.max("finding").alias("finding"), F.coalesce(F.max_by("cwe", "hit_id"), F.max(F.when(~is_hit, F.col("cwe")))).alias("cwe"), F.lit(True).alias("own")
    )
    e = _external(spark, d).withColumnsRenamed({"ext_repo": "repo", "ext_path": "path", "other_line": "line"}).select("ext_id", "tool", "rule_id", *place, "ext_cwe")
    places = n.select(*place).unionByName(e.where(known).select(*place)).distinct()
    placed = _placed_by_path(e.where("repo is null and path is not null and line is not null"), places)
    x = e.where(known).unionByName(placed.where(known)).groupBy(*place).agg(
        F.array_join(F.array_sort(F.collect_set(F.concat_ws(":", "tool", "rule_id"))), ";").alias("tools"),
        F.min_by("ext_cwe", F.when(F.col("ext_cwe").isNotNull(), F.col("ext_id"))).alias("ext_cwe"),
    )
    alone = own.where(unknown).distinct().withColumns({"tools": F.lit(None).cast("string"), "origin": F.lit("native")})
    rest = e.where("path is null or line is null").distinct().unionByName(placed.where(unknown))
    added = rest.select(
        *place, F.lit(None).cast("long").alias("hit_id"), F.lit(None).cast("string").alias("finding"), F.col("ext_cwe").alias("cwe"), F.concat_ws(":", "tool", "rule_id").alias("tools"), F.lit("added").alias("origin")
    )
    origin = F.when(F.col("own").isNull(), "added").when(F.col("tools").isNull(), "native").otherwise("corroborated")
    both = n.join(x, place, "full_outer").select(*place, "hit_id", "finding", F.coalesce("cwe", "ext_cwe").alias("cwe"), "tools", origin.alias("origin"))
    return both.unionByName(alone).unionByName(added)


def _placed_by_path(rows: DataFrame, places: DataFrame) -> DataFrame:
    """Distinct ``rows`` without repo; where a part of the path names a repo that has the rest of it as a place, with that repo and rest.

    The last such part counts. Rows that fit no place stay as they are.
    """
    parts = F.split("path", "/")
    split = rows.withColumn("k", F.explode(F.sequence(F.lit(1), F.size(parts))))
    named = split.withColumns({"fit_repo": level_repo(F.element_at(parts, F.col("k"))), "fit_path": F.array_join(F.slice(parts, F.col("k") + 1, F.size(parts)), "/")})
    fitting = places.select(F.col("repo").alias("fit_repo"), F.col("path").alias("fit_path"), "line", F.lit(True).alias("fits"))
    best = F.max(F.when(F.col("fits"), F.struct("k", "fit_repo", "fit_path"))).alias("best")
    found = named.join(fitting, ["fit_repo", "fit_path", "line"], "left").groupBy(*rows.columns).agg(best)
    return found.withColumns({"repo": F.col("best.fit_repo"), "path": F.coalesce("best.fit_path", "path")}).drop("best")


@query(f"""WITH {_HITS}, s AS (SELECT DISTINCT repo, path, regexp_replace(path, '/?[^/]*$', '') AS folder FROM h WHERE pattern_id IN ('source', 'route')),
k AS (SELECT hit_id, repo, path, regexp_replace(path, '/?[^/]*$', '') AS folder FROM h WHERE pattern_id = 'sink')
SELECT hit_id, CASE WHEN EXISTS (SELECT 1 FROM s WHERE s.repo = k.repo AND s.path = k.path) THEN 'file' WHEN EXISTS (SELECT 1 FROM s WHERE s.repo = k.repo AND s.folder = k.folder) THEN 'folder' ELSE 'none' END AS reach FROM k""")
def reachable_sinks(spark: SparkSession, d: str) -> DataFrame:
    """How near a source or route stands to each sink: in its file, in its folder, or nowhere there."""
    h = _hits(spark, d).withColumn("folder", F.regexp_replace("path", "/?[^/]*$", ""))
    fed = h.where("pattern_id in ('source', 'route')")
    files = fed.select("repo", "path").distinct().withColumn("in_file", F.lit(True))
    folders = fed.select("repo", "folder").distinct().withColumn("in_folder", F.lit(True))
    sinks = h.where("pattern_id = 'sink'").join(files, ["repo", "path"], "left").join(folders, ["repo", "folder"], "left")
    return sinks.select("hit_id", F.when(F.col("in_file"), "file").when(F.col("in_folder"), "folder").otherwise("none").alias("reach"))


_PRINT = "substr(sha256('CWE-' || coalesce(CAST(cwe AS VARCHAR), 'UNK') || '|' || path || '|' || CAST(line AS VARCHAR) || '|' || coalesce(skill, '')), 1, 16)"


@query(f"""WITH {Q.LATEST}, b AS (SELECT {Q.cwe('cwe')} AS cwe, {Q.path('path')} AS path, CAST(start_line AS BIGINT) AS line, {Q.word('skill')} AS skill FROM baseline_entries),
held AS (SELECT DISTINCT {_PRINT} AS fingerprint FROM b WHERE path IS NOT NULL AND line IS NOT NULL)
SELECT scan_id, finding_id, {_PRINT} AS fingerprint FROM f WHERE path IS NOT NULL AND line IS NOT NULL AND {_PRINT} NOT IN (SELECT fingerprint FROM held)
UNION ALL SELECT scan_id, finding_id, NULL FROM f WHERE path IS NULL OR line IS NULL""")
def baseline_anti(spark: SparkSession, d: str) -> DataFrame:
    """Findings whose fingerprint no accepted entry has. Those without path or line have none and are kept."""

    def printed(df: DataFrame) -> DataFrame:
        parts = F.concat_ws("|", F.concat(F.lit("CWE-"), F.coalesce(F.col("cwe").cast("string"), F.lit("UNK"))), "path", F.col("line").cast("string"), F.coalesce("skill", F.lit("")))
        return df.where("path is not null and line is not null").withColumn("fingerprint", F.substring(F.sha2(parts, 256), 1, 16))

    b = table(spark, d, "baseline_entries").select(
        level_cwe(F.col("cwe")).alias("cwe"), level_path(F.col("path")).alias("path"), F.col("start_line").cast("long").alias("line"), level_word(F.col("skill")).alias("skill")
    )
    f = levelled_findings(spark, d, "path", "line", "cwe", "skill")
    kept = printed(f).select("scan_id", "finding_id", "fingerprint").join(printed(b).select("fingerprint"), "fingerprint", "left_anti").select("scan_id", "finding_id", "fingerprint")
    return kept.unionByName(f.where("path is null or line is null").select("scan_id", "finding_id", F.lit(None).cast("string").alias("fingerprint")))


_TAIL = "array_to_string(list_reverse(list_reverse(string_split({}, '/'))[1:3]), '/')"
_MERGE_ROWS = f"""{Q.SNAPSHOTS}, {Q.LATEST}, {_EXT}, newest AS (SELECT scan_id FROM snaps WHERE next_scan_id IS NULL),
ends AS (SELECT scan_id, finding_id, max(TRY_CAST({Q.scalar('record', 'end_line')} AS BIGINT)) AS end_line FROM (WITH {_PLACES} SELECT * FROM records) WHERE list_pos = 0 GROUP BY ALL),
all_rows AS (SELECT 'finding ' || f.scan_id || ' ' || f.finding_id AS key, repo, {_TAIL.format('path')} AS tail, coalesce(CAST(cwe AS VARCHAR), 'UNK') AS cwe_key, line,
  greatest(coalesce(end_line, line), line) AS last_line, coalesce({Q.SEV_NUM}, 0) AS sev, coalesce(confidence, 0) AS confidence, skill AS reporter
  FROM f SEMI JOIN newest USING (scan_id) LEFT JOIN ends USING (scan_id, finding_id)
 UNION SELECT 'report ' || ext_id, ext_repo, {_TAIL.format('ext_path')}, coalesce(CAST(ext_cwe AS VARCHAR), 'UNK'), other_line, greatest(coalesce(ext_end, other_line), other_line),
  coalesce({Q.SEV_NUM.replace('severity', 'ext_severity')}, 0), 0, tool FROM e),
whole_rows AS (SELECT * FROM all_rows WHERE repo IS NOT NULL AND tail IS NOT NULL AND line IS NOT NULL)"""


@query(f"""WITH {_MERGE_ROWS},
p AS (SELECT * FROM (SELECT repo, tail, cwe_key, key AS p_key, line AS a, last_line AS b, row_number() OVER (PARTITION BY repo, tail, cwe_key ORDER BY sev DESC, confidence DESC, key) AS rn FROM whole_rows) WHERE rn = 1),
j AS (SELECT r.*, CASE WHEN r.key = p.p_key OR greatest(least(last_line, b) - greatest(line, a) + 1, 0) / greatest(last_line - line + 1, b - a + 1) > 0.5 THEN p.p_key ELSE r.key END AS primary_key
 FROM whole_rows r JOIN p USING (repo, tail, cwe_key))
SELECT primary_key, CAST(count(*) AS BIGINT) AS merged, max(confidence) AS confidence, CAST(max(sev) AS INTEGER) AS sev, coalesce(string_agg(DISTINCT reporter, ';' ORDER BY reporter), '') AS reported_by FROM j GROUP BY repo, tail, cwe_key, primary_key
UNION ALL SELECT key, 1, confidence, CAST(sev AS INTEGER), coalesce(reporter, '') FROM all_rows WHERE repo IS NULL OR tail IS NULL OR line IS NULL""")
def merge_overlapping(spark: SparkSession, d: str) -> DataFrame:
    """Findings of newest snapshots and scanner rows, merged into the first of their repository, file and class where they overlap it by
    more than half of the longer span: how many came together, their best severity and confidence, and who reported them.

    A finding spans its first location up to its end. Rows without a whole place overlap none and are their own primary.
    """
    key = ["scan_id", "finding_id"]
    last = newest(table(spark, d, "scans")).select("scan_id")
    f = levelled_findings(spark, d, "repo", "path", "cwe", "line", "severity", "confidence", "skill").join(last, "scan_id", "left_semi")
    ends = shredding.finding_entity(table(spark, d, "findings"), "locations", ["end_line"]).where("list_pos = 0").select(*key, F.expr("try_cast(rec_end_line as bigint)").alias("end_line"))
    shape = lambda key, repo, path, cwe, line, end, severity, confidence, reporter: [
        key.alias("key"), F.col(repo).alias("repo"), path_tail(F.col(path)).alias("tail"), F.coalesce(F.col(cwe).cast("string"), F.lit("UNK")).alias("cwe_key"), F.col(line).alias("line"),
        F.greatest(F.col(end), F.col(line)).alias("last_line"), F.coalesce(A.severity_number(F.col(severity)), F.lit(0)).alias("sev"), confidence.alias("confidence"), F.col(reporter).alias("reporter"),
    ]
    found = f.join(ends, key, "left").select(
        *shape(F.concat(F.lit("finding "), F.concat_ws(" ", *key)), "repo", "path", "cwe", "line", "end_line", "severity", F.coalesce("confidence", F.lit(0.0)), "skill")
    )
    told = _external(spark, d).where("ext_id is not null").select(
        *shape(F.concat(F.lit("report "), F.col("ext_id").cast("string")), "ext_repo", "ext_path", "ext_cwe", "other_line", "ext_end", "ext_severity", F.lit(0.0), "tool")
    )
    every = written(found.unionByName(told.distinct()), "merge-rows")
    bucket = ["repo", "tail", "cwe_key"]
    joined = A.merged(every.where("repo is not null and tail is not null and line is not null"), bucket, "key")
    together = joined.groupBy(*bucket, F.col("primary").alias("primary_key")).agg(
        F.count("*").alias("merged"), F.max("confidence").alias("confidence"), F.max("sev").alias("sev"), F.array_join(F.array_sort(F.collect_set("reporter")), ";").alias("reported_by")
    ).drop(*bucket)
    alone = every.where("repo is null or tail is null or line is null")
    return together.unionByName(alone.select(F.col("key").alias("primary_key"), F.lit(1).cast("long").alias("merged"), "confidence", "sev", F.coalesce("reporter", F.lit("")).alias("reported_by")))


_LEVELS = ["critical", "high", "medium", "low", "informational"]


@query(f"""WITH {Q.LATEST}, r AS (SELECT repo, cwe, split_part(path, '/', 1) AS module, path, severity, {Q.SEV_NUM} AS sev, confidence, scan_id || ' ' || finding_id AS key,
 path IS NOT NULL AND cwe IS NOT NULL AND repo IS NOT NULL AS whole FROM f),
g AS (SELECT repo, cwe, module, CAST(count(*) AS BIGINT) AS size, max(confidence) AS top_confidence, min(key) AS first_id, max_by(severity, sev) AS severity FROM r WHERE whole GROUP BY ALL HAVING count(*) >= 5),
p AS (SELECT repo, cwe, module, array_to_string(list_sort(list(path))[1:10], ';') AS paths FROM (SELECT DISTINCT repo, cwe, module, path FROM r WHERE whole) GROUP BY ALL)
SELECT g.*, p.paths, 'C-' || first_id AS cluster_id, 'parent' AS kind FROM g JOIN p USING (repo, cwe, module)
UNION ALL BY NAME SELECT r.repo, r.cwe, r.module, CAST(1 AS BIGINT) AS size, r.confidence AS top_confidence, r.key AS first_id, r.path AS paths,
 CASE WHEN g.first_id IS NULL THEN r.severity ELSE CASE r.severity WHEN 'critical' THEN 'high' WHEN 'high' THEN 'medium' WHEN 'medium' THEN 'low' WHEN 'low' THEN 'informational' ELSE r.severity END END AS severity,
 'C-' || g.first_id AS cluster_id, CASE WHEN g.first_id IS NULL THEN 'untouched' ELSE 'child' END AS kind FROM r LEFT JOIN g ON r.whole AND g.repo = r.repo AND g.cwe = r.cwe AND g.module = r.module""")
def systemic_clusters(spark: SparkSession, d: str) -> DataFrame:
    """Clusters as parents, their findings as children, a level of severity lower, and all other findings untouched.

    A parent has the best severity of its children. Rows of findings have their own confidence, key and path.
    """
    keys = ["repo", "cwe", "module"]
    narrow = levelled_findings(spark, d, "repo", "cwe", "path", "severity", "confidence").select(
        "repo", "cwe", F.substring_index("path", "/", 1).alias("module"), "path", "severity", "confidence", F.concat_ws(" ", "scan_id", "finding_id").alias("key")
    )
    f = written(narrow, "clustered")
    whole = "path is not null and cwe is not null and repo is not null"
    rows = f.where(whole)
    best = rows.groupBy(*keys).agg(F.max_by("severity", A.severity_number(F.col("severity"))).alias("severity"))
    parents = A.systemic(rows.drop("severity"), keys, "key").join(best, keys)
    named = parents.withColumns({"cluster_id": F.concat(F.lit("C-"), "first_id"), "kind": F.lit("parent")})
    marked = rows.join(named.select(*keys, "cluster_id"), keys, "left").unionByName(f.where(f"not ({whole})").withColumn("cluster_id", F.lit(None).cast("string")))
    lower = F.create_map(*(F.lit(x) for pair in zip(_LEVELS, [*_LEVELS[1:], _LEVELS[-1]]) for x in pair))
    child = F.col("cluster_id").isNotNull()
    findings = marked.select(
        *keys, F.lit(1).cast("long").alias("size"), F.col("confidence").alias("top_confidence"), F.col("key").alias("first_id"), F.col("path").alias("paths"),
        F.when(child, F.coalesce(lower[F.col("severity")], "severity")).otherwise(F.col("severity")).alias("severity"), "cluster_id", F.when(child, "child").otherwise("untouched").alias("kind"),
    )
    return named.unionByName(findings)


@query(f"""WITH {Q.LATEST} SELECT scan_id, bool_or(cwe = 79) AND bool_or(cwe = 352) AS chained, CAST(count(*) FILTER (cwe IN (79, 352)) AS BIGINT) AS n FROM f
GROUP BY scan_id HAVING bool_or(cwe = 79) OR bool_or(cwe = 352)""")
def cooccurring_classes(spark: SparkSession, d: str) -> DataFrame:
    f = levelled_findings(spark, d, "cwe").where("cwe in (79, 352)")
    return f.groupBy("scan_id").agg((F.bool_or(F.col("cwe") == 79) & F.bool_or(F.col("cwe") == 352)).alias("chained"), F.count("*").alias("n"))


def _case(table_: dict[str, float], x: str) -> str:
    return "CASE " + x + "".join(f" WHEN '{k}' THEN CAST({v} AS DOUBLE)" for k, v in table_.items()) + " END"


@query(f"""WITH {Q.LATEST}, {_HITS}, defaults(cwe, d_av, d_ui, s, c, i, a) AS (VALUES {", ".join(str(r) for r in C.CVSS_DEFAULTS)}),
routes AS (SELECT DISTINCT repo, path FROM h WHERE pattern_id = 'route' AND repo IS NOT NULL AND path IS NOT NULL),
m AS (SELECT f.scan_id, f.finding_id, CASE WHEN r.path IS NOT NULL THEN 'N' WHEN coalesce(d_av, 'N') <> 'N' THEN d_av ELSE 'L' END AS av,
  coalesce(d_ui, 'N') AS ui, coalesce(s, 'U') AS s, coalesce(c, 'L') AS c, coalesce(i, 'L') AS i, coalesce(a, 'N') AS a
  FROM f LEFT JOIN routes r ON f.repo = r.repo AND f.path = r.path LEFT JOIN defaults d ON f.cwe = d.cwe),
w AS (SELECT *, 1 - (1 - {_case(C.CVSS_CIA, 'c')}) * (1 - {_case(C.CVSS_CIA, 'i')}) * (1 - {_case(C.CVSS_CIA, 'a')}) AS loss,
  CAST(8.22 AS DOUBLE) * {_case(C.CVSS_AV, 'av')} * CAST(0.77 AS DOUBLE) * CAST(0.85 AS DOUBLE) * {_case(C.CVSS_UI, 'ui')} AS ease FROM m),
t AS (SELECT *, CASE WHEN s = 'C' THEN CAST(7.52 AS DOUBLE) * (loss - CAST(0.029 AS DOUBLE)) - CAST(3.25 AS DOUBLE) * pow(loss - CAST(0.02 AS DOUBLE), 15) ELSE CAST(6.42 AS DOUBLE) * loss END AS impact FROM w)
SELECT scan_id, finding_id, 'CVSS:3.1/AV:' || av || '/AC:L/PR:N/UI:' || ui || '/S:' || s || '/C:' || c || '/I:' || i || '/A:' || a AS vector,
CASE WHEN impact <= 0 THEN 0.0 ELSE ceil(round(least(CASE WHEN s = 'C' THEN CAST(1.08 AS DOUBLE) * (impact + ease) ELSE impact + ease END, 10.0) * 10, 9)) / 10 END AS score FROM t""")
def cvss_scores(spark: SparkSession, d: str) -> DataFrame:
    """Vector and score from class defaults; a file with a route is reached over the network."""
    f = levelled_findings(spark, d, "cwe", "repo", "path")
    routes = _hits(spark, d).where("pattern_id = 'route'").select("repo", "path").distinct().withColumn("routed", F.lit(True))
    joined = f.join(routes, ["repo", "path"], "left")
    vector, score = S.cvss(F.col("cwe"), F.coalesce("routed", F.lit(False)), F.lit(False), F.lit(False))
    return joined.select("scan_id", "finding_id", vector.alias("vector"), score.alias("score"))


def _proofs(spark: SparkSession, d: str) -> DataFrame:
    payload = F.coalesce(F.get_json_object("finding_json", "$.poc.payload"), F.get_json_object("finding_json", "$.finding.poc.payload"))
    valid = F.expr("try_parse_json(finding_json) is not null")
    return levelled_findings(spark, d, "cwe", "finding_json").select("scan_id", "finding_id", "cwe", F.when(valid, payload).alias("payload")).where("payload is not null")


_PROOFS = f"""{Q.LATEST_JSON}, q AS (SELECT scan_id, finding_id, cwe, CASE WHEN json_valid(finding_json) THEN coalesce(finding_json->>'$.poc.payload', finding_json->>'$.finding.poc.payload') END AS payload FROM f)"""


def _re(x: str, p: str) -> str:
    return f"regexp_matches({x}, '" + p.replace("'", "''") + "')"


@query(f"""WITH {_PROOFS} SELECT scan_id, finding_id, payload, trim(payload) <> '' AND NOT ({" OR ".join(_re("payload", p) for p in C.PLACEHOLDER_SIGNS)})
AND ({" OR ".join(_re("payload", p) for p in C.CONCRETE_SIGNS)}) AS concrete FROM q WHERE payload IS NOT NULL""")
def concrete_proofs(spark: SparkSession, d: str) -> DataFrame:
    return _proofs(spark, d).select("scan_id", "finding_id", "payload", S.is_concrete(F.col("payload")).alias("concrete"))


@query(f"""WITH h0 AS (SELECT hit_id, {Q.cwe('cwe_hint')} AS cwe, trim(snippet) AS p FROM structural_hits WHERE snippet IS NOT NULL)
SELECT hit_id, cwe, CASE WHEN p = '' THEN false WHEN cwe = 89 THEN {_re("p", C.SQL_TAUTOLOGY)} OR {_re("p", C.SQL_STACKED)} OR {_re("p", C.SQL_UNION)} OR {_re("p", C.SQL_COMMENT)} AND {_re("p", C.SQL_BREAKOUT)}
 WHEN cwe = 78 THEN {_re("p", C.SHELL_META)} AND {_re("p", C.SHELL_VERB)}
 WHEN cwe = 22 THEN {_re("p", C.PATH_TARGET)} OR len(regexp_extract_all(p, '{C.PATH_HOP}')) >= 2
 WHEN cwe = 918 THEN regexp_extract(p, '{C.URL_HOST}', 1) <> '' AND regexp_matches(regexp_extract(p, '{C.URL_HOST}', 1), '{C.INTERNAL_HOST}')
 WHEN cwe = 79 THEN {_re("p", C.SCRIPT_VECTOR)} WHEN cwe = 95 THEN {_re("p", C.CODE_TOKENS)} END AS demonstrated FROM h0""")
def demonstrated_payloads(spark: SparkSession, d: str) -> DataFrame:
    h = table(spark, d, "structural_hits").where("snippet is not null").withColumn("cwe", level_cwe(F.col("cwe_hint")))
    return h.select("hit_id", "cwe", S.demonstrates(F.col("snippet"), F.col("cwe")).alias("demonstrated"))


SIGNALS = ["grounded", "taint_complete", "concrete_poc", "reachable", "vote_confirmed", "externally_corroborated"]
#: So many of the six signals verify a finding.
LEAST_SIGNALS = 3

_JSON = Q.records("findings", "scan_id, finding_id", "finding_json", "finding", {"evidence": ["evidence"], "votes": ["votes"]})
_PASSED = "record ->> '$.check' = 'pass' AND record ->> '$.kind' ="
_SIGNAL_ROWS = f"""{_CORROBORATED}, v AS (SELECT DISTINCT scan_id, finding_id FROM votes WHERE {Q.verdict('verdict')} = 'confirm'),
ev AS (SELECT scan_id, finding_id, bool_or(list_name = 'evidence' AND {_PASSED} 'snippet_match') AS grounded, bool_or(list_name = 'evidence' AND {_PASSED} 'reachable') AS reachable,
 bool_or(list_name = 'evidence' AND {_PASSED} 'external_corroboration') AS told, bool_or(list_name = 'votes' AND {Q.verdict("record ->> '$.verdict'")} = 'confirm') AS voted FROM (WITH {_JSON} SELECT * FROM records) GROUP BY ALL),
bo AS (SELECT scan_id, finding_id, bool_or(coalesce(body ->> '$.taint.source', '') <> '' AND coalesce(body ->> '$.taint.sink', '') <> '') AS taint_complete,
 bool_or(coalesce(body ->> '$.poc.is_concrete', '') = 'true') AS concrete_poc FROM (WITH {_JSON} SELECT * FROM whole) GROUP BY ALL),
s AS (SELECT f.scan_id, f.finding_id, f.severity, coalesce(ev.grounded, false) AS grounded, coalesce(taint_complete, false) AS taint_complete, coalesce(concrete_poc, false) AS concrete_poc,
 coalesce(reachable, false) AS reachable, coalesce(f.validator = 'confirm', false) OR v.scan_id IS NOT NULL OR coalesce(voted, false) AS vote_confirmed, b.ext_id IS NOT NULL OR coalesce(told, false) AS externally_corroborated
 FROM f LEFT JOIN v USING (scan_id, finding_id) LEFT JOIN best b USING (scan_id, finding_id) LEFT JOIN ev USING (scan_id, finding_id) LEFT JOIN bo USING (scan_id, finding_id))
"""


def _signals(spark: SparkSession, d: str) -> DataFrame:
    """The six signals of every finding, each from what another step left: its evidence, its taint, its proof, votes and scanners."""
    key = ["scan_id", "finding_id"]
    found = table(spark, d, "findings").where("scan_id is not null and finding_id is not null")
    names = ["kind", "check", "verdict"]
    nodes = written(shredding.adjacency(found, key, "finding_json", [*shredding.FINDING_NESTED, *names], ("object", "scalar"), shredding.FINDING_NESTED), "nodes")
    lists = lambda name, columns: shredding.entity_table(nodes, key, name, shredding.FINDING_LISTS[name], columns, ("finding",))
    passed = lambda kind: F.bool_or((F.col("rec_check") == "pass") & (F.col("rec_kind") == kind))
    evidence = lists("evidence", ["kind", "check"]).groupBy(*key).agg(passed("snippet_match").alias("grounded"), passed("reachable").alias("reachable"), passed("external_corroboration").alias("told"))
    voted = lists("votes", ["verdict"]).where(level_verdict(F.col("rec_verdict")) == "confirm").select(*key)
    voted = voted.unionByName(table(spark, d, "votes").where(level_verdict(F.col("verdict")) == "confirm").select(*key)).distinct().withColumn("voted", F.lit(True))
    text = lambda path: F.coalesce(json_member(path), F.lit(""))
    body = found.groupBy(*key).agg(
        F.bool_or((text("taint.source") != "") & (text("taint.sink") != "")).alias("taint_complete"), F.bool_or(text("poc.is_concrete") == "true").alias("concrete_poc")
    )
    outside = _corroborated(spark, d).select(*key, F.lit(True).alias("near"))
    f = levelled_findings(spark, d, "severity", "validator").join(voted, key, "left").join(outside, key, "left").join(evidence, key, "left").join(body, key, "left")
    holds = lambda *names: F.coalesce(*names, F.lit(False))
    return f.select(
        *key, "severity", holds("grounded").alias("grounded"), holds("taint_complete").alias("taint_complete"), holds("concrete_poc").alias("concrete_poc"), holds("reachable").alias("reachable"),
        (holds(F.col("validator") == "confirm") | holds("voted")).alias("vote_confirmed"), (holds("near") | holds("told")).alias("externally_corroborated"),
    )


def json_member(path: str, column: str = "finding_json") -> Column:
    """A member of a JSON text as text, whether the text is wrapped, is itself held as text, or is no JSON (null)."""
    held = F.when(F.col(column).rlike(r'^\s*"'), F.get_json_object(column, "$")).otherwise(F.col(column))
    value = F.coalesce(F.get_json_object(held, f"$.finding.{path}"), F.get_json_object(held, f"$.{path}"))
    return F.when(F.try_parse_json(held).isNotNull(), value)


_COUNTED = " + ".join(f"CAST({x} AS INT)" for x in SIGNALS)


@query(f"""WITH {_SIGNAL_ROWS} SELECT scan_id, finding_id, {", ".join(SIGNALS)}, {_COUNTED} AS signals, {_COUNTED} >= {LEAST_SIGNALS} AS verified, round(({_COUNTED}) / 6, 3) AS score,
 CASE WHEN severity IN ('critical', 'high') AND NOT (vote_confirmed AND (externally_corroborated OR concrete_poc)) THEN 'medium' ELSE severity END AS capped_severity FROM s""")
def k_of_n_verdict(spark: SparkSession, d: str) -> DataFrame:
    """The six signals of each finding, whether three hold, their share, and severity, capped unless votes confirm and a scanner or a proof does."""
    s = _signals(spark, d)
    n = sum((F.col(x).cast("int") for x in SIGNALS[1:]), F.col(SIGNALS[0]).cast("int"))
    keys = F.col("vote_confirmed") & (F.col("externally_corroborated") | F.col("concrete_poc"))
    capped = F.when(F.col("severity").isin("critical", "high") & ~keys, "medium").otherwise(F.col("severity"))
    return s.select("scan_id", "finding_id", *SIGNALS, n.alias("signals"), (n >= LEAST_SIGNALS).alias("verified"), F.round(n / 6, 3).alias("score"), capped.alias("capped_severity"))


@query(f"WITH {Q.LATEST} SELECT CASE WHEN confidence >= 0.7 THEN 'confirm' WHEN confidence < 0.3 THEN 'reject' ELSE 'uncertain' END AS band, severity, CAST(count(*) AS BIGINT) AS n FROM f WHERE confidence IS NOT NULL GROUP BY ALL")
def confidence_bands(spark: SparkSession, d: str) -> DataFrame:
    f = levelled_findings(spark, d, "confidence", "severity").where("confidence is not null")
    return f.groupBy(A.bands(F.col("confidence")).alias("band"), "severity").agg(F.count("*").alias("n"))


@query()
def calibrated_probability(spark: SparkSession, d: str) -> DataFrame:
    """Confidence as a probability, by a logistic curve fitted to the marks of reviewers."""
    f = levelled_findings(spark, d, "confidence", "reviewer")
    a, b, fitted = A.platt(_marks(f).select(F.col("confidence").alias("score"), (F.col("mark") == "TP").cast("int").alias("label")))
    p = 1 / (1 + F.exp(-(F.lit(a) * F.col("confidence") + F.lit(b)))) if fitted else F.col("confidence")
    return f.where("confidence is not null").select("scan_id", "finding_id", p.alias("probability"), A.bands(p).alias("band"))


@query()
def redacted_documents(spark: SparkSession, d: str) -> DataFrame:
    docs = spread(table(spark, d, "documents").where("text is not null").select("doc_id", "text"))
    return docs.select("doc_id", S.redacted(F.col("text")).alias("text"))


@query(f"""WITH d0 AS (SELECT doc_id, {Q.word('source')} AS source, text, length(text) AS size, sha256(text) AS hash FROM documents),
r AS (SELECT *, row_number() OVER (PARTITION BY hash ORDER BY doc_id) AS copy FROM d0)
SELECT coalesce(source, 'none') AS source, CASE WHEN text IS NULL OR trim(text, ' \t\n\r') = '' THEN 'blank' WHEN size > 3000 THEN 'oversize' WHEN copy > 1 THEN 'duplicate' ELSE 'kept' END AS reason,
CAST(count(*) AS BIGINT) AS n, CAST(coalesce(sum(size), 0) AS BIGINT) AS chars FROM r GROUP BY ALL""")
def intake_reasons(spark: SparkSession, d: str) -> DataFrame:
    """Documents by the first reason not to take them in; the least id of equal texts is kept."""
    docs = table(spark, d, "documents").select("doc_id", level_word(F.col("source")).alias("source"), "text", F.length("text").alias("size"))
    first = docs.where("text is not null").groupBy(F.sha2("text", 256).alias("hash")).agg(F.min("doc_id").alias("kept_id"))
    marked = docs.withColumn("hash", F.sha2("text", 256)).join(first, "hash", "left")
    reason = (
        F.when(F.col("text").isNull() | (F.trim(F.col("text"), F.lit(" \t\n\r")) == ""), "blank").when(F.col("size") > 3000, "oversize")
        .when(F.col("doc_id") > F.col("kept_id"), "duplicate").otherwise("kept")
    )
    return marked.groupBy(F.coalesce("source", F.lit("none")).alias("source"), reason.alias("reason")).agg(F.count("*").alias("n"), F.coalesce(F.sum("size"), F.lit(0)).cast("long").alias("chars"))


def _file_hashes(spark: SparkSession, d: str) -> DataFrame:
    text = F.coalesce(F.get_json_object("manifest_json", "$.file_hashes"), F.get_json_object("manifest_json", "$.manifest.file_hashes"))
    valid = F.expr("try_parse_json(manifest_json) is not null")
    hashes = F.from_json(F.when(valid, text), "map<string,string>")
    return table(spark, d, "scans").where("scan_id is not null").select("scan_id", F.explode(hashes).alias("path", "hash"))


@query(f"""WITH {Q.SNAPSHOTS},
m AS (SELECT scan_id, CASE WHEN json_valid(manifest_json) THEN coalesce(manifest_json->'$.file_hashes', manifest_json->'$.manifest.file_hashes') END AS j FROM scans),
k AS (SELECT scan_id, j, unnest(json_keys(j)) AS path FROM m WHERE json_type(j) = 'OBJECT'),
hh AS (SELECT scan_id, path, json_extract_string(j, '$."' || path || '"') AS hash FROM k),
cur AS (SELECT s.stream, s.seq, hh.* FROM hh JOIN snaps s USING (scan_id)),
prev AS (SELECT stream, seq + 1 AS seq, path, hash AS old_hash FROM cur)
SELECT c.scan_id, c.path, CASE WHEN p.path IS NULL THEN 'new' ELSE 'changed' END AS state FROM cur c LEFT JOIN prev p USING (stream, seq, path)
WHERE c.hash IS DISTINCT FROM p.old_hash""")
def incremental_files(spark: SparkSession, d: str) -> DataFrame:
    """Files that are new or whose content hash changed since the snapshot before."""
    snaps = snapshots(table(spark, d, "scans")).select("scan_id", "stream", "seq")
    cur = _file_hashes(spark, d).join(snaps, "scan_id")
    prev = cur.select("stream", (F.col("seq") + 1).alias("seq"), "path", F.col("hash").alias("old_hash"), F.lit(True).alias("had"))
    changed = cur.join(prev, ["stream", "seq", "path"], "left").where(~F.col("hash").eqNullSafe(F.col("old_hash")))
    return changed.select("scan_id", "path", F.when(F.col("had"), "changed").otherwise("new").alias("state"))


@query("""SELECT repo, profile, CAST(count(*) AS BIGINT) AS scans, CAST(sum(finding_count) AS BIGINT) AS findings, CAST(sum(dropped_count) AS BIGINT) AS dropped,
round(sum(total_cost_usd), 4) AS cost FROM scans GROUP BY ALL""")
def run_costs(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "scans").groupBy("repo", "profile").agg(
        F.count("*").alias("scans"), F.sum("finding_count").alias("findings"), F.sum("dropped_count").alias("dropped"), F.round(F.sum("total_cost_usd"), 4).alias("cost")
    )


@query(f"""WITH {Q.LATEST_JSON} SELECT scan_id, finding_id, severity, 'CWE-' || CAST(cwe AS VARCHAR) AS cwe, path, line, skill, confidence, validator, reviewer,
CASE severity WHEN 'critical' THEN 'error' WHEN 'high' THEN 'error' WHEN 'medium' THEN 'warning' ELSE 'note' END AS level,
CASE WHEN json_valid(finding_json) THEN array_to_string(CAST(coalesce(finding_json->'$.tags', finding_json->'$.finding.tags') AS VARCHAR[]), ';') END AS tags FROM f""")
def flat_export(spark: SparkSession, d: str) -> DataFrame:
    """One flat row per finding, lists joined by semicolons."""
    f = levelled_findings(spark, d, "severity", "cwe", "path", "line", "skill", "confidence", "validator", "reviewer", "finding_json")
    valid = F.expr("try_parse_json(finding_json) is not null")
    text = F.coalesce(F.get_json_object("finding_json", "$.tags"), F.get_json_object("finding_json", "$.finding.tags"))
    tags = F.array_join(F.from_json(F.when(valid, text), "array<string>"), ";")
    level = F.when(F.col("severity").isin("critical", "high"), "error").when(F.col("severity") == "medium", "warning").otherwise("note")
    return f.select(
        "scan_id", "finding_id", "severity", F.concat(F.lit("CWE-"), F.col("cwe").cast("string")).alias("cwe"), "path", "line", "skill", "confidence", "validator", "reviewer",
        level.alias("level"), tags.alias("tags"),
    )


@query(f"""WITH {Q.LATEST}, {_EXT}, t AS (SELECT DISTINCT repo, file, line FROM f WHERE reviewer = 'confirm' AND repo IS NOT NULL AND file IS NOT NULL AND line IS NOT NULL),
p AS (SELECT DISTINCT tool, ext_repo AS repo, file, other_line AS line FROM e WHERE ext_repo IS NOT NULL AND file IS NOT NULL AND other_line IS NOT NULL),
n AS (SELECT tool, CAST(count(*) AS BIGINT) AS predicted, CAST(count(*) FILTER (EXISTS (SELECT 1 FROM t WHERE t.repo = p.repo AND t.file = p.file AND abs(t.line - p.line) <= 3)) AS BIGINT) AS tp FROM p GROUP BY tool)
SELECT tool, predicted, tp, round(tp / predicted, 4) AS precision_, round(tp / (SELECT count(*) FROM t), 4) AS recall_ FROM n""")
def scanner_precision(spark: SparkSession, d: str) -> DataFrame:
    """Per scanner, how many of its places lie within three lines of a confirmed flaw."""
    known = "repo is not null and file is not null and line is not null"
    truth = levelled_findings(spark, d, "reviewer", "repo", "file", "line").where("reviewer = 'confirm'").where(known).select("repo", "file", "line").distinct()
    e = _external(spark, d).select("tool", F.col("ext_repo").alias("repo"), "file", F.col("other_line").alias("line")).where(known).distinct()
    right = J.near_pairs(e, truth.withColumnRenamed("line", "other_line"), ["repo", "file"], 3).select(*e.columns).distinct().withColumn("hit", F.lit(1))
    total = truth.agg(F.count("*").alias("total"))
    counts = e.join(right, e.columns, "left").groupBy("tool").agg(F.count("*").alias("predicted"), F.count("hit").alias("tp"))
    return counts.crossJoin(F.broadcast(total)).select(
        "tool", "predicted", "tp", F.round(F.col("tp") / F.col("predicted"), 4).alias("precision_"), F.round(F.try_divide(F.col("tp"), F.col("total")), 4).alias("recall_")
    )


@query()
def byte_budget_intake(spark: SparkSession, d: str) -> DataFrame:
    """Documents of each source taken in order of id into 200,000 characters and 300 documents, passing over what does not fit."""
    docs = table(spark, d, "documents").where("doc_id is not null and text is not null").select(
        "doc_id", F.coalesce(level_word(F.col("source")), F.lit("none")).alias("source"), F.length("text").cast("long").alias("size")
    )
    return byte_budget(docs, "source", ["doc_id"], 200_000, 300)


def _signs_sql() -> str:
    classes = sorted({c for c, _ in C.CLASS_SIGNS})
    return " ".join(f"WHEN cwe = {c} THEN " + " OR ".join(_re("coalesce(snippet, '')", p) for k, p in C.CLASS_SIGNS if k == c) for c in classes)


@query(f"""WITH g AS (SELECT hit_id, snippet, {Q.cwe('cwe_hint')} AS cwe FROM structural_hits) SELECT hit_id, cwe, CASE {_signs_sql()} END AS grounded FROM g""")
def grounded_hits(spark: SparkSession, d: str) -> DataFrame:
    """Whether the lines of a hit show a sign of its class."""
    h = _hits(spark, d)
    return h.select("hit_id", "cwe", S.grounded(F.col("snippet"), F.col("cwe")).alias("grounded"))


@query("""SELECT t.tool, kind, CAST(count(*) AS BIGINT) AS n FROM (SELECT DISTINCT hit_id, kind, lower(trim(unnest(corroborated_by))) AS tool FROM structural_hits) s
JOIN (SELECT DISTINCT lower(trim(tool)) AS tool FROM external_findings) t ON s.tool = t.tool GROUP BY ALL""")
def corroborating_tools(spark: SparkSession, d: str) -> DataFrame:
    """Hits by the tools listed in them that also delivered reports: a join on members of an array."""
    named = table(spark, d, "structural_hits").select("hit_id", "kind", F.explode("corroborated_by").alias("tool")).withColumn("tool", F.lower(F.trim("tool"))).distinct()
    tools = table(spark, d, "external_findings").select(F.lower(F.trim("tool")).alias("tool")).distinct()
    return named.join(tools, "tool").groupBy("tool", "kind").agg(F.count("*").alias("n"))


@query("""WITH m AS (SELECT profile, CASE WHEN json_valid(manifest_json) THEN coalesce(manifest_json->'$.hallucination_metrics', manifest_json->'$.manifest.hallucination_metrics') END AS j FROM scans)
SELECT profile, CAST(count(j) AS BIGINT) AS runs, CAST(sum(TRY_CAST(j->>'$.raw_lens' AS BIGINT)) AS BIGINT) AS raw_lens, CAST(sum(TRY_CAST(j->>'$.ungrounded_dropped' AS BIGINT)) AS BIGINT) AS ungrounded_dropped,
CAST(sum(TRY_CAST(j->>'$.missing_poc' AS BIGINT)) AS BIGINT) AS missing_poc FROM m GROUP BY profile""")
def run_counters(spark: SparkSession, d: str) -> DataFrame:
    """Counters of runs by profile, from their manifests."""
    valid = F.expr("try_parse_json(manifest_json) is not null")
    text = F.coalesce(F.get_json_object("manifest_json", "$.hallucination_metrics"), F.get_json_object("manifest_json", "$.manifest.hallucination_metrics"))
    m = table(spark, d, "scans").select("profile", F.when(valid, text).alias("j"))
    names = ("raw_lens", "ungrounded_dropped", "missing_poc")
    return m.groupBy("profile").agg(F.count("j").alias("runs"), *(F.sum(F.expr(f"try_cast(get_json_object(j, '$.{n}') as bigint)")).alias(n) for n in names))


@query(f"""WITH {Q.LATEST} SELECT scan_id, finding_id, printf('N-%04d', row_number() OVER (PARTITION BY scan_id ORDER BY {Q.SEV_NUM} DESC NULLS LAST, confidence DESC NULLS LAST, finding_id)) AS new_id FROM f""")
def renumbered(spark: SparkSession, d: str) -> DataFrame:
    """Findings numbered within their scan in order of severity and confidence."""
    f = levelled_findings(spark, d, "severity", "confidence")
    order = Window.partitionBy("scan_id").orderBy(A.severity_number(F.col("severity")).desc_nulls_last(), F.col("confidence").desc_nulls_last(), "finding_id")
    return f.select("scan_id", "finding_id", F.format_string("N-%04d", F.row_number().over(order)).alias("new_id"))


@query(f"""WITH {_HITS} SELECT regexp_extract(file, '(\\.[^.]*)$', 1) AS suffix, CAST(count(*) AS BIGINT) AS n, CAST(count(DISTINCT repo) AS BIGINT) AS repos FROM h WHERE file IS NOT NULL
GROUP BY suffix ORDER BY n DESC, suffix LIMIT 10""")
def top_suffixes(spark: SparkSession, d: str) -> DataFrame:
    """The ten most frequent suffixes of files with hits."""
    h = _hits(spark, d).where("file is not null").select(F.regexp_extract("file", r"(\.[^.]*)$", 1).alias("suffix"), "repo")
    return h.groupBy("suffix").agg(F.count("*").alias("n"), F.countDistinct("repo").alias("repos")).orderBy(F.desc("n"), "suffix").limit(10)


@query(f"""WITH {Q.LATEST}, r AS (SELECT f.*, l.title FROM f JOIN latest l USING (scan_id, finding_id))
SELECT scan_id, to_json(struct_pack(ruleId := coalesce('CWE-' || CAST(cwe AS VARCHAR), 'unknown'), level := CASE severity WHEN 'critical' THEN 'error' WHEN 'high' THEN 'error' WHEN 'medium' THEN 'warning' ELSE 'note' END))
 AS rule, path, line, finding_id FROM r""")
def sarif_places(spark: SparkSession, d: str) -> DataFrame:
    """What the SARIF export says of each finding's rule and place, in columns."""
    rows = _sarif_rows(spark, d)
    level = F.when(F.col("severity").isin("critical", "high"), "error").when(F.col("severity") == "medium", "warning").otherwise("note")
    rule = F.to_json(F.struct(F.coalesce(F.col("cwe"), F.lit("unknown")).alias("ruleId"), level.alias("level")))
    return rows.select("scan_id", rule.alias("rule"), "path", F.col("start_line").cast("long").alias("line"), "finding_id")


def _sarif_rows(spark: SparkSession, d: str) -> DataFrame:
    kept = levelled_findings(spark, d, "cwe", "severity", "path", "line", "title")
    return kept.withColumn("cwe", F.concat(F.lit("CWE-"), F.col("cwe").cast("string"))).withColumnRenamed("line", "start_line")


@query()
def sarif_export(spark: SparkSession, d: str) -> DataFrame:
    """One SARIF result per finding, secrets masked."""
    findings = _sarif_rows(spark, d)
    return sarif_results(findings).unionByName(sarif_unlocated(findings))
