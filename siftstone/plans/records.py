"""Queries that bring records into shape and join them to what else is known: exports, normalised replies, baselines, places and classes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siftstone import catalogs as C
from siftstone.functions.levelling import level_cwe, level_path, level_repo, level_word
from siftstone.operators import joins as J
from siftstone.operators import scoring as S
from siftstone.operators import shredding
from siftstone.operators.snapshots import newest
from siftstone.plans import reference as R
from siftstone.plans import sqltext as Q
from siftstone.session import table, written

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


_FIRST_PLACES = Q.records("f", "scan_id, finding_id", "finding_json", "finding", {"locations": ["locations"]})
_BODIES = f"""{Q.LATEST_JSON}, body AS (WITH {_FIRST_PLACES} SELECT * FROM whole),
first_place AS (SELECT scan_id, finding_id, {Q.scalar('record', 'path')} AS loc_path, {Q.scalar('record', 'start_line')} AS loc_start, {Q.scalar('record', 'end_line')} AS loc_end
  FROM (WITH {_FIRST_PLACES} SELECT * FROM records) WHERE list_pos = 0),
x AS (SELECT f.*, l.title, l.cvss_score, l.cvss_vector, b.body, p.* EXCLUDE (scan_id, finding_id) FROM f JOIN latest l USING (scan_id, finding_id)
  LEFT JOIN body b USING (scan_id, finding_id) LEFT JOIN first_place p USING (scan_id, finding_id))"""


def _first_places(spark: SparkSession, findings: DataFrame) -> DataFrame:
    places = shredding.finding_entity(findings, "locations", ["path", "start_line", "end_line"]).where("list_pos = 0")
    return places.select(*KEY, F.col("rec_path").alias("loc_path"), F.col("rec_start_line").alias("loc_start"), F.col("rec_end_line").alias("loc_end"))


def _with_body(findings: DataFrame) -> DataFrame:
    """``findings`` with the record in their JSON as text, taken out of its wrapper once; null where the text is no JSON."""
    held = F.when(F.col("finding_json").rlike(r'^\s*"'), F.get_json_object("finding_json", "$")).otherwise(F.col("finding_json"))
    return findings.withColumn("held", held).withColumn("body", F.when(F.try_parse_json("held").isNotNull(), F.coalesce(F.get_json_object("held", "$.finding"), "held"))).drop("held")


def _member(path: str) -> Column:
    return F.get_json_object("body", f"$.{path}")


def _is_true(path: str) -> Column:
    return F.coalesce(F.lower(_member(path)) == "true", F.lit(False))


def _is_true_sql(path: str) -> str:
    return f"coalesce(lower(body ->> '$.{path}') = 'true', false)"


def _joined(path: str) -> Column:
    return F.coalesce(F.array_join(F.from_json(_member(path), "array<string>"), ";"), F.lit(""))


def _joined_sql(path: str) -> str:
    return f"coalesce(CASE WHEN json_type(body, '$.{path}') = 'ARRAY' THEN array_to_string(CAST(body -> '$.{path}' AS VARCHAR[]), ';') END, '')"


@query(f"""WITH {_BODIES} SELECT scan_id, finding_id AS id, coalesce(title, '') AS title, coalesce(severity, '') AS severity, coalesce('CWE-' || CAST(cwe AS VARCHAR), '') AS cwe, cvss_score,
 coalesce(cvss_vector, '') AS cvss_vector, confidence, TRY_CAST(body ->> '$.calibrated_confidence' AS DOUBLE) AS calibrated_confidence, {_is_true_sql('verification.verified')} AS verified,
 TRY_CAST(body ->> '$.verification.score' AS DOUBLE) AS verification_score,
 coalesce(array_to_string(list_sort(list_filter(json_keys(body, '$.verification.signals'), lambda k: (body -> '$.verification.signals' ->> k) = 'true')), ';'), '') AS verification_signals,
 {_is_true_sql('externally_corroborated')} OR {_is_true_sql('verification.signals.corroborated')} AS externally_corroborated, {_joined_sql('corroborating_tools')} AS corroborating_tools,
 {_is_true_sql('grounded')} OR {_is_true_sql('verification.signals.grounded')} AS grounded, TRY_CAST(body ->> '$.reachability' AS DOUBLE) AS reachability, {_is_true_sql('poc.is_concrete')} AS has_concrete_poc,
 {_is_true_sql('poc_demonstrated')} AS poc_demonstrated, {_is_true_sql('abstained')} AS abstained, coalesce(path, '') AS path, line AS start_line, TRY_CAST(loc_end AS BIGINT) AS end_line, coalesce(skill, '') AS skill,
 coalesce(body ->> '$.stage', '') AS stage, {_joined_sql('tags')} AS tags, trim(replace(coalesce(body ->> '$.remediation', ''), chr(10), ' ')) AS remediation FROM x""")
def full_export(spark: SparkSession, d: str) -> DataFrame:
    """The flat export in all of its 25 columns, beside the scan: texts that are missing come out empty, numbers null, flags false."""
    f = R.levelled_findings(spark, d, "severity", "cwe", "path", "line", "skill", "confidence", "title", "cvss_score", "cvss_vector", "finding_json")
    f = _with_body(f.join(_first_places(spark, f).select(*KEY, "loc_end"), KEY, "left"))
    text = lambda c: F.coalesce(c, F.lit(""))
    number = lambda path: _member(path).try_cast("double")
    signals = F.map_keys(F.map_filter(F.from_json(_member("verification.signals"), "map<string,boolean>"), lambda _, ok: ok))
    return f.select(
        "scan_id", F.col("finding_id").alias("id"), text(F.col("title")).alias("title"), text(F.col("severity")).alias("severity"), text(F.concat(F.lit("CWE-"), F.col("cwe").cast("string"))).alias("cwe"), "cvss_score",
        text(F.col("cvss_vector")).alias("cvss_vector"), "confidence", number("calibrated_confidence").alias("calibrated_confidence"), _is_true("verification.verified").alias("verified"),
        number("verification.score").alias("verification_score"), text(F.array_join(F.array_sort(signals), ";")).alias("verification_signals"),
        (_is_true("externally_corroborated") | _is_true("verification.signals.corroborated")).alias("externally_corroborated"), _joined("corroborating_tools").alias("corroborating_tools"),
        (_is_true("grounded") | _is_true("verification.signals.grounded")).alias("grounded"), number("reachability").alias("reachability"), _is_true("poc.is_concrete").alias("has_concrete_poc"),
        _is_true("poc_demonstrated").alias("poc_demonstrated"), _is_true("abstained").alias("abstained"), text(F.col("path")).alias("path"), F.col("line").alias("start_line"),
        F.col("loc_end").try_cast("long").alias("end_line"), text(F.col("skill")).alias("skill"), text(_member("stage")).alias("stage"), _joined("tags").alias("tags"),
        F.trim(F.replace(text(_member("remediation")), F.lit("\n"), F.lit(" "))).alias("remediation"),
    )


# Short and long names of severities in replies; any other name counts as medium.
REPLY_SEVERITIES = {
    "critical": "critical", "high": "high", "medium": "medium", "low": "low", "informational": "informational", "crit": "critical", "med": "medium", "info": "informational"
}


@query(f"""WITH {_BODIES}, r AS (SELECT scan_id, finding_id, body, trim(coalesce(body ->> '$.title', '')) AS title, coalesce(nullif(body ->> '$.path', ''), nullif(body ->> '$.file', ''), nullif(loc_path, '')) AS path,
 coalesce(nullif(TRY_CAST(coalesce(body ->> '$.start_line', body ->> '$.line', loc_start) AS INTEGER), 0), 1) AS start_line, TRY_CAST(coalesce(body ->> '$.end_line', loc_end) AS INTEGER) AS end_line FROM x WHERE body IS NOT NULL)
SELECT scan_id, finding_id, substr(title, 1, 200) AS title, coalesce(CASE lower(body ->> '$.severity') {" ".join(f"WHEN '{a}' THEN '{b}'" for a, b in REPLY_SEVERITIES.items())} END, 'medium') AS severity,
 body ->> '$.cwe' AS cwe, coalesce(nullif(TRY_CAST(body ->> '$.confidence' AS DOUBLE), 0), 0.5) AS confidence, path, start_line, end_line, substr(coalesce(body ->> '$.description', ''), 1, 4000) AS description,
 substr(coalesce(body ->> '$.remediation', ''), 1, 2000) AS remediation, substr(nullif(body ->> '$.taint.source', ''), 1, 300) AS source, substr(nullif(body ->> '$.taint.sink', ''), 1, 300) AS sink,
 lower(body ->> '$.taint.sanitizer_missing') IN ('true', 'yes', '1') AS sanitizer_missing, CASE WHEN title = '' THEN 'no_title' WHEN path IS NULL THEN 'no_place' END AS reject_reason FROM r""")
def normalised_replies(spark: SparkSession, d: str) -> DataFrame:
    """Records as replies deliver them, brought into shape: other names of members, defaults, lengths, severities and numbers.

    A record without title or place has its reason to be rejected; text that is no JSON gives no row.
    """
    f = R.levelled_findings(spark, d, "finding_json")
    f = _with_body(f.join(_first_places(spark, f), KEY, "left")).where("body is not null")
    m = _member
    text = lambda path: F.coalesce(m(path), F.lit(""))
    some = lambda c: F.nullif(c, F.lit(""))
    severity = F.coalesce(F.create_map(*(F.lit(x) for pair in REPLY_SEVERITIES.items() for x in pair))[F.lower(m("severity"))], F.lit("medium"))
    r = f.withColumns({"r_title": F.trim(text("title")), "r_path": F.coalesce(some(m("path")), some(m("file")), some(F.col("loc_path")))})
    return r.select(
        *KEY, F.substring("r_title", 1, 200).alias("title"), severity.alias("severity"), m("cwe").alias("cwe"),
        F.coalesce(F.nullif(m("confidence").try_cast("double"), F.lit(0.0)), F.lit(0.5)).alias("confidence"), F.col("r_path").alias("path"),
        F.coalesce(F.nullif(F.coalesce(m("start_line"), m("line"), F.col("loc_start")).try_cast("int"), F.lit(0)), F.lit(1)).alias("start_line"),
        F.coalesce(m("end_line"), F.col("loc_end")).try_cast("int").alias("end_line"), F.substring(text("description"), 1, 4000).alias("description"), F.substring(text("remediation"), 1, 2000).alias("remediation"),
        F.substring(some(m("taint.source")), 1, 300).alias("source"), F.substring(some(m("taint.sink")), 1, 300).alias("sink"), F.lower(m("taint.sanitizer_missing")).isin("true", "yes", "1").alias("sanitizer_missing"),
        F.when(F.col("r_title") == "", "no_title").when(F.col("r_path").isNull(), "no_place").alias("reject_reason"),
    )


@query(f"""WITH {Q.SNAPSHOTS}, {Q.LATEST}, n AS (SELECT scan_id FROM snaps WHERE next_scan_id IS NULL),
b AS (SELECT {Q.repo('repo')} AS repo, {Q.cwe('cwe')} AS cwe, {Q.path('path')} AS path, CAST(start_line AS BIGINT) AS line, {Q.word('skill')} AS skill, accepted_at FROM baseline_entries),
held AS (SELECT repo, {R._PRINT} AS fingerprint, CAST(count(*) AS BIGINT) AS entries, min(accepted_at) AS accepted_at FROM b WHERE path IS NOT NULL AND line IS NOT NULL GROUP BY ALL),
told AS (SELECT repo, {R._PRINT} AS fingerprint, bool_or(reviewer = 'reject') AS rejected, bool_or(reviewer = 'confirm') AS confirmed FROM f SEMI JOIN n USING (scan_id)
  WHERE path IS NOT NULL AND line IS NOT NULL AND reviewer IN ('reject', 'confirm') GROUP BY ALL)
SELECT coalesce(h.repo, t.repo) AS repo, coalesce(h.fingerprint, t.fingerprint) AS fingerprint, coalesce(entries, 0) AS entries, accepted_at,
 CASE WHEN h.fingerprint IS NULL THEN 'added' WHEN t.confirmed AND NOT t.rejected THEN 'removed' ELSE 'kept' END AS state
FROM held h FULL OUTER JOIN told t ON h.fingerprint = t.fingerprint AND h.repo IS NOT DISTINCT FROM t.repo WHERE h.fingerprint IS NOT NULL OR t.rejected""")
def next_baseline(spark: SparkSession, d: str) -> DataFrame:
    """The baseline after the reviewers of the newest snapshots: fingerprints by repository that stay, come in because a finding was
    rejected, or go because it was confirmed and nowhere rejected. Entries accepted twice are one, with their number and first time.
    """

    def printed(df: DataFrame) -> DataFrame:
        parts = F.concat_ws("|", F.concat(F.lit("CWE-"), F.coalesce(F.col("cwe").cast("string"), F.lit("UNK"))), "path", F.col("line").cast("string"), F.coalesce("skill", F.lit("")))
        return df.where("path is not null and line is not null").withColumn("fingerprint", F.substring(F.sha2(parts, 256), 1, 16))

    b = table(spark, d, "baseline_entries").select(
        level_repo(F.col("repo")).alias("repo"), level_cwe(F.col("cwe")).alias("cwe"), level_path(F.col("path")).alias("path"), F.col("start_line").cast("long").alias("line"), level_word(F.col("skill")).alias("skill"), "accepted_at"
    )
    held = printed(b).groupBy("repo", "fingerprint").agg(F.count("*").alias("entries"), F.min("accepted_at").alias("accepted_at"))
    last = newest(table(spark, d, "scans")).select("scan_id")
    marked = R.levelled_findings(spark, d, "repo", "cwe", "path", "line", "skill", "reviewer").where("reviewer in ('reject', 'confirm')").join(last, "scan_id", "left_semi")
    told = printed(marked).groupBy(F.col("repo").alias("t_repo"), F.col("fingerprint").alias("t_print")).agg(
        F.bool_or(F.col("reviewer") == "reject").alias("rejected"), F.bool_or(F.col("reviewer") == "confirm").alias("confirmed")
    )
    both = held.join(told, (F.col("fingerprint") == F.col("t_print")) & F.col("repo").eqNullSafe(F.col("t_repo")), "full_outer").where("fingerprint is not null or rejected")
    state = F.when(F.col("fingerprint").isNull(), "added").when(F.col("confirmed") & ~F.col("rejected"), "removed").otherwise("kept")
    return both.select(F.coalesce("repo", "t_repo").alias("repo"), F.coalesce("fingerprint", "t_print").alias("fingerprint"), F.coalesce("entries", F.lit(0).cast("long")).alias("entries"), "accepted_at", state.alias("state"))


_SIGNS = R._signs_sql().replace("snippet", "line_text")


@query(f"""WITH {Q.LATEST}, {R._HITS}, {R._LINES}, {R._EXT},
text_lines AS (SELECT h.repo, h.file, h.line + n.line_no - 1 AS at_line, n.line_text FROM h JOIN numbered n USING (hit_id) WHERE h.repo IS NOT NULL AND h.file IS NOT NULL AND h.line IS NOT NULL),
known AS (SELECT repo, file, max(last) AS last FROM (SELECT repo, file, max(at_line) AS last FROM text_lines GROUP BY ALL UNION ALL
  SELECT ext_repo, file, max(greatest(coalesce(ext_end, other_line), other_line)) FROM e WHERE ext_repo IS NOT NULL AND file IS NOT NULL GROUP BY ALL) GROUP BY ALL),
near AS (SELECT scan_id, finding_id, bool_or(CASE {_SIGNS} END) AS shown FROM f JOIN text_lines t ON t.repo = f.repo AND t.file = f.file AND abs(t.at_line - f.line) <= 5 GROUP BY ALL),
g AS (SELECT f.scan_id, f.finding_id, CASE WHEN f.repo IS NULL OR f.file IS NULL THEN 'unknown' WHEN k.file IS NULL THEN 'fail' ELSE 'pass' END AS path_check,
 CASE WHEN k.file IS NULL OR k.last IS NULL OR f.line IS NULL THEN 'unknown' WHEN f.line BETWEEN 1 AND k.last THEN 'pass' ELSE 'fail' END AS line_check,
 CASE WHEN shown IS NULL THEN 'unknown' WHEN shown THEN 'pass' ELSE 'fail' END AS window_check FROM f LEFT JOIN known k ON k.repo = f.repo AND k.file = f.file LEFT JOIN near USING (scan_id, finding_id))
SELECT *, path_check = 'pass' AND line_check = 'pass' AND window_check <> 'fail' AS grounded FROM g""")
def place_grounding(spark: SparkSession, d: str) -> DataFrame:
    """Three checks of each finding's place against the files known of its repository: that the file is known, that the line lies in the
    part of it that is known, and that the lines up to five away show a sign of the class.

    A check without what it needs (place, lines near, signs of the class) is unknown, which fails the first two and leaves the third open.
    """
    by = ["repo", "file"]
    whole = "repo is not null and file is not null"
    hits = R._hits(spark, d).where(whole).where("line is not null").select("hit_id", *by, "line")
    lines = written(R._lines(spark, d).join(hits, "hit_id").select(*by, (F.col("line") + F.col("line_no") - 1).alias("other_line"), "line_text"), "known-lines")
    told = R._external(spark, d).select(F.col("ext_repo").alias("repo"), "file", F.greatest("ext_end", "other_line").alias("last"), "other_line").where(whole)
    told = told.select(*by, F.when(F.col("other_line").isNotNull(), F.col("last")).alias("last"))
    known = lines.select(*by, F.col("other_line").alias("last")).unionByName(told).groupBy(*by).agg(F.max("last").alias("last"), F.lit(True).alias("known"))
    f = R.levelled_findings(spark, d, "repo", "file", "line", "cwe")
    near = J.near_pairs(f.where(whole).where("line is not null"), lines, by, 5).groupBy(*KEY).agg(F.bool_or(S.grounded(F.col("line_text"), F.col("cwe"))).alias("shown"))
    joined = f.join(known, by, "left").join(near, KEY, "left")
    path_check = F.when(F.col("repo").isNull() | F.col("file").isNull(), "unknown").when(F.col("known").isNull(), "fail").otherwise("pass")
    line_check = F.when(F.col("last").isNull() | F.col("line").isNull(), "unknown").when(F.col("line").between(1, F.col("last")), "pass").otherwise("fail")
    window_check = F.when(F.col("shown").isNull(), "unknown").when(F.col("shown"), "pass").otherwise("fail")
    grounded = (path_check == "pass") & (line_check == "pass") & (window_check != "fail")
    return joined.select(*KEY, path_check.alias("path_check"), line_check.alias("line_check"), window_check.alias("window_check"), grounded.alias("grounded"))


@query(f"""WITH {Q.LATEST}, {R._EXT}, {R._HITS}, t AS (SELECT DISTINCT repo, file, line FROM f WHERE reviewer = 'confirm' AND repo IS NOT NULL AND file IS NOT NULL AND line IS NOT NULL),
p AS (SELECT DISTINCT tool, ext_repo AS repo, file, other_line AS line FROM e WHERE ext_repo IS NOT NULL AND file IS NOT NULL AND other_line IS NOT NULL),
files AS (SELECT repo, file FROM h UNION SELECT repo, file FROM f),
m AS (SELECT p.*, EXISTS (SELECT 1 FROM t WHERE t.repo = p.repo AND t.file = p.file AND abs(t.line - p.line) <= 3) AS hit, EXISTS (SELECT 1 FROM files x WHERE x.repo = p.repo AND x.file = p.file) AS exists_ FROM p),
found AS (SELECT p.tool, count(DISTINCT (t.repo, t.file, t.line)) AS labels FROM p JOIN t ON t.repo = p.repo AND t.file = p.file AND abs(t.line - p.line) <= 3 GROUP BY p.tool),
c AS (SELECT tool, CAST(count(*) AS BIGINT) AS predicted, CAST(count(*) FILTER (hit) AS BIGINT) AS tp, CAST(count(*) FILTER (NOT exists_) AS BIGINT) AS nowhere FROM m GROUP BY tool),
r AS (SELECT c.*, tp / predicted AS p_, coalesce(labels, 0) / (SELECT count(*) FROM t) AS r_ FROM c LEFT JOIN found USING (tool))
SELECT tool, predicted, tp, nowhere, round(p_, 4) AS precision_, round(coalesce(r_, 0), 4) AS recall_, round(CASE WHEN p_ + coalesce(r_, 0) > 0 THEN 2 * p_ * r_ / (p_ + r_) ELSE 0 END, 4) AS f1, round(nowhere / predicted, 4) AS hallucination_rate FROM r""")
def scanner_scores(spark: SparkSession, d: str) -> DataFrame:
    """Per scanner precision over its places, recall over the confirmed flaws, their F1, and the share of places in files that nobody knows.

    A rate without anything to divide by is 0.
    """
    by = ["repo", "file"]
    whole = "repo is not null and file is not null and line is not null"
    f = R.levelled_findings(spark, d, "reviewer", "repo", "file", "line")
    truth = f.where("reviewer = 'confirm'").where(whole).select(*by, F.col("line").alias("other_line")).distinct()
    e = written(R._external(spark, d).select("tool", F.col("ext_repo").alias("repo"), "file", F.col("other_line").alias("line")).where(whole).distinct(), "places")
    files = R._hits(spark, d).select(*by).unionByName(f.select(*by)).distinct().withColumn("known", F.lit(True))
    pairs = written(J.near_pairs(e, truth, by, 3).select("tool", *by, "line", "other_line"), "near")
    hit = pairs.select("tool", *by, "line").distinct().withColumn("hit", F.lit(1))
    labels = pairs.select("tool", *by, "other_line").distinct().groupBy("tool").agg(F.count("*").alias("labels"))
    # A scanner without a name is none that others could match.
    counts = e.join(hit, ["tool", *by, "line"], "left").join(files, by, "left").groupBy("tool").agg(F.count("*").alias("predicted"), F.count("hit").alias("tp"), F.count_if(F.col("known").isNull()).alias("nowhere"))
    total = truth.agg(F.count("*").alias("total"))
    both = counts.join(labels, "tool", "left").crossJoin(F.broadcast(total))  # one row
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    rates = both.withColumns({"p": zero(F.try_divide("tp", "predicted")), "r": zero(F.try_divide(F.coalesce("labels", F.lit(0)), F.col("total")))})
    f1 = zero(F.try_divide(2 * F.col("p") * F.col("r"), F.col("p") + F.col("r")))
    return rates.select(
        "tool", "predicted", "tp", "nowhere", F.round("p", 4).alias("precision_"), F.round("r", 4).alias("recall_"), F.round(f1, 4).alias("f1"), F.round(zero(F.try_divide("nowhere", "predicted")), 4).alias("hallucination_rate")
    )


@query(f"""WITH {Q.LATEST}, c AS ({R.SQL['cvss_scores']}) SELECT scan_id, finding_id, coalesce(nullif(trim(l.cvss_vector), ''), c.vector) AS vector, coalesce(l.cvss_score, c.score) AS score,
 nullif(trim(l.cvss_vector), '') IS NULL AS vector_filled, l.cvss_score IS NULL AS score_filled FROM c JOIN latest l USING (scan_id, finding_id)""")
def cvss_filled(spark: SparkSession, d: str) -> DataFrame:
    """Severity vectors and scores as delivered; where one is missing, by the defaults of the class, and marked so."""
    given = R.levelled_findings(spark, d, "cvss_vector", "cvss_score").withColumn("given", F.nullif(F.trim("cvss_vector"), F.lit("")))
    both = R.cvss_scores(spark, d).join(given, KEY)
    return both.select(
        *KEY, F.coalesce("given", "vector").alias("vector"), F.coalesce("cvss_score", "score").alias("score"), F.col("given").isNull().alias("vector_filled"), F.col("cvss_score").isNull().alias("score_filled")
    )


@query(f"""WITH {Q.LATEST}, c AS ({R.SQL['incremental_files']}), p AS (SELECT scan_id, {Q.path('path')} AS path, max(state) AS state FROM c GROUP BY ALL),
seen AS (SELECT DISTINCT scan_id FROM c) SELECT scan_id, finding_id, coalesce(p.state, 'unchanged') AS file_state FROM f SEMI JOIN seen USING (scan_id) LEFT JOIN p USING (scan_id, path)""")
def findings_in_changed_files(spark: SparkSession, d: str) -> DataFrame:
    """Findings of scans that say which files changed, by what became of their file since the snapshot before."""
    changed = written(R.incremental_files(spark, d), "changed-files")
    files = changed.groupBy("scan_id", level_path(F.col("path")).alias("path")).agg(F.max("state").alias("state"))
    f = R.levelled_findings(spark, d, "path").join(changed.select("scan_id").distinct(), "scan_id", "left_semi")
    return f.join(files, ["scan_id", "path"], "left").select(*KEY, F.coalesce("state", F.lit("unchanged")).alias("file_state"))


@query(f"""WITH {Q.LATEST}, {R._HITS}, lens AS (SELECT DISTINCT skill, cwe FROM f WHERE skill IS NOT NULL AND cwe IS NOT NULL), there AS (SELECT repo, cwe, count(*) AS n FROM h WHERE repo IS NOT NULL AND cwe IS NOT NULL GROUP BY ALL)
SELECT repo, skill, CAST(count(*) AS BIGINT) AS classes, CAST(sum(n) AS BIGINT) AS hits FROM there JOIN lens USING (cwe) GROUP BY ALL""")
def lenses_with_work(spark: SparkSession, d: str) -> DataFrame:
    """Per repository the lenses that have anything to look at: classes a lens reports anywhere, met by hits there. Others may be skipped."""
    lens = R.levelled_findings(spark, d, "skill", "cwe").select("skill", "cwe").where("skill is not null and cwe is not null").distinct()
    there = R._hits(spark, d).where("repo is not null and cwe is not null").groupBy("repo", "cwe").agg(F.count("*").alias("n"))
    return there.join(lens, "cwe").groupBy("repo", "skill").agg(F.count("*").alias("classes"), F.sum("n").alias("hits"))


_SIGNATURE = "'cwe-' || CAST(cwe AS VARCHAR) || '|' || regexp_extract(path, '^([^/]+)', 1)"


@query(f"""WITH {Q.SNAPSHOTS}, {Q.LATEST}, n AS (SELECT scan_id FROM snaps WHERE next_scan_id IS NULL),
t AS (SELECT repo, {_SIGNATURE} AS signature, CAST(count(*) AS BIGINT) AS findings FROM f SEMI JOIN n USING (scan_id) WHERE repo IS NOT NULL AND cwe IS NOT NULL AND path IS NOT NULL GROUP BY ALL),
b AS (SELECT DISTINCT repo, {_SIGNATURE} AS signature FROM (SELECT {Q.repo('repo')} AS repo, {Q.cwe('cwe')} AS cwe, {Q.path('path')} AS path FROM baseline_entries))
SELECT * FROM t ANTI JOIN b USING (repo, signature)""")
def new_threats(spark: SparkSession, d: str) -> DataFrame:
    """Threats of newest snapshots, a class against a part of a repository, that the baseline does not know there."""

    def signed(df: DataFrame) -> DataFrame:
        name = F.concat(F.lit("cwe-"), F.col("cwe").cast("string"), F.lit("|"), F.substring_index("path", "/", 1))
        return df.where("repo is not null and cwe is not null and path is not null").select("repo", name.alias("signature"))

    last = newest(table(spark, d, "scans")).select("scan_id")
    threats = signed(R.levelled_findings(spark, d, "repo", "cwe", "path").join(last, "scan_id", "left_semi")).groupBy("repo", "signature").agg(F.count("*").alias("findings"))
    held = table(spark, d, "baseline_entries").select(level_repo(F.col("repo")).alias("repo"), level_cwe(F.col("cwe")).alias("cwe"), level_path(F.col("path")).alias("path"))
    return threats.join(signed(held).distinct(), ["repo", "signature"], "left_anti")


@query(f"""WITH {Q.LATEST}, s AS (SELECT DISTINCT scan_id, {Q.repo('repo')} AS repo, nullif(trim(application_id), '') AS app FROM scans WHERE scan_id IS NOT NULL),
one AS (SELECT repo, min(app) AS only_app FROM s WHERE repo IS NOT NULL GROUP BY repo HAVING count(DISTINCT app) = 1),
c AS (SELECT scan_id, count(*) AS n, count(*) FILTER (severity IN ('critical', 'high')) AS severe FROM f GROUP BY scan_id)
SELECT s.repo, coalesce(app, only_app) AS application_id, app IS NULL AND only_app IS NOT NULL AS implied, CAST(count(*) AS BIGINT) AS scans, CAST(sum(coalesce(n, 0)) AS BIGINT) AS findings, CAST(sum(coalesce(severe, 0)) AS BIGINT) AS severe
FROM s LEFT JOIN one USING (repo) LEFT JOIN c USING (scan_id) GROUP BY ALL""")
def application_findings(spark: SparkSession, d: str) -> DataFrame:
    """Scans and findings by application; a scan that names none belongs to the only application of its repository, if there is just one."""
    s = table(spark, d, "scans").where("scan_id is not null").select("scan_id", level_repo(F.col("repo")).alias("repo"), F.nullif(F.trim("application_id"), F.lit("")).alias("app")).distinct()
    only = s.where("repo is not null").groupBy("repo").agg(F.min("app").alias("only_app"), F.max("app").alias("last_app")).where("only_app = last_app").drop("last_app")
    counts = R.levelled_findings(spark, d, "severity").groupBy("scan_id").agg(F.count("*").alias("n"), F.count_if(F.col("severity").isin("critical", "high")).alias("severe"))
    both = s.join(only, "repo", "left").join(counts, "scan_id", "left")
    implied = F.col("app").isNull() & F.col("only_app").isNotNull()
    return both.groupBy("repo", F.coalesce("app", "only_app").alias("application_id"), implied.alias("implied")).agg(
        F.count("*").alias("scans"), F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("findings"), F.coalesce(F.sum("severe"), F.lit(0)).cast("long").alias("severe")
    )


@query(f"""WITH {Q.LATEST}, own AS (SELECT cwe, CAST(count(*) AS BIGINT) AS findings, CAST(count(DISTINCT repo) AS BIGINT) AS repos FROM f WHERE cwe IS NOT NULL GROUP BY cwe),
refs AS (SELECT {Q.cwe('cwe')} AS cwe, CAST(count(DISTINCT doc_id) AS BIGINT) AS documents, min(doc_id) AS first_doc FROM documents GROUP BY ALL)
SELECT cwe, findings, repos, coalesce(documents, 0) AS documents, first_doc FROM own LEFT JOIN refs USING (cwe)""")
def class_references(spark: SparkSession, d: str) -> DataFrame:
    """Classes of findings with the documents that treat the same class, spelled as it may be; a class without one keeps its row."""
    own = R.levelled_findings(spark, d, "cwe", "repo").where("cwe is not null").groupBy("cwe").agg(F.count("*").alias("findings"), F.countDistinct("repo").alias("repos"))
    docs = table(spark, d, "documents").select("doc_id", level_cwe(F.col("cwe")).alias("cwe")).where("cwe is not null")
    refs = docs.groupBy("cwe").agg(F.countDistinct("doc_id").alias("documents"), F.min("doc_id").alias("first_doc"))
    return own.join(refs, "cwe", "left").select("cwe", "findings", "repos", F.coalesce("documents", F.lit(0).cast("long")).alias("documents"), "first_doc")
