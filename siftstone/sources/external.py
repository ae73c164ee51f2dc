"""Reports of outside scanners as one table, read by Spark from JSON files or a column of JSON text.

Formats are told by content: SARIF, Trivy, Grype, Semgrep, Bandit, Gitleaks, else generic rows. Each is read with an
explicit schema and exploded. Text that is no JSON, or of no known shape, becomes a row of ``ingest_errors``.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Severities of outside vocabularies.
SEVERITY_ALIASES = {"error": "high", "warning": "medium", "warn": "medium", "note": "low", "info": "informational", "moderate": "medium"}

COLUMNS = ["report", "tool", "rule_id", "message", "path", "start_line", "end_line", "severity", "cwe", "ord"]

_LOCATION = "struct<physicalLocation:struct<artifactLocation:struct<uri:string>,region:struct<startLine:int,endLine:int,snippet:struct<text:string>>,contextRegion:struct<snippet:struct<text:string>>>>"
_RULE = "struct<id:string,properties:struct<tags:array<string>,cwe:string>,relationships:array<struct<target:struct<id:string>>>,defaultConfiguration:struct<level:string>>"
_SARIF = (
    f"struct<runs:array<struct<tool:struct<driver:struct<name:string,rules:array<{_RULE}>>,extensions:array<struct<rules:array<{_RULE}>>>>,"
    f"results:array<struct<ruleId:string,ruleIndex:int,rule:struct<id:string,index:int>,message:struct<text:string>,level:string,baselineState:string,"
    f"suppressions:array<string>,properties:struct<tags:array<string>>,locations:array<{_LOCATION}>,relatedLocations:array<{_LOCATION}>>>>>>"
)
_SEMGREP = "array<struct<check_id:string,path:string,start:struct<line:int>,end:struct<line:int>,extra:struct<message:string,severity:string,metadata:struct<cwe:string>>>>"
_BANDIT = "array<struct<filename:string,line_number:int,test_id:string,test_name:string,issue_text:string,issue_severity:string,issue_cwe:struct<id:string>>>"
_GITLEAKS = "array<struct<RuleID:string,File:string,StartLine:int,EndLine:int,Description:string>>"
_TRIVY = (
    "array<struct<Target:string,Vulnerabilities:array<struct<VulnerabilityID:string,Title:string,Description:string,PkgName:string,Severity:string,CweIDs:array<string>>>,"
    "Misconfigurations:array<struct<ID:string,Title:string,Message:string,Severity:string,CauseMetadata:struct<StartLine:int>>>,"
    "Secrets:array<struct<RuleID:string,Title:string,StartLine:int,Severity:string>>>>"
)
_GRYPE = "array<struct<vulnerability:struct<id:string,description:string,severity:string>,artifact:struct<name:string,locations:array<struct<path:string>>>>>"


def _filled(*cols: Column) -> Column:
    return F.coalesce(*(F.nullif(c, F.lit("")) for c in cols))


def bare_path(c: Column) -> Column:
    """A path without ``file://`` or one leading ``./``; forward slashes."""
    return F.translate(F.regexp_replace(F.regexp_replace(F.trim(c), r"^file://", ""), r"^\./", ""), "\\", "/")


def severity_of(c: Column) -> Column:
    low = F.lower(F.trim(c))
    return F.coalesce(F.create_map(*(F.lit(x) for kv in SEVERITY_ALIASES.items() for x in kv))[low], low, F.lit(""))


def class_of(text: Column) -> Column:
    """``CWE-n`` from the first class named in a text, null if none."""
    n = F.regexp_extract(F.upper(text), r"CWE-0*(\d+)", 1)
    return F.when(n != "", F.concat(F.lit("CWE-"), n))


def _out(df: DataFrame, **cols: Column) -> DataFrame:
    defaults = {"end_line": F.lit(None).cast("int"), "cwe": F.lit(None).cast("string"), "ord": F.col("pos").cast("long")}
    given = {k: cols.get(k, defaults.get(k)) for k in COLUMNS if k != "report"}
    given["start_line"] = F.coalesce(given["start_line"], F.lit(1)).cast("int")
    given["message"] = F.coalesce(given["message"], F.lit(""))
    return df.select("report", *(c.alias(k) for k, c in given.items()))


def _tool(df: DataFrame) -> Column:
    return F.regexp_replace(F.substring_index("report", "/", -1), r"\.[^.]*$", "")


def sarif(docs: DataFrame) -> DataFrame:
    runs = docs.select("report", F.explode(F.from_json("text", _SARIF)["runs"]).alias("run"))
    every_rule = F.concat(
        F.coalesce("run.tool.driver.rules", F.from_json(F.lit("[]"), f"array<{_RULE}>")),
        F.flatten(F.coalesce(F.transform("run.tool.extensions", lambda x: F.coalesce(x["rules"], F.from_json(F.lit("[]"), f"array<{_RULE}>"))), F.array())),
    )
    ruled = runs.withColumn("rules", every_rule)
    results = ruled.select("report", "run", "rules", F.posexplode("run.results").alias("pos", "r")).where(
        (F.coalesce(F.size("r.suppressions"), F.lit(0)) <= 0) & ~F.coalesce(F.col("r.baselineState") == "absent", F.lit(False))
    )
    index = F.coalesce("r.ruleIndex", "r.rule.index")
    by_index = F.when((index >= 0) & (index < F.size("rules")), F.get("rules", index)["id"])
    named = results.withColumn("rule_id", F.coalesce(_filled(F.col("r.ruleId"), F.col("r.rule.id")), by_index, F.lit("unknown")))
    own = F.get(F.filter("rules", lambda x: x["id"] == F.col("rule_id")), F.lit(0))
    named = named.withColumn("own", own)
    cwe = F.coalesce(
        class_of(F.array_join("own.properties.tags", " ")), class_of(F.col("own.properties.cwe")),
        class_of(F.array_join(F.transform("own.relationships", lambda x: x["target"]["id"]), " ")), class_of(F.array_join("r.properties.tags", " ")),
    )
    places = F.when(F.coalesce(F.size("r.locations"), F.lit(0)) > 0, F.col("r.locations")).otherwise(F.col("r.relatedLocations"))
    located = named.withColumn("cwe", cwe).withColumn("loc", F.explode(places))
    uri, region = F.col("loc.physicalLocation.artifactLocation.uri"), "loc.physicalLocation.region"
    snippet = _filled(F.col(f"{region}.snippet.text"), F.col("loc.physicalLocation.contextRegion.snippet.text"))
    return _out(
        located.where(F.coalesce(uri, F.lit("")) != ""),
        tool=F.coalesce(_filled(F.col("run.tool.driver.name")), _tool(located)), rule_id=F.col("rule_id"), message=F.coalesce(_filled(F.col("r.message.text")), snippet),
        path=bare_path(uri), start_line=F.col(f"{region}.startLine"), end_line=F.col(f"{region}.endLine"),
        severity=severity_of(F.coalesce(_filled(F.col("r.level")), F.col("own.defaultConfiguration.level"))), cwe=F.col("cwe"),
    )


def semgrep(docs: DataFrame) -> DataFrame:
    r = docs.select("report", F.posexplode(F.from_json(F.get_json_object("text", "$.results"), _SEMGREP)).alias("pos", "r"))
    return _out(
        r, tool=F.lit("semgrep"), rule_id=F.col("r.check_id"), message=F.col("r.extra.message"), path=bare_path(F.col("r.path")), start_line=F.col("r.start.line"),
        end_line=F.col("r.end.line"), severity=severity_of(F.col("r.extra.severity")), cwe=class_of(F.col("r.extra.metadata.cwe")),
    )


def bandit(docs: DataFrame) -> DataFrame:
    r = docs.select("report", F.posexplode(F.from_json(F.get_json_object("text", "$.results"), _BANDIT)).alias("pos", "r"))
    number = F.regexp_extract("r.issue_cwe.id", r"(\d+)$", 1)
    return _out(
        r, tool=F.lit("bandit"), rule_id=F.coalesce(_filled(F.col("r.test_id"), F.col("r.test_name")), F.lit("unknown")), message=F.col("r.issue_text"), path=bare_path(F.col("r.filename")),
        start_line=F.col("r.line_number"), severity=severity_of(F.col("r.issue_severity")), cwe=F.when(number != "", F.concat(F.lit("CWE-"), number.cast("int").cast("string"))),
    )


def gitleaks(docs: DataFrame) -> DataFrame:
    r = docs.select("report", F.posexplode(F.from_json("text", _GITLEAKS)).alias("pos", "r"))
    return _out(
        r, tool=F.lit("gitleaks"), rule_id=F.coalesce(_filled(F.col("r.RuleID")), F.lit("secret")), message=F.coalesce(_filled(F.col("r.Description")), F.lit("hardcoded secret")),
        path=bare_path(F.coalesce("r.File", F.lit(""))), start_line=F.col("r.StartLine"), end_line=F.col("r.EndLine"), severity=F.lit("high"), cwe=F.lit("CWE-798"),
    )


def trivy(docs: DataFrame) -> DataFrame:
    results = docs.select("report", F.explode(F.from_json(F.get_json_object("text", "$.Results"), _TRIVY)).alias("t")).withColumn("target", bare_path(F.coalesce("t.Target", F.lit(""))))
    short = lambda *c: F.substring(F.coalesce(_filled(*c), F.lit("")), 1, 300)
    v = results.select("report", "target", F.posexplode("t.Vulnerabilities").alias("pos", "r"))
    m = results.select("report", "target", F.posexplode("t.Misconfigurations").alias("pos", "r"))
    s = results.select("report", "target", F.posexplode("t.Secrets").alias("pos", "r"))
    name = F.lit("trivy")
    parts = [
        _out(v, tool=name, rule_id=F.coalesce("r.VulnerabilityID", F.lit("unknown")), message=short(F.col("r.Title"), F.col("r.Description")), path=F.coalesce(_filled(F.col("target")), F.col("r.PkgName")),
             start_line=F.lit(1), severity=severity_of(F.col("r.Severity")), cwe=class_of(F.array_join("r.CweIDs", " "))),
        _out(m, tool=name, rule_id=F.coalesce("r.ID", F.lit("unknown")), message=short(F.col("r.Title"), F.col("r.Message")), path=F.col("target"), start_line=F.col("r.CauseMetadata.StartLine"),
             severity=severity_of(F.col("r.Severity"))),
        _out(s, tool=name, rule_id=F.coalesce("r.RuleID", F.lit("secret")), message=short(F.col("r.Title"), F.lit("hardcoded secret")), path=F.col("target"), start_line=F.col("r.StartLine"),
             severity=severity_of(F.col("r.Severity")), cwe=F.lit("CWE-798")),
    ]
    return reduce(DataFrame.unionByName, parts)


def grype(docs: DataFrame) -> DataFrame:
    m = docs.select("report", F.posexplode(F.from_json(F.get_json_object("text", "$.matches"), _GRYPE)).alias("pos", "r"))
    return _out(
        m, tool=F.lit("grype"), rule_id=F.coalesce("r.vulnerability.id", F.lit("unknown")), message=F.substring(F.coalesce(_filled(F.col("r.vulnerability.description"), F.col("r.artifact.name")), F.lit("")), 1, 300),
        path=F.coalesce(_filled(bare_path(F.get("r.artifact.locations", F.lit(0))["path"]), F.col("r.artifact.name")), F.lit("")), start_line=F.lit(1), severity=severity_of(F.col("r.vulnerability.severity")),
    )


def generic(docs: DataFrame) -> DataFrame:
    listed = F.coalesce(F.get_json_object("text", "$.results"), F.get_json_object("text", "$.findings"), F.col("text"))
    r = docs.select("report", F.posexplode(F.from_json(listed, "array<map<string,string>>")).alias("pos", "r"))
    g = lambda *names: _filled(*(F.col("r")[n] for n in names))
    path = g("path", "file", "filename", "File", "location")
    return _out(
        r.where(path.isNotNull()), tool=F.coalesce(g("tool"), _tool(r)), rule_id=F.coalesce(g("rule_id", "rule", "check_id", "id"), F.lit("unknown")), message=g("message", "description", "title"),
        path=bare_path(path), start_line=F.expr("try_cast(coalesce(r['line'], r['start_line'], r['lineno'], r['line_number'], r['StartLine']) as int)"), end_line=F.expr("try_cast(r['end_line'] as int)"),
        severity=severity_of(F.col("r")["severity"]), cwe=class_of(g("cwe", "cwe_id")),
    )


FORMATS = {"sarif": sarif, "trivy": trivy, "grype": grype, "semgrep": semgrep, "bandit": bandit, "gitleaks": gitleaks, "generic": generic}


def sniffed(docs: DataFrame) -> DataFrame:
    """``docs`` (report, text) with the format of each, null where it has none."""
    has = lambda p: F.get_json_object("text", p).isNotNull()
    # A format counts only if every row of the report has its mark.
    every = lambda path, field: F.coalesce(F.forall(F.from_json(F.get_json_object("text", path), "array<map<string,string>>"), lambda m: m[field].isNotNull()), F.lit(False))
    rows = F.from_json("text", "array<map<string,string>>")
    leaks = F.coalesce(F.forall(rows, lambda m: (F.coalesce(m["RuleID"], m["File"], F.lit("")) != "")), F.lit(False))
    is_list, valid = F.col("text").rlike(r"^\s*\["), F.expr("try_parse_json(text) is not null")
    kind = (
        F.when(~valid, None)
        .when(~is_list & has("$.version") & has("$.runs"), "sarif")
        .when(~is_list & has("$.Results"), "trivy")
        .when(~is_list & has("$.matches"), "grype")
        .when(~is_list & has("$.results") & every("$.results", "check_id"), "semgrep")
        .when(~is_list & has("$.results") & every("$.results", "filename") & every("$.results", "issue_text"), "bandit")
        .when(~is_list & (has("$.results") | has("$.findings")), "generic")
        .when(is_list & leaks, "gitleaks")
        .when(is_list, "generic")
    )
    return docs.withColumn("format", kind)


def read_reports(spark: SparkSession, *paths: str) -> DataFrame:
    """(report, text): whole files."""
    return spark.read.text(list(paths), wholetext=True).select(F.input_file_name().alias("report"), F.col("value").alias("text"))


def external_findings(docs: DataFrame) -> DataFrame:
    """All formats as one table, with the report and the order within it."""
    told = sniffed(docs)
    return reduce(DataFrame.unionByName, (parse(told.where(F.col("format") == name)) for name, parse in FORMATS.items()))


def ingest_errors(docs: DataFrame) -> DataFrame:
    """(report, error) for text that could not be read."""
    told = sniffed(docs).where("format is null")
    return told.select("report", F.when(F.expr("try_parse_json(text) is null"), "no valid JSON").otherwise("unknown shape").alias("error"))
