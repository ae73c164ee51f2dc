"""Rows that lack a part of their place, or have more than one place, are neither lost nor misjudged."""

import json

from pyspark.sql import functions as F

from siftstone.plans import reference as R
from tests.conftest import rows

HIT = "hit_id long, repo string, path string, line int, kind string, pattern_id string, cwe_hint string, reachable_from_source boolean, snippet string"
EXT = "ext_id long, tool string, rule_id string, repo string, path string, start_line int, end_line int, severity string, cwe string"


def test_merge_sources_keeps_rows_without_a_whole_place(spark, tmp_path):
    hits = [(k, repo, path, line, "k", "sink", "CWE-89", None, "x") for k, repo, path, line in [(1, "r", "src/a.py", 5), (2, None, "src/a.py", 5), (3, "r", None, 5), (4, "r", "src/b.py", None)]]
    ext = [
        (1, "t", "a", None, "/builds/agent3/r/src/a.py", 5, 5, "low", None), (2, "u", "b", "r", "src/c.py", 7, None, None, "CWE-79"), (3, "t", "a", None, "C:\\ws\\R\\src\\c.py", 7, None, None, None),
        (4, "t", "a", None, "/builds/agent3/q/src/a.py", 5, None, None, "CWE-1"), (5, "t", "a", None, "/builds/agent3/q/src/a.py", 5, None, None, "CWE-1"),
        (6, "t", "a", "r", None, 5, None, None, None), (7, "t", "a", "r", "src/a.py", None, None, None, None), (7, "t", "a", "r", "src/a.py", None, None, None, None), (8, "t", "a", "r", "src/d.py", 3, 3, "high", None),
    ]
    d = _findings(spark, tmp_path, [("A", "src/d.py", 3, "CWE-22", "x", None), ("B", None, 3, None, "x", None)], ext=ext)
    spark.createDataFrame(hits, HIT).write.parquet(f"{d}/structural_hits.parquet")
    want = [
        ("r", "src/a.py", 5, 1, None, 89, "t:a", "corroborated"), (None, "src/a.py", 5, 2, None, 89, None, "native"), ("r", None, 5, 3, None, 89, None, "native"), ("r", "src/b.py", None, 4, None, 89, None, "native"),
        ("r", "src/c.py", 7, None, None, 79, "t:a;u:b", "added"), (None, "builds/agent3/q/src/a.py", 5, None, None, 1, "t:a", "added"), (None, "builds/agent3/q/src/a.py", 5, None, None, 1, "t:a", "added"),
        ("r", None, 5, None, None, None, "t:a", "added"), ("r", "src/a.py", None, None, None, None, "t:a", "added"), ("r", "src/d.py", 3, None, "s A", 22, "t:a", "corroborated"), ("r", None, 3, None, "s B", None, None, "native"),
    ]
    assert rows(R.merge_sources(spark, d)) == sorted(want, key=str)


def _findings(spark, tmp_path, data, ext=()):
    """Findings of scan s in the real table's columns, from (finding_id, path, start_line, cwe, skill, finding_json); no accepted entries."""
    for name in ("findings", "baseline_entries", "scans"):
        real = spark.read.parquet(f"/root/testdata/sf0.001/{name}.parquet").limit(0)
        if name == "findings":
            given = {"scan_id": "s", "repo": "r", "severity": "high", "title": "t", "confidence": 0.5}
            some = spark.createDataFrame(data, "finding_id string, path string, start_line int, cwe string, skill string, finding_json string").withColumns({k: F.lit(v) for k, v in given.items()})
            real = some.select(*((F.col(c) if c in some.columns else F.lit(None)).cast(t).alias(c) for c, t in real.dtypes))
        if name == "scans":
            some = spark.createDataFrame([("s", "r", "2024-01-01 00:00:00", "2024-01-01 01:00:00")], "scan_id string, repo string, started_at string, ended_at string")
            real = some.select(*((F.col(c) if c in some.columns else F.lit(None)).cast(t).alias(c) for c, t in real.dtypes))
        real.write.parquet(f"{tmp_path}/{name}.parquet")
    spark.createDataFrame(list(ext), EXT).write.parquet(f"{tmp_path}/external_findings.parquet")
    return str(tmp_path)


def test_findings_without_place_are_kept(spark, tmp_path):
    clustered = [(f"C{k}", f"src/{k}.py", 5, "CWE-89", "x", None) for k in range(5)]
    d = _findings(spark, tmp_path, clustered + [("A", None, None, "CWE-89", "x", None), ("B", "src/a.py", None, "CWE-79", "x", None), ("D", "src/a.py", 3, None, "x", None)])
    every = {"A", "B", "D", *(f"C{k}" for k in range(5))}
    assert {r.finding_id for r in R.baseline_anti(spark, d).collect()} == every
    assert {(r.primary_key, r.merged) for r in R.merge_overlapping(spark, d).collect()} == {(f"finding s {k}", 1) for k in every}
    places = [json.loads(r.result)["locations"] for r in R.sarif_export(spark, d).collect()]
    assert len(places) == 8 and places.count([]) == 1
    got = R.systemic_clusters(spark, d)
    parent = [("parent", "s C0", 5, "high", "C-s C0")]
    children = [("child", f"s C{k}", 1, "medium", "C-s C0") for k in range(5)]
    untouched = [("untouched", f"s {k}", 1, "high", None) for k in "ABD"]
    assert rows(got, "kind", "first_id", "size", "severity", "cluster_id") == sorted(parent + children + untouched, key=str)


def test_near_duplicates_at_any_location_and_unknown_skills(spark, tmp_path):
    second = json.dumps({"locations": [{"path": "src/z.py", "start_line": 1}, {"path": "./src/a.py", "start_line": 12}]})
    far = second.replace("12", "14")
    data = [
        ("D", "src/a.py", 10, "CWE-89", "deterministic_detector", None), ("A", "src/z.py", 1, "CWE-89", "x", second), ("B", "src/z.py", 1, "CWE-89", "x", far),
        ("C", "src/z.py", 1, "CWE-89", None, None), ("E", "src/a.py", 11, "CWE-89", None, None), ("F", "src/z.py", 1, None, "n/a", second),
    ]
    assert rows(R.anti_near_duplicate(spark, _findings(spark, tmp_path, data)), "finding_id") == [("B",), ("C",), ("F",)]


def test_scanner_rows_of_the_repository_count_as_near(spark, tmp_path):
    data = [("A", "src/a.py", 10, "CWE-89", "x", None), ("B", "src/b.py", 10, "CWE-89", "x", None), ("C", "src/a.py", 10, "CWE-22", "x", None)]
    ext = [(1, "t", "a", "R.git", "./src/a.py", 13, None, None, "CWE-89"), (2, "t", "a", "other", "src/b.py", 10, None, None, "CWE-89")]
    assert rows(R.anti_near_duplicate(spark, _findings(spark, tmp_path, data, ext)), "finding_id") == [("B",), ("C",)]


def test_overlaps_of_more_than_half_merge_with_best_severity(spark, tmp_path):
    span = json.dumps({"locations": [{"path": "src/a.py", "start_line": 10, "end_line": 13}]})
    data = [("A", "src/a.py", 10, "CWE-89", "x", span), ("B", "src/a.py", 40, "CWE-89", "y", None)]
    ext = [(1, "t", "a", "r", "src/a.py", 11, 13, "critical", "CWE-89"), (2, "u", "a", "r", "src/a.py", 12, 15, "low", "CWE-89"), (3, "u", "a", "r", "src/a.py", 11, 13, "low", "CWE-22")]
    got = rows(R.merge_overlapping(spark, _findings(spark, tmp_path, data, ext)), "primary_key", "merged", "sev", "reported_by")
    # Row 2 shares two of four lines with the first one of its bucket, which is not more than half.
    assert got == sorted([("report 1", 2, 5, "t;x"), ("report 2", 1, 2, "u"), ("report 3", 1, 2, "u"), ("finding s B", 1, 4, "y")], key=str)


def test_last_rows_read_only_what_is_wanted(spark):
    plan = R.severity_counts(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    read = [x for x in plan.split("ReadSchema: ")[1:] if "reviewer_verdict" in x][0].split(">")[0]
    assert "finding_json" not in read and read.count(":") <= 8
