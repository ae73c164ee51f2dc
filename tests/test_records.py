import json

from siftstone.plans import records
from tests.conftest import rows

FINDINGS = "scan_id string, finding_id string, repo string, title string, severity string, cwe string, cvss_vector string, cvss_score double, path string, start_line int, skill string, confidence double, validator_verdict string, reviewer_verdict string, reviewer_at timestamp_ntz, finding_json string, recorded_at timestamp_ntz"


def _findings(spark, folder, given):
    names = [part.split()[0] for part in FINDINGS.split(", ")]
    data = [tuple({"scan_id": "s", "finding_id": f"F{k}"} .get(n) if n not in row else row[n] for n in names) for k, row in enumerate(given)]
    spark.createDataFrame(data, FINDINGS).write.parquet(f"{folder}/findings.parquet")


def test_replies_come_into_shape(spark, tmp_path):
    replies = [
        {"title": "  T  ", "file": "a.py", "line": "7", "severity": "CRIT", "confidence": 0, "taint": {"source": "x" * 400, "sanitizer_missing": "Yes"}},
        {"title": "t" * 300, "locations": [{"path": "b.py", "start_line": 3, "end_line": 5}], "severity": "odd", "confidence": 0.9, "description": "d" * 5000},
        {"title": " ", "path": "c.py"}, {"title": "no place", "severity": "info", "locations": None},
    ]
    texts = [json.dumps(r) for r in replies] + [json.dumps({"finding": replies[0]}), "{broken", None, ""]
    _findings(spark, tmp_path, [{"finding_json": t} for t in texts])
    got = records.normalised_replies(spark, str(tmp_path))
    kept = rows(got, "finding_id", "severity", "confidence", "path", "start_line", "end_line", "sanitizer_missing", "reject_reason")
    assert kept == sorted(
        [("F0", "critical", 0.5, "a.py", 7, None, True, None), ("F1", "medium", 0.9, "b.py", 3, 5, None, None), ("F2", "medium", 0.5, "c.py", 1, None, None, "no_title"),
         ("F3", "informational", 0.5, None, 1, None, None, "no_place"), ("F4", "critical", 0.5, "a.py", 7, None, True, None)], key=str)
    lengths = {r.finding_id: (len(r.title), len(r.description), r.source and len(r.source)) for r in got.collect()}
    assert lengths["F0"] == (1, 0, 300) and lengths["F1"] == (200, 4000, None)


def test_export_has_all_columns(spark, tmp_path):
    body = {"verification": {"verified": True, "score": 0.5, "signals": {"b": True, "a": True, "c": False}}, "corroborating_tools": ["x", "y"], "tags": [], "remediation": " fix\nit ", "reachability": 0.9, "locations": [{"end_line": 9}]}
    _findings(spark, tmp_path, [{"finding_json": json.dumps(body), "cwe": "cwe_089", "severity": "Info"}, {"finding_json": None}])
    got = records.full_export(spark, str(tmp_path))
    assert len(got.columns) == 26
    wanted = ("id", "severity", "cwe", "verified", "verification_score", "verification_signals", "corroborating_tools", "reachability", "end_line", "tags", "remediation")
    assert rows(got, *wanted) == [("F0", "informational", "CWE-89", True, 0.5, "a;b", "x;y", 0.9, 9, "", "fix it"), ("F1", "", "", False, None, "", "", None, None, "", "")]


def test_the_only_application_of_a_repository_is_implied(spark, tmp_path):
    scans = [("s", "one", "A"), ("t", "one", None), ("u", "many", "A"), ("v", "many", "B"), ("w", "many", " "), ("x", None, None), ("x", None, None)]
    spark.createDataFrame(scans, "scan_id string, repo string, application_id string").write.parquet(f"{tmp_path}/scans.parquet")
    _findings(spark, tmp_path, [{"scan_id": "t", "severity": "high"}, {"scan_id": "t", "severity": "low"}])
    got = rows(records.application_findings(spark, str(tmp_path)), "repo", "application_id", "implied", "scans", "findings", "severe")
    assert got == sorted([("one", "A", False, 1, 0, 0), ("one", "A", True, 1, 2, 1), ("many", "A", False, 1, 0, 0), ("many", "B", False, 1, 0, 0), ("many", None, False, 1, 0, 0), (None, None, False, 1, 0, 0)], key=str)


def test_places_are_checked_against_known_files(spark, tmp_path):
    hits = [(1, "r", "a/x.py", 10, "sink", "sink", "x = 1\ncursor.execute(q)", "CWE-89", None, None, None)]
    spark.createDataFrame(hits, "hit_id long, repo string, path string, line int, kind string, pattern_id string, snippet string, cwe_hint string, reachable_from_source boolean, corroborated_by array<string>, indexed_at timestamp_ntz").write.parquet(f"{tmp_path}/structural_hits.parquet")
    told = [(1, "t", "q", "m", "r", "a/x.py", 20, 22, "high", None, None)]
    spark.createDataFrame(told, "ext_id long, tool string, rule_id string, message string, repo string, path string, start_line int, end_line int, severity string, cwe string, reported_at timestamp_ntz").write.parquet(f"{tmp_path}/external_findings.parquet")
    place = lambda line, cwe="CWE-89", path="a/x.py", repo="r": {"repo": repo, "path": path, "start_line": line, "cwe": cwe}
    _findings(spark, tmp_path, [place(16), place(17), place(22), place(23), place(0), place(12, "CWE-327"), place(12, "CWE-1"), place(5, path="b/y.py"), place(11, repo="other"), place(None), place(11, path=None)])
    got = rows(records.place_grounding(spark, str(tmp_path)), "finding_id", "path_check", "line_check", "window_check", "grounded")
    assert got == sorted([
        ("F0", "pass", "pass", "pass", True), ("F1", "pass", "pass", "unknown", True), ("F2", "pass", "pass", "unknown", True), ("F3", "pass", "fail", "unknown", False), ("F4", "pass", "fail", "unknown", False),
        ("F5", "pass", "pass", "fail", False), ("F6", "pass", "pass", "unknown", True), ("F7", "fail", "unknown", "unknown", False), ("F8", "fail", "unknown", "unknown", False),
        ("F9", "pass", "unknown", "unknown", False), ("F10", "unknown", "unknown", "unknown", False)], key=str)
