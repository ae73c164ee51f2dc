import json
import random

from pyspark.sql import functions as F

from siftstone.functions.levelling import level_cwe, level_path, level_repo, level_severity, level_verdict, level_word, path_tail
from siftstone.operators import aggregates as A
from siftstone.operators import index as X
from siftstone.operators import joins as J
from siftstone.operators import scoring as S
from siftstone.operators.store import apply_marks, latest_rows, upsert
from siftstone.sinks.export import sarif_results, sarif_rules, write_flat
from siftstone.sources.external import external_findings, ingest_errors, read_reports
from siftstone.sources.files import byte_budget, comment_marks, intake, read_files, read_targets, reply_json
from siftstone.streaming.feeds import VersionedStore, fold_feed
from tests.conftest import rows


def _one(spark, expr, values, type_="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {type_}")
    return [r[0] for r in df.orderBy("i").select(expr(F.col("v"))).collect()]


def test_levelling(spark):
    assert _one(spark, level_cwe, ["CWE-0089", "cwe 79", "external/cwe/cwe-022", "89", "n/a", "", None, " CWE_5 "]) == [89, 79, 22, 89, None, None, None, 5]
    assert _one(spark, level_severity, ["Info", "MODERATE ", "high", "", None]) == ["informational", "medium", "high", None, None]
    assert _one(spark, level_path, ["./a//B\\c.py ", "a/../x/y", "a%2Fb", "file:///w/a", "", None, ".github/x"]) == ["a/b/c.py", "x/y", "a/b", "w/a", None, None, ".github/x"]
    assert _one(spark, lambda c: path_tail(level_path(c)), ["a/b/c/d", "c/d"]) == ["b/c/d", "c/d"]
    assert _one(spark, level_repo, ["git@h:t/R.git", "https://h/t/r/", "R-fork", " ", None]) == ["r", "r", "r-fork", None, None]
    assert _one(spark, level_verdict, ['{"verdict": "reject"}', "True Positive", "unsure", "what", None]) == ["reject", "confirm", "uncertain", None, None]
    assert _one(spark, level_word, ["Fast-Triage ", "UNK", None]) == ["fast_triage", None, None]


def test_line_index_skips_comments_and_reads_routes(spark):
    code = "# eval(x)\nvalue = eval(x)\n  // os.system(a)\nos.system(a); h = hashlib.md5(b)\n@app.get('/u/<id>')\nDocumentBuilderFactory.newInstance().x setFeature"
    lines = X.lines(spark.createDataFrame([(1, code), (2, None), (3, "")], "id int, text string"), ["id"], "text")
    hits = rows(X.line_hits(lines).where("hit_class = 'sink'"), "line_no", "kind")
    assert hits == [(2, "eval_call"), (4, "os_system"), (4, "weak_hash")] or hits == [(2, "eval_call"), (4, "os_system"), (4, "weak_hash"), (6, "java_dbf_xxe")]
    assert rows(X.route_values(lines), "line_no", "route") == [(5, "/u/<id>")]
    around = spark.createDataFrame([(1, 1)], "id int, line_no int")
    assert X.context(lines, ["id"], around, 1).first().window == "# eval(x)\nvalue = eval(x)"
    top = X.top_per_class(spark.range(500).selectExpr("cast(id % 2 as string) as hit_class", "id", "'k' as kind"), ["id"], 3)
    assert rows(top, "id", "rank") == [(0, 1), (1, 1), (2, 2), (3, 2), (4, 3), (5, 3)]


def test_near_pairs_and_nearest_against_brute_force(spark):
    rng = random.Random(2)
    left = [(i, rng.choice("ab"), rng.randint(1, 400)) for i in range(150)] + [(900, None, 3), (901, "a", None)]
    right = [(i, rng.choice("ab"), rng.randint(1, 400), rng.random() < 0.3) for i in range(150)] + [(902, None, 3, True)]
    ldf = spark.createDataFrame(left, "id int, file string, line long")
    rdf = spark.createDataFrame(right, "rid int, file string, other_line long, unreached boolean")
    want = {(a, b) for a, f, x in left for b, g, y, _ in right if f and f == g and x is not None and abs(x - y) <= 5}
    assert {(r.id, r.rid) for r in J.near_pairs(ldf, rdf, ["file"], 5).collect()} == want
    assert {r.id for r in J.near_anti(ldf, rdf, ["id"], ["file"], 5).collect()} == {a for a, _, _ in left} - {a for a, _ in want}
    best = {a: min(((u, abs(x - y), b) for b, g, y, u in right if g == f), default=None) for a, f, x in left if f and x is not None}
    got = J.nearest_either_side(ldf.where("file is not null and line is not null"), rdf.withColumnRenamed("other_line", "line"), "id", ["file"], "unreached", "rid")
    assert {r.id: (r.unreached, r.line_delta, r.rid) for r in got.collect()} == best


def test_votes_reliability_and_calibration(spark):
    v = spark.createDataFrame([("f", "confirm"), ("f", "confirm"), ("f", None), ("g", "reject")], "k string, v string")
    assert rows(A.quorum(v, ["k"], "v")) == [("f", 2, 0, 1, True), ("g", 0, 1, 0, False)]
    marks = spark.createDataFrame([("a", "TP"), ("a", "TP"), ("a", "FP"), ("b", "FP"), (None, "TP")], "cwe string, mark string")
    rel = A.smoothed_reliability(marks, "cwe")
    assert rows(rel) == [("a", 2, 1, 0.6), ("b", 0, 1, None)]
    f = spark.createDataFrame([("a", "x", 0.95), ("b", "x", 0.5), (None, None, 0.5)], "cwe string, skill string, confidence double")
    none = spark.createDataFrame([], "skill string, reliability double")
    assert [round(r[0], 4) for r in sorted(A.calibrated(f, rel, none).select("calibrated").collect())] == [0.5, 0.5, 0.99]
    a, b, fitted = A.platt(spark.createDataFrame([(x / 100, int(x > 50)) for x in range(100)], "score double, label int"))
    assert fitted and a > 1 and b < 0
    assert A.platt(spark.createDataFrame([(0.5, 1)] * 9, "score double, label int"))[2] is False


def test_merge_and_clusters(spark):
    cols = "id string, cwe string, path string, line long, last_line long, sev int, confidence double"
    f = spark.createDataFrame([("A", "1", "p", 10, 19, 3, 0.5), ("B", "1", "p", 14, 23, 4, 0.1), ("C", "1", "p", 19, 28, 1, 0.9), ("D", "1", "q", 10, 19, 3, 0.5)], cols)
    assert rows(A.merged(f, ["cwe", "path"], "id"), "id", "primary") == [("A", "B"), ("B", "B"), ("C", "C"), ("D", "D")]
    g = spark.createDataFrame([("m", f"p{i:02d}", f"f{i:02d}", i / 20) for i in range(12)] + [("n", "p", "z", 0.1)] * 4, "module string, path string, id string, confidence double")
    got = A.systemic(g, ["module"], "id").collect()
    assert len(got) == 1 and got[0]["size"] == 12 and got[0].paths == ";".join(f"p{i:02d}" for i in range(10)) and got[0].first_id == "f00"
    assert rows(A.zero_filled_counts(g, "module", ["m", "x"]), "module", "n") == [("m", 12), ("x", 0)]


def test_scores(spark):
    payloads = [("' OR '1'='1", 89, True), ("--", 89, False), ("1; DROP TABLE x", 89, True), ("; cat /etc/passwd", 78, True), ("cat x", 78, False), ("../../x", 22, True), ("../x", 22, False), ("http://169.254.169.254/a", 918, True), ("http://example.org", 918, False), ("<script>", 79, True), ("", 79, False), ("__import__('os')", 95, True), ("x", 7, None), (None, 89, False)]
    df = spark.createDataFrame(list(enumerate(payloads)), "i int, p struct<t:string,c:int,w:boolean>")
    assert [r[0] for r in df.orderBy("i").select(S.demonstrates(F.col("p.t"), F.col("p.c"))).collect()] == [w for _, _, w in payloads]
    assert _one(spark, S.is_concrete, ["curl http://a/", "TODO", "<payload_here>", "", None, "abc"]) == [True, False, False, False, False, False]
    c = spark.createDataFrame([(89, True), (79, True), (None, False)], "c int, r boolean").select(*S.cvss(F.col("c"), F.col("r"), F.lit(False), F.lit(False)))
    assert [tuple(r) for r in c.collect()] == [("CVSS:3.1/AV:N/AC:L/PR:N/UI:N/S:U/C:H/I:H/A:L", 9.4), ("CVSS:3.1/AV:N/AC:L/PR:N/UI:R/S:C/C:L/I:L/A:N", 6.1), ("CVSS:3.1/AV:L/AC:L/PR:N/UI:N/S:U/C:L/I:L/A:N", 5.2)] or c.collect()[2][1] == 5.1
    text = "AWS_SECRET_ACCESS_KEY = 'abcd1234' and Bearer abcdefghij1 and db://u:pw123@h and plain code = 1"
    once = _one(spark, S.redacted, [text])[0]
    assert "abcd1234" not in once and "abcdefghij1" not in once and "pw123" not in once and "plain code = 1" in once and _one(spark, S.redacted, [once]) == [once]


def test_store_and_stream(spark, tmp_path):
    t = "k string, at long, a string, b string"
    old, new = spark.createDataFrame([("x", 1, "p", None), ("y", 5, "q", "r")], t), spark.createDataFrame([("x", 2, None, "s"), ("y", 4, "late", None), ("z", None, "n", None)], t)
    want = [("x", 2, None, "s"), ("y", 5, "q", "r"), ("z", None, "n", None)]
    assert rows(upsert(old, new, ["k"], ["at"])) == want
    assert rows(latest_rows(old.limit(0), ["k"], ["at"])) == []
    marks = spark.createDataFrame([("x", "m"), ("nobody", "m")], "k string, b string")
    assert rows(apply_marks(old, marks, ["k"], "b"), "k", "b") == [("x", "m"), ("y", "r")]
    feed = str(tmp_path / "feed")
    old.write.parquet(feed)
    store = VersionedStore(spark, f"file://{tmp_path}/store", ["k"], ["at"])
    for batch in (None, new):
        if batch is not None:
            batch.write.mode("append").parquet(feed)
        fold_feed(spark.readStream.schema(old.schema).parquet(feed), store, f"file://{tmp_path}/state").awaitTermination(120)
    assert rows(store.read()) == want
    store.upsert(old, 0)
    assert rows(store.read()) == want


def test_external_reports(spark, tmp_path):
    rule = {"id": "r1", "properties": {"tags": ["external/cwe/cwe-089"]}, "defaultConfiguration": {"level": "warning"}}
    place = {"physicalLocation": {"artifactLocation": {"uri": "file://src/a.py"}, "region": {"startLine": 4, "endLine": 5}}}
    reports = {
        "s.sarif": {"version": "2.1.0", "runs": [{"tool": {"driver": {"name": "T", "rules": [rule]}}, "results": [{"ruleIndex": 0, "message": {"text": "m"}, "locations": [place]}, {"ruleId": "r1", "suppressions": [{}], "locations": [place]}]}]},
        "semgrep.json": {"results": [{"check_id": "c", "path": "./b.py", "start": {"line": 2}, "end": {"line": 3}, "extra": {"message": "m", "severity": "ERROR", "metadata": {"cwe": ["CWE-95: x 2021"]}}}]},
        "bandit.json": {"results": [{"filename": "c.py", "line_number": 7, "test_id": "B1", "issue_text": "i", "issue_severity": "LOW", "issue_cwe": {"id": 78}}]},
        "leaks.json": [{"RuleID": "k", "File": "d.py", "StartLine": 9, "Description": ""}],
        "trivy.json": {"Results": [{"Target": "e", "Vulnerabilities": [{"VulnerabilityID": "V", "Title": "t", "Severity": "HIGH", "CweIDs": ["CWE-22"]}], "Secrets": [{"RuleID": "q", "StartLine": 3}]}]},
        "grype.json": {"matches": [{"vulnerability": {"id": "G", "severity": "Medium"}, "artifact": {"name": "n", "locations": [{"path": "f"}]}}]},
        "rows.json": [{"file": "g.py", "start_line": "6", "message": "m", "severity": "info"}, {"message": "no path"}],
    }
    for name, data in reports.items():
        (tmp_path / name).write_text(json.dumps(data))
    (tmp_path / "broken.json").write_text("{not json")
    docs = read_reports(spark, f"file://{tmp_path}")
    got = rows(external_findings(docs), "tool", "rule_id", "path", "start_line", "severity", "cwe")
    assert got == sorted(
        [("T", "r1", "src/a.py", 4, "medium", "CWE-89"), ("semgrep", "c", "b.py", 2, "high", "CWE-95"), ("bandit", "B1", "c.py", 7, "low", "CWE-78"), ("gitleaks", "k", "d.py", 9, "high", "CWE-798"),
         ("trivy", "V", "e", 1, "high", "CWE-22"), ("trivy", "q", "e", 3, "", "CWE-798"), ("grype", "G", "f", 1, "medium", None), ("rows", "unknown", "g.py", 6, "informational", None)], key=str)
    assert [r.error for r in ingest_errors(docs).collect()] == ["no valid JSON"]


def test_files_and_comments(spark, tmp_path):
    tree = tmp_path / "tree"
    (tree / "vendor").mkdir(parents=True)
    for name, text in {"a.py": "x", "b.py": "x", "c.txt": "x", "vendor/d.py": "y", "big.py": "z" * 50}.items():
        (tree / name).write_text(text)
    files = intake(read_files(spark, f"file://{tree}"), [".py"], ["*big*"], ["/vendor/"])
    assert {r.path.rsplit("/", 1)[1]: r.skip_reason for r in files.collect()} == {"a.py": None, "b.py": "duplicate", "c.txt": "suffix", "d.py": "excluded", "big.py": "glob"}
    sized = spark.createDataFrame([("g", i, s) for i, s in enumerate([5, 9, 4, 3, 1, 2])] + [("h", 0, 99)], "grp string, id int, size long")
    assert rows(byte_budget(sized, "grp", ["id"], 12, 3).where("taken"), "grp", "id") == [("g", 0), ("g", 2), ("g", 3)]
    assert rows(byte_budget(sized, "grp", ["id"], 11, 9).where("taken"), "grp", "id") == [("g", 0), ("g", 2), ("g", 4)]
    (tmp_path / "t.csv").write_text("repo,app_id\n/a,A1\n,A2\n")
    assert rows(read_targets(spark, f"file://{tmp_path}/t.csv")) == [("/a", "A1")]
    text = "<!-- vuln-id: F-1 scan-id: s1 -->\n- [ ] True positive\n- [x] False positive\n<!-- vuln-id: F-2 scan-id: s1 -->\n- [X] true positive\n<!-- VULN-ID: F-3 scan-id: s2 -->"
    assert rows(comment_marks(spark.createDataFrame([(text,), (None,), ("",)], "c string"), "c")) == [("s1", "F-1", "FP"), ("s1", "F-2", "TP"), ("s2", "F-3", "UNK")]
    replies = ['say ```json\n{"v": "a"}\n``` ok', 'x {"v": "b"} y', "none", None, "{broken"]
    assert _one(spark, lambda c: reply_json(c, "v string")["v"], replies) == ["a", "b", None, None, None]


def test_sinks(spark, tmp_path):
    f = spark.createDataFrame([("s", "t1", "p", 3, "CWE-1", "high", ["a", "b"]), ("s", "password = 'abcdef12'", "p", 4, "CWE-1", "low", None), ("s", "x", None, 1, None, None, None)], "scan_id string, title string, path string, start_line int, cwe string, severity string, tags array<string>")
    results = [json.loads(r.result) for r in sarif_results(f).collect()]
    assert [r["level"] for r in results] == ["error", "note"] and "abcdef12" not in str(results)
    assert sarif_rules(f).count() == 2
    write_flat(f, f"file://{tmp_path}/flat")
    assert rows(spark.read.csv(f"file://{tmp_path}/flat", header=True), "tags", "title")[0] == ("a;b", "t1")


def test_nested_redaction_and_signs(spark):
    df = spark.createDataFrame([(({"k": "token: abcd12345"}, ["Bearer abcdefghij1", None], 3),), (None,)], "v struct<m:map<string,string>,a:array<string>,n:int>")
    got = df.select(S.redacted_nested(F.col("v"), df.schema["v"].dataType).alias("v")).collect()
    assert got[1].v is None and got[0].v.n == 3 and "abcd12345" not in got[0].v.m["k"] and "abcdefghij1" not in got[0].v.a[0] and got[0].v.a[1] is None
    signs = spark.createDataFrame([("cursor.execute(q)", 89), ("x", 89), (None, 89), ("x", 5)], "t string, c int")
    assert [r[0] for r in signs.select(S.grounded(F.col("t"), F.col("c"))).collect()] == [True, False, False, None]
