import os
import random
from datetime import datetime

from siftstone.llm.history import AcceptedHistory, repeated_findings
from tests.conftest import rows

ENTRY = "entry_id long, repo string, path string, cwe string, start_line int, accepted_at timestamp"
FINDING = "scan_id string, finding_id string, repo string, path string, cwe string, start_line int"
SCAN = "scan_id string, repo string, application_id string, target_sha string, started_at timestamp, ended_at timestamp"
T = datetime


def _scans(spark):
    return spark.createDataFrame(
        [("old", "r", "a", "1", T(2024, 1, 1), T(2024, 1, 1, 1)), ("new", "r", "a", "2", T(2024, 2, 1), T(2024, 2, 1, 1)), ("open", "r", "a", "3", T(2024, 3, 1), None)], SCAN
    )


def test_matches_by_meaning_and_distance(spark):
    findings = spark.createDataFrame(
        [
            ("new", "near", "r", "src/a/b/c.py", "CWE-89", 20), ("new", "near", "r", "src/a/b/c.py", "cwe_089", 20), ("new", "far", "r", "src/a/b/c.py", "CWE-89", 31),
            ("new", "none", "r", "src/a/b/c.py", "n/a", 10), ("new", "nopath", "r", None, "CWE-89", 10), ("new", "noline", "r", "src/a/b/c.py", "CWE-89", None),
            ("old", "near", "r", "src/a/b/c.py", "CWE-89", 20), ("open", "near", "r", "src/a/b/c.py", "CWE-89", 20),
        ], FINDING)
    entries = spark.createDataFrame(
        [
            (1, "R.git", ".\\A\\B\\C.py", "CWE 89", 10, T(2024, 1, 1)), (2, "r-fork", "a/b/c.py", "CWE-89", 20, T(2024, 1, 1)), (3, "r", "a/b/c.py", "CWE-89", 20, T(2024, 5, 1)),
            (4, "r", "a/b/c.py", None, 10, T(2024, 1, 1)), (5, "r", "a/b/c.py", "CWE-89", 20, None), (6, None, None, None, None, None), (None, "r", "a/b/c.py", "CWE-89", 20, T(2024, 1, 1)),
        ], ENTRY)
    got = repeated_findings(findings, _scans(spark), entries)
    assert rows(got) == [("new", "near", 1, 10), ("new", "none", 4, 0)]


def test_every_distance_against_brute_force(spark):
    rng = random.Random(5)
    entries = [(i, "r", f"d/e/{rng.choice('xy')}.py", "CWE-1", rng.randint(1, 300), T(2024, 1, 1)) for i in range(200)]
    batch = [("new", f"F{i}", "r", f"d/e/{rng.choice('xy')}.py", "CWE-1", rng.randint(1, 300)) for i in range(200)]
    want = {(f[1], e[0]) for f in batch for e in entries if f[3] == e[2] and abs(f[5] - e[4]) <= 10}
    got = repeated_findings(spark.createDataFrame(batch, FINDING), _scans(spark), spark.createDataFrame(entries, ENTRY))
    assert {(r.finding_id, r.entry_id) for r in got.collect()} == want


def test_second_batch_meets_first_without_rewriting(spark):
    history = AcceptedHistory(spark).accept(spark.createDataFrame([(1, "r", "a/b/c", "CWE-1", 5, T(2024, 1, 1))], ENTRY))
    history.accept(spark.createDataFrame([(2, "r", "a/b/c", "CWE-1", 9, T(2024, 1, 2))], ENTRY))
    assert history.generations == 2
    batch = spark.createDataFrame([("s", "f", "r", "a/b/c", "CWE-1", 7), ("s", "g", "other", "a/b/c", "CWE-1", 7)], FINDING)
    assert rows(history.matches(batch, ["scan_id", "finding_id"]), "finding_id", "entry_id") == [("f", 1), ("f", 2)]


def test_filters_rule_out_most_of_what_is_not_held(spark):
    history = AcceptedHistory(spark).accept(spark.createDataFrame([(i, "r", f"a/b/{i}", "CWE-1", 5, T(2024, 1, 1)) for i in range(500)], ENTRY))
    probes = spark.range(5000).selectExpr("xxhash64(id) as fingerprint", "id as spot")
    assert history.prescreen(probes, history.held[0]).count() < 100


def test_a_history_lasts(spark, tmp_path):
    path = f"file://{tmp_path}/history"
    entries = [(i, "r", f"a/b/{i % 7}", "CWE-1", 40 * i, T(2024, 1, 1)) for i in range(60)]
    AcceptedHistory(spark, path).accept(spark.createDataFrame(entries[:30], ENTRY))
    other = spark.newSession()
    again = AcceptedHistory(other, path)
    assert again.generations == 1
    again.accept(other.createDataFrame(entries[20:], ENTRY)).accept(other.createDataFrame(entries, ENTRY))
    last = AcceptedHistory(spark, path)
    assert last.generations == 2 and sum(r.n_rows for r in last.held) == AcceptedHistory(spark).accept(spark.createDataFrame(entries, ENTRY)).held[0].n_rows
    batch = spark.createDataFrame([("s", str(i), "r", f"a/b/{i % 7}", "CWE-1", 40 * i + 3) for i in range(60)], FINDING)
    assert rows(last.matches(batch, ["finding_id"]), "finding_id", "entry_id") == sorted(((str(i), i) for i in range(60)), key=str)


def test_generations_are_merged_and_keep_all(spark, tmp_path):
    history = AcceptedHistory(spark, f"file://{tmp_path}/history", most_generations=2, bucket_rows=50)
    for k in range(5):
        history.accept(spark.createDataFrame([(10 * k + i, "r", "a/b/c", "CWE-1", 1000 * k + 50 * i, T(2024, 1, 1)) for i in range(10)], ENTRY))
    history = AcceptedHistory(spark, f"file://{tmp_path}/history")
    assert history.generations <= 2
    batch = spark.createDataFrame([("s", str(10 * k + i), "r", "a/b/c", "CWE-1", 1000 * k + 50 * i) for k in range(5) for i in range(10)], FINDING)
    assert {(r.finding_id, r.entry_id) for r in history.matches(batch, ["finding_id"]).collect()} == {(str(i), i) for i in range(50)}


def test_reading_follows_the_batch_and_not_the_history(spark, tmp_path):
    def read_bytes(n):
        entries = spark.range(n).selectExpr("id as entry_id", "'r' as repo", "concat('a/b/f', id div 20) as path", "'CWE-1' as cwe", "cast(100 * (id % 20) as int) as start_line", "timestamp'2024-01-01' as accepted_at")
        history = AcceptedHistory(spark, f"file://{tmp_path}/h{n}", bucket_rows=1000).accept(entries)
        batch = spark.createDataFrame([("s", str(i), "r", f"a/b/f{i}", "CWE-1", 100) for i in range(3)], FINDING)
        fingerprints = history._fingerprinted(batch, ["finding_id"])
        generation = history.held[0]
        hit = [r.bucket for r in history.prescreen(fingerprints, generation).select("bucket").distinct().collect()]
        files = history._store(generation, hit).select("entry_id").inputFiles()
        assert history.matches(batch, ["finding_id"]).count() == 3
        return generation.buckets, len(hit), sum(os.path.getsize(f.removeprefix("file://")) for f in files if any(f"bucket={b}/" in f for b in hit))

    small, large = read_bytes(2000), read_bytes(20000)
    assert large[0] >= 9 * small[0] and large[1] <= 6 and large[2] / large[1] <= 1.2 * small[2] / small[1]


def test_empty_tables_and_clashing_columns(spark):
    none, findings = spark.createDataFrame([], ENTRY), spark.createDataFrame([], FINDING)
    assert repeated_findings(findings, _scans(spark), none).count() == 0
    one = spark.createDataFrame([("new", "f", "r", "a/b/c", None, 1, "x", 7, "y")], FINDING + ", started_at string, bucket int, fingerprint string")
    held = spark.createDataFrame([(1, "r", "a/b/c", "", 1, T(2024, 1, 1), "z", 3)], ENTRY + ", fingerprint string, line_l int")
    assert rows(repeated_findings(one, _scans(spark), held), "finding_id", "entry_id") == [("f", 1)]
