import random
from datetime import datetime as T

from siftstone.operators.snapshots import assign_ordinals, newest, snapshot_changes, snapshot_counts, snapshots
from tests.conftest import rows

SCAN = "scan_id string, repo string, application_id string, target_sha string, started_at timestamp, ended_at timestamp"
FINDING = "scan_id string, finding_id string, severity string, cwe string, path string, start_line int"


def _scan(i, day, sha, app="a", done=True):
    return (i, "r", app, sha, T(2024, 1, day), T(2024, 1, day, 1) if done else None)


def test_runs_of_one_sha_are_one_snapshot(spark):
    scans = spark.createDataFrame(
        [_scan("s3", 3, "y"), _scan("s1", 1, "x"), _scan("s2", 2, "X "), _scan("open", 4, "z", done=False), _scan("n1", 5, None), _scan("n2", 6, None), _scan("b", 7, "y"), _scan("o", 1, "q", None), (None, "r", "a", "k", T(2024, 1, 9), T(2024, 1, 9))],
        SCAN,
    )
    got = {r.scan_id: (r.seq, r.next_scan_id) for r in snapshots(scans).collect()}
    assert got == {"s2": (1, "s3"), "s3": (2, "n1"), "n1": (3, "n2"), "n2": (4, "b"), "b": (5, None), "o": (1, None)}
    assert rows(newest(scans), "scan_id") == [("b",), ("o",)]


def test_changes_by_meaning(spark):
    scans = spark.createDataFrame([_scan("s1", 1, "x"), _scan("s2", 2, "y"), _scan("s3", 3, "z")], SCAN)
    findings = spark.createDataFrame(
        [
            ("s1", "same", "Info", "cwe_089", "./src//A.py", 5), ("s2", "same", "informational ", "CWE-89", "src\\a.py", 5), ("s2", "same", "informational", "CWE-0089", "src/a.py", 5),
            ("s1", "moved", "low", "CWE-1", "a", 5), ("s2", "moved", "low", "CWE-1", "a", 6), ("s1", "gone", None, None, None, None), ("s2", "new", None, "n/a", None, None),
            ("s2", "lost", "low", "CWE-1", "a", None), ("s1", "lost", "low", "unknown", "a", None), ("s1", None, "low", None, None, 1), ("other", "x", "low", None, None, 1),
        ], FINDING)
    got = snapshot_changes(findings, scans)
    want = [("s2", "gone", "removed"), ("s2", "lost", "changed"), ("s2", "moved", "changed"), ("s2", "new", "added")]
    want += [("s3", k, "removed") for k in ("lost", "moved", "new", "same")]
    assert rows(got) == sorted(want, key=str)


def test_against_sets_over_many_keys(spark):
    rng = random.Random(9)
    held = [{f"F{k}": rng.randint(1, 3) for k in range(3000) if rng.random() < 0.6} for _ in range(4)]
    scans = spark.createDataFrame([_scan(f"s{i}", i + 1, str(i)) for i in range(4)], SCAN)
    findings = spark.createDataFrame([(f"s{i}", k, "low", "CWE-1", "p", v) for i, h in enumerate(held) for k, v in h.items()], FINDING)
    want = set()
    for i in range(1, 4):
        a, b = held[i - 1], held[i]
        want |= {(f"s{i}", k, "added") for k in b.keys() - a.keys()} | {(f"s{i}", k, "removed") for k in a.keys() - b.keys()}
        want |= {(f"s{i}", k, "changed") for k in a.keys() & b.keys() if a[k] != b[k]}
    assert {tuple(r) for r in snapshot_changes(findings, scans).collect()} == want
    counts = {r.scan_id: r.n_common for r in snapshot_counts(findings, scans).collect()}
    assert counts == {f"s{i}": len(held[i].keys() & held[i - 1].keys()) for i in range(1, 4)}


def test_ordinals_persist_and_grow(spark):
    one = spark.createDataFrame([("s", f"k{i}") for i in range(9000)] + [("t", "k1"), (None, "x"), ("s", None)], "space string, key string")
    first = assign_ordinals(one, "space", "key").cache()
    assert first.count() == 9001 and first.select("space", "ordinal").distinct().count() == 9001
    more = one.unionByName(spark.createDataFrame([("s", "new"), ("u", "k")], one.schema))
    second = assign_ordinals(more, "space", "key", first)
    assert second.join(first, ["space", "key", "ordinal"]).count() == 9001 and second.select("space", "ordinal").distinct().count() == 9003


def test_empty_and_clashing_columns(spark):
    scans = spark.createDataFrame([], SCAN + ", stream string, seq int")
    findings = spark.createDataFrame([], FINDING + ", word long, bit int, stream string")
    assert snapshot_changes(findings, scans).count() == 0
