import itertools
import random
from datetime import datetime as T

from siftstone.llm.entities import best_assignment, matching_pairs, one_to_one
from tests.conftest import rows

FINDING = "scan_id string, finding_id string, repo string, path string, cwe string, start_line int"
EXT = "ext_id long, tool string, repo string, path string, cwe string, start_line int"
SCAN = "scan_id string, repo string, application_id string, target_sha string, started_at timestamp, ended_at timestamp"


def _scans(spark):
    return spark.createDataFrame([("s", "r", None, "1", T(2024, 1, 1), T(2024, 1, 2))], SCAN)


def test_spellings_missing_values_and_distance(spark):
    f = spark.createDataFrame([("s", "A", "r", "src/a/b/c.py", "CWE-89", 10), ("s", "A", "r", "./src/a/b/c.py", "cwe89", 10), ("s", "B", "r", "src/a/b/d.py", None, 256), ("s", "C", "r", None, None, 1)], FINDING)
    e = spark.createDataFrame(
        [
            (1, "t", "git@h:team/R.git", "C:\\ws\\r\\src\\a\\b\\c.py", "external/cwe/cwe-089", 13), (2, "t", None, "/builds/agent3/r/src/a/b/c.py", None, 7), (3, "t", None, "/builds/agent3/other/src/a/b/c.py", None, 10),
            (4, "t", "r-fork", "src/a/b/c.py", "CWE-89", 10), (5, "t", "r", "src/a/b/c.py", "CWE-79", 10), (6, "t", "r", "src/a/b/c.py", "CWE-89", 14), (7, "t", "r", "src%2Fa%2Fb%2Fd.py", "CWE-1", 259),
            (8, None, None, None, None, None), (9, "t", "r", "SRC/A/B/C.PY", "CWE-89", 10),
        ], EXT)
    got = matching_pairs(f, _scans(spark), e)
    assert rows(got, "finding_id", "ext_id", "line_delta") == [("A", 1, 3), ("A", 2, 3), ("A", 9, 0), ("B", 7, 3)]
    assert all(0 < r.confidence <= 1 for r in got.collect())


def test_assignment_is_best_and_one_to_one(spark):
    rng = random.Random(1)
    pairs = [(f"u{a}", b, round(rng.random(), 3)) for a in range(5) for b in range(5) if rng.random() < 0.7]
    df = spark.createDataFrame(pairs, "u_id string, v_id long, confidence double")
    weight = {(a, b): c for a, b, c in pairs}
    best = max(sum(weight.get((f"u{a}", b), 0) for a, b in enumerate(p)) for p in itertools.permutations(range(5)))
    got = one_to_one(df, ["u_id"], "v_id").collect()
    assert len({r.u_id for r in got}) == len(got) == len({r.v_id for r in got})
    assert abs(sum(r.confidence for r in got) - best) < 1e-9


def test_a_full_component_is_one_to_one(spark):
    df = spark.createDataFrame([(f"u{a}", b, 1.0 / (1 + a + b)) for a in range(8) for b in range(8)], "u_id string, v_id long, confidence double")
    got = one_to_one(df, ["u_id"], "v_id").collect()
    assert len({r.u_id for r in got}) == len(got) == 8


def test_long_chains_and_hot_places(spark):
    chain = [(f"c{k}", k + d, 0.5 + 0.01 * ((7 * k + d) % 5)) for k in range(50) for d in (0, 1)]
    hot = [(f"h{a}", 1000 + b, 0.9) for a in range(60) for b in range(40)]
    df = spark.createDataFrame(chain + hot, "u_id string, v_id long, confidence double")
    got = one_to_one(df, ["u_id"], "v_id").collect()
    assert len({r.u_id for r in got}) == len(got) == len({r.v_id for r in got}) == 90
    best = sum(chain[k][2] for k in best_assignment(*map(list, zip(*chain))))
    assert abs(sum(r.confidence for r in got) - best - 36) < 1e-6


def test_equal_rows_go_through_once_and_come_back(spark):
    f = spark.createDataFrame([("s", f"F{k}", "r", "src/a/b/c.py", "CWE-89", 10) for k in range(30)], FINDING)
    e = spark.createDataFrame([(k, "t", "r", "src/a/b/c.py", "CWE-89", 11 + k % 2) for k in range(40)], EXT)
    got = matching_pairs(f, _scans(spark), e)
    assert got.count() == got.select("finding_id", "ext_id").distinct().count() == 1200
    assert {r.line_delta for r in got.collect()} == {1, 2}


def test_empty(spark):
    f, e = spark.createDataFrame([], FINDING), spark.createDataFrame([], EXT + ", block string, cell int")
    pairs = matching_pairs(f, _scans(spark), e)
    assert pairs.count() == 0 and one_to_one(pairs, ["scan_id", "finding_id"], "ext_id").count() == 0


def test_small_assignments_are_exact():
    rng = random.Random(7)
    for _ in range(150):
        pairs = [(a, 10 + b, rng.choice([0.2, 0.5, rng.random()])) for a in range(rng.randint(1, 4)) for b in range(rng.randint(1, 4)) if rng.random() < 0.8] or [(0, 10, 0.5)]
        got = best_assignment(*map(list, zip(*pairs)))
        assert len({pairs[k][0] for k in got}) == len(got) == len({pairs[k][1] for k in got})
        best = max(
            sum(c for _, _, c in chosen)
            for n in range(5) for chosen in itertools.combinations(pairs, n) if len({p[0] for p in chosen}) == n == len({p[1] for p in chosen})
        )
        assert abs(sum(pairs[k][2] for k in got) - best) < 1e-9


def test_large_components_are_exact(spark):
    rng = random.Random(5)
    pairs = []
    # A chain where pairs best on both sides reach little more than half, a place that many rows share, and random ones.
    pairs += [("c0", 0, 0.5), ("c0", 1, 0.51), ("c1", 1, 0.5), ("c1", 2, 0.4), ("c2", 2, 0.41), ("c2", 3, 0.4)]
    pairs += [(f"h{a}", 100 + b, (0.9 if a < 7 else 0.8) - (0.3 if b < 9 else 0.2) * (a % 3 == 0)) for a in range(21) for b in range(20)]
    for k in range(6):
        pairs += [(f"r{k}.{a}", 1000 * (k + 1) + b, rng.choice([0.3, 0.55, 0.8, rng.random()])) for a in range(9) for b in range(7) if rng.random() < 0.5]
    df = spark.createDataFrame(pairs, "u_id string, v_id long, confidence double")
    best = sum(pairs[k][2] for k in best_assignment(*map(list, zip(*pairs))))
    got = one_to_one(df, ["u_id"], "v_id").collect()
    assert len({r.u_id for r in got}) == len(got) == len({r.v_id for r in got})
    assert abs(sum(r.confidence for r in got) - best) < 1e-9


def test_flows_between_groups_are_best():
    from siftstone.llm.entities import best_flows

    rng = random.Random(11)
    for _ in range(200):
        supply, room = {a: rng.randint(1, 3) for a in range(rng.randint(1, 4))}, {b: rng.randint(1, 3) for b in range(rng.randint(1, 4))}
        edges = [(a, b, rng.choice([0.2, 0.5, rng.random()])) for a in supply for b in room if rng.random() < 0.8 or b == 0]
        got = best_flows(edges, supply, room)
        single = [((a, i), (b, j), w) for a, b, w in edges for i in range(supply[a]) for j in range(room[b])]
        best = sum(single[k][2] for k in best_assignment(*map(list, zip(*single))))
        weight = {(a, b): w for a, b, w in edges}
        assert all(sum(f for (u, _), f in got.items() if u == a) <= n for a, n in supply.items())
        assert all(sum(f for (_, v), f in got.items() if v == b) <= n for b, n in room.items())
        assert abs(sum(weight[k] * f for k, f in got.items()) - best) < 1e-9
