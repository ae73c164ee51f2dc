import math
import random
from datetime import datetime as T

import pytest

from siftstone.llm.consensus import agreement, consensus, finding_verdicts
from siftstone.llm.mixing import bisect_exponent, draw, entropy, mix_report, plan_mix, temperature_weights, weigh

VOTE = "vote_id long, scan_id string, finding_id string, role string, verdict string, voted_at timestamp"


def test_consensus_learns_who_is_wrong(spark):
    rng = random.Random(6)
    skill = {"good": 0.92, "fine": 0.85, "fair": 0.8, "liar": 0.2, "coin": 0.5}
    truth = {f"i{k}": rng.choice(["confirm", "reject"]) for k in range(300)}
    other = {"confirm": "reject", "reject": "confirm"}
    labels = [(i, a, t if rng.random() < p else other[t]) for i, t in truth.items() for a, p in skill.items()]
    labels += [("i0", None, "confirm"), (None, "good", "confirm"), ("i1", "good", None)]
    verdicts, who = consensus(spark.createDataFrame(labels, "item string, annotator string, label string"))
    right = sum(truth[r.item] == r.verdict for r in verdicts.collect())
    reliability = {r.annotator: r.reliability for r in who.collect()}
    assert right >= 0.9 * 300
    assert reliability["good"] > reliability["fair"] > reliability["coin"] > reliability["liar"]


def test_every_voted_finding_has_a_verdict(spark):
    t = T(2024, 1, 1)
    votes = spark.createDataFrame(
        [(1, "s", "A", "R-1", "confirm", t), (2, "s", "A", "r_1", "confirm", t), (3, "s", "A", "r2", '{"verdict": "confirm"}', t), (4, "s", "B", "r1", None, None), (5, "gone", "C", None, "FP", t), (6, None, "D", "r1", "confirm", t)], VOTE
    )
    findings = spark.createDataFrame([("s", "A", "confirmed", "TP")], "scan_id string, finding_id string, validator_verdict string, reviewer_verdict string")
    scans = spark.createDataFrame([("s", "r", None)], "scan_id string, repo string, application_id string")
    got = {(r.scan_id, r.finding_id): r.verdict for r in finding_verdicts(votes, findings, scans).collect()}
    assert set(got) == {("s", "A"), ("s", "B"), ("gone", "C")} and got["s", "A"] == "confirm"
    assert finding_verdicts(votes.limit(0), findings, scans).count() == 0


def test_agreement(spark):
    t = T(2024, 1, 1)
    votes = [(k, "s", f, r, v, t) for k, (f, r, v) in enumerate([("A", "a", "confirm"), ("A", "b", "confirm"), ("B", "a", "reject"), ("B", "b", "reject"), ("B", "b", "reject")])]
    row = agreement(spark.createDataFrame(votes, VOTE)).first()
    assert row.alpha == pytest.approx(1.0) and row.n_votes == 4
    assert agreement(spark.createDataFrame([], VOTE)).first().observed is None


def test_temperature_meets_entropy():
    tokens = {"a": 800.0, "b": 150.0, "c": 50.0}
    goal = entropy([0.5, 0.3, 0.2])
    e = bisect_exponent(tokens, lambda w: entropy(list(w.values())) <= goal)
    assert entropy(list(temperature_weights(tokens, e).values())) == pytest.approx(goal, abs=1e-6)


def test_weights_respect_caps_and_sum():
    mix = weigh({"a": 1000.0, "b": 10.0, "c": 500.0}, {"a": 0.3, "b": 0.3, "c": 0.4, "absent": 0.2}, {"a": 1, "b": 2, "c": 3}, 1000)
    assert mix.shares["b"] == pytest.approx(0.02) and sum(mix.shares.values()) == pytest.approx(1)
    # Both targets are met, and what b and the absent source can't give goes by temperature.
    assert mix.shares["a"] > 0.3 / 1.2 and mix.shares["c"] > 0.4 / 1.2 and mix.shares["a"] <= 1.0
    assert weigh({}, {"a": 1.0}, {}).shares == {}


def test_temperature_rules_where_no_target_does():
    tokens, caps = {"a": 800.0, "b": 150.0, "c": 50.0}, {"a": 9, "b": 9, "c": 9}
    free = weigh(tokens, dict.fromkeys(tokens), caps)
    assert free.shares == pytest.approx(temperature_weights(tokens, free.exponent_by_entropy)) and sum(free.shares.values()) == pytest.approx(1)
    tight = weigh(tokens, dict.fromkeys(tokens), {"a": 2, "b": 2, "c": 2})
    assert all(tight.shares[s] * 1000 <= 2 * tokens[s] * (1 + 1e-9) for s in tokens) and sum(tight.shares.values()) == pytest.approx(1)
    some = weigh(tokens, {"a": 0.5, "b": None, "c": None}, caps)
    assert some.shares["a"] == pytest.approx(0.5) and some.shares["b"] + some.shares["c"] == pytest.approx(0.5)
    met = weigh(tokens, {"a": 0.5, "b": 0.3, "c": 0.2}, caps)
    assert met.shares == pytest.approx({"a": 0.5, "b": 0.3, "c": 0.2})


def test_drawn_records_meet_budgets(spark):
    rng = random.Random(0)
    counts = spark.createDataFrame([(i, "big" if i % 3 else "small", rng.randint(5, 50)) for i in range(900)], "doc_id long, source string, tokens long")
    targets = spark.createDataFrame([("Big", 0.5, 4), ("small ", 0.5, 3), ("none", 0.0, 1)], "source string, target_weight double, max_repeats int")
    mix, rows = plan_mix(counts, targets)
    held = {r.source: float(r.tokens or 0) for r in rows}
    got = draw(counts, mix, held).groupBy("source").agg({"tokens": "sum", "pass": "max"}).collect()
    for r in got:
        assert 0 <= r["sum(tokens)"] - mix.shares[r.source] * mix.budget < 50 and r["max(pass)"] <= 4
    twice = draw(counts, mix, held)
    assert twice.groupBy("doc_id", "source", "pass").count().where("count > 1").count() == 0


def test_report_with_dirty_rows(spark):
    docs = spark.createDataFrame([(1, "alpha beta gamma", "Web "), (2, None, "web"), (3, "  ", "web"), (4, "delta " * 400, None), (None, "x y", "web"), (5, "a b c d e", "code-x")], "doc_id long, text string, source string")
    targets = spark.createDataFrame([("web", 0.5, 2), ("code_x", 0.5, 2)], "source string, target_weight double, max_repeats int")
    got = {r.source: r for r in mix_report(docs, targets).collect()}
    assert got["web"].records == 1 and got["code_x"].records == 1 and math.isclose(sum(r.reached_share for r in got.values()), 1)
    assert mix_report(docs.limit(0), targets).count() == 2
