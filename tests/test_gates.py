import json

import pytest
from pyspark.sql import functions as F

from siftstone.plans import core, gates, records, reference
from tests.conftest import rows

OWN = core.QUERIES | reference.QUERIES | gates.QUERIES | records.QUERIES
#: Domains that are shown in full, and totals, have rows even where no data are.
ALWAYS = {"severity_counts", "conditional_counts"}


@pytest.mark.parametrize("name", sorted(OWN))
def test_empty_and_dirty_tables(spark, edge_folders, name):
    empty, dirty = edge_folders
    assert name in ALWAYS or OWN[name](spark, empty).count() == 0
    OWN[name](spark, dirty).collect()


def test_quotes_need_length_and_ignore_blanks(spark):
    df = spark.createDataFrame([("Call  Me(now)", "we call\nme( NOW ) later"), ("short", "short"), ("absent_words", "nothing"), (None, "x"), ("something", None)], "q string, s string")
    assert [r[0] for r in df.select(gates.quote_grounded(F.col("q"), F.col("s"))).collect()] == [True, False, False, False, False]


def test_severities_go_down_one_step(spark):
    df = spark.createDataFrame([("critical",), ("informational",), ("low",), (None,), ("odd",)], "s string")
    assert [r[0] for r in df.select(gates.demoted(F.col("s"))).collect()] == ["high", "informational", "informational", None, None]


def test_drops_between_stages(spark, tmp_path):
    ids = lambda *x: [{"id": i} for i in x]
    first = {"stages": [{"stage_id": "a", "findings": ids("F-1", "F-2", "F-3")}, {"stage_id": "b", "findings": ids("F-1", "F-3")}, {"stage_id": "c", "findings": ids("F-1")}, {"stage_id": "d", "findings": []}]}
    whole = {"manifest": {"stages": [{"findings": ids("F-9")}, {"findings": json.dumps(ids("F-9"))}]}}
    scans = spark.createDataFrame([("s", json.dumps(first)), ("t", json.dumps(whole)), ("u", "{broken"), ("v", None)], "scan_id string, manifest_json string")
    scans.write.parquet(f"{tmp_path}/scans.parquet")
    held = [("s", "F-1"), ("s", "F-7"), ("t", "F-9"), ("x", "F-1")]
    spark.createDataFrame(held, "scan_id string, finding_id string").write.parquet(f"{tmp_path}/findings.parquet")
    got = gates.recovered_drops(spark, str(tmp_path))
    want = [("s", "F-1", 0, 2, "kept"), ("s", "F-2", 0, 0, "dropped_between_stages"), ("s", "F-3", 0, 1, "dropped_between_stages"), ("s", "F-7", None, None, "delivered_only"), ("t", "F-9", 0, 1, "kept")]
    assert rows(got, "scan_id", "finding_id", "first_stage", "last_stage", "state") == sorted(want, key=str)
    assert rows(gates.last_listing_stage(spark, str(tmp_path)), "scan_id", "stage", "n_findings") == [("s", 2, 1), ("t", 1, 1)]


#: Columns of outcomes that have more than one value in the tables.
OUTCOMES = {
    "closed_set_citation": "cited", "merge_sources": "origin", "reachable_sinks": "reach", "k_of_n_verdict": "verified", "quoted_sinks": "grounded", "weak_evidence_cap": "grounded",
    "threshold_gate": "passed", "recovered_drops": "state", "quorum_vote": "kept", "consistent_reports": "consistent", "nearest_hit": "unreached", "proof_gate": "reason", "gate_reasons": "drop_reason",
}


@pytest.mark.parametrize("name", sorted(OUTCOMES))
def test_both_outcomes_occur(spark, name):
    assert OWN[name](spark, "/root/testdata/sf0.01").select(OUTCOMES[name]).distinct().count() >= 2


def test_signals_merges_and_anti_joins_have_both_outcomes(spark):
    d = "/root/testdata/sf0.01"
    assert {r.signals for r in OWN["k_of_n_verdict"](spark, d).select("signals").distinct().collect()} >= {0, 1, 2, 3, 4, 5}
    merged = OWN["merge_overlapping"](spark, d)
    assert merged.where("merged > 1").count() > 50 and merged.where("merged = 1").count() > 50
    lenses = reference.levelled_findings(spark, d, "skill").where("not (skill <=> 'deterministic_detector')").count()
    assert 0 < OWN["anti_near_duplicate"](spark, d).count() < lenses


def test_near_joins_stay_in_their_repository(spark):
    d = "/root/testdata/sf0.01"
    own = reference.levelled_findings(spark, d, "repo")
    told = reference._external(spark, d).select("ext_id", "ext_repo")
    pairs = OWN["corroborate_nearest"](spark, d).join(own, ["scan_id", "finding_id"]).join(told, "ext_id")
    assert pairs.count() > 0 and pairs.where("not (repo <=> ext_repo)").count() == 0
