import json

from siftstone.operators.shredding import FINDING_LISTS, adjacency, all_entities, child_records, entity_table
from tests.conftest import rows

F = "scan_id string, finding_id string, finding_json string"
S = "scan_id string, manifest_json string"


def test_nodes_of_any_depth(spark):
    deep = "0"
    for _ in range(60):
        deep = '{"a": ' + deep + "}"
    nodes = adjacency(spark.createDataFrame([("s", "f", deep)], F), ["scan_id", "finding_id"], "finding_json")
    assert nodes.count() == 61 and nodes.where("kind = 'scalar'").first().scalar == "0"


def test_rebuild_from_nodes(spark):
    doc = {"a": [1, None, {"b": "x/y", "c/d": True}], "e": {}, "f": [], "g": 1.5, "h": "[not json"}
    nodes = adjacency(spark.createDataFrame([("s", "f", json.dumps(doc))], F), ["scan_id"], "finding_json").collect()
    by_parent = {}
    for n in nodes:
        by_parent.setdefault(n.parent, []).append(n)

    def build(n):
        below = sorted(by_parent.get(n.node, []), key=lambda x: x.ordinal)
        if n.kind == "object":
            return {c.label: build(c) for c in below}
        if n.kind == "array":
            return [build(c) for c in below]
        if n.kind == "null":
            return None
        try:
            return json.loads(n.scalar)
        except ValueError:
            return n.scalar

    assert build(by_parent[None][0]) == doc


def test_shapes_of_lists(spark):
    docs = [
        ("a", {"locations": [{"path": "p"}, None, {"path": "q"}], "votes": None, "evidence": {"kind": "k"}, "taint": {"taint_path": [{}]}}),
        ("b", {"schema_version": 2, "finding": {"locations": json.dumps([{"path": "p"}]), "taint_path": [{"path": 1}]}}),
        ("c", json.dumps({"locations": [{"path": "p"}], "tags": [{"path": "no"}]})),
        ("d", None), ("e", []), ("f", "text"),
    ]
    data = [("s", k, json.dumps(v)) for k, v in docs] + [("s", "bad", '{"locations": [{"path": "p"}'), ("s", "nan", '{"locations": [{"path": NaN}]}'), ("s", "none", None), ("s", "blank", " "), ("s", "a", json.dumps(docs[0][1]))]
    scans = [("s", json.dumps({"manifest": {"stages": json.dumps([{"findings": [None, {"id": 1}]}, None, {"findings": {"id": 2}}])}})), ("t", json.dumps({"stages": {"findings": []}})), ("u", None)]
    got = child_records(spark.createDataFrame(data, F), spark.createDataFrame(scans, S))
    assert rows(got) == sorted(
        [
            ("s", "a", "locations", -1, 0), ("s", "a", "locations", -1, 2), ("s", "a", "evidence", -1, 0), ("s", "a", "taint_path", -1, 0), ("s", "b", "locations", -1, 0), ("s", "b", "taint_path", -1, 0),
            ("s", "c", "locations", -1, 0), ("s", "", "stages", -1, 0), ("s", "", "stages", -1, 2), ("s", "", "findings", 0, 1), ("s", "", "findings", 2, 0), ("t", "", "stages", -1, 0),
        ], key=str)
    empty = child_records(spark.createDataFrame([], F + ", node string"), spark.createDataFrame([], S))
    assert empty.count() == 0


def test_entity_table_pivots_scalars(spark):
    data = [("s", "f", json.dumps({"locations": [{"path": "p", "start_line": 3, "x": 1}, {}, {"path": None}]}))]
    keys = ["scan_id", "finding_id"]
    nodes = adjacency(spark.createDataFrame(data, F), keys, "finding_json")
    table = entity_table(nodes, keys, "locations", FINDING_LISTS["locations"], ["path", "start_line"])
    assert rows(table, "list_pos", "rec_path", "rec_start_line") == [(0, "p", "3"), (1, None, None), (2, None, None)]


def test_members_named_like_places_are_no_items(spark):
    doc = {"locations": {"0": {"path": "inner"}, "path": "outer"}, "locations#1": {"path": "x"}, "votes": [[{"role": "r"}]], "evidence": [{"kind": "k", "sub": {"kind": "deep"}}], "a/locations": [{}]}
    manifest = {"stages": {"0": {"findings": [{}]}, "findings": {"id": 1}}, "stages#2/findings": [{}], "x": {"findings": [{}]}}
    found = spark.createDataFrame([("s", "f", json.dumps(doc))], F)
    got = child_records(found, spark.createDataFrame([("s", json.dumps(manifest))], S))
    assert rows(got) == sorted([("s", "f", "locations", -1, 0), ("s", "f", "evidence", -1, 0), ("s", "", "stages", -1, 0), ("s", "", "findings", 0, 0)], key=str)
    entities, _ = all_entities(found, spark.createDataFrame([], S))
    assert rows(entities, "list_name", "rec_path", "rec_kind") == [("evidence", None, "k"), ("locations", "outer", None)]
