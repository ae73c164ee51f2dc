"""Nested JSON records as an adjacency table, and flat entity tables made from it.

Every JSON value becomes one node (node, parent, label, ordinal, kind, scalar). A node's id is its path
from the root, ``/name`` for a member and ``#place`` for an item of a list (``~``, ``/`` and ``#`` in names are
escaped), so a parent's id is a prefix of it. Text that holds JSON counts as what it holds, at any
depth. Records are object nodes; pivoting their scalar children gives an entity's table.

Null, blank and invalid text gives no nodes. Records may nest to any depth.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siftstone.session import spread

KINDS = ("object", "array", "scalar", "null")

_HOLDS_JSON = re.compile(r'\s*[\[{"]')


def _no_constant(name: str) -> None:
    raise ValueError(f"{name} is no JSON")


def _decoded(value: object) -> object:
    """What a value stands for: text that holds JSON counts as what it holds, however often wrapped."""
    while isinstance(value, str) and _HOLDS_JSON.match(value):
        try:
            inner = json.loads(value, parse_constant=_no_constant)
        except (ValueError, RecursionError):
            return value
        if inner == value:
            return value
        value = inner
    return value


def _step(key: str) -> str:
    return "/" + key.replace("~", "~0").replace("/", "~1").replace("#", "~2") if "/" in key or "#" in key or "~" in key else "/" + key


def _scalar_text(value: object) -> str:
    if isinstance(value, str):
        return value
    if isinstance(value, bool):
        return "true" if value else "false"
    return repr(value) if isinstance(value, int) else json.dumps(value)


def _walk(text: str, labels: frozenset[str] | None, nested: frozenset[str] | None, kinds: frozenset[str], emit: Callable[[tuple], None]) -> None:
    """Emit every node of one document that is of ``kinds``, parents first; an explicit stack, so depth has no limit.

    Text under the labels of ``nested``, in their lists, and the document itself may hold JSON; other text stays text.
    """
    try:
        root = json.loads(text, parse_constant=_no_constant)
    except (ValueError, RecursionError):
        return
    stack: list[tuple[str, str | None, str, int, object, bool]] = [("", None, "", 0, root, True)]
    while stack:
        node, parent, label, ordinal, value, may_hold = stack.pop()
        if may_hold and isinstance(value, str):
            value = _decoded(value)
        if isinstance(value, dict):
            if "object" in kinds:
                emit((node, parent, label, ordinal, "object", None))
            for i, (k, v) in enumerate(value.items()):
                if labels is None or k in labels:
                    stack.append((node + _step(k), node, k, i, v, nested is None or k in nested))
        elif isinstance(value, list):
            if "array" in kinds:
                emit((node, parent, label, ordinal, "array", None))
            stack.extend((f"{node}#{i}", node, str(i), i, v, may_hold) for i, v in enumerate(value))
        elif value is None:
            if "null" in kinds:
                emit((node, parent, label, ordinal, "null", None))
        elif "scalar" in kinds:
            emit((node, parent, label, ordinal, "scalar", _scalar_text(value)))


def adjacency(docs: DataFrame, keys: list[str], json_col: str, labels: list[str] | None = None, kinds: tuple[str, ...] = KINDS, nested: list[str] | None = None) -> DataFrame:
    """keys and (node, parent, label, ordinal, kind, scalar) for every JSON value in ``json_col``.

    ``labels`` limits the members that become nodes, with all that lies below others left out; ``kinds``
    limits the nodes that come out; ``nested`` limits the members whose text may hold JSON (default: any).
    """
    wanted, held, kept = (None if x is None else frozenset(x) for x in (labels, nested, kinds))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at: list[int] = []
            nodes: list[tuple] = []
            for row, text in enumerate(batch.column(batch.num_columns - 1).to_pylist()):
                _walk(text, wanted, held, kept, nodes.append)
                at.extend([row] * (len(nodes) - len(at)))
            columns = zip(*nodes) if nodes else [()] * 6
            types = (pa.string(), pa.string(), pa.string(), pa.int32(), pa.string(), pa.string())
            taken = pa.array(at, pa.int64())
            arrays = [batch.column(k).take(taken) for k in range(len(keys))] + [pa.array(c, t) for c, t in zip(columns, types)]
            yield pa.RecordBatch.from_arrays(arrays, names=[*keys, "node", "parent", "label", "ordinal", "kind", "scalar"])

    rows = spread(docs.where(F.col(json_col).isNotNull()).select(*keys, F.col(json_col).alias("json_text")))
    schema = T.StructType(
        [f for f in rows.schema.fields if f.name in keys]
        + [T.StructField(n, T.StringType()) for n in ("node", "parent", "label")]
        + [T.StructField("ordinal", T.IntegerType()), T.StructField("kind", T.StringType()), T.StructField("scalar", T.StringType())]
    )
    return rows.mapInArrow(run, schema)


def _placed(nodes: DataFrame, at: Column, lists: dict[str, tuple[str, ...]], wrappers: tuple[str, ...]) -> DataFrame:
    """``nodes`` with (list_name, parent_pos, list_pos) of the record at the path ``at``; nodes at no list's path are left out, and
    list_name is null where none can stand.

    Paths are cut once at the places of items and compared as text, which costs less than a pattern for each list.
    """
    tops = ["", *(f"/{w}" for w in wrappers)]
    plain = {f"{t}/{p}": name for name, paths in lists.items() for p in paths if "/*/" not in p for t in tops}
    nested = [(name, *p.split("/*/")) for name, paths in lists.items() for p in paths if "/*/" in p]
    heads = [*plain, *(f"{t}/{x}" for _, outer, inner in nested for t in tops for x in (outer, f"{outer}/{inner}"))]
    cut = nodes.withColumn("at", at).where(F.substring_index("at", "#", 1).isin(heads)).withColumn("piece", F.split("at", "#"))
    n, first, second = F.size("piece"), F.col("piece")[0], F.get("piece", F.lit(1))
    number = lambda c: c.try_cast("int")
    in_list = cut.withColumn("own", F.when(n == 1, 0).when(n == 2, number(second)))
    called = F.coalesce(*(F.when(first.isin([p for p, of in plain.items() if of == name]), name) for name in dict.fromkeys(plain.values())), F.lit(None).cast("string"))
    found, parent, own = F.when(F.col("own").isNotNull(), called), F.lit(-1), F.col("own")
    for name, outer, inner in nested:
        alone = first.isin([f"{t}/{outer}/{inner}" for t in tops])
        above = number(F.substring_index(second, "/", 1))
        # An outer record may be a single object, as may its list.
        within = (n > 1) & first.isin([f"{t}/{outer}" for t in tops]) & (F.instr(second, "/") > 0) & (F.substring(second, F.instr(second, "/") + 1, F.length(second)) == inner)
        inside = F.when(alone, F.when(n == 1, 0).when(n == 2, number(second))).when(within & above.isNotNull(), F.when(n == 2, 0).when(n == 3, number(F.get("piece", F.lit(2)))))
        is_inside = alone | within
        found = F.when(is_inside, F.when(inside.isNotNull(), name)).otherwise(found)
        parent = F.when(is_inside, F.when(alone, 0).otherwise(above)).otherwise(parent)
        own = F.when(is_inside, inside).otherwise(own)
    return in_list.select("*", found.alias("list_name"), parent.alias("parent_pos"), own.alias("list_pos"))


def entity_tables(nodes: DataFrame, keys: list[str], lists: dict[str, tuple[str, ...]], columns: list[str], wrappers: tuple[str, ...] = ()) -> DataFrame:
    """One row per record of the named lists: keys, list_name, parent_pos, list_pos and its scalar members as text columns rec_*.

    ``lists`` maps a list's name to the paths it may stand at, a ``*`` in a path being the place of the
    parent record in its own list. A list may be a single object. ``wrappers`` are members that may
    enclose the whole record. Object nodes and the scalar nodes whose parent they are come together by place and are pivoted in one
    shuffle; records without scalars keep their row. A record delivered twice is one row, with the greater text where the deliveries differ.
    """
    is_object = F.col("kind") == "object"
    # A scalar stands at the place of the object that is its parent.
    own = nodes.where(is_object | (F.col("label").isin(columns) & (F.col("kind") == "scalar")))
    placed = _placed(own, F.when(is_object, F.col("node")).otherwise(F.col("parent")), lists, wrappers)
    # That a record stands there is asked of the groups: asked of the nodes, their place would be worked out twice.
    pivoted = placed.groupBy(*keys, "list_name", "parent_pos", "list_pos").agg(
        F.max(is_object & F.col("list_name").isNotNull()).alias("is_record"),
        *(F.max(F.when(~is_object & (F.col("label") == c), F.col("scalar"))).alias(f"rec_{c}") for c in columns),
    )
    return pivoted.where("is_record").drop("is_record")


def entity_table(nodes: DataFrame, keys: list[str], list_name: str, paths: tuple[str, ...], columns: list[str], wrappers: tuple[str, ...] = ()) -> DataFrame:
    """The table of one list, without its name."""
    return entity_tables(nodes, keys, {list_name: paths}, columns, wrappers).drop("list_name")


FINDING_LISTS = {
    "locations": ("locations",),
    "votes": ("votes",),
    "evidence": ("evidence",),
    "taint_path": ("taint/taint_path", "taint_path"),
}
MANIFEST_LISTS = {"stages": ("stages",), "findings": ("stages/*/findings",)}
FINDING_NESTED = ["finding", "locations", "votes", "evidence", "taint", "taint_path"]
MANIFEST_NESTED = ["manifest", "stages", "findings"]


#: Scalar members of the records of both documents.
FINDING_COLUMNS = ["path", "start_line", "end_line", "snippet", "role", "model", "verdict", "kind", "check", "detail"]
MANIFEST_COLUMNS = ["stage_id", "skill", "duration_seconds", "tokens_in", "tokens_out", "cost_usd", "error", "id", "cwe"]


def all_entities(findings: DataFrame, scans: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Entity tables of finding_json and of manifest_json, from the whole adjacency tables of both."""
    keys = ["scan_id", "finding_id"]
    kinds = ("object", "scalar")
    own = adjacency(findings, keys, "finding_json", kinds=kinds, nested=FINDING_NESTED)
    of_scan = adjacency(scans.select("scan_id", F.lit("").alias("finding_id"), "manifest_json"), keys, "manifest_json", kinds=kinds, nested=MANIFEST_NESTED)
    return entity_tables(own, keys, FINDING_LISTS, FINDING_COLUMNS, ("finding",)), entity_tables(of_scan, keys, MANIFEST_LISTS, MANIFEST_COLUMNS, ("manifest",))


def child_records(findings: DataFrame, scans: DataFrame) -> DataFrame:
    """(scan_id, finding_id, list_name, parent_pos, list_pos) for every child record of both documents."""
    own, of_scan = (t.select("scan_id", "finding_id", "list_name", "parent_pos", "list_pos") for t in all_entities(findings, scans))
    return own.unionByName(of_scan)


def finding_entity(findings: DataFrame, name: str, columns: list[str]) -> DataFrame:
    """Records of a list in finding_json as a flat table."""
    keys = ["scan_id", "finding_id"]
    nodes = adjacency(findings, keys, "finding_json", [*FINDING_NESTED, *columns], ("object", "scalar"), FINDING_NESTED)
    return entity_table(nodes, keys, name, FINDING_LISTS[name], columns, ("finding",))


def manifest_entity(scans: DataFrame, name: str, columns: list[str]) -> DataFrame:
    """Records of a list in manifest_json as a flat table."""
    nodes = adjacency(scans, ["scan_id"], "manifest_json", [*MANIFEST_NESTED, *columns], ("object", "scalar"), MANIFEST_NESTED)
    return entity_table(nodes, ["scan_id"], name, MANIFEST_LISTS[name], columns, ("manifest",))
