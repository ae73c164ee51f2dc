"""Matching external rows and findings that share no key.

Sorted neighbourhood: rows of both sources are sorted by composite keys, and a window slides over each
order. Two keys are used: (repo as given, file, line), and (repo as the path names it, file, line) for rows
without a repo. The window covers all rows within ``tolerance`` lines, so it misses no pair however many rows
lie between. Orders are cut into cells of lines, rows near an edge standing in both cells, and rows of equal place and class go
through them once, so that one file or one place may hold any share of all rows. Pairs are compared by weighted similarities of repo,
path, line and class; their members come back at the end.

Rows without path or line match nothing. Null classes match any. Equal rows give one pair.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftstone.functions.levelling import level_cwe, level_path, level_repo, path_tail
from siftstone.llm.history import newest_findings
from siftstone.session import written

TOLERANCE, CELL = 3, 256
#: Parts in which the members of a group are numbered.
GROUP_PARTS = 64
# Weights of the field similarities; they sum to 1.
WEIGHTS = {"repo": 0.3, "path": 0.3, "line": 0.25, "cwe": 0.15}


def _place(df: DataFrame) -> DataFrame:
    return df.withColumns(
        {
            "path_l": level_path(F.col("path")),
            "repo_l": level_repo(F.col("repo")),
            "cwe_l": level_cwe(F.col("cwe")),
            "line_l": F.col("start_line").cast("long"),
        }
    ).withColumn("file_l", path_tail(F.col("path_l")))


def _cells(line: Column, reach: int) -> Column:
    return F.sequence(F.floor((line - reach) / CELL), F.floor((line + reach) / CELL))


def row_classes(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(cls, repo_l, path_l, file_l, cwe_l, line_l), once for all rows of equal place and class, and (cls, key) of all rows."""
    place = ["repo_l", "path_l", "file_l", "cwe_l", "line_l"]
    named = rows.withColumn("cls", F.xxhash64(F.lit(1), *(F.coalesce(F.col(c).cast("string"), F.lit("\0")) for c in place)))
    return named.groupBy("cls", *place).agg(F.count("*").alias("members")).drop("members"), named.select("cls", "key").distinct()


def candidate_pairs(left: DataFrame, right: DataFrame, tolerance: int = TOLERANCE) -> DataFrame:
    """(l, r): structs of a left and a right class of rows whose sort keys lie within the window.

    ``left`` and ``right`` have cls, repo_l, path_l, file_l, cwe_l and line_l, once each, so a window holds the distinct
    spellings and classes of a few lines of one file, however many rows repeat them.
    """
    fields = ["cls", "path_l", "cwe_l", "line_l"]
    # The part of a path before the file names the repo; every such part is a possible key.
    before = F.expr("slice(split(path_l, '/'), 1, greatest(size(split(path_l, '/')) - 3, 0))")
    given = right.where("repo_l is not null").withColumn("block", F.col("repo_l"))
    named = right.where("repo_l is null").withColumn("block", F.explode(F.array_distinct(before)))
    rights = given.unionByName(named).withColumn("cell", F.explode(_cells(F.col("line_l"), tolerance)))
    lefts = left.withColumn("block", F.col("repo_l")).withColumn("cell", F.floor(F.col("line_l") / CELL))
    rows = lefts.select("block", "file_l", "cell", "line_l", F.struct(*fields).alias("l"), F.lit(None).alias("r")).unionByName(
        rights.select("block", "file_l", "cell", "line_l", F.lit(None).alias("l"), F.struct(*fields, F.col("repo_l").isNotNull().alias("repo_given")).alias("r"))
    )
    sliding = Window.partitionBy("block", "file_l", "cell").orderBy("line_l").rangeBetween(-tolerance, tolerance)
    return (
        rows.withColumn("near", F.collect_list("r").over(sliding))
        .where("l is not null")
        .select("l", F.explode("near").alias("r"))
    )


def trigram_similarity(a: Column, b: Column) -> Column:
    """Share of distinct letter trigrams that two texts have in common; texts shorter than three letters count whole."""

    def grams(x: Column) -> Column:
        return F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.length(x) - 2, F.lit(1))), lambda i: F.substring(x, i, F.lit(3))))

    shared = F.size(F.array_intersect(grams(a), grams(b)))
    return shared / (F.size(grams(a)) + F.size(grams(b)) - shared)


def compared(pairs: DataFrame, tolerance: int = TOLERANCE) -> DataFrame:
    """(left_cls, right_cls, line_delta, confidence) of pairs of classes, without those whose weakness classes contradict.

    Fields are compared one by one and weighed: the repo counts less where only the path names it, paths by their letters,
    lines by their distance, and a missing weakness class for half.
    """
    path = F.when(F.col("l.path_l") == F.col("r.path_l"), 1.0).otherwise(trigram_similarity(F.col("l.path_l"), F.col("r.path_l")))
    delta = F.abs(F.col("l.line_l") - F.col("r.line_l"))
    line = 1.0 - delta / F.lit(2.0 * (tolerance + 1))
    cwe = F.when(F.col("l.cwe_l") == F.col("r.cwe_l"), 1.0).otherwise(0.5)
    repo = F.when(F.col("r.repo_given"), 1.0).otherwise(0.8)
    confidence = F.round(WEIGHTS["repo"] * repo + WEIGHTS["path"] * path + WEIGHTS["line"] * line + WEIGHTS["cwe"] * cwe, 6)
    return pairs.where("l.cwe_l = r.cwe_l or l.cwe_l is null or r.cwe_l is null").groupBy(F.col("l.cls").alias("left_cls"), F.col("r.cls").alias("right_cls")).agg(
        F.min(delta).alias("line_delta"), F.max(confidence).alias("confidence")
    )


def matching_pairs(findings: DataFrame, scans: DataFrame, external: DataFrame, tolerance: int = TOLERANCE) -> DataFrame:
    """(scan_id, finding_id, ext_id, line_delta, confidence): every pair that may be the same flaw."""
    place = ["repo_l", "path_l", "file_l", "cwe_l", "line_l"]
    known = "file_l is not null and line_l is not null and key is not null"
    left = _place(newest_findings(findings, scans)).select(F.struct("scan_id", "finding_id").alias("key"), *place).where(known).where("repo_l is not null")
    right = _place(external).select(F.col("ext_id").alias("key"), *place).where(known)
    (left_classes, lefts), (right_classes, rights) = row_classes(left), row_classes(right)
    pairs = compared(candidate_pairs(left_classes, right_classes, tolerance), tolerance)
    members = pairs.join(lefts.withColumnsRenamed({"cls": "left_cls", "key": "left_key"}), "left_cls").join(rights.withColumnsRenamed({"cls": "right_cls", "key": "right_key"}), "right_cls")
    return members.groupBy("left_key.scan_id", "left_key.finding_id", F.col("right_key").alias("ext_id")).agg(
        F.min("line_delta").alias("line_delta"), F.max("confidence").alias("confidence")
    )


def one_to_one(pairs: DataFrame, left: list[str], right: str) -> DataFrame:
    """The pairs of a one-to-one assignment that maximises total confidence; ``pairs`` has one row per pair.

    Keys with the same partners at the same confidences are one node with a capacity, so a place that many rows share shrinks to a few
    nodes. Nodes that share a partner form components, and every component is solved exactly, as flows between its nodes. For pairs of
    ``matching_pairs`` a component lies within one file of one repo, and its nodes are distinct (line, weakness class, spelling of the path).
    """
    spark = pairs.sparkSession
    keyed = written(pairs.withColumns({"hu": F.xxhash64(*left), "hv": F.xxhash64(right)}), "pairs")
    edges = keyed.select("hu", "hv", "confidence")
    lefts, rights = (written(_alike(edges, own, other), "alike") for own, other in (("hu", "hv"), ("hv", "hu")))
    # All members of a group have the same partners, so the pairs of the keys that name them are those of the groups.
    between = edges.join(lefts.where("hu = group_hu"), "hu").join(rights.where("hv = group_hv"), "hv").select("group_hu", "group_hv", "confidence", "members_hu", "members_hv")
    labelled = _components(written(between, "group-pairs"))
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    flows = written(
        labelled.repartition(tasks, "component")
        .sortWithinPartitions("component", "group_hu", "group_hv")
        .mapInPandas(_solve_flows, "group_hu long, group_hv long, first_hu long, first_hv long, amount long"),
        "flows",
    )
    units = flows.withColumn("k", F.explode(F.sequence(F.lit(0).cast("long"), F.col("amount") - 1))).select(
        "group_hu", "group_hv", (F.col("first_hu") + F.col("k")).alias("place_hu"), (F.col("first_hv") + F.col("k")).alias("place_hv")
    )
    chosen = units.join(lefts, ["group_hu", "place_hu"]).join(rights, ["group_hv", "place_hv"]).select("hu", "hv")
    return keyed.join(chosen, ["hu", "hv"], "left_semi").drop("hu", "hv")


def _alike(edges: DataFrame, own: str, other: str) -> DataFrame:
    """(own, group, place, members): keys with the same partners at the same confidences are a group, named by its least key.

    Places are numbered within parts of a group first, so no task numbers the whole of a large one.
    """
    signs = [F.bit_xor(F.xxhash64(F.lit(seed), other, "confidence")).alias(f"sign{seed}") for seed in (1, 2)]
    sign = ["sign1", "sign2", "degree"]
    signed = edges.groupBy(own).agg(*signs, F.count("*").alias("degree")).withColumn("part", F.pmod(F.xxhash64(own, F.lit(3)), F.lit(GROUP_PARTS)))
    parts = signed.groupBy(*sign, "part").agg(F.count("*").alias("n"), F.min(own).alias("least"))
    before = Window.partitionBy(*sign).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*sign)
    # At most GROUP_PARTS rows per group.
    starts = parts.select(
        *sign, "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"), F.sum("n").over(whole).alias(f"members_{own}"), F.min("least").over(whole).alias(f"group_{own}")
    )
    within = Window.partitionBy(*sign, "part").orderBy(own)
    numbered = signed.withColumn("rank", F.row_number().over(within) - 1).join(starts, [*sign, "part"])
    return numbered.select(own, f"group_{own}", (F.col("start") + F.col("rank")).cast("long").alias(f"place_{own}"), f"members_{own}")


def _solve_flows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Flows of components that come one after the other, with the places of the first members they take on both sides."""
    waiting: list[pd.DataFrame] = []
    for pdf in batches:
        for component, part in pdf.groupby("component", sort=False):
            if waiting and waiting[0].component.iloc[0] != component:
                yield _flows_of(pd.concat(waiting, ignore_index=True))
                waiting = []
            waiting.append(part)
    if waiting:
        yield _flows_of(pd.concat(waiting, ignore_index=True))


def _flows_of(pdf: pd.DataFrame) -> pd.DataFrame:
    edges = list(zip(pdf.group_hu.tolist(), pdf.group_hv.tolist(), pdf.confidence.tolist()))
    flows = best_flows(edges, dict(zip(pdf.group_hu.tolist(), pdf.members_hu.tolist())), dict(zip(pdf.group_hv.tolist(), pdf.members_hv.tolist())))
    out, used_u, used_v = [], {}, {}
    for (u, v), amount in flows.items():
        a, b = used_u.get(u, 0), used_v.get(v, 0)
        out.append((u, v, a, b, amount))
        used_u[u], used_v[v] = a + amount, b + amount
    return pd.DataFrame(out, columns=["group_hu", "group_hv", "first_hu", "first_hv", "amount"]).astype("int64")


def best_flows(edges: list[tuple[int, int, float]], supply: dict[int, int], room: dict[int, int]) -> dict[tuple[int, int], int]:
    """Amounts between left and right nodes of greatest total weight, within ``supply`` of lefts and ``room`` of rights.

    Exact, by shortest augmenting paths on potentials over the edges that exist, in whole numbers; lefts may keep supply.
    """
    costs: dict[int, dict[int, int]] = {}
    for u, v, w in edges:
        costs.setdefault(u, {})[v] = -int(w * 2.0**60)
    free = dict(room)
    of_left: dict[int, int] = {}
    of_right = dict.fromkeys(free, 0)
    held: dict[int, dict[int, int]] = {v: {} for v in free}
    for root, amount in supply.items():
        of_left[root] = min(0, min(c - of_right[v] for v, c in costs[root].items()))
        while amount:
            # Ends are rights with room, or a left that keeps supply (v is None).
            distance_left, distance_right, via, back = {root: 0}, {}, {}, {}
            heap: list[tuple[int, int, int | None, int]] = []
            order, fresh = 0, [root]
            while True:
                for u in fresh:
                    base = distance_left[u] - of_left[u]
                    heapq.heappush(heap, (base, order, None, u))
                    order += 1
                    for v, c in costs[u].items():
                        if v not in distance_right:
                            heapq.heappush(heap, (base + c - of_right[v], order, v, u))
                            order += 1
                step, _, end, u = heapq.heappop(heap)
                while end is not None and end in distance_right:
                    step, _, end, u = heapq.heappop(heap)
                if end is None:
                    break
                distance_right[end], back[end] = step, u
                if free[end]:
                    break
                fresh = [x for x, f in held[end].items() if f and x not in distance_left]
                for x in fresh:
                    distance_left[x], via[x] = step, end
            for x, near in distance_left.items():
                of_left[x] += step - near
            for v, near in distance_right.items():
                of_right[v] -= step - near
            path, x = [], u
            while x != root:
                path.append((via[x], x, back[via[x]]))
                x = back[via[x]]
            moved = min([amount, *(held[v][x] for v, x, _ in path)] + ([free[end]] if end is not None else []))
            if end is not None:
                free[end] -= moved
                held[end][u] = held[end].get(u, 0) + moved
            for v, x, y in path:
                held[v][x] -= moved
                held[v][y] = held[v].get(y, 0) + moved
            amount -= moved
    return {(u, v): f for v, flows in held.items() for u, f in flows.items() if f}


def _components(edges: DataFrame) -> DataFrame:
    """Edges (group_hu, group_hv, and more) with a component label: the least left node reachable.

    Least labels pass back and forth, and each label is then replaced by the label of the node it names, so chains shrink by a
    factor a round and not by a step.
    """
    ends = ["group_hu", "group_hv"]
    labels = written(edges.groupBy("group_hu").agg(F.min("group_hu").alias("component")), "labels")
    while True:
        by_v = edges.select(*ends).join(labels, "group_hu").groupBy("group_hv").agg(F.min("component").alias("low"))
        by_u = edges.select(*ends).join(by_v, "group_hv").groupBy("group_hu").agg(F.min("low").alias("low"))
        named = by_u.select(F.col("group_hu").alias("low"), F.col("low").alias("lower"))
        jumped = by_u.join(named, "low").select("group_hu", F.least("low", "lower").alias("low"))
        after = written(labels.join(jumped, "group_hu").select("group_hu", F.least("component", "low").alias("component"), (F.col("low") < F.col("component")).alias("moved")), "labels")
        labels = after.drop("moved")
        if after.where("moved").isEmpty():
            return edges.join(labels, "group_hu")


def best_assignment(lefts: list, rights: list, weights: list[float]) -> list[int]:
    """Places of the pairs of greatest total weight in which no left or right key stands twice.

    Exact, by shortest augmenting paths on potentials; lefts may stay without a partner.
    """
    us, vs = {u: i for i, u in enumerate(dict.fromkeys(lefts))}, {v: i for i, v in enumerate(dict.fromkeys(rights))}
    if len(us) == 1 or len(vs) == 1:
        return [max(range(len(weights)), key=weights.__getitem__)]
    # Every left has a column of its own that costs nothing and means no partner.
    rows, columns = len(us), len(vs) + len(us)
    cost = np.zeros((rows + 1, columns + 1))
    place: dict[tuple[int, int], int] = {}
    for k, (u, v, w) in enumerate(zip(lefts, rights, weights)):
        i, j = us[u] + 1, vs[v] + 1
        if (i, j) not in place or -w < cost[i, j]:
            cost[i, j], place[i, j] = -w, k
    of_row, of_column = np.zeros(rows + 1), np.zeros(columns + 1)
    partner = np.zeros(columns + 1, dtype=int)
    for i in range(1, rows + 1):
        partner[0], j = i, 0
        least, back, seen = np.full(columns + 1, np.inf), np.zeros(columns + 1, dtype=int), np.zeros(columns + 1, dtype=bool)
        while True:
            seen[j] = True
            slack = cost[partner[j]] - of_row[partner[j]] - of_column
            nearer = ~seen & (slack < least)
            least[nearer], back[nearer] = slack[nearer], j
            following = int(np.where(seen, np.inf, least).argmin())
            step = least[following]
            of_row[partner[seen]] += step
            of_column[seen] -= step
            least[~seen] -= step
            j = following
            if partner[j] == 0:
                break
        while j:
            partner[j], j = partner[back[j]], back[j]
    return [place[partner[j], j] for j in range(1, columns + 1) if (partner[j], j) in place]
