"""Mixing sources to target weights, by temperature, within a cap on repetition.

Sizes are tokens of a public tokenizer. Source shares raised to an exponent and normalised are temperature weights. A target weight
that a source can give within its cap on repetition is met. What no target settles goes by temperature: the share of listed sources
without a target, and what sources at their cap can't give, which the others take in proportion to their shares raised to the exponent
that lies nearest to the entropy of the targets and that no cap forbids; without any target, all of the mix.
Weights times the budget are realised as block permutations: each pass over a
source orders its blocks of records by a seeded hash and takes whole records until the budget of the pass is used.

Null and blank texts have no tokens and are not drawn. Sources without a target get none. A source may have a target but no
records; its share goes to the others. Sources are levelled; repeated targets of one source add up.
"""

from __future__ import annotations

import base64
import math
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siftstone.functions.levelling import level_word
from siftstone.session import spread, written

RANKS = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: the way the tokenizer of these ranks cuts text.
CUT = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Tokens that a block of records is meant to hold, and blocks that are put in order together.
BLOCK_TOKENS, ROW_BLOCKS = 1_000_000, 4096


def token_counts(documents: DataFrame, ranks: str = RANKS) -> DataFrame:
    """(doc_id, source, tokens) for every document with text; the source levelled."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import tiktoken

        with open(ranks, "rb") as f:
            merges = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        coder = tiktoken.Encoding("mixing", pat_str=CUT, mergeable_ranks=merges, special_tokens={})
        for pdf in batches:
            yield pd.DataFrame({"doc_id": pdf.doc_id, "source": pdf.source, "tokens": [len(coder.encode_ordinary(t)) for t in pdf.text]})

    texts = documents.where("doc_id is not null and text is not null and trim(text) <> ''").select(
        F.col("doc_id").cast("long").alias("doc_id"), level_word(F.col("source")).alias("source"), "text"
    )
    return spread(texts).mapInPandas(run, "doc_id long, source string, tokens long")


def entropy(weights: list[float]) -> float:
    return -sum(w * math.log(w) for w in weights if w > 0)


def temperature_weights(tokens: dict[str, float], exponent: float) -> dict[str, float]:
    """Token shares raised to ``exponent`` and normalised."""
    logs = {s: exponent * math.log(t) for s, t in tokens.items() if t > 0}
    top = max(logs.values(), default=0.0)
    total = sum(math.exp(x - top) for x in logs.values())
    return {s: math.exp(x - top) / total for s, x in logs.items()}


def bisect_exponent(tokens: dict[str, float], met, low: float = 0.0, high: float = 1.0, steps: int = 60) -> float:
    """The least exponent at which ``met(weights)`` holds, if it holds at ``high`` and goes on holding above."""
    if met(temperature_weights(tokens, low)):
        return low
    for _ in range(steps):
        middle = (low + high) / 2
        low, high = (low, middle) if met(temperature_weights(tokens, middle)) else (middle, high)
    return high


@dataclass(frozen=True)
class Mix:
    """Weights of one mix and how they came about."""

    exponent_by_entropy: float
    exponent_by_repeats: float
    temperature: dict[str, float]
    shares: dict[str, float]
    budget: float


def weigh(tokens: dict[str, float], targets: dict[str, float | None], caps: dict[str, float], budget: float | None = None) -> Mix:
    """Shares of the budget that sources get: their targets as far as caps allow, and the rest by temperature."""
    held = {s: t for s, t in tokens.items() if t > 0 and s in targets}
    budget = budget or float(sum(held.values()))
    goal = entropy([w for s, w in targets.items() if s in held and w])
    by_entropy = bisect_exponent(held, lambda w: entropy(list(w.values())) <= goal, 0.0, 8.0) if held else 1.0
    by_repeats = (
        bisect_exponent(held, lambda w: all(w[s] * budget <= held[s] * caps.get(s, 1) * (1 + 1e-12) for s in w)) if held else 1.0
    )
    limit = {s: held[s] * caps.get(s, 1) / budget for s in held} if budget else {}
    aimed = {s: w for s, w in targets.items() if s in held and w is not None and w > 0}
    # Targets are met as far as caps allow; they count as shares of all, so more than the whole is scaled down.
    over = max(1.0, sum(w for w in targets.values() if w))
    shares = {s: min(w / over, limit[s]) for s, w in aimed.items()}
    left = 1.0 - sum(shares.values())
    # Sources without a target are open from the start; those with one take what is left when no such source can.
    free = {s for s, w in targets.items() if s in held and w is None}
    for group in (free, set(aimed)):
        open_ = {s for s in group if limit[s] - shares.get(s, 0.0) > 1e-12}
        while open_ and left > 1e-12:
            room = {s: limit[s] - shares.get(s, 0.0) for s in open_}
            exponent = _nearest_exponent({s: held[s] for s in open_}, {s: room[s] / left for s in open_}, by_entropy)
            weights = temperature_weights({s: held[s] for s in open_}, exponent)
            given = {s: min(left * weights[s], room[s]) for s in open_}
            for s, x in given.items():
                shares[s] = shares.get(s, 0.0) + x
            left -= sum(given.values())
            open_ = {s for s in open_ if room[s] - given[s] > 1e-12}
    return Mix(by_entropy, by_repeats, temperature_weights(held, by_entropy), shares, budget)


def _nearest_exponent(tokens: dict[str, float], room: dict[str, float], wanted: float) -> float:
    """The exponent nearest to ``wanted`` at which no source gets more than its room, ``wanted`` itself if there is none."""
    fits = lambda w: all(w[s] <= room[s] * (1 + 1e-12) for s in w)
    if fits(temperature_weights(tokens, wanted)) or not fits(temperature_weights(tokens, 1.0)):
        return wanted
    # Shares by size fit; from there the exponent goes as far towards the wanted one as they still do.
    low, high = 0.0, 1.0
    for _ in range(60):
        middle = (low + high) / 2
        low, high = (middle, high) if fits(temperature_weights(tokens, 1.0 + middle * (wanted - 1.0))) else (low, middle)
    return 1.0 + low * (wanted - 1.0)


def _source_table(counts: DataFrame, targets: DataFrame) -> list:
    """One row per source that the targets name: as many as that list, which people write, however many sources there are."""
    sums = counts.where("source is not null").groupBy("source").agg(F.sum("tokens").alias("tokens"), F.count("*").alias("records"))
    aims = targets.select(level_word(F.col("source")).alias("source"), "target_weight", "max_repeats").where("source is not null").groupBy("source").agg(
        F.sum("target_weight").alias("weight"), F.min("max_repeats").alias("cap")
    )
    return aims.join(sums, "source", "left").collect()


def plan_mix(counts: DataFrame, targets: DataFrame, budget: float | None = None) -> tuple[Mix, list]:
    rows = _source_table(counts, targets)
    tokens = {r.source: float(r.tokens or 0) for r in rows}
    weights = {r.source: None if r.weight is None else float(r.weight) for r in rows}
    caps = {r.source: float(r.cap if r.cap is not None else 1) for r in rows}
    return weigh(tokens, weights, caps, budget), rows


def draw(counts: DataFrame, mix: Mix, tokens: dict[str, float], seed: int = 0) -> DataFrame:
    """(doc_id, source, pass, tokens): the records of the mix; every source's sum is its budget but for one record.

    Full passes take all records; the last one orders blocks by a seeded hash and cuts inside one block only.
    """
    spark = counts.sparkSession
    plan = [(s, int(w * mix.budget // tokens[s]), float(w * mix.budget % tokens[s]), max(1, math.ceil(tokens[s] / BLOCK_TOKENS))) for s, w in mix.shares.items()]
    planned = spark.createDataFrame(plan, "source string, full int, rest double, blocks long")  # one row per target
    rows = counts.join(F.broadcast(planned), "source")
    whole = rows.where("full > 0").select("doc_id", "source", F.explode(F.sequence(F.lit(1), F.col("full"))).alias("pass"), "tokens")
    last = rows.where("rest > 0").withColumns(
        {"block": F.pmod(F.xxhash64("doc_id", F.lit(seed), F.lit("block")), F.col("blocks")), "place": F.xxhash64("doc_id", F.lit(seed), F.lit("place"))}
    )
    sums = last.groupBy("source", "block").agg(F.sum("tokens").alias("size"))
    # Blocks lie in rows of ROW_BLOCKS or so; rows are put in order first, then blocks within their row, so no task orders all blocks.
    n_rows = F.ceil(F.col("blocks") / ROW_BLOCKS)
    laid = sums.join(F.broadcast(planned.select("source", n_rows.alias("n_rows"))), "source").withColumn("row", F.pmod(F.xxhash64("block", F.lit(seed), F.lit("row")), F.col("n_rows")))
    of_rows = Window.partitionBy("source").orderBy("row").rowsBetween(Window.unboundedPreceding, -1)
    starts = laid.groupBy("source", "row").agg(F.sum("size").alias("size")).select("source", "row", F.coalesce(F.sum("size").over(of_rows), F.lit(0)).alias("start"))
    order = Window.partitionBy("source", "row").orderBy(F.xxhash64("block", F.lit(seed)), "block").rowsBetween(Window.unboundedPreceding, -1)
    before = laid.join(starts, ["source", "row"]).select("source", "block", "size", (F.col("start") + F.coalesce(F.sum("size").over(order), F.lit(0))).alias("before"))
    within = Window.partitionBy("source", "block").orderBy("place", "doc_id").rowsBetween(Window.unboundedPreceding, -1)
    placed = last.join(before, ["source", "block"]).where("before < rest")
    inside = placed.where("before + size <= rest").select("doc_id", "source", (F.col("full") + 1).alias("pass"), "tokens")
    cut = (
        placed.where("before + size > rest")
        .withColumn("at", F.col("before") + F.coalesce(F.sum("tokens").over(within), F.lit(0)))
        .where("at < rest")
        .select("doc_id", "source", (F.col("full") + 1).alias("pass"), "tokens")
    )
    return whole.unionByName(inside).unionByName(cut)


def mixed_records(documents: DataFrame, targets: DataFrame, budget: float | None = None, seed: int = 0, ranks: str = RANKS) -> DataFrame:
    counts = written(token_counts(documents, ranks), "token-counts")
    mix, rows = plan_mix(counts, targets, budget)
    return draw(counts, mix, {r.source: float(r.tokens or 0) for r in rows}, seed)


def mix_report(documents: DataFrame, targets: DataFrame, budget: float | None = None, seed: int = 0, ranks: str = RANKS) -> DataFrame:
    """Per source: its target, tokens held, temperature weight, planned and reached share, and repeats."""
    counts = written(token_counts(documents, ranks), "token-counts")
    mix, rows = plan_mix(counts, targets, budget)
    drawn = draw(counts, mix, {r.source: float(r.tokens or 0) for r in rows}, seed)
    reached = drawn.groupBy("source").agg(F.sum("tokens").alias("mix_tokens"), F.max("pass").alias("passes"))
    planned = counts.sparkSession.createDataFrame(
        [
            (r.source, r.weight, r.cap, int(r.tokens or 0), int(r.records or 0), mix.temperature.get(r.source, 0.0), mix.shares.get(r.source, 0.0), mix.exponent_by_entropy, mix.exponent_by_repeats)
            for r in rows
        ],
        "source string, target_weight double, max_repeats int, held_tokens long, records long, temperature_weight double, planned_share double,"
        " exponent_by_entropy double, exponent_by_repeats double",
    )
    other = counts.where("source is not null").groupBy("source").agg(F.sum("tokens").alias("held_tokens"), F.count("*").alias("records")).join(F.broadcast(planned.select("source")), "source", "left_anti")
    zeros = {c: F.lit(0.0) for c in ("temperature_weight", "planned_share")} | {c: F.lit(None).cast("double") for c in ("target_weight", "exponent_by_entropy", "exponent_by_repeats")}
    every = planned.unionByName(other.withColumns(zeros | {"max_repeats": F.lit(None).cast("int")}))
    joined = every.join(reached, "source", "left").na.fill(0, ["mix_tokens", "passes"])
    total = joined.agg(F.sum("mix_tokens").alias("total"))
    return joined.crossJoin(F.broadcast(total)).select(
        *planned.columns, "mix_tokens", "passes", F.coalesce(F.try_divide(F.col("mix_tokens"), F.col("total")), F.lit(0.0)).alias("reached_share")
    )
