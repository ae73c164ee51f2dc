"""The pattern index over lines of code, and views of it.

Null text has no lines. A line may hit many patterns; comment-only lines hit none.
"""

from __future__ import annotations

import re
from re import _constants as sre
from re import _parser as parser

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftstone import catalogs as C


def lines(df: DataFrame, keys: list[str], text_col: str) -> DataFrame:
    """keys and (line_no, line_text): every line of a text, counted from 1."""
    return df.where(F.col(text_col).isNotNull()).select(*keys, F.posexplode(F.split(text_col, "\n")).alias("line_no", "line_text")).withColumn(
        "line_no", F.col("line_no") + 1
    )


def is_comment(line: Column) -> Column:
    return line.rlike(r"^\s*(#|//|/\*|<!--)")


def required_literal(pattern: str) -> str:
    """The longest run of letters and marks that every match of a pattern holds as it stands; empty if there is none."""
    tree = parser.parse(pattern)
    if tree.state.flags & re.IGNORECASE:
        return ""
    runs = [""]
    for op, arg in tree:
        if op is sre.LITERAL:
            runs[-1] += chr(arg)
        elif op is not sre.AT:
            runs.append("")
    return max(runs, key=len)


def _hit(line: Column, kind: str, hit_class: str, cwe: int | None, pattern: str) -> Column:
    holds = line.rlike(pattern)
    literal = required_literal(pattern)
    if len(literal) >= 2:
        # Looking for a fixed text costs far less than a pattern, and most lines lack it.
        holds = F.contains(line, F.lit(literal)) & holds
    if kind in C.UNLESS_FOLLOWED:
        holds = holds & ~line.rlike(C.UNLESS_FOLLOWED[kind])
    fields = F.struct(F.lit(hit_class).alias("hit_class"), F.lit(kind).alias("kind"), F.lit(cwe).cast("int").alias("cwe"))
    return F.when(holds, fields)


def catalogue() -> list[tuple[str, str, int | None, str]]:
    """(hit_class, kind, cwe, pattern) of all patterns, in order."""
    return [
        *(("route", k, None, p) for k, p in C.ROUTES),
        *(("source", k, None, p) for k, p in C.SOURCES),
        *(("sink", k, c, p) for k, c, p in C.SINKS),
        *(("secret", k, None, p) for k, p in C.SECRETS),
    ]


def line_hits(numbered: DataFrame) -> DataFrame:
    """Rows of ``lines`` once for each distinct (hit_class, kind, cwe) they hit. Patterns are literals and compile once."""
    line = F.col("line_text")
    hits = F.array(*(_hit(line, kind, hit_class, cwe, p) for hit_class, kind, cwe, p in catalogue()))
    found = numbered.where(~is_comment(line)).withColumn("h", F.explode(F.array_distinct(F.array_compact(hits))))
    return found.select(*numbered.columns, "h.hit_class", "h.kind", "h.cwe")


def route_values(numbered: DataFrame) -> DataFrame:
    """Rows with the route they declare, at most 200 characters: the first pattern that matches counts."""
    value = F.coalesce(*(F.nullif(F.regexp_extract("line_text", p, 2 if p.count("(") - p.count(r"\(") > 1 else 1), F.lit("")) for _, p in C.ROUTES))
    return numbered.where(~is_comment(F.col("line_text"))).withColumn("route", F.substring(value, 1, 200)).where("route is not null")


def top_per_class(hits: DataFrame, order: list[str], n: int = 40) -> DataFrame:
    """The first ``n`` rows of each class. Ranks within parts come first, so no task sorts a whole class."""
    part = F.pmod(F.xxhash64(*order), F.lit(64))
    within = Window.partitionBy("hit_class", "part").orderBy(*order, "kind")
    few = hits.withColumn("part", part).withColumn("rank", F.row_number().over(within)).where(F.col("rank") <= n)
    overall = Window.partitionBy("hit_class").orderBy(*order, "kind")
    return few.withColumn("rank", F.row_number().over(overall)).where(F.col("rank") <= n).drop("part")


def context(numbered: DataFrame, keys: list[str], around: DataFrame, reach: int = 5) -> DataFrame:
    """Lines ``reach`` above and below each line in ``around`` (keys, line_no), joined by line breaks."""
    near = around.withColumn("at", F.explode(F.sequence(F.col("line_no") - reach, F.col("line_no") + reach)))
    text = numbered.select(*keys, F.col("line_no").alias("at"), "line_text")
    lines_of = near.join(text, [*keys, "at"]).groupBy(*keys, "line_no").agg(F.array_sort(F.collect_list(F.struct("at", "line_text"))).alias("held"))
    return lines_of.select(*keys, "line_no", F.array_join("held.line_text", "\n").alias("window"))
