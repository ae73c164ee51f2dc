"""Source trees as tables: file listings with reasons for not taking a file, targets, and marks in comments."""

from __future__ import annotations

import fnmatch

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F



def read_files(spark: SparkSession, root: str, glob: str | None = None) -> DataFrame:
    """(path, size, modified, content): files below ``root``; ``glob`` prunes names before content is read."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    return reader.load(root).select("path", F.col("length").alias("size"), F.col("modificationTime").alias("modified"), "content")


def _globs(c: Column, patterns: list[str]) -> Column:
    out = F.lit(False)
    for p in patterns:
        out = out | c.rlike("^" + fnmatch.translate(p).replace("(?s:", "(?s:").removesuffix("\\Z").removesuffix("\\z") + "$")
    return out


def intake(files: DataFrame, suffixes: list[str], deny_globs: list[str] = [], exclude: list[str] = [], most_bytes: int | None = None) -> DataFrame:  # noqa: B006
    """``files`` with ``skip_reason``, the first that holds, null where taken; equal contents are taken once, by least path."""
    suffix = F.concat(F.lit("."), F.lower(F.element_at(F.split("path", r"\."), -1)))
    reason = F.when(_contains_any(F.lower("path"), exclude), "excluded").when(~suffix.isin(suffixes), "suffix").when(_globs(F.col("path"), deny_globs), "glob")
    if most_bytes is not None:
        reason = reason.when(F.col("size") > most_bytes, "oversize")
    hashed = files.withColumn("sha256", F.sha2("content", 256)).withColumn("skip_reason", reason)
    first = hashed.where("skip_reason is null").groupBy("sha256").agg(F.min("path").alias("first_path"))
    again = F.when(F.col("skip_reason").isNull() & (F.col("path") != F.col("first_path")), "duplicate")
    return hashed.join(first, "sha256", "left").withColumn("skip_reason", F.coalesce("skip_reason", again)).drop("first_path")


def _contains_any(c: Column, parts: list[str]) -> Column:
    out = F.lit(False)
    for p in parts:
        out = out | F.contains(c, F.lit(p.lower()))
    return out


def byte_budget(files: DataFrame, group: str, order: list[str], most_bytes: int, most_files: int) -> DataFrame:
    """Files taken in order as long as they fit; one that does not fit is passed over, and a later, smaller one may fit.

    A round takes the longest run of files that fits, then drops those larger than what is left; every round takes at least one
    file of each group that has room, and rounds end when no file can fit. Returns ``files`` with ``taken``. Only sizes and keys move between rounds.
    """
    from siftstone.session import written

    left = written(files.select(group, *order, "size").withColumns({"used": F.lit(0).cast("long"), "count": F.lit(0).cast("long")}), "budget")
    taken = None
    while True:
        run = Window.partitionBy(group).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
        open_ = left.where((F.col("size") <= most_bytes - F.col("used")) & (F.col("count") < most_files))
        summed = open_.withColumns({"sum": F.sum("size").over(run), "n": F.count("*").over(run)}).withColumn(
            "fits", (F.col("used") + F.col("sum") <= most_bytes) & (F.col("count") + F.col("n") <= most_files)
        )
        summed = written(summed, "budget")
        got = summed.where("fits")
        taken = got.select(group, *order) if taken is None else taken.unionByName(got.select(group, *order))
        gain = got.groupBy(group).agg(F.sum("size").alias("more"), F.count("*").alias("more_n"))
        left = written(
            summed.where("not fits").join(gain, group, "left").select(
                group, *order, "size", (F.col("used") + F.coalesce("more", F.lit(0))).alias("used"), (F.col("count") + F.coalesce("more_n", F.lit(0))).alias("count")
            ),
            "budget",
        )
        if left.where((F.col("size") <= most_bytes - F.col("used")) & (F.col("count") < most_files)).isEmpty():
            break
    return files.join(taken.withColumn("taken", F.lit(True)), [group, *order], "left").na.fill(False, ["taken"])


def read_targets(spark: SparkSession, path: str) -> DataFrame:
    """(path, application_id) of a CSV with ``path`` or ``repo`` and ``application_id`` or ``app_id``; rows without a path are left out."""
    rows = spark.read.csv(path, header=True)
    have = [c for c in ("path", "repo") if c in rows.columns]
    apps = [F.col(c) for c in ("application_id", "app_id") if c in rows.columns] or [F.lit(None).cast("string")]
    return rows.select(F.coalesce(*(F.nullif(F.trim(c), F.lit("")) for c in have)).alias("path"), F.coalesce(*apps).alias("application_id")).where("path is not null")


def comment_marks(comments: DataFrame, text_col: str) -> DataFrame:
    """(scan_id, finding_id, mark) from marker comments: the first ticked box in the eight lines after each decides."""
    pattern = r"(?is)<!--\s*vuln-id:\s*(\S+)\s+scan-id:\s*(\S+?)\s*-->(.*?)(?=<!--\s*vuln-id:|\z)"
    part = lambda g: F.regexp_extract_all(text_col, F.lit(pattern), F.lit(g))
    each = comments.where(F.col(text_col).isNotNull()).select(F.explode(F.arrays_zip(part(1).alias("finding"), part(2).alias("scan"), part(3).alias("tail"))).alias("m"))
    lines = F.slice(F.split(F.substring("m.tail", 1, 800), "\n"), 1, 8)
    ticked = F.filter(lines, lambda x: x.rlike(r"(?i)^\s*- \[x\].*(true|false) positive"))
    first = F.lower(F.get(ticked, F.lit(0)))
    mark = F.when(first.contains("true positive"), "TP").when(first.contains("false positive"), "FP").otherwise("UNK")
    return each.select(F.col("m.scan").alias("scan_id"), F.col("m.finding").alias("finding_id"), mark.alias("mark"))


def reply_json(text: Column, schema: str) -> Column:
    """The record in a reply: JSON inside a fence first, else from the first brace to the last, else null."""
    fenced = F.regexp_extract(text, r"(?s)```(?:json)?\s*(\{.*?\})\s*```", 1)
    loose = F.regexp_extract(text, r"(?s)(\{.*\})", 1)
    valid = lambda c: F.when(F.try_parse_json(c).isNotNull(), c)
    return F.from_json(F.coalesce(valid(fenced), valid(loose)), schema)
