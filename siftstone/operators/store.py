"""Upserts by window-free aggregation: the last row of each key wins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def latest_rows(rows: DataFrame, keys: list[str], order: list[str], columns: list[str] | None = None) -> DataFrame:
    """One row per key: the greatest by ``order``, nulls least. Whole rows, so columns never mix.

    Only keys, order and ``columns`` (default: all) are read. Text orders with null as empty. Rows equal in ``order`` and ``columns`` are
    the same row; of rows equal in ``order`` alone, the greatest by the hash of ``columns`` stands.
    """
    columns = columns or rows.columns
    types = dict(rows.dtypes)
    ranks = [F.coalesce(F.col(c), F.lit("")).alias(f"o{k}") if types[c] == "string" else F.col(c).alias(f"o{k}") for k, c in enumerate(order)]
    tie = F.xxhash64(*columns).alias("tie")
    best = rows.groupBy(*keys).agg(F.max_by(F.struct(*(c for c in columns if c not in keys)), F.struct(*ranks, tie)).alias("row"))
    return best.select(*keys, "row.*").select(*columns)


def upsert(store: DataFrame, batch: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The store with the rows of the batch put in, each key keeping its last row."""
    return latest_rows(store.unionByName(batch, allowMissingColumns=True), keys, order)


def apply_marks(store: DataFrame, marks: DataFrame, keys: list[str], column: str) -> DataFrame:
    """The store with ``column`` replaced where a mark is given; marks of unknown keys change nothing."""
    given = marks.where(F.col(column).isNotNull()).groupBy(*keys).agg(F.max(column).alias("given"))
    return store.join(given, keys, "left").withColumn(column, F.coalesce("given", column)).drop("given").select(*store.columns)
