"""Tolerant joins: by file and nearby lines, with classes that may be missing.

Lines are cut into cells, so a file name that holds any share of the rows spreads over tasks. Rows without
path or line match nothing. Nearest rows win; ties go by the order column.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CELL = 64


def near_pairs(left: DataFrame, right: DataFrame, by: list[str], tolerance: int, residual: Column | None = None) -> DataFrame:
    """left ⋈ right on equal ``by`` and lines at most ``tolerance`` apart, with ``line_delta``.

    Left rows have ``line``, right rows ``other_line``; other columns must not clash.
    """
    lefts = left.withColumn("cell", F.floor(F.col("line") / CELL))
    rights = right.withColumn("cell", F.explode(F.sequence(F.floor((F.col("other_line") - tolerance) / CELL), F.floor((F.col("other_line") + tolerance) / CELL))))
    delta = F.abs(F.col("line") - F.col("other_line"))
    pairs = lefts.join(rights, [*by, "cell"]).where(delta <= tolerance)
    if residual is not None:
        pairs = pairs.where(residual)
    return pairs.drop("cell").withColumn("line_delta", delta)


def nearest(pairs: DataFrame, keys: list[str], order: list[str], keep: list[str]) -> DataFrame:
    """The first pair of each key by ``order``; an aggregate, so it combines before the shuffle."""
    best = pairs.groupBy(*keys).agg(F.min(F.struct(*order, *(k for k in keep if k not in order))).alias("best"))
    return best.select(*keys, *(F.col(f"best.{k}").alias(k) for k in keep))


def near_anti(left: DataFrame, right: DataFrame, keys: list[str], by: list[str], tolerance: int) -> DataFrame:
    """Rows of ``left`` with no row of ``right`` within ``tolerance`` lines."""
    matched = near_pairs(left, right, by, tolerance).select(*keys).distinct()
    return left.join(matched, keys, "left_anti")


def nearest_either_side(left: DataFrame, right: DataFrame, key: str, by: list[str], rank: str, other: str) -> DataFrame:
    """(key, other, rank, line_delta): for each left row the right row of equal ``by`` with the least
    (rank, distance, other), however far. Both have ``line``; ``rank`` is a boolean of the right.

    Sorted neighbours instead of pairs: the last right row before and the first one after each left row,
    per rank, so the work grows with the rows and not with their product.
    """
    places = right.groupBy(*by, "line", rank).agg(F.min(other).alias(other))
    marks = {r: F.when(F.col(rank).eqNullSafe(F.lit(r)), F.struct("line", other)) for r in (False, True)}
    rows = left.select(*by, "line", key, F.lit(None).cast("boolean").alias(rank), F.lit(None).cast(right.schema[other].dataType).alias(other)).unionByName(
        places.withColumn(key, F.lit(None).cast(left.schema[key].dataType))
    )
    # RANGE frames let rows of the same line see each other.
    up = Window.partitionBy(*by).orderBy("line").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    down = Window.partitionBy(*by).orderBy(F.desc("line")).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    seen = rows
    for r, mark in marks.items():
        seen = seen.withColumns({f"up_{r}": F.last(mark, ignorenulls=True).over(up), f"down_{r}": F.last(mark, ignorenulls=True).over(down)})

    def option(c: str, r: bool) -> Column:
        return F.when(F.col(c).isNotNull(), F.struct(F.lit(r).alias(rank), F.abs(F.col("line") - F.col(f"{c}.line")).alias("line_delta"), F.col(f"{c}.{other}").alias(other)))

    options = F.array_compact(F.array(*(option(f"{side}_{r}", r) for r in marks for side in ("up", "down"))))
    best = seen.where(F.col(key).isNotNull()).withColumn("best", F.array_min(options)).where("best is not null")
    return best.select(key, f"best.{other}", f"best.{rank}", "best.line_delta")
