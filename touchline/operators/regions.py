"""Point-in-rectangle join with a table of rectangles, of any number and size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Sides of grid cells go from 2^-LEVELS to 2^LEVELS; larger, endless rectangles share one cell.
LEVELS = 24
BOUNDS = ["xmin", "xmax", "ymin", "ymax"]


def _level(side: Column) -> Column:
    """The finest level whose cells are at least as wide as ``side``, so that a rectangle lies in at most two cells a way."""
    fine = F.ceil(F.log2(F.greatest(side, F.lit(2.0 ** -LEVELS))))
    return F.when(side <= 2.0**LEVELS, F.greatest(fine, F.lit(-LEVELS))).otherwise(F.lit(LEVELS + 1)).cast("int")


def _cell(value: Column, level: Column) -> Column:
    """The number of the cell of a level that holds ``value``; one cell for all at the last level."""
    number = F.floor(value / F.pow(F.lit(2.0), level.cast("double")))
    return F.when(level > LEVELS, F.lit(0).cast("long")).otherwise(number)


def in_regions(points: DataFrame, regions: DataFrame, x: str, y: str) -> DataFrame:
    """Pairs of a point and a closed rectangle that holds it: the columns of ``points`` and those of ``regions`` but BOUNDS.

    Every rectangle lies in at most four cells of the grid level that fits its size, every point in one cell of each level in
    use (a few, whatever the number of rectangles), and pairs meet by equality of level and cell before the exact check: no
    nested loop, and no pair beyond a rectangle's own neighbourhood. Unknown coordinates and bounds hold nothing;
    infinite bounds are bounds.
    """
    side = F.greatest(F.col("xmax") - F.col("xmin"), F.col("ymax") - F.col("ymin"))
    known = F.lit(True)
    for bound in BOUNDS:
        known = known & F.col(bound).isNotNull() & ~F.isnan(F.col(bound).cast("double"))
    shaped = regions.where(known & (F.col("xmin") <= F.col("xmax")) & (F.col("ymin") <= F.col("ymax")))
    shaped = shaped.withColumn("__level", _level(side.cast("double")))
    for axis, low, high in (("x", "xmin", "xmax"), ("y", "ymin", "ymax")):
        ends = F.array(_cell(F.col(low), F.col("__level")), _cell(F.col(high), F.col("__level")))
        shaped = shaped.withColumn(f"__c{axis}", F.explode(F.array_distinct(ends)))
    # At most 2 * LEVELS + 2 numbers.
    levels = shaped.select("__level").distinct().agg(F.collect_list("__level")).scalar()
    placed = points.where(F.col(x).isNotNull() & F.col(y).isNotNull()).withColumn("__levels", levels)
    placed = placed.withColumn("__level", F.explode("__levels")).drop("__levels")
    placed = placed.withColumns(
        {"__px": _cell(F.col(x), F.col("__level")), "__py": _cell(F.col(y), F.col("__level"))}
    )
    inside = F.col(x).between(F.col("xmin"), F.col("xmax")) & F.col(y).between(F.col("ymin"), F.col("ymax"))
    named = [c for c in regions.columns if c not in BOUNDS]
    right = shaped.withColumnRenamed("__level", "__of")
    met = placed.join(right, (F.col("__level") == F.col("__of")) & (F.col("__px") == F.col("__cx")) & (F.col("__py") == F.col("__cy")) & inside)
    return met.select(*points.columns, *named)


def assign_regions(
    points: DataFrame, regions: DataFrame, id_col: str, x: str = "end_x", y: str = "end_y", name: str = "zona_nombre", default: str | None = None
) -> DataFrame:
    """One row per point and rectangle that holds it, or one with the ``default`` name where there is none.

    ``id_col`` tells the points apart. Rectangles of the same name count each.
    """
    hits = in_regions(points, regions.select(name, *BOUNDS), x, y)
    outside = points.join(hits.select(id_col).distinct(), id_col, "left_anti").select(*points.columns)
    return hits.unionByName(outside.withColumn(name, F.lit(default).cast("string")))
