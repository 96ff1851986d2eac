"""Two-dimensional Gaussian kernel density per group, on a regular grid."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from touchline.schema import PITCH_LENGTH, PITCH_WIDTH


#: Ranges a coordinate is counted in before quartiles are looked up inside one of them.
RANGES = 1000


def quartiles(bins: DataFrame, by: list[str], value: str, weight: str, low: float, high: float) -> DataFrame:
    """Exact quartiles (q1, q3) of weighted values per group, interpolated between ranks.

    Running counts in two levels: over RANGES ranges of a group, then over the distinct
    values of the range that holds a wanted rank. No task holds all values of a group.
    """
    cell = F.floor((F.col(value) - low) * (RANGES / (high - low)))
    counts = bins.groupBy(*by, cell.alias("cell"), F.col(value).alias("v")).agg(F.sum(weight).alias("w"))
    earlier = Window.partitionBy(*by).orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    cells = counts.groupBy(*by, "cell").agg(F.sum("w").alias("in_cell")).withColumns(
        {
            "before": F.coalesce(F.sum("in_cell").over(earlier), F.lit(0)),
            "n": F.sum("in_cell").over(Window.partitionBy(*by)),
        }
    )
    at = lambda q: F.lit(q) * (F.col("n") - 1)
    ranks = F.array(*(F.struct(F.lit(i).alias("place"), edge(at(q)).cast("long").alias("rank"))
                      for i, (q, edge) in enumerate([(0.25, F.floor), (0.25, F.ceil), (0.75, F.floor), (0.75, F.ceil)])))
    wanted = cells.select(*by, "cell", "before", "in_cell", "n", F.inline(ranks)).where(
        "before <= rank AND rank < before + in_cell"
    )
    inside = Window.partitionBy(*by, "cell", "place").orderBy("v").rowsBetween(Window.unboundedPreceding, 0)
    found = counts.join(wanted, [*by, "cell"]).withColumn("to_here", F.col("before") + F.sum("w").over(inside))
    found = found.where("to_here - w <= rank AND rank < to_here").groupBy(*by).agg(
        F.max("n").alias("n"), *(F.max(F.when(F.col("place") == i, F.col("v"))).alias(f"v{i}") for i in range(4))
    )

    def between(q: float, lower: str, upper: str) -> Column:
        share = at(q) - F.floor(at(q))
        return (1 - share) * F.col(lower) + share * F.col(upper)

    return found.select(*by, between(0.25, "v0", "v1").alias("q1"), between(0.75, "v2", "v3").alias("q3"))


def kernel_sd(values: Column, weights: Column, q1: Column, q3: Column) -> Column:
    """Normal-reference bandwidth of weighted values, as a kernel standard
    deviation: 1.06 min(sd, IQR/1.34) n^(-1/5). NULL where it would not be positive."""
    n = F.sum(weights)
    total = F.sum(values * weights)
    squares = F.sum(values * values * weights)
    variance = F.try_divide(squares - total * total / n, n - 1)
    sd = F.sqrt(F.greatest(variance, F.lit(0.0)))
    spread = (F.max(q3) - F.max(q1)) / 1.34
    width = 1.06 * F.least(sd, spread) * F.pow(n.cast("double"), F.lit(-0.2))
    return F.when(width > 0, width)


BLOCK = 20


def _smoothed(
    df: DataFrame, by: list[str], weight: str, at: str, sd: str, low: float, step: float, cells: int, index: str
) -> DataFrame:
    """Sum ``weight`` x Gaussian kernel at ``cells`` grid values, per ``by``.

    A row meets the grid in blocks of BLOCK values, one aggregate per value, so
    it is repeated once per block and not per value, and a group crosses the
    exchange as one row per block and task; the values become rows after it.
    Blocks also keep the aggregation within the size of generated code.
    """
    blocks = F.sequence(F.lit(0), F.lit(math.ceil(cells / BLOCK) - 1))
    blocked = df.withColumn("block", F.explode(blocks)).withColumn(
        "distance", low + F.col("block") * (BLOCK * step) - F.col(at)
    )
    sums = (
        F.expr(f"sum({weight} * exp(-0.5D * ((distance + {i * step!r}D) / {sd}) * ((distance + {i * step!r}D) / {sd})))")
        for i in range(BLOCK)
    )
    wide = blocked.groupBy(*by, "block").agg(*(total.alias(f"g{i}") for i, total in enumerate(sums)))
    values = F.slice(F.array(*(F.col(f"g{i}") for i in range(BLOCK))), F.lit(1), cells - F.col("block") * BLOCK)
    return wide.select(*by, (F.col("block") * BLOCK).alias(index), values.alias("s"))


def _density_runs(
    points: DataFrame,
    by: list[str],
    x: str = "end_x",
    y: str = "end_y",
    cells: int = 100,
    xlim: tuple[float, float] = (0.0, PITCH_LENGTH),
    ylim: tuple[float, float] = (0.0, PITCH_WIDTH),
) -> DataFrame:
    """Densities of each group's points: (by, ix, iy, s), a run of up to BLOCK values from iy on.

    Equal points are counted first, so the later cost follows the number of
    distinct coordinates (at most the pitch at the feed's resolution) and not
    the number of points. The Gaussian kernel is separable: the first sum runs
    along x, the second along y, which takes distinct * cells steps instead of
    distinct * cells^2. A group without spread along an axis falls back to a
    kernel one grid step wide.
    """
    step_x = (xlim[1] - xlim[0]) / (cells - 1)
    step_y = (ylim[1] - ylim[0]) / (cells - 1)
    bins = (
        points.where(F.col(x).isNotNull() & F.col(y).isNotNull())
        .groupBy(*by, F.col(x).alias("px"), F.col(y).alias("py"))
        .agg(F.count("*").alias("w"))
    )
    # Both axes go through one pass, as rows of their own.
    axes = F.array(*(F.struct(F.lit(a).alias("axis"), F.col(f"p{a}").cast("double").alias("v")) for a in "xy"))
    along = quartiles(
        bins.select(*by, "w", F.inline(axes)), [*by, "axis"], "v", "w", min(xlim[0], ylim[0]), max(xlim[1], ylim[1])
    )
    edges = {f"{a}{q}": F.max(F.when(F.col("axis") == a, F.col(f"q{q}"))) for a in "xy" for q in (1, 3)}
    moments = bins.join(along.groupBy(*by).agg(*(edge.alias(name) for name, edge in edges.items())), by)
    widths = moments.groupBy(*by).agg(
        F.sum("w").alias("n"),
        F.coalesce(kernel_sd(F.col("px"), F.col("w"), F.col("x1"), F.col("x3")), F.lit(step_x)).alias("hx"),
        F.coalesce(kernel_sd(F.col("py"), F.col("w"), F.col("y1"), F.col("y3")), F.lit(step_y)).alias("hy"),
    )
    # The widths ride along in the groupings: they depend on the group only. The
    # kernel sums are heavy per byte, so rows are spread by (group, y) over a fixed
    # number of tasks: by the group alone a team would stay in one task, and AQE
    # would merge partitions that are small only in bytes.
    group = [*by, "n", "hx", "hy"]
    tasks = int(points.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    spread = bins.join(widths, by).repartition(tasks, *by, "py")
    along_x = _smoothed(spread, [*group, "py"], "w", "px", "hx", xlim[0], step_x, cells, "ix")
    along_x = along_x.select(*group, "py", "ix", F.posexplode("s").alias("place", "s"))
    along_x = along_x.select(*group, "py", (F.col("ix") + F.col("place")).alias("ix"), "s")
    along_y = _smoothed(along_x, [*group, "ix"], "s", "py", "hy", ylim[0], step_y, cells, "iy")
    volume = 2 * math.pi * F.col("n") * F.col("hx") * F.col("hy")
    return along_y.select(*by, "ix", "iy", F.transform("s", lambda s: s / volume).alias("s"))


def _cells(runs: DataFrame, kept: list[str], cells: int, xlim: tuple, ylim: tuple) -> DataFrame:
    """One row per grid point of the runs."""
    step_x, step_y = (xlim[1] - xlim[0]) / (cells - 1), (ylim[1] - ylim[0]) / (cells - 1)
    rows = runs.select(*kept, "ix", "iy", F.posexplode("s").alias("place", "densidad"))
    return rows.select(
        *kept,
        (xlim[0] + F.col("ix") * step_x).alias("grid_x"),
        (ylim[0] + (F.col("iy") + F.col("place")) * step_y).alias("grid_y"),
        "densidad",
    )


PITCH_X, PITCH_Y = (0.0, PITCH_LENGTH), (0.0, PITCH_WIDTH)


def kernel_density(
    points: DataFrame,
    by: list[str],
    x: str = "end_x",
    y: str = "end_y",
    cells: int = 100,
    xlim: tuple[float, float] = PITCH_X,
    ylim: tuple[float, float] = PITCH_Y,
) -> DataFrame:
    """Density of each group's points at ``cells`` x ``cells`` grid points."""
    return _cells(_density_runs(points, by, x, y, cells, xlim, ylim), by, cells, xlim, ylim)


def pretty_step(low: Column, high: Column, steps: int = 10) -> Column:
    """Width of about ``steps`` round intervals (1, 2 or 5 times a power of ten)
    covering low..high."""
    cell = (high - low) / steps
    base = F.pow(F.lit(10.0), F.floor(F.log10(cell)))
    unit = (
        F.when(10 * base - cell < 1.5 * (cell - 5 * base), 10 * base)
        .when(5 * base - cell < 2.75 * (cell - 2 * base), 5 * base)
        .when(2 * base - cell < 1.5 * (cell - base), 2 * base)
        .otherwise(base)
    )
    return F.when(high > low, unit)


def contour_grid(
    points: DataFrame,
    by: list[str],
    panel: list[str],
    x: str = "end_x",
    y: str = "end_y",
    cells: int = 100,
    xlim: tuple[float, float] = PITCH_X,
    ylim: tuple[float, float] = PITCH_Y,
) -> DataFrame:
    """``kernel_density`` with contour levels (the highest round break at or below the
    density); breaks span the density range of the whole panel (no columns: one panel).

    The range is taken from the runs of the grid, the same rows that become cells
    last, so the kernel sums are evaluated once.
    """
    runs = _density_runs(points, by, x, y, cells, xlim, ylim)
    step = pretty_step(F.min(F.array_min("s")), F.max(F.array_max("s"))).alias("paso")
    if panel:
        # One row per panel (a season), however many points: a shuffle would deal by a few hot keys.
        stepped = runs.join(F.broadcast(runs.groupBy(*panel).agg(step)), panel)
    else:
        stepped = runs.withColumn("paso", runs.agg(step).scalar())
    level = F.floor(F.col("densidad") / F.col("paso")) * F.col("paso")
    return _cells(stepped, [*by, "paso"], cells, xlim, ylim).withColumn("nivel", level).drop("paso")
