"""Shots and goals by number of attackers in the six-yard box."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from touchline.functions.labels import paste, percent_text, shot_tooltip
from touchline.functions.nulls import count_true, ratio, strict_sum, sum_or_zero
from touchline.operators.relational import for_season, longer, null_safe_left
from touchline.plans.corners import (
    enriched_shots,
    occupancy_category,
    shots_with_category,
    sums_by_season,
)
from touchline.schema import levels_table
from touchline.sources.tables import EventTables

LEVEL = ["categoria_atacantes", "categoria_orden"]
METRICS = ["total_remates", "xG_total", "total_goles"]


def _with_every_level(df: DataFrame) -> DataFrame:
    """Add one empty row (``presente`` = 0) per occupancy level, so that a later
    grouping has every level; an unknown level keeps its own group."""
    empty = levels_table(df.sparkSession).withColumn("presente", F.lit(0))
    return df.withColumn("presente", F.lit(1)).unionByName(empty, allowMissingColumns=True)


def shots_by_occupancy(t: EventTables) -> DataFrame:
    """Shots per level, zero-filled (section 1)."""
    shots = _with_every_level(occupancy_category(t).select(*LEVEL))
    return shots.groupBy(*LEVEL).agg(F.sum("presente").cast("long").alias("total_remates_generados"))


def goal_rate_by_occupancy(t: EventTables, strict: bool = True) -> DataFrame:
    """Goal rate per level (section 5).

    ``strict``: a level with a shot of unknown outcome has no goal total, and
    only levels that occur are listed. Otherwise unknown outcomes are no goals
    and every level is listed, with zeros.
    """
    shots = occupancy_category(t).select(*LEVEL, "fue_gol")
    if strict:
        totals = shots.groupBy(*LEVEL).agg(
            F.count("*").alias("total_remates"), strict_sum(F.col("fue_gol")).alias("total_goles")
        )
        return totals.withColumn("tasa_de_gol", ratio(F.col("total_goles"), F.col("total_remates")))
    totals = _with_every_level(shots).groupBy(*LEVEL).agg(
        F.sum("presente").cast("long").alias("total_remates"),
        count_true(F.col("fue_gol")).alias("total_goles"),
    )
    rate = ratio(F.col("total_goles"), F.col("total_remates"))
    return totals.withColumn("tasa_de_gol", F.coalesce(rate, F.lit(0.0)))


def _level_sums():
    return {
        "total_remates": F.count("*"),
        "xG_total": sum_or_zero(F.col("xG")),
        "total_goles": count_true(F.col("fue_gol")),
    }


def _levelled_shots(t: EventTables) -> DataFrame:
    shots = shots_with_category(t).withColumnRenamed("xg", "xG")
    return shots.where(F.col("categoria_atacantes").isNotNull())


def occupancy_comparison(t: EventTables) -> DataFrame:
    """Shots, xG and goals per level, long form (section 4)."""
    totals = _levelled_shots(t).groupBy(*LEVEL).agg(*(c.alias(n) for n, c in _level_sums().items()))
    return longer(totals, LEVEL, METRICS)


def occupancy_xg_summary(t: EventTables) -> DataFrame:
    """Shots, xG, mean xG per shot and goals per level, zero-filled."""
    shots = _with_every_level(_levelled_shots(t).select(*LEVEL, "xG", "fue_gol"))
    return shots.groupBy(*LEVEL).agg(
        F.sum("presente").cast("long").alias("total_remates"),
        sum_or_zero(F.col("xG")).alias("xG_total"),
        F.coalesce(F.avg("xG"), F.lit(0.0)).alias("xG_promedio_por_remate"),
        count_true(F.col("fue_gol")).alias("total_goles"),
    )


def occupancy_season_totals(t: EventTables) -> DataFrame:
    """Shots, xG and goals per known season and level, wide form."""
    totals = sums_by_season(_levelled_shots(t), t, _level_sums(), LEVEL)
    return totals.where(F.col("temporada").isNotNull())


def occupancy_by_season(t: EventTables, season: str | None = None) -> DataFrame:
    """Shots, xG and goals per season and level, long form (section 6)."""
    return longer(for_season(occupancy_season_totals(t), season), ["temporada", *LEVEL], METRICS)


def goal_rate_by_season(t: EventTables) -> DataFrame:
    totals = occupancy_season_totals(t)
    rate = ratio(F.col("total_goles"), F.col("total_remates"))
    return totals.withColumn("tasa_de_gol", rate).withColumn("etiqueta", percent_text(rate))


def level_counts(t: EventTables, season: str | None = None, by_season: bool = False, goals: bool = False) -> DataFrame:
    """Number of ``enriched_shots`` (or goals among them) per level, and per known season.

    Counted on the few columns it takes, below the joins that bring the taker and the
    match; shots shrink to one row per match and level before they meet the seasons.
    """
    shots = occupancy_category(t, "match_id").where(F.col("categoria_atacantes").isNotNull())
    if goals:
        shots = shots.where("fue_gol")
    if season is None and not by_season:
        return shots.groupBy("categoria_atacantes").agg(F.count("*").alias("n"))
    counts = sums_by_season(shots, t, {"n": F.count("*")}, ["categoria_atacantes"])
    if by_season:
        return counts.where(F.col("temporada").isNotNull())
    return for_season(counts, season).drop("temporada")


def facet_titles(shots: DataFrame, counts: DataFrame, by: list[str], noun: str) -> DataFrame:
    """Attach the size of each shot's group (``counts``: by, n) and the facet title.

    An unknown level or season is a group like any other. Counts by level alone have at most six
    rows, so they are broadcast and the shots stay where they are; with other keys Spark decides by size.
    """
    if set(by) <= set(LEVEL):
        counts = F.broadcast(counts)
    return null_safe_left(shots, counts, by).withColumn(
        "titulo_facet", paste(F.col("categoria_atacantes"), "\n(N = ", F.col("n"), f" {noun})")
    )


def _tooltips(shots: DataFrame, counts: DataFrame, by: list[str], goals: bool) -> DataFrame:
    titled = facet_titles(shots, counts, by, "Goles" if goals else "Remates")
    return titled.withColumn("tooltip_text", shot_tooltip(goal=goals))


def shot_tooltips(t: EventTables, season: str | None = None) -> DataFrame:
    """Delivery segments of shots with facet title and hover text (section 2)."""
    shots = for_season(enriched_shots(t), season)
    return _tooltips(shots, level_counts(t, season), ["categoria_atacantes"], goals=False)


def goal_tooltips(t: EventTables, season: str | None = None) -> DataFrame:
    """The same for goals (section 3)."""
    goals = for_season(enriched_shots(t).where("fue_gol"), season)
    return _tooltips(goals, level_counts(t, season, goals=True), ["categoria_atacantes"], goals=True)


def shot_tooltips_by_season(t: EventTables, goals: bool = False) -> DataFrame:
    """Segments of every known season at once, titles counted within a season."""
    shots = enriched_shots(t).where(F.col("temporada").isNotNull())
    if goals:
        shots = shots.where("fue_gol")
    counts = level_counts(t, by_season=True, goals=goals)
    return _tooltips(shots, counts, ["temporada", "categoria_atacantes"], goals)
