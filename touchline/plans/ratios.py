"""Corners per goal, direct and in the same possession."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from touchline.functions.corner import is_goal
from touchline.functions.labels import two_decimals
from touchline.functions.nulls import count_true, ratio
from touchline.operators.relational import decorate_logo, for_season, ranked
from touchline.operators.sequences import flag_followed, next_target
from touchline.plans.corners import ROWS, corner_table, corner_totals, sums_by_season
from touchline.plans.stored import stored
from touchline.sources.tables import EventTables

SEQUENCE_KEYS = ["match_id", "possession", "team_id", "team_name"]


def _ratio_table(totals: DataFrame, goals: str, t: EventTables) -> DataFrame:
    """Corners per goal of those with a goal, as number and text, with the badge."""
    per_goal = ratio(F.col("total_corners"), F.col(goals))
    scored = totals.where(F.col(goals) > 0).withColumns(
        {"corners_por_gol": per_goal, "etiqueta": two_decimals(per_goal)}
    )
    return decorate_logo(scored, t.logos)


def _direct_totals(t: EventTables, by_season: bool) -> DataFrame:
    sums = {"total_corners": F.sum(ROWS), "total_goles_de_corner": F.sum("goles")}
    corners = corner_totals(t)
    if by_season:
        return sums_by_season(corners, t, sums, ["team_name"])
    return corners.groupBy("team_name").agg(*(c.alias(n) for n, c in sums.items()))


def corners_per_goal(t: EventTables, season: str | None = None) -> DataFrame:
    """Corners per goal scored from them, per team that scored (section 12a).

    Corners of unknown season count in the all-seasons ratio only. A corner
    with several shots counts once per shot.
    """
    totals = for_season(_direct_totals(t, by_season=season is not None), season).drop("temporada")
    return _ratio_table(totals, "total_goles_de_corner", t).orderBy("corners_por_gol")


def corners_per_goal_by_season(t: EventTables) -> DataFrame:
    """The same per known season and team."""
    totals = _direct_totals(t, by_season=True).where(F.col("temporada").isNotNull())
    return _ratio_table(totals, "total_goles_de_corner", t).orderBy(
        "temporada", "corners_por_gol"
    )


@stored
def flagged_corners(t: EventTables) -> DataFrame:
    """Corners, marked when their team scores later in the same possession."""
    corners = corner_table(t).select("id", "ts", *SEQUENCE_KEYS)
    goals = t.events.where(is_goal()).select("ts", *SEQUENCE_KEYS)
    return flag_followed(corners, goals, SEQUENCE_KEYS, "ts", "gol_en_secuencia")


def goal_sequences(t: EventTables) -> DataFrame:
    """Corners followed by a goal; two corners before one goal count twice."""
    return flagged_corners(t).where("gol_en_secuencia").drop("gol_en_secuencia")


def time_slot(t: EventTables) -> Column:
    """The minute of ``ts``, be it a clock within the period (text) or a timestamp."""
    if t.events.schema["ts"].dataType.typeName() == "string":
        return F.substring("ts", 1, 5)
    return F.date_trunc("minute", F.col("ts"))


def sequence_goals(t: EventTables) -> DataFrame:
    """The corners of ``goal_sequences``, each with the first later goal of its possession: gol_id, gol_ts."""
    corners = corner_table(t).select("id", "ts", *SEQUENCE_KEYS)
    goals = t.events.where(is_goal()).select("id", "ts", *SEQUENCE_KEYS)
    found = next_target(corners, goals, SEQUENCE_KEYS, "ts", time_slot(t), into="gol")
    followed = found.where(F.col("gol.id").isNotNull())
    return followed.select("id", "ts", *SEQUENCE_KEYS, F.col("gol.id").alias("gol_id"), F.col("gol.ts").alias("gol_ts"))


def _sequence_sums() -> dict:
    return {
        "total_goles_secuencia": count_true(F.col("gol_en_secuencia")),
        "total_corners": F.count("*"),
    }


def corners_per_sequence_goal(t: EventTables, season: str | None = None) -> DataFrame:
    """Corners per same-possession goal, teams with at least one (section 12b)."""
    corners = flagged_corners(t)
    if season is None:
        totals = corners.groupBy("team_name").agg(*(c.alias(n) for n, c in _sequence_sums().items()))
    else:
        totals = for_season(sums_by_season(corners, t, _sequence_sums(), ["team_name"]), season)
    return _ratio_table(totals.drop("temporada"), "total_goles_secuencia", t).orderBy("corners_por_gol")


def corners_per_sequence_goal_by_season(t: EventTables) -> DataFrame:
    """The same per season and team; the unknown season is a group of its own."""
    totals = sums_by_season(flagged_corners(t), t, _sequence_sums(), ["team_name"])
    return _ratio_table(totals, "total_goles_secuencia", t).orderBy(
        F.col("temporada").asc_nulls_last(), "corners_por_gol"
    )


def corners_per_sequence_goal_agg(t: EventTables) -> DataFrame:
    """Re-aggregated over the seasons in which the team scored that way."""
    by_season = sums_by_season(flagged_corners(t), t, _sequence_sums(), ["team_name"])
    totals = by_season.where(F.col("total_goles_secuencia") > 0).groupBy("team_name").agg(
        F.sum("total_corners").alias("total_corners"),
        F.sum("total_goles_secuencia").alias("total_goles_secuencia"),
    )
    return _ratio_table(totals, "total_goles_secuencia", t).orderBy("corners_por_gol")


def ranked_ratios(ratios: DataFrame) -> DataFrame:
    """A ratio table with each team's place, fewest corners per goal first."""
    return ranked(ratios, ["corners_por_gol", "team_name"])
