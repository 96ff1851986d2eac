"""Set-piece chances per 90 minutes and dependence on set pieces."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from touchline.functions.corner import is_set_piece
from touchline.functions.nulls import count_true, ratio
from touchline.operators.relational import (
    for_season,
    null_safe_left,
    roles_to_entity,
    with_logo,
    without_logo,
)
from touchline.plans.corners import shots, sums_by_season
from touchline.plans.stored import stored
from touchline.schema import MATCH_MINUTES
from touchline.sources.tables import EventTables

COMPONENTS = ["ocasiones_abp", "ocasiones_totales", "minutos_totales"]


def minutes_per_team(t: EventTables, only_with_events: bool = False) -> DataFrame:
    """Minutes played per season and team: 90 per listed match and team.

    All listed matches count, also those without events, which understates the
    per-90 figures of partial coverage; ``only_with_events`` leaves them out.
    """
    matches = t.matches
    if only_with_events:
        covered = t.events.select("match_id").distinct()
        matches = matches.join(covered, "match_id", "left_semi")
    roles = roles_to_entity(
        matches.select(F.col("season_name").alias("temporada"), "home_team_name", "away_team_name"),
        ["temporada"],
        ["home_team_name", "away_team_name"],
        "team_name",
    )
    return roles.groupBy("temporada", "team_name").agg(
        (F.count("*") * MATCH_MINUTES).alias("minutos_totales")
    )


@stored
def set_piece_chances(t: EventTables) -> DataFrame:
    """Set-piece and total shots per season and team."""
    flagged = shots(t).select("match_id", "team_name", is_set_piece().alias("es_balon_parado"))
    sums = {"ocasiones_abp": count_true(F.col("es_balon_parado")), "ocasiones_totales": F.count("*")}
    return sums_by_season(flagged, t, sums, ["team_name"])


def _rates(df: DataFrame) -> DataFrame:
    return df.withColumns(
        {
            "ocasiones_abp_por_90": ratio(F.col("ocasiones_abp"), F.col("minutos_totales")) * MATCH_MINUTES,
            "pct_ocasiones_abp": ratio(F.col("ocasiones_abp"), F.col("ocasiones_totales")),
        }
    )


def set_piece_dependence(
    t: EventTables, season: str | None = None, only_with_events: bool = False
) -> DataFrame:
    """Per-90 set-piece chances and their share of all chances (section 13)."""
    minutes = minutes_per_team(t, only_with_events)
    joined = null_safe_left(set_piece_chances(t), minutes, ["temporada", "team_name"])
    return for_season(_rates(joined.where(F.col("minutos_totales") > 0)), season)


def dependence_scatter(t: EventTables, season: str | None = None) -> DataFrame:
    """The teams of the chart: those with a badge."""
    return with_logo(set_piece_dependence(t, season), t.logos)


def dependence_all_seasons(t: EventTables) -> DataFrame:
    """Components summed over seasons, then divided again."""
    totals = dependence_scatter(t).groupBy("team_name", "logo_url").agg(
        *(F.sum(c).alias(c) for c in COMPONENTS)
    )
    return _rates(totals)


def teams_without_logo(t: EventTables, season: str | None = None) -> DataFrame:
    """Teams the chart leaves out for lack of a badge."""
    return without_logo(set_piece_dependence(t, season), t.logos)
