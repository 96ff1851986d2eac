"""Spot checks and selector values."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from touchline import schema as S
from touchline.functions.corner import is_goal
from touchline.functions.nulls import member_of
from touchline.operators.relational import for_season, selector_domain
from touchline.plans.corners import ROWS, corner_totals, shots, with_season
from touchline.plans.delivery import percentile_profile
from touchline.plans.stored import stored
from touchline.sources.tables import EventTables


def one_team_summary(t: EventTables, season: str, team_pattern: str) -> DataFrame:
    """Corner and goal totals of the teams matching a regex, in one season."""
    corners = corner_totals(t).where(F.col("team_name").rlike(team_pattern))
    # One row per match, so the season join and the global sums stay small.
    per_match = corners.groupBy("match_id").agg(
        F.sum(ROWS).alias("corners"), F.sum("goles").alias("goles")
    )
    return for_season(with_season(per_match, t), season).agg(
        F.coalesce(F.sum("corners"), F.lit(0)).alias("corners_totales"),
        F.coalesce(F.sum("goles"), F.lit(0)).alias("goles_de_corner"),
    )


def corner_goals_check(t: EventTables, season: str, team_pattern: str) -> DataFrame:
    """Goals that the feed itself labels as coming from a corner."""
    labelled = F.col("shot_type").isin(*S.CORNER_SHOT_TYPES) | (F.col("play_pattern") == S.FROM_CORNER)
    goals = shots(t).where(is_goal() & labelled & F.col("team_name").rlike(team_pattern))
    return for_season(with_season(goals, t), season).select(
        "match_id", "minute", "second", "team_name", "player_name", "shot_type", "play_pattern"
    )


@stored
def team_names(t: EventTables) -> DataFrame:
    return t.events.select("team_name").distinct()


def event_teams(t: EventTables) -> DataFrame:
    return selector_domain(team_names(t), "team_name")


def radar_teams(t: EventTables) -> DataFrame:
    return selector_domain(percentile_profile(t), "team_name")


def set_piece_flags(t: EventTables) -> DataFrame:
    """Shots with their set-piece flag; an unknown pattern is no set piece."""
    return shots(t).select(
        "id", "match_id", "team_name",
        member_of(F.col("play_pattern"), S.SET_PIECE_PATTERNS).alias("es_balon_parado"),
    )
