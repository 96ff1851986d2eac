"""The thirteen dashboard sections as functions of season and team.

``section(tables, "s6", season="2022/2023")`` returns the lazy table behind a
section. ``season=None`` means all seasons.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from touchline.plans import checks, delivery, dependence, occupancy, ratios, spatial
from touchline.sources.tables import EventTables

# section -> function of tables, season, team
SECTIONS = {
    "s1": lambda t, season, team: occupancy.shots_by_occupancy(t),
    "s2": lambda t, season, team: occupancy.shot_tooltips(t, season),
    "s3": lambda t, season, team: occupancy.goal_tooltips(t, season),
    "s4": lambda t, season, team: occupancy.occupancy_comparison(t),
    "s5": lambda t, season, team: occupancy.goal_rate_by_occupancy(t),
    "s6": lambda t, season, team: occupancy.occupancy_by_season(t, season),
    "s7": lambda t, season, team: delivery.delivery_effectiveness(t),
    "s8": lambda t, season, team: delivery.tactical_profile(t, season),
    "s9": lambda t, season, team: delivery.team_radar(t, season, team),
    "s10": lambda t, season, team: spatial.delivery_heatmap(t, season),
    "s11": lambda t, season, team: spatial.zone_map(t, team, season),
    "s12a": lambda t, season, team: ratios.corners_per_goal(t, season),
    "s12b": lambda t, season, team: ratios.corners_per_sequence_goal(t, season),
    "s13": lambda t, season, team: dependence.dependence_scatter(t, season),
}

# section -> table of the teams its selector offers
TEAM_CHOICES = {"s9": checks.radar_teams, "s11": checks.event_teams}


def default_team(t: EventTables, name: str) -> Column:
    """The team a section shows before one is chosen, the first of its selector, as a subquery of the plan."""
    choices = TEAM_CHOICES[name](t)
    return choices.agg(F.min(choices.columns[0])).scalar()


def section(t: EventTables, name: str, season: str | None = None, team: str | None = None) -> DataFrame:
    if name in TEAM_CHOICES and team is None:
        team = default_team(t, name)
    return SECTIONS[name](t, season, team)
