"""Where corners are delivered: end points, density and zones."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from touchline import schema as S
from touchline.operators.density import contour_grid
from touchline.operators.relational import for_season, with_logo
from touchline.operators.zones import assign_zones
from touchline.plans.corners import corner_table, season_of_match, sums_by_season, with_season
from touchline.sources.tables import EventTables


def corner_end_points(t: EventTables) -> DataFrame:
    """Every corner with delivery type and end point; coordinates may be unknown."""
    return corner_table(t).select("id", "match_id", "team_name", "tipo_cobro", "end_x", "end_y")


def delivery_points(t: EventTables, season: str | None = None) -> DataFrame:
    """End point of each corner of known season (section 10)."""
    points = with_season(corner_end_points(t).where(F.col("end_x").isNotNull()), t, "id")
    known = points.where(F.col("temporada").isNotNull())
    return for_season(known, season).select("team_name", "temporada", "end_x", "end_y")


def delivery_heatmap(
    t: EventTables, season: str | None = None, by_season: bool = False, cells: int = 100
) -> DataFrame:
    """Delivery density per team on the pitch, with contour levels (section 10).

    One panel of all teams for the chosen season(s), or with ``by_season`` one
    panel per season holding the teams that have a badge.
    """
    points = delivery_points(t, season)
    if by_season:
        by, panel = ["temporada", "team_name"], ["temporada"]
        points = with_logo(points, t.logos).drop("logo_url")
        return contour_grid(points, by, panel, cells=cells)
    return contour_grid(points, ["team_name"], [], cells=cells)


def zone_assignment(t: EventTables) -> DataFrame:
    """Each corner of known season and end point, once per zone it falls in."""
    points = with_season(corner_end_points(t).where(F.col("end_x").isNotNull()), t, "id")
    return assign_zones(points.where(F.col("temporada").isNotNull())).drop("id")


def _zone_totals(t: EventTables, team: str | None = None) -> DataFrame:
    """Corners per known season, team, delivery type and zone."""
    corners = corner_end_points(t).where(F.col("end_x").isNotNull())
    if team is not None:
        corners = corners.where(F.col("team_name") == team)
    points = assign_zones(corners)
    by = ["team_name", "tipo_cobro", "zona_nombre"]
    totals = sums_by_season(points, t, {"total_en_zona": F.count("*")}, by)
    return totals.where(F.col("temporada").isNotNull())


def _zones_with_anchor(t: EventTables) -> DataFrame:
    return S.zones_table(t.matches.sparkSession).withColumns(
        {
            "centro_x": (F.col("xmin") + F.col("xmax")) / 2,
            "centro_y": (F.col("ymin") + F.col("ymax")) / 2,
        }
    )


def zone_map(t: EventTables, team: str, season: str | None = None) -> DataFrame:
    """Zones with one team's deliveries by type; empty zones stay, with NULL
    (section 11). A selection without any corner gives no rows."""
    totals = for_season(_zone_totals(t, team), season)
    counts = totals.groupBy("zona_nombre", "team_name", "tipo_cobro").agg(
        F.sum("total_en_zona").alias("total_en_zona")
    )
    chosen = corner_end_points(t).where(F.col("team_name") == team)
    if season is not None:
        of_season = season_of_match(t).where(F.col("temporada") == season).select("match_id")
        chosen = chosen.join(of_season, "match_id", "left_semi")
    zones = _zones_with_anchor(t).where(chosen.exists())
    return zones.join(counts, "zona_nombre", "left")


def zone_counts(t: EventTables) -> DataFrame:
    """Zone deliveries of every team with a badge, by season and type."""
    zones = _zones_with_anchor(t).join(_zone_totals(t), "zona_nombre", "inner")
    return with_logo(zones, t.logos)


def dim_zones(t: EventTables) -> DataFrame:
    """The zone rectangles with label anchor and number of deliveries."""
    totals = _zone_totals(t).groupBy("zona_nombre").agg(F.sum("total_en_zona").alias("total_en_zona"))
    return _zones_with_anchor(t).join(totals, "zona_nombre", "left")
