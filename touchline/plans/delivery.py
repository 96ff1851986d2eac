"""Delivery types, tactical profiles and percentile radars."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from touchline import schema as S
from touchline.functions.corner import delivery_type
from touchline.functions.labels import image_tag, number_text, paste, percent_label
from touchline.functions.nulls import ratio
from touchline.operators.relational import for_season, longer, with_logo
from touchline.operators.windows import percentile_ranks, rescale_unit
from touchline.plans.corners import ROWS, corner_totals, outcome_sums, sums_by_season
from touchline.sources.tables import EventTables

EFFECTIVENESS = ["tasa_de_remate", "tasa_de_gol_por_corner", "valor_promedio_obv"]


def _shot_rate() -> Column:
    return ratio(F.col("remates"), F.col(ROWS))


def _delivery_rates(t: EventTables) -> DataFrame:
    """Corners, shot rate, goal rate and mean OBV per delivery type."""
    sums = corner_totals(t).groupBy("tipo_cobro").agg(*(c.alias(n) for n, c in outcome_sums().items()))
    return sums.select(
        "tipo_cobro",
        F.col(ROWS).alias("total_corners"),
        _shot_rate().alias("tasa_de_remate"),
        ratio(F.col("goles"), F.col(ROWS)).alias("tasa_de_gol_por_corner"),
        ratio(F.col("obv"), F.col("filas_obv")).alias("valor_promedio_obv"),
    )


def delivery_summary(t: EventTables) -> DataFrame:
    """The rates per delivery type, best OBV first."""
    return _delivery_rates(t).orderBy(F.col("valor_promedio_obv").desc_nulls_last())


def delivery_effectiveness(t: EventTables) -> DataFrame:
    """Rates and mean OBV per delivery type, long form with labels (section 7)."""
    rows = longer(_delivery_rates(t).drop("total_corners"), ["tipo_cobro"], EFFECTIVENESS)
    label = F.when(F.col("metrica") == "valor_promedio_obv", number_text(F.col("valor"), 4))
    return rows.withColumn("etiqueta", label.otherwise(percent_label(F.col("valor"))))


def tactical_profile(
    t: EventTables,
    season: str | None = None,
    min_corners: int = 5,
    rescale_before_logos: bool = False,
) -> DataFrame:
    """Shot rate per season, team and delivery type, rescaled to 0..1 among the
    teams of that season and type (section 8).

    Keeps combinations with more than ``min_corners`` outcome rows. Teams
    without a badge leave before the rescale, or after it with
    ``rescale_before_logos``.
    """
    sums = sums_by_season(
        corner_totals(t),
        t,
        {ROWS: F.sum(ROWS), "remates": F.sum("remates")},
        ["team_name", "tipo_cobro"],
    )
    rates = for_season(sums.where(F.col("temporada").isNotNull()), season).where(
        F.col(ROWS) > min_corners
    )
    rates = rates.select(
        "temporada",
        "team_name",
        "tipo_cobro",
        F.col(ROWS).alias("total_corners_temporada"),
        _shot_rate().alias("tasa_de_remate"),
    )
    among = ["temporada", "tipo_cobro"]
    if rescale_before_logos:
        profile = with_logo(rescale_unit(rates, "tasa_de_remate", among, "tasa_normalizada"), t.logos)
    else:
        profile = rescale_unit(with_logo(rates, t.logos), "tasa_de_remate", among, "tasa_normalizada")
    title = paste(image_tag(F.col("logo_url"), 20), " ", F.col("team_name"))
    return profile.withColumns(
        {"facet_title": title, "etiqueta": percent_label(F.col("tasa_de_remate"))}
    )


XG_MODES = {"linked": "xG_linked", "as_written": "xG_as_written"}


def _team_season_totals(t: EventTables) -> DataFrame:
    shares = [S.OUTSWINGER, S.INSWINGER, S.SHORT, S.DIRECT]
    kind = delivery_type(other=S.DIRECT)
    own_xg = F.when(F.col("remates") > 0, F.col("xg"))
    sums = {
        **outcome_sums(),
        "xG_linked": F.sum("xg_vinculado"),
        "xG_as_written": F.sum(own_xg),
        **{k: F.sum(F.when(F.col("clase") == k, F.col(ROWS)).otherwise(0)) for k in shares},
    }
    corners = corner_totals(t).withColumn("clase", kind)
    totals = sums_by_season(corners, t, sums, ["team_name"]).where(F.col("temporada").isNotNull())
    return totals.select(
        "temporada",
        "team_name",
        F.col("remates").alias("Remates"),
        F.col("goles").alias("Goles"),
        *(F.coalesce(c, F.lit(0.0)).alias(c) for c in XG_MODES.values()),
        F.coalesce("obv", F.lit(0.0)).alias("OBV"),
        _shot_rate().alias("Tasa_Remate"),
        *(ratio(F.col(k), F.col(ROWS)).alias(k) for k in shares),
    )


def team_season_metrics(t: EventTables, xg_mode: str = "linked") -> DataFrame:
    """Corner volume, quality and delivery mix per known season and team.

    ``xg_mode``: "linked" sums the xG of the shots a corner led to; "as_written"
    sums the xG recorded on the corner events themselves, which the feed leaves
    empty, and is therefore 0.
    """
    totals = _team_season_totals(t).withColumnRenamed(XG_MODES[xg_mode], "xG")
    return totals.select("temporada", "team_name", *S.RADAR_METRICS)


def team_xg_from_corners(t: EventTables) -> DataFrame:
    """Both readings of a team's xG from corners, side by side."""
    return _team_season_totals(t).select("temporada", "team_name", *XG_MODES.values())


def delivery_mix(t: EventTables) -> DataFrame:
    """Share of each delivery type per season and team."""
    return team_season_metrics(t).select(
        "temporada", "team_name", S.OUTSWINGER, S.INSWINGER, S.SHORT, S.DIRECT
    )


def percentile_profile(t: EventTables, min_shots: int = 0, xg_mode: str = "linked") -> DataFrame:
    """Season percentile of each metric, teams with more than ``min_shots`` shots
    (section 9)."""
    metrics = team_season_metrics(t, xg_mode).where(F.col("Remates") > min_shots)
    return percentile_ranks(metrics, S.RADAR_METRICS, ["temporada"])


def team_radars(t: EventTables, min_shots: int = 0, xg_mode: str = "linked") -> DataFrame:
    """Radar rows (metric, percentile) of every team with a badge, all seasons."""
    profile = with_logo(percentile_profile(t, min_shots, xg_mode), t.logos)
    return longer(profile, ["temporada", "team_name", "logo_url"], S.RADAR_METRICS, "valor_percentil")


def team_radar(
    t: EventTables, season: str | None, team: str, min_shots: int = 0, xg_mode: str = "linked"
) -> DataFrame:
    """Radar of one team in one season; percentiles compare within a season, so
    there is no all-seasons radar."""
    if season is None:
        raise ValueError("a radar needs one season")
    return for_season(team_radars(t, min_shots, xg_mode), season).where(F.col("team_name") == team)
