"""Relations that must hold between results on the driver tables."""

import pytest
from pyspark.sql import functions as F

from touchline import schema as S
from tools.compare import difference
from touchline.plans import corners, dashboard, delivery, dependence, marts, occupancy, spatial
from touchline.sources import driver_tables


@pytest.fixture(scope="module")
def t(spark):
    return driver_tables.open_tables(spark, "/root/testdata/sf0.01")


def test_delivery_shares_sum_to_one(t):
    shares = sum(F.col(c) for c in ["Outswinger", "Inswinger", "Corto", "Directo"])
    assert delivery.delivery_mix(t).where(F.abs(shares - 1) > 1e-9).count() == 0


def test_percentiles_and_rescaled_rates_are_in_range(t):
    long = delivery.team_radars(t)
    assert long.where(~F.col("valor_percentil").between(0, 100)).count() == 0
    assert delivery.tactical_profile(t).where(~F.col("tasa_normalizada").between(0, 1)).count() == 0


def test_levels_add_up_to_the_shots(t):
    total = occupancy.shots_by_occupancy(t).agg(F.sum("total_remates_generados")).first()[0]
    assert total == corners.box_occupancy(t).count()


def test_goals_do_not_exceed_shots(t):
    assert occupancy.occupancy_season_totals(t).where("total_goles > total_remates").count() == 0


def test_every_end_point_gets_a_zone(t):
    points, zones = spatial.delivery_points(t).count(), spatial.zone_assignment(t).count()
    assert zones >= points


def test_minutes_are_ninety_per_match_and_team(t):
    minutes = dependence.minutes_per_team(t).agg(F.sum("minutos_totales")).first()[0]
    assert minutes == 2 * S.MATCH_MINUTES * t.matches.count()


def test_density_integrates_to_at_most_one(t):
    grid = spatial.delivery_heatmap(t, cells=41)
    area = (120 / 40) * (80 / 40)
    mass = grid.groupBy("team_name").agg((F.sum("densidad") * area).alias("m")).collect()
    assert all(0.2 < r.m < 1.05 for r in mass)


def test_nested_and_separate_frames_agree(spark, t):
    """Arrays built per event (fine at this size) give the same counts."""
    from dataclasses import replace

    arrays = t.frames.groupBy("id").agg(F.flatten(F.collect_list("freeze_frame")).alias("players"))
    nested = t.events.join(arrays, "id", "left").withColumn(
        "freeze_frame", F.when(F.col("has_frame"), F.coalesce("players", F.array()))
    )
    other = replace(t, events=nested.drop("players", "has_frame"), frames=None)
    for plan in (corners.box_occupancy, corners.corner_outcomes, corners.shots_with_category):
        assert plan(t).exceptAll(plan(other)).count() == 0
        assert plan(other).exceptAll(plan(t)).count() == 0


def test_prepared_tables_answer_like_raw_events(spark, t, tmp_path_factory):
    """Every dashboard section gives the same rows from the written tables."""
    prepared = marts.write_marts(t, str(tmp_path_factory.mktemp("marts")))
    for name in dashboard.SECTIONS:
        team = "Club NATION_5" if name in dashboard.TEAM_CHOICES else None
        raw = dashboard.section(t, name, "2022/2023", team).toPandas()
        from_files = dashboard.section(prepared, name, "2022/2023", team).toPandas()
        assert difference(from_files, raw) is None, name
    choices = [[r[0] for r in dashboard.TEAM_CHOICES["s11"](x).collect()] for x in (t, prepared)]
    assert choices[0] == choices[1]


def test_prepared_season_filter_prunes_folders(t, tmp_path_factory):
    prepared = marts.write_marts(t, str(tmp_path_factory.mktemp("seasons")))
    plan = occupancy.shot_tooltips(prepared, "2022/2023")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(temporada" in plan


@pytest.mark.parametrize("name", [n for n in dashboard.SECTIONS if n not in ("s10",)])
def test_dashboard_sections_answer(t, name):
    team = "Club NATION_5" if name in dashboard.TEAM_CHOICES else None
    assert dashboard.section(t, name, "2022/2023", team).count() > 0


def test_dashboard_starts_with_the_first_team(t):
    teams = {r.team_name for r in dashboard.section(t, "s11").collect()} - {None}
    assert teams == {"Club NATION_1"}
