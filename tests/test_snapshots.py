"""Versions of the prepared tables: refreshed by season, never half."""

from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from touchline.plans import corners, dashboard, delivery, ratios, snapshots
from touchline.plans.corners import with_season
from touchline.sources import driver_tables
from tools.compare import difference

NEW = "2023/2024"
PLANS = [corners.corner_outcomes, corners.enriched_shots, ratios.corners_per_goal_by_season, delivery.team_season_metrics]


@pytest.fixture(scope="module")
def whole(spark, sf_dir):
    return driver_tables.open_tables(spark, sf_dir)


@pytest.fixture(scope="module")
def earlier(whole):
    """Before the season NEW was played."""
    known = with_season(whole.events, whole, "id")
    events = known.where(F.col("temporada").isNull() | (F.col("temporada") != NEW)).drop("temporada")
    matches = whole.matches.where(F.col("season_name").isNull() | (F.col("season_name") != NEW))
    return replace(whole, events=events.select(*whole.events.columns), matches=matches)


def same(found, wanted):
    for plan in PLANS:
        assert difference(plan(found).toPandas(), plan(wanted).toPandas()) is None, plan.__name__


def test_refreshed_season_equals_a_full_rebuild(spark, whole, earlier, tmp_path, monkeypatch):
    folder = str(tmp_path / "snapshots")
    assert snapshots.refresh(earlier, folder) == 1
    before = snapshots.read_snapshot(spark, folder)
    same(before, earlier)

    # A run that dies midway leaves the version as it is.
    with monkeypatch.context() as patch:
        written = []

        def dying(t, name, real=snapshots._seasoned):
            written.append(name)
            if len(written) == 4:
                raise RuntimeError("lost")
            return real(t, name)

        patch.setattr(snapshots, "_seasoned", dying)
        with pytest.raises(RuntimeError, match="lost"):
            snapshots.refresh(whole, folder, [NEW])
    assert snapshots.commits(spark, folder).agg(F.max("version")).first()[0] == 1
    same(snapshots.read_snapshot(spark, folder), earlier)

    assert snapshots.refresh(whole, folder, [NEW]) == 2
    after = snapshots.read_snapshot(spark, folder)
    same(after, whole)
    same(snapshots.read_snapshot(spark, folder, 1), earlier)
    owners = snapshots._owners(spark, folder)[1]
    assert len(set(owners.values())) == 2 and [s for s, r in owners.items() if r == owners[NEW]] == [NEW]
    section = dashboard.section(after, "s11", "2022/2023", "Club NATION_5").toPandas()
    assert difference(section, dashboard.section(whole, "s11", "2022/2023", "Club NATION_5").toPandas()) is None
    names = [{r[0] for r in dashboard.TEAM_CHOICES["s11"](x).collect()} for x in (after, whole)]
    assert names[0] == names[1]


def test_no_version(spark, tmp_path):
    with pytest.raises(ValueError, match="no version"):
        snapshots.read_snapshot(spark, str(tmp_path / "nothing"))
