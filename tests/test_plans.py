"""What the physical plans must look like."""

import re

import pytest

import __spark_entry__ as registry
from touchline.plans import corners, occupancy, ratios, spatial
from touchline.sources import driver_tables
from touchline.operators.relational import for_season
from touchline.sources.tables import EventTables, events_of_matches, scan_events
from touchline import schema as S
from tests.football import MATCH_DDL

SKIP = {"materialize_roundtrip", "snapshot_refresh", "ingest_quarantine", "ingest_repaired", "match_through_index", "ingest_pending_matches", "ingest_landing", "stream_landing", "stream_then_ingest",
        "feed_scan", "box_occupancy_nested", "corner_outcomes_nested", "season_roundtrip"}  # these write first


def plan_of(df) -> str:
    return df._jdf.queryExecution().explainString(
        df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")
    )


@pytest.mark.parametrize("key", [k for k in registry.queries() if k not in SKIP and k not in registry.LLM_QUERIES])
def test_no_python_and_no_pairing(spark, sf_dir, key):
    plan = plan_of(registry.queries()[key](spark, sf_dir))
    for operator in ("PythonUDF", "BatchEvalPython", "ArrowEvalPython", "InPandas", "CartesianProduct",
                     "BroadcastNestedLoopJoin"):
        assert operator not in plan


def test_kind_filter_reaches_the_scan(spark, sf_dir):
    t = driver_tables.open_tables(spark, sf_dir, links=False)
    plan = plan_of(corners.corner_events(t).select("id", "pass_length"))
    assert "EqualTo(event_type,click)" in plan
    scans = re.findall(r"ReadSchema: struct<(event_id[^>]*)>", plan)
    assert scans and all("value" not in scan for scan in scans)


def test_linking_reads_no_payload_columns(spark, sf_dir):
    t = driver_tables.open_tables(spark, sf_dir)
    plan = plan_of(corners.corner_assisted_shots(t).select("id"))
    assert all("props" not in scan for scan in re.findall(r"ReadSchema: struct<(event_id[^>]*)>", plan))


@pytest.fixture(scope="module")
def feed(spark, tmp_path_factory):
    """An empty feed in the provider's own layout."""
    path = str(tmp_path_factory.mktemp("feed"))
    spark.createDataFrame([], S.feed_schema()).write.mode("overwrite").parquet(path)
    return EventTables(
        events=scan_events(spark, path),
        matches=spark.createDataFrame([], MATCH_DDL),
        logos=S.logos_table(spark),
    )


def test_nested_frames_are_counted_without_exchange(feed):
    counted = corners.count_box_attackers(corners.shots(feed), feed).select("id", corners.ATTACKERS)
    assert "Exchange" not in plan_of(counted)


def test_nested_scan_prunes_to_location_and_teammate(feed):
    plan = plan_of(corners.box_occupancy(feed))
    assert "`shot.outcome.name`" in plan or "shot.outcome.name" in plan
    assert "pass.end_location" not in plan


def test_zone_assignment_is_part_of_the_scan_stage(feed):
    assert "Join" not in plan_of(spatial.assign_zones(spatial.corner_end_points(feed)))


def test_sequence_goals_shrink_before_the_join(feed):
    plan = ratios.flagged_corners(feed)._jdf.queryExecution().optimizedPlan().toString()
    assert re.search(r"Join LeftOuter", plan) and "max(ts" in plan


def test_only_small_counts_are_hinted():
    """One row per level or per panel, of the hot keys, which are counted, of seasons or grid levels; other joins leave the choice to Spark's size estimates."""
    from pathlib import Path

    files = [f for f in Path(corners.__file__).parents[1].rglob("*.py") if "llm" not in f.parts]
    assert sorted(f.name for f in files if "broadcast(" in f.read_text()) == ["density.py", "occupancy.py", "skew.py", "tables.py"]


def executed(df) -> str:
    """The final adaptive plan; the query runs."""
    execution = df._jdf.queryExecution()
    execution.executedPlan().execute().count()
    return execution.executedPlan().toString().split("== Initial Plan ==")[0]


@pytest.mark.parametrize("key", ["delivery_heatmap", "delivery_heatmap_by_season"])
def test_kernel_sums_are_evaluated_once(spark, sf_dir, key):
    """Contour range and cells share the exchange of each kernel sum."""
    plan = executed(registry.queries()[key](spark, sf_dir))
    partial = re.findall(r"HashAggregate\(keys=\[[^]]*block[^]]*\], functions=\[partial_sum", plan)
    assert len(partial) == 2 and "ReusedExchange" in plan and "percentile" not in plan


def test_titles_do_not_shuffle_the_shots(spark, sf_dir):
    shots = spark.range(10).selectExpr("id", "'0 Atacantes' AS categoria_atacantes")
    counts = shots.groupBy("categoria_atacantes").count().withColumnRenamed("count", "n")
    plan = occupancy.facet_titles(shots, counts, ["categoria_atacantes"], "Remates")
    assert plan_of(plan).count("Exchange hashpartitioning") <= 1


def test_unknown_level_has_its_title(spark):
    shots = spark.createDataFrame([(1, None), (2, "0 Atacantes"), (3, None)], "id long, categoria_atacantes string")
    counts = shots.groupBy("categoria_atacantes").agg({"*": "count"}).withColumnRenamed("count(1)", "n")
    titled = occupancy.facet_titles(shots, counts, ["categoria_atacantes"], "Remates")
    assert {r.id: (r.n, r.titulo_facet) for r in titled.collect()} == {
        1: (2, "NA\n(N = 2 Remates)"), 2: (1, "0 Atacantes\n(N = 1 Remates)"), 3: (2, "NA\n(N = 2 Remates)"),
    }


def test_frames_are_cut_down_before_they_are_exploded(spark, sf_dir):
    t = driver_tables.open_tables(spark, sf_dir)
    plan = corners.box_occupancy(t)._jdf.queryExecution().optimizedPlan().toString()
    below = plan[plan.index("Generate explode") :]
    assert re.search(r"Join LeftSemi", below[: below.index("l_orderkey")])


def test_hot_possession_is_spread(spark, feed):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = plan_of(ratios.flagged_corners(feed))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert len(re.findall(r"hashpartitioning\([^\n]*__(?:key|one)_team_name[^\n]*__(?:no_)?salt", plan)) == 2


def test_hot_corner_and_hot_match_are_spread(spark, feed):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        linked = plan_of(corners.enriched_shots(feed))
        points = plan_of(spatial.delivery_points(feed))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert len(re.findall(r"hashpartitioning\([^\n]*__(?:key|one)_key_pass_id[^\n]*__(?:no_)?salt", linked)) == 2
    assert len(re.findall(r"hashpartitioning\([^\n]*__(?:key|one)_match_id[^\n]*__(?:no_)?salt", linked)) == 2
    assert len(re.findall(r"hashpartitioning\([^\n]*__(?:key|one)_match_id[^\n]*__(?:no_)?salt", points)) == 2


def test_season_filter_and_match_dimension_prune_folders(spark, sf_dir):
    feed = registry._season_feed(spark, sf_dir)
    season = for_season(feed, "2022/2023", "season_name").select("id")
    assert re.search(r"PartitionFilters: \[[^]]*season_name#\d+ = 2022/2023", plan_of(season))
    matches = driver_tables.matches(spark, sf_dir).where("match_date < '1996-01-01'")
    found = events_of_matches(feed, matches).select("id")
    assert "dynamicpruning" in plan_of(found)
    assert found.count() == feed.join(matches.select("match_id"), "match_id", "left_semi").count() > 0
