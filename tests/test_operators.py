"""Generic operators against brute force on small inputs."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.football import MATCH_DDL, match, rows
from touchline import schema as S
from touchline.functions.labels import (
    number_text,
    percent_label,
    percent_text,
    safe_name,
    two_decimals,
    two_digits,
)
from touchline.functions.nulls import mean_of, strict_sum, sum_or_zero
from touchline.operators.density import kernel_density, pretty_step, quartiles
from touchline.operators.relational import any_of, cast_flags, null_safe_left, selector_domain
from touchline.operators.sequences import flag_followed, next_target
from touchline.operators.zones import assign_zones
from touchline.session import work_folder
from touchline.sources import ingest as landing
from touchline.sources.tables import catalog_entries, conform_matches, harmonize, scan_events, write_by_season
from touchline.streaming.landing import land_available


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first().v


@pytest.mark.parametrize(
    "value, digits, text",
    [
        (0.5, 2, "0.5"), (0.125, 2, "0.12"), (3.0, 2, "3"), (10.0, 1, "10"), (-0.0105, 4, "-0.0105"),
        (0.0123, 4, "0.0123"), (0.0005, 4, "5e-04"), (-0.00012, 4, "-1e-04"), (0.00001, 4, "0"),
        (0.001, 4, "0.001"), (100.0, 1, "100"), (-0.00001, 4, "0"),
        (float("nan"), 2, "NaN"), (float("nan"), 4, "NaN"),
    ],
)
def test_number_text(spark, value, digits, text):
    assert one(spark, number_text(F.lit(value), digits)) == text


def test_percent_labels(spark):
    assert one(spark, percent_label(F.lit(0.2))) == "20.0%"
    assert one(spark, percent_text(F.lit(0.2))) == "20%"
    assert one(spark, percent_label(F.lit(0.0625))) == "6.2%"
    assert one(spark, percent_text(F.lit(0.1444))) == "14.4%"
    assert one(spark, percent_text(F.lit(None).cast("double"))) == "NA%"


def test_two_decimals(spark):
    assert one(spark, two_decimals(F.lit(1234.5))) == "1,234.50"
    assert one(spark, two_decimals(F.lit(10.125))) == "10.12"


def test_padded_and_safe_text(spark):
    assert one(spark, two_digits(F.lit(5))) == "05"
    assert one(spark, two_digits(F.lit(None).cast("int"))) == "NA"
    assert one(spark, safe_name(F.lit("2022/2023"), F.lit("A/B"))) == "2022-2023_A-B"


def test_null_rules(spark):
    df = spark.createDataFrame(
        [("a", True, 1.0), ("a", False, None), ("b", None, None), ("b", True, None)],
        "k string, f boolean, x double",
    )
    got = df.groupBy("k").agg(strict_sum(F.col("f")), sum_or_zero(F.col("x")), mean_of(F.col("f")))
    assert rows(got) == [("a", 1, 1.0, 0.5), ("b", None, 0.0, 1.0)]


def test_projection_helpers(spark):
    df = spark.createDataFrame([("yes", "T", 1, 0)], "odd string, flag string, number int, `a.b` int")
    assert any_of(df, ["a.b", "missing", "flag"]).columns == ["a.b", "flag"]
    assert rows(cast_flags(df, ["odd", "flag", "number", "missing"]), "odd", "flag", "number") == [
        (None, True, True)
    ]


def test_selector_domain_is_sorted_and_known(spark):
    df = spark.createDataFrame([("b",), ("a",), (None,), ("b",)], "team_name string")
    assert [r[0] for r in selector_domain(df, "team_name").collect()] == ["a", "b"]


def test_null_safe_join(spark):
    left = spark.createDataFrame([(None, "x", 1), ("s", "x", 2)], "a string, b string, v int")
    right = spark.createDataFrame([(None, "x", 10)], "a string, b string, w int")
    assert rows(null_safe_left(left, right, ["a", "b"])) == [(None, "x", 1, 10), ("s", "x", 2, None)]


def test_harmonised_names(spark):
    df = spark.createDataFrame([("América", "León"), ("Toluca", None)], "h string, a string")
    assert rows(harmonize(df, ["h", "a"])) == [("Club América", "Club León"), ("Toluca", None)]


def test_logos_use_harmonised_names(spark):
    logos = dict(rows(S.logos_table(spark)))
    assert len(logos) == 18
    assert logos["Club América"].endswith("/1292.png") and "América" not in logos


def test_flag_followed_equals_pairwise(spark):
    rng = random.Random(7)
    events = [(i, rng.randrange(4), rng.randrange(12)) for i in range(60)]
    targets = [(rng.randrange(4), rng.randrange(12)) for _ in range(10)]
    got = flag_followed(
        spark.createDataFrame(events, "id int, k int, ts int"),
        spark.createDataFrame(targets, "k int, ts int"), ["k"], "ts", "later",
    )
    expected = sorted((i, any(k == g and u > ts for g, u in targets)) for i, k, ts in events)
    assert sorted((r.id, r.later) for r in got.collect()) == expected


def test_zones_equal_pairwise(spark):
    rng = random.Random(3)
    points = [(i, float(rng.randrange(85, 122)), float(rng.randrange(0, 82, 2))) for i in range(300)]
    got = assign_zones(spark.createDataFrame(points, "id int, end_x double, end_y double"))
    expected = []
    for i, x, y in points:
        hits = [z.zona_nombre for z in S.ZONES if z.xmin <= x <= z.xmax and z.ymin <= y <= z.ymax]
        expected += [(i, name) for name in hits or [S.OTHER_ZONE]]
    assert sorted((r.id, r.zona_nombre) for r in got.collect()) == sorted(expected)


def test_density_equals_direct_sum(spark):
    rng = np.random.default_rng(5)
    xs = np.round(rng.normal(108, 4, 80), 1)
    ys = np.round(rng.normal(40, 9, 80), 1)
    points = spark.createDataFrame(
        [("A", float(x), float(y)) for x, y in zip(xs, ys)] + [("B", 100.0, 10.0), ("B", 100.0, 30.0), ("A", None, 1.0)],
        "team string, end_x double, end_y double",
    )
    grid = kernel_density(points, ["team"], cells=13).collect()

    def sd(v):
        q = np.quantile(v, [0.25, 0.75])
        return 1.06 * min(v.std(ddof=1), (q[1] - q[0]) / 1.34) * len(v) ** -0.2

    hx, hy = sd(xs), sd(ys)
    cells = [r for r in grid if r.team == "A"]
    assert len(cells) == 169
    for r in cells:
        kernel = np.exp(-0.5 * (((r.grid_x - xs) / hx) ** 2 + ((r.grid_y - ys) / hy) ** 2))
        assert r.densidad == pytest.approx(kernel.sum() / (2 * math.pi * 80 * hx * hy), rel=1e-9, abs=1e-15)
    # B has no spread along x: its kernel is one grid step (10 m) wide there.
    peak = max(r.densidad for r in grid if r.team == "B")
    hy_b = 1.06 * min(math.sqrt(200), 10 / 1.34) * 2**-0.2
    at = {(r.grid_x, round(r.grid_y, 6)): r.densidad for r in grid if r.team == "B"}
    assert peak == pytest.approx(max(at.values()))
    expected = sum(math.exp(-0.5 * ((20.0 - y) / hy_b) ** 2) for y in (10.0, 30.0)) / (2 * math.pi * 2 * 10 * hy_b)
    assert at[(100.0, 20.0)] == pytest.approx(expected)


def test_contour_steps_are_round(spark):
    ranges = spark.createDataFrame([(0.0, 0.0249, 0.002), (0.0, 1.0, 0.1), (1.0, 1.0, None)], "a double, b double, step double")
    for r in ranges.withColumn("got", pretty_step(F.col("a"), F.col("b"))).collect():
        assert r.got == (pytest.approx(r.step) if r.step else None)


def test_quartiles_equal_the_exact_percentile(spark):
    rng = np.random.default_rng(8)
    values = [("A", float(v), int(w)) for v, w in zip(rng.normal(60, 30, 400), rng.integers(1, 5, 400))]
    values += [("B", 3.0, 1), ("C", 7.0, 5), ("D", 1.0, 1), ("D", 2.0, 1), ("E", -50.0, 2), ("E", 500.0, 1)]
    bins = spark.createDataFrame(values, "g string, v double, w long")
    wanted = bins.groupBy("g").agg(F.percentile("v", [0.25, 0.75], F.col("w")).alias("q"))
    got = {r.g: (r.q1, r.q3) for r in quartiles(bins, ["g"], "v", "w", 0.0, 120.0).collect()}
    assert got == {r.g: pytest.approx(tuple(r.q)) for r in wanted.collect()}


def test_catalogue(spark):
    catalogue = spark.createDataFrame(
        [("Mexico", "Liga MX", 73, 108, "b"), ("Mexico", "Liga MX", 73, 27, "a"), ("Spain", "La Liga", 11, 1, "c")],
        "country_name string, competition_name string, competition_id int, season_id int, season_name string",
    )
    assert [r.season_id for r in catalog_entries(catalogue, "Mexico", "Liga MX").collect()] == [27, 108]


def test_feed_scan_reads_many_files_with_sparse_columns(spark, tmp_path):
    first = spark.sql("SELECT 'e1' AS id, 1 AS match_id, 'Shot' AS `type.name`, array(1D, 2D) AS location")
    second = spark.sql("SELECT 'e2' AS id, 2L AS match_id, 'Pass' AS `type.name`, 'Corner' AS `pass.type.name`")
    first.write.parquet(str(tmp_path / "events" / "1.parquet"))
    second.write.parquet(str(tmp_path / "events" / "2.parquet"))
    events = scan_events(spark, str(tmp_path / "events"))
    assert events.columns == [f.name for f in S.EVENTS]
    assert rows(events, "id", "type_name", "pass_type") == [("e1", "Shot", None), ("e2", "Pass", "Corner")]


def test_match_scan_keeps_listed_columns(spark):
    raw = spark.sql(
        "SELECT 1L AS match_id, '2022/2023' AS `season.season_name`, 'A' AS `home_team.home_team_name`, "
        "'TRUE' AS neutral_ground, array(1) AS managers"
    )
    got = conform_matches(raw)
    assert got.columns == ["match_id", "season_name", "home_team_name", "neutral_ground"]
    assert got.first().neutral_ground is True


def feed_and_matches(spark):
    feed = spark.createDataFrame(
        [(f"e{i}", m) for i, m in enumerate([1, 1, 2, 3, 4, 5])], "id string, match_id bigint"
    )
    matches = spark.createDataFrame(
        [match(1), match(2, season="2023/2024"), match(3, status="processing"), match(4, status=None), match(6)],
        MATCH_DDL,
    )
    return feed, matches


def test_ingest_is_incremental_and_idempotent(spark, tmp_path):
    feed, matches = feed_and_matches(spark)
    folder = str(tmp_path / "landing")
    landing.ingest(spark, feed, matches, folder)
    assert rows(landing.scan_landing(spark, folder, feed.schema), "id", "season_name") == [
        ("e0", "2022/2023"), ("e1", "2022/2023"), ("e2", "2023/2024"),
    ]
    landing.ingest(spark, feed, matches, folder)
    assert landing.scan_landing(spark, folder, feed.schema).count() == 3
    pending = landing.pending_matches(matches, landing.read_manifest(spark, folder))
    assert rows(pending, "match_id") == [(6,)]
    now_there = matches.replace({"processing": "available"}, subset=["match_status_360"])
    landing.ingest(spark, feed, now_there, folder)
    assert rows(landing.scan_landing(spark, folder, feed.schema), "match_id") == [(1,), (1,), (2,), (3,)]


def test_ingest_with_nothing_pending(spark, tmp_path):
    feed, matches = feed_and_matches(spark)
    folder = str(tmp_path / "landing")
    landing.ingest(spark, feed, matches.where("match_id = 3"), folder)
    assert landing.scan_landing(spark, folder, feed.schema).count() == 0


def test_events_of_an_unfinished_run_stay_invisible(spark, tmp_path):
    feed, matches = feed_and_matches(spark)
    folder = str(tmp_path / "landing")
    half = feed.where("match_id = 2").withColumn("season_name", F.lit("2023/2024"))
    write_by_season(half, f"{folder}/events/run=lost/batch=0", ["match_id", "id"])
    landing.ingest(spark, feed, matches, folder)
    assert rows(landing.scan_landing(spark, folder, feed.schema), "id") == [("e0",), ("e1",), ("e2",)]


def test_streaming_landing_processes_each_file_once(spark, tmp_path):
    feed, matches = feed_and_matches(spark)
    inbox, folder = str(tmp_path / "inbox"), str(tmp_path / "landed")

    def run():
        land_available(spark.readStream.schema(feed.schema).parquet(inbox), matches, folder)
        return landing.scan_landing(spark, folder, feed.schema).count()

    feed.where("match_id < 2").write.mode("append").parquet(inbox)
    assert run() == 2
    assert run() == 2
    feed.where("match_id >= 2").write.mode("append").parquet(inbox)
    assert run() == 3


def test_a_late_match_is_fetched_after_the_stream(spark, tmp_path):
    feed, matches = feed_and_matches(spark)
    inbox, folder = str(tmp_path / "inbox"), str(tmp_path / "landed")
    feed.write.parquet(inbox)
    land_available(spark.readStream.schema(feed.schema).parquet(inbox), matches, folder)
    assert landing.scan_landing(spark, folder, feed.schema).count() == 3
    now_there = matches.replace({"processing": "available"}, subset=["match_status_360"])
    landing.ingest(spark, feed, now_there, folder)
    assert rows(landing.scan_landing(spark, folder, feed.schema), "match_id") == [(1,), (1,), (2,), (3,)]


def test_overlapping_runs_do_not_double_a_match(spark, tmp_path):
    feed, matches = feed_and_matches(spark)
    folder = str(tmp_path / "landing")
    listed = feed.join(matches.where("match_status_360 = 'available'").select("match_id", "season_name"), "match_id")
    for run in ("a", "b"):  # both read the manifest before either wrote it
        landing.land(listed, folder, run, 0)
    assert rows(landing.scan_landing(spark, folder, feed.schema), "id") == [("e0",), ("e1",), ("e2",)]


def test_a_repeated_batch_replaces_itself(spark, tmp_path):
    feed, matches = feed_and_matches(spark)
    folder = str(tmp_path / "landing")
    listed = feed.join(matches.select("match_id", "season_name"), "match_id").where("match_id < 3")
    for _ in range(2):
        landing.land(listed, folder, "stream", 4)
    assert landing.scan_landing(spark, folder, feed.schema).count() == 3


def test_season_layout_spreads_a_hot_match(spark, tmp_path):
    events = spark.range(40_000).select(
        F.col("id").cast("string").alias("id"),
        F.when(F.col("id") % 10 < 9, 1).otherwise(F.col("id")).alias("match_id"),
        F.lit("2022/2023").alias("season_name"),
    )
    path = str(tmp_path / "events")
    # Files this small would be merged into one.
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        write_by_season(events, path, ["match_id", "id"])
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    per_file = spark.read.parquet(path).groupBy(F.input_file_name()).count()
    sizes = [r[1] for r in per_file.collect()]
    assert sum(sizes) == 40_000 and len(sizes) > 1 and max(sizes) < 40_000 * 0.6


def test_work_folder_follows_the_session(spark):
    shared = spark.conf.get("spark.checkpoint.dir")
    assert work_folder(spark, "x").startswith(shared)


@pytest.mark.parametrize("hot", [False, True])
def test_next_target_equals_all_pairs(spark, hot):
    """The first later target, ties to the smaller id; targets at the event's own time and under null keys do not count."""
    events = [(i, None if i % 17 == 0 else (1 if hot else i % 5), f"00:{i * 7 % 40:02d}:{i * 13 % 60 // 20:02d}") for i in range(160)]
    goals = [(1000 - i, None if i % 19 == 0 else (1 if hot else i % 6), f"00:{i * 11 % 43:02d}:{i * 5 % 60 // 20:02d}") for i in range(60)]
    fields = "id long, match long, ts string"
    found = next_target(
        spark.createDataFrame(events, fields), spark.createDataFrame(goals, fields), ["match"], "ts", F.substring("ts", 1, 5), into="goal"
    )
    wanted = {}
    for i, m, ts in events:
        later = sorted((t, g) for g, gm, t in goals if m is not None and gm == m and t > ts)
        wanted[i] = (later[0][1], later[0][0]) if later else (None, None)
    assert {r.id: (r.goal.id, r.goal.ts) for r in found.collect()} == wanted
    assert found.columns == ["id", "match", "ts", "goal"]
