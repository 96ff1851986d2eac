"""

Every query reads the whole driver tables through ``touchline.sources.driver_tables``.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from oracle import STATEMENTS
from oracle.sql import CELLS, SEASON, TEAM, TEAM_PATTERN
from touchline import schema as S
from touchline.functions.corner import coordinate
from touchline.functions.labels import percent_label, percent_text, safe_name
from touchline.operators.regions import assign_regions
from touchline.operators.relational import any_of, cast_flags, first_rows, for_season
from touchline.plans import checks, corners, delivery, dependence, occupancy, ratios, snapshots, spatial
from touchline.plans.marts import write_marts
from touchline.session import work_folder
from touchline.sources import driver_tables
from touchline.sources.ingest import ingest, ingest_files, pending_matches, read_manifest, scan_landing, scan_match
from touchline.sources.tables import EventTables, catalog_entries, events_of_matches, scan_events, write_by_season, write_feed
from touchline.streaming.landing import land_available

Query = Callable[[SparkSession, str], DataFrame]

try:
    import corpus_pipeline
    from touchline.llm import queries as llm
except ModuleNotFoundError as missing:
    if missing.name not in {"corpus_pipeline", "touchline.llm"}:
        raise
    LLM_QUERIES, LLM_SQL = {}, {}
else:
    LLM_QUERIES = {**llm.QUERIES, "pipeline": corpus_pipeline.run}
    LLM_SQL = {**llm.SQL, **({"pipeline": corpus_pipeline.ORACLE_SQL} if corpus_pipeline.ORACLE_SQL else {})}


def _linked(plan: Callable[[EventTables], DataFrame]) -> Query:
    """A query that follows shots to their corners."""
    return lambda spark, sf_dir: plan(driver_tables.open_tables(spark, sf_dir, links=True))


def _unlinked(plan: Callable[[EventTables], DataFrame]) -> Query:
    return lambda spark, sf_dir: plan(driver_tables.open_tables(spark, sf_dir, links=False))


def _xy(df: DataFrame) -> DataFrame:
    """Coordinate lists as plain columns."""
    return df.withColumns(
        {
            "end_x": coordinate(F.col("pass_end_location"), 0),
            "end_y": coordinate(F.col("pass_end_location"), 1),
            "start_x": coordinate(F.col("location"), 0),
            "start_y": coordinate(F.col("location"), 1),
        }
    ).drop("pass_end_location", "location")


def _corner_events(t: EventTables) -> DataFrame:
    return _xy(corners.corner_events(t)).select(
        "id", "match_id", "team_name", "player_name", "pass_length", "inswinging", "outswinging", "end_x", "end_y"
    )


def _shots_with_freeze_frame(t: EventTables) -> DataFrame:
    return corners.shots_with_freeze_frame(t).select(
        "id", "match_id", "team_name", "key_pass_id", "shot_outcome"
    )


def _corner_assisted_shots(t: EventTables) -> DataFrame:
    return corners.corner_assisted_shots(t).select(
        "id", "match_id", "team_name", "key_pass_id", "shot_outcome", "xg"
    )


def _shot_to_corner(t: EventTables) -> DataFrame:
    return corners.shot_to_corner(corners.corner_assisted_shots(t).select("id", "key_pass_id"), t)


def _season_filter(t: EventTables) -> DataFrame:
    seasoned = corners.with_season(corners.corner_events(t), t, "id")
    return for_season(seasoned, SEASON).select("id", "match_id", "team_name", "temporada")


def _team_regex_filter(t: EventTables) -> DataFrame:
    matching = corners.corner_events(t).where(F.col("team_name").rlike(TEAM_PATTERN))
    return matching.select("id", "match_id", "team_name")


def _events_with_season(t: EventTables) -> DataFrame:
    return corners.with_season(t.events.select("id", "match_id", "type_name", "team_name"), t, "id")


def _distinct_team_season(t: EventTables) -> DataFrame:
    pairs = corners.corner_events(t).select("match_id", "team_name").distinct()
    return corners.with_season(pairs, t).select("temporada", "team_name").distinct()


def _harmonize_names(t: EventTables) -> DataFrame:
    per_match = t.events.groupBy("match_id", "team_name").agg(F.count("*").alias("n"))
    names = ["team_name", "home_team_name", "away_team_name"]
    return per_match.join(t.matches, "match_id").groupBy(*names).agg(F.sum("n").alias("eventos"))


def _facet_counts(t: EventTables) -> DataFrame:
    counts = occupancy.level_counts(t)
    titled = occupancy.facet_titles(corners.enriched_shots(t), counts, ["categoria_atacantes"], "Remates")
    return titled.select("id", "categoria_atacantes", "n", "titulo_facet")


def _with_logo(t: EventTables) -> DataFrame:
    return dependence.dependence_scatter(t).select(
        "temporada", "team_name", "ocasiones_abp_por_90", "pct_ocasiones_abp", "logo_url"
    )


def _rate_labels(t: EventTables) -> DataFrame:
    rate = F.col("Tasa_Remate")
    return delivery.team_season_metrics(t).select(
        "temporada",
        "team_name",
        percent_label(rate).alias("etiqueta_fija"),
        percent_text(rate).alias("etiqueta_corta"),
    )


def _safe_name(t: EventTables) -> DataFrame:
    name = safe_name(F.col("temporada"), F.col("team_name"))
    return delivery.team_season_metrics(t).select("temporada", "team_name", name.alias("nombre_seguro"))


def _zone_assignment(t: EventTables) -> DataFrame:
    return spatial.zone_assignment(t).select(
        "match_id", "team_name", "tipo_cobro", "end_x", "end_y", "temporada", "zona_nombre"
    )


def _region_assignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Corner end points and the rectangles of a table that hold them."""
    t = driver_tables.open_tables(spark, sf_dir, links=False)
    points = spatial.corner_end_points(t).select("id", "team_name", "end_x", "end_y")
    return assign_regions(points, driver_tables.regions(spark, sf_dir), "id", default=S.OTHER_ZONE)


def _rounded_grid(grid: DataFrame) -> DataFrame:
    digits = {"grid_x": 9, "grid_y": 9, "densidad": 12, "nivel": 12}
    return grid.withColumns({c: F.round(c, d) for c, d in digits.items()})


def _feed_schema() -> T.StructType:
    return T.StructType.fromDDL(driver_tables.SCHEMAS["events"])


def _as_feed(raw: DataFrame) -> DataFrame:
    return raw.select("*", driver_tables.match_of_event().alias("match_id"))


def _early_matches(matches: DataFrame) -> DataFrame:
    """The match table of an earlier day, when matches of odd id were not available yet."""
    later = F.col("match_id") % 2 == 1
    return matches.withColumn("match_status_360", F.when(later, "processing").otherwise(F.col("match_status_360")))


def _landed(spark: SparkSession, folder: str) -> DataFrame:
    """The landed events, read through the manifest."""
    schema = T.StructType([*_feed_schema().fields, T.StructField("match_id", T.LongType())])
    return scan_landing(spark, folder, schema).select("event_id", "match_id", "event_type", "season_name")


def _ingest_first(spark: SparkSession, sf_dir: str) -> str:
    folder = work_folder(spark, "landing")
    feed = _as_feed(spark.read.schema(_feed_schema()).parquet(f"{sf_dir}/events.parquet"))
    ingest(spark, feed, _early_matches(driver_tables.matches(spark, sf_dir)), folder, "event_id")
    return folder


def _ingest_pending(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Matches to fetch after the first run."""
    folder = _ingest_first(spark, sf_dir)
    pending = pending_matches(driver_tables.matches(spark, sf_dir), read_manifest(spark, folder))
    return pending.select("match_id", "season_name", "match_status_360")


def _ingest_landing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of available matches after a second run has fetched the late ones."""
    folder = _ingest_first(spark, sf_dir)
    feed = _as_feed(spark.read.schema(_feed_schema()).parquet(f"{sf_dir}/events.parquet"))
    ingest(spark, feed, driver_tables.matches(spark, sf_dir), folder, "event_id")
    return _landed(spark, folder)


def _inbox(spark: SparkSession, sf_dir: str) -> tuple[str, DataFrame]:
    """A folder of feed files of which the one file with the matches of odd id cannot be read, and its events."""
    folder = work_folder(spark, "inbox")
    feed = _as_feed(spark.read.schema(_feed_schema()).parquet(f"{sf_dir}/events.parquet"))
    odd = F.pmod("match_id", F.lit(2)) == 1
    feed.where(~odd).repartition("match_id").write.parquet(f"{folder}/even")
    # Text under a name that promises Parquet.
    damaged = spark.range(1).selectExpr("'not what it seems' AS value").coalesce(1)
    damaged.write.partitionBy().text(f"{folder}/odd.parquet")
    return folder, feed.where(odd)


def _file_schema() -> T.StructType:
    return T.StructType([*_feed_schema().fields, T.StructField("match_id", T.LongType())])


def _ingest_quarantine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of available matches whose files can be read."""
    (inbox, _), folder = _inbox(spark, sf_dir), work_folder(spark, "landing")
    ingest_files(spark, inbox, _file_schema(), driver_tables.matches(spark, sf_dir), folder, "event_id")
    return _landed(spark, folder)


def _ingest_repaired(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same after the provider has delivered the other matches as well."""
    (inbox, odd), folder = _inbox(spark, sf_dir), work_folder(spark, "landing")
    matches = driver_tables.matches(spark, sf_dir)
    ingest_files(spark, inbox, _file_schema(), matches, folder, "event_id")
    odd.repartition("match_id").write.parquet(f"{inbox}/odd")
    ingest_files(spark, inbox, _file_schema(), matches, folder, "event_id")
    return _landed(spark, folder)


def _match_through_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events of the first landed match, from the file that holds it."""
    folder = _ingest_first(spark, sf_dir)
    first = read_manifest(spark, folder).agg(F.min("match_id")).first()[0]
    one = scan_match(spark, folder, first, _file_schema())
    return one.select("event_id", "match_id", "event_type", "season_name")


def _glob_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Corners from the feed files that an explicit glob names."""
    folder = work_folder(spark, "feed")
    write_feed(driver_tables.nested_events(spark, sf_dir), folder)
    found = scan_events(spark, f"{folder}/part-*.parquet")
    return found.where(F.col("pass_type") == S.CORNER).select("id", "match_id", "team_name", "pass_length")


def _season_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The feed in season folders, as a scan that knows them."""
    t, folder = driver_tables.raw_tables(spark, sf_dir, links=False), work_folder(spark, "seasons")
    feed = driver_tables.nested_events(spark, sf_dir)
    seasoned = corners.with_season(feed, t, "id").withColumnRenamed("temporada", "season_name")
    write_feed(seasoned, folder, season_col="season_name")
    return scan_events(spark, folder, partitions="season_name string")


def _season_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of one season; the other folders are not opened."""
    found = for_season(_season_feed(spark, sf_dir), SEASON, "season_name")
    return found.select("id", "match_id", "type_name", "season_name")


def _period_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of the matches of one summer; the seasons come from the match table while the query runs."""
    played = driver_tables.matches(spark, sf_dir).where("match_date BETWEEN '1995-06-01' AND '1995-08-31'")
    found = events_of_matches(_season_feed(spark, sf_dir), played)
    return found.select("id", "match_id", "type_name", "season_name")


def _streamed(spark: SparkSession, sf_dir: str, matches: DataFrame) -> str:
    folder = work_folder(spark, "landing")
    # As a pattern the path may be a folder or, which a stream's plain path may not, one file.
    feed = spark.readStream.schema(_feed_schema()).parquet(f"{sf_dir}/events.parque[t]")
    land_available(_as_feed(feed), matches, folder, "event_id")
    return folder


def _stream_landing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of available matches after the streaming ingest has caught up."""
    return _landed(spark, _streamed(spark, sf_dir, driver_tables.matches(spark, sf_dir)))


def _stream_then_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same when matches that became available after their file had passed are ingested later."""
    matches = driver_tables.matches(spark, sf_dir)
    folder = _streamed(spark, sf_dir, _early_matches(matches))
    feed = _as_feed(spark.read.schema(_feed_schema()).parquet(f"{sf_dir}/events.parquet"))
    ingest(spark, feed, matches, folder, "event_id")
    return _landed(spark, folder)


def _materialize_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Corner outcomes read back from the prepared tables."""
    folder = work_folder(spark, "marts")
    write_marts(driver_tables.open_tables(spark, sf_dir), folder)
    return spark.read.parquet(f"{folder}/corner_outcomes")


def _snapshot_refresh(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Corner outcomes of the second version of prepared tables, in which one season came in later."""
    folder, whole = work_folder(spark, "snapshots"), driver_tables.open_tables(spark, sf_dir)
    before = F.col("season_name").isNull() | (F.col("season_name") != SEASON)
    early = replace(whole, matches=whole.matches.where(before))
    late = whole.matches.where(~before).select("match_id")
    early = replace(early, events=whole.events.join(late, "match_id", "left_anti").select(*whole.events.columns))
    snapshots.refresh(early, folder)
    snapshots.refresh(whole, folder, [SEASON])
    return corners.corner_outcomes(snapshots.read_snapshot(spark, folder))


def _feed_tables(spark: SparkSession, sf_dir: str) -> EventTables:
    """Tables over feed files: dotted names, nested players, several files."""
    folder = work_folder(spark, "feed")
    write_feed(driver_tables.nested_events(spark, sf_dir), folder)
    raw = replace(driver_tables.raw_tables(spark, sf_dir), events=scan_events(spark, folder), frames=None)
    return raw.harmonized(driver_tables.TEAM_NAMES)


def _feed_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _feed_tables(spark, sf_dir).events.select(
        "id", "match_id", "team_name", "type_name", "pass_type", "key_pass_id", "xg", "shot_outcome",
        F.size("freeze_frame").alias("jugadores"),
    )


def _season_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of one season read back from season folders."""
    t = driver_tables.open_tables(spark, sf_dir, links=False)
    folder = work_folder(spark, "seasons")
    events = corners.with_season(t.events.select("id", "match_id", "type_name"), t, "id")
    write_by_season(events.withColumnRenamed("temporada", "season_name"), folder, ["match_id", "id"])
    back = spark.read.schema("id bigint, match_id bigint, type_name string, season_name string").parquet(folder)
    return for_season(back, SEASON, "season_name")


def _first_corners(t: EventTables) -> DataFrame:
    columns = corners.corner_events(t).select("id", "match_id", "ts", "team_name")
    return first_rows(columns, ["match_id", "ts", "id"], 25)


def _catalogue_seasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    seasons = catalog_entries(driver_tables.catalogue(spark, sf_dir), "1-URGENT", "F")
    return seasons.withColumn("season_id", F.col("season_id").cast("long"))


def _project_any_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return any_of(driver_tables.match_flags(spark, sf_dir), S.MATCH_KEEP)


def _cast_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cast_flags(_project_any_of(spark, sf_dir), S.MATCH_FLAGS)


def entry(spark: SparkSession) -> DataFrame:
    """Goal rate by box occupancy: nested frames, shot-corner link, null rules."""
    return queries()["goal_rate_by_occupancy"](spark, "/root/testdata/sf0.001")


def queries() -> dict[str, Query]:
    return {
        # scans, sinks, projection
        "scan_events": _linked(lambda t: _xy(t.events)),
        "materialize_roundtrip": _materialize_roundtrip,
        "snapshot_refresh": _snapshot_refresh,
        "ingest_pending_matches": _ingest_pending,
        "ingest_landing": _ingest_landing,
        "ingest_quarantine": _ingest_quarantine,
        "ingest_repaired": _ingest_repaired,
        "match_through_index": _match_through_index,
        "glob_scan": _glob_scan,
        "season_scan": _season_scan,
        "period_scan": _period_scan,
        "stream_landing": _stream_landing,
        "stream_then_ingest": _stream_then_ingest,
        "feed_scan": _feed_scan,
        "box_occupancy_nested": lambda spark, sf_dir: corners.box_occupancy(_feed_tables(spark, sf_dir)),
        "corner_outcomes_nested": lambda spark, sf_dir: corners.corner_outcomes(_feed_tables(spark, sf_dir)),
        "season_roundtrip": _season_roundtrip,
        "catalogue_seasons": _catalogue_seasons,
        "first_corners": _unlinked(_first_corners),
        "dim_zones": _unlinked(spatial.dim_zones),
        "project_any_of": _project_any_of,
        "cast_flags": _cast_flags,
        "distinct_team_season": _unlinked(_distinct_team_season),
        "selector_domain": _unlinked(checks.event_teams),
        "radar_teams": _linked(checks.radar_teams),
        "harmonize_names": _unlinked(_harmonize_names),
        # filters and joins
        "corner_events": _unlinked(_corner_events),
        "shots_with_freeze_frame": _linked(_shots_with_freeze_frame),
        "corner_assisted_shots": _linked(_corner_assisted_shots),
        "set_piece_flag": _unlinked(checks.set_piece_flags),
        "season_filter": _unlinked(_season_filter),
        "team_regex_filter": _unlinked(_team_regex_filter),
        "events_with_season": _unlinked(_events_with_season),
        "shot_to_corner": _linked(_shot_to_corner),
        "shots_with_category": _linked(lambda t: corners.shots_with_category(t).drop("match_id", "xg")),
        "with_logo": _unlinked(_with_logo),
        "teams_without_logo": _unlinked(dependence.teams_without_logo),
        # corners
        "box_occupancy": _linked(corners.box_occupancy),
        "occupancy_category": _linked(corners.occupancy_category),
        "enriched_shots": _linked(corners.enriched_shots),
        "corner_outcomes": _linked(corners.corner_outcomes),
        # occupancy
        "shots_by_occupancy": _linked(occupancy.shots_by_occupancy),
        "goal_rate_by_occupancy": _linked(occupancy.goal_rate_by_occupancy),
        "goal_rate_by_occupancy_filled": _linked(lambda t: occupancy.goal_rate_by_occupancy(t, strict=False)),
        "occupancy_comparison": _linked(occupancy.occupancy_comparison),
        "occupancy_xg_summary": _linked(occupancy.occupancy_xg_summary),
        "occupancy_by_season": _linked(occupancy.occupancy_by_season),
        "goal_rate_by_season": _linked(occupancy.goal_rate_by_season),
        "facet_counts": _linked(_facet_counts),
        "shot_tooltips": _linked(occupancy.shot_tooltips),
        "goal_tooltips": _linked(occupancy.goal_tooltips),
        "shot_tooltips_by_season": _linked(occupancy.shot_tooltips_by_season),
        "goal_tooltips_by_season": _linked(lambda t: occupancy.shot_tooltips_by_season(t, goals=True)),
        # delivery
        "delivery_summary": _linked(delivery.delivery_summary),
        "delivery_effectiveness": _linked(delivery.delivery_effectiveness),
        "tactical_profile": _linked(delivery.tactical_profile),
        "tactical_profile_batch": _linked(
            lambda t: delivery.tactical_profile(t, rescale_before_logos=True)
        ),
        "team_season_metrics": _linked(delivery.team_season_metrics),
        "team_xg_from_corners": _linked(delivery.team_xg_from_corners),
        "delivery_mix": _linked(delivery.delivery_mix),
        "percentile_profile": _linked(delivery.percentile_profile),
        "percentile_profile_as_written": _linked(
            lambda t: delivery.percentile_profile(t, xg_mode="as_written")
        ),
        "team_radars": _linked(delivery.team_radars),
        "team_radar": _linked(lambda t: delivery.team_radar(t, SEASON, TEAM)),
        "rate_labels": _linked(_rate_labels),
        "safe_name": _linked(_safe_name),
        # spatial
        "delivery_points": _unlinked(spatial.delivery_points),
        "delivery_heatmap": _unlinked(lambda t: _rounded_grid(spatial.delivery_heatmap(t, cells=CELLS))),
        "delivery_heatmap_by_season": _unlinked(
            lambda t: _rounded_grid(spatial.delivery_heatmap(t, by_season=True, cells=CELLS))
        ),
        "zone_assignment": _unlinked(_zone_assignment),
        "region_assignment": _region_assignment,
        "zone_map": _unlinked(lambda t: spatial.zone_map(t, TEAM)),
        "zone_map_of_no_team": _unlinked(lambda t: spatial.zone_map(t, "No such team")),
        "zone_counts": _unlinked(spatial.zone_counts),
        # ratios
        "corners_per_goal": _linked(ratios.corners_per_goal),
        "corners_per_goal_one_season": _linked(lambda t: ratios.corners_per_goal(t, SEASON)),
        "corners_per_goal_by_season": _linked(ratios.corners_per_goal_by_season),
        "corners_per_goal_ranked": _linked(lambda t: ratios.ranked_ratios(ratios.corners_per_goal(t))),
        "corners_per_sequence_goal_ranked": _unlinked(
            lambda t: ratios.ranked_ratios(ratios.corners_per_sequence_goal(t))
        ),
        "goal_sequences": _unlinked(ratios.goal_sequences),
        "sequence_goals": _unlinked(ratios.sequence_goals),
        "corners_per_sequence_goal": _unlinked(ratios.corners_per_sequence_goal),
        "corners_per_sequence_goal_one_season": _unlinked(lambda t: ratios.corners_per_sequence_goal(t, SEASON)),
        "corners_per_sequence_goal_by_season": _unlinked(ratios.corners_per_sequence_goal_by_season),
        "corners_per_sequence_goal_agg": _unlinked(ratios.corners_per_sequence_goal_agg),
        # dependence
        "minutes_per_team": _unlinked(dependence.minutes_per_team),
        "minutes_per_team_with_events": _unlinked(
            lambda t: dependence.minutes_per_team(t, only_with_events=True)
        ),
        "set_piece_dependence": _unlinked(dependence.set_piece_dependence),
        "dependence_all_seasons": _unlinked(dependence.dependence_all_seasons),
        # checks
        "one_team_summary": _linked(lambda t: checks.one_team_summary(t, SEASON, TEAM_PATTERN)),
        "corner_goals_check": _unlinked(lambda t: checks.corner_goals_check(t, SEASON, TEAM_PATTERN)),
        **LLM_QUERIES,
    }


def oracle_sql() -> dict[str, str]:
    return {**STATEMENTS, **LLM_SQL}
