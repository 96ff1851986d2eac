"""Input tables of the analytics, Parquet scans and sinks."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from touchline import schema as S
from touchline.operators.relational import any_of, cast_flags, rename_columns


@dataclass(frozen=True)
class EventTables:
    """Inputs of every query, under canonical column names.

    ``frames`` is None when ``events`` carries the nested ``freeze_frame``. A
    feed that delivers the player positions apart gives them as ``frames`` (id,
    freeze_frame), possibly several rows per event, and ``events`` then has a
    boolean ``has_frame`` instead.
    """

    events: DataFrame
    matches: DataFrame
    logos: DataFrame
    frames: DataFrame | None = None
    # Prepared tables by name (see plans.stored); empty means compute everything.
    stored: dict[str, DataFrame] = field(default_factory=dict)

    def harmonized(self, names: dict[str, str] = S.TEAM_NAMES) -> "EventTables":
        """Team names recoded in events, both match roles and logos."""
        return replace(
            self,
            events=harmonize(self.events, ["team_name"], names),
            matches=harmonize(self.matches, ["home_team_name", "away_team_name"], names),
            logos=harmonize(self.logos, ["team_name"], names),
        )


def harmonize(df: DataFrame, columns: list[str], names: dict[str, str] = S.TEAM_NAMES) -> DataFrame:
    """Recode values of the given columns; values not listed pass through."""
    return df.replace(names, subset=columns)


# --- scans -------------------------------------------------------------------
def scan_events(
    spark: SparkSession,
    path: str,
    columns: dict[str, str] = S.EVENT_COLUMNS,
    schema: T.StructType = S.EVENTS,
    partitions: str | None = None,
) -> DataFrame:
    """All Parquet files of a directory (sub-folders included), or of a glob such as ``dir/*.parquet``, as one lazy table.

    The schema is explicit: a sparse column that a file lacks reads as NULL,
    and no file is opened just to infer types. ``partitions`` (a DDL string) names the
    columns of ``name=value`` sub-folders; a filter or a join on them then opens only the folders it needs.
    """
    fields, reader = S.feed_schema(columns, schema), spark.read.option("pathGlobFilter", "*.parquet")
    if partitions is None:
        reader = reader.option("recursiveFileLookup", "true")
    else:
        fields = T.StructType([*fields.fields, *T.StructType.fromDDL(partitions).fields])
    return rename_columns(reader.schema(fields).parquet(path), columns)


def events_of_matches(events: DataFrame, matches: DataFrame) -> DataFrame:
    """Events of the given matches, from a scan by season (``scan_events`` with partitions).

    The seasons of the matches, no more than there are folders, are broadcast first and prune the scan's folders at
    run time; the matches then pick their events. An unknown season is a folder of its own.
    """
    seasons = matches.select("season_name").where(F.col("season_name").isNotNull()).distinct()
    known = events.join(F.broadcast(seasons), "season_name", "left_semi").select(*events.columns)
    unknown = events.where(F.col("season_name").isNull())
    return known.union(unknown).join(matches.select("match_id"), "match_id", "left_semi").select(*events.columns)


def conform_matches(raw: DataFrame) -> DataFrame:
    """Atomic match columns under canonical names, with typed flags."""
    return cast_flags(rename_columns(any_of(raw, S.MATCH_KEEP), S.MATCH_COLUMNS), S.MATCH_FLAGS)


def scan_matches(spark: SparkSession, path: str) -> DataFrame:
    return conform_matches(spark.read.parquet(path))


def open_tables(spark: SparkSession, events_path: str, matches_path: str) -> EventTables:
    """The feed's own files, with harmonised team names."""
    return EventTables(
        events=scan_events(spark, events_path),
        matches=scan_matches(spark, matches_path),
        logos=S.logos_table(spark),
    ).harmonized()


def catalog_entries(catalog: DataFrame, country: str, competition: str) -> DataFrame:
    """Seasons of one competition in a provider catalogue, oldest first."""
    wanted = (F.col("country_name") == country) & (F.col("competition_name") == competition)
    return (
        catalog.where(wanted)
        .select("competition_id", "season_id", "competition_name", "season_name")
        .orderBy("season_id")
    )


def write_feed(
    events: DataFrame, path: str, columns: dict[str, str] = S.EVENT_COLUMNS, season_col: str | None = None
) -> None:
    """Write events under the column names of the feed, for ``scan_events``; with ``season_col`` in a folder per season."""
    source_of = {canonical: source for source, canonical in columns.items()}
    feed = rename_columns(events, source_of)
    if season_col is None:
        write_table(feed, path)
    else:
        feed.hint("rebalance", season_col).write.mode("overwrite").partitionBy(season_col).parquet(path)


# --- sinks -------------------------------------------------------------------
def write_by_season(df: DataFrame, path: str, order: list[str], mode: str = "append") -> None:
    """Write one folder per season. Rows are range-partitioned on the season and
    ``order`` (end it with a unique column), so a season, or a single match,
    that holds most of the data still spreads over many tasks and files."""
    (
        df.repartitionByRange("season_name", *order)
        .sortWithinPartitions("season_name", *order)
        .write.mode(mode)
        .partitionBy("season_name")
        .parquet(path)
    )


def write_by_match(df: DataFrame, path: str, id_col: str, mode: str = "append") -> None:
    """Write one folder per season, each match in one file.

    Matches are dealt to files by size: AQE merges small matches up to its advisory partition size, and splits
    a match that is far larger over several files. Files are sorted by match, so row groups of others are skipped.
    """
    (
        df.hint("rebalance", "season_name", "match_id")
        .sortWithinPartitions("season_name", "match_id", id_col)
        .write.mode(mode)
        .partitionBy("season_name")
        .parquet(path)
    )


def write_table(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)
