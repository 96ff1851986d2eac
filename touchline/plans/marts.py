"""Prepared tables: written once from the events, read by every later query.

    python -m touchline.plans.marts --events DIR --matches FILE --out DIR
"""

from __future__ import annotations

import argparse
from dataclasses import replace

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from touchline import schema as S
from touchline.functions.corner import is_goal

# Importing the plans registers their base tables.
from touchline.plans import checks, corners, delivery, dependence, ratios, spatial  # noqa: F401
from touchline.plans.corners import with_season
from touchline.plans.stored import BASE_TABLES
from touchline.session import build_session
from touchline.sources.tables import EventTables, open_tables, write_by_season, write_table

INPUTS = ["matches", "logos"]
SEASON = "temporada"
# Results kept next to the base tables; no query reads them back.
RESULTS = {
    "corner_assisted_shots": corners.corner_assisted_shots,
    "occupancy_category": corners.occupancy_category,
    "set_piece_dependence": dependence.set_piece_dependence,
    "percentile_profile": delivery.percentile_profile,
    "corner_outcomes": corners.corner_outcomes,
}


def write_marts(t: EventTables, folder: str) -> EventTables:
    """Write the base tables and the results; returns the prepared tables.

    The raw events are read for the corners, shots and goals, the few kinds that the
    tables are made of, and for the team names; each table then starts from the files of
    those before it. Tables that carry the season have a folder per season.
    """
    spark = t.events.sparkSession
    for name in INPUTS:
        write_table(getattr(t, name), f"{folder}/{name}")
    # The only table that takes all events.
    t = _write(t, "team_names", folder)
    kinds = (F.col("pass_type") == S.CORNER) | (F.col("type_name") == S.SHOT) | is_goal()
    relevant = with_season(t.events.where(kinds), t, "id")
    write_by_season(relevant.withColumnRenamed(SEASON, "season_name"), f"{folder}/events", ["match_id", "id"], "overwrite")
    t = replace(t, events=spark.read.schema(relevant.drop(SEASON).schema).parquet(f"{folder}/events"))
    for name in BASE_TABLES:
        if name not in t.stored:
            t = _write(t, name, folder)
    for name, compute in RESULTS.items():
        write_table(compute(t), f"{folder}/{name}")
    return read_marts(spark, folder)


def _write(t: EventTables, name: str, folder: str) -> EventTables:
    """Write one base table; answers from its files from then on."""
    table, path = BASE_TABLES[name](t), f"{folder}/{name}"
    by = [SEASON] if SEASON in table.columns else []
    table.write.mode("overwrite").partitionBy(*by).parquet(path)
    return replace(t, stored={**t.stored, name: t.events.sparkSession.read.schema(table.schema).parquet(path)})


def read_marts(spark: SparkSession, folder: str) -> EventTables:
    """Prepared tables, ready for every query that does not need raw events."""
    stored = {name: spark.read.parquet(f"{folder}/{name}") for name in BASE_TABLES}
    inputs = {name: spark.read.parquet(f"{folder}/{name}") for name in INPUTS}
    return EventTables(events=None, stored=stored, **inputs)


def with_events(prepared: EventTables, raw: EventTables) -> EventTables:
    """Prepared tables plus the raw events, for the queries that need both."""
    return replace(prepared, events=raw.events, frames=raw.frames)


def main() -> None:
    parser = argparse.ArgumentParser(description="Prepare the derived tables from raw event files.")
    parser.add_argument("--events", required=True, help="folder of event Parquet files")
    parser.add_argument("--matches", required=True, help="match Parquet file")
    parser.add_argument("--out", required=True, help="folder for the prepared tables")
    args = parser.parse_args()
    write_marts(open_tables(build_session("prepare"), args.events, args.matches), args.out)


if __name__ == "__main__":
    main()
