"""Prepared tables in versions: readers see a whole version, and a refresh rewrites only the seasons that changed.

A folder holds ``data/<run>/<table>/`` (a folder per season) and ``commits/`` (version, season, run). All prepared tables
fall apart by the season of their matches, so a version is a list of seasons, each served by the run that last
computed it. The list is one small file, written last: a run that dies before leaves the version before as it was, and
its files are seen by nobody. Nothing is overwritten, so a reader of an older version is not disturbed.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterable
from dataclasses import replace
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from touchline.plans.corners import with_season
from touchline.plans.marts import INPUTS, SEASON
from touchline.plans.stored import BASE_TABLES
from touchline.sources.tables import EventTables, write_table

_COMMITS = "version bigint, season string, run string"
_PART = "__season"


def commits(spark: SparkSession, folder: str) -> DataFrame | None:
    """(version, season, run); None before the first version."""
    try:
        return spark.read.schema(_COMMITS).parquet(f"{folder}/commits")
    except AnalysisException as missing:
        if missing.getCondition() == "PATH_NOT_FOUND":
            return None
        raise


def _owners(spark: SparkSession, folder: str, version: int | None = None) -> tuple[int, dict[str | None, str]]:
    """A version (the last one) and the run of each of its seasons; (0, {}) before the first."""
    listed = commits(spark, folder)
    if listed is None:
        return 0, {}
    if version is None:
        version = listed.agg(F.max("version")).first()[0]
    # One row per season. Of two runs that took the same number at once, one counts for every reader.
    owners = listed.where(F.col("version") == version).groupBy("season").agg(F.min("run").alias("run"))
    return version, {r["season"]: r["run"] for r in owners.collect()}


def _is_one_of(column: Column, seasons: Iterable[str | None]) -> Column:
    known = [s for s in seasons if s is not None]
    unknown = column.isNull() if None in seasons else F.lit(False)
    return unknown | F.coalesce(column.isin(known), F.lit(False))


def _of_seasons(t: EventTables, seasons: Iterable[str | None]) -> EventTables:
    """The tables cut down to some seasons; events of unlisted matches are of unknown season."""
    events = with_season(t.events, t, "id").where(_is_one_of(F.col(SEASON), seasons)).drop(SEASON)
    matches = t.matches.where(_is_one_of(F.col("season_name"), seasons))
    return replace(t, events=events.select(*t.events.columns), matches=matches)


def _seasoned(t: EventTables, name: str) -> DataFrame:
    """A base table with its season as _PART."""
    table = BASE_TABLES[name](t)
    if SEASON in table.columns:
        return table.withColumn(_PART, F.col(SEASON))
    if "match_id" in table.columns:
        spread = "id" if "id" in table.columns else None
        return with_season(table, t, spread).withColumnRenamed(SEASON, _PART)
    # Without a match: the distinct rows per season, of which a reader takes the distinct ones.
    per_match = t.events.select("match_id", *table.columns).distinct()
    return with_season(per_match, t).select(*table.columns, F.col(SEASON).alias(_PART)).distinct()


def refresh(t: EventTables, folder: str, seasons: Iterable[str | None] | None = None) -> int:
    """Write a new version in which the given seasons (None among them: the unknown season) are computed anew; returns its number.

    Without ``seasons``, or with no version there yet, all are. The other seasons are taken over without being read. A match that
    changes its season changes both of them.
    """
    spark, run = t.events.sparkSession, uuid.uuid4().hex
    version, owners = _owners(spark, folder)
    everything = [r["season_name"] for r in t.matches.select("season_name").distinct().collect()] + [None]
    wanted = set(everything if seasons is None or not version else seasons)
    for name in INPUTS:
        write_table(getattr(t, name), f"{folder}/data/{run}/{name}")
    part = t if wanted >= set(everything) else _of_seasons(t, wanted)
    part = replace(part, stored={})
    for name in BASE_TABLES:
        table = _seasoned(part, name)
        path = f"{folder}/data/{run}/{name}"
        # By size of the seasons: small ones are one file, a large one is many.
        table.hint("rebalance", _PART).write.partitionBy(_PART).parquet(path)
        part = replace(part, stored={**part.stored, name: _stored(spark, path, table.schema, wanted).drop(_PART)})
    kept = {s: r for s, r in owners.items() if s not in wanted} if version else {}
    rows = [(version + 1, season, owner) for season, owner in {**kept, **dict.fromkeys(wanted, run)}.items()]
    # One task, hence one file: it is there whole or not at all.
    spark.createDataFrame(rows, _COMMITS).coalesce(1).write.mode("append").parquet(f"{folder}/commits")
    return version + 1


def _stored(spark: SparkSession, path: str, schema: T.StructType, seasons: Iterable[str | None]) -> DataFrame:
    return spark.read.schema(schema).parquet(path).where(_is_one_of(F.col(_PART), seasons))


def read_snapshot(spark: SparkSession, folder: str, version: int | None = None) -> EventTables:
    """The prepared tables of a version (the last one), for every query that needs no raw events."""
    version, owners = _owners(spark, folder, version)
    if not owners:
        raise ValueError(f"no version {version} in {folder}")
    runs: dict[str, set[str | None]] = {}
    for season, run in owners.items():
        runs.setdefault(run, set()).add(season)
    newest = max(runs, key=lambda run: (_first_version(spark, folder, run), run))
    stored = {}
    for name in BASE_TABLES:
        parts = []
        for run, seasons in sorted(runs.items()):
            path = f"{folder}/data/{run}/{name}"
            fields = [f for f in spark.read.parquet(path).schema if f.name != _PART]
            parts.append(_stored(spark, path, T.StructType([*fields, T.StructField(_PART, T.StringType())]), seasons))
        table = reduce(DataFrame.unionByName, parts).drop(_PART)
        stored[name] = table if {"match_id", SEASON} & set(table.columns) else table.distinct()
    inputs = {name: spark.read.parquet(f"{folder}/data/{newest}/{name}") for name in INPUTS}
    return EventTables(events=None, stored=stored, **inputs)


def _first_version(spark: SparkSession, folder: str, run: str) -> int:
    return commits(spark, folder).where(F.col("run") == run).agg(F.min("version")).first()[0]
