"""The adapter over the driver tables drops nothing and sees the files that are there."""

import shutil
from pathlib import Path

from pyspark.sql import functions as F

import __spark_entry__ as registry
from touchline.plans import corners
from touchline.sources import driver_tables


def test_every_row_is_bound(spark, sf_dir):
    t = driver_tables.open_tables(spark, sf_dir)
    for view, table in (("matches", "orders"), ("events", "events"), ("logos", "nation"), ("frames", "lineitem")):
        assert getattr(t, view).count() == spark.read.parquet(f"{sf_dir}/{table}.parquet").count()
    assert t.logos.where("logo_url IS NULL").count() > 0
    assert t.events.join(t.matches, "match_id", "left_anti").count() > 0


def _copied(sf_dir, tmp_path) -> Path:
    """The events as a folder of part files, the other tables as they are."""
    for table in ("orders", "lineitem", "nation"):
        (tmp_path / f"{table}.parquet").symlink_to(f"{sf_dir}/{table}.parquet")
    (tmp_path / "events.parquet").mkdir()
    shutil.copy(f"{sf_dir}/events.parquet", tmp_path / "events.parquet" / "part-0.parquet")
    return tmp_path


def test_appended_files_are_seen(spark, sf_dir, tmp_path):
    folder = _copied(sf_dir, tmp_path)
    count = lambda: corners.corner_events(driver_tables.open_tables(spark, str(folder), links=False)).count()
    before = count()
    shutil.copy(f"{sf_dir}/events.parquet", folder / "events.parquet" / "part-1.parquet")
    assert count() == 2 * before > 0


def test_landings_read_a_folder_of_parts(spark, sf_dir, tmp_path):
    folder = _copied(sf_dir, tmp_path)
    whole = registry.queries()["stream_landing"](spark, sf_dir).count()
    assert registry.queries()["stream_landing"](spark, str(folder)).count() == whole > 0
    assert registry.queries()["stream_then_ingest"](spark, str(folder)).count() == whole
    assert registry.queries()["ingest_landing"](spark, str(folder)).agg(F.count("*")).first()[0] == whole
