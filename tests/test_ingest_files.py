"""Unreadable files are set aside, matches are read through the index."""

import os
import shutil

import pytest
from pyspark.sql import functions as F

from touchline.sources import ingest as landing
from tests.football import MATCH_DDL, match, rows

FIELDS = "id string, match_id bigint, note string"


def put(spark, inbox, name, events):
    """One file with the given (id, match_id) rows; its checksum file goes, as in a store that has none."""
    scratch = f"{inbox}-scratch-{name}"
    table = spark.createDataFrame([(i, m, f"note of {i}" * 50) for i, m in events], FIELDS).coalesce(1)
    table.write.mode("overwrite").option("compression", "none").parquet(scratch)
    part = next(f for f in os.listdir(scratch) if f.startswith("part-"))
    os.makedirs(inbox, exist_ok=True)
    shutil.copy(f"{scratch}/{part}", f"{inbox}/{name}.parquet")


@pytest.fixture
def setting(spark, tmp_path):
    inbox, folder = str(tmp_path / "in box+%"), str(tmp_path / "landing")
    for m in range(1, 6):
        put(spark, inbox, f"match {m}", [(f"e{m}-{i}", m) for i in range(40)])
    matches = spark.createDataFrame([match(i, season="2022/2023" if i % 2 else None) for i in range(1, 5)] + [match(5, status="processing")], MATCH_DDL)
    schema = spark.createDataFrame([], FIELDS).schema
    return inbox, folder, matches, schema


def landed(spark, folder, schema):
    found = landing.scan_landing(spark, folder, schema).groupBy("match_id").count()
    return {r["match_id"]: r["count"] for r in found.collect()}


def log(spark, folder):
    return sorted((os.path.basename(r["file"]), r["status"]) for r in landing.file_log(spark, folder).collect())


def test_all_readable(spark, setting):
    inbox, folder, matches, schema = setting
    landing.ingest_files(spark, inbox, schema, matches, folder)
    assert landed(spark, folder, schema) == {1: 40, 2: 40, 3: 40, 4: 40}
    assert log(spark, folder) == [(f"match {m}.parquet", "landed" if m < 5 else "waiting") for m in range(1, 6)]
    assert landing.rejected_files(spark, folder).count() == 0
    landing.ingest_files(spark, inbox, schema, matches, folder)  # only the waiting file is read again
    assert landed(spark, folder, schema) == {1: 40, 2: 40, 3: 40, 4: 40}
    assert landing.file_log(spark, folder).count() == 6
    now = matches.withColumn("match_status_360", F.lit("available"))
    landing.ingest_files(spark, inbox, schema, now, folder)
    assert landed(spark, folder, schema) == {m: 40 for m in range(1, 6)}


def damage(path, how):
    content = open(path, "rb").read()
    if how == "cut":
        content = content[: len(content) // 2]
    elif how == "garbage":
        content = b"no such thing as a file"
    elif how == "nothing":
        content = b""
    elif how == "pages":  # the footer is whole, a page of the last column is not
        at = content.index(b"note of e2-7")
        content = content[: at - 800] + b"\xff" * 700 + content[at - 100 :]
    open(path, "wb").write(content)


@pytest.mark.parametrize("how", ["cut", "garbage", "nothing", "pages"])
def test_damaged_file_is_set_aside_and_landed_when_repaired(spark, setting, how):
    inbox, folder, matches, schema = setting
    damage(f"{inbox}/match 2.parquet", how)
    landing.ingest_files(spark, inbox, schema, matches, folder)
    assert landed(spark, folder, schema) == {1: 40, 3: 40, 4: 40}
    bad = landing.rejected_files(spark, folder).collect()
    assert [os.path.basename(r["file"]) for r in bad] == ["match 2.parquet"] and bad[0]["reason"]
    assert landing.scan_match(spark, folder, 2, schema).count() == 0
    put(spark, inbox, "match 2", [(f"e2-{i}", 2) for i in range(40)])
    landing.ingest_files(spark, inbox, schema, matches, folder)
    assert landed(spark, folder, schema) == {1: 40, 2: 40, 3: 40, 4: 40}
    assert landing.rejected_files(spark, folder).count() == 0


def test_match_over_two_files_needs_both(spark, setting):
    inbox, folder, matches, schema = setting
    put(spark, inbox, "match 3 more", [(f"more{i}", 3) for i in range(10)] + [("other", 4)])
    damage(f"{inbox}/match 3.parquet", "cut")
    landing.ingest_files(spark, inbox, schema, matches, folder)
    # The good half of match 3 waits as well: nothing of it can be told from the damaged file.
    assert landed(spark, folder, schema).get(4) == 41


def test_files_without_rows(spark, setting):
    inbox, folder, matches, schema = setting
    put(spark, inbox, "empty", [])
    landing.ingest_files(spark, inbox, schema, matches, folder)
    assert ("empty.parquet", "empty") in log(spark, folder)
    assert landing.rejected_files(spark, folder).count() == 0


def test_one_match_opens_its_file_only(spark, tmp_path):
    folder = str(tmp_path / "landing")
    feed = spark.range(400).selectExpr("concat('e', id) id", "id % 40 match_id", "'x' note")
    matches = spark.createDataFrame([match(i, season=None if i == 7 else f"20{i % 3}/2{i % 3}") for i in range(40)], MATCH_DDL)
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "1k")  # several files
    try:
        landing.ingest(spark, feed, matches, folder)
    finally:
        spark.conf.unset("spark.sql.adaptive.advisoryPartitionSizeInBytes")
    whole = landing.scan_landing(spark, folder, feed.schema)
    assert len(whole.inputFiles()) > 4
    for m in (3, 7, 20):
        one = landing.scan_match(spark, folder, m, feed.schema)
        assert len(one.inputFiles()) == 1
        assert rows(one, "id", "season_name") == rows(whole.where(F.col("match_id") == m), "id", "season_name")
        assert one.count() == 10
    assert landing.scan_match(spark, folder, 99, feed.schema).count() == 0


def test_huge_match_is_split_and_read_whole(spark, tmp_path):
    folder = str(tmp_path / "landing")
    feed = spark.range(60_000).selectExpr("concat('e', id) id", "if(id % 3 = 0, 7, id % 40) match_id", "repeat(md5(string(id)), 3) note")
    changed = {
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "200k",
        "spark.sql.adaptive.rebalancePartitionsSmallPartitionFactor": "0.1",
    }
    for k, v in changed.items():
        spark.conf.set(k, v)
    try:
        landing.land(feed.withColumn("season_name", F.lit("2022/2023")), folder, "run", 0)
    finally:
        for k in changed:
            spark.conf.unset(k)
    one = landing.scan_match(spark, folder, 7, feed.schema)
    assert len(one.inputFiles()) > 1
    assert one.count() == feed.where("match_id = 7").count() and one.select("id").distinct().count() == one.count()
