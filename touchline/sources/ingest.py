"""Incremental, idempotent landing of the events of newly available matches.

A landing folder holds ``events/run=<id>/batch=<n>/season_name=<s>/`` and
``manifest/run=<id>/batch=<n>/`` (match_id, file, rows). A match counts as landed once the manifest
names it, and only what the manifest names is read back, so a run that dies half-way leaves
nothing visible and its matches are simply taken again by the next run. If runs that overlap
land a match twice, readers take it from the run of the smallest id. The manifest is also the index
by which one match is read without opening the files of others (``scan_match``).

Files that cannot be read do not stop the others: see ``ingest_files``.
"""

from __future__ import annotations

import uuid
from functools import reduce
from urllib.parse import unquote

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from touchline import schema as S
from touchline.operators.skew import salted_join
from touchline.sources.tables import write_by_match

_MANIFEST = "match_id bigint, file string, rows bigint, run string, batch bigint"
_FILES = "file string, length bigint, modified timestamp, status string, reason string, rows bigint, run string"
#: Status of a file of the inbox. All but LANDED are read again by the next run.
LANDED, WAITING, EMPTY, REJECTED = "landed", "waiting", "empty", "rejected"
SOURCE = "__source_file"


def pending_matches(matches: DataFrame, landed: DataFrame | None) -> DataFrame:
    """Matches whose positions are available and that have not landed yet; an
    unknown status is not available."""
    available = matches.where(F.col("match_status_360") == S.AVAILABLE)
    if landed is None:
        return available
    return available.join(landed.select("match_id").distinct(), "match_id", "left_anti")


def _read(spark: SparkSession, schema: str, folder: str) -> DataFrame | None:
    try:
        return spark.read.schema(schema).parquet(folder)
    except AnalysisException as missing:
        if missing.getCondition() == "PATH_NOT_FOUND":
            return None
        raise


def read_manifest(spark: SparkSession, landing: str) -> DataFrame | None:
    """(match_id, file, rows, run, batch) of everything landed; None before the first run."""
    return _read(spark, _MANIFEST, f"{landing}/manifest")


def _decoded(path: Column) -> Column:
    """A path as it is written in the file system; Spark's metadata column gives it as a URI."""
    return F.url_decode(F.replace(path, F.lit("+"), F.lit("%2B")))


def _landed_rows(spark: SparkSession, folder: str, *columns: str) -> DataFrame:
    """(match_id, file, ..., rows) of one written batch; file is the path below the batch."""
    fields = ", ".join(["match_id bigint", *(f"{c} string" for c in columns)])
    below = F.regexp_extract(_decoded(F.col("_metadata.file_path")), "([^/]+/[^/]+)$", 1)
    read = spark.read.schema(fields).parquet(folder).select("match_id", *columns, below.alias("file"))
    return read.groupBy("match_id", "file", *columns).agg(F.count("*").alias("rows"))


def land(events: DataFrame, landing: str, run: str, batch: int, id_col: str = "id") -> None:
    """Write one batch of a run (match_id, season_name, ...), then name its matches and
    their files in the manifest. Repeating a batch replaces it."""
    part = f"run={run}/batch={batch}"
    write_by_match(events, f"{landing}/events/{part}", id_col, "overwrite")
    landed = _landed_rows(events.sparkSession, f"{landing}/events/{part}")
    landed.write.mode("overwrite").parquet(f"{landing}/manifest/{part}")


def ingest(spark: SparkSession, feed: DataFrame, matches: DataFrame, landing: str, id_col: str = "id") -> str:
    """Append the feed's events of all pending matches; returns the run id.

    A match the feed cannot deliver yet contributes no rows, does not stop the
    others and stays pending.
    """
    run = uuid.uuid4().hex
    pending = pending_matches(matches, read_manifest(spark, landing))
    wanted = pending.select("match_id", "season_name")
    land(salted_join(feed, wanted, ["match_id"], "inner", id_col), landing, run, 0, id_col)
    return run


# --- files that may be unreadable ---------------------------------------------
def file_log(spark: SparkSession, landing: str) -> DataFrame | None:
    """What became of the inbox files: a row per file, size, time and run; None before the first run."""
    return _read(spark, _FILES, f"{landing}/files")


def rejected_files(spark: SparkSession, landing: str) -> DataFrame:
    """Files that could not be read whole and have not been landed since: file, length, reason."""
    log = file_log(spark, landing)
    if log is None:
        return spark.createDataFrame([], "file string, length bigint, reason string")
    good = log.where(F.col("status") != REJECTED).select("file", "length", "modified")
    bad = log.where(F.col("status") == REJECTED).join(good, ["file", "length", "modified"], "left_anti")
    replaced = log.where(F.col("status") != REJECTED).groupBy("file").agg(F.max("modified").alias("later"))
    still = bad.join(replaced, "file", "left").where(F.col("later").isNull() | (F.col("later") < F.col("modified")))
    return still.select("file", "length", "reason").distinct()


def _inbox(spark: SparkSession, folder: str) -> DataFrame:
    """(file, length, modified) of the Parquet files; their contents are not read. A file of
    no bytes, which scans leave out, is listed as of the oldest time."""
    reader = spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").option("recursiveFileLookup", "true")
    files = reader.load(folder)
    found = files.select(F.col("path").alias("file"), "length", F.col("modificationTime").alias("modified"))
    every = spark.createDataFrame([(unquote(uri),) for uri in files.inputFiles()], "file string")
    # Both ways to write a local path, file:/a and file:///a, are one.
    every = every.withColumn("file", F.regexp_replace("file", "^file:/+", "file:/"))
    no_bytes = every.join(found, "file", "left_anti")
    return found.union(no_bytes.select("file", F.lit(0).cast("long"), F.timestamp_seconds(F.lit(0))))


def _without_rows(spark: SparkSession, files: list[str]) -> DataFrame:
    """(file, status, reason) of files that gave no row: EMPTY, or REJECTED if they do not end as Parquet files do."""
    if not files:
        return spark.createDataFrame([], "file string, status string, reason string")
    content = spark.read.format("binaryFile").load(files).select(F.col("path").alias("file"), F.substring("content", -4, 4).alias("end"))
    found = spark.createDataFrame([(f,) for f in files], "file string").join(content, "file", "left")
    whole = F.coalesce(F.col("end") == F.lit(b"PAR1"), F.lit(False))
    return found.select(
        "file",
        F.when(whole, EMPTY).otherwise(REJECTED).alias("status"),
        F.when(whole, "no rows").otherwise("no Parquet footer").alias("reason"),
    )


def ingest_files(
    spark: SparkSession,
    inbox: str,
    schema: T.StructType,
    matches: DataFrame,
    landing: str,
    id_col: str = "id",
    match: Column | None = None,
) -> str:
    """Append the events of all pending matches from the files of a folder; returns the run id.

    A file that cannot be read, or not to its end, is set aside: its matches stay pending (a match that lies in several files
    needs all of them), ``rejected_files`` lists it, and the next run tries it again. The others land.
    Damage shows in counts: the rows a file announces in its footer, those whose match could be read and those that were
    written must agree. Files that landed whole are not opened again unless they change; files of matches that are not
    available yet wait. ``match`` computes match_id where the feed has none.
    """
    run, log = uuid.uuid4().hex, file_log(spark, landing)
    wanted = _inbox(spark, inbox)
    if log is not None:
        done = log.where(F.col("status") == LANDED).select("file", "length", "modified")
        wanted = wanted.join(done, ["file", "length", "modified"], "left_anti")
    # Spark's own listing of a scan holds the same paths on the driver.
    files = wanted.collect()
    if not files:
        return run
    paths = [r["file"] for r in files]
    feed = spark.read.schema(schema).option("ignoreCorruptFiles", "true").parquet(*paths)
    feed = feed.select("*", _decoded(F.col("_metadata.file_path")).alias(SOURCE))
    if match is not None:
        feed = feed.withColumn("match_id", match)
    path, part = f"{landing}/checks/run={run}", f"run={run}/batch=0"
    # Counted from the footers, without a look at any column.
    feed.groupBy(F.col(SOURCE).alias("file")).agg(F.count("*").alias("announced")).write.parquet(f"{path}/footers")
    footers = spark.read.schema("file string, announced bigint").parquet(f"{path}/footers")
    feed.groupBy(F.col(SOURCE).alias("file"), "match_id").agg(F.count("*").alias("seen")).write.parquet(f"{path}/seen")
    seen = spark.read.schema("file string, match_id bigint, seen bigint").parquet(f"{path}/seen")
    pending = pending_matches(matches, read_manifest(spark, landing)).select("match_id", "season_name")
    write_by_match(salted_join(feed, pending, ["match_id"], "inner", id_col), f"{landing}/events/{part}", id_col, "overwrite")
    written = _landed_rows(spark, f"{landing}/events/{part}", SOURCE)
    of_file = written.groupBy("match_id", F.col(SOURCE).alias("file")).agg(F.sum("rows").alias("rows"))
    # Per file and match; a match that was not pending has nothing to compare.
    compared = seen.join(pending.select("match_id", F.lit(True).alias("taken")), "match_id", "left").join(of_file, ["match_id", "file"], "left")
    short = F.col("taken") & (F.coalesce("rows", F.lit(0)) != F.col("seen"))
    known = read_manifest(spark, landing)
    landed_before = spark.createDataFrame([], "match_id bigint") if known is None else known.select("match_id").distinct()
    compared = compared.join(landed_before.withColumn("before", F.lit(True)), "match_id", "left")
    per_file = compared.groupBy("file").agg(
        F.sum("seen").alias("rows"),
        F.count_if(short).alias("short"),
        F.count_if(F.col("taken").isNull() & F.col("before").isNull()).alias("unavailable"),
    )
    damaged = F.col("rows").isNull() | (F.col("rows") != F.col("announced")) | (F.col("short") > 0)
    status = F.when(damaged, REJECTED).when(F.col("unavailable") > 0, WAITING).otherwise(LANDED)
    reason = F.when(damaged, "rows cannot be read")
    checked = footers.join(per_file, "file", "left").select("file", status.alias("status"), reason.alias("reason"), "rows")
    checked.write.parquet(f"{path}/checked")
    checked = spark.read.schema("file string, status string, reason string, rows bigint").parquet(f"{path}/checked")
    listed = spark.createDataFrame(files, "file string, length bigint, modified timestamp")
    silent = [r["file"] for r in listed.join(checked, "file", "left_anti").select("file").collect()]
    others = _without_rows(spark, silent).withColumn("rows", F.lit(0).cast("long"))
    bad = checked.where(F.col("status") == REJECTED).select("file")
    spoilt = seen.join(bad, "file", "left_semi").select("match_id").distinct()
    index = written.groupBy("match_id", "file").agg(F.sum("rows").alias("rows")).join(spoilt, "match_id", "left_anti")
    # Visible from here on; a run that is lost before the log only reads its files once more.
    index.write.mode("overwrite").parquet(f"{landing}/manifest/{part}")
    log_rows = listed.join(checked.unionByName(others), "file").withColumn("run", F.lit(run))
    log_rows.write.mode("append").parquet(f"{landing}/files")
    return run


# --- reading back --------------------------------------------------------------
def scan_match(spark: SparkSession, landing: str, match_id: int, schema: T.StructType = S.EVENTS) -> DataFrame:
    """The landed events of one match (``schema`` plus ``season_name``); opens the files that hold it and no other."""
    fields = T.StructType([*schema.fields, T.StructField("season_name", T.StringType())])
    manifest = read_manifest(spark, landing)
    found = [] if manifest is None else manifest.where(F.col("match_id") == match_id).collect()
    if not found:
        return spark.createDataFrame([], fields)
    owner = min(r["run"] for r in found)  # as in ``scan_landing``
    batches = {f"{landing}/events/run={r['run']}/batch={r['batch']}" for r in found if r["run"] == owner}
    files = [f"{landing}/events/run={r['run']}/batch={r['batch']}/{r['file']}" for r in found if r["run"] == owner]
    if len(batches) > 1:  # a stream's match whose files came in several batches
        tables = [
            spark.read.schema(fields).option("basePath", b).parquet(*(f for f in files if f.startswith(f"{b}/"))) for b in sorted(batches)
        ]
        return reduce(DataFrame.union, tables).where(F.col("match_id") == match_id)
    return spark.read.schema(fields).option("basePath", batches.pop()).parquet(*files).where(F.col("match_id") == match_id)


def scan_landing(spark: SparkSession, landing: str, schema: T.StructType = S.EVENTS) -> DataFrame:
    """All landed events (``schema`` plus ``season_name``); a season filter prunes folders."""
    folders = [
        T.StructField("run", T.StringType()),
        T.StructField("batch", T.LongType()),
        T.StructField("season_name", T.StringType()),
    ]
    events = spark.read.schema(T.StructType([*schema.fields, *folders])).parquet(f"{landing}/events")
    manifest = spark.read.schema(_MANIFEST).parquet(f"{landing}/manifest")
    owner = manifest.groupBy("match_id").agg(F.min("run").alias("run"))
    # A match may have several files in a batch; the semi joins see it once.
    visible = manifest.join(owner, ["match_id", "run"], "left_semi")
    return events.join(visible, ["run", "batch", "match_id"], "left_semi").drop("run", "batch")
