"""Session settings and the shared work folder."""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession

RECOMMENDED_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Split skewed partitions even when that costs one more shuffle later on.
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    # Recording the Python line of every column doubles the time to build a plan.
    "spark.python.sql.dataFrameDebugging.enabled": "false",
    "spark.sql.parquet.filterPushdown": "true",
}


def build_session(app_name: str = "touchline", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the plans were tuned for.

    Broadcast thresholds stay at Spark's own defaults: AQE measures a build side
    in compressed shuffle bytes, several times less than its hash table needs.
    Partition counts are left to AQE; on a cluster raise
    ``spark.sql.shuffle.partitions`` (for example to 2-3x the cores) and AQE
    coalesces what turns out to be too fine.
    """
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for key, value in {**RECOMMENDED_CONF, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def work_folder(spark: SparkSession, name: str) -> str:
    """A new sub-folder of the shared folder named by ``spark.checkpoint.dir``.

    Only a local-mode session without that setting (tests, bench) gets a folder of its
    own, next to the session's warehouse: there the driver machine is the only machine.
    """
    shared = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not shared:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
        shared = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/touchline-work"
        spark.conf.set("spark.checkpoint.dir", shared)
    return f"{shared.rstrip('/')}/{name}-{uuid.uuid4().hex}"
