"""Land the events of available matches from files as they arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from touchline.sources.ingest import land, pending_matches, read_manifest

#: The run of all the batches of a landing's stream; sorts after the ids of single ingests.
STREAM_RUN = "stream"


def land_available(feed: DataFrame, matches: DataFrame, landing: str, id_col: str = "id") -> None:
    """Process every event file not seen yet, then stop.

    Batches go into the same layout and manifest as ``sources.ingest``. The checkpoint
    remembers the files, and a batch that is repeated after a loss replaces itself, so nothing is
    added twice. Matches that another run has landed are left alone. Run ``sources.ingest``
    for matches whose status changes after their file has passed.
    """

    def land_batch(events: DataFrame, batch: int) -> None:
        manifest = read_manifest(events.sparkSession, landing)
        others = manifest and manifest.where(F.col("run") != STREAM_RUN)
        wanted = pending_matches(matches, others).select("match_id", "season_name")
        land(events.join(wanted, "match_id", "inner"), landing, STREAM_RUN, batch, id_col)

    query = (
        feed.writeStream.foreachBatch(land_batch)
        .option("checkpointLocation", f"{landing}/checkpoint")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
