"""Shards of near-equal bytes by sampled splitters, with DataFrame operations only.

A size-weighted sample of the keys gives quantile boundaries; the records are dealt
into those key ranges, ranges that turn out overfull are sampled again and subdivided,
and exact sums per range then place every record: a shard is a run of consecutive keys,
cut where the bytes before a record pass a multiple of total / shards.
"""

from __future__ import annotations

from bisect import bisect_left
from itertools import accumulate

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from touchline.llm.common import id_back, id_order, unit_hash, whole_text, written

#: Sampled keys per range; the driver holds SAMPLES * ranges keys of 32 characters.
SAMPLES = 40
ROUNDS = 4


def _sort_key() -> Column:
    """(id, row) as text that sorts as the pair does."""
    flipped = F.col("order").bitwiseXOR(F.lit(-(2**63)))
    return F.concat(F.lpad(F.hex(flipped), 16, "0"), F.lpad(F.hex("row"), 16, "0"))


def _range_of(key: Column, bounds: list[str]) -> Column:
    """Number of bounds at or below the key, by a search in two steps."""
    if not bounds:
        return F.lit(0)
    step = max(1, round(len(bounds) ** 0.5))
    blocks = [bounds[i : i + step] for i in range(0, len(bounds), step)]
    below = lambda values: F.size(F.filter(values, lambda b: b <= key))
    block = F.greatest(below(F.lit([b[0] for b in blocks])), F.lit(1))
    inside = F.element_at(F.array(*(F.lit(b) for b in blocks)), block)
    return ((block - 1) * step + below(inside)).cast("int")


def _sampled(rows: DataFrame, share: Column, seed: int) -> list[tuple]:
    """Keys drawn with probability ``share``."""
    drawn = rows.where(unit_hash(F.col("row"), F.col("order"), F.lit(seed)) < share)
    return drawn.select("key", "range", "size").collect()


def _quantiles(drawn: list[tuple[str, float]], parts: int) -> list[str]:
    """Boundaries that cut the drawn weight into ``parts``."""
    drawn = sorted(drawn)
    sums = list(accumulate(w for _, w in drawn))
    if not sums:
        return []
    cuts = (bisect_left(sums, sums[-1] * i / parts) for i in range(1, parts))
    return sorted({drawn[min(i, len(drawn) - 1)][0] for i in cuts})


def splitters(rows: DataFrame, ranges: int) -> tuple[list[str], list[tuple[int, int, int]]]:
    """Boundaries of the key ranges and (range, bytes, rows) of each, in order.

    ``rows`` has key, row, order, size. A range above twice its share is sampled again on its
    own and subdivided, until none is or a range is a single record.
    """
    total = rows.agg(F.sum("size")).first()[0] or 0
    bounds: list[str] = []
    over = {0: (total, ranges)}
    for turn in range(ROUNDS):
        ranged = rows.withColumn("range", _range_of(F.col("key"), bounds))
        if turn:
            stats = sorted(map(tuple, ranged.groupBy("range").agg(F.sum("size"), F.count("*")).collect()))
            fair = total / ranges
            over = {r: (b, int(-(-b // fair))) for r, b, n in stats if b > 2 * fair and n > 1}
            if not over or turn == ROUNDS - 1:
                return bounds, stats
        rate = F.element_at(
            F.create_map(*(F.lit(x) for r, (b, k) in over.items() for x in (r, SAMPLES * k / max(b, 1)))), F.col("range")
        )
        drawn = _sampled(ranged.where(F.col("range").isin(list(over))), F.col("size") * rate, turn)
        new = [
            _quantiles([(key, max(size, b / (SAMPLES * k))) for key, at, size in drawn if at == r], k)
            for r, (b, k) in over.items()
        ]
        bounds = sorted({*bounds, *(x for cuts in new for x in cuts)})
    raise AssertionError("the last round returns")


def assign_shards(
    docs: DataFrame, shards: int = 16, id_col: str = "doc_id", text_col: str = "text", ranges: int | None = None
) -> DataFrame:
    """One row per document: id, size, text_crc32, law, shard, slot, grown_shard.

    Size is the text's UTF-8 bytes plus 1 (null text: none plus 1). Records lie in id order
    (null ids first, equal ids in the table's order), a shard is a run of them, and slots count from
    0 in that order, so shards differ by at most one record from an equal cut. With fewer
    records than shards some shards stay empty; an empty table gives no rows. Other columns are not read.
    """
    spark = docs.sparkSession
    text = whole_text(text_col)
    slim = written(
        docs.select(
            id_order(id_col).alias("order"),
            F.monotonically_increasing_id().alias("row"),
            (F.octet_length(text) + 1).cast("long").alias("size"),
            F.crc32(text.cast("binary")).alias("text_crc32"),
        ),
        "shard-rows",
    )
    rows = slim.withColumn("key", _sort_key())
    ranges = ranges or max(4 * shards, 2 * int(spark.conf.get("spark.sql.shuffle.partitions")))
    bounds, stats = splitters(rows, ranges)
    starts, before_bytes, before_rows = [], 0, 0
    for at, size, n in stats:
        starts.append((at, before_bytes, before_rows))
        before_bytes, before_rows = before_bytes + size, before_rows + n
    # One row per range: bounded by the number of ranges, not by the data.
    offsets = spark.createDataFrame(starts, "range int, before_bytes long, before_rows long")
    in_range = Window.partitionBy("range").orderBy("key")
    placed = (
        rows.withColumn("range", _range_of(F.col("key"), bounds))
        .withColumns(
            {
                "to_here": F.sum("size").over(in_range.rowsBetween(Window.unboundedPreceding, 0)),
                "nth": F.row_number().over(in_range),
            }
        )
        .join(F.broadcast(offsets), "range")
        .withColumns(
            {
                "position": F.col("before_bytes") + F.col("to_here") - F.col("size"),
                "global_row": F.col("before_rows") + F.col("nth") - 1,
            }
        )
    )
    shard = F.floor(F.col("position") * shards / F.lit(max(before_bytes, 1)))
    placed = placed.withColumn("shard", F.least(shard, F.lit(shards - 1)).cast("int"))
    firsts = placed.groupBy("shard").agg(F.min("global_row").alias("first_row"))  # one row per shard
    return placed.join(F.broadcast(firsts), "shard").select(
        id_back(F.col("order")).alias(id_col),
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        (F.col("global_row") - F.col("first_row")).alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )
