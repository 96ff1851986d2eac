"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

Every document draws an exponential key scaled by its quality weight (-ln(u) / w; small keys
first). A source's target is met by complete epochs over all its documents and, for the fraction that is
left, by its documents in key order until their sizes, prefix-summed, reach the budget. The prefix sums run over
slices of the keys: sums per slice first, rows only inside the slice where a budget ends.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from touchline.llm.common import free_name, id_back, id_order, rows_kept, written

#: Weights of the sources in code-point order, repeating; the share of all words that is mixed; the most
#: often a document is taken.
PATTERN = (5.0, 2.0, 1.0)
SHARE = 1.5
MOST = 2.0
#: Quality weights lie between this and 1.
LEAST_WEIGHT = 0.2
SEED = "mix-1"

SOURCE = ("no_source", "source")


def word_count(text: Column) -> Column:
    """Number of runs of characters other than blanks and the control characters 9 to 13."""
    return F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def uniform(id_: Column, seed: str = SEED) -> Column:
    """A number in (0, 1) from the first 52 bits of an MD5 over the seed and the id."""
    digits = F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(id_.cast("string"), F.lit("null"))).cast("binary")), 1, 13)
    return (F.conv(digits, 16, 10).cast("double") + 0.5) / float(2**52)


def source_targets(sizes: DataFrame, pattern: tuple = PATTERN, share: float = SHARE, most: float = MOST) -> DataFrame:
    """(no_source, source, source_size, target) of (no_source, source, source_size): one row per source.

    Targets are proportional to the weights, at most ``most`` times the source's size; what
    is above goes to the others by weight. With the sources in order of size per weight, all before
    one are at their limit or none is, so running sums give the common level in one pass.
    """
    ranked = Window.orderBy(*SOURCE)  # one row per source
    weight = F.element_at(F.array(*map(F.lit, pattern)), F.pmod(F.row_number().over(ranked) - 1, F.lit(len(pattern))) + 1)
    rows = sizes.withColumn("weight", weight).withColumn("limit", F.col("source_size") * F.lit(most))
    rows = rows.withColumn("ratio", F.col("limit") / F.col("weight"))
    by_ratio = Window.orderBy("ratio", *SOURCE)
    before = F.coalesce(F.sum("limit").over(by_ratio.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    onward = F.sum("weight").over(by_ratio.rowsBetween(0, Window.unboundedFollowing))
    whole = Window.partitionBy()
    total = F.sum("source_size").over(whole) * F.lit(share)
    rows = rows.withColumn("level", (total - before) / onward).withColumn("turn", F.row_number().over(by_ratio))
    first = F.min(F.when(F.col("level") <= F.col("ratio"), F.struct("turn", "level"))).over(whole)
    rows = rows.withColumn("found", first["level"])
    target = F.when(F.col("found").isNull(), F.col("limit")).otherwise(F.least("limit", F.col("weight") * F.col("found")))
    return rows.select(*SOURCE, "source_size", target.alias("target"))


def _draws(docs: DataFrame, weights: DataFrame | None, id_col: str, text_col: str, source_col: str, seed: str) -> DataFrame:
    """(row, order, no_source, source, size, key, position): position orders as the key does, in [0, 1)."""
    rows = docs.select(
        F.monotonically_increasing_id().alias("row"),
        id_order(id_col).alias("order"),
        F.col(source_col).isNull().alias("no_source"),
        F.coalesce(F.col(source_col).cast("string"), F.lit("")).alias("source"),
        F.coalesce(word_count(F.col(text_col).cast("string")), F.lit(0)).alias("size"),
    )
    if weights is None:
        rows = rows.withColumn("weight", F.lit(1.0))
    else:
        known = weights.groupBy(id_order("id").alias("order")).agg(F.min("weight").cast("double").alias("weight"))
        rows = rows.join(known, "order", "left").fillna({"weight": 1.0})
    weight = F.least(F.greatest("weight", F.lit(LEAST_WEIGHT)), F.lit(1.0))
    key = -F.log(uniform(id_back(F.col("order")), seed)) / weight
    rows = rows.withColumn("key", key).drop("weight")
    return rows.withColumn("position", 1 - F.exp(-F.col("key") * LEAST_WEIGHT))


def mix(
    docs: DataFrame,
    weights: DataFrame | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    pattern: tuple = PATTERN,
    share: float = SHARE,
    most: float = MOST,
    seed: str = SEED,
) -> DataFrame:
    """One row per document: row (the scan's), id, size, source_size, target, copies, taken.

    ``weights`` (id, weight) favours documents in the fractional part; an unknown or null weight counts as 1
    and weights are held between LEAST_WEIGHT and 1. Documents are taken whole. After the prefix, one more
    document of the source may be taken if that brings the sum nearer to the target: the one
    whose size is nearest to what is missing. Equal keys go by id and row. A null text has size 0; null sources
    are one source, the last; sources without words have target 0. An empty table gives no rows.
    """
    spark = docs.sparkSession
    slices = max(64, 2 * int(spark.conf.get("spark.sql.shuffle.partitions")))
    drawn = _draws(docs, weights, id_col, text_col, source_col, seed)
    drawn = written(drawn.withColumn("slice", F.floor(F.col("position") * slices).cast("int")), "mix-draws")

    sums = drawn.groupBy(*SOURCE, "slice").agg(F.sum("size").alias("slice_size"))
    sizes = sums.groupBy(*SOURCE).agg(F.sum("slice_size").alias("source_size"))
    targets = source_targets(sizes, pattern, share, most)
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0))
    targets = targets.withColumn("epochs", epochs.cast("long"))
    targets = targets.withColumn("budget", F.col("target") - F.col("epochs") * F.col("source_size"))
    earlier = Window.partitionBy(*SOURCE).orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)  # at most `slices` rows
    plan = written(
        sums.withColumn("before", F.coalesce(F.sum("slice_size").over(earlier), F.lit(0))).join(targets, [*SOURCE]), "mix-plan"
    )

    ends = plan.where("before <= budget AND before + slice_size > budget").select(*SOURCE, "slice", "before", "budget")
    in_slice = Window.partitionBy(*SOURCE, "slice").orderBy("key", "order", "row").rowsBetween(Window.unboundedPreceding, 0)
    cut = drawn.join(ends, [*SOURCE, "slice"]).withColumn("to_here", F.col("before") + F.sum("size").over(in_slice))
    cut = written(cut.select(*SOURCE, "row", "before", "budget", "to_here"), "mix-cut")
    reached = cut.groupBy(*SOURCE).agg(
        F.max(F.when(F.col("to_here") <= F.col("budget"), F.col("to_here")).otherwise(F.col("before"))).alias("reached")
    )
    plan = plan.join(reached, [*SOURCE], "left").withColumn("missing", F.col("budget") - F.col("reached"))

    placed = drawn.join(plan, [*SOURCE, "slice"])
    placed = placed.join(cut.where("to_here <= budget").select("row", F.lit(True).alias("cut_in")), "row", "left")
    chosen = (F.col("before") + F.col("slice_size") <= F.col("budget")) | F.coalesce("cut_in", F.lit(False))
    placed = written(placed.withColumn("chosen", chosen), "mix-placed")
    off = F.abs(F.col("missing") - F.col("size"))
    extra = (
        placed.where(~F.col("chosen") & (off < F.col("missing")))
        .groupBy(*SOURCE)
        .agg(F.min(F.struct(off, F.col("key"), F.col("order"), F.col("row"))).alias("least"))
        .select(F.col("least.row").alias("row"), F.lit(True).alias("extra"))
    )
    copies = F.col("epochs") + F.when(F.col("chosen") | F.col("extra"), 1).otherwise(0)
    return placed.join(extra, "row", "left").select(
        "row",
        id_back(F.col("order")).alias(id_col),
        "size",
        "source_size",
        "target",
        copies.alias("copies"),
        (copies * F.col("size")).alias("taken"),
    )


def label_weights(labels: DataFrame) -> DataFrame:
    """(id, weight) from quality labels: good 1, poor 0.25; the rest, by default, 1."""
    weight = F.when(F.col("quality") == 0, F.lit(0.25)).otherwise(F.lit(1.0))
    return labels.select(F.col("doc_id").alias("id"), weight.alias("weight"))


def mixed_documents(docs: DataFrame, weights: DataFrame | None = None, **options) -> DataFrame:
    """The mixture: the rows of ``docs``, all columns, each as often as it is taken.

    ``docs`` is read twice and must give its rows in one order, as a table of files does.
    """
    row, times = free_name(docs, "scan_row"), free_name(docs, "times")
    copies = mix(docs, weights, **options).where("copies > 0").select(F.col("row").alias(row), F.col("copies").alias(times))
    numbered = docs.withColumn(row, F.monotonically_increasing_id())
    taken = rows_kept(numbered, copies, row, "inner")
    return taken.select(*docs.columns, F.explode(F.sequence(F.lit(1), F.col(times).cast("int"))).alias(times)).drop(times)
