"""Joins in which one key may hold a large part of the rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Keys that the sketch of frequent items follows, and how many of them are hot at most.
TRACKED, MOST_HOT = 4096, 256


def hot_share(spark: SparkSession) -> float:
    """Share of the rows from which on a key is hot: half of what an even task has, but no less than the sketch can tell apart."""
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return max(1 / (2 * max(partitions, 8)), 4 / TRACKED)


def hot_keys(many: DataFrame, keys: list[str]) -> DataFrame:
    """Hashes (__hash) of the hot keys of ``many``, at most MOST_HOT rows.

    A sketch of frequent items counts in every task and is merged into one row, so no exchange by key is
    needed; only the key columns are read.
    """
    share = hot_share(many.sparkSession)
    found = many.select(F.xxhash64(*keys).alias("key")).agg(
        F.expr(f"approx_top_k(key, {MOST_HOT}, {TRACKED})").alias("top"), F.count("*").alias("n")
    )
    hot = F.filter("top", lambda x: x["count"] >= F.lit(share) * F.col("n"))
    return found.select(F.explode(F.transform(hot, lambda x: x["item"])).alias("__hash"))


def salted_join(
    many: DataFrame, one: DataFrame, keys: list[str], how: str, spread: str, counted: DataFrame | None = None
) -> DataFrame:
    """Join ``many`` (left, left_semi or inner) to ``one``, which has one narrow row per key.

    The rows of ``one`` for the hot keys, at most MOST_HOT, are broadcast. All others meet by shuffle, where
    rows that are matched already, and those of a null key, are salted with a hash of the column ``spread``, which should tell
    them apart. ``one`` is not repeated, and no result hangs on which keys the sketch calls hot. The sketch counts the keys of
    ``counted`` where ``many`` is the result of a long plan and another table tells its frequent keys as well.
    AQE splits large partitions too, but only from a size in bytes on, and not where the other side aggregates
    between shuffle and join.
    """
    values = [c for c in one.columns if c not in keys]
    hot = one.join(F.broadcast(hot_keys(many if counted is None else counted, keys)), F.xxhash64(*keys) == F.col("__hash"), "left_semi")
    hot = hot.select(*keys, F.lit(True).alias("__hot"), *(F.col(c).alias(f"__hot_{c}") for c in values))
    dealt = many.join(F.broadcast(hot), keys, "left")
    no_key = F.greatest(*(F.col(k).isNull().cast("int") for k in (*keys, *keys[:1]))) == 1
    away = F.col("__hot").isNotNull() | no_key
    dealt = dealt.withColumns(
        {f"__key_{k}": F.when(~away, F.col(k)) for k in keys} | {"__salt": F.when(away, F.xxhash64(spread)).otherwise(F.lit(0))}
    )
    # Always 0, but not a constant to the optimizer, which would take the salt out of the join's keys.
    no_salt = F.pmod(F.xxhash64(*keys), F.lit(1).cast("long"))
    rest = one.select(
        *(F.col(k).alias(f"__one_{k}") for k in keys), no_salt.alias("__no_salt"), *values, F.lit(True).alias("__rest")
    )
    on = [F.col(f"__key_{k}").eqNullSafe(F.col(f"__one_{k}")) for k in keys]
    met = dealt.join(rest, [*on, F.col("__salt") == F.col("__no_salt")], "left")
    if how != "left":
        met = met.where(F.col("__hot") | F.col("__rest"))
    merged = [F.when(F.col("__hot"), F.col(f"__hot_{c}")).otherwise(F.col(c)).alias(c) for c in values]
    # As a join by column names has it: the keys first.
    left = [c for c in many.columns if c not in keys]
    return met.select(*keys, *left, *(merged if how != "left_semi" else []))
