"""Does a later event of another kind exist under the same key?"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from touchline.operators.skew import salted_join


def flag_followed(
    events: DataFrame, targets: DataFrame, keys: list[str], ts: str, into: str, spread: str = "id"
) -> DataFrame:
    """Mark each event for which some target with equal keys has a later ``ts``.

    Equals joining all pairs, keeping the later ones and de-duplicating, but a
    later target exists exactly if the last one is later, so the targets shrink
    to one row per key before the join and no pairs are formed.

    A key with very many events is spread over tasks by the column ``spread``.
    """
    last = targets.groupBy(*keys).agg(F.max(ts).alias("__last"))
    followed = F.coalesce(F.col("__last") > F.col(ts), F.lit(False))
    return salted_join(events, last, keys, "left", spread).withColumn(into, followed).drop("__last")


def next_target(
    events: DataFrame, targets: DataFrame, keys: list[str], ts: str, slot: Column, target_id: str = "id", into: str = "target"
) -> DataFrame:
    """Attach to each event the first later target of equal keys: ``into`` (target_id, ts), null where there is none.

    Of targets at the same time the smallest id counts. No pairs are formed: events and targets are sorted together once
    within a ``slot`` of time (a non-decreasing function of ``ts``), where the next target is the one seen last on the way
    back, and each slot hands its first target on to the slots before it. A key with very many events is split by its slots.
    """
    group, pick = [*keys, "__slot"], F.struct(F.col(ts).alias(ts), F.col("__id").alias(target_id))
    # One row per key and time; the plain equality of join keys leaves null keys without a target.
    firsts = targets.groupBy(*keys, ts).agg(F.min(target_id).alias("__id"))
    marked = events.withColumn("__event", F.struct(*events.columns)).select(*keys, ts, "__event", F.lit(None).cast(firsts.schema["__id"].dataType).alias("__id"))
    both = marked.unionByName(firsts.withColumn("__event", F.lit(None).cast(marked.schema["__event"].dataType)))
    both = both.withColumns({"__slot": slot, "__target": F.when(F.col("__id").isNotNull(), pick)})
    # From late to early; at one time the events come before the targets, so that only later ones are seen.
    back = Window.partitionBy(*group).orderBy(F.desc(ts), F.col("__id").isNotNull()).rowsBetween(Window.unboundedPreceding, -1)
    in_slot = both.withColumn("__near", F.last("__target", ignorenulls=True).over(back)).where(F.col("__event").isNotNull())
    slots = both.groupBy(*group).agg(F.min("__target").alias("__first"))
    over_slots = Window.partitionBy(*keys).orderBy(F.desc("__slot")).rowsBetween(Window.unboundedPreceding, -1)
    later = slots.withColumn("__later", F.last("__first", ignorenulls=True).over(over_slots)).drop("__first")
    met = in_slot.alias("l").join(later.alias("r"), [F.col(f"l.{c}").eqNullSafe(F.col(f"r.{c}")) for c in group], "left")
    known = F.lit(True)
    for key in keys:
        known = known & F.col(f"__event.{key}").isNotNull()
    found = F.when(known, F.coalesce("__near", "__later"))
    return met.select("__event.*", F.struct(found[target_id].alias(target_id), found[ts].alias(ts)).alias(into))
