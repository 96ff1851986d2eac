"""A key that holds a third of the rows: right results, and no task with all of it."""

import pytest
from pyspark.sql import functions as F

from touchline import schema as S
from touchline.operators.skew import hot_keys, salted_join
from touchline.plans import corners, spatial
from touchline.sources.tables import EventTables
from tests.football import MATCH_DDL

ROWS = 30_000


@pytest.fixture
def shuffled(spark):
    """No broadcasts, one task per shuffle partition."""
    changed = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.enabled": "false",
        "spark.sql.shuffle.partitions": "64",
    }
    before = {k: spark.conf.get(k) for k in changed}
    for k, v in changed.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


def hot(key, other):
    return F.when(F.col("id") % 3 == 0, F.lit(key)).otherwise(other)


@pytest.mark.parametrize("how", ["left", "inner", "left_semi"])
def test_salted_join_equals_the_plain_join(spark, shuffled, how):
    many = spark.range(ROWS).select("id", hot(7, F.col("id") % 900).alias("k"))
    one = spark.range(0, 900, 2).select(F.col("id").alias("k"), *([] if how == "left_semi" else [(F.col("id") * 10).alias("v")]))
    joined = salted_join(many, one.union(one.limit(1).selectExpr("7L", *([] if how == "left_semi" else ["70L"]))), ["k"], how, "id")
    plain = many.join(one.union(one.limit(1).selectExpr("7L", *([] if how == "left_semi" else ["70L"]))), ["k"], how)
    assert joined.exceptAll(plain).count() == 0 and plain.exceptAll(joined).count() == 0
    tasks = joined.groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0]
    assert tasks < ROWS / 3 * 0.6


def test_only_hot_rows_are_broadcast(spark, shuffled):
    """The other side is not repeated, whatever its size; the broadcast side holds the hot keys alone."""
    many = spark.range(ROWS).select("id", hot(7, F.col("id") % 9000).alias("k"))
    one = spark.range(9000).select(F.col("id").alias("k"), (F.col("id") * 10).alias("v"))
    assert salted_join(many, one, ["k"], "inner", "id").count() == ROWS
    assert [r[0] for r in hot_keys(many, ["k"]).collect()] == [spark.range(1).select(F.xxhash64(F.lit(7).cast("long"))).first()[0]]
    assert hot_keys(many.limit(0), ["k"]).count() == 0
    even = spark.range(ROWS).select("id", F.col("id").alias("k"))
    assert hot_keys(even, ["k"]).count() == 0
    plan = salted_join(many, one, ["k"], "left", "id")._jdf.queryExecution().optimizedPlan().toString()
    assert "approx_top_k" in plan and "sequence(" not in plan


def test_null_keys_and_several_columns(spark, shuffled):
    many = spark.range(ROWS).select("id", F.when(F.col("id") % 2 == 0, F.col("id") % 5).alias("a"), hot(1, F.col("id") % 11).alias("b"))
    one = many.select("a", "b").distinct().withColumn("v", F.concat_ws("-", "a", "b"))
    for how in ("left", "inner", "left_semi"):
        right = one.drop("v") if how == "left_semi" else one
        joined, plain = salted_join(many, right, ["a", "b"], how, "id"), many.join(right, ["a", "b"], how)
        assert joined.exceptAll(plain).count() == 0 and plain.exceptAll(joined).count() == 0


def test_hot_match_of_delivery_points(spark, shuffled):
    rows = spark.range(ROWS)
    known = {"id": F.col("id").cast("string"), "match_id": hot(1, F.col("id") % 50), "pass_type": F.lit(S.CORNER)}
    known |= {"team_name": F.lit("A"), "pass_end_location": F.array(F.lit(110.0), F.lit(40.0))}
    events = rows.select(*(known.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in S.EVENTS))
    matches = spark.createDataFrame([(i, "2023-01-02", "2022/2023", "A", "B", "available") for i in range(50)], MATCH_DDL)
    t = EventTables(events=events, matches=matches, logos=S.logos_table(spark))
    points = spatial.delivery_points(t)
    assert points.where("temporada = '2022/2023'").count() == ROWS
    assert points.groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0] < ROWS / 3 * 0.6
    assert corners.corner_totals(t).count() == ROWS
