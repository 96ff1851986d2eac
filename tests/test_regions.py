"""Rectangles as a table: against a loop over all pairs, and the plan."""

import math

import pytest
from pyspark.sql import functions as F

from touchline import schema as S
from touchline.operators.regions import assign_regions
from touchline.operators.zones import assign_zones

INF = math.inf
REGIONS = [
    ("a", 0.0, 10.0, 0.0, 10.0), ("b", 10.0, 10.0, 0.0, 120.0), ("point", 5.0, 5.0, 5.0, 5.0), ("tiny", 5.0, 5.0 + 1e-9, 5.0, 5.0),
    ("left", -INF, 0.0, -INF, INF), ("all", -INF, INF, -INF, INF), ("wide", -1e9, 1e9, 3.0, 4.0), ("null", None, 1.0, 0.0, 1.0),
    ("nan", math.nan, 1.0, 0.0, 1.0), ("turned", 9.0, 1.0, 0.0, 9.0), ("a", 8.0, 24.0, 8.0, 24.0), ("neg", -64.0, -32.0, -64.5, -31.5),
]
POINTS = [(i, x, y) for i, (x, y) in enumerate([(5.0, 5.0), (10.0, 10.0), (0.0, 0.0), (-32.0, -31.5), (1e8, 3.5), (12.5, 30.0), (None, 1.0), (1.0, None), (7.25, 3.0), (5.0 + 1e-9, 5.0)])]


def region_table(spark, rows):
    return spark.createDataFrame(rows, "zona_nombre string, xmin double, xmax double, ymin double, ymax double")


def brute(points, regions, default="none"):
    out = []
    for i, x, y in points:
        hits = [
            n for n, x0, x1, y0, y1 in regions
            if None not in (x, y, x0, x1, y0, y1) and x0 <= x <= x1 and y0 <= y <= y1
        ]
        out += [(i, n) for n in hits or [default]]
    return sorted(out)


@pytest.mark.parametrize("regions", [REGIONS, REGIONS[:5], REGIONS[7:8], []])
def test_odd_rectangles(spark, regions):
    points = spark.createDataFrame(POINTS, "id long, end_x double, end_y double")
    found = assign_regions(points, region_table(spark, regions), "id", default="none")
    assert sorted((r.id, r.zona_nombre) for r in found.collect()) == brute(POINTS, regions)


def test_many_rectangles_without_a_nested_loop(spark):
    regions = [(f"z{i}", i * 7 % 110, i * 7 % 110 + 2.0 ** (i % 9 - 3), i * 11 % 70, i * 11 % 70 + i % 17 / 4) for i in range(700)]
    regions = [tuple(map(lambda v: v if isinstance(v, str) else float(v), r)) for r in regions]
    points = [(i, i * 13 % 121 / 1.0, i * 29 % 323 / 4) for i in range(900)]
    table = spark.createDataFrame(points, "id long, end_x double, end_y double")
    found = assign_regions(table, region_table(spark, regions), "id", default="none")
    assert sorted((r.id, r.zona_nombre) for r in found.collect()) == brute(points, regions)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan and "Subquery" in plan


def test_equals_the_literal_zones(spark):
    points = spark.range(9000).select("id", (F.col("id") % 121).cast("double").alias("end_x"), (F.col("id") * 7 % 81).cast("double").alias("end_y"))
    table = region_table(spark, [(z.zona_nombre, float(z.xmin), float(z.xmax), float(z.ymin), float(z.ymax)) for z in S.ZONES])
    found, literal = assign_regions(points, table, "id", default=S.OTHER_ZONE), assign_zones(points)
    assert found.exceptAll(literal).count() == 0 and literal.exceptAll(found).count() == 0
