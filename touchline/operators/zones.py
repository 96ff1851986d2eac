"""Point-in-rectangle assignment (range left join with a literal dimension)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from touchline import schema as S


def assign_zones(
    points: DataFrame,
    x: str = "end_x",
    y: str = "end_y",
    zones: list[S.Zone] = S.ZONES,
    default: str | None = S.OTHER_ZONE,
) -> DataFrame:
    """One row per point and closed rectangle containing it, or one row with the
    default label where there is none.

    The rectangles are literals of the plan, so the range join is a projection
    and a generator inside the scan stage: no exchange, no nested-loop join and
    nothing to broadcast. A point on a shared edge belongs to each neighbour.
    """
    hits = F.array_compact(
        F.array(
            *(
                F.when(
                    F.col(x).between(z.xmin, z.xmax) & F.col(y).between(z.ymin, z.ymax),
                    F.lit(z.zona_nombre),
                )
                for z in zones
            )
        )
    )
    labels = F.when(F.size(hits) > 0, hits).otherwise(F.array(F.lit(default)))
    return points.withColumn("zona_nombre", F.explode(labels))
