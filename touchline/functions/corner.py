"""Domain expressions: delivery type, box occupancy, coordinates, set pieces."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from touchline import schema as S
from touchline.functions.nulls import member_of


def coordinate(location: Column, axis: int) -> Column:
    """x (axis 0) or y (axis 1) of a coordinate list; NULL where it is too short."""
    return F.get(location, axis)


def delivery_type(other: str = S.DIRECT_OR_OTHER) -> Column:
    """Short, inswinging, outswinging or ``other``; an unknown test does not match."""
    return (
        F.when(F.col("pass_length") < S.SHORT_CORNER_LENGTH, S.SHORT)
        .when(F.col("inswinging"), S.INSWINGER)
        .when(F.col("outswinging"), S.OUTSWINGER)
        .otherwise(other)
    )


def attacker_in_six_yard_box(player: Column) -> Column:
    """Whether a freeze-frame player is a teammate inside the six-yard box
    (closed bounds); unknown only if no known test already excludes them."""
    x = coordinate(player["location"], 0)
    y = coordinate(player["location"], 1)
    return (
        (x >= S.SIX_YARD_X_MIN)
        & (y >= S.SIX_YARD_Y_MIN)
        & (y <= S.SIX_YARD_Y_MAX)
        & player["teammate"]
    )


def occupancy_order(attackers: Column) -> Column:
    """Ordinal of the occupancy level; the top level is open-ended."""
    return F.when(attackers >= S.OCCUPANCY_TOP, F.lit(S.OCCUPANCY_TOP)).otherwise(attackers.cast("int"))


def occupancy_label(attackers: Column) -> Column:
    """Occupancy level of an attacker count; an unknown count has no level."""
    return F.when(attackers >= S.OCCUPANCY_TOP, S.OCCUPANCY_LEVELS[-1]).otherwise(
        F.concat(attackers.cast("string"), F.lit(" Atacantes"))
    )


def is_set_piece() -> Column:
    return member_of(F.col("play_pattern"), S.SET_PIECE_PATTERNS)


def is_goal() -> Column:
    return F.col("shot_outcome") == S.GOAL
