"""Corners, the shots they caused, and who stood in the six-yard box."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from touchline import schema as S
from touchline.functions.corner import (
    attacker_in_six_yard_box,
    coordinate,
    delivery_type,
    is_goal,
    occupancy_label,
    occupancy_order,
)
from touchline.functions.nulls import count_true
from touchline.operators.skew import salted_join
from touchline.plans.stored import stored
from touchline.sources.tables import EventTables

# Working columns of a shot: players seen, and attackers in the box (NULL when unknown).
PLAYERS = "jugadores"
ATTACKERS = "atacantes_en_area_chica"


def season_of_match(t: EventTables) -> DataFrame:
    return t.matches.select("match_id", F.col("season_name").alias("temporada"))


def with_season(df: DataFrame, t: EventTables, spread: str | None = None) -> DataFrame:
    """Attach the season; rows of unlisted matches stay, with NULL. Rows that were not
    reduced to a few per match name the column by which a match with very many is ``spread``."""
    if spread is None:
        return df.join(season_of_match(t), "match_id", "left")
    return salted_join(df, season_of_match(t), ["match_id"], "left", spread)


def corner_events(t: EventTables) -> DataFrame:
    return t.events.where(F.col("pass_type") == S.CORNER)


@stored
def corner_table(t: EventTables) -> DataFrame:
    """Corners with delivery type, taker and flat coordinates; queries read the
    columns they need."""
    return corner_events(t).select(
        "id",
        "match_id",
        "possession",
        "ts",
        "team_id",
        "team_name",
        "player_name",
        "pass_length",
        "inswinging",
        "outswinging",
        "obv_total_net",
        "xg",
        delivery_type().alias("tipo_cobro"),
        coordinate(F.col("location"), 0).alias("start_x"),
        coordinate(F.col("location"), 1).alias("start_y"),
        coordinate(F.col("pass_end_location"), 0).alias("end_x"),
        coordinate(F.col("pass_end_location"), 1).alias("end_y"),
    )


def shots(t: EventTables) -> DataFrame:
    return t.events.where(F.col("type_name") == S.SHOT)


def shots_with_freeze_frame(t: EventTables) -> DataFrame:
    """Shots whose frame was delivered; an empty frame counts as delivered."""
    present = F.col("freeze_frame").isNotNull() if t.frames is None else F.col("has_frame")
    return shots(t).where(present)


def linked_shots(t: EventTables) -> DataFrame:
    """Shots with a frame and a key pass of any kind."""
    return shots_with_freeze_frame(t).where(F.col("key_pass_id").isNotNull())


def _shot_keys(t: EventTables) -> DataFrame:
    """Match and key pass of the shots, from which their frequent values are told."""
    known = t.stored.get("counted_shots")
    return (linked_shots(t) if known is None else known).select("match_id", "key_pass_id")


def of_corners(shots_: DataFrame, t: EventTables) -> DataFrame:
    """The shots whose key pass is a corner."""
    ids = corner_table(t).select(F.col("id").alias("key_pass_id"))
    return salted_join(shots_, ids, ["key_pass_id"], "left_semi", "id", _shot_keys(t))


def corner_assisted_shots(t: EventTables) -> DataFrame:
    """Shots with a frame whose key pass is a corner."""
    return of_corners(linked_shots(t), t)


def _box_flag_counts(flag: Column) -> list[Column]:
    return [
        F.count("*").alias(PLAYERS),
        F.when(F.count_if(flag.isNull()) == 0, count_true(flag)).alias(ATTACKERS),
    ]


def frame_counts(frames: DataFrame) -> DataFrame:
    """Players and box attackers per event id of separately delivered frames.

    Counting is partial before the exchange, so an event with very many rows
    costs one row per task.
    """
    players = frames.select("id", F.explode("freeze_frame").alias("player"))
    flagged = players.select("id", attacker_in_six_yard_box(F.col("player")).alias("in_box"))
    return flagged.groupBy("id").agg(*_box_flag_counts(F.col("in_box")))


def count_box_attackers(corner_shots: DataFrame, t: EventTables) -> DataFrame:
    """Attach PLAYERS and ATTACKERS; a shot without any player has 0 and NULL.

    Nested frames are counted in place, without explode or exchange. Frames delivered
    apart are first cut down to those of the shots.
    """
    if t.frames is not None:
        wanted = t.frames.join(corner_shots.select("id"), "id", "left_semi")
        counted = corner_shots.join(frame_counts(wanted), "id", "left")
        return counted.withColumn(PLAYERS, F.coalesce(PLAYERS, F.lit(0)))
    flags = F.transform("freeze_frame", attacker_in_six_yard_box)
    unknown = F.exists(flags, lambda f: f.isNull())
    hits = F.size(F.filter(flags, lambda f: f)).cast("long")
    return corner_shots.withColumns(
        {
            PLAYERS: F.size("freeze_frame").cast("long"),
            ATTACKERS: F.when((F.size("freeze_frame") > 0) & ~F.coalesce(unknown, F.lit(False)), hits),
        }
    )


@stored
def counted_shots(t: EventTables) -> DataFrame:
    """``linked_shots`` with PLAYERS and ATTACKERS in place of the frame."""
    frame = ["freeze_frame"] if t.frames is None else []
    narrow = linked_shots(t).select(
        "id",
        "key_pass_id",
        "match_id",
        "team_name",
        "player_name",
        "minute",
        "second",
        "shot_outcome",
        "xg",
        "xgot",
        *frame,
    )
    return count_box_attackers(narrow, t).drop(*frame)


def _with_level(df: DataFrame) -> DataFrame:
    return df.withColumns(
        {
            "categoria_atacantes": occupancy_label(F.col(ATTACKERS)),
            "categoria_orden": occupancy_order(F.col(ATTACKERS)),
        }
    )


def box_occupancy(t: EventTables, *more: str) -> DataFrame:
    """Box attackers and goal flag per corner shot with at least one player; ``more`` names
    further columns of the shot."""
    seen = of_corners(counted_shots(t).where(F.col(PLAYERS) > 0), t)
    return seen.select("id", *more, ATTACKERS, is_goal().alias("fue_gol"))


def occupancy_category(t: EventTables, *more: str) -> DataFrame:
    """``box_occupancy`` with the occupancy level (label and ordinal)."""
    return _with_level(box_occupancy(t, *more))


def shots_with_category(t: EventTables) -> DataFrame:
    """Every corner shot with its occupancy attributes; a shot without players
    stays, with NULL attributes."""
    return _with_level(of_corners(counted_shots(t), t)).select(
        "id",
        "key_pass_id",
        "match_id",
        "xg",
        ATTACKERS,
        F.when(F.col(PLAYERS) > 0, is_goal()).alias("fue_gol"),
        "categoria_atacantes",
        "categoria_orden",
    )


def shot_to_corner(shots_: DataFrame, t: EventTables, how: str = "left") -> DataFrame:
    """Attach taker, start and end of the corner named by ``key_pass_id``; one
    join serves all of them. ``how="inner"`` also keeps only the shots whose key
    pass is a corner."""
    corner = corner_table(t).select(
        F.col("id").alias("key_pass_id"),
        F.col("player_name").alias("ejecutor"),
        "start_x",
        "start_y",
        "end_x",
        "end_y",
    )
    return salted_join(shots_, corner, ["key_pass_id"], how, "id", _shot_keys(t))


@stored
def enriched_shots(t: EventTables) -> DataFrame:
    """Corner shots of known occupancy with match, taker, coordinates and xG."""
    known = _with_level(counted_shots(t).where(F.col(ATTACKERS).isNotNull()))
    match = t.matches.select(
        "match_id",
        F.col("match_date").alias("fecha"),
        F.col("home_team_name").alias("equipo_local"),
        F.col("away_team_name").alias("equipo_visitante"),
        F.col("season_name").alias("temporada"),
    )
    linked = shot_to_corner(known, t, "inner")
    return salted_join(linked, match, ["match_id"], "left", "id", _shot_keys(t)).select(
        "id",
        "match_id",
        "key_pass_id",
        F.col("team_name").alias("equipo_atacante"),
        F.col("player_name").alias("rematador"),
        F.col("minute").alias("minuto"),
        F.col("second").alias("segundo"),
        F.col("xg").alias("xG"),
        F.col("xgot").alias("xGoT"),
        "fecha",
        "equipo_local",
        "equipo_visitante",
        "temporada",
        "ejecutor",
        "categoria_atacantes",
        "categoria_orden",
        "start_x",
        "start_y",
        "end_x",
        "end_y",
        is_goal().alias("fue_gol"),
    )


# Per-corner number of rows in ``corner_outcomes``.
ROWS = "filas"


@stored
def corner_totals(t: EventTables) -> DataFrame:
    """One row per corner: ``filas`` outcome rows (one per shot it led to, at
    least one), ``remates`` shots, ``goles`` goals and ``xg_vinculado``, the xG
    of its shots.

    Summing these gives the totals of ``corner_outcomes``, with the shots
    reduced to one row per key pass before the join and no corner repeated. The
    join itself drops key passes that are no corner. A shot without players
    never counts as a goal: its occupancy row, which carries the goal flag,
    does not exist.
    """
    goal = (F.col(PLAYERS) > 0) & is_goal()
    per_key_pass = (
        counted_shots(t)
        .groupBy(F.col("key_pass_id").alias("id"))
        .agg(
            F.count("*").alias("remates"),
            count_true(goal).alias("goles"),
            F.sum("xg").alias("xg_vinculado"),
        )
    )
    shots_of_corner = F.coalesce("remates", F.lit(0))
    return corner_table(t).join(per_key_pass, "id", "left").withColumns(
        {
            "remates": shots_of_corner,
            "goles": F.coalesce("goles", F.lit(0)),
            ROWS: F.greatest(shots_of_corner, F.lit(1)),
        }
    )


FAN_OUT = 1000


def corner_outcomes(t: EventTables) -> DataFrame:
    """One row per corner and shot it led to, one row for a corner without any.

    The rows of a corner differ in the goal flag only, so they are written out
    from the counts of ``corner_totals``. That happens in runs of at most
    FAN_OUT rows, spread by (corner, run): a corner with very many shots is
    neither joined row by row nor written by one task.
    """
    totals = corner_totals(t).withColumn("termino_en_remate", F.col("remates") > 0)
    parts = F.array(
        F.struct(F.lit(True).alias("fue_gol"), F.col("goles").alias("n")),
        F.struct(F.lit(False).alias("fue_gol"), (F.col(ROWS) - F.col("goles")).alias("n")),
    )
    base = ["id", "match_id", "team_name", "tipo_cobro", "obv_total_net"]
    by_flag = totals.select(*base, "termino_en_remate", F.inline(parts)).where("n > 0")
    runs = by_flag.withColumn("run", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / FAN_OUT))))
    run_length = F.least(F.col("n") - F.col("run") * FAN_OUT, F.lit(FAN_OUT))
    return (
        runs.repartition("id", "run")
        .withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), run_length)))
        .select(*base, "fue_gol", "termino_en_remate")
    )


def outcome_sums() -> dict[str, Column]:
    """Additive sums over ``corner_totals``."""
    known_obv = F.col("obv_total_net").isNotNull()
    return {
        ROWS: F.sum(ROWS),
        "remates": F.sum("remates"),
        "goles": F.sum("goles"),
        "obv": F.sum(F.col("obv_total_net") * F.col(ROWS)),
        "filas_obv": F.sum(F.when(known_obv, F.col(ROWS)).otherwise(0)),
    }


def sums_by_season(df: DataFrame, t: EventTables, sums: dict[str, Column], by: list[str]) -> DataFrame:
    """Additive ``sums`` per season and ``by``. Rows shrink to one per match and
    ``by`` before they meet the match table."""
    per_match = df.groupBy("match_id", *by).agg(*(c.alias(n) for n, c in sums.items()))
    return with_season(per_match, t).groupBy("temporada", *by).agg(*(F.sum(n).alias(n) for n in sums))
