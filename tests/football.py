"""Builders of tiny event tables: only the columns that matter to a test are given."""

from __future__ import annotations

from touchline import schema as S
from touchline.sources.tables import EventTables

MATCH_DDL = (
    "match_id bigint, match_date string, season_name string, home_team_name string, "
    "away_team_name string, match_status_360 string"
)


def player(x, y, teammate=True):
    return ([x, y], teammate)


IN_BOX = player(116.0, 40.0)
OUT_OF_BOX = player(100.0, 40.0)


def corner(id, team="A", match=1, possession=1, ts="00:01:00.000", **more):
    return dict(
        id=id, match_id=match, possession=possession, ts=ts, team_id=ord(team[0]), team_name=team,
        type_name="Pass", pass_type="Corner", player_name="taker", **more,
    )


def shot(id, key_pass_id=None, frame=(IN_BOX,), team="A", match=1, possession=1, ts="00:01:05.000",
         outcome="Saved", minute=1, second=5, player_name="shooter", **more):
    return dict(
        id=id, key_pass_id=key_pass_id, freeze_frame=None if frame is None else list(frame), match_id=match,
        possession=possession, ts=ts, team_id=ord(team[0]), team_name=team, type_name="Shot",
        shot_outcome=outcome, minute=minute, second=second, player_name=player_name, **more,
    )


def match(match_id=1, season="2022/2023", home="A", away="B", status="available"):
    return (match_id, "2023-01-02", season, home, away, status)


def tables(spark, events, matches=(match(),), logos=(("A", "img/a"), ("B", "img/b"))) -> EventTables:
    rows = [tuple(event.get(f.name) for f in S.EVENTS) for event in events]
    return EventTables(
        events=spark.createDataFrame(rows, S.EVENTS),
        matches=spark.createDataFrame(list(matches), MATCH_DDL),
        logos=spark.createDataFrame(list(logos), "team_name string, logo_url string"),
    )


def separate_frames(t: EventTables) -> EventTables:
    """The same events with the players delivered apart, one part per player."""
    from dataclasses import replace

    from pyspark.sql import functions as F

    parts = t.events.where("freeze_frame is not null").select(
        "id", F.explode("freeze_frame").alias("p")
    ).select("id", F.array("p").alias("freeze_frame"))
    events = t.events.withColumn("has_frame", F.col("freeze_frame").isNotNull()).drop("freeze_frame")
    return replace(t, events=events, frames=parts)


def rows(df, *columns):
    """Sorted tuples (NULLs first)."""
    picked = df.select(*columns) if columns else df
    return sorted((tuple(r) for r in picked.collect()), key=lambda r: [(v is not None, str(v)) for v in r])
