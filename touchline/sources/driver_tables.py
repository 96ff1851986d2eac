"""Football-shaped views over the generic star-schema test tables.

Lets every query run on ``events``, ``orders``, ``lineitem`` and ``nation``
Parquet files of any size.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from touchline.schema import AVAILABLE, CORNER, EVENTS, GOAL, SHOT
from touchline.sources.tables import EventTables

TEAM_NAMES = {f"NATION_{n}": f"Club NATION_{n}" for n in (1, 5, 12)}


# The columns read here; an explicit schema needs no look at the files.
SCHEMAS = {
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string",
    "orders": "o_orderkey bigint, o_orderstatus string, o_orderdate timestamp_ntz, o_orderpriority string",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_quantity double, l_returnflag string",
    "nation": "n_nationkey int, n_name string",
    "supplier": "s_suppkey bigint",
}


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.schema(SCHEMAS[table]).parquet(f"{sf_dir}/{table}.parquet")


def matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every order as a match, most of them without events."""
    orders = _read(spark, sf_dir, "orders")
    nation = _read(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("k"), "n_name")
    key = F.col("o_orderkey")
    season = (
        F.when(key % 19 == 0, None)
        .when(key % 4 == 0, "2021/2022")
        .when(key % 4 == 1, "2022/2023")
        .when(key % 4 == 2, "2023/2024")
        .otherwise("2024/2025")
    )
    status = F.when(key % 11 == 0, "processing").when(key % 13 != 0, AVAILABLE)
    home = nation.select(F.col("k").alias("home"), F.col("n_name").alias("home_team_name"))
    away = nation.select(F.col("k").alias("away"), F.col("n_name").alias("away_team_name"))
    return (
        orders.select(
            key.alias("match_id"),
            F.col("o_orderdate").cast("date").alias("match_date"),
            season.alias("season_name"),
            ((key * 3) % 25).alias("home"),
            ((key * 3 + 7) % 25).alias("away"),
            status.alias("match_status_360"),
        )
        .join(home, "home", "left")
        .join(away, "away", "left")
        .drop("home", "away")
    )


def match_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as a raw match table whose flags are spelled as text."""
    status = F.col("o_orderstatus")
    return _read(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("match_id"),
        status.alias("behind_closed_doors"),
        F.when(status == "O", "true").when(status == "F", "False").otherwise("unknown").alias("neutral_ground"),
        F.col("o_orderpriority").alias("not_a_match_column"),
    )


def match_of_event():
    """The event's match; some events name a match that no order has."""
    return F.when(F.col("user_id") % 9 == 4, -F.col("user_id")).otherwise(F.col("user_id"))


def _k():
    return F.get_json_object("props", "$.k").cast("int")


def _play_pattern():
    k = _k()
    return (
        F.when(k % 6 == 0, "From Corner")
        .when(k % 6 == 1, "From Free Kick")
        .when(k % 6 == 2, "From Throw-in")
        .when(k % 6 >= 4, "Regular Play")
    )


def _corner_columns() -> dict:
    event_id, k = F.col("event_id"), _k()
    end = F.array((90 + event_id * 7 % 31).cast("double"), (event_id * 11 % 81).cast("double"))
    return {
        "type_name": F.lit("Pass"),
        "pass_type": F.lit(CORNER),
        "pass_length": F.when(k % 13 != 0, k.cast("double")),
        "inswinging": F.when(k % 3 == 0, True),
        "outswinging": F.when(k % 3 == 1, True),
        "pass_end_location": F.when(event_id % 29 != 0, end),
        "location": F.array(F.lit(120.0), (event_id % 2 * 80).cast("double")),
        "obv_total_net": F.when(event_id % 11 != 0, (F.col("value") - 50) / 1000),
    }


def _shot_columns() -> dict:
    value, k = F.col("value"), _k()
    return {
        "type_name": F.lit(SHOT),
        "xg": F.when(F.col("event_id") % 13 != 0, value / 500),
        "xgot": F.when(value > 30, value / 400),
        "shot_outcome": F.when(value > 60, GOAL).when(k % 10 != 0, "Saved"),
        "shot_type": F.when(k % 7 == 0, "Corner").otherwise("Open Play"),
    }


# Columns that only some kinds of event have.
_KIND_COLUMNS = {
    "type_name": "string",
    "pass_type": "string",
    "pass_length": "double",
    "inswinging": "boolean",
    "outswinging": "boolean",
    "pass_end_location": "array<double>",
    "location": "array<double>",
    "obv_total_net": "double",
    "xg": "double",
    "xgot": "double",
    "shot_outcome": "string",
    "shot_type": "string",
}


def _events_of(raw: DataFrame, kind: dict, linked: bool = False) -> DataFrame:
    """Events of one kind. What the kind lacks is a NULL literal, so a filter on
    the kind removes the other kinds' scans from the plan."""
    event_id, user_id, day = F.col("event_id"), F.col("user_id"), F.dayofmonth("ts")
    player = F.concat(F.lit("P"), (event_id % 37).cast("string"))
    return raw.select(
        event_id.alias("id"),
        match_of_event().alias("match_id"),
        "ts",
        day.alias("possession"),
        ((user_id * 3 + (day % 2) * 7) % 25).cast("int").alias("team_id"),
        (event_id % 90).cast("int").alias("minute"),
        (event_id % 60).cast("int").alias("second"),
        F.when(event_id % 37 != 0, player).alias("player_name"),
        _play_pattern().alias("play_pattern"),
        (event_id % 17 != 0).alias("has_frame"),
        *(kind.get(name, F.lit(None)).cast(type_).alias(name) for name, type_ in _KIND_COLUMNS.items()),
        F.col("key_pass_id") if linked else F.lit(None).cast("long").alias("key_pass_id"),
    )


def _linked_shots(raw: DataFrame) -> DataFrame:
    """The raw shots with key_pass_id, the highest corner id earlier in the same match and possession.

    A running maximum in two levels: within a minute by a window, and over the
    earlier minutes by a window on one row per minute. No window partition
    holds a whole match or possession, so one that has most of the events is
    spread over its minutes.
    """
    rows = raw.where(F.col("event_type").isin("click", "purchase")).withColumns(
        {
            "match": match_of_event(),
            "day": F.dayofmonth("ts"),
            "at_minute": F.date_trunc("minute", F.col("ts")),
            "corner_id": F.when(F.col("event_type") == "click", F.col("event_id")),
        }
    )
    group = ["match", "day"]
    before = (Window.unboundedPreceding, -1)
    within = Window.partitionBy(*group, "at_minute").orderBy("ts", "event_id").rowsBetween(*before)
    minutes = rows.groupBy(*group, "at_minute").agg(F.max("corner_id").alias("m"))
    over_minutes = Window.partitionBy(*group).orderBy("at_minute").rowsBetween(*before)
    earlier = minutes.withColumn("earlier", F.max("m").over(over_minutes)).drop("m")
    return (
        rows.withColumn("same_minute", F.max("corner_id").over(within))
        .where(F.col("corner_id").isNull())
        .join(earlier, [*group, "at_minute"])
        .select(*raw.columns, F.greatest("same_minute", "earlier").alias("key_pass_id"))
    )


def events(spark: SparkSession, sf_dir: str, links: bool = True) -> DataFrame:
    """The events view; ``links=False`` leaves ``key_pass_id`` empty for queries
    that do not follow shots to their corners."""
    raw = _read(spark, sf_dir, "events")
    nation = _read(spark, sf_dir, "nation").select(
        F.col("n_nationkey").alias("team_id"), F.col("n_name").alias("team_name")
    )
    kind = F.col("event_type")
    corners = _events_of(raw.where(kind == "click"), _corner_columns())
    others = _events_of(raw.where(kind.isNull() | ~kind.isin("click", "purchase")), {"type_name": F.lit("Other")})
    shots = _linked_shots(raw) if links else raw.where(kind == "purchase")
    shots = _events_of(shots, _shot_columns(), linked=links)
    return corners.unionByName(shots).unionByName(others).join(nation, "team_id", "left")


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Freeze-frame players, delivered as one single-player part per line item.

    Parts keep the arrays short whatever an event's number of players; the
    consumer adds up counts per event.
    """
    lines = _read(spark, sf_dir, "lineitem")
    y = F.when(F.col("l_partkey") % 97 != 0, (25 + F.col("l_suppkey") % 31).cast("double"))
    x = (108 + F.floor("l_quantity") % 13).cast("double")
    player = F.struct(
        F.array(x, y).alias("location"), (F.col("l_returnflag") != "N").alias("teammate")
    )
    return lines.select(F.col("l_orderkey").alias("id"), F.array(player).alias("freeze_frame"))


def nested_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events in the feed's schema, the players nested in the event: up to five, none
    (an empty array), or an array that is missing. They are computed per event."""
    event_id = F.col("id")

    def player(i):
        x = (108 + (event_id * 5 + i * 3) % 13).cast("double")
        y = F.when((event_id + i) % 31 != 0, (25 + (event_id * 7 + i * 11) % 31).cast("double"))
        return F.struct(F.array(x, y).alias("location"), ((event_id + i) % 3 != 0).alias("teammate"))

    players = F.transform(F.slice(F.array(*map(F.lit, range(1, 6))), F.lit(1), (event_id % 6).cast("int")), player)
    framed = events(spark, sf_dir).withColumn("freeze_frame", F.when(F.col("has_frame"), players))
    return framed.select(*(F.col(f.name).cast(f.dataType).alias(f.name) for f in EVENTS))


def catalogue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as seasons of a provider's catalogue."""
    key = F.col("o_orderkey")
    return _read(spark, sf_dir, "orders").select(
        F.col("o_orderpriority").alias("country_name"),
        F.col("o_orderstatus").alias("competition_name"),
        (key % 7).alias("competition_id"),
        key.alias("season_id"),
        F.date_format("o_orderdate", "yyyy-MM-dd").alias("season_name"),
    )


def regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every supplier as a rectangle of the pitch, some of them without a known bound."""
    key = F.col("s_suppkey")
    xmin, ymin = (60 + key * 7 % 53).cast("double"), (key * 11 % 71).cast("double")
    return _read(spark, sf_dir, "supplier").select(
        F.concat(F.lit("Z"), key.cast("string")).alias("zona_nombre"),
        xmin.alias("xmin"),
        F.when(key % 23 != 0, xmin + key % 9).alias("xmax"),
        ymin.alias("ymin"),
        (ymin + key % 5 / 2).alias("ymax"),
    )


def logos(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for every team; some have no badge."""
    key = F.col("n_nationkey")
    url = F.when(key % 9 != 0, F.concat(F.lit("img/"), key.cast("string")))
    return _read(spark, sf_dir, "nation").select(F.col("n_name").alias("team_name"), url.alias("logo_url"))


def raw_tables(spark: SparkSession, sf_dir: str, links: bool = True) -> EventTables:
    """The bound tables before team names are harmonised."""
    return EventTables(
        events=events(spark, sf_dir, links),
        matches=matches(spark, sf_dir),
        logos=logos(spark, sf_dir),
        frames=frames(spark, sf_dir),
    )


def open_tables(spark: SparkSession, sf_dir: str, links: bool = True) -> EventTables:
    """The bound tables, over the files that are there now."""
    return raw_tables(spark, sf_dir, links).harmonized(TEAM_NAMES)
