"""Canonical column names, table schemas and the literal dimensions."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

# --- fixed values: event vocabulary --------------------------------------
CORNER = "Corner"
SHOT = "Shot"
GOAL = "Goal"
FROM_CORNER = "From Corner"
SET_PIECE_PATTERNS = ["From Corner", "From Free Kick", "From Throw-in"]
CORNER_SHOT_TYPES = ["Corner", "From Corner"]
AVAILABLE = "available"
MATCH_MINUTES = 90

# --- fixed values: pitch geometry (120 x 80) ------------------------------
PITCH_LENGTH = 120.0
PITCH_WIDTH = 80.0
SIX_YARD_X_MIN = 114.0
SIX_YARD_Y_MIN = 30.0
SIX_YARD_Y_MAX = 50.0
SHORT_CORNER_LENGTH = 25.0

# --- fixed values: delivery types -----------------------------------------
SHORT = "Corto"
INSWINGER = "Inswinger"
OUTSWINGER = "Outswinger"
DIRECT_OR_OTHER = "Directo/Otro"
DIRECT = "Directo"

# --- fixed values: occupancy levels, in order ------------------------------
OCCUPANCY_LEVELS = ["0 Atacantes", "1 Atacantes", "2 Atacantes", "3 Atacantes", "4+ Atacantes"]
OCCUPANCY_TOP = 4

# --- fixed values: radar metrics, in column order --------------------------
RADAR_METRICS = [
    "Remates", "Goles", "xG", "OBV", "Tasa_Remate",
    "Outswinger", "Inswinger", "Corto", "Directo",
]


class Zone(NamedTuple):
    zona_nombre: str
    xmin: float
    xmax: float
    ymin: float
    ymax: float


# --- fixed values: delivery zones (closed rectangles) ----------------------
ZONES = [
    Zone("Primer Poste - Área Chica", 114.0, 120.0, 0.0, 20.0),
    Zone("Centro - Área Chica", 114.0, 120.0, 20.0, 60.0),
    Zone("Segundo Poste - Área Chica", 114.0, 120.0, 60.0, 80.0),
    Zone("Primer Poste - Área Grande", 102.0, 114.0, 0.0, 18.0),
    Zone("Zona Punto Penal", 102.0, 114.0, 18.0, 62.0),
    Zone("Segundo Poste - Área Grande", 102.0, 114.0, 62.0, 80.0),
    Zone("Borde del Área", 90.0, 102.0, 18.0, 62.0),
]
OTHER_ZONE = "Otra Zona"

# --- fixed values: team names in the feed -> display names ------------------
TEAM_NAMES = {
    "América": "Club América",
    "Juárez": "FC Juárez",
    "Mazatlán": "Mazatlán FC",
    "Necaxa": "Club Necaxa",
    "Tijuana": "Club Tijuana",
    "León": "Club León",
    "Puebla": "Club Puebla",
}

# --- fixed values: team -> address of its badge image ----------------------
LOGOS = {
    "América": "https://e01-mx-marca.uecdn.es/mx/assets/sports/logos/football/png/72x72/1292.png",
    "Atlas": "https://e01-mx-marca.uecdn.es/mx/assets/sports/logos/football/png/72x72/1284.png",
    "Atlético San Luis": "https://e01-mx-marca.uecdn.es/mx/assets/sports/logos/football/png/72x72/9491.png",
    "Cruz Azul": "https://e01-mx-marca.uecdn.es/mx/assets/sports/logos/football/png/72x72/853.png",
    "Guadalajara": "https://e01-mx-marca.uecdn.es/mx/assets/sports/logos/football/png/72x72/1283.png",
    "Juárez": "https://e01-mx-marca.uecdn.es/mx/assets/sports/logos/football/png/72x72/10991.png",
    "León": "https://e01-mx-marca.uecdn.es/mx/assets/sports/logos/football/png/72x72/1293.png",
    "Mazatlán": "https://e01-mx-marca.uecdn.es/mx/assets/sports/logos/football/png/72x72/16906.png",
    "Monterrey": "https://e01-mx-marca.uecdn.es/mx/assets/sports/logos/football/png/72x72/741.png",
    "Necaxa": "https://e01-mx-marca.uecdn.es/mx/assets/sports/logos/football/png/72x72/1174.png",
    "Pachuca": "https://e01-mx-marca.uecdn.es/mx/assets/sports/logos/football/png/72x72/1295.png",
    "Puebla": "https://e01-mx-marca.uecdn.es/mx/assets/sports/logos/football/png/72x72/1296.png",
    "Pumas UNAM": "https://e01-mx-marca.uecdn.es/mx/assets/sports/logos/football/png/72x72/1297.png",
    "Querétaro": "https://e01-mx-marca.uecdn.es/mx/assets/sports/logos/football/png/72x72/4047.png",
    "Santos Laguna": "https://e01-mx-marca.uecdn.es/mx/assets/sports/logos/football/png/72x72/1287.png",
    "Tigres UANL": "https://e01-mx-marca.uecdn.es/mx/assets/sports/logos/football/png/72x72/1294.png",
    "Tijuana": "https://e01-mx-marca.uecdn.es/mx/assets/sports/logos/football/png/72x72/4690.png",
    "Toluca": "https://e01-mx-marca.uecdn.es/mx/assets/sports/logos/football/png/72x72/1286.png",
}

# --- fixed values: pieces of a shot's hover text ----------------------------
TOOLTIP = {
    "match": "<b>Partido:</b> ",
    "versus": " vs ",
    "goal": "<b>GOL! de ",
    "goal_end": "</b><br>",
    "team": "<br><b>Equipo:</b> ",
    "date": "<br><b>Fecha:</b> ",
    "minute": "<br><b>Minuto:</b> ",
    "clock": ":",
    "taker": "<br><b>Ejecutó:</b> ",
    "shooter": "<br><b>Remató:</b> ",
    "xg": "<br><b>xG:</b> ",
    "xgot": "<br><b>xGoT:</b> ",
}

# --- fixed values: column names in the feed -> canonical names ---------------
EVENT_COLUMNS = {
    "id": "id",
    "match_id": "match_id",
    "possession": "possession",
    "timestamp": "ts",
    "minute": "minute",
    "second": "second",
    "type.name": "type_name",
    "play_pattern.name": "play_pattern",
    "team.id": "team_id",
    "team.name": "team_name",
    "player.name": "player_name",
    "location": "location",
    "pass.end_location": "pass_end_location",
    "pass.type.name": "pass_type",
    "pass.length": "pass_length",
    "pass.inswinging": "inswinging",
    "pass.outswinging": "outswinging",
    "shot.key_pass_id": "key_pass_id",
    "shot.outcome.name": "shot_outcome",
    "shot.type.name": "shot_type",
    "shot.statsbomb_xg": "xg",
    "shot.shot_execution_xg": "xgot",
    "shot.freeze_frame": "freeze_frame",
    "obv_total_net": "obv_total_net",
}

# --- fixed values: atomic match columns to keep; a feed may lack some of them ---
MATCH_KEEP = [
    "match_id", "match_date", "kick_off", "home_score", "away_score", "match_week",
    "competition.competition_id", "competition.competition_name",
    "season.season_id", "season.season_name",
    "home_team.home_team_id", "home_team.home_team_name",
    "away_team.away_team_id", "away_team.away_team_name",
    "stadium.name", "referee.name", "attendance",
    "behind_closed_doors", "neutral_ground", "collection_status",
    "play_status", "match_status", "match_status_360",
    "last_updated", "last_updated_360",
]
MATCH_FLAGS = ["behind_closed_doors", "neutral_ground"]
MATCH_COLUMNS = {
    "season.season_id": "season_id",
    "season.season_name": "season_name",
    "home_team.home_team_id": "home_team_id",
    "home_team.home_team_name": "home_team_name",
    "away_team.away_team_id": "away_team_id",
    "away_team.away_team_name": "away_team_name",
    "competition.competition_id": "competition_id",
    "competition.competition_name": "competition_name",
    "stadium.name": "stadium_name",
    "referee.name": "referee_name",
}

FREEZE_FRAME = T.ArrayType(
    T.StructType(
        [
            T.StructField("location", T.ArrayType(T.DoubleType())),
            T.StructField("teammate", T.BooleanType()),
        ]
    )
)

EVENTS = T.StructType(
    [
        T.StructField("id", T.StringType()),
        T.StructField("match_id", T.LongType()),
        T.StructField("possession", T.IntegerType()),
        T.StructField("ts", T.StringType()),
        T.StructField("minute", T.IntegerType()),
        T.StructField("second", T.IntegerType()),
        T.StructField("type_name", T.StringType()),
        T.StructField("play_pattern", T.StringType()),
        T.StructField("team_id", T.LongType()),
        T.StructField("team_name", T.StringType()),
        T.StructField("player_name", T.StringType()),
        T.StructField("location", T.ArrayType(T.DoubleType())),
        T.StructField("pass_end_location", T.ArrayType(T.DoubleType())),
        T.StructField("pass_type", T.StringType()),
        T.StructField("pass_length", T.DoubleType()),
        T.StructField("inswinging", T.BooleanType()),
        T.StructField("outswinging", T.BooleanType()),
        T.StructField("key_pass_id", T.StringType()),
        T.StructField("shot_outcome", T.StringType()),
        T.StructField("shot_type", T.StringType()),
        T.StructField("xg", T.DoubleType()),
        T.StructField("xgot", T.DoubleType()),
        T.StructField("freeze_frame", FREEZE_FRAME),
        T.StructField("obv_total_net", T.DoubleType()),
    ]
)


def feed_schema(columns: dict[str, str] = EVENT_COLUMNS, schema: T.StructType = EVENTS) -> T.StructType:
    """``schema`` under the column names of the feed, for an explicit-schema scan."""
    source_of = {canonical: source for source, canonical in columns.items()}
    return T.StructType([T.StructField(source_of[f.name], f.dataType) for f in schema])


def literal_table(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A small literal dimension. Inline VALUES gives Catalyst its true size, so
    joins with it are broadcast without a hint."""
    names, casts = zip(*(column.split() for column in schema.split(", ")))
    values = ", ".join(
        "(" + ", ".join("'" + v.replace("'", "\\'") + "'" if isinstance(v, str) else repr(v) for v in row) + ")"
        for row in rows
    )
    table = spark.sql(f"SELECT * FROM VALUES {values} AS t({', '.join(names)})")
    return table.select(*(table[n].cast(c).alias(n) for n, c in zip(names, casts)))


def zones_table(spark: SparkSession, zones: list[Zone] = ZONES) -> DataFrame:
    return literal_table(
        spark, list(zones), "zona_nombre string, xmin double, xmax double, ymin double, ymax double"
    )


def levels_table(spark: SparkSession) -> DataFrame:
    return literal_table(
        spark, list(enumerate(OCCUPANCY_LEVELS)), "categoria_orden int, categoria_atacantes string"
    )


def logos_table(spark: SparkSession, names: dict[str, str] = TEAM_NAMES) -> DataFrame:
    """Badge per team, under the harmonised names."""
    rows = [(names.get(team, team), url) for team, url in LOGOS.items()]
    return literal_table(spark, rows, "team_name string, logo_url string")
