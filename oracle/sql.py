"""One DuckDB statement per registered query, over the driver's own tables.

Written independently of the Spark plans: row-level joins, de-duplication and
windows where the plans pre-aggregate.
"""

from __future__ import annotations

import math

SEASON = "2022/2023"
TEAM = "Club NATION_5"
TEAM_PATTERN = "NATION_(1|5)$"
CELLS = 100

_BASE = """
nat AS (
  SELECT n_nationkey, CASE WHEN n_name IN ('NATION_1', 'NATION_5', 'NATION_12')
         THEN 'Club ' || n_name ELSE n_name END AS n_name
  FROM nation),
raw AS (
  SELECT event_id AS id, CASE WHEN user_id % 9 = 4 THEN -user_id ELSE user_id END AS match_id, user_id, ts, CAST(extract(day FROM ts) AS INTEGER) AS possession,
         CAST(json_extract_string(props, '$.k') AS INTEGER) AS k, value,
         event_type = 'click' AS is_corner, event_type = 'purchase' AS is_shot
  FROM events),
ev AS (
  SELECT raw.id, match_id, ts, possession,
    CAST((user_id * 3 + (possession % 2) * 7) % 25 AS INTEGER) AS team_id,
    nat.n_name AS team_name,
    CAST(id % 90 AS INTEGER) AS minute, CAST(id % 60 AS INTEGER) AS second,
    CASE WHEN id % 37 <> 0 THEN 'P' || CAST(id % 37 AS VARCHAR) END AS player_name,
    CASE WHEN is_corner THEN 'Pass' WHEN is_shot THEN 'Shot' ELSE 'Other' END AS type_name,
    CASE WHEN is_corner THEN 'Corner' END AS pass_type,
    CASE k % 6 WHEN 0 THEN 'From Corner' WHEN 1 THEN 'From Free Kick' WHEN 2 THEN 'From Throw-in'
               WHEN 4 THEN 'Regular Play' WHEN 5 THEN 'Regular Play' END AS play_pattern,
    CASE WHEN is_corner AND k % 13 <> 0 THEN CAST(k AS DOUBLE) END AS pass_length,
    CASE WHEN is_corner AND k % 3 = 0 THEN TRUE END AS inswinging,
    CASE WHEN is_corner AND k % 3 = 1 THEN TRUE END AS outswinging,
    CASE WHEN is_corner AND id % 29 <> 0 THEN CAST(90 + id * 7 % 31 AS DOUBLE) END AS end_x,
    CASE WHEN is_corner AND id % 29 <> 0 THEN CAST(id * 11 % 81 AS DOUBLE) END AS end_y,
    CASE WHEN is_corner THEN 120.0::DOUBLE END AS start_x,
    CASE WHEN is_corner THEN CAST(id % 2 * 80 AS DOUBLE) END AS start_y,
    CASE WHEN is_corner AND id % 11 <> 0 THEN (value - 50) / 1000 END AS obv_total_net,
    CASE WHEN is_shot AND id % 13 <> 0 THEN value / 500 END AS xg,
    CASE WHEN is_shot AND value > 30 THEN value / 400 END AS xgot,
    CASE WHEN is_shot AND value > 60 THEN 'Goal' WHEN is_shot AND k % 10 <> 0 THEN 'Saved' END AS shot_outcome,
    CASE WHEN is_shot AND k % 7 = 0 THEN 'Corner' WHEN is_shot THEN 'Open Play' END AS shot_type,
    id % 17 <> 0 AS has_frame,
    CASE WHEN is_shot THEN max(CASE WHEN is_corner THEN id END) OVER (
      PARTITION BY match_id, possession ORDER BY ts, id
      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) END AS key_pass_id,
    CASE WHEN is_corner AND k % 13 <> 0 AND k < 25 THEN 'Corto' WHEN is_corner AND k % 3 = 0 THEN 'Inswinger'
         WHEN is_corner AND k % 3 = 1 THEN 'Outswinger' WHEN is_corner THEN 'Directo/Otro' END AS tipo_cobro
  FROM raw LEFT JOIN nat ON nat.n_nationkey = (user_id * 3 + (possession % 2) * 7) % 25),
partidos AS (
  SELECT o_orderkey AS match_id, CAST(o_orderdate AS DATE) AS fecha,
    CASE WHEN o_orderkey % 19 = 0 THEN NULL WHEN o_orderkey % 4 = 0 THEN '2021/2022'
         WHEN o_orderkey % 4 = 1 THEN '2022/2023' WHEN o_orderkey % 4 = 2 THEN '2023/2024'
         ELSE '2024/2025' END AS temporada,
    h.n_name AS equipo_local, a.n_name AS equipo_visitante,
    CASE WHEN o_orderkey % 11 = 0 THEN 'processing' WHEN o_orderkey % 13 = 0 THEN NULL
         ELSE 'available' END AS match_status_360
  FROM orders JOIN nat h ON h.n_nationkey = (o_orderkey * 3) % 25
              JOIN nat a ON a.n_nationkey = (o_orderkey * 3 + 7) % 25),
logos AS (
  SELECT n_name AS team_name, 'img/' || CAST(n_nationkey AS VARCHAR) AS logo_url
  FROM nat WHERE n_nationkey % 9 <> 0),
zonas(zona_nombre, xmin, xmax, ymin, ymax) AS (VALUES
  ('Primer Poste - Área Chica', 114::DOUBLE, 120::DOUBLE, 0::DOUBLE, 20::DOUBLE),
  ('Centro - Área Chica', 114, 120, 20, 60),
  ('Segundo Poste - Área Chica', 114, 120, 60, 80),
  ('Primer Poste - Área Grande', 102, 114, 0, 18),
  ('Zona Punto Penal', 102, 114, 18, 62),
  ('Segundo Poste - Área Grande', 102, 114, 62, 80),
  ('Borde del Área', 90, 102, 18, 62)),
niveles(categoria_orden, categoria_atacantes) AS (VALUES
  (0, '0 Atacantes'), (1, '1 Atacantes'), (2, '2 Atacantes'), (3, '3 Atacantes'), (4, '4+ Atacantes')),
corners AS (SELECT * FROM ev WHERE pass_type = 'Corner'),
jugadores AS (
  SELECT l_orderkey AS id,
    (108 + CAST(floor(l_quantity) AS INTEGER) % 13 >= 114)
    AND (CASE WHEN l_partkey % 97 <> 0 THEN 25 + l_suppkey % 31 END >= 30)
    AND (CASE WHEN l_partkey % 97 <> 0 THEN 25 + l_suppkey % 31 END <= 50)
    AND l_returnflag <> 'N' AS dentro
  FROM lineitem),
remates AS (
  SELECT s.* FROM ev s
  WHERE s.type_name = 'Shot' AND s.has_frame AND s.key_pass_id IN (SELECT id FROM corners)),
conteo AS (
  SELECT r.id,
    CASE WHEN count(*) FILTER (j.dentro IS NULL) = 0
         THEN count(*) FILTER (j.dentro) END AS atacantes_en_area_chica,
    any_value(r.shot_outcome) = 'Goal' AS fue_gol
  FROM remates r JOIN jugadores j ON j.id = r.id GROUP BY r.id),
categorias AS (
  SELECT *,
    CASE WHEN atacantes_en_area_chica >= 4 THEN '4+ Atacantes'
         ELSE CAST(atacantes_en_area_chica AS VARCHAR) || ' Atacantes' END AS categoria_atacantes,
    CAST(least(atacantes_en_area_chica, CASE WHEN atacantes_en_area_chica IS NOT NULL THEN 4 END) AS INTEGER)
      AS categoria_orden
  FROM conteo),
remates_cat AS (
  SELECT r.*, c.atacantes_en_area_chica, c.fue_gol, c.categoria_atacantes, c.categoria_orden, p.temporada
  FROM remates r LEFT JOIN categorias c ON c.id = r.id LEFT JOIN partidos p ON p.match_id = r.match_id),
base AS (
  SELECT r.id, r.match_id, r.key_pass_id, r.team_name AS equipo_atacante, r.player_name AS rematador,
    r.minute AS minuto, r.second AS segundo, r.xg AS "xG", r.xgot AS "xGoT",
    p.fecha, p.equipo_local, p.equipo_visitante, p.temporada, k.player_name AS ejecutor,
    c.categoria_atacantes, c.categoria_orden, k.start_x, k.start_y, k.end_x, k.end_y,
    r.shot_outcome = 'Goal' AS fue_gol
  FROM remates r LEFT JOIN partidos p ON p.match_id = r.match_id
  LEFT JOIN corners k ON k.id = r.key_pass_id
  JOIN categorias c ON c.id = r.id WHERE c.categoria_atacantes IS NOT NULL),
resultados AS (
  SELECT r.key_pass_id AS corner_id, coalesce(c.fue_gol, FALSE) AS fue_gol, r.xg
  FROM remates r LEFT JOIN conteo c ON c.id = r.id),
cobros AS (
  SELECT k.id, k.match_id, k.team_name, k.tipo_cobro, k.obv_total_net,
    coalesce(x.fue_gol, FALSE) AS fue_gol, x.corner_id IS NOT NULL AS termino_en_remate
  FROM corners k LEFT JOIN resultados x ON x.corner_id = k.id),
cobros_t AS (
  SELECT c.*, p.temporada FROM cobros c LEFT JOIN partidos p ON p.match_id = c.match_id),
puntos AS (
  SELECT k.id, k.match_id, k.team_name, k.tipo_cobro, k.end_x, k.end_y, p.temporada
  FROM corners k LEFT JOIN partidos p ON p.match_id = k.match_id
  WHERE k.end_x IS NOT NULL AND p.temporada IS NOT NULL),
en_zona AS (
  SELECT p.*, coalesce(z.zona_nombre, 'Otra Zona') AS zona_nombre
  FROM puntos p LEFT JOIN zonas z ON p.end_x >= z.xmin AND p.end_x <= z.xmax
                                 AND p.end_y >= z.ymin AND p.end_y <= z.ymax),
secuencias AS (
  SELECT DISTINCT c.id, c.ts, c.match_id, c.possession, c.team_id, c.team_name
  FROM corners c JOIN ev g ON g.match_id = c.match_id AND g.possession = c.possession
    AND g.team_id = c.team_id AND g.team_name = c.team_name
    AND g.shot_outcome = 'Goal' AND g.ts > c.ts),
metricas AS (
  SELECT c.temporada, c.team_name,
    count(*) FILTER (c.termino_en_remate) AS "Remates",
    count(*) FILTER (c.fue_gol) AS "Goles",
    coalesce(sum(c.obv_total_net), 0) AS "OBV",
    avg(CAST(c.termino_en_remate AS DOUBLE)) AS "Tasa_Remate",
    avg(CASE WHEN c.tipo_cobro = 'Outswinger' THEN 1.0::DOUBLE ELSE 0 END) AS "Outswinger",
    avg(CASE WHEN c.tipo_cobro = 'Inswinger' THEN 1.0::DOUBLE ELSE 0 END) AS "Inswinger",
    avg(CASE WHEN c.tipo_cobro = 'Corto' THEN 1.0::DOUBLE ELSE 0 END) AS "Corto",
    avg(CASE WHEN c.tipo_cobro = 'Directo/Otro' THEN 1.0::DOUBLE ELSE 0 END) AS "Directo"
  FROM cobros_t c WHERE c.temporada IS NOT NULL GROUP BY c.temporada, c.team_name),
xg_equipo AS (
  SELECT p.temporada, k.team_name, coalesce(sum(x.xg), 0) AS "xG"
  FROM corners k JOIN partidos p ON p.match_id = k.match_id LEFT JOIN resultados x ON x.corner_id = k.id
  WHERE p.temporada IS NOT NULL GROUP BY p.temporada, k.team_name),
equipo_temporada AS (
  SELECT m.temporada, m.team_name, "Remates", "Goles", "xG", "OBV", "Tasa_Remate",
         "Outswinger", "Inswinger", "Corto", "Directo"
  FROM metricas m JOIN xg_equipo x ON x.temporada = m.temporada AND x.team_name = m.team_name),
minutos AS (
  SELECT temporada, team_name, count(*) * 90 AS minutos_totales FROM (
    SELECT temporada, equipo_local AS team_name FROM partidos
    UNION ALL SELECT temporada, equipo_visitante FROM partidos)
  GROUP BY temporada, team_name),
ocasiones AS (
  SELECT p.temporada, e.team_name,
    count(*) FILTER (e.play_pattern IN ('From Corner', 'From Free Kick', 'From Throw-in')) AS ocasiones_abp,
    count(*) AS ocasiones_totales
  FROM ev e LEFT JOIN partidos p ON p.match_id = e.match_id
  WHERE e.type_name = 'Shot' GROUP BY p.temporada, e.team_name),
dependencia AS (
  SELECT o.temporada, o.team_name, o.ocasiones_abp, o.ocasiones_totales, m.minutos_totales,
    (o.ocasiones_abp / m.minutos_totales) * 90 AS ocasiones_abp_por_90,
    o.ocasiones_abp / o.ocasiones_totales AS pct_ocasiones_abp
  FROM ocasiones o JOIN minutos m
    ON m.temporada IS NOT DISTINCT FROM o.temporada AND m.team_name = o.team_name)
"""

_METRICS = ["Remates", "Goles", "xG", "OBV", "Tasa_Remate", "Outswinger", "Inswinger", "Corto", "Directo"]

_PERCENTILES = """
percentiles AS (SELECT temporada, team_name, {columns} FROM equipo_temporada WHERE "Remates" > 0)
""".format(
    columns=", ".join(
        f"""CASE WHEN count("{m}") OVER (PARTITION BY temporada) > 1 THEN round_even(100 *
            percent_rank() OVER (PARTITION BY temporada ORDER BY "{m}"), 0) END AS "{m}" """
        for m in _METRICS
    )
)

_RADAR_LONG = (
    "radares AS ("
    + " UNION ALL ".join(
        f"""SELECT p.temporada, p.team_name, l.logo_url, '{m}' AS metrica, {i + 1} AS metrica_orden,
            p."{m}" AS valor_percentil FROM percentiles p JOIN logos l ON l.team_name = p.team_name"""
        for i, m in enumerate(_METRICS)
    )
    + ")"
)


def _number(value: str, digits: int) -> str:
    """Text of a rounded number without trailing zeros."""
    return (
        f"coalesce(regexp_replace(CAST(CAST(round_even(CAST({value} AS DECIMAL(18, 8)), {digits}) "
        f"AS DECIMAL(18, {digits})) AS VARCHAR), '\\.?0+$', ''), 'NA')"
    )


def _number4(value: str) -> str:
    """The same at four digits, where a single digit at the fourth place prints
    in its shorter scientific form (6e-04)."""
    rounded = f"round_even(CAST({value} AS DECIMAL(18, 8)), 4)"
    return (
        f"CASE WHEN {rounded} <> 0 AND abs({rounded}) < 0.001 "
        f"THEN CAST(CAST({rounded} * 10000 AS INTEGER) AS VARCHAR) || 'e-04' ELSE {_number(value, 4)} END"
    )


def _percent(value: str) -> str:
    return f"printf('%.1f%%', round_even({value} * 1000, 0) / 10)"


def _tooltip(goal: bool) -> str:
    match = "'<b>Partido:</b> ' || coalesce(equipo_local, 'NA') || ' vs ' || coalesce(equipo_visitante, 'NA')"
    if goal:
        head = f"'<b>GOL! de ' || coalesce(equipo_atacante, 'NA') || '</b>' || '<br>' || {match}"
    else:
        head = f"{match} || '<br><b>Equipo:</b> ' || coalesce(equipo_atacante, 'NA')"
    return f"""{head}
      || '<br><b>Fecha:</b> ' || coalesce(CAST(fecha AS VARCHAR), 'NA')
      || '<br><b>Minuto:</b> ' || CAST(minuto AS VARCHAR) || ':' || printf('%02d', segundo)
      || '<br><b>Ejecutó:</b> ' || coalesce(ejecutor, 'NA')
      || '<br><b>Remató:</b> ' || coalesce(rematador, 'NA')
      || '<br><b>xG:</b> ' || {_number('"xG"', 2)}
      || CASE WHEN "xGoT" IS NOT NULL THEN '<br><b>xGoT:</b> ' || {_number('"xGoT"', 2)} ELSE '' END"""


def _titled(source: str, by: str, noun: str, goal: bool) -> str:
    return f"""SELECT b.*, categoria_atacantes || chr(10) || '(N = ' || CAST(n AS VARCHAR) || ' {noun})'
      AS titulo_facet, {_tooltip(goal)} AS tooltip_text
    FROM (SELECT *, count(*) OVER (PARTITION BY {by}) AS n FROM ({source})) b"""


def _statement(body: str, *more: str) -> str:
    return "WITH " + ", ".join([_BASE, *more]) + "\n" + body


_LEVEL = "categoria_atacantes, categoria_orden"
_EV_SCALARS = """id, match_id, ts, possession, team_id, team_name, minute, second, player_name, type_name,
  pass_type, play_pattern, pass_length, inswinging, outswinging, end_x, end_y, start_x, start_y,
  obv_total_net, xg, xgot, shot_outcome, shot_type, has_frame, key_pass_id"""

_LEVEL_TOTALS = """count(*) AS total_remates, coalesce(sum(xg), 0) AS "xG_total",
  count(*) FILTER (fue_gol) AS total_goles"""


def _metrics_long(source: str, ids: str, names: list[str]) -> str:
    return " UNION ALL ".join(
        f"""SELECT {ids}, '{m}' AS metrica, {i + 1} AS metrica_orden, CAST("{m}" AS DOUBLE) AS valor FROM {source}"""
        for i, m in enumerate(names)
    )


_OCC = ["total_remates", "xG_total", "total_goles"]
_EFFECT = ["tasa_de_remate", "tasa_de_gol_por_corner", "valor_promedio_obv"]

_DELIVERY = """efectividad AS (
  SELECT tipo_cobro, count(*) AS total_corners, avg(CAST(termino_en_remate AS DOUBLE)) AS tasa_de_remate,
    avg(CAST(fue_gol AS DOUBLE)) AS tasa_de_gol_por_corner, avg(obv_total_net) AS valor_promedio_obv
  FROM cobros GROUP BY tipo_cobro)"""


def _profile(min_corners: int, rescale_first: bool) -> tuple[str, str]:
    rates = f"""tasas AS (
      SELECT temporada, team_name, tipo_cobro, count(*) AS total_corners_temporada,
        avg(CAST(termino_en_remate AS DOUBLE)) AS tasa_de_remate
      FROM cobros_t WHERE temporada IS NOT NULL GROUP BY temporada, team_name, tipo_cobro
      HAVING count(*) > {min_corners})"""
    joined = "tasas t JOIN logos l USING (team_name)"
    scaled = """SELECT *, CASE WHEN max(tasa_de_remate) OVER w = min(tasa_de_remate) OVER w THEN 0.5
        ELSE (tasa_de_remate - min(tasa_de_remate) OVER w)
             / (max(tasa_de_remate) OVER w - min(tasa_de_remate) OVER w) END AS tasa_normalizada
      FROM {source} WINDOW w AS (PARTITION BY temporada, tipo_cobro)"""
    if rescale_first:
        inner = f"SELECT * FROM ({scaled.format(source='tasas')}) s JOIN logos l USING (team_name)"
    else:
        inner = scaled.format(source=f"(SELECT * FROM {joined})")
    body = f"""SELECT temporada, team_name, tipo_cobro, total_corners_temporada, tasa_de_remate, logo_url,
      CAST(tasa_normalizada AS DOUBLE) AS tasa_normalizada,
      '<img src=''' || logo_url || ''' width=''20''/> ' || team_name AS facet_title,
      {_percent('tasa_de_remate')} AS etiqueta FROM ({inner})"""
    return body, rates


_TACTICAL = _profile(5, False)
_TACTICAL_BATCH = _profile(5, True)

_RATIO = """SELECT team_name, total_corners, {goals}, total_corners / {goals} AS corners_por_gol,
  printf('%.2f', total_corners / {goals}) AS etiqueta, logo_url
  FROM ({totals}) LEFT JOIN logos USING (team_name) WHERE {goals} > 0"""
_RATIO_T = _RATIO.replace("SELECT team_name", "SELECT temporada, team_name")


def _density(by: str, source: str, panel: str) -> tuple[str, ...]:
    """Direct double sum over points and grid, unlike the separable Spark plan."""
    step = f"{120.0 / (CELLS - 1)!r}, {80.0 / (CELLS - 1)!r}".split(", ")
    width = "1.06 * least(stddev_samp({c}), (quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25)) / 1.34)"
    hx, hy = (f"({width.format(c=c)}) * pow(count(*), -0.2)" for c in ("end_x", "end_y"))
    return (
        f"pts AS ({source})",
        f"""anchos AS (SELECT {by}, count(*) AS n,
          CASE WHEN {hx} > 0 THEN {hx} ELSE {step[0]}::DOUBLE END AS hx,
          CASE WHEN {hy} > 0 THEN {hy} ELSE {step[1]}::DOUBLE END AS hy FROM pts GROUP BY {by})""",
        f"""nodos AS (SELECT i * {step[0]}::DOUBLE AS grid_x, j * {step[1]}::DOUBLE AS grid_y
          FROM range({CELLS}) a(i), range({CELLS}) b(j))""",
        f"""densidades AS (SELECT {by}, grid_x, grid_y,
          sum(exp(-0.5 * (pow((grid_x - end_x) / hx, 2) + pow((grid_y - end_y) / hy, 2))))
            / any_value(2 * {math.pi!r}::DOUBLE * n * hx * hy) AS densidad
          FROM pts JOIN anchos USING ({by}), nodos GROUP BY {by}, grid_x, grid_y)""",
        f"""pasos AS (SELECT panel, CASE WHEN 10 * b - c < 1.5 * (c - 5 * b) THEN 10 * b
            WHEN 5 * b - c < 2.75 * (c - 2 * b) THEN 5 * b
            WHEN 2 * b - c < 1.5 * (c - b) THEN 2 * b ELSE b END AS paso
          FROM (SELECT panel, c, pow(10, floor(log10(c))) AS b FROM (
            SELECT {panel} AS panel, (max(densidad) - min(densidad)) / 10 AS c FROM densidades GROUP BY 1)))""",
    )


_HEAT = _density("team_name", "SELECT team_name, end_x, end_y FROM puntos", "1")
_HEAT_SEASON = _density(
    "temporada, team_name",
    "SELECT temporada, team_name, end_x, end_y FROM puntos SEMI JOIN logos USING (team_name)",
    "temporada",
)


def _heat_body(by: str, on: str) -> str:
    return f"""SELECT {by}, round(grid_x, 9) AS grid_x, round(grid_y, 9) AS grid_y,
      round(densidad, 12) AS densidad, round(floor(densidad / paso) * paso, 12) AS nivel
      FROM densidades JOIN pasos ON {on}"""


_NESTED = (
    """jugadores_n AS (
      SELECT e.id, i, 108 + (id * 5 + i * 3) % 13 >= 114 AND (id + i) % 3 <> 0
        AND CASE WHEN (id + i) % 31 <> 0 THEN 25 + (id * 7 + i * 11) % 31 BETWEEN 30 AND 50 END AS dentro
      FROM ev e, unnest(range(1, e.id % 6 + 1)) AS u(i) WHERE e.has_frame)""",
    """conteo_n AS (
      SELECT r.id, CASE WHEN count(*) FILTER (j.dentro IS NULL) = 0 THEN count(*) FILTER (j.dentro) END
          AS atacantes_en_area_chica, any_value(r.shot_outcome) = 'Goal' AS fue_gol
      FROM remates r JOIN jugadores_n j ON j.id = r.id GROUP BY r.id)""",
)

_LANDED = """SELECT e.event_id, e.user_id AS match_id, e.event_type, p.temporada AS season_name
    FROM events e JOIN partidos p ON p.match_id = e.user_id
    WHERE p.match_status_360 = 'available' AND e.user_id % 9 <> 4"""

STATEMENTS: dict[str, str] = {
    # --- scans, sinks, projection ---
    "scan_events": _statement(f"SELECT {_EV_SCALARS} FROM ev"),
    "materialize_roundtrip": _statement(
        "SELECT id, match_id, team_name, tipo_cobro, obv_total_net, fue_gol, termino_en_remate FROM cobros"
    ),
    "snapshot_refresh": _statement(
        "SELECT id, match_id, team_name, tipo_cobro, obv_total_net, fue_gol, termino_en_remate FROM cobros"
    ),
    "ingest_pending_matches": _statement(
        """SELECT match_id, temporada AS season_name, match_status_360 FROM partidos p
        WHERE match_status_360 = 'available'
          AND (match_id % 2 = 1 OR NOT EXISTS (SELECT 1 FROM ev e WHERE e.match_id = p.match_id))"""
    ),
    "ingest_landing": _statement(_LANDED),
    "ingest_quarantine": _statement(f"{_LANDED} AND p.match_id % 2 = 0"),
    "ingest_repaired": _statement(_LANDED),
    "match_through_index": _statement(
        f"SELECT * FROM ({_LANDED} AND p.match_id % 2 = 0) WHERE match_id = (SELECT min(match_id) FROM ({_LANDED} AND p.match_id % 2 = 0))"
    ),
    "glob_scan": _statement(
        "SELECT CAST(e.id AS VARCHAR) AS id, e.match_id, n.n_name AS team_name, e.pass_length FROM corners e JOIN nation n ON n.n_nationkey = e.team_id"
    ),
    "season_scan": _statement(
        f"""SELECT CAST(id AS VARCHAR) AS id, match_id, type_name, temporada AS season_name FROM ev JOIN partidos USING (match_id)
        WHERE temporada = '{SEASON}'"""
    ),
    "period_scan": _statement(
        """SELECT CAST(id AS VARCHAR) AS id, match_id, type_name, temporada AS season_name FROM ev JOIN partidos USING (match_id)
        WHERE fecha BETWEEN DATE '1995-06-01' AND DATE '1995-08-31'"""
    ),
    "stream_landing": _statement(_LANDED),
    "stream_then_ingest": _statement(_LANDED),
    "feed_scan": _statement(
        """SELECT CAST(id AS VARCHAR) AS id, match_id, team_name, type_name, pass_type,
          CAST(key_pass_id AS VARCHAR) AS key_pass_id, xg, shot_outcome, CASE WHEN has_frame THEN id % 6 END AS jugadores
        FROM ev"""
    ),
    "box_occupancy_nested": _statement(
        "SELECT CAST(id AS VARCHAR) AS id, atacantes_en_area_chica, fue_gol FROM conteo_n", *_NESTED
    ),
    "corner_outcomes_nested": _statement(
        """SELECT CAST(k.id AS VARCHAR) AS id, k.match_id, k.team_name, k.tipo_cobro, k.obv_total_net,
          coalesce(c.fue_gol, FALSE) AS fue_gol, r.id IS NOT NULL AS termino_en_remate
        FROM corners k LEFT JOIN remates r ON r.key_pass_id = k.id LEFT JOIN conteo_n c ON c.id = r.id""",
        *_NESTED,
    ),
    "season_roundtrip": _statement(
        f"""SELECT id, match_id, type_name, temporada AS season_name FROM ev JOIN partidos USING (match_id)
        WHERE temporada = '{SEASON}'"""
    ),
    "catalogue_seasons": """SELECT o_orderkey % 7 AS competition_id, o_orderkey AS season_id,
        o_orderstatus AS competition_name, strftime(o_orderdate, '%Y-%m-%d') AS season_name
        FROM orders WHERE o_orderpriority = '1-URGENT' AND o_orderstatus = 'F'""",
    "first_corners": _statement(
        """SELECT id, match_id, ts, team_name, row_number() OVER (ORDER BY match_id, ts, id) AS puesto
        FROM corners ORDER BY match_id, ts, id LIMIT 25"""
    ),
    "dim_zones": _statement(
        """SELECT zona_nombre, xmin, xmax, ymin, ymax, (xmin + xmax) / 2 AS centro_x, (ymin + ymax) / 2 AS centro_y,
        n AS total_en_zona FROM zonas LEFT JOIN (SELECT zona_nombre, count(*) AS n FROM en_zona GROUP BY 1)
        USING (zona_nombre)"""
    ),
    "project_any_of": "SELECT o_orderkey AS match_id, o_orderstatus AS behind_closed_doors, "
    "CASE o_orderstatus WHEN 'O' THEN 'true' WHEN 'F' THEN 'False' ELSE 'unknown' END AS neutral_ground FROM orders",
    "cast_flags": "SELECT o_orderkey AS match_id, CASE WHEN o_orderstatus = 'F' THEN FALSE END AS behind_closed_doors, "
    "CASE o_orderstatus WHEN 'O' THEN TRUE WHEN 'F' THEN FALSE END AS neutral_ground FROM orders",
    "distinct_team_season": _statement(
        "SELECT DISTINCT temporada, team_name FROM corners LEFT JOIN partidos USING (match_id)"
    ),
    "selector_domain": _statement("SELECT DISTINCT team_name FROM ev WHERE team_name IS NOT NULL"),
    "radar_teams": _statement('SELECT DISTINCT team_name FROM equipo_temporada WHERE "Remates" > 0'),
    "harmonize_names": _statement(
        """SELECT e.team_name, p.equipo_local AS home_team_name, p.equipo_visitante AS away_team_name,
        count(*) AS eventos FROM ev e JOIN partidos p ON p.match_id = e.match_id GROUP BY ALL"""
    ),
    # --- filters and joins ---
    "corner_events": _statement(
        """SELECT id, match_id, team_name, player_name, pass_length, inswinging, outswinging, end_x, end_y
        FROM corners"""
    ),
    "shots_with_freeze_frame": _statement(
        "SELECT id, match_id, team_name, key_pass_id, shot_outcome FROM ev WHERE type_name = 'Shot' AND has_frame"
    ),
    "corner_assisted_shots": _statement(
        "SELECT id, match_id, team_name, key_pass_id, shot_outcome, xg FROM remates"
    ),
    "set_piece_flag": _statement(
        """SELECT id, match_id, team_name, coalesce(play_pattern IN ('From Corner', 'From Free Kick',
        'From Throw-in'), FALSE) AS es_balon_parado FROM ev WHERE type_name = 'Shot'"""
    ),
    "season_filter": _statement(
        f"""SELECT id, match_id, team_name, temporada FROM corners JOIN partidos USING (match_id)
        WHERE temporada = '{SEASON}'"""
    ),
    "team_regex_filter": _statement(
        f"SELECT id, match_id, team_name FROM corners WHERE regexp_matches(team_name, '{TEAM_PATTERN}')"
    ),
    "events_with_season": _statement(
        "SELECT id, match_id, type_name, team_name, temporada FROM ev LEFT JOIN partidos USING (match_id)"
    ),
    "shot_to_corner": _statement(
        """SELECT r.id, r.key_pass_id, k.player_name AS ejecutor, k.start_x, k.start_y, k.end_x, k.end_y
        FROM remates r LEFT JOIN corners k ON k.id = r.key_pass_id"""
    ),
    "shots_with_category": _statement(
        f"SELECT id, key_pass_id, atacantes_en_area_chica, fue_gol, {_LEVEL} FROM remates_cat"
    ),
    "with_logo": _statement(
        """SELECT temporada, team_name, ocasiones_abp_por_90, pct_ocasiones_abp, logo_url
        FROM dependencia JOIN logos USING (team_name)"""
    ),
    "teams_without_logo": _statement(
        "SELECT DISTINCT team_name FROM dependencia WHERE team_name NOT IN (SELECT team_name FROM logos)"
    ),
    # --- corners ---
    "box_occupancy": _statement("SELECT id, atacantes_en_area_chica, fue_gol FROM conteo"),
    "occupancy_category": _statement(
        f"SELECT id, atacantes_en_area_chica, fue_gol, {_LEVEL} FROM categorias"
    ),
    "enriched_shots": _statement("SELECT * FROM base"),
    "corner_outcomes": _statement(
        "SELECT id, match_id, team_name, tipo_cobro, obv_total_net, fue_gol, termino_en_remate FROM cobros"
    ),
    # --- occupancy ---
    "shots_by_occupancy": _statement(
        f"""SELECT {_LEVEL}, coalesce(n, 0) AS total_remates_generados FROM niveles LEFT JOIN (
          SELECT categoria_orden, count(*) AS n FROM categorias GROUP BY 1) USING (categoria_orden)
        UNION ALL SELECT NULL, NULL, count(*) FROM categorias WHERE categoria_orden IS NULL HAVING count(*) > 0"""
    ),
    "goal_rate_by_occupancy": _statement(
        f"""SELECT {_LEVEL}, count(*) AS total_remates,
          CASE WHEN count(*) FILTER (fue_gol IS NULL) = 0 THEN count(*) FILTER (fue_gol) END AS total_goles,
          CASE WHEN count(*) FILTER (fue_gol IS NULL) = 0 THEN count(*) FILTER (fue_gol) END / count(*) AS tasa_de_gol
        FROM categorias GROUP BY {_LEVEL}"""
    ),
    "goal_rate_by_occupancy_filled": _statement(
        f"""SELECT {_LEVEL}, coalesce(n, 0) AS total_remates, coalesce(g, 0) AS total_goles,
          coalesce(g / n, 0) AS tasa_de_gol FROM niveles LEFT JOIN (
          SELECT categoria_orden, count(*) AS n, count(*) FILTER (fue_gol) AS g FROM categorias GROUP BY 1)
          USING (categoria_orden)
        UNION ALL SELECT NULL, NULL, count(*), count(*) FILTER (fue_gol), count(*) FILTER (fue_gol) / count(*)
          FROM categorias WHERE categoria_orden IS NULL HAVING count(*) > 0"""
    ),
    "occupancy_comparison": _statement(
        _metrics_long("t", _LEVEL, _OCC),
        f"t AS (SELECT {_LEVEL}, {_LEVEL_TOTALS} FROM remates_cat WHERE categoria_orden IS NOT NULL GROUP BY {_LEVEL})",
    ),
    "occupancy_xg_summary": _statement(
        f"""SELECT {_LEVEL}, coalesce(total_remates, 0) AS total_remates, coalesce("xG_total", 0) AS "xG_total",
          coalesce(m, 0) AS "xG_promedio_por_remate", coalesce(total_goles, 0) AS total_goles
        FROM niveles LEFT JOIN (SELECT categoria_orden, {_LEVEL_TOTALS}, avg(xg) AS m
          FROM remates_cat WHERE categoria_orden IS NOT NULL GROUP BY 1) USING (categoria_orden)"""
    ),
    "occupancy_by_season": _statement(
        _metrics_long("t", f"temporada, {_LEVEL}", _OCC),
        f"""t AS (SELECT temporada, {_LEVEL}, {_LEVEL_TOTALS} FROM remates_cat
        WHERE categoria_orden IS NOT NULL AND temporada IS NOT NULL GROUP BY temporada, {_LEVEL})""",
    ),
    "goal_rate_by_season": _statement(
        f"""SELECT *, total_goles / total_remates AS tasa_de_gol,
          {_number('total_goles / total_remates * 100', 1)} || '%' AS etiqueta FROM t""",
        f"""t AS (SELECT temporada, {_LEVEL}, {_LEVEL_TOTALS} FROM remates_cat
        WHERE categoria_orden IS NOT NULL AND temporada IS NOT NULL GROUP BY temporada, {_LEVEL})""",
    ),
    "facet_counts": _statement(
        """SELECT id, categoria_atacantes, count(*) OVER (PARTITION BY categoria_atacantes) AS n,
        categoria_atacantes || chr(10) || '(N = ' || CAST(count(*) OVER (PARTITION BY categoria_atacantes) AS VARCHAR)
        || ' Remates)' AS titulo_facet FROM base"""
    ),
    "shot_tooltips": _statement(_titled("SELECT * FROM base", "categoria_atacantes", "Remates", False)),
    "goal_tooltips": _statement(_titled("SELECT * FROM base WHERE fue_gol", "categoria_atacantes", "Goles", True)),
    "shot_tooltips_by_season": _statement(
        _titled(
            "SELECT * FROM base WHERE temporada IS NOT NULL", "temporada, categoria_atacantes", "Remates", False
        )
    ),
    "goal_tooltips_by_season": _statement(
        _titled(
            "SELECT * FROM base WHERE fue_gol AND temporada IS NOT NULL",
            "temporada, categoria_atacantes",
            "Goles",
            True,
        )
    ),
    # --- delivery ---
    "delivery_summary": _statement("SELECT * FROM efectividad", _DELIVERY),
    "delivery_effectiveness": _statement(
        f"""SELECT *, CASE WHEN metrica = 'valor_promedio_obv' THEN {_number4('valor')}
        ELSE {_percent('valor')} END AS etiqueta FROM largo""",
        _DELIVERY,
        f"largo AS ({_metrics_long('efectividad', 'tipo_cobro', _EFFECT)})",
    ),
    "tactical_profile": _statement(*_TACTICAL),
    "tactical_profile_batch": _statement(*_TACTICAL_BATCH),
    "team_season_metrics": _statement("SELECT * FROM equipo_temporada"),
    "team_xg_from_corners": _statement(
        'SELECT temporada, team_name, 0.0::DOUBLE AS "xG_as_written", "xG" AS "xG_linked" FROM equipo_temporada'
    ),
    "delivery_mix": _statement(
        'SELECT temporada, team_name, "Outswinger", "Inswinger", "Corto", "Directo" FROM equipo_temporada'
    ),
    "percentile_profile": _statement("SELECT * FROM percentiles", _PERCENTILES),
    "percentile_profile_as_written": _statement(
        "SELECT * FROM percentiles", _PERCENTILES.replace(
            "FROM equipo_temporada", 'FROM (SELECT * REPLACE (0.0::DOUBLE AS "xG") FROM equipo_temporada)'
        )
    ),
    "team_radars": _statement("SELECT * FROM radares", _PERCENTILES, _RADAR_LONG),
    "team_radar": _statement(
        f"SELECT * FROM radares WHERE temporada = '{SEASON}' AND team_name = '{TEAM}'", _PERCENTILES, _RADAR_LONG
    ),
    "rate_labels": _statement(
        f"""SELECT temporada, team_name, {_percent('"Tasa_Remate"')} AS etiqueta_fija,
        {_number('"Tasa_Remate" * 100', 1)} || '%' AS etiqueta_corta FROM equipo_temporada"""
    ),
    "safe_name": _statement(
        """SELECT temporada, team_name, replace(temporada, '/', '-') || '_' || replace(team_name, '/', '-')
        AS nombre_seguro FROM equipo_temporada"""
    ),
    # --- spatial ---
    "delivery_points": _statement("SELECT team_name, temporada, end_x, end_y FROM puntos"),
    "delivery_heatmap": _statement(_heat_body("team_name", "TRUE"), *_HEAT),
    "delivery_heatmap_by_season": _statement(
        _heat_body("densidades.temporada, team_name", "densidades.temporada = pasos.panel"), *_HEAT_SEASON
    ),
    "zone_assignment": _statement(
        "SELECT match_id, team_name, tipo_cobro, end_x, end_y, temporada, zona_nombre FROM en_zona"
    ),
    "region_assignment": _statement(
        """SELECT k.id, k.team_name, k.end_x, k.end_y, coalesce(z.zona_nombre, 'Otra Zona') AS zona_nombre
        FROM corners k LEFT JOIN regiones z ON k.end_x BETWEEN z.xmin AND z.xmax AND k.end_y BETWEEN z.ymin AND z.ymax""",
        """regiones AS (
          SELECT 'Z' || CAST(s_suppkey AS VARCHAR) AS zona_nombre, 60 + s_suppkey * 7 % 53 AS xmin,
            CASE WHEN s_suppkey % 23 <> 0 THEN 60 + s_suppkey * 7 % 53 + s_suppkey % 9 END AS xmax,
            s_suppkey * 11 % 71 AS ymin, s_suppkey * 11 % 71 + (s_suppkey % 5) / 2 AS ymax FROM supplier)""",
    ),
    "zone_map": _statement(
        f"""SELECT z.*, (xmin + xmax) / 2 AS centro_x, (ymin + ymax) / 2 AS centro_y,
          c.team_name, c.tipo_cobro, c.total_en_zona
        FROM zonas z LEFT JOIN (SELECT zona_nombre, team_name, tipo_cobro, count(*) AS total_en_zona FROM en_zona
          WHERE team_name = '{TEAM}' GROUP BY ALL) c ON c.zona_nombre = z.zona_nombre
        WHERE EXISTS (SELECT 1 FROM corners WHERE team_name = '{TEAM}')"""
    ),
    "zone_map_of_no_team": _statement(
        """SELECT z.*, (xmin + xmax) / 2 AS centro_x, (ymin + ymax) / 2 AS centro_y,
          NULL AS team_name, NULL AS tipo_cobro, NULL AS total_en_zona FROM zonas z WHERE FALSE"""
    ),
    "zone_counts": _statement(
        """SELECT z.*, (xmin + xmax) / 2 AS centro_x, (ymin + ymax) / 2 AS centro_y, temporada, team_name,
          tipo_cobro, total_en_zona, logo_url
        FROM zonas z JOIN (SELECT temporada, team_name, tipo_cobro, zona_nombre, count(*) AS total_en_zona
          FROM en_zona GROUP BY ALL) c ON c.zona_nombre = z.zona_nombre JOIN logos USING (team_name)"""
    ),
    # --- ratios ---
    "corners_per_goal": _statement(
        _RATIO.format(
            goals="total_goles_de_corner",
            totals="""SELECT team_name, count(*) AS total_corners, count(*) FILTER (fue_gol) AS total_goles_de_corner
            FROM cobros GROUP BY 1""",
        )
    ),
    "corners_per_goal_one_season": _statement(
        _RATIO.format(
            goals="total_goles_de_corner",
            totals=f"""SELECT team_name, count(*) AS total_corners, count(*) FILTER (fue_gol) AS total_goles_de_corner
            FROM cobros_t WHERE temporada = '{SEASON}' GROUP BY 1""",
        )
    ),
    "corners_per_goal_by_season": _statement(
        _RATIO_T.format(
            goals="total_goles_de_corner",
            totals="""SELECT temporada, team_name, count(*) AS total_corners,
            count(*) FILTER (fue_gol) AS total_goles_de_corner
            FROM cobros_t WHERE temporada IS NOT NULL GROUP BY 1, 2""",
        )
    ),
    "goal_sequences": _statement("SELECT id, ts, match_id, possession, team_id, team_name FROM secuencias"),
    "sequence_goals": _statement(
        """SELECT c.id, c.ts, c.match_id, c.possession, c.team_id, c.team_name, g.id AS gol_id, g.ts AS gol_ts
        FROM corners c JOIN ev g ON g.match_id = c.match_id AND g.possession = c.possession
          AND g.team_id = c.team_id AND g.team_name = c.team_name AND g.shot_outcome = 'Goal' AND g.ts > c.ts
        QUALIFY row_number() OVER (PARTITION BY c.id ORDER BY g.ts, g.id) = 1"""
    ),
    "corners_per_sequence_goal": _statement(
        _RATIO.format(
            goals="total_goles_secuencia",
            totals="""SELECT team_name, c.n AS total_corners, s.n AS total_goles_secuencia
            FROM (SELECT team_name, count(*) AS n FROM secuencias GROUP BY 1) s
            JOIN (SELECT team_name, count(*) AS n FROM corners GROUP BY 1) c USING (team_name)""",
        )
    ),
    "corners_per_sequence_goal_one_season": _statement(
        _RATIO.format(
            goals="total_goles_secuencia",
            totals=f"""SELECT team_name, c.n AS total_corners, s.n AS total_goles_secuencia
            FROM (SELECT team_name, count(*) AS n FROM secuencias JOIN partidos USING (match_id)
                  WHERE temporada = '{SEASON}' GROUP BY 1) s
            JOIN (SELECT team_name, count(*) AS n FROM corners JOIN partidos USING (match_id)
                  WHERE temporada = '{SEASON}' GROUP BY 1) c USING (team_name)""",
        )
    ),
}

_SEQUENCE_SEASONS = """por_temporada AS (
  SELECT c.temporada, c.team_name, c.n AS total_corners, s.n AS total_goles_secuencia
  FROM (SELECT temporada, team_name, count(*) AS n FROM corners LEFT JOIN partidos USING (match_id) GROUP BY 1, 2) c
  JOIN (SELECT temporada, team_name, count(*) AS n FROM secuencias LEFT JOIN partidos USING (match_id) GROUP BY 1, 2) s
    ON s.temporada IS NOT DISTINCT FROM c.temporada AND s.team_name = c.team_name)"""

STATEMENTS |= {
    "corners_per_sequence_goal_by_season": _statement(
        _RATIO_T.format(goals="total_goles_secuencia", totals="SELECT * FROM por_temporada"), _SEQUENCE_SEASONS
    ),
    "corners_per_sequence_goal_agg": _statement(
        """SELECT logo_url, team_name, CAST(sum(total_corners) AS BIGINT) AS total_corners,
          CAST(sum(total_goles_secuencia) AS BIGINT) AS total_goles_secuencia,
          sum(total_corners) / sum(total_goles_secuencia) AS corners_por_gol,
          printf('%.2f', sum(total_corners) / sum(total_goles_secuencia)) AS etiqueta
        FROM por_temporada LEFT JOIN logos USING (team_name) GROUP BY logo_url, team_name""",
        _SEQUENCE_SEASONS,
    ),
    # --- dependence ---
    "minutes_per_team": _statement("SELECT * FROM minutos"),
    "minutes_per_team_with_events": _statement(
        """SELECT temporada, team_name, count(*) * 90 AS minutos_totales FROM (
            SELECT temporada, equipo_local AS team_name, match_id FROM partidos
            UNION ALL SELECT temporada, equipo_visitante, match_id FROM partidos)
          WHERE match_id IN (SELECT match_id FROM ev) GROUP BY 1, 2"""
    ),
    "set_piece_dependence": _statement("SELECT * FROM dependencia"),
    "dependence_all_seasons": _statement(
        """SELECT *, (ocasiones_abp / minutos_totales) * 90 AS ocasiones_abp_por_90,
          ocasiones_abp / ocasiones_totales AS pct_ocasiones_abp
        FROM (SELECT team_name, logo_url, CAST(sum(ocasiones_abp) AS BIGINT) AS ocasiones_abp,
          CAST(sum(ocasiones_totales) AS BIGINT) AS ocasiones_totales,
          CAST(sum(minutos_totales) AS BIGINT) AS minutos_totales
          FROM dependencia JOIN logos USING (team_name) GROUP BY 1, 2)"""
    ),
    # --- checks ---
    "one_team_summary": _statement(
        f"""SELECT count(*) AS corners_totales, count(*) FILTER (fue_gol) AS goles_de_corner FROM cobros_t
        WHERE temporada = '{SEASON}' AND regexp_matches(team_name, '{TEAM_PATTERN}')"""
    ),
    "corner_goals_check": _statement(
        f"""SELECT match_id, minute, second, team_name, player_name, shot_type, play_pattern
        FROM ev JOIN partidos USING (match_id)
        WHERE type_name = 'Shot' AND shot_outcome = 'Goal'
          AND (shot_type IN ('Corner', 'From Corner') OR play_pattern = 'From Corner')
          AND temporada = '{SEASON}' AND regexp_matches(team_name, '{TEAM_PATTERN}')"""
    ),
}

for _name in ("corners_per_goal", "corners_per_sequence_goal"):
    STATEMENTS[f"{_name}_ranked"] = (
        f"SELECT *, row_number() OVER (ORDER BY corners_por_gol, team_name) AS puesto FROM ({STATEMENTS[_name]})"
    )
