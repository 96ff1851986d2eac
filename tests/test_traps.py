"""Hand-made rows per semantic rule, expected values written by hand."""

import pytest
from pyspark.sql import functions as F

from tests.football import (
    IN_BOX,
    OUT_OF_BOX,
    corner,
    match,
    player,
    rows,
    separate_frames,
    shot,
    tables,
)
from touchline.operators.windows import percentile_ranks, rescale_unit
from touchline.operators.zones import assign_zones
from touchline.plans import checks, corners, delivery, dependence, occupancy, ratios, spatial


@pytest.fixture(params=["nested", "separate"])
def layout(request):
    """Player positions inside the shot row, or in a table of their own."""
    return separate_frames if request.param == "separate" else (lambda t: t)


def test_unknown_player_makes_count_unknown(spark, layout):
    t = layout(
        tables(
            spark,
            [
                corner("c1"),
                shot("s1", "c1", [IN_BOX, player(115.0, None)]),
                shot("s2", "c1", [IN_BOX, player(100.0, None)]),
                shot("s3", "c1", [IN_BOX, player(115.0, 40.0, None)]),
                shot("s4", "c1", [IN_BOX, player(115.0, None, False)]),
                shot("s5", "c1", [IN_BOX, player(114.0, 30.0), player(120.0, 50.0), OUT_OF_BOX]),
            ],
        )
    )
    got = rows(corners.box_occupancy(t), "id", corners.ATTACKERS)
    assert got == [("s1", None), ("s2", 1), ("s3", None), ("s4", 1), ("s5", 3)]


def test_unknown_count_has_no_level_but_stays_in_the_counts(spark, layout):
    t = layout(tables(spark, [corner("c1"), shot("s1", "c1", [player(115.0, None)]), shot("s2", "c1")]))
    assert rows(corners.occupancy_category(t), "id", "categoria_atacantes", "categoria_orden") == [
        ("s1", None, None),
        ("s2", "1 Atacantes", 1),
    ]
    assert rows(occupancy.shots_by_occupancy(t), "categoria_orden", "total_remates_generados") == [
        (None, 1), (0, 0), (1, 1), (2, 0), (3, 0), (4, 0),
    ]
    assert rows(corners.enriched_shots(t), "id") == [("s2",)]
    assert rows(corners.shots_with_category(t), "id", "categoria_orden") == [("s1", None), ("s2", 1)]
    assert rows(occupancy.occupancy_xg_summary(t), "categoria_orden", "total_remates") == [
        (0, 0), (1, 1), (2, 0), (3, 0), (4, 0),
    ]


def test_four_and_more_share_a_level(spark, layout):
    t = layout(tables(spark, [corner("c"), shot("s4", "c", [IN_BOX] * 4), shot("s6", "c", [IN_BOX] * 6)]))
    assert rows(corners.occupancy_category(t), "id", "categoria_atacantes") == [
        ("s4", "4+ Atacantes"), ("s6", "4+ Atacantes"),
    ]


def test_unknown_season_matches_unknown_season(spark):
    t = tables(
        spark,
        [corner("c1"), shot("g1", outcome="Goal"), shot("s2", play_pattern="From Corner")],
        [match(season=None)],
    )
    assert rows(ratios.corners_per_sequence_goal_by_season(t), "temporada", "team_name", "corners_por_gol") == [
        (None, "A", 1.0)
    ]
    assert rows(dependence.set_piece_dependence(t), "temporada", "team_name", "minutos_totales") == [
        (None, "A", 90)
    ]


def test_empty_and_missing_frames(spark, layout):
    t = layout(
        tables(
            spark,
            [
                corner("c1"), corner("c2"), corner("c3"),
                shot("s1", "c1", [], outcome="Goal"),
                shot("s2", "c2", None, outcome="Goal"),
                shot("s3", "c3", outcome="Goal"),
            ],
        )
    )
    assert rows(corners.shots_with_freeze_frame(t), "id") == [("s1",), ("s3",)]
    assert rows(corners.box_occupancy(t), "id") == [("s3",)]
    assert rows(corners.corner_outcomes(t), "id", "termino_en_remate", "fue_gol") == [
        ("c1", True, False), ("c2", False, False), ("c3", True, True),
    ]
    assert rows(corners.shots_with_category(t), "id", "fue_gol") == [("s1", None), ("s3", True)]


def test_percentile_of_a_single_team_and_of_unknown_values(spark):
    df = spark.createDataFrame(
        [("s1", "A", 5.0), ("s2", "A", 1.0), ("s2", "B", 2.0), ("s2", "C", None), ("s2", "D", 2.0)],
        "temporada string, team_name string, m double",
    )
    assert rows(percentile_ranks(df, ["m"], ["temporada"])) == [
        ("s1", "A", None), ("s2", "A", 0.0), ("s2", "B", 50.0), ("s2", "C", None), ("s2", "D", 50.0),
    ]


def test_percentile_rounds_half_to_even(spark):
    df = spark.createDataFrame([("s", i, float(i)) for i in range(9)], "temporada string, team int, m double")
    got = [r.m for r in percentile_ranks(df, ["m"], ["temporada"]).orderBy("team").collect()]
    assert got == [0, 12, 25, 38, 50, 62, 75, 88, 100]


def test_team_xg_as_written_and_linked(spark, layout):
    t = layout(tables(spark, [corner("c1"), corner("c2"), shot("s1", "c1", xg=0.3), shot("s2", "c1", xg=0.2)]))
    assert rows(delivery.team_season_metrics(t, "as_written"), "xG") == [(0.0,)]
    assert [r.xG for r in delivery.team_season_metrics(t).collect()] == [pytest.approx(0.5)]


def test_rescale_without_spread_is_one_half(spark):
    df = spark.createDataFrame(
        [("s", "x", 0.4), ("s", "x", 0.4), ("s", "y", 0.1), ("s", "y", 0.3), ("s", "z", 0.7)],
        "temporada string, tipo string, v double",
    )
    got = rows(rescale_unit(df, "v", ["temporada", "tipo"], "r"), "tipo", "r")
    assert got == [("x", 0.5), ("x", 0.5), ("y", 0.0), ("y", 1.0), ("z", 0.5)]


def test_sequence_counts_corners_not_goals(spark):
    def goal(id, ts, possession):
        return shot(id, outcome="Goal", ts=ts, possession=possession)

    t = tables(
        spark,
        [
            corner("c1", ts="00:01:00.000", possession=1), corner("c2", ts="00:01:10.000", possession=1),
            goal("g1", "00:01:20.000", 1),
            goal("g2", "00:02:00.000", 2), corner("c3", ts="00:02:10.000", possession=2),
            corner("c4", ts="00:03:00.000", possession=3), goal("g3", "00:03:00.000", 3),
            corner("c5", ts="00:04:00.000", possession=4),
            shot("g4", outcome="Goal", ts="00:04:10.000", possession=4, team="B"),
        ],
    )
    assert rows(ratios.goal_sequences(t), "id") == [("c1",), ("c2",)]
    assert rows(ratios.corners_per_sequence_goal(t), "team_name", "total_corners", "corners_por_gol") == [
        ("A", 5, 2.5)
    ]


def test_shared_zone_edges_count_in_each_zone(spark):
    points = spark.createDataFrame(
        [(1, 114.0, 20.0), (2, 102.0, 18.0), (3, 95.0, 10.0), (4, 105.0, None), (5, 105.0, 40.0)],
        "id int, end_x double, end_y double",
    )
    got = {}
    for r in assign_zones(points).collect():
        got.setdefault(r.id, []).append(r.zona_nombre)
    assert {k: len(v) for k, v in got.items()} == {1: 3, 2: 3, 3: 1, 4: 1, 5: 1}
    assert got[3] == got[4] == ["Otra Zona"]
    assert got[5] == ["Zona Punto Penal"]


def test_corner_with_two_shots_gives_two_rows(spark, layout):
    t = layout(tables(spark, [corner("c1"), corner("c2"), shot("s1", "c1"), shot("s2", "c1", outcome="Goal")]))
    assert rows(corners.corner_outcomes(t), "id", "termino_en_remate", "fue_gol") == [
        ("c1", True, False), ("c1", True, True), ("c2", False, False),
    ]
    assert rows(ratios.corners_per_goal(t), "total_corners", "total_goles_de_corner", "corners_por_gol") == [
        (3, 1, 3.0)
    ]


def test_many_shots_of_one_corner_are_all_written(spark, layout, monkeypatch):
    monkeypatch.setattr(corners, "FAN_OUT", 3)
    shots = [shot(f"s{i}", "c1", outcome="Goal" if i < 4 else "Saved") for i in range(11)]
    t = layout(tables(spark, [corner("c1"), *shots]))
    counts = corners.corner_outcomes(t).groupBy("fue_gol").count()
    assert rows(counts) == [(False, 7), (True, 4)]


def test_delivery_type_order_and_labels(spark):
    t = tables(
        spark,
        [
            corner("c1", pass_length=24.9, inswinging=True),
            corner("c2", pass_length=25.0, inswinging=True, outswinging=True),
            corner("c3", outswinging=True),
            corner("c4"),
            shot("s4", "c4"),
        ],
    )
    assert rows(corners.corner_outcomes(t), "id", "tipo_cobro") == [
        ("c1", "Corto"), ("c2", "Inswinger"), ("c3", "Outswinger"), ("c4", "Directo/Otro"),
    ]
    shares = ["Outswinger", "Inswinger", "Corto", "Directo"]
    assert rows(delivery.team_season_metrics(t), *shares) == [(0.25, 0.25, 0.25, 0.25)]


def test_missing_values_print_as_na(spark, layout):
    t = layout(
        tables(
            spark,
            [
                corner("c1", location=[120.0, 0.0], pass_end_location=[110.0]),
                shot("s1", "c1", player_name=None, xg=0.5, xgot=None, minute=7, second=3),
                shot("s2", "c1", xg=0.126, xgot=0.25, outcome="Goal"),
            ],
        )
    )
    texts = dict(rows(occupancy.shot_tooltips(t), "id", "tooltip_text"))
    assert texts["s1"] == (
        "<b>Partido:</b> A vs B<br><b>Equipo:</b> A<br><b>Fecha:</b> 2023-01-02<br><b>Minuto:</b> 7:03"
        "<br><b>Ejecutó:</b> taker<br><b>Remató:</b> NA<br><b>xG:</b> 0.5"
    )
    assert texts["s2"].endswith("<br><b>xG:</b> 0.13<br><b>xGoT:</b> 0.25")
    goal = occupancy.goal_tooltips(t).first()
    assert goal.tooltip_text.startswith("<b>GOL! de A</b><br><b>Partido:</b> A vs B<br><b>Fecha:</b>")
    assert goal.titulo_facet == "1 Atacantes\n(N = 1 Goles)"
    assert (goal.start_x, goal.end_x, goal.end_y) == (120.0, 110.0, None)


def test_minutes_count_matches_without_events(spark):
    t = tables(spark, [shot("s1", play_pattern="From Corner"), shot("s2")], [match(1), match(2, away="C")])
    assert rows(dependence.minutes_per_team(t), "team_name", "minutos_totales") == [
        ("A", 180), ("B", 90), ("C", 90),
    ]
    assert rows(dependence.set_piece_dependence(t), "ocasiones_abp_por_90", "pct_ocasiones_abp") == [(0.5, 0.5)]
    covered = dependence.set_piece_dependence(t, only_with_events=True)
    assert rows(covered, "ocasiones_abp_por_90") == [(1.0,)]


def test_corner_of_unlisted_match_counts_over_all_seasons_only(spark, layout):
    t = layout(
        tables(spark, [corner("c1"), corner("c2", match=9), shot("s1", "c1", outcome="Goal")])
    )
    assert rows(ratios.corners_per_goal(t), "total_corners") == [(2,)]
    assert rows(ratios.corners_per_goal(t, "2022/2023"), "total_corners") == [(1,)]
    assert rows(ratios.corners_per_goal_by_season(t), "temporada", "total_corners") == [("2022/2023", 1)]


def test_sums_of_unknown_values_are_zero_and_means_unknown(spark, layout):
    t = layout(tables(spark, [corner("c1"), shot("s1", "c1")]))
    assert rows(occupancy.occupancy_comparison(t), "metrica", "valor") == [
        ("total_goles", 0.0), ("total_remates", 1.0), ("xG_total", 0.0),
    ]
    assert rows(delivery.delivery_summary(t), "valor_promedio_obv") == [(None,)]
    assert rows(delivery.team_season_metrics(t), "OBV", "xG") == [(0.0, 0.0)]


def test_strict_and_filled_goal_rate(spark, layout):
    t = layout(tables(spark, [corner("c1"), shot("s1", "c1", outcome=None), shot("s2", "c1", outcome="Goal")]))
    assert rows(occupancy.goal_rate_by_occupancy(t), "total_remates", "total_goles", "tasa_de_gol") == [
        (2, None, None)
    ]
    filled = occupancy.goal_rate_by_occupancy(t, strict=False).where(F.col("categoria_orden") <= 1)
    assert rows(filled, "categoria_orden", "total_goles", "tasa_de_gol") == [(0, 0, 0.0), (1, 1, 0.5)]


def test_zone_map_of_a_team_without_corners_is_empty(spark):
    t = tables(spark, [corner("c1", pass_end_location=[116.0, 40.0])])
    full = spatial.zone_map(t, "A")
    assert full.count() == 7
    assert rows(full.where("total_en_zona is not null"), "zona_nombre", "tipo_cobro", "total_en_zona") == [
        ("Centro - Área Chica", "Directo/Otro", 1)
    ]
    assert spatial.zone_map(t, "B").count() == 0
    assert spatial.zone_map(t, "A", "2021/2022").count() == 0
    assert spatial.zone_map(t, "A", "2022/2023").count() == 7


def test_radar_needs_a_season(spark):
    t = tables(spark, [corner("c1")])
    with pytest.raises(ValueError):
        delivery.team_radar(t, None, "A")


def test_spot_checks_agree(spark, layout):
    t = layout(
        tables(
            spark,
            [
                corner("c1", team="América"), corner("c2", team="América"),
                shot("s1", "c1", team="América", outcome="Goal", play_pattern="From Corner"),
                shot("s2", None, team="América", outcome="Goal", shot_type="Corner"),
                shot("s3", None, team="América", outcome="Goal", play_pattern="Regular Play"),
                shot("s4", None, team="América", outcome="Goal"),
                corner("c3", team="B"),
            ],
        )
    )
    pattern = "Am(é|e)rica"
    assert rows(checks.one_team_summary(t, "2022/2023", pattern)) == [(2, 1)]
    assert rows(checks.one_team_summary(t, "2021/2022", pattern)) == [(0, 0)]
    assert checks.corner_goals_check(t, "2022/2023", pattern).count() == 2
