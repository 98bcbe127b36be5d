import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from furrow.functions.wkt import with_centroid
from furrow.operators import daily as D
from furrow.operators import lineage as L
from furrow.operators import pairs as P
from furrow.operators import profile as PR
from furrow.operators import quality as Q
from furrow.operators import ridge as R
from furrow.operators import spatial as S
from furrow.operators import timeline as T
from furrow.operators import weekly as WK
from furrow.operators import windows as W

TECH, CONV = "tecnologia_4_0", "convencional"
DAY = dt.date(2026, 2, 1)


def week(i):
    return dt.date(2025, 11, 3) + dt.timedelta(weeks=i)


def test_harvest_keeps_harvest_rows_with_yield(spark):
    rows = [("grao", DAY, "CALAGEM", 999999.0, 0.1, 99.0, 10.0), ("grao", DAY, "COLHEITA SILAGEM", 125000.0, 0.2, 42.0, 12.0), ("grao", DAY, "COLHEITA SILAGEM", 0.0, 0.1, 0.0, 14.0), (None, DAY, "COLHEITA", 5.0, 1.0, 1.0, 1.0)]
    df = spark.createDataFrame(rows, "season_id string, date date, Operation string, `Yield - kg/ha` double, `Area - ha` double, `Weight - kg` double, `Humidity - %` double")
    (r,) = D.summarize_layer(df, "harvest").collect()
    assert (r.harvest_points, r.harvest_yield_mean_kg_ha, r.harvest_weight_kg) == (1, 125000.0, 42.0)


def test_fertilization_and_stop_null_rules(spark):
    fert = spark.createDataFrame([("a", DAY, "x", 1.0, 10.0, 0.0, 1.0), ("a", DAY, "x", None, 20.0, 10.0, None), ("a", DAY, "x", 1.0, None, None, 1.0)], "season_id string, date date, Operation string, `Area - ha` double, `AppliedDos - kg/ha` double, `Configured - kg/ha` double, `Weight - kg` double")
    (r,) = D.summarize_layer(fert, "fertilization").collect()
    assert (r.fert_points, r.fert_dose_ratio_mean, r.fert_dose_gap_mean_kg_ha, r.fert_weight_kg) == (2, 2.0, 10.0, 1.0)
    stop = spark.createDataFrame([("a", DAY, None, 1.0), ("a", DAY, "Sem evento", 2.0)], "season_id string, date date, event string, `Duration - h` double")
    (r,) = D.summarize_layer(stop, "stop").collect()
    assert (r.stop_events, r.stop_duration_h, r.stop_known_reason_share) == (2, 3.0, 0.5)


def test_merge_is_a_full_outer_join(spark):
    a = spark.createDataFrame([("s", DAY, 1)], "season_id string, date date, x int")
    b = spark.createDataFrame([("s", DAY, 2), ("t", DAY, 3)], "season_id string, date date, y int")
    assert sorted(tuple(r) for r in D.merge_daily([a, b]).collect()) == [("s", DAY, 1, 2), ("t", DAY, None, 3)]


def test_weather(spark):
    rows = [(dt.datetime(2025, 11, 3 + i // 2, i % 2), float(i), 1.0, 5.0, 20.0, 25.0, 15.0, 60.0, 3.0) for i in range(20)]
    df = spark.createDataFrame(rows, "date timestamp, precipitation_mm double, evapotranspiration_mm double, solar_radiation_w_m2 double, temp_avg_c double, temp_max_c double, temp_min_c double, humidity_avg_pct double, wind_avg_kmh double")
    daily = D.weather_daily(df).orderBy("date").collect()
    assert [r.precipitation_mm for r in daily][:3] == [1.0, 5.0, 9.0] and daily[0].water_balance_mm == -1.0
    assert daily[9].precipitation_mm_ma7 == np.mean([r.precipitation_mm for r in daily][3:])
    weeks = WK.weather_weekly(D.weather_daily(df)).orderBy("week_start").collect()
    assert [r.weather_days for r in weeks] == [7, 3]


def test_traps_and_events(spark):
    reads = spark.createDataFrame([("s", DAY, "t1", "ELECTRONIC", 5.0, 4.0, None, 9.0, 2.0, "b"), ("s", DAY, "t1", "CONVENTIONAL", None, 4.0, 4.0, 9.0, None, "a"), ("s", DAY, "t2", None, 9.0, None, 3.0, 9.0, None, " ")], "season_id string, date date, trapCode string, trapType string, pestCount double, alert_threshold double, control_threshold double, damage_threshold double, action_ray_m double, primaryPest string")
    (r,) = D.trap_daily(reads).collect()
    assert (r.trap_readings, r.traps_reporting, r.alert_hits, r.control_hits, r.damage_hits, r.electronic_readings, r.primary_pests) == (3, 2, 1, 1, 1, 1, "a, b")
    events = spark.createDataFrame([("s", DAY, "IMAGE", 2.0, '[{"name":"x"},{"name":"y"}]'), ("s", DAY, "PING", None, None)], "season_id string, date date, type string, pestCount double, detection string")
    (r,) = D.trap_event_daily(events).collect()
    assert (r.image_events, r.ping_events, r.detected_boxes, r.detected_species) == (1, 1, 2, "x, y")
    lookup = D.pest_lookup(spark.createDataFrame([("Ácaro", None, 2.0)], "name string, alert_threshold double, control_threshold double"), spark.createDataFrame([("acaro", 1.0, 9.0)], "name string, alert_threshold double, control_threshold double"))
    (r,) = lookup.collect()
    assert (r.primary_pest_key, r.alert_threshold, r.control_threshold) == ("acaro", 1.0, 2.0)


def test_pair_gaps_never_mix_pairs(spark):
    rows = [("g", TECH, week(0), 0.6), ("g", CONV, week(0), 0.4), ("s", TECH, week(0), 0.5), ("s", CONV, week(0), 0.7)]
    df = spark.createDataFrame(rows, "comparison_pair string, treatment string, week_start date, v double")
    gaps = {(r.comparison_pair, r.treatment): round(r.gap, 6) for r in WK.pair_gap(df, "v", name="gap").collect()}
    assert gaps == {("g", TECH): 0.2, ("g", CONV): 0.2, ("s", TECH): -0.2, ("s", CONV): -0.2}


def test_phase_timeline_without_optional_columns(spark):
    rows = [("t", "p", TECH, week(0), 0.70, 5.0, 1.0), ("t", "p", TECH, week(1), 0.52, 5.0, 30.0), ("c", "p", CONV, week(0), 0.60, 5.0, 1.0), ("c", "p", CONV, week(1), 0.61, 5.0, 1.0)]
    df = spark.createDataFrame(rows, "season_id string, comparison_pair string, treatment string, week_start date, ndvi_mean_week double, soil_pct_week double, avg_pest_count_week double")
    out = {(r.season_id, r.week_start): r for r in T.phase_timeline(df).collect()}
    last = out["t", week(1)]
    assert last.phase == "queda_forte" and last.event_type == "queda_forte" and last.primary_driver == "pressao_de_pragas"
    assert out["c", week(1)].phase == "pico"


def test_pair_effects_and_classic_tests(spark):
    rows = [(s, "p", week(i), b + 0.01 * i, 0.0) for i in range(8) for s, b in ((TECH, 0.62), (CONV, 0.55))]
    df = spark.createDataFrame(rows, "treatment string, comparison_pair string, week_start date, ndvi_mean_week double, low_vigor_flag double")
    out = {r.metric: r for r in P.pair_effects(df).collect()}
    assert out["ndvi_mean_week"].winner == "favorece_4_0" and out["ndvi_mean_week"].evidence_level == "alta" and out["low_vigor_flag"].winner == "inconclusivo"
    rows = [(s, "p", week(i), 0.6 + (0.04 + 0.01 * i) * (s == TECH)) for i in range(6) for s in (TECH, CONV)]
    (r,) = P.classic_tests(spark.createDataFrame(rows, "treatment string, comparison_pair string, week_start date, ndvi_mean_week double")).collect()
    assert r.favors == "favorece_4_0" and r.significant


def test_outliers(spark):
    rows = [("a", week(i), v) for i, v in enumerate((0.50, 0.51, 0.18, 0.49))]
    out = W.outliers(spark.createDataFrame(rows, "season_id string, week date, ndvi double"), "ndvi", ["season_id"]).collect()
    assert [(r.week, r.direction) for r in out] == [(week(2), "ndvi_abaixo_do_padrao")]


def test_windows_on_nulls_and_ties(spark):
    df = spark.createDataFrame([("a", None, 1), ("a", DAY, 2), ("b", DAY, 3), ("b", DAY, 4)], "k string, d date, i int")
    assert {r.k: r.i for r in W.latest(df, ["k"], "d", ["i"]).collect()} == {"a": 1, "b": 4}
    flat = spark.createDataFrame([("a", 1.0), ("a", 1.0), ("b", 2.0), ("b", None)], "k string, v double")
    assert {r.n for r in W.min_max(flat, "v", ["k"], "n").collect()} == {None}
    area = spark.createDataFrame([("a", week(0), 1.0), ("a", week(1), None), ("a", week(2), 3.0), ("a", week(3), 5.0)], "k string, d date, v double")
    assert [r.s for r in W.running_area(area, "v", ["k"], "d", [], "s").orderBy("d").collect()] == [0.0, 0.0, 0.0, 28.0]


def test_points(spark):
    boxes = spark.createDataFrame([("b", 0.0, 0.0, 2.0, 2.0, 1.0, 1.0), ("a", 1.0, 1.0, 3.0, 3.0, 2.0, 2.0)], "season_id string, min_lon double, min_lat double, max_lon double, max_lat double, center_lon double, center_lat double")
    points = spark.createDataFrame([(1, 1.5, 1.5), (2, 0.5, 0.5), (3, 9.0, 9.0), (4, None, 1.0)], "point_id long, lon double, lat double")
    out = {r.point_id: (r.season_id, r.assignment_method) for r in S.assign_points(points, boxes, "lon", "lat").collect()}
    assert out == {1: ("a", "bbox_contains"), 2: ("b", "bbox_contains"), 3: ("a", "nearest_center"), 4: (None, "missing_coordinates")}
    assert {r.point_id: (r.season_id, r.assignment_method) for r in S.assign_points(points, boxes, "lon", "lat", max_boxes=0).collect()} == out


def test_distances_and_centroids(spark):
    # Flinders Peak to Buninyon, the classic example of the inverse formula
    d = S.geodesic_m(np.array([144.42486789]), np.array([-37.95103342]), np.array([143.92649553]), np.array([-37.65282114]))
    assert d[0] == pytest.approx(54972.27, abs=1.5)
    assert S.geodesic_m(*np.zeros((4, 1)))[0] == 0
    left = spark.createDataFrame([(1, -50.0, -25.0)], "i long, lon double, lat double")
    right = spark.createDataFrame([(1, -50.0, -25.003), (2, -50.0, -25.004), (3, -49.9967, -25.0)], "j long, r_lon double, r_lat double")
    assert {r.j for r in S.within_radius(left, right, 350.0).collect()} == {1, 3}
    got = with_centroid(spark.createDataFrame([("POINT (1 2)",), (None,), ("x",)], "geometry string")).select("centroid_lon").collect()
    assert [r[0] for r in got] == [1.0, None, None]


def test_ridge_matches_numpy(spark):
    rng = np.random.default_rng(2)
    rows = [(f"s{i % 4}", float(a), float(b), bool(c), "xy"[i % 2]) for i, (a, b, c) in enumerate(zip(rng.normal(size=40), rng.normal(size=40), rng.random(40) > 0.5))]
    rows = [(*r, 2 * r[1] - r[2] + 0.1 * i) for i, r in enumerate(rows)]
    df = spark.createDataFrame(rows, "season string, a double, b double, f boolean, c string, y double")
    summary, coefficients, out = R.fit(df, ["a", "b"], ["f"], ["c"], "y", "season")
    x = np.array([[r[1], r[2], float(r[3]), float(r[4] == "x"), float(r[4] == "y")] for r in rows])
    x = (x - x.mean(0)) / x.std(0)
    y = np.array([r[5] for r in rows])
    one = np.column_stack((np.ones(40), x))
    w = np.linalg.pinv(one.T @ one + np.diag([0, 1, 1, 1, 1, 1])) @ one.T @ y
    assert np.allclose(sorted(r.predicted for r in out.collect()), np.sort(one @ w))
    table = {r.feature: r for r in coefficients.collect()}
    assert table["a"].coefficient == pytest.approx(w[1]) and table["a"].direction == "aumenta_ndvi_futuro" and table["b"].direction == "pressiona_ndvi_futuro"
    assert table["c_x"].feature_mean == 0.5 and [r.abs_coefficient for r in coefficients.collect()] == pytest.approx(sorted((abs(x) for x in w[1:]), reverse=True))
    loo = {r.y: r.loo_predicted for r in out.collect()}
    keep = np.array([r[0] != "s0" for r in rows])
    w0 = np.linalg.pinv(one[keep].T @ one[keep] + np.diag([0, 1, 1, 1, 1, 1])) @ one[keep].T @ y[keep]
    assert loo[rows[0][5]] == pytest.approx((one @ w0)[0])
    (s,) = summary.collect()
    assert (s.observations, s.features) == (40, 5) and s.in_sample_mae == pytest.approx(np.abs(y - one @ w).mean()) and s.loo_mae > s.in_sample_mae
    assert s.in_sample_r2 == pytest.approx(1 - ((y - one @ w) ** 2).mean() / y.var())


def test_ridge_of_few_rows_null_groups_and_nothing(spark):
    rows = [("s", 1.0, None), ("s", 2.0, 1.0), (None, 3.0, 2.0), (None, None, 4.0), ("t", None, 3.0)]
    df = spark.createDataFrame(rows, "season_id string, a double, target double")
    _, _, out = R.fit(df.withColumn("x", F.lit("clash")), ["a"], [], [], "target")
    assert sorted((r.target, r.loo_predicted is None) for r in out.collect()) == [(1.0, False), (2.0, False), (3.0, False), (4.0, False)]
    _, _, out = R.fit(df.where("season_id = 's'"), ["a"], [], [], "target")
    assert [r.loo_predicted for r in out.collect()] == [None]
    model = R.fit(df.limit(0), ["a"], [], ["season_id"], "target")
    assert model.predictions.count() == 0 and model.summary.first().observations == 0 and model.coefficients.count() == 1
    frame = R.transition_frame(spark.createDataFrame([("s", week(0), 0.5, True, "tecnologia_4_0"), ("s", week(1), 0.4, None, "tecnologia_4_0")], "season_id string, week_start date, ndvi_mean_week double, low_vigor_flag boolean, treatment string"))
    assert len(frame.columns) == 6 + 1 + 16 + 12 and [(round(r.target_next_ndvi_delta, 6), r.low_vigor_flag, r.phase) for r in frame.collect()] == [(-0.1, 1.0, None)]


def test_quality_rules(spark):
    df = spark.createDataFrame([("s", "f", 0.0, 2.0, 50.0, 60.0), ("s", "f", 5.0, 0.5, 120.0, None), (None, "g", None, None, None, None)], "season_id string, filename string, b1_valid_pixels double, b1_mean double, b1_pct_solo double, b1_pct_veg_densa double")
    got = {r.rule_id: r.affected_rows for r in Q.run_rules(df, Q.scene_rules(df.columns), "scenes").collect()}
    assert got == {"ndvi_b1_valid_pixels_zero": 2, "ndvi_b1_mean_outside_range": 1, "ndvi_b1_pct_solo_outside_pct": 1, "ndvi_b1_pct_veg_densa_outside_pct": 0, "ndvi_soil_dense_veg_pct_sum_gt_100": 1}
    assert Q.duplicate_keys(df, ["season_id", "filename"]).count() == 2
    assert [r.column_name for r in Q.empty_columns(df.withColumn("e", F.lit(None).cast("int")), "t").collect()] == ["e"]
    assert {r.rule_id: r.affected_rows for r in Q.run_rules(df.withColumn("z", F.lit(0.0)), [Q.mostly_zero("z"), Q.mostly_zero("b1_mean")], "t").collect()} == {"ops_z_mostly_zero": 3, "ops_b1_mean_mostly_zero": 0}


def test_profiles_and_pages(spark):
    df = spark.createDataFrame([(float(i), None if i % 3 else f"Ação {i}") for i in range(10)], "v double, t string")
    (r,) = PR.numeric_profile(df, ["v"]).collect()
    assert (r.n, r.mean, r.median, r.q1) == (10, 4.5, 4.5, 2.25) and r.skewness == pytest.approx(0) and r.kurtosis == pytest.approx(-1.2)
    (o,) = PR.overview(df, "d").collect()
    assert (o.rows, o.columns, o.numeric_columns, o.null_cells) == (10, 2, 1, 6)
    assert [r.v for r in PR.page(df, ["v"], 1, 2, "ACAO", ["t"]).collect()] == [3.0, 6.0]
    assert [(r.bin, r.n) for r in PR.histogram(df, "v", 3).orderBy("bin").collect()] == [(0, 3), (1, 3), (2, 4)]


def test_lineage(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "d"), ("x", "c")], "src string, dst string")
    start = spark.createDataFrame([("b",)], "node string")
    assert {r.node: r.depth for r in L.neighbourhood(edges, start, 2).collect()} == {"b": 0, "a": 1, "c": 1, "d": 2, "x": 2}
    assert {(r.src, r.dst) for r in L.flow(edges, start).collect()} == {("b", "c"), ("c", "d")}
    nodes = spark.createDataFrame([(n,) for n in "abcdx"], "node string")
    assert {r.node: r.layer for r in L.layers(edges, nodes).collect()} == {"a": 0, "x": 0, "b": 1, "c": 2, "d": 3}
    records = spark.createDataFrame([("1", "m", "p | q"), ("2", "p", ""), ("3", "r", "")], "id string, column_name string, tokens string")
    assert {r.id for r in L.expand_tokens(records, records.where("id = '1'"), "id", "column_name", "tokens").collect()} == {"1", "2"}
    (r,) = L.storage_advice(spark.createDataFrame([("raw", 118 << 20), ("raw", 90 << 20), ("out", 1 << 19)], "zone string, size_bytes long")).collect()
    assert (round(r.raw_mb), r.large_files, r.recommendation) == (208, 2, "hybrid")


def test_nearest_sites(spark):
    points = spark.createDataFrame([("s", 0.0, 0.0)], "season_id string, lon double, lat double")
    sites = spark.createDataFrame([("a", 0.0, 0.0100, None), ("b", 0.0, 0.0110, "plot"), ("c", 0.0, 0.5, "plot"), ("d", 1.0, 1.0, None)], "site string, s_lon double, s_lat double, plot string")
    (r,) = S.preferred_site(S.k_nearest(points, sites)).collect()
    assert [x.site for x in r.nearest] == ["a", "b", "c"] and r.suggested == "b"


def test_targets_and_gates(spark):
    records = spark.createDataFrame([("NDVI médio", "panel", "mean"), ("solo", "panel", "share")], "column_name string, table_name string, rule string")
    targets = spark.createDataFrame([("ndvi", "ndvi medio"), ("yield", "produtividade")], "target string, needle string")
    got = {r.target: (r.passed, r.checks, r.missing) for r in L.critical_targets(records, targets, {"name": "column_name", "rule": "rule"}).collect()}
    assert got == {"ndvi": (1, 2, "rule"), "yield": (0, 2, "name, rule")}
    rules = spark.createDataFrame([("error", 1), ("info", 5)], "severity string, affected_rows int")
    cov = spark.createDataFrame([(100.0,)], "coverage_pct double")
    assert {r.gate: r.passed for r in L.gates(cov, L.critical_targets(records, targets, {"name": "column_name"}), rules).collect()} == {"coverage": True, "critical_targets": False, "quality": False}
