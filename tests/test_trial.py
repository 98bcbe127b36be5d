import datetime as dt

import pytest
from pyspark.sql import functions as F

from furrow.operators import index as I
from furrow.operators import narrative as N
from furrow.operators import trial as T
from furrow.operators import workspace as WS
from furrow.sources import csv as C
from furrow.sources import sinks

TECH, CONV = "tecnologia_4_0", "convencional"
D = dt.date


def test_area_metadata_official_default_and_manual(spark):
    scenes = spark.createDataFrame([("s1",), ("s2",), ("s3-long-name",), ("s1",), (None,)], "season_id string")
    official = spark.createDataFrame([("s1", "Grao 4.0", TECH, "grao", "grao", "official", "x"), ("s2", "Grao C", CONV, "grao", "grao", "official", "y")], "season_id string, area_label string, treatment string, crop_type string, comparison_pair string, mapping_source string, notes string")
    manual = spark.createDataFrame([("s2", "Outro", None)], "season_id string, area_label string, treatment string")
    out = {r.season_id: r for r in T.area_metadata(scenes, official, manual).collect()}
    assert (out["s1"].area_label, out["s2"].area_label, out["s2"].treatment, out["s2"].crop_type) == ("Grao 4.0", "Outro", CONV, "grao")
    assert (out["s3-long-name"].area_label, out["s3-long-name"].treatment, out["s3-long-name"].mapping_source) == ("Area s3-long-", "indefinido", "auto_missing") and len(out) == 3


def test_clean_scenes(spark):
    rows = [("s", "a", D(2025, 11, 1), 120.0, 0.61), ("s", "b", D(2025, 11, 6), 0.0, 0.03), ("s", "c", D(2025, 11, 5), 9.0, 0.71), ("s", "d", None, None, 0.2)]
    scenes = spark.createDataFrame(rows, "season_id string, filename string, date date, b1_valid_pixels double, b1_mean double").withColumns({"b1_std": F.lit(0.1), "b1_pct_solo": F.lit(10.0), "b1_pct_veg_densa": F.lit(80.0)})
    areas = spark.createDataFrame([("s", "A")], "season_id string, area_label string")
    weather = spark.createDataFrame([(D(2025, 11, 1),), (D(2025, 11, 2),)], "date date")
    a, c = sorted(T.clean_scenes(scenes, areas, weather).collect(), key=lambda r: r.filename)
    assert (a.has_weather_coverage, c.has_weather_coverage, a.ndvi_delta, c.area_label) == (True, False, None, "A")
    assert c.ndvi_delta == pytest.approx(0.1) and c.ndvi_auc == pytest.approx(4 * 0.66) and c.week_start.date() == D(2025, 11, 3)
    assert T.clean_scenes(scenes, areas, weather.limit(0)).where("has_weather_coverage").count() == 0
    assert [r.filename for r in T.scenes_before_weather(scenes, spark.createDataFrame([(D(2025, 11, 6),)], "date date")).orderBy("filename").collect()] == ["a", "c"]
    assert T.duplicate_columns(["a", "b", "A", "a"]) == ["A", "a"]


def test_hypothesis_matrix_texts(spark):
    rows = [("g", TECH, "a", 0.70, None, 1.0, 8, 3), ("g", CONV, "b", 0.50, 100.0, 9.0, 8, 8), ("h", TECH, "c", 0.7, None, None, 8, None)]
    inventory = spark.createDataFrame(rows, "comparison_pair string, treatment string, area_label string, ndvi_mean double, harvest_yield_mean_kg_ha double, avg_pest_count double, soil_samples_available int, miip_days int").withColumn("mapping_source", F.lit("official"))
    features = spark.createDataFrame([("g", True), ("g", None), ("h", True)], "comparison_pair string, has_weather_coverage_week boolean")
    out = {r.pair: r for r in N.hypothesis_matrix_texts(inventory, features).collect()}
    assert out["g"].supports_4_0 == "NDVI medio da safra: 4.0 leva vantagem (+0.20). | Pressao media de pragas: 4.0 leva vantagem (-8.00 insetos)."
    assert out["g"].known_gaps.split(" | ") == [N.GAP_YIELD, N.GAP_TRAP_DAYS, N.GAP_WEATHER, N.GAP_SOIL] and out["g"].evidence_strength == "baixa"
    assert out["h"].known_gaps.split(" | ") == [N.GAP_SOIL, N.GAP_NO_YIELD] and out["h"].supports_convencional == N.NO_SUPPORT[1]


def test_workspace(spark):
    seasons = spark.createDataFrame([("season-one", -50.0, -20.0), ("far", 10.0, 50.0)], "season_id string, center_lon double, center_lat double")
    traps = spark.createDataFrame([("t1", "ELECTRONIC", None, -50.0, -20.001), ("t2", "CONVENTIONAL", "p9", -50.0, -20.0012), ("t3", "CONVENTIONAL", "p1", -49.0, -20.0), ("t4", "X", None, None, 1.0)], "code string, type string, plot string, longitude double, latitude double")
    readings = spark.createDataFrame([("t1", D(2025, 1, 1), 1, 4.0, "b", "x"), ("t1", D(2025, 1, 3), 2, 6.0, "a", "x"), ("t2", None, 3, 10.0, "c", "x")], "trapCode string, createdAt date, trapId int, pestCount double, primaryPest string, trapInfestationLevel string")
    mapping = {r.season_id: r for r in WS.with_manual(WS.suggested_mapping(seasons, traps), spark.createDataFrame([("far", "Longe")], "season_id string, area_label string")).collect()}
    assert (mapping["season-one"].suggested_plot, mapping["season-one"].suggested_treatment, mapping["season-one"].closest_trap, mapping["far"].area_label) == ("p9", CONV, "t2", "Longe")
    near = {r.season_id: r for r in WS.nearby_traps(seasons, traps, readings).collect()}
    assert (near["season-one"].electronic_traps, near["season-one"].conventional_traps, near["season-one"].avg_pest_count, near["season-one"].primary_pests, near["far"].electronic_traps) == (1, 1, 8.0, "a, c", 0)
    boxes = spark.createDataFrame([("a", 0.0, 0.0, 1.0, 1.0, 0.5, 0.5), ("b", 5.0, 0.0, 6.0, 1.0, 5.5, 0.5)], "season_id string, min_lon double, min_lat double, max_lon double, max_lat double, center_lon double, center_lat double")
    points = spark.createDataFrame([(1, 1.0, 1.0), (2, 3.1, 0.5), (3, None, 1.0)], "i int, centroid_lon double, centroid_lat double")
    assert sorted((r.i, r.season_id, r.assignment_method) for r in WS.assign_to_polygons(points, boxes).collect()) == [(1, "a", "contains"), (2, "b", "nearest_bbox"), (3, None, "missing_geometry")]
    off = spark.createDataFrame([("c", 362.6, 0.0, 363.6, 1.0, 363.1, 0.5)], boxes.schema)  # around the globe it would be at point 2
    for most in (0, 10):
        assert {r.i: r.season_id for r in WS.assign_to_polygons(points, boxes.union(off), max_boxes=most).collect()} == {1: "a", 2: "b", 3: None}
        assert {r.i: r.season_id for r in WS.assign_to_polygons(points, off, max_boxes=most).collect()} == {1: "c", 2: "c", 3: None}
    base = spark.createDataFrame([("a", TECH, 10.0, 2, 0, 5.0, 1.0), ("b", CONV, 5.0, 0, 3, None, None)], "season_id string, treatment string, yield_mean_kg_ha double, electronic_traps int, conventional_traps int, avg_pest_count double, population_mean_ha double")
    scenes = spark.createDataFrame([("a", D(2025, 1, 1), "x", 0.5, 1.0), ("a", D(2025, 1, 2), "y", None, 3.0)], "season_id string, date date, filename string, b1_mean double, b1_pct_veg_densa double")
    parts = [base.select("season_id", c) for c in ("yield_mean_kg_ha", "population_mean_ha")]
    out = {r.season_id: r for r in WS.evidence_table(base.select("season_id", "treatment"), scenes, *parts, base.select("season_id", "electronic_traps", "conventional_traps", "avg_pest_count")).collect()}
    assert out["a"].ndvi_last == 0.5 and out["a"].diagnostic.startswith(WS.YIELD_TEXTS[0]) and "eletrônicas no entorno imediato (2)" in out["a"].diagnostic and "majoritariamente convencional" in out["b"].diagnostic
    halves = base.select("season_id", F.lit(5001508.5).alias("population_mean_ha"))
    out = WS.evidence_table(base.select("season_id", "treatment"), scenes, parts[0], halves, base.select("season_id", "electronic_traps", "conventional_traps", F.lit(0.25).alias("avg_pest_count")))
    assert all("5001508 plantas/ha" in r.diagnostic and "próximas: 0.2." in r.diagnostic for r in out.collect())
    evidence = spark.createDataFrame([("a", 10.0)], "season_id string, yield_mean_kg_ha double")
    assert [(r.total_cost_per_ha_brl, r.kg_per_brl) for r in WS.cost_summary(spark.createDataFrame([("a", "2.5"), ("a", "x"), ("b", "0")], "season_id string, cost_per_ha_brl string"), evidence).orderBy("season_id").collect()] == [(2.5, 4.0), (0.0, None)]


def test_lineage_index(spark):
    features = spark.createDataFrame([("ndvi_mean_week", "ndvi", "media", "weekly", "b1_mean | date", "onesoil", "avg", "", "a.csv", "H1"), ("low_vigor_flag", "flag", "baixo", "timeline", "ndvi_mean_week", "", "case", "0.35", "a.csv", "H2")],
                                     "feature string, category string, definition string, born_table string, source_columns string, raw_sources string, transformation string, thresholds string, appears_in_csvs string, hypotheses string")
    drivers = spark.createDataFrame([("baixo_vigor", "low_vigor_flag", "d")], "driver string, feature string, definition string")
    raw = spark.createDataFrame([("scenes", "b1_mean"), ("scenes", "crs")], "table string, column string")
    index = I.lineage_index(spark, raw, features, drivers, {"weekly": ["ndvi_mean_week"]}, {"a.csv": ["gap_ndvi_mean_week_4_0_minus_convencional", "low_vigor_rate", "other"]})
    status = {(r["layer"], r["column"]): r.mapping_status for r in index.collect()}
    assert len(status) == 9 and status["csv_final", "low_vigor_rate"] == "mapeado_por_feature" and status["csv_final", "other"] == "parcial_por_csv_exportado" and status["bruto", "crs"] == "parcial_por_tabela"
    expected = spark.createDataFrame([("a.csv", c) for c in ("low_vigor_rate", "other", "lost")], "csv string, column_name string")
    coverage = I.csv_coverage(index, expected)
    (c,) = coverage.collect()
    assert (c.columns_total, c.columns_with_lineage, c.strong_or_partial_lineage, c.unmapped_columns) == (3, 2, 1, "lost")
    critical = spark.createDataFrame([("t", 7, 7)], "target string, passed int, checks int")
    rules = spark.createDataFrame([("r", 3)], "rule_id string, affected_rows int")
    gates = I.acceptance_gates(index, coverage, critical, rules, 4)
    assert {r.gate_id[:2]: r.status for r in gates.collect()} == {"G1": "falha", "G2": "ok", "G3": "ok", "G4": "ok", "G5": "ok", "G6": "aceito_com_limitacao"}
    assert I.manifest_summary(index, coverage, gates, rules).first().failed_gates == 1 and I.records_for(index, "b1_mean", layer="bruto").count() == 1
    nodes, edges = I.atlas_graph(index)
    assert edges.where("relation = 'sustenta'").count() >= 2 and nodes.where("kind = 'tabela'").count() == 5
    told = I.explained_correlations(spark.createDataFrame([("low_vigor_flag", "target_x", 0.5)], "feature string, target string, pearson double"), index, {"target_x": "ndvi_mean_week"}).first()
    assert (told.feature_definition, told.target_definition) == ("baixo", "media")
    days = spark.createDataFrame([("s", D(2025, 1, 6))], "season_id string, week_start date")
    images = spark.createDataFrame([("s", D(2025, 1, 9), "n.jpg"), ("s", D(2025, 2, 9), "f.jpg")], "season_id string, date date, path string")
    line = spark.createDataFrame([("s", "p", D(2025, 1, 6), True, False, 2), ("t", "p", None, None, True, 0)], "season_id string, comparison_pair string, week_start date, a_flag boolean, b_flag boolean, risk_flag_count int")
    many = days.withColumn("v", F.explode(F.sequence(F.lit(1), F.lit(30))))
    pairs = spark.createDataFrame([("p", D(2025, 1, 6), float(i)) for i in range(9)], "comparison_pair string, week_start date, gap double")
    built = I.audit_index(line, days, pairs, many, images)
    assert "WindowGroupLimit" in I.first_rows_json(many, ["season_id"], 8, "r")._jdf.queryExecution().toString()
    out = {r.season_id: r for r in built.collect()}
    a = out["s"]
    assert (a.audit_id, a.nearest_path, a.active_flags, len(a.event_rows), len(a.raw_rows), len(a.pair_rows)) == ("audit:s:2025-01-06", "n.jpg", ["a_flag", "risk_flag_count"], 1, 8, 4)
    texts = sorted(r[0] for r in many.select(F.to_json(F.struct("season_id", "week_start", "v", F.col("week_start").alias("__day")))).collect())
    assert a.raw_rows == texts[:8] and (out["t"].active_flags, out["t"].raw_rows) == (["b_flag"], [])
    assert I.entity_index({"area": (days, "season_id", "season_id")}).first().entity_id == "area:s"


def drop(root):
    """A small drop: two seasons side by side over eight weeks."""
    def put(path, text):
        (root / path).parent.mkdir(parents=True, exist_ok=True)
        (root / path).write_text(text, encoding="utf-8")

    put("Cropman1/CSV/soil_analysis.csv", "AMOSTRA;PH\n1;5,5\n2;6,1\n")
    scenes = ["season_id,filename,b1_valid_pixels,b1_mean,b1_std,b1_pct_solo,b1_pct_veg_densa,bounds_left,bounds_bottom,bounds_right,bounds_top"]
    for s, x, base, step in (("s1", 0, 0.4, 0.05), ("s2", 2000, 0.7, -0.06)):
        for w in range(8):
            day = D(2025, 11, 3) + dt.timedelta(weeks=w)
            scenes.append(f"{s},img{s}_{day}.tiff,{0 if w == 7 else 100},{base + step * w:.3f},0.1,{10 + w},60,{x},0,{x + 1000},1000")
    put("OneSoil1/CSV/ndvi_metadata.csv", "\n".join(scenes) + "\n")
    put("Metos1/CSV/w.csv", "Data;Precipitação (mm);Evapotranspiração (mm);Temp. Média (°C)\n" + "".join(f"{(D(2025, 11, 3) + dt.timedelta(days=i)).strftime('%d/%m/%Y')} - 10:00 / GMT -3;{i % 5},5;2,0;22\n" for i in range(40)))
    put("EKOS1/CSV/Pest/traps_list.csv", "code;type;plot;latitude;longitude;id;farm;businessUnit;radius;installationDate\nc1;ELECTRONIC;p1;0,004;0,004;1;1;1;5;2025-01-01\nc2;CONVENTIONAL;;0,004;0,022;2;1;1;5;2025-01-01\n")
    put("EKOS1/CSV/Pest/traps_data.csv", "trapCode;trapType;primaryPest;trapInfestationLevel;doneMissionCount;idBusinessUnit;lateMissionCount;pendingMissionCount;pestCount;trapId;createdAt\nc1;ELECTRONIC;Lagárta;x;1;1;1;1;3;1;2025-11-04T10:00:00Z\nc2;CONVENTIONAL;lagarta;x;1;1;1;1;30;2;2025-11-05T10:00:00Z\n")
    put("EKOS1/CSV/Pest/pest_list.csv", "MIIP_PEST_ID;MIIP_PEST_NAME_POPULAR;MIIP_PEST_NAME_SCIENTIFIC;MIIP_PEST_ALERT;MIIP_PEST_CONTROL;MIIP_PEST_DAMAGE\n1;Lagarta;S;10;20;\n")
    put("EKOS1/CSV/Pest/pest_details.csv", "id;namePopular;nameScientific;alert;control;damage;actionRay;daysAdhesiveFloor;daysPheromone\n1;LAGARTA;S;1;2;25;50;1;1\n")
    put("EKOS1/CSV/Pest/traps_events.csv", 'trapCode;type;detection;farm;id;pestCount;trapId;createdAt\nc1;IMAGE;"[{""name"":""Spodoptera"",""confidence"":0.9}]";1;1;1;1;2025-11-04T11:00:00Z\n')
    head = "Date Time;geometry;Operation"
    put("EKOS1/CSV/Layers/LAYER_MAP_PLANTING.csv", f"{head};Area - ha;Population - ha\n05/11/2025 10:00:00;POINT (0.004 0.004);PLANTIO;1,5;60000\n")
    put("EKOS1/CSV/Layers/LAYER_MAP_GRAIN_HARVESTING.csv", f"{head};Area - ha;Yield - kg/ha;Weight - kg;Humidity - %\n20/12/2025 10:00:00;POINT (0.004 0.004);COLHEITA;1;5000;10;14\n20/12/2025 10:00:00;POINT (0.022 0.004);CALAGEM;1;9999;10;14\n")
    put("EKOS1/CSV/Layers/LAYER_MAP_OVERLAP.csv", "Date Time;geometry;OverlapArea - ha\n05/11/2025 10:00:00;POINT (0.022 0.004);0,5\n")
    put("EKOS1/CSV/Layers/LAYER_MAP_ENGINE_TEMPERATURE.csv", "Date Time;geometry;EngineTemperature - ºC\n05/11/2025 10:00:00;POINT (0.022 0.004);90\n05/11/2025 11:00:00;POINT (0.022 0.004);70\n")


def test_a_season_from_its_drop(spark, tmp_path):
    from furrow.plans.season import season_tables

    drop(tmp_path)
    official = spark.createDataFrame([("s1", "Um", TECH, "grao", "grao", "official", ""), ("s2", "Dois", CONV, "grao", "grao", "official", "")], "season_id string, area_label string, treatment string, crop_type string, comparison_pair string, mapping_source string, notes string")

    def keep(df, name):
        df.write.parquet(str(tmp_path / "kept" / name))
        return spark.read.parquet(str(tmp_path / "kept" / name))

    tables, gaps = season_tables(spark, str(tmp_path), official, keep=keep)
    assert set(tables) == set(sinks.ALL_TABLES) and {"area_inventory", "data_audit", "decision_summary", "ops_support_weekly", "miip_daily"} <= set(tables)
    inventory = {r.season_id: r for r in tables["area_inventory"].collect()}
    assert (inventory["s1"].total_images, inventory["s1"].invalid_images, inventory["s1"].harvest_yield_mean_kg_ha, inventory["s2"].harvest_yield_mean_kg_ha, inventory["s2"].overlap_area_ha, inventory["s1"].soil_samples_available) == (8, 1, 5000.0, None, 0.5, 2)
    assert inventory["s2"].overlap_area_pct_bbox == pytest.approx(0.5 / 100)
    traps = {r.season_id: r for r in tables["miip_daily"].collect()}
    assert (traps["s1"].alert_hits, traps["s2"].alert_hits, traps["s2"].damage_hits, traps["s1"].detected_species) == (0, 1, 1, "Spodoptera")
    timeline = tables["ndvi_phase_timeline"].where("season_id = 's1'").orderBy("week_start").collect()
    assert timeline[1].pair_ndvi_gap_4_0_minus_conv == pytest.approx(0.45 - 0.64) and timeline[0].story_sentence.startswith("2025-11-03: Um ficou em fase ")
    audit = {r.season_id: r for r in tables["data_audit"].collect()}
    assert tuple(audit["s1"].asDict()) == T.AUDIT_COLUMNS and (audit["s1"].ndvi_weeks, audit["s1"].miip_weeks, audit["s1"].audit_status, audit["s1"].weather_window) == (7, 1, "atencao", "2025-11-03 -> 2025-12-12")
    (d,) = tables["ndvi_pair_diagnostics"].collect()
    assert d.trajectory_winner in ("4.0", "convencional", "sem vantagem clara") and N.GAP_YIELD in d.known_gaps
    assert {r.hypothesis_id for r in tables["final_hypothesis_register"].collect()} == set(N.HYPOTHESES) and tables["decision_summary"].first().decision_message.startswith("No par grao, ")
    assert all(r.recommended_actions and r.expected_harvest_note for r in tables["ndvi_outlook"].collect())
    assert any("alarmes" in g for g in gaps) and len(gaps) == len(set(gaps))
    rows = {r.dataset: r for r in tables["dataset_overview"].collect()}
    assert (rows["ndvi_clean"].rows, rows["ndvi_clean"].unique_seasons, str(rows["ndvi_clean"].date_start)[:10], rows["soil_context"].sample_columns) == (14, 2, "2025-11-03", "AMOSTRA, PH")
    assert {(r.weeks, r.trend_direction) for r in tables["ndvi_trend_tests"].collect()} == {(7, "crescimento_significativo"), (7, "queda_significativa")}
    (model,) = tables["transition_model_summary"].collect()
    assert model.observations == 12 and model.model_choice == "ridge_linear_interpretavel" and tables["transition_model_predictions"].count() == 12
    outliers = tables["ndvi_outliers"].collect()
    assert len(outliers) == 14 and len(outliers[0]) == 16 and not any(r.outlier_flag for r in outliers)
    assert {r.analysis_target for r in tables["weekly_correlations"].collect()} == {"nivel_ndvi", "delta_ndvi_seguinte"} and "sem_relacao" in {r.strength for r in tables["weekly_correlations"].collect()}
    tests = {r.metric: r for r in tables["pair_classic_tests"].collect()}
    assert tests["ndvi_mean_week"].weeks_compared == 7 and tests["ndvi_mean_week"].recommended_test in ("ttest_1samp", "wilcoxon") and tests["low_vigor_flag"].metric_label == "Semanas de baixo vigor"
    assert {r.dataset for r in tables["numeric_profiles"].collect()} == {"ndvi_clean", "weather_daily", "ops_area_daily", "miip_daily", "transition_model_frame"}
    assert tables["pair_weekly_gaps"].where("paired_week_flag").count() == 7 and tables["ndvi_stats_by_area"].where("season_id = 's1'").first().images_valid == 7
    folder = f"file://{tmp_path}/season"
    sinks.publish(spark, tables, folder, facts={"gaps": gaps})
    back = sinks.published(spark, folder)
    assert set(back) == set(sinks.ALL_TABLES) and sinks.manifest(spark, sinks.versions(spark, folder)[-1])["gaps"] == gaps
    sinks.save_tables({n: tables[n] for n in ("data_audit", "hypothesis_matrix")}, str(tmp_path / "out"))
    assert {r.name for r in sinks.table_status(spark, str(tmp_path / "out"), ["data_audit", "hypothesis_matrix", "none"]).collect()} == {"data_audit", "hypothesis_matrix"}


def test_encodings(spark, tmp_path):
    (tmp_path / "l.csv").write_bytes("Estação;x\né;1\n".encode("latin-1"))
    (tmp_path / "u.csv").write_bytes("Estação;x\né;1\n".encode())
    assert [C.encoding(spark, str(tmp_path / f)) for f in ("l.csv", "u.csv")] == ["ISO-8859-1", "UTF-8"]
    assert C.read_text_columns(spark, str(tmp_path / "l.csv")).first()["Estação"] == "é"
    assert C.file_summary(spark, str(tmp_path / "u.csv"), ";").first().rows == 1
