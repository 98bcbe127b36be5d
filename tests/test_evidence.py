import datetime as dt

from pyspark.sql import functions as F

from furrow.operators import evidence as EV
from furrow.operators import timeline as T

TECH, CONV = "tecnologia_4_0", "convencional"


def test_weighted_means_and_days(spark):
    rows = [("a", dt.date(2025, 1, 1), 2.0, 1.0, None), ("a", dt.date(2025, 1, 2), 4.0, 3.0, None), ("a", dt.date(2025, 1, 2), 9.0, 0.0, None), ("a", dt.date(2025, 1, 3), None, 5.0, None)]
    df = spark.createDataFrame(rows, "season_id string, date date, v double, w double, s double")
    (r,) = EV.ops_summary(df, {"v": "w"}, ["s"], ["w"]).collect()
    assert (r.ops_days, r.w_days, r.v, r.s) == (3, 3, 3.5, None)


def test_outlook_against_the_pair(spark):
    week = lambda i: dt.date(2025, 11, 3) + dt.timedelta(weeks=i)
    rows = [(s, "p", t, week(i), v(i), 5.0) for s, t, v in (("a", TECH, lambda i: 0.5 + 0.04 * i), ("b", CONV, lambda i: 0.9 - 0.1 * i)) for i in range(6)]
    rows.append(("z", "alone", TECH, week(0), 0.5, 5.0))
    df = spark.createDataFrame(rows, "season_id string, comparison_pair string, treatment string, week_start date, ndvi_mean_week double, soil_pct_week double")
    out = {r.season_id: r for r in EV.outlook(EV.season_summary(T.phase_timeline(df), ["season_id", "comparison_pair", "treatment"])).collect()}
    assert out["a"].expected_vs_pair == "tende_a_chegar_acima_do_par" and out["b"].expected_vs_pair == "tende_a_chegar_abaixo_do_par"
    assert out["z"].expected_vs_pair == "sem_referencia_no_par" and out["a"].trajectory_score > out["b"].trajectory_score
    assert "quedas_relevantes_de_ndvi" in out["b"].top_risks


def test_hypothesis_matrix_is_lowered_by_gaps(spark):
    rows = [("p", TECH, 0.7, None, 1.0, 0.0), ("p", CONV, 0.5, 100.0, 9.0, 0.5)]
    df = spark.createDataFrame(rows, "comparison_pair string, treatment string, ndvi_mean double, harvest_yield_mean_kg_ha double, avg_pest_count double, overlap_area_pct_bbox double")
    (r,) = EV.hypothesis_matrix(df).collect()
    assert r.supports_4_0 == ["ndvi_mean", "avg_pest_count", "overlap_area_pct_bbox"] and r.known_gaps == ["colheita_parcial"] and r.evidence_strength == "baixa"


def test_register_has_four_rows_a_pair(spark):
    effects = spark.createDataFrame([("p", "ndvi_mean_week", "favorece_4_0"), ("p", "low_vigor_flag", "favorece_4_0"), ("p", "major_drop_flag", "favorece_convencional")], "comparison_pair string, metric string, winner string")
    lift = spark.createDataFrame([("p", "x", 12.0, "media"), ("p", "y", 2.0, "baixa")], "comparison_pair string, driver string, delta_pp double, evidence_level string")
    outlooks = spark.createDataFrame([("p", TECH, "tende_a_chegar_acima_do_par"), ("p", CONV, "x")], "comparison_pair string, treatment string, expected_vs_pair string")
    register = EV.hypothesis_register(effects, lift, outlooks)
    assert {r.hypothesis: r.status for r in register.collect()} == {"H1": "suportada", "H2": "parcialmente_suportada", "H3": "suportada", "H4": "suportada"}
    assert EV.decision_summary(register).first().decision == "avancar_4_0"


def test_audit_status(spark):
    df = spark.createDataFrame([(0.5, 1.0, 1.0), (0.9, 0.3, 1.0), (0.9, 0.9, 0.9)], "a double, b double, c double")
    assert [r.s for r in df.coalesce(1).select(EV.audit_status(F.col("a"), F.col("b"), F.col("c")).alias("s")).collect()] == ["critico", "atencao", "ok"]
