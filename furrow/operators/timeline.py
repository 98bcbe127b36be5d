"""Weekly timeline rules: thresholds, flags, phases, events, driver candidates and places within a pair."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from furrow.functions.exprs import flag, top_labels
from furrow.operators.order import quantile_row
from furrow.operators.windows import delta, lag_flags, min_max, weeks_from_peak
from furrow.sources.scratch import staged

# Fixed values: (column, quantile, default) of each threshold over the whole timeline.
THRESHOLDS = {
    "high_soil": ("soil_pct_week", 0.75, 20.0),
    "weather_stress": ("water_balance_mm_week", 0.25, -10.0),
    "pest": ("avg_pest_count_week", 0.75, 20.0),
    "fert": ("fert_dose_gap_abs_mean_kg_ha_week", 0.75, 150.0),
    "overlap": ("overlap_area_pct_bbox_week", 0.75, 0.04),
    "stop": ("stop_duration_h_per_bbox_ha_week", 0.75, 0.02),
    "telemetry": ("invalid_telemetry_share_week", 0.75, 0.05),
    "engine_hot": ("engine_temp_max_c_week", 0.90, 85.0),
    "engine_idle": ("engine_idle_share_week", 0.75, 0.25),
}
# The flags that count as risks, and those that are lagged.
RISKS = ("high_soil_flag", "weather_stress_flag", "pest_risk_flag", "fert_risk_flag", "overlap_risk_flag", "stop_risk_flag", "telemetry_risk_flag", "alert_risk_flag", "engine_risk_flag")
LAGGED = ("major_drop_flag", *RISKS)
# Labels and weights of drivers, each with its flag.
DRIVERS = (
    ("pest_risk_flag", 3.0, "pressao_de_pragas"), ("weather_stress_flag", 2.8, "estresse_climatico"), ("high_soil_flag", 2.2, "solo_exposto"), ("fert_risk_flag", 2.0, "falha_de_dose_na_adubacao"),
    ("overlap_risk_flag", 1.7, "sobreposicao_operacional"), ("stop_risk_flag", 1.5, "paradas_operacionais"), ("telemetry_risk_flag", 1.3, "falha_de_telemetria"),
    ("alert_risk_flag", 1.2, "alertas_de_maquina"), ("engine_risk_flag", 1.0, "risco_de_maquina"),
)

# The flags of the lift and their labels there, which are not those of the drivers in all cases.
LIFT_LABELS = {
    "high_soil_flag": "solo_exposto", "weather_stress_flag": "estresse_climatico", "pest_risk_flag": "pressao_de_pragas", "fert_risk_flag": "falha_de_dose_na_adubacao", "overlap_risk_flag": "sobreposicao_operacional",
    "stop_risk_flag": "tempo_parado", "telemetry_risk_flag": "falha_de_telemetria", "alert_risk_flag": "alertas_de_maquina", "engine_risk_flag": "risco_de_motor",
}


def quantile_thresholds(timeline: DataFrame, spec: dict[str, tuple[str, float, float]] | None = None) -> DataFrame:
    """One row thr_<name>: exact quantiles over the whole timeline, the default where the column lacks or is all null."""
    spec = spec or THRESHOLDS
    there = {f"thr_{n}": (c, q) for n, (c, q, _) in spec.items() if c in timeline.columns}
    row = quantile_row(timeline, [], there) if there else timeline.sparkSession.range(1)
    return row.select(*[(F.coalesce(f"thr_{n}", F.lit(d)) if f"thr_{n}" in there else F.lit(d)).alias(f"thr_{n}") for n, (_, _, d) in spec.items()])


def weekly_flags(timeline: DataFrame) -> DataFrame:
    """The timeline with its flags; a comparison with an unknown value is false, and columns that lack are unknown."""
    has = set(timeline.columns)
    col = lambda c: F.col(c) if c in has else F.lit(None).cast("double")
    thr = lambda n: F.col(f"thr_{n}")
    at_least = lambda c, n: flag(col(c) >= thr(n))
    df = timeline.join(F.broadcast(quantile_thresholds(timeline)))  # one row
    d, norm = col("ndvi_delta_week"), col("ndvi_norm_week")
    covered = flag(col("has_weather_coverage_week").cast("boolean"))
    flags = {
        "major_drop_flag": flag(d <= -0.08), "severe_drop_flag": flag(d <= -0.15), "recovery_flag": flag(d >= 0.08), "low_vigor_flag": flag(norm <= 0.35), "high_soil_flag": at_least("soil_pct_week", "high_soil"),
        "weather_stress_flag": covered & flag(col("water_balance_mm_week") <= thr("weather_stress")),
        "weather_relief_flag": covered & flag(col("water_balance_mm_week") > 0) & flag(col("precipitation_mm_week") > 20),
        "pest_risk_flag": at_least("avg_pest_count_week", "pest") | flag(col("alert_hits_week") > 0) | flag(col("damage_hits_week") > 0),
        "fert_risk_flag": at_least("fert_dose_gap_abs_mean_kg_ha_week", "fert"), "overlap_risk_flag": at_least("overlap_area_pct_bbox_week", "overlap"), "stop_risk_flag": at_least("stop_duration_h_per_bbox_ha_week", "stop"),
        "telemetry_risk_flag": at_least("invalid_telemetry_share_week", "telemetry"), "alert_risk_flag": flag(col("alarm_events_week") > 0) | flag(col("param_alert_events_week") > 0),
        "engine_risk_flag": at_least("engine_temp_max_c_week", "engine_hot") | at_least("engine_idle_share_week", "engine_idle") | flag(col("fuel_zero_share_week") >= 0.4),
    }
    df = df.withColumns(flags)
    ops = F.lit(False)
    for f in RISKS[3:]:
        ops = ops | F.col(f)
    count = sum((F.col(f).cast("int") for f in RISKS[1:]), F.col(RISKS[0]).cast("int"))
    return df.withColumns({"ops_risk_flag": ops, "risk_flag_count": count}).drop(*[f"thr_{n}" for n in THRESHOLDS])


def phase(ndvi: Column, change: Column, norm: Column, from_peak: Column, dropped_before: Column) -> Column:
    """The growth phase by the first rule that holds; unknown measures count as 0."""
    d, n, w = (F.coalesce(c, F.lit(0.0)) for c in (change, norm, from_peak))
    return (
        F.when(ndvi.isNull(), "sem_cena").when(d <= -0.15, "queda_forte").when(d <= -0.08, "queda").when((d >= 0.08) & dropped_before, "recuperacao")
        .when((n <= 0.35) & (w < 0), "estabelecimento").when((n >= 0.85) & (F.abs(d) <= 0.05), "pico").when((w > 0) & (d < -0.02), "senescencia").when(d > 0.05, "expansao").otherwise("estavel")
    )


def event(ndvi: Column, phase_: Column, low_vigor: Column, risks: Column) -> Column:
    return F.when(ndvi.isNull(), None).when(phase_.isin("queda_forte", "queda", "recuperacao", "pico"), phase_).when(low_vigor & (risks >= 2), "baixo_vigor")


def drivers(event_: Column) -> Column:
    """Labels of the three heaviest drivers that hold now or (but for exposed soil) held in the row before."""
    recovering = flag(event_ == "recuperacao")
    candidates = [(F.col(f) | (F.col(f + "_lag1") if f != "high_soil_flag" else F.lit(False)), w, label) for f, w, label in DRIVERS]
    candidates += [
        (recovering & F.col("weather_relief_flag"), 2.3, "alivio_climatico"), (recovering & ~F.col("pest_risk_flag") & ~F.col("high_soil_flag"), 1.6, "ambiente_mais_estavel"),
        (recovering & ~F.col("ops_risk_flag"), 1.3, "operacao_sem_desvio_forte"),
    ]
    return top_labels(candidates)


def pair_position(gap: Column) -> Column:
    """gap is the row's own side less the other's."""
    return F.when(gap.isNull(), "sem_par_no_periodo").when(F.abs(gap) < 0.03, "equilibrado").when(gap > 0, "acima_do_par").otherwise("abaixo_do_par")


def phase_timeline(weekly: DataFrame, keys: list[str] | None = None, week: str = "week_start") -> DataFrame:
    """The weekly panel with delta, scale, weeks from the peak, flags and lags, phase, event and drivers."""
    keys = keys or ["season_id"]
    df = delta(weekly, "ndvi_mean_week", keys, [week], "ndvi_delta_week")
    # the thresholds are quantiles of the same rows, which are made once
    df = staged(weeks_from_peak(min_max(df, "ndvi_mean_week", keys, "ndvi_norm_week"), "ndvi_mean_week", keys, week), "weeks")
    df = lag_flags(weekly_flags(df), list(LAGGED), keys, [week])
    ndvi = F.col("ndvi_mean_week")
    df = df.withColumn("phase", phase(ndvi, F.col("ndvi_delta_week"), F.col("ndvi_norm_week"), F.col("weeks_from_peak"), F.col("major_drop_flag_lag1")))
    df = df.withColumn("event_type", event(ndvi, F.col("phase"), F.col("low_vigor_flag"), F.col("risk_flag_count")))
    df = df.withColumn("driver_candidates", F.when(ndvi.isNotNull(), drivers(F.col("event_type"))).otherwise(F.array().cast("array<string>")))
    return df.withColumns({"primary_driver": F.coalesce(F.get("driver_candidates", F.lit(0)), F.lit("sem_driver_forte")), "secondary_driver": F.get("driver_candidates", F.lit(1))})


def driver_lift(timeline: DataFrame, flags: dict[str, str] | None = None, pair: str = "comparison_pair") -> DataFrame:
    """Per pair and driver (label by flag): share of weeks with the flag among problem weeks and among the others, their difference in points, ratio and level.

    Without problem weeks, or without others, that share is unknown, and so are difference and ratio; the level is then baixa.
    """
    flags = flags or {f: label for f, label in LIFT_LABELS.items() if f in timeline.columns}
    problem = F.col("major_drop_flag") | F.col("low_vigor_flag") | flag(F.col("event_type").isin("queda", "queda_forte", "baixo_vigor"))
    rows = timeline.withColumn("__problem", problem).select(pair, "__problem", F.explode(F.array(*[F.struct(F.lit(label).alias("driver"), flag(F.col(f)).cast("double").alias("on")) for f, label in flags.items()])).alias("d"))
    out = rows.groupBy(pair, F.col("d.driver").alias("driver")).agg(
        F.count_if("__problem").alias("problem_weeks"), F.avg(F.when(F.col("__problem"), F.col("d.on"))).alias("problem_rate"), F.avg(F.when(~F.col("__problem"), F.col("d.on"))).alias("baseline_rate")
    )
    points = (F.col("problem_rate") - F.col("baseline_rate")) * 100
    level = F.when(F.col("problem_weeks") < 3, "baixa").when(points >= 20, "alta").when(points >= 10, "media").otherwise("baixa")
    return out.withColumns({"delta_pp": points, "lift_ratio": F.try_divide("problem_rate", "baseline_rate"), "evidence_level": level})


def outlook_score(last4_norm: Column, peak: Column, low_vigor: Column, major_drop: Column, pest: Column, ops: Column, trend: Column) -> Column:
    """Weighted outlook in 0..100, half-even to two places, as bands and gaps judge it; unknown parts take their neutral value."""
    from furrow.functions.exprs import clip01

    held = lambda c, neutral: F.when(c.isNull(), F.lit(neutral)).otherwise(clip01(1 - c))
    parts = [
        0.30 * F.when(last4_norm.isNull(), F.lit(0.5)).otherwise(clip01(last4_norm)), 0.20 * clip01(peak / 0.85), 0.15 * held(low_vigor, 0.5), 0.10 * held(major_drop, 0.4), 0.10 * held(pest, 0.4), 0.10 * held(ops, 0.4),
        0.05 * F.when(trend.isNull(), F.lit(0.5)).otherwise(clip01((trend + 0.12) / 0.24)),
    ]
    return F.bround(100 * sum(parts[1:], parts[0]), 2)


def outlook_band(score: Column) -> Column:
    return F.when(score >= 75, "favoravel").when(score >= 65, "positivo_com_ressalvas").when(score >= 50, "misto").otherwise("atencao")
