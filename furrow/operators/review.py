"""The review tables of a season: overviews, profiles, statistics by area, outliers, weekly gaps, tests, trends and correlations, in their columns and orders."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, NumericType

from furrow.functions.exprs import exact_mean
from furrow.operators import pairs as P
from furrow.operators.order import joined
from furrow.operators.profile import numeric_profile
from furrow.operators.trial import fixed_columns, in_order
from furrow.operators.weekly import ndvi_weekly, pair_panel
from furrow.operators.windows import scores

# The tables of the overview, the profiled columns by table, the columns and labels of correlations.
OVERVIEW = ("ndvi_clean", "weather_daily", "ops_area_daily", "miip_daily", "ndvi_phase_timeline", "transition_model_frame", "transition_model_predictions", "soil_context")
TARGETS = {"ndvi_mean_week": "nivel_ndvi", "target_next_ndvi_delta": "delta_ndvi_seguinte"}
FEATURES = (
    "soil_pct_week", "dense_veg_pct_week", "precipitation_mm_week", "water_balance_mm_week", "temp_avg_c_week", "humidity_avg_pct_week", "avg_pest_count_week", "fert_dose_gap_abs_mean_kg_ha_week",
    "overlap_area_pct_bbox_week", "stop_duration_h_per_bbox_ha_week", "invalid_telemetry_share_week", "alarm_events_week", "engine_temp_hot_share_week", "risk_flag_count", "low_vigor_flag", "major_drop_flag", "pest_risk_flag",
    "ops_risk_flag",
)
PROFILED = {
    "ndvi_clean": ("ndvi_mean", "ndvi_std", "soil_pct", "dense_veg_pct", "ndvi_delta", "ndvi_auc", "b1_valid_pixels"),
    "weather_daily": ("precipitation_mm", "evapotranspiration_mm", "water_balance_mm", "solar_radiation_w_m2", "temp_avg_c", "temp_max_c", "temp_min_c", "humidity_avg_pct", "wind_avg_kmh"),
    "ops_area_daily": ("planting_population_mean_ha", "harvest_yield_mean_kg_ha", "harvest_humidity_mean_pct", "fert_dose_gap_abs_mean_kg_ha", "overlap_area_pct_bbox", "stop_duration_h_per_bbox_ha"),
    "miip_daily": ("avg_pest_count", "total_pest_count", "alert_hits", "control_hits", "damage_hits", "image_pest_count", "detected_boxes"),
    "transition_model_frame": ("target_next_ndvi_delta", "ndvi_mean_week", "ndvi_delta_week", *FEATURES[:14]),
}
# Labels of the metrics that the classic tests compare.
METRIC_LABELS = {
    "ndvi_mean_week": "NDVI medio semanal", "ndvi_auc_week": "Area sob a curva do NDVI", "low_vigor_flag": "Semanas de baixo vigor", "major_drop_flag": "Semanas de queda relevante",
    "pest_risk_flag": "Semanas com risco de praga", "ops_risk_flag": "Semanas com risco operacional", "high_soil_flag": "Semanas com solo exposto relevante", "avg_pest_count_week": "Contagem media de pragas",
    "fert_dose_gap_abs_mean_kg_ha_week": "Gap absoluto de dose na adubacao", "overlap_area_pct_bbox_week": "Sobreposicao operacional relativa", "stop_duration_h_per_bbox_ha_week": "Horas de parada por area",
    "invalid_telemetry_share_week": "Falha de telemetria", "alarm_events_week": "Alertas de maquina",
}
DATES = ("date", "week_start", "timestamp", "Date Time")
AREA = ("season_id", "area_label", "treatment", "crop_type", "comparison_pair")
OUTLIER_COLUMNS = (
    "season_id", "date", "week_start", "area_label", "treatment", "comparison_pair", "ndvi_mean", "soil_pct", "dense_veg_pct", "ndvi_zscore", "ndvi_robust_zscore", "outlier_zscore_flag", "outlier_robust_flag", "outlier_flag",
    "outlier_direction", "image_path",
)
SIDES_OF_NDVI = ("ndvi_abaixo_do_padrao", "ndvi_acima_do_padrao")


def overview(tables: dict[str, DataFrame]) -> DataFrame:
    """A row per table: rows, columns, numeric and boolean columns, empty cells and their share, seasons, areas, dates, the first eight columns."""
    parts = []
    for name, df in tables.items():
        n = F.count(F.lit(1))
        empty = reduce(lambda a, b: a + b, [F.count_if(F.col(f"`{c}`").isNull()) for c in df.columns])
        numeric = sum(isinstance(f.dataType, (NumericType, BooleanType)) for f in df.schema)
        distinct = lambda c: F.count_distinct(c) if c in df.columns else F.lit(None).cast("long")  # noqa: E731,B023
        date = next((c for c in DATES if c in df.columns), None)
        day = F.try_to_timestamp(F.col(f"`{date}`").cast("string")) if date else F.lit(None).cast("timestamp")
        parts.append(df.agg(n.alias("rows"), empty.alias("null_cells"), distinct("season_id").alias("unique_seasons"), distinct("area_label").alias("unique_areas"), F.min(day).alias("date_start"), F.max(day).alias("date_end")).select(
            F.lit(name).alias("dataset"), "rows", F.lit(len(df.columns)).cast("long").alias("columns"), F.lit(numeric).cast("long").alias("numeric_columns"), "null_cells", F.try_divide("null_cells", F.col("rows") * len(df.columns)).alias("null_ratio"),
            "unique_seasons", "unique_areas", "date_start", "date_end", F.lit(", ".join(df.columns[:8])).alias("sample_columns"),
        ))
    return in_order(reduce(DataFrame.unionByName, parts), "dataset")


def _counted(profile: DataFrame) -> DataFrame:
    return profile.withColumnsRenamed({"n": "count", "skewness": "skew"})


def numeric_profiles(tables: dict[str, DataFrame], spec: dict[str, tuple[str, ...]] | None = None) -> DataFrame:
    """(dataset, variable, profile) of the columns that each table has."""
    parts = [_counted(numeric_profile(tables[name], [c for c in columns if c in tables[name].columns])).select(F.lit(name).alias("dataset"), "*") for name, columns in (spec or PROFILED).items() if name in tables and set(columns) & set(tables[name].columns)]
    return in_order(reduce(DataFrame.unionByName, parts), "dataset", "variable")


def stats_by_area(clean: DataFrame) -> DataFrame:
    """A field's images, weeks, first and last scene, mean cover and the profile of its index."""
    sums = clean.groupBy(*AREA).agg(
        F.count("ndvi_mean").alias("images_valid"), F.count_distinct("week_start").alias("weeks_with_scenes"), F.min("date").alias("scene_start"), F.max("date").alias("scene_end"), F.avg("soil_pct").alias("soil_pct_mean"),
        F.avg("dense_veg_pct").alias("dense_veg_pct_mean"), exact_mean("ndvi_mean").alias("__mean"),
    )
    profile = _counted(numeric_profile(clean, ["ndvi_mean"], list(AREA))).drop("variable")
    out = joined(sums, profile, list(AREA), "left").withColumns({"mean": F.col("__mean"), "cv": F.abs(F.try_divide("std", "__mean"))})
    return in_order(out.drop("__mean"), "comparison_pair", "area_label")


def outliers(clean: DataFrame) -> DataFrame:
    """Every scene with its scores and flags, outliers first; an unknown score raises no flag, and counts as above."""
    scored = scores(clean, "ndvi_mean", ["season_id"]).withColumnsRenamed({"z_score": "ndvi_zscore", "robust_z_score": "ndvi_robust_zscore"})
    beyond = lambda c, least: F.coalesce(F.abs(c) >= least, F.lit(False))
    scored = scored.withColumns({"outlier_zscore_flag": beyond("ndvi_zscore", 2.0), "outlier_robust_flag": beyond("ndvi_robust_zscore", 3.5)})
    scored = scored.withColumns({"outlier_flag": F.col("outlier_zscore_flag") | F.col("outlier_robust_flag"), "outlier_direction": F.when(F.col("ndvi_zscore") < 0, SIDES_OF_NDVI[0]).otherwise(SIDES_OF_NDVI[1])})
    return in_order(fixed_columns(scored, OUTLIER_COLUMNS), "-outlier_flag", "comparison_pair", "area_label", "date", "ndvi_zscore")


def pair_weekly_gaps(timeline: DataFrame) -> DataFrame:
    """Weeks of pairs that have both sides: labels and seasons, metrics and gaps of both sides (flags as 0 and 1)."""
    metrics = sorted(m for m in P.CLASSIC if m in timeline.columns)
    both = timeline.groupBy("comparison_pair").agg(*[F.bool_or(F.col("treatment") == s).alias(f"__{i}") for i, s in enumerate(P.SIDES)]).where("__0 and __1").select("comparison_pair")
    numbers = timeline.join(both, "comparison_pair", "left_semi").withColumns({m: F.col(m).cast("double") for m in metrics})
    sides = {f"{c}{x}": F.min(F.when(F.col("treatment") == s, F.col(c))) for c in ("area_label", "season_id") for s, x in zip(P.SIDES, ("_4_0", "_convencional"), strict=True)}
    names = numbers.groupBy("comparison_pair", "week_start").agg(*[a.alias(n) for n, a in sides.items()])
    wide = joined(names, pair_panel(numbers, metrics), ["comparison_pair", "week_start"])
    wide = wide.where(F.coalesce("season_id_4_0", "season_id_convencional").isNotNull()).withColumns({"tech_area_label": F.col("area_label_4_0"), "conv_area_label": F.col("area_label_convencional")})
    return in_order(wide, "comparison_pair", "week_start")


def classic_tests(timeline: DataFrame) -> DataFrame:
    """The classic tests by pair and metric, with the metric's label and the gaps' median, spread and scores."""
    from furrow.operators.order import quantiles

    values = P.paired_values(timeline, list(P.CLASSIC))
    keys = ["comparison_pair", "metric"]
    tests = P.classic_tests(timeline)
    sums = P.effect_summary(values, keys).select(*keys, "mean_4_0", "mean_convencional", "effect_size", "mean_zscore")
    spread = values.groupBy(*keys).agg(F.stddev_samp("gap").alias("std_gap"))
    middle = quantiles(values, keys, "gap", [0.5]).toDF(*keys, "median_gap")
    better = P.higher_is_better("metric")
    label = F.create_map(*[F.lit(x) for kv in METRIC_LABELS.items() for x in kv])
    out = joined(joined(joined(tests, sums, keys), spread, keys), middle, keys)
    gap = F.col("mean_gap")
    return in_order(out.select(
        "comparison_pair", "metric", F.try_element_at(label, F.col("metric")).alias("metric_label"), F.col("n").alias("weeks_compared"), "mean_4_0", "mean_convencional", gap.alias("mean_gap_4_0_minus_convencional"),
        F.when(better, gap).otherwise(-gap).alias("mean_favorable_gap_4_0"), F.col("median_gap").alias("median_gap_4_0_minus_convencional"), F.col("std_gap").alias("std_gap_4_0_minus_convencional"), F.col("mean_zscore").alias("gap_zscore_mean"),
        F.col("shapiro_p").alias("normality_shapiro_p"), F.col("t_p").alias("ttest_gap_vs_zero_p"), F.col("wilcoxon_p").alias("wilcoxon_gap_vs_zero_p"), F.col("p_value").alias("recommended_p_value"), "recommended_test",
        F.col("effect_size").alias("paired_effect_size_dz"), "favors", F.col("significant").alias("significant_0_05"),
    ), "comparison_pair", "recommended_p_value", "metric_label")


def trend_tests(clean: DataFrame) -> DataFrame:
    """The weekly trend of each field's index."""
    keys = ["season_id", "area_label", "treatment", "comparison_pair"]
    weeks = joined(ndvi_weekly(clean), clean.select(*keys).distinct(), ["season_id"], "left")
    out = P.trends(weeks, "ndvi_mean_week", keys)
    return in_order(out.select(
        *keys, F.col("n").alias("weeks"), F.col("slope").alias("slope_ndvi_per_week"), F.col("intercept").alias("intercept_ndvi"), F.col("r").alias("r_value"), F.col("r2").alias("r_squared"), "p_value", "stderr",
        F.col("direction").alias("trend_direction"),
    ), "comparison_pair", "area_label")


def weekly_correlations(frame: DataFrame) -> DataFrame:
    """Correlations of the transition frame's targets with its features, over all and by pair."""
    out = P.correlations(frame, [t for t in TARGETS if t in frame.columns], [f for f in FEATURES if f in frame.columns], "comparison_pair", with_p=True)
    label = F.create_map(*[F.lit(x) for kv in TARGETS.items() for x in kv])
    return in_order(out.select(
        F.try_element_at(label, F.col("target")).alias("analysis_target"), F.col("scope").alias("comparison_pair"), "feature", F.col("n").alias("observations"), F.col("pearson").alias("pearson_r"), "pearson_p",
        F.col("spearman").alias("spearman_rho"), "spearman_p", F.col("strongest").alias("strongest_abs_correlation"), "direction", "strength",
    ), "analysis_target", "comparison_pair", "-strongest_abs_correlation")
