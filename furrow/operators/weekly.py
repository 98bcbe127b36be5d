"""Weekly panels: daily facts rolled up by named rules, joined, and compared within pairs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from furrow.functions.exprs import week_start

RULES = {"sum": lambda c: F.coalesce(F.sum(c), F.lit(0.0)), "mean": F.avg, "max": F.max, "min": F.min, "std0": lambda c: F.coalesce(F.stddev_samp(c), F.lit(0.0)), "any": F.bool_or, "days": F.count_distinct}

# The rule of each weekly column of operations, traps and support.
OPS_WEEKLY = {
    "planting_points": "sum", "planting_area_ha": "sum", "planting_population_mean_ha": "mean", "planting_population_p90_ha": "mean", "harvest_points": "sum", "harvest_area_ha": "sum",
    "harvest_yield_mean_kg_ha": "mean", "harvest_yield_p90_kg_ha": "mean", "harvest_weight_kg": "sum", "harvest_humidity_mean_pct": "mean", "fert_points": "sum", "fert_area_ha": "sum",
    "fert_applied_mean_kg_ha": "mean", "fert_configured_mean_kg_ha": "mean", "fert_dose_gap_mean_kg_ha": "mean", "fert_dose_gap_abs_mean_kg_ha": "mean", "fert_dose_ratio_mean": "mean",
    "spray_points": "sum", "spray_pressure_mean_psi": "mean", "spray_pressure_active_share": "mean", "overlap_points": "sum", "overlap_area_ha": "sum", "overlap_area_pct_bbox": "mean",
    "speed_points": "sum", "speed_mean_kmh": "mean", "speed_p90_kmh": "mean", "speed_zero_share": "mean", "state_points": "sum", "state_operation_share": "mean", "state_maneuver_share": "mean",
    "state_transit_share": "mean", "state_supply_share": "mean", "state_stop_share": "mean", "stop_events": "sum", "stop_duration_h": "sum", "stop_known_reason_share": "mean", "stop_duration_h_per_bbox_ha": "mean",
}
TRAP_WEEKLY = {
    "trap_readings": "sum", "traps_reporting": "max", "electronic_readings": "sum", "conventional_readings": "sum", "avg_pest_count": "mean", "total_pest_count": "sum", "alert_hits": "sum",
    "control_hits": "sum", "damage_hits": "sum", "image_events": "sum", "ping_events": "sum", "battery_events": "sum", "image_pest_count": "sum", "detected_boxes": "sum", "avg_action_ray_m": "mean",
}
WEATHER_WEEKLY = {
    "precipitation_mm": "sum", "evapotranspiration_mm": "sum", "water_balance_mm": "sum", "solar_radiation_w_m2": "mean", "temp_avg_c": "mean", "temp_max_c": "max", "temp_min_c": "min",
    "humidity_avg_pct": "mean", "wind_avg_kmh": "mean",
}
SUPPORT_WEEKLY = {
    "alarm_events": "sum", "alarm_type_count": "mean", "param_alert_events": "sum", "param_alert_type_count": "mean", "telemetry_points": "sum", "invalid_telemetry_share": "mean", "external_gps_share": "mean",
    "mobile_comm_share": "mean", "engine_rotation_points": "sum", "engine_rotation_mean_rpm": "mean", "engine_idle_share": "mean", "engine_temp_points": "sum", "engine_temp_mean_c": "mean", "engine_temp_max_c": "max",
    "engine_temp_hot_share": "mean", "fuel_points": "sum", "fuel_consumption_mean_l_h": "mean", "fuel_zero_share": "mean",
}


def roll_up(df: DataFrame, keys: list[str | Column], rules: dict[str, str], suffix: str = "_week") -> DataFrame:
    """Each column that df has, by its rule; columns that it lacks are left out. Sums of nothing are 0."""
    return df.groupBy(*keys).agg(*[RULES[rule](c).alias(c + suffix) for c, rule in rules.items() if c in df.columns])


def weekly(df: DataFrame, rules: dict[str, str], key: str = "season_id", date: str = "date") -> DataFrame:
    """Daily rows of a key by Monday week."""
    return roll_up(df.where(F.col(key).isNotNull() & F.col(date).isNotNull()), [key, week_start(date).alias("week_start")], rules)


def weather_weekly(daily: DataFrame) -> DataFrame:
    days = daily.groupBy("week_start").agg(F.count_distinct("date").alias("weather_days"), *[RULES[r](c).alias(f"{c}_week") for c, r in WEATHER_WEEKLY.items()])
    return days.where("week_start is not null")


def ndvi_weekly(clean: DataFrame) -> DataFrame:
    """Scenes of a field by week: mean, greatest, spread (0 for one scene), running area, cover, weather."""
    return clean.groupBy("season_id", "week_start").agg(
        F.avg("ndvi_mean").alias("ndvi_mean_week"), F.max("ndvi_mean").alias("ndvi_max_week"), F.coalesce(F.stddev_samp("ndvi_mean"), F.lit(0.0)).alias("ndvi_std_week"),
        F.max("ndvi_auc").alias("ndvi_auc_week"), F.avg("soil_pct").alias("soil_pct_week"), F.avg("dense_veg_pct").alias("dense_veg_pct_week"), F.count(F.lit(1)).alias("image_count_week"),
        F.coalesce(F.bool_or("has_weather_coverage"), F.lit(False)).alias("has_weather_coverage_week"),
    )


def join_weekly(panels: list[DataFrame], weather: DataFrame | None, keys: tuple[str, str] = ("season_id", "week_start")) -> DataFrame:
    """Full outer join of panels on field and week, then the farm's weather by week."""
    from furrow.operators.daily import merge_daily

    joined = merge_daily(panels, keys)
    return joined if weather is None else joined.join(weather, keys[1], "left")


def pair_gap(df: DataFrame, metric: str, pair: str = "comparison_pair", week: str = "week_start", side: str = "treatment", sides: tuple[str, str] = ("tecnologia_4_0", "convencional"), name: str | None = None) -> DataFrame:
    """df with the first side's value less the second's in the same pair and week, on the rows of both; null if either lacks."""
    def of(s: str) -> str:
        return f"max(case when {side} = '{s}' then {metric} end) over (partition by {pair}, {week})"

    return df.withColumn(name or f"pair_{metric}_gap", F.expr(f"{of(sides[0])} - {of(sides[1])}"))


def pair_panel(df: DataFrame, metrics: list[str], pair: str = "comparison_pair", week: str = "week_start", side: str = "treatment", sides: tuple[str, str] = ("tecnologia_4_0", "convencional"), suffixes: tuple[str, str] = ("_4_0", "_convencional")) -> DataFrame:
    """A row per pair and week with each metric of both sides, their gap and whether both sides are there: one aggregation instead of a full outer self-join."""
    columns = []
    for m in metrics:
        columns += [F.max(F.when(F.col(side) == s, F.col(m))).alias(m + x) for s, x in zip(sides, suffixes, strict=True)]
    both = [F.bool_or(F.col(side) == s) for s in sides]
    wide = df.groupBy(pair, week).agg(*columns, (both[0] & both[1]).alias("paired_week_flag"))
    return wide.withColumns({f"gap_{m}_4_0_minus_convencional": F.col(m + suffixes[0]) - F.col(m + suffixes[1]) for m in metrics})
