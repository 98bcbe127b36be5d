"""The start of a field trial: area metadata, clean scenes, daily and weekly facts by field, inventory and audit."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from furrow.functions.exprs import flag, safe_divide, text_key, week_start
from furrow.operators.daily import merge_daily, trap_daily, trap_event_daily
from furrow.operators.evidence import audit_status, weighted_mean
from furrow.operators.spatial import assign_points
from furrow.operators.weekly import OPS_WEEKLY, SUPPORT_WEEKLY, TRAP_WEEKLY, join_weekly, ndvi_weekly, pair_gap, weekly
from furrow.operators.windows import delta, latest, running_area

# The columns of area metadata and what a field without an official mapping gets.
AREA_COLUMNS = ("area_label", "treatment", "crop_type", "comparison_pair", "mapping_source", "notes")
UNMAPPED = {"treatment": "indefinido", "crop_type": "desconhecido", "comparison_pair": "desconhecido", "mapping_source": "auto_missing", "notes": "Season sem mapeamento oficial; validar manualmente."}
DIMENSION = ("season_id", "area_label", "treatment", "crop_type", "comparison_pair")
# Weekly metrics whose gap within the pair is kept, and the columns of the audit.
PAIR_GAPS = {"ndvi_mean_week": "pair_ndvi_gap_4_0_minus_conv", "harvest_yield_mean_kg_ha_week": "pair_harvest_gap_4_0_minus_conv", "avg_pest_count_week": "pair_pest_gap_4_0_minus_conv"}
AUDIT_COLUMNS = (
    "season_id", "area_label", "treatment", "crop_type", "comparison_pair", "total_images", "total_valid_images", "invalid_images", "ndvi_valid_ratio", "ndvi_weeks", "ndvi_weather_weeks", "weather_coverage_ratio",
    "miip_days", "miip_weeks", "miip_coverage_ratio", "ops_days", "harvest_days", "fert_days", "overlap_days", "stop_days", "low_vigor_weeks", "major_drop_weeks", "ops_risk_weeks", "pest_risk_weeks", "audit_status", "weather_window",
)


def fixed_columns(df: DataFrame, columns: tuple[str, ...] | list[str]) -> DataFrame:
    """df in exactly these columns: those that it lacks are null, others go."""
    return df.select(*[F.col(f"`{c}`") if c in df.columns else F.lit(None).alias(c) for c in columns])


def present_columns(df: DataFrame, columns: tuple[str, ...] | list[str]) -> DataFrame:
    """Those of the columns that df has, in the order given."""
    return df.select(*[F.col(f"`{c}`") for c in columns if c in df.columns])


def in_order(df: DataFrame, *order: str) -> DataFrame:
    """df sorted by columns, a leading minus for descending; nulls come last in both directions."""
    return df.orderBy(*[F.col(c[1:]).desc_nulls_last() if c.startswith("-") else F.col(c).asc_nulls_last() for c in order])


def rows_of_week(df: DataFrame, keys: dict[str, str], week: str, limit: int = 20, column: str = "week_start") -> DataFrame:
    """The first rows of a key and week, for a report; weeks are compared by their day."""
    same = reduce(lambda a, b: a & b, [F.col(k).cast("string") == v for k, v in keys.items()])
    return df.where(same & (F.substring(F.col(column).cast("string"), 1, 10) == week[:10])).limit(limit)


def area_metadata(scenes: DataFrame, official: DataFrame, manual: DataFrame | None = None) -> DataFrame:
    """A row per season of the scenes: the official mapping, defaults where it has none, and a manual value over either where there is one.

    official and manual hold a row per season_id and any of AREA_COLUMNS.
    """
    seen = scenes.where("season_id is not null").select(F.col("season_id").cast("string").alias("season_id")).distinct()
    base = seen.join(fixed_columns(official, ("season_id", *AREA_COLUMNS)), "season_id", "left")
    missing = F.col("area_label").isNull()
    default = {"area_label": F.concat(F.lit("Area "), F.substring("season_id", 1, 8)), **{c: F.lit(v) for c, v in UNMAPPED.items()}}
    base = base.select("season_id", *[F.when(missing, default[c]).otherwise(F.col(c)).alias(c) for c in AREA_COLUMNS])
    if manual is None:
        return base
    over = manual.select("season_id", *[F.col(c).alias(f"__{c}") for c in AREA_COLUMNS if c in manual.columns])
    joined = base.join(over, "season_id", "left")
    return joined.select("season_id", *[F.coalesce(f"__{c}", c).alias(c) if c in manual.columns else F.col(c) for c in AREA_COLUMNS])


def weather_span(weather_daily: DataFrame) -> DataFrame:
    """One row: first and last day with weather."""
    return weather_daily.agg(F.min(F.to_date("date")).alias("weather_start"), F.max(F.to_date("date")).alias("weather_end"))


def clean_scenes(scenes: DataFrame, areas: DataFrame, weather_daily: DataFrame) -> DataFrame:
    """Scenes with valid pixels, with their area, week, measures, change, running area and whether the weather covers their day."""
    df = scenes.withColumn("date", F.to_date("date")).where(F.coalesce("b1_valid_pixels", F.lit(0)) > 0)
    df = df.join(areas.select("season_id", *[c for c in areas.columns if c not in df.columns]), "season_id", "left")
    df = df.withColumns({"week_start": week_start("date"), "ndvi_mean": F.col("b1_mean"), "ndvi_std": F.col("b1_std"), "soil_pct": F.col("b1_pct_solo"), "dense_veg_pct": F.col("b1_pct_veg_densa")})
    df = delta(df, "ndvi_mean", ["season_id"], ["date", "filename"], "ndvi_delta")
    df = running_area(df, "ndvi_mean", ["season_id"], "date", ["filename"], "ndvi_auc")
    df = df.join(F.broadcast(weather_span(weather_daily)))  # one row
    return df.withColumn("has_weather_coverage", flag(F.col("date").between(F.col("weather_start"), F.col("weather_end")))).drop("weather_start", "weather_end")


def in_window(df: DataFrame, date: str, start: Column | None = None, end: Column | None = None) -> DataFrame:
    """Rows from start to end by day; an end that is None or null does not bind."""
    for bound, keeps in ((start, lambda b: F.col(date) >= F.to_date(b)), (end, lambda b: F.col(date) <= F.to_date(b))):
        if bound is not None:
            df = df.where(bound.isNull() | keeps(bound))
    return df


def placed(layer: DataFrame, boxes: DataFrame) -> DataFrame:
    """A layer's rows with the season of their centroid."""
    return assign_points(layer, boxes, "centroid_lon", "centroid_lat")


def ops_daily(summaries: list[DataFrame], areas: DataFrame) -> DataFrame:
    """Daily layer summaries by field as one table with the field's dimension; overlap and stops also by the area of its box."""
    merged = merge_daily(summaries)
    out = merged.join(present_columns(areas, (*DIMENSION, "bbox_area_ha")), "season_id", "left")
    per_area = {"overlap_area_ha": "overlap_area_pct_bbox", "stop_duration_h": "stop_duration_h_per_bbox_ha"}
    return out.withColumns({n: safe_divide(F.col(c), F.col("bbox_area_ha")) if c in merged.columns else F.lit(None).cast("double") for c, n in per_area.items()})


def support_daily(summaries: list[DataFrame], areas: DataFrame) -> DataFrame:
    return merge_daily(summaries).join(present_columns(areas, DIMENSION), "season_id", "left")


def trap_facts(traps: DataFrame, readings: DataFrame, events: DataFrame, lookup: DataFrame, boxes: DataFrame, areas: DataFrame) -> DataFrame:
    """Trap readings and events by field and day: of each trap its latest row says where it stands, thresholds come by the pest's name."""
    where = assign_points(latest(traps, ["code"], "installationDate", ["id"]), boxes, "longitude", "latitude").select(F.col("code").alias("trapCode"), "season_id")
    read = readings.drop("season_id").join(where, "trapCode", "left").withColumns({"date": F.to_date("createdAt"), "primary_pest_key": text_key("primaryPest")}).join(lookup, "primary_pest_key", "left")
    seen = events.drop("season_id").join(where, "trapCode", "left").withColumn("date", F.to_date("createdAt"))
    return merge_daily([trap_daily(read), trap_event_daily(seen)]).join(present_columns(areas, DIMENSION), "season_id", "left")


def latest_readings(traps: DataFrame, readings: DataFrame) -> DataFrame:
    """Traps with a place, with what their latest reading says."""
    last = latest(readings, ["trapCode"], "createdAt", ["trapId"]).select(F.col("trapCode").alias("code"), "pestCount", "primaryPest", "trapInfestationLevel")
    return traps.where("latitude is not null and longitude is not null").join(last, "code", "left")


def weekly_features(clean: DataFrame, weather_weekly: DataFrame, ops: DataFrame | None, traps: DataFrame | None, areas: DataFrame) -> DataFrame:
    """Scenes, operations and traps by field and week with the farm's weather and the gaps within the pair; parts that are None are left out."""
    scenes = ndvi_weekly(clean).withColumnsRenamed({"ndvi_max_week": "ndvi_peak_week", "image_count_week": "valid_images_week"})
    scenes = delta(scenes, "ndvi_mean_week", ["season_id"], ["week_start"], "ndvi_delta_week")
    panels = [scenes, *[weekly(df, rules) for df, rules in ((ops, OPS_WEEKLY), (traps, TRAP_WEEKLY)) if df is not None]]
    joined = join_weekly(panels, None).join(areas.select(*DIMENSION, "mapping_source"), "season_id", "left").join(weather_weekly, "week_start", "left")
    for metric, name in PAIR_GAPS.items():
        joined = pair_gap(joined, metric, name=name) if metric in joined.columns else joined.withColumn(name, F.lit(None).cast("double"))
    return joined


def with_support(features: DataFrame, support: DataFrame | None) -> DataFrame:
    """The weekly features with the support layers by field and week."""
    return features if support is None else features.join(weekly(support, SUPPORT_WEEKLY), ["season_id", "week_start"], "left")


def scene_summary(scenes: DataFrame) -> DataFrame:
    valid = F.count_if(F.coalesce("b1_valid_pixels", F.lit(0)) > 0)
    return scenes.where("season_id is not null").groupBy("season_id").agg(F.count(F.lit(1)).alias("total_images"), valid.alias("total_valid_images"), F.min("date").alias("first_scene"), F.max("date").alias("last_scene"))


def clean_summary(clean: DataFrame) -> DataFrame:
    return clean.groupBy("season_id").agg(
        F.avg("ndvi_mean").alias("ndvi_mean"), F.max("ndvi_mean").alias("ndvi_peak"), F.max("ndvi_auc").alias("ndvi_auc"), F.avg("soil_pct").alias("soil_pct_mean"), F.avg("dense_veg_pct").alias("dense_veg_pct_mean")
    )


# Days counted by the column that is positive on them.
ACTIVE_DAYS = {"harvest_days": "harvest_points", "fert_days": "fert_points", "overlap_days": "overlap_area_ha", "speed_days": "speed_points", "state_days": "state_points", "stop_days": "stop_events"}


def area_ops_summary(ops: DataFrame) -> DataFrame:
    """A field's season of operations: active days, means weighted by points, sums that stay null without a value."""
    ops = fixed_columns(ops, list(dict.fromkeys((*ops.columns, *ACTIVE_DAYS.values(), "planting_points", "planting_population_mean_ha", "harvest_yield_mean_kg_ha", "harvest_humidity_mean_pct", "fert_dose_gap_abs_mean_kg_ha", "overlap_area_pct_bbox", "stop_duration_h", "stop_duration_h_per_bbox_ha"))))
    days = [F.count_if(F.coalesce(F.col(c).cast("double"), F.lit(0.0)) > 0).alias(n) for n, c in ACTIVE_DAYS.items()]
    weighted = {"planting_population_mean_ha": "planting_points", "harvest_yield_mean_kg_ha": "harvest_points", "harvest_humidity_mean_pct": "harvest_points", "fert_dose_gap_abs_mean_kg_ha": "fert_points"}
    return ops.groupBy("season_id").agg(
        F.count_distinct("date").alias("ops_days"), *days, *[weighted_mean(v, w).alias(v) for v, w in weighted.items()], *[F.sum(F.col(c).cast("double")).alias(c) for c in ("overlap_area_ha", "stop_duration_h")],
        *[F.avg(F.col(c).cast("double")).alias(c) for c in ("overlap_area_pct_bbox", "stop_duration_h_per_bbox_ha")],
    )


def area_trap_summary(traps: DataFrame) -> DataFrame:
    zero = lambda c: F.coalesce(F.sum(c), F.lit(0))
    return traps.where("season_id is not null").groupBy("season_id").agg(
        F.count_distinct("date").alias("miip_days"), zero("trap_readings").alias("trap_readings_total"), F.max("traps_reporting").alias("traps_reporting_max"), F.avg("avg_pest_count").alias("avg_pest_count"),
        *[zero(c).alias(c) for c in ("total_pest_count", "alert_hits", "control_hits", "damage_hits", "image_events")],
    )


def area_inventory(areas: DataFrame, scenes: DataFrame, clean: DataFrame, ops: DataFrame | None, traps: DataFrame | None, soil: DataFrame, weather_daily: DataFrame) -> DataFrame:
    """Area metadata with the season's scenes, operations and traps, the farm's soil samples and the span of its weather."""
    parts = [scene_summary(scenes), clean_summary(clean), *([area_ops_summary(ops)] if ops is not None else []), *([area_trap_summary(traps)] if traps is not None else [])]
    out = areas
    for part in parts:
        out = out.join(part, "season_id", "left")
    zero = lambda c: F.coalesce(c, F.lit(0))
    out = out.withColumn("invalid_images", zero("total_images") - zero("total_valid_images"))
    samples = soil.agg(F.count(F.lit(1)).cast("int").alias("soil_samples_available"))
    return out.join(F.broadcast(samples)).join(F.broadcast(weather_span(weather_daily))).withColumn("soil_context_only", F.lit(True))  # a row each


def data_audit(inventory: DataFrame, clean: DataFrame, weather_daily: DataFrame, traps: DataFrame | None, ops: DataFrame | None, timeline: DataFrame) -> DataFrame:
    """What each field's data covers, and its status.

    ndvi_weather_weeks counts covered scenes, so its ratio to weeks may exceed 1.
    Days of operations and traps are the inventory's.
    """
    scenes = clean.groupBy("season_id").agg(F.count_distinct("date").alias("ndvi_dates"), F.count_distinct("week_start").alias("ndvi_weeks"), F.count_if("has_weather_coverage").alias("ndvi_weather_weeks"))
    phases = timeline.groupBy("season_id").agg(F.count_distinct("week_start").alias("model_weeks"), *[F.count_if(F.col(f"{f}_flag").cast("boolean")).alias(f"{f}_weeks") for f in ("low_vigor", "major_drop", "ops_risk", "pest_risk")])
    out = inventory.join(scenes, "season_id", "left").join(phases, "season_id", "left")
    if traps is not None:
        out = out.join(traps.groupBy("season_id").agg(F.count_distinct(week_start("date")).alias("miip_weeks")), "season_id", "left")
    else:
        out = out.withColumn("miip_weeks", F.lit(None).cast("long"))
    out = out.withColumns({"ndvi_valid_ratio": safe_divide(F.col("total_valid_images"), F.col("total_images")), "weather_coverage_ratio": safe_divide(F.col("ndvi_weather_weeks"), F.col("ndvi_weeks")), "miip_coverage_ratio": safe_divide(F.col("miip_weeks"), F.col("ndvi_weeks"))})
    day = lambda c: F.date_format(c, "yyyy-MM-dd")
    window = F.coalesce(F.concat(day("weather_start"), F.lit(" -> "), day("weather_end")), F.lit("sem_clima_local"))
    status = audit_status(F.col("ndvi_valid_ratio"), F.col("weather_coverage_ratio"), F.col("miip_coverage_ratio"))
    return fixed_columns(out.withColumns({"audit_status": status, "weather_window": window}), AUDIT_COLUMNS)


def scenes_before_weather(clean: DataFrame, weather_daily: DataFrame) -> DataFrame:
    """Scenes of days before the first day with weather."""
    return clean.join(F.broadcast(weather_span(weather_daily))).where(F.to_date("date") < F.col("weather_start")).drop("weather_start", "weather_end")  # one row


def duplicate_columns(columns: list[str]) -> list[str]:
    """Names that a table's header repeats, letter case aside as in Spark, in order, once for each repetition."""
    seen: set[str] = set()
    return [c for c in columns if c.lower() in seen or seen.add(c.lower())]
