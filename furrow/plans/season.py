"""A season from its CSV drop to its tables: every step reads the tables before it, nothing is collected but scalars."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from furrow.operators import narrative as N
from furrow.operators import review as R
from furrow.operators import trial as T
from furrow.operators.daily import hot_share, pest_lookup, summarize_layer, weather_daily
from furrow.operators.evidence import outlook, season_summary
from furrow.operators.pairs import EFFECTS, pair_effects
from furrow.operators.ridge import transition_frame, transition_model
from furrow.operators.spatial import season_boxes
from furrow.operators.timeline import driver_lift, pair_position, phase_timeline
from furrow.operators.weekly import SUPPORT_WEEKLY, weather_weekly, weekly
from furrow.sources import csv as C
from furrow.sources.scratch import staged

def season_tables(spark: SparkSession, root: str, official: DataFrame, manual: DataFrame | None = None, keep: Callable[[DataFrame, str], DataFrame] = staged) -> tuple[dict[str, DataFrame], list[str]]:
    """(tables by name, known gaps) of the drop under root.

    official maps season_id to AREA_COLUMNS. keep(df, name) writes a table that
    several others read and returns it read back, so that it is made once: by
    default in the folder that driver and executors share.
    """
    find = lambda name: C.find_source(spark, root, name)
    scenes = keep(C.load_scenes(spark, find("ndvi_metadata")), "scenes")
    boxes = keep(season_boxes(scenes), "boxes")
    areas = keep(T.area_metadata(scenes, official, manual).join(boxes.select("season_id", "bbox_area_ha"), "season_id", "left"), "areas")
    weather = keep(weather_daily(C.load_weather(spark, find("weather_hourly"))), "weather_daily")
    soil = C.load_soil(spark, find("soil_analysis"))
    clean = keep(T.clean_scenes(scenes, areas, weather), "ndvi_clean")

    def summaries(names: tuple[str, ...]) -> list[DataFrame]:
        out = []
        for name in names:
            layer = C.load_named_layer(spark, root, name)
            if layer is not None:
                rows = T.placed(layer, boxes)
                out.append(hot_share(rows) if name == "engine_temperature" else summarize_layer(rows, name))
        return out

    ops = keep(T.ops_daily(summaries(C.OPS_LAYERS), areas), "ops_area_daily")
    held = summaries(C.SUPPORT_LAYERS)
    support = keep(T.support_daily(held, areas), "ops_support_daily") if held else None
    paths = {n: find(n) for n in ("pest_list", "pest_details", "traps_events")}
    traps = None
    if all(paths.values()):
        lookup = pest_lookup(C.load_pest_list(spark, paths["pest_list"]), C.load_pest_details(spark, paths["pest_details"]))
        traps = keep(T.trap_facts(C.load_traps(spark, find("traps_list")), C.load_trap_data(spark, find("traps_data")), C.load_trap_events(spark, paths["traps_events"]), lookup, boxes, areas), "miip_daily")
    by_week = keep(weather_weekly(weather), "weather_weekly")
    features = keep(T.weekly_features(clean, by_week, ops, traps, areas), "pairwise_weekly_features")
    inventory = keep(T.area_inventory(areas, scenes, clean, ops, traps, soil, weather), "area_inventory")
    matrix = keep(N.hypothesis_matrix_texts(inventory, features), "hypothesis_matrix")

    timeline = phase_timeline(T.with_support(features, support))
    own_gap = F.when(F.col("treatment") == "convencional", -F.col("pair_ndvi_gap_4_0_minus_conv")).otherwise(F.col("pair_ndvi_gap_4_0_minus_conv"))
    timeline = keep(N.with_story(timeline.withColumn("pair_position", pair_position(own_gap))), "ndvi_phase_timeline")
    frame = keep(transition_frame(timeline), "transition_model_frame")
    model = transition_model(timeline)
    predictions = keep(model.predictions, "transition_model_predictions")
    summary = keep(season_summary(timeline, list(T.DIMENSION)), "season_summary")
    diagnostics = keep(N.pair_diagnostics(summary, matrix), "ndvi_pair_diagnostics")
    ahead = keep(N.outlook_texts(outlook(summary), diagnostics), "ndvi_outlook")
    label = F.create_map(*[F.lit(x) for kv in R.METRIC_LABELS.items() for x in kv])
    effects = keep(pair_effects(timeline, EFFECTS).withColumn("metric_label", F.try_element_at(label, F.col("metric"))), "pair_effect_tests")
    lift = keep(driver_lift(timeline), "event_driver_lift")
    register = keep(N.register(effects, lift, ahead, diagnostics), "final_hypothesis_register")
    tables = {
        "area_inventory": inventory, "ndvi_clean": clean, "ops_area_daily": ops, "miip_daily": traps, "pairwise_weekly_features": features, "hypothesis_matrix": matrix, "ndvi_phase_timeline": timeline, "ndvi_events": N.events(timeline),
        "ndvi_pair_diagnostics": diagnostics, "ndvi_outlook": ahead, "ops_support_daily": support, "ops_support_weekly": weekly(support, SUPPORT_WEEKLY) if support is not None else None,
        "data_audit": T.data_audit(inventory, clean, weather, traps, ops, timeline), "pair_effect_tests": effects, "event_driver_lift": lift, "final_hypothesis_register": register,
        "decision_summary": N.decisions(effects, lift, ahead, diagnostics, register), "transition_model_frame": frame, "transition_model_summary": model.summary, "transition_model_coefficients": model.coefficients,
        "transition_model_predictions": predictions, "weather_daily": weather, "weather_weekly": by_week, "ndvi_stats_by_area": R.stats_by_area(clean), "ndvi_outliers": R.outliers(clean), "pair_weekly_gaps": R.pair_weekly_gaps(timeline),
        "pair_classic_tests": R.classic_tests(timeline), "ndvi_trend_tests": R.trend_tests(clean), "weekly_correlations": R.weekly_correlations(frame),
    }
    held = {n: df for n, df in {**tables, "soil_context": soil}.items() if df is not None}
    tables |= {"dataset_overview": R.overview({n: held[n] for n in R.OVERVIEW if n in held}), "numeric_profiles": R.numeric_profiles(held)}
    there = {n for n, p in paths.items() if p} | {n for n in C.LAYERS if find(f"{n}_layer")}
    return {n: df for n, df in tables.items() if df is not None}, N.season_gaps(scenes, weather, soil, ops, there, timeline)
