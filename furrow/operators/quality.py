"""Data-quality rules: named predicates over a table, counted in one pass, with examples of the rows they hit."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from furrow.functions.exprs import flag
from furrow.operators.windows import duplicates, gaps


# What is done with rows that a rule hits, statuses, and the order of severities.
KEPT, DROPPED, BLOCKED, VISIBLE, BLOCKED_COLUMN = "mantido_com_alerta", "descartado_da_base_analitica", "bloqueia_confianca_da_linha", "mantido_visivel_com_alerta", "bloqueia_confianca_da_coluna"
STATUSES = ("ok", "atenção")
SEVERITIES = ("error", "warning", "info")
# The numbers of an operations table that a mostly empty layer shows in.
MOSTLY_ZERO = ("spray_pressure_mean_psi", "fert_dose_gap_abs_mean_kg_ha", "overlap_area_pct_bbox", "stop_duration_h_per_bbox_ha")


@dataclass(frozen=True)
class Rule:
    """A predicate on rows; hit by more than so much of the table only, where least_share is given."""

    id: str
    severity: str
    predicate: Column
    domain: str = ""
    dimension: str = ""
    columns: tuple[str, ...] = ()
    action: str = KEPT
    least_share: float | None = None


def outside(column: str, low: float | None, high: float | None) -> Column:
    c = F.col(f"`{column}`")
    out = F.lit(False)
    if low is not None:
        out = out | flag(c < low)
    if high is not None:
        out = out | flag(c > high)
    return out


def not_positive(column: str) -> Column:
    return F.coalesce(F.col(f"`{column}`"), F.lit(0.0)) <= 0


def any_null(*columns: str) -> Column:
    out = F.lit(False)
    for c in columns:
        out = out | F.col(f"`{c}`").isNull()
    return out


# Rules by table, with domain, quality dimension, columns and action.
def scene_rules(columns: list[str]) -> list[Rule]:
    rules = [
        Rule("ndvi_b1_valid_pixels_zero", "info", not_positive("b1_valid_pixels"), "NDVI", "completude", ("b1_valid_pixels", "filename", "season_id"), DROPPED),
        Rule("ndvi_b1_mean_outside_range", "warning", outside("b1_mean", -1, 1), "NDVI", "validade_fisica", ("b1_mean",)),
    ]
    rules += [Rule(f"ndvi_{c}_outside_pct", "warning", outside(c, 0, 100), "NDVI", "validade_fisica", (c,)) for c in columns if c.startswith("b1_pct_")]
    if {"b1_pct_solo", "b1_pct_veg_densa"} <= set(columns):
        rules.append(Rule("ndvi_soil_dense_veg_pct_sum_gt_100", "warning", flag(F.col("b1_pct_solo") + F.col("b1_pct_veg_densa") > 100), "NDVI", "consistencia", ("b1_pct_solo", "b1_pct_veg_densa")))
    return rules


def clean_rules() -> list[Rule]:
    return [Rule("ndvi_clean_missing_keys", "error", any_null("season_id", "date", "ndvi_mean"), "NDVI", "completude", ("season_id", "date", "ndvi_mean"), BLOCKED)]


def weather_rules() -> list[Rule]:
    return [
        Rule("weather_temp_avg_implausible", "warning", outside("temp_avg_c", -10, 50), "Clima", "validade_fisica", ("temp_avg_c",)),
        Rule("weather_humidity_outside_pct", "warning", outside("humidity_avg_pct", 0, 100), "Clima", "validade_fisica", ("humidity_avg_pct",)),
        Rule("weather_wind_implausible", "warning", outside("wind_avg_kmh", None, 120), "Clima", "precisao", ("wind_avg_kmh",)),
        Rule("weather_precipitation_negative_or_extreme", "warning", outside("precipitation_mm", 0, 300), "Clima", "validade_fisica", ("precipitation_mm",)),
    ]


def ops_rules(columns: list[str] | None = None, most_yield: float = 25_000) -> list[Rule]:
    """most_yield depends on the crop: grain by default, silage yields more. columns adds the rules of mostly empty layers that there are."""
    rules = [
        Rule("ops_yield_negative_or_extreme", "warning", outside("harvest_yield_mean_kg_ha", 0, most_yield), "Operação", "validade_fisica", ("harvest_yield_mean_kg_ha",)),
        Rule("ops_yield_zero_or_missing", "info", not_positive("harvest_yield_mean_kg_ha"), "Operação", "completude", ("harvest_yield_mean_kg_ha",)),
        Rule("ops_population_implausible", "info", flag((F.col("planting_population_mean_ha") <= 0) | (F.col("planting_population_mean_ha") > 200_000)), "Operação", "precisao", ("planting_population_mean_ha",)),
    ]
    return rules + [mostly_zero(c) for c in MOSTLY_ZERO if c in (columns or [])]


def mostly_zero(column: str, share: float = 0.8) -> Rule:
    """Zero-or-null rows, counted only where they are more than so much of the table."""
    return Rule(f"ops_{column}_mostly_zero", "info", F.coalesce(F.col(f"`{column}`"), F.lit(0.0)) == 0, "Operação", "completude", (column,), least_share=share)


def trap_rules() -> list[Rule]:
    return [
        Rule("miip_pest_negative_or_extreme", "warning", outside("avg_pest_count", 0, 10_000), "MIIP", "validade_fisica", ("avg_pest_count", "total_pest_count")),
        Rule("miip_missing_spatial_assignment", "warning", any_null("season_id", "area_label"), "MIIP", "inconsistencia_espacial", ("season_id", "area_label")),
    ]


SUMMARY = ("table_name", "rule_id", "domain", "severity", "dimension", "affected_columns", "action", "affected_rows", "total_rows", "status")


def _facts(rule: Rule) -> list[Column]:
    return [F.lit(rule.id).alias("rule_id"), F.lit(rule.domain).alias("domain"), F.lit(rule.severity).alias("severity"), F.lit(rule.dimension).alias("dimension"), F.lit(", ".join(rule.columns)).alias("affected_columns"), F.lit(rule.action).alias("action")]


def _summed(table: str, rule: Rule, hits: DataFrame, total: DataFrame | None = None) -> DataFrame:
    """The summary row of a rule whose hits are rows of their own."""
    n = hits.agg(F.count(F.lit(1)).alias("affected_rows"))
    n = n.join(F.broadcast(total.agg(F.count(F.lit(1)).alias("total_rows")))) if total is not None else n.withColumn("total_rows", F.lit(None).cast("long"))  # one row each
    return _with_status(n.select(F.lit(table).alias("table_name"), *_facts(rule), "affected_rows", "total_rows"))


def _with_status(rows: DataFrame) -> DataFrame:
    return rows.withColumn("status", F.when(F.col("affected_rows") == 0, STATUSES[0]).otherwise(STATUSES[1])).select(*SUMMARY)


def run_rules(df: DataFrame, rules: list[Rule], table: str) -> DataFrame:
    """A SUMMARY row per rule: all rules in one aggregation."""
    counts = df.agg(F.count(F.lit(1)).alias("n"), F.array(*[F.struct(*_facts(r), F.count_if(flag(r.predicate)).alias("hit"), F.lit(r.least_share).cast("double").alias("least")) for r in rules]).alias("r"))
    out = counts.select(F.lit(table).alias("table_name"), F.explode("r").alias("r"), F.col("n").alias("total_rows")).select("table_name", "r.*", "total_rows")
    return _with_status(out.withColumn("affected_rows", F.when(F.col("least").isNull() | (F.col("hit") > F.col("least") * F.col("total_rows")), F.col("hit")).otherwise(F.lit(0))))


def duplicate_scenes(scenes: DataFrame) -> DataFrame:
    rule = Rule("ndvi_duplicate_scene_key", "warning", F.lit(True), "NDVI", "consistencia", ("season_id", "filename", "date"))
    return _summed("ndvi_raw", rule, duplicate_keys(scenes, ["season_id", "filename"]), scenes)


def scene_gaps(scenes: DataFrame, days: int = 12) -> DataFrame:
    rule = Rule("ndvi_temporal_gap_gt_12_days", "info", F.lit(True), "NDVI", "atualidade", ("season_id", "date"))
    return _summed("ndvi_raw", rule, temporal_gaps(scenes.where("season_id is not null and date is not null"), "date", ["season_id"], ["filename"], days), scenes)


def weather_late(before: DataFrame, clean: DataFrame) -> DataFrame:
    """before: scenes of days before the first day with weather."""
    rule = Rule("weather_starts_after_ndvi_window", "warning", F.lit(True), "Clima", "atualidade", ("date", "has_weather_coverage", "water_balance_mm_week"))
    return _summed("weather_daily", rule, before, clean)


def structure_rules(tables: dict[str, DataFrame], headers: dict[str, list[str]] | None = None) -> DataFrame:
    """Per table its empty and its repeated columns. headers are column names as a file has them, which a table cannot repeat."""
    from furrow.operators.trial import duplicate_columns

    parts = []
    for name, df in tables.items():
        empty = empty_columns(df, name).agg(F.array_sort(F.collect_list("column_name")).alias("c"))
        again = duplicate_columns((headers or {}).get(name, df.columns))
        facts = lambda kind, severity, dimension, action: [F.lit(name).alias("table_name"), F.lit(f"{name}_{kind}").alias("rule_id"), F.lit("Estrutura").alias("domain"), F.lit(severity).alias("severity"), F.lit(dimension).alias("dimension"), F.lit(action).alias("action")]  # noqa: E731,B023
        found = empty.select(*facts("empty_columns", "info", "completude", VISIBLE), F.array_join("c", ", ").alias("affected_columns"), F.size("c").cast("long").alias("affected_rows"))
        twice = df.sparkSession.range(1).select(*facts("duplicate_columns", "warning", "consistencia", BLOCKED_COLUMN), F.lit(", ".join(again)).alias("affected_columns"), F.lit(len(again)).cast("long").alias("affected_rows"))
        parts += [found, twice]
    return _with_status(reduce(DataFrame.unionByName, parts).withColumn("total_rows", F.lit(None).cast("long")))


def quality_summary(scenes: DataFrame, clean: DataFrame, weather: DataFrame, ops: DataFrame, traps: DataFrame) -> DataFrame:
    """All rules of a season's tables, by severity, most rows first."""
    from furrow.operators.trial import scenes_before_weather

    parts = [
        run_rules(scenes, scene_rules(scenes.columns), "ndvi_raw"), duplicate_scenes(scenes), scene_gaps(scenes), run_rules(clean, clean_rules(), "ndvi_clean"), run_rules(weather, weather_rules(), "weather_daily"),
        weather_late(scenes_before_weather(clean, weather), clean), run_rules(ops, ops_rules(ops.columns), "ops_area_daily"), run_rules(traps, trap_rules(), "miip_daily"),
        structure_rules({"ndvi_raw": scenes, "ndvi_clean": clean, "weather_daily": weather, "ops_area_daily": ops, "miip_daily": traps}),
    ]
    return severity_order(reduce(DataFrame.unionByName, parts))


def empty_columns(df: DataFrame, table: str) -> DataFrame:
    """Columns without any value (of an empty table: all)."""
    counts = df.agg(F.array(*[F.struct(F.lit(c).alias("column_name"), F.count(F.col(f"`{c}`")).alias("n")) for c in df.columns]).alias("r"))
    return counts.select(F.explode("r").alias("r")).where("r.n = 0").select(F.lit(table).alias("table_name"), F.col("r.column_name").alias("column_name"))


def examples(df: DataFrame, rule: Rule, order: list[str], limit: int = 50) -> DataFrame:
    """The first rows in order that a rule hits."""
    return df.where(flag(rule.predicate)).orderBy(*order).limit(limit)


def severity_order(summary: DataFrame) -> DataFrame:
    rank = F.array_position(F.array(*map(F.lit, SEVERITIES)), F.col("severity"))
    rank = F.when(rank == 0, 99).otherwise(rank)  # others come last
    return summary.orderBy(rank, F.desc("affected_rows"), "rule_id")


def duplicate_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    return duplicates(df, keys).where("is_duplicate").drop("is_duplicate")


def temporal_gaps(df: DataFrame, date: str, keys: list[str], ties: list[str], days: int = 12) -> DataFrame:
    return gaps(df, date, keys, ties, days)
