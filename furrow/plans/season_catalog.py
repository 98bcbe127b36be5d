"""Queries over the driver's tables that run the season's operators, and the same in SQL.

Events stand in for telemetry and trap readings of fields, orders for hourly
weather, line items for scenes, suppliers for fields. Inputs are derived by
expressions that both engines read (columns_of, table_of); what is done with
them is the library's on one side and written out in SQL on the other.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from furrow.functions import exprs as X
from furrow.operators import daily as D
from furrow.operators import evidence as EV
from furrow.operators import index as I
from furrow.operators import lineage as L
from furrow.operators import narrative as NA
from furrow.operators import quality as Q
from furrow.operators import review as R
from furrow.operators import spatial as S
from furrow.operators import timeline as T
from furrow.operators import trial as TR
from furrow.operators import weekly as WK
from furrow.operators import windows as W
from furrow.operators import workspace as WS
from furrow.plans.catalog import AREAS, EDGES, PANEL, SCENES, SIDES, areas, edges, panel, query, read, rounded, scenes
from furrow.sources import catalog as K
from furrow.sources.scratch import staged


def columns_of(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    return df.select(*[F.expr(e).alias(n) for n, e in columns.items()])


def table_of(columns: dict[str, str], table: str) -> str:
    return "SELECT " + ", ".join(f'{e} AS "{n}"' for n, e in columns.items()) + f" FROM {table}"


def six(columns: list[str], digits: int = 6) -> str:
    return ", ".join(f'round("{c}", {digits}) AS "{c}"' for c in columns)


FIELD = {"season_id": "CAST(user_id % 20 AS STRING)", "date": "CAST(ts AS DATE)"}
#: Rows of all telemetry layers at once.
TELEMETRY = {
    **FIELD,
    "Operation": "CASE event_id % 4 WHEN 0 THEN 'Plantio de soja' WHEN 1 THEN 'COLHEITA SILAGEM' WHEN 2 THEN 'Calagem' END",
    "Area - ha": "CASE WHEN event_id % 9 = 0 THEN NULL ELSE value / 9.7 END",
    "Population - ha": "CASE event_id % 5 WHEN 0 THEN NULL WHEN 1 THEN 0.0 ELSE value * 1000 END",
    "Yield - kg/ha": "CASE event_id % 7 WHEN 0 THEN NULL WHEN 1 THEN 0.0 ELSE value * 50 END",
    "Weight - kg": "value * 3",
    "Humidity - %": "CASE WHEN event_id % 6 = 0 THEN NULL ELSE value / 5 END",
    "AppliedDos - kg/ha": "CASE WHEN event_id % 3 = 0 THEN NULL ELSE value * 2 END",
    "Configured - kg/ha": "CASE event_id % 4 WHEN 0 THEN NULL WHEN 1 THEN 0.0 ELSE value + 20 END",
    "Pressure - psi": "CASE event_id % 3 WHEN 0 THEN 0.0 WHEN 1 THEN NULL ELSE value END",
    "OverlapArea - ha": "value / 97.3",
    "Speed - km/h": "CASE event_id % 8 WHEN 0 THEN NULL WHEN 1 THEN 0.05 ELSE value / 3.1 END",
    "Duration - h": "CASE WHEN event_id % 10 = 0 THEN NULL ELSE value / 61.7 END",
    "event": "CASE event_id % 3 WHEN 0 THEN 'Sem evento' WHEN 1 THEN 'Chuva' END",
    "Alarm": "CASE event_id % 4 WHEN 0 THEN ' ' WHEN 1 THEN NULL ELSE event_type END",
    "Alert": "CASE event_id % 5 WHEN 0 THEN '' ELSE CONCAT(' ', event_type, ' ') END",
    "InvalidCommunication": "CASE event_id % 6 WHEN 0 THEN 'True' WHEN 1 THEN 'SIM' WHEN 2 THEN '1' WHEN 3 THEN 'no' END",
    "ExternalGPS": "CASE event_id % 2 WHEN 0 THEN 'sim' ELSE '0' END",
    "TelemetryCommunication": "CASE event_id % 4 WHEN 0 THEN 'Rede Móvel' WHEN 1 THEN 'MOVEL' WHEN 2 THEN 'Wifi' END",
    "EngineRotation - rpm": "CASE event_id % 7 WHEN 0 THEN NULL WHEN 1 THEN 0.0 ELSE value * 20 END",
    "FuelConsumption - L/h": "CASE event_id % 5 WHEN 0 THEN NULL WHEN 1 THEN 0.0 ELSE value END",
    "EngineTemperature - ºC": "CASE WHEN event_id % 9 = 0 THEN NULL ELSE value + 40 END",
}
PLANTED = """contains(upper(Operation), 'PLANTIO') AND coalesce("Population - ha", 0) > 0"""
REAPED = """contains(upper(Operation), 'COLHEITA') AND coalesce("Yield - kg/ha", 0) > 0"""
DOSED = """("AppliedDos - kg/ha" IS NOT NULL OR "Configured - kg/ha" IS NOT NULL)"""
YES = "lower({}) IN ('true', '1', 'sim')"


def _total(c: str, where: str) -> str:
    return f"""CASE WHEN count(*) FILTER (WHERE {where}) > 0 THEN coalesce(sum("{c}") FILTER (WHERE {where}), 0) END"""


def _rows(where: str) -> str:
    return f"nullif(count(*) FILTER (WHERE {where}), 0)"


def _share(condition: str) -> str:
    return f"avg(CASE WHEN {condition} THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END)"


_GAP = '"AppliedDos - kg/ha" - "Configured - kg/ha"'
OPS_SQL = {
    "planting_points": _rows(PLANTED), "planting_area_ha": _total("Area - ha", PLANTED), "planting_population_mean_ha": f'avg("Population - ha") FILTER (WHERE {PLANTED})', "planting_population_p90_ha": f'quantile_cont("Population - ha", 0.9) FILTER (WHERE {PLANTED})',
    "harvest_points": _rows(REAPED), "harvest_area_ha": _total("Area - ha", REAPED), "harvest_yield_mean_kg_ha": f'avg("Yield - kg/ha") FILTER (WHERE {REAPED})', "harvest_yield_p90_kg_ha": f'quantile_cont("Yield - kg/ha", 0.9) FILTER (WHERE {REAPED})',
    "harvest_weight_kg": _total("Weight - kg", REAPED), "harvest_humidity_mean_pct": f'avg("Humidity - %") FILTER (WHERE {REAPED})',
    "fert_points": _rows(DOSED), "fert_area_ha": _total("Area - ha", DOSED), "fert_applied_mean_kg_ha": 'avg("AppliedDos - kg/ha")', "fert_configured_mean_kg_ha": 'avg("Configured - kg/ha")', "fert_dose_gap_mean_kg_ha": f"avg({_GAP})",
    "fert_dose_gap_abs_mean_kg_ha": f"avg(abs({_GAP}))", "fert_dose_ratio_mean": 'avg("AppliedDos - kg/ha" / nullif("Configured - kg/ha", 0))', "fert_weight_kg": _total("Weight - kg", DOSED),
    "spray_points": "count(*)", "spray_pressure_mean_psi": 'avg("Pressure - psi")', "spray_pressure_active_share": _share('"Pressure - psi" > 0'), "overlap_points": "count(*)", "overlap_area_ha": 'sum("OverlapArea - ha")',
    "speed_points": "count(*)", "speed_mean_kmh": 'avg("Speed - km/h")', "speed_p90_kmh": 'quantile_cont("Speed - km/h", 0.9)', "speed_zero_share": _share('coalesce("Speed - km/h", 0) <= 0.1::DOUBLE'),
    "stop_events": "count(*)", "stop_duration_h": 'coalesce(sum("Duration - h"), 0)', "stop_known_reason_share": _share("coalesce(event, '') <> 'Sem evento'"),
}
SUPPORT_SQL = {
    "alarm_events": "count(*)", "alarm_type_count": "count(DISTINCT nullif(trim(\"Alarm\"), ''))", "param_alert_events": "count(*)", "param_alert_type_count": "count(DISTINCT nullif(trim(\"Alert\"), ''))",
    "telemetry_points": "count(*)", "invalid_telemetry_share": _share(YES.format('"InvalidCommunication"')), "external_gps_share": _share(YES.format('"ExternalGPS"')), "mobile_comm_share": _share("regexp_matches(\"TelemetryCommunication\", '(?i)m[oó]vel')"),
    "engine_rotation_points": "count(*)", "engine_rotation_mean_rpm": 'avg("EngineRotation - rpm")', "engine_idle_share": _share('coalesce("EngineRotation - rpm", 0) BETWEEN 1 AND 900'),
    "engine_temp_points": "count(*)", "engine_temp_mean_c": 'avg("EngineTemperature - ºC")', "engine_temp_max_c": 'max("EngineTemperature - ºC")',
    "engine_temp_hot_share": _share('"EngineTemperature - ºC" >= (SELECT quantile_cont("EngineTemperature - ºC", 0.9) FROM rows_)'),
    "fuel_points": "count(*)", "fuel_consumption_mean_l_h": 'avg("FuelConsumption - L/h")', "fuel_zero_share": _share('coalesce("FuelConsumption - L/h", 0) = 0'),
}


def _daily_sql(columns: dict[str, str]) -> str:
    return f"WITH rows_ AS ({table_of(TELEMETRY, 'events')}), days AS (SELECT season_id, date, " + ", ".join(f"{e} AS {n}" for n, e in columns.items()) + " FROM rows_ GROUP BY season_id, date)"


def telemetry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return columns_of(read(spark, sf_dir, "events"), TELEMETRY)


def ops_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = telemetry(spark, sf_dir)
    return D.merge_daily([D.summarize_layer(rows, n) for n in ("planting", "harvest", "fertilization", "spray", "overlap", "speed", "stop")])


def support_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = telemetry(spark, sf_dir)
    return D.merge_daily([*[D.summarize_layer(rows, n) for n in ("alarm", "param_alert", "telemetry", "engine_rotation", "fuel")], D.hot_share(rows)])


@query(f"{_daily_sql(OPS_SQL)} SELECT season_id, date, {six(list(OPS_SQL), 8)} FROM days")
def operations_by_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seven telemetry layers by field and day, in one union and one aggregation."""
    return rounded(ops_days(spark, sf_dir).select("season_id", "date", *OPS_SQL), 8)


@query(f"{_daily_sql(SUPPORT_SQL)} SELECT season_id, date, {six(list(SUPPORT_SQL), 8)} FROM days")
def support_by_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(support_days(spark, sf_dir).select("season_id", "date", *SUPPORT_SQL), 8)


_ROLL = {"sum": "coalesce(CAST(sum({0}) AS DOUBLE), 0)", "mean": "avg({0})", "max": "max({0})", "min": "min({0})"}


def _weekly_sql(columns: dict[str, str], rules: dict[str, str]) -> str:
    out = ", ".join(f"round({_ROLL[rule].format(c)}, 8) AS {c}_week" for c, rule in rules.items() if c in columns)
    return f"{_daily_sql(columns)} SELECT season_id, CAST(date_trunc('week', date) AS DATE) AS week_start, {out} FROM days GROUP BY ALL"


@query(_weekly_sql(OPS_SQL, WK.OPS_WEEKLY))
def operations_by_week(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = WK.weekly(ops_days(spark, sf_dir), WK.OPS_WEEKLY)
    return rounded(out.withColumn("week_start", F.to_date("week_start")), 8)


@query(_weekly_sql(SUPPORT_SQL, WK.SUPPORT_WEEKLY))
def support_by_week(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = WK.weekly(support_days(spark, sf_dir), WK.SUPPORT_WEEKLY)
    return rounded(out.withColumn("week_start", F.to_date("week_start")), 8)


HOURS = {
    "date": "o_orderdate", "precipitation_mm": "CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE o_totalprice / 100003.7 END", "evapotranspiration_mm": "o_totalprice / 200003.9", "solar_radiation_w_m2": "o_totalprice / 1003.3", "temp_avg_c": "o_totalprice / 15007.3 - 2",
    "temp_max_c": "o_totalprice / 10007.9", "temp_min_c": "o_totalprice / 20011.3 - 5", "humidity_avg_pct": "CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE o_totalprice / 4903.1 END", "wind_avg_kmh": "o_totalprice / 4001.7",
}
WEATHER_DAYS = f"""hours AS ({table_of(HOURS, "orders")}), sums AS (
  SELECT CAST(date AS DATE) AS date, coalesce(sum(precipitation_mm), 0) AS precipitation_mm, coalesce(sum(evapotranspiration_mm), 0) AS evapotranspiration_mm, avg(solar_radiation_w_m2) AS solar_radiation_w_m2, avg(temp_avg_c) AS temp_avg_c,
    avg(humidity_avg_pct) AS humidity_avg_pct, avg(wind_avg_kmh) AS wind_avg_kmh, max(temp_max_c) AS temp_max_c, min(temp_min_c) AS temp_min_c FROM hours GROUP BY 1
), weather AS (
  SELECT *, precipitation_mm - evapotranspiration_mm AS water_balance_mm, avg(precipitation_mm) OVER (ORDER BY date ROWS 6 PRECEDING) AS precipitation_mm_ma7, avg(precipitation_mm - evapotranspiration_mm) OVER (ORDER BY date ROWS 13 PRECEDING) AS water_balance_mm_ma14,
    CAST(date_trunc('week', date) AS DATE) AS week_start FROM sums
)"""
WEATHER_COLUMNS = ["precipitation_mm", "evapotranspiration_mm", "solar_radiation_w_m2", "temp_avg_c", "humidity_avg_pct", "wind_avg_kmh", "temp_max_c", "temp_min_c", "water_balance_mm", "precipitation_mm_ma7", "water_balance_mm_ma14"]


def weather_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.weather_daily(columns_of(read(spark, sf_dir, "orders"), HOURS))


@query(f"WITH {WEATHER_DAYS} SELECT date, week_start, {six(WEATHER_COLUMNS)} FROM weather")
def weather_by_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(weather_days(spark, sf_dir).select("date", F.to_date("week_start").alias("week_start"), *WEATHER_COLUMNS))


@query(f"WITH {WEATHER_DAYS} SELECT week_start, count(DISTINCT date) AS weather_days, " + ", ".join(f"round({_ROLL[r].format(c)}, 6) AS {c}_week" for c, r in WK.WEATHER_WEEKLY.items()) + " FROM weather GROUP BY week_start")
def weather_by_week(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = WK.weather_weekly(weather_days(spark, sf_dir))
    return rounded(out.withColumn("week_start", F.to_date("week_start")))


READINGS = {
    **FIELD, "trapCode": "CONCAT('T', CAST(user_id % 30 AS STRING))", "trapId": "event_id", "createdAt": "ts", "trapType": "CASE event_id % 3 WHEN 0 THEN 'ELECTRONIC' WHEN 1 THEN 'CONVENTIONAL' END", "pestCount": "CASE WHEN event_id % 11 = 0 THEN NULL ELSE value END",
    "alert_threshold": "CASE WHEN event_id % 4 = 0 THEN NULL ELSE 10.0 END", "control_threshold": "20.0", "damage_threshold": "CASE WHEN event_id % 2 = 0 THEN NULL ELSE 40.0 END", "action_ray_m": "value * 2",
    "primaryPest": "CASE event_id % 4 WHEN 0 THEN ' ' WHEN 1 THEN 'Lagarta' WHEN 2 THEN 'Percevejo' END", "trapInfestationLevel": "event_type",
}
TRAP_SQL = {
    "trap_readings": "count(*)", "traps_reporting": "count(DISTINCT \"trapCode\")", "electronic_readings": "count(*) FILTER (WHERE \"trapType\" = 'ELECTRONIC')", "conventional_readings": "count(*) FILTER (WHERE \"trapType\" = 'CONVENTIONAL')",
    "avg_pest_count": 'avg("pestCount")', "total_pest_count": 'coalesce(sum("pestCount"), 0)', "alert_hits": 'count(*) FILTER (WHERE "pestCount" >= alert_threshold)', "control_hits": 'count(*) FILTER (WHERE "pestCount" >= control_threshold)',
    "damage_hits": 'count(*) FILTER (WHERE "pestCount" >= damage_threshold)', "avg_action_ray_m": "avg(action_ray_m)",
}


def readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return columns_of(read(spark, sf_dir, "events"), READINGS)


@query(f"""WITH rows_ AS ({table_of(READINGS, "events")}) SELECT season_id, date, {", ".join(f"round({e}, 6) AS {n}" for n, e in TRAP_SQL.items())}, coalesce(string_agg(DISTINCT "primaryPest", ', ' ORDER BY "primaryPest") FILTER (WHERE trim("primaryPest") <> ''), '') AS primary_pests FROM rows_ GROUP BY ALL""")
def traps_by_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(D.trap_daily(readings(spark, sf_dir)).select("season_id", "date", *TRAP_SQL, "primary_pests"))


@query(f"""WITH rows_ AS ({table_of(READINGS, "events")}), days AS (SELECT season_id, date, {", ".join(f"{e} AS {n}" for n, e in TRAP_SQL.items())} FROM rows_ GROUP BY ALL)
SELECT season_id, CAST(date_trunc('week', date) AS DATE) AS week_start, {", ".join(f"round({_ROLL[r].format(c)}, 6) AS {c}_week" for c, r in WK.TRAP_WEEKLY.items() if c in TRAP_SQL)} FROM days GROUP BY ALL""")
def traps_by_week(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = WK.weekly(D.trap_daily(readings(spark, sf_dir)), WK.TRAP_WEEKLY)
    return rounded(out.withColumn("week_start", F.to_date("week_start")))


EVENTS = {**FIELD, "type": "CASE event_type WHEN 'click' THEN 'IMAGE' WHEN 'view' THEN 'PING' WHEN 'error' THEN 'CLIENT_BATTERY_VOLTAGE' ELSE 'x' END", "pestCount": "CASE WHEN event_id % 5 = 0 THEN NULL ELSE value END", "k": "user_id % 4", "bad": "event_id % 6"}


@query(f"""WITH rows_ AS ({table_of(EVENTS, "events")}), n AS (SELECT *, CASE bad WHEN 0 THEN [] WHEN 1 THEN ['s' || k] ELSE ['s' || k, 'b'] END AS names FROM rows_), d AS (SELECT DISTINCT season_id, date, unnest(names) AS name FROM n),
s AS (SELECT season_id, date, string_agg(name, ', ' ORDER BY name) AS detected_species FROM d GROUP BY ALL)
SELECT n.season_id, n.date, count(*) FILTER (WHERE type = 'IMAGE') AS image_events, count(*) FILTER (WHERE type = 'PING') AS ping_events, count(*) FILTER (WHERE type = 'CLIENT_BATTERY_VOLTAGE') AS battery_events, round(coalesce(sum("pestCount"), 0), 6) AS image_pest_count, CAST(sum(len(names)) AS BIGINT) AS detected_boxes, coalesce(any_value(s.detected_species), '') AS detected_species
FROM n LEFT JOIN s ON s.season_id = n.season_id AND s.date = n.date GROUP BY ALL""")
def trap_events_by_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Detections as records, as a text of records within an array, and as bad JSON."""
    rows = columns_of(read(spark, sf_dir, "events"), EVENTS)
    one = F.format_string('[{"name":"s%s","confidence":0.5}]', F.col("k").cast("string"))
    two = F.to_json(F.array(F.lit("[]"), F.format_string('[{"name":"s%s"},{"name":"b","confidence":1}]', F.col("k").cast("string"))))
    payload = F.when(F.col("bad") == 0, "[{").when(F.col("bad") == 1, one).otherwise(two)
    return rounded(D.trap_event_daily(rows.withColumn("detection", payload)))


@query("""WITH l AS (SELECT p_partkey, trim(lower(strip_accents(CONCAT(' ', p_name, 'É ')))) AS k, CASE WHEN p_partkey % 3 = 0 THEN NULL ELSE p_retailprice END AS a FROM part WHERE p_partkey % 2 = 0), d AS (SELECT trim(lower(p_name)) || 'e' AS k, p_size AS a, p_size * 2.0::DOUBLE AS r FROM part WHERE p_partkey % 2 = 1),
b AS (SELECT k, 0 AS side, a, NULL::DOUBLE AS r FROM l UNION ALL SELECT k, 1, a, r FROM d) SELECT k AS primary_pest_key, round(arg_min(a, {'s': side, 'a': a}) FILTER (WHERE a IS NOT NULL), 6) AS alert_threshold, round(arg_min(r, {'s': side, 'r': r}) FILTER (WHERE r IS NOT NULL), 6) AS action_ray_m FROM b GROUP BY k""")
def pest_thresholds(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = read(spark, sf_dir, "part")
    pests = part.where("p_partkey % 2 = 0").select(F.concat(F.lit(" "), "p_name", F.lit("É ")).alias("name"), F.when(F.col("p_partkey") % 3 != 0, F.col("p_retailprice")).alias("alert_threshold"))
    details = part.where("p_partkey % 2 = 1").select(F.concat("p_name", F.lit("E")).alias("name"), F.col("p_size").cast("double").alias("alert_threshold"), (F.col("p_size") * 2).cast("double").alias("action_ray_m"))
    return rounded(D.pest_lookup(pests, details).select("primary_pest_key", "alert_threshold", "action_ray_m"))


TRAPS = {"code": "CONCAT('T', CAST(s_suppkey AS STRING))", "type": "CASE s_suppkey % 3 WHEN 0 THEN 'ELECTRONIC' WHEN 1 THEN 'CONVENTIONAL' ELSE 'x' END", "latitude": "CASE WHEN s_suppkey % 10 = 0 THEN NULL ELSE 0.0 END", "longitude": "s_suppkey * 0.01", "plot": "CASE WHEN s_suppkey % 4 = 0 THEN CONCAT('P', CAST(s_suppkey AS STRING)) END"}


@query(f"""WITH t AS ({table_of(TRAPS, "supplier")}), r AS ({table_of(READINGS, "events")}), n AS (SELECT *, row_number() OVER (PARTITION BY "trapCode" ORDER BY "createdAt" DESC, "trapId" DESC) AS k FROM r)
SELECT t.code, "pestCount", "primaryPest", "trapInfestationLevel" FROM t LEFT JOIN n ON "trapCode" = code AND k = 1 WHERE latitude IS NOT NULL""")
def latest_trap_readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    traps = columns_of(read(spark, sf_dir, "supplier"), TRAPS)
    return TR.latest_readings(traps, readings(spark, sf_dir)).select("code", "pestCount", "primaryPest", "trapInfestationLevel")


CLEAN = f"""{SCENES}, {AREAS}, span AS (SELECT min(CAST(o_orderdate AS DATE)) + 400 AS a, max(CAST(o_orderdate AS DATE)) - 400 AS b FROM orders), tax AS (SELECT l_orderkey || '-' || l_linenumber AS filename, CAST(l_suppkey AS VARCHAR) AS season_id, l_tax FROM lineitem), valid AS (
  SELECT s.*, b1_mean AS ndvi_mean, date_trunc('week', date)::DATE AS week_start, date BETWEEN a AND b AS has_weather_coverage, lag(b1_mean) OVER w AS before, lag(date) OVER w AS day FROM scenes s, span WHERE coalesce(b1_valid_pixels, 0) > 0 WINDOW w AS (PARTITION BY season_id ORDER BY date, filename)
), clean AS (
  SELECT valid.*, area_label, treatment, 'grao' AS crop_type, CASE WHEN mapping_source IS NULL THEN 'par' ELSE 'desconhecido' END AS comparison_pair, ndvi_mean - before AS ndvi_delta, sum(coalesce(date_diff('day', day, date) * (before + ndvi_mean) / 2, 0)) OVER (PARTITION BY season_id ORDER BY date, filename ROWS UNBOUNDED PRECEDING) AS ndvi_auc, 10.0::DOUBLE AS soil_pct, 80.0::DOUBLE AS dense_veg_pct
  FROM valid LEFT JOIN areas USING (season_id)
)"""


def weather_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    day = F.to_date("o_orderdate")
    return read(spark, sf_dir, "orders").agg(F.explode(F.array(F.date_add(F.min(day), 400), F.date_sub(F.max(day), 400))).alias("date"))


def clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = TR.clean_scenes(scenes(spark, sf_dir), areas(spark, sf_dir), weather_window(spark, sf_dir))
    official = F.coalesce(F.col("mapping_source") != "auto_missing", F.lit(True))
    return out.withColumns({"crop_type": F.lit("grao"), "comparison_pair": F.when(official, "par").otherwise("desconhecido"), "image_path": F.col("filename")})


NDVI_WEEKS = f"""{CLEAN}, weeks AS (
  SELECT season_id, week_start, avg(ndvi_mean) AS ndvi_mean_week, max(ndvi_mean) AS ndvi_max_week, coalesce(stddev_samp(ndvi_mean), 0) AS ndvi_std_week, max(ndvi_auc) AS ndvi_auc_week, avg(soil_pct) AS soil_pct_week, avg(dense_veg_pct) AS dense_veg_pct_week, count(*) AS image_count_week, bool_or(has_weather_coverage) AS has_weather_coverage_week FROM clean GROUP BY ALL
)"""


@query(f"WITH {NDVI_WEEKS} SELECT season_id, week_start, {six(['ndvi_mean_week', 'ndvi_max_week', 'ndvi_std_week', 'soil_pct_week', 'dense_veg_pct_week'])}, round(ndvi_auc_week, 4) AS ndvi_auc_week, image_count_week, has_weather_coverage_week FROM weeks")
def scenes_by_week(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = WK.ndvi_weekly(clean(spark, sf_dir)).withColumns({"week_start": F.to_date("week_start"), "ndvi_auc_week": F.round("ndvi_auc_week", 4)})
    return rounded(out)


@query(f"""WITH {NDVI_WEEKS}, {WEATHER_DAYS}, rain AS (SELECT week_start, coalesce(sum(precipitation_mm), 0) AS precipitation_mm_week, avg(temp_avg_c) AS temp_avg_c_week FROM weather GROUP BY week_start), f AS (
  SELECT w.*, ndvi_mean_week - lag(ndvi_mean_week) OVER (PARTITION BY season_id ORDER BY w.week_start) AS ndvi_delta_week, treatment, CASE WHEN mapping_source IS NULL THEN 'par' ELSE 'desconhecido' END AS comparison_pair, precipitation_mm_week, temp_avg_c_week FROM weeks w LEFT JOIN areas USING (season_id) LEFT JOIN rain r ON r.week_start = w.week_start
) SELECT season_id, week_start, treatment, comparison_pair, image_count_week AS valid_images_week, {six(['ndvi_mean_week', 'ndvi_delta_week', 'precipitation_mm_week', 'temp_avg_c_week'])},
  round(max(CASE WHEN treatment = 'tecnologia_4_0' THEN ndvi_mean_week END) OVER p - max(CASE WHEN treatment = 'convencional' THEN ndvi_mean_week END) OVER p, 6) AS pair_ndvi_gap_4_0_minus_conv, NULL::DOUBLE AS pair_pest_gap_4_0_minus_conv FROM f WINDOW p AS (PARTITION BY comparison_pair, week_start)""")
def features_by_week(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scenes by week with the farm's weather, the field's dimension and the gaps within the pair."""
    official = F.coalesce(F.col("mapping_source") != "auto_missing", F.lit(True))
    fields = areas(spark, sf_dir).withColumns({"crop_type": F.lit("grao"), "comparison_pair": F.when(official, "par").otherwise("desconhecido")})
    out = TR.weekly_features(clean(spark, sf_dir), WK.weather_weekly(weather_days(spark, sf_dir)), None, None, fields).withColumn("week_start", F.to_date("week_start"))
    return rounded(out.select("season_id", "week_start", "treatment", "comparison_pair", "valid_images_week", "ndvi_mean_week", "ndvi_delta_week", "precipitation_mm_week", "temp_avg_c_week", "pair_ndvi_gap_4_0_minus_conv", "pair_pest_gap_4_0_minus_conv"))


@query(f"""WITH {CLEAN}, total AS (SELECT season_id, count(*) AS total_images, count(*) FILTER (WHERE coalesce(b1_valid_pixels, 0) > 0) AS total_valid_images FROM scenes GROUP BY ALL), c AS (SELECT season_id, avg(ndvi_mean) AS ndvi_mean, max(ndvi_mean) AS ndvi_peak, max(ndvi_auc) AS ndvi_auc FROM clean GROUP BY ALL),
{WEATHER_DAYS}, ops AS ({_daily_sql(OPS_SQL)} SELECT * FROM days), o AS (SELECT season_id, count(DISTINCT date) AS ops_days, count(*) FILTER (WHERE harvest_points > 0) AS harvest_days, count(*) FILTER (WHERE stop_events > 0) AS stop_days, sum(harvest_yield_mean_kg_ha * harvest_points) FILTER (WHERE harvest_points > 0) / sum(harvest_points) FILTER (WHERE harvest_yield_mean_kg_ha IS NOT NULL) AS harvest_yield_mean_kg_ha, sum(overlap_area_ha) AS overlap_area_ha FROM ops GROUP BY ALL),
r AS ({table_of(READINGS, "events")}), td AS (SELECT season_id, date, {", ".join(f"{e} AS {n}" for n, e in TRAP_SQL.items())}, 0 AS image_events FROM r GROUP BY ALL), t AS (SELECT season_id, count(DISTINCT date) AS miip_days, CAST(sum(trap_readings) AS BIGINT) AS trap_readings_total, max(traps_reporting) AS traps_reporting_max, avg(avg_pest_count) AS avg_pest_count FROM td GROUP BY ALL)
SELECT a.season_id, a.area_label, total_images, total_valid_images, total_images - total_valid_images AS invalid_images, {six(['ndvi_mean', 'ndvi_peak', 'harvest_yield_mean_kg_ha', 'overlap_area_ha', 'avg_pest_count'])}, round(ndvi_auc, 4) AS ndvi_auc, ops_days, harvest_days, stop_days, miip_days, trap_readings_total, traps_reporting_max,
  CAST((SELECT count(*) FROM part) AS INTEGER) AS soil_samples_available, (SELECT min(date) FROM weather) AS weather_start, (SELECT max(date) FROM weather) AS weather_end, true AS soil_context_only
FROM areas a LEFT JOIN total USING (season_id) LEFT JOIN c USING (season_id) LEFT JOIN o USING (season_id) LEFT JOIN t USING (season_id)""")
def season_inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fields with their scenes, operations and traps: twenty of them have telemetry."""
    traps = D.trap_daily(readings(spark, sf_dir)).withColumn("image_events", F.lit(0))
    out = TR.area_inventory(areas(spark, sf_dir), scenes(spark, sf_dir), clean(spark, sf_dir), ops_days(spark, sf_dir), traps, read(spark, sf_dir, "part"), weather_days(spark, sf_dir)).withColumn("ndvi_auc", F.round("ndvi_auc", 4))
    return rounded(out.select(
        "season_id", "area_label", "total_images", "total_valid_images", "invalid_images", "ndvi_mean", "ndvi_peak", "harvest_yield_mean_kg_ha", "overlap_area_ha", "avg_pest_count", "ndvi_auc", "ops_days", "harvest_days", "stop_days", "miip_days",
        "trap_readings_total", "traps_reporting_max", "soil_samples_available", "weather_start", "weather_end", "soil_context_only",
    ))


@query(f"""WITH {NDVI_WEEKS}, r AS ({table_of(READINGS, "events")}), total AS (SELECT season_id, count(*) AS total_images, count(*) FILTER (WHERE coalesce(b1_valid_pixels, 0) > 0) AS total_valid_images FROM scenes GROUP BY ALL), sc AS (SELECT season_id, count(DISTINCT week_start) AS ndvi_weeks, count(*) FILTER (WHERE has_weather_coverage) AS ndvi_weather_weeks FROM clean GROUP BY ALL),
p AS (SELECT season_id, count(*) FILTER (WHERE ndvi_mean_week < 0.0512345) AS low_vigor_weeks, count(*) FILTER (WHERE ndvi_mean_week > 0.0912345) AS major_drop_weeks FROM weeks GROUP BY ALL), m AS (SELECT season_id, count(DISTINCT date) AS miip_days, count(DISTINCT date_trunc('week', date)) AS miip_weeks FROM r GROUP BY ALL),
x AS (SELECT a.season_id, a.treatment, total_images, total_valid_images, total_valid_images / total_images AS ndvi_valid_ratio, ndvi_weeks, ndvi_weather_weeks, ndvi_weather_weeks / ndvi_weeks AS weather_coverage_ratio, miip_days, miip_weeks, miip_weeks / ndvi_weeks AS miip_coverage_ratio, low_vigor_weeks, major_drop_weeks FROM areas a LEFT JOIN total USING (season_id) LEFT JOIN sc USING (season_id) LEFT JOIN p USING (season_id) LEFT JOIN m USING (season_id))
SELECT season_id, treatment, total_images, total_valid_images, round(ndvi_valid_ratio, 6) AS ndvi_valid_ratio, ndvi_weeks, ndvi_weather_weeks, round(weather_coverage_ratio, 6) AS weather_coverage_ratio, miip_days, miip_weeks, round(miip_coverage_ratio, 6) AS miip_coverage_ratio, low_vigor_weeks, major_drop_weeks,
  CASE WHEN ndvi_valid_ratio < 0.55 THEN 'critico' WHEN weather_coverage_ratio < 0.40 OR miip_coverage_ratio < 0.30 THEN 'atencao' ELSE 'ok' END AS audit_status, (SELECT strftime(a, '%Y-%m-%d') || ' -> ' || strftime(b, '%Y-%m-%d') FROM span) AS weather_window FROM x""")
def season_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    scene, valid, weather = scenes(spark, sf_dir), clean(spark, sf_dir), weather_window(spark, sf_dir)
    traps = D.trap_daily(readings(spark, sf_dir)).withColumn("image_events", F.lit(0))
    inventory = TR.area_inventory(areas(spark, sf_dir), scene, valid, None, traps, read(spark, sf_dir, "part"), weather)
    v = F.col("ndvi_mean_week")
    line = WK.ndvi_weekly(valid).withColumns({"low_vigor_flag": v < 0.0512345, "major_drop_flag": v > 0.0912345, "ops_risk_flag": F.lit(False), "pest_risk_flag": F.lit(False)})
    out = TR.data_audit(inventory, valid, weather, traps, None, line)
    return rounded(out.select("season_id", "treatment", "total_images", "total_valid_images", "ndvi_valid_ratio", "ndvi_weeks", "ndvi_weather_weeks", "weather_coverage_ratio", "miip_days", "miip_weeks", "miip_coverage_ratio", "low_vigor_weeks", "major_drop_weeks", "audit_status", "weather_window"))


@query(f"""WITH {CLEAN}, s AS (SELECT *, (ndvi_mean - avg(ndvi_mean) OVER w) / nullif(stddev_pop(ndvi_mean) OVER w, 0) AS z, median(ndvi_mean) OVER w AS med FROM clean WINDOW w AS (PARTITION BY season_id)), r AS (SELECT *, 0.6745::DOUBLE * (ndvi_mean - med) / nullif(median(abs(ndvi_mean - med)) OVER (PARTITION BY season_id), 0) AS rz FROM s), f AS (SELECT *, coalesce(abs(z) >= 2.0, false) AS a, coalesce(abs(rz) >= 3.5, false) AS b FROM r)
SELECT season_id, filename AS image_path, date, week_start, area_label, treatment, comparison_pair, ndvi_mean, soil_pct, dense_veg_pct, round(z, 6) AS ndvi_zscore, round(rz, 6) AS ndvi_robust_zscore, a AS outlier_zscore_flag, b AS outlier_robust_flag, a OR b AS outlier_flag, CASE WHEN z < 0 THEN 'ndvi_abaixo_do_padrao' ELSE 'ndvi_acima_do_padrao' END AS outlier_direction FROM f""")
def scene_outliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(R.outliers(clean(spark, sf_dir)).withColumn("week_start", F.to_date("week_start")))


@query(f"""WITH {CLEAN} SELECT season_id, area_label, treatment, crop_type, comparison_pair, count(ndvi_mean) AS images_valid, count(DISTINCT week_start) AS weeks_with_scenes, min(date) AS scene_start, max(date) AS scene_end, avg(soil_pct) AS soil_pct_mean, avg(dense_veg_pct) AS dense_veg_pct_mean, count(ndvi_mean) AS count,
  count(*) - count(ndvi_mean) AS missing, 0.0::DOUBLE AS missing_ratio, round(avg(ndvi_mean), 6) AS mean, round(median(ndvi_mean), 6) AS median, round(stddev_samp(ndvi_mean), 6) AS std, min(ndvi_mean) AS min, round(quantile_cont(ndvi_mean, 0.25), 6) AS q1, round(quantile_cont(ndvi_mean, 0.75), 6) AS q3, max(ndvi_mean) AS max, round(abs(stddev_samp(ndvi_mean) / avg(ndvi_mean)), 6) AS cv,
  round(skewness(ndvi_mean), 5) AS skew, round(kurtosis(ndvi_mean), 5) AS kurtosis FROM clean GROUP BY ALL""")
def area_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = R.stats_by_area(clean(spark, sf_dir)).withColumns({c: F.round(c, 5) for c in ("skew", "kurtosis")})
    return rounded(out)


@query(f"""WITH {NDVI_WEEKS}, x AS (SELECT season_id, ndvi_mean_week AS y, CAST(row_number() OVER (PARTITION BY season_id ORDER BY week_start) - 1 AS DOUBLE) AS x FROM weeks), g AS (SELECT season_id, count(*) AS weeks, regr_slope(y, x) AS slope, regr_intercept(y, x) AS i, corr(y, x) AS r FROM x GROUP BY season_id)
SELECT season_id, area_label, treatment, weeks, round(slope, 9) AS slope_ndvi_per_week, round(i, 6) AS intercept_ndvi, round(r, 6) AS r_value, round(r * r, 6) AS r_squared FROM g LEFT JOIN areas USING (season_id)""")
def area_trends(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = R.trend_tests(clean(spark, sf_dir)).withColumn("slope_ndvi_per_week", F.round("slope_ndvi_per_week", 9))
    return out.select("season_id", "area_label", "treatment", "weeks", "slope_ndvi_per_week", *[F.round(c, 6).alias(c) for c in ("intercept_ndvi", "r_value", "r_squared")])


def _overview_sql(name: str, columns: list[str], numeric: int, season: str, area: str, date: str | None) -> str:
    day = (f"min({date})", f"max({date})") if date else ("NULL::DATE", "NULL::DATE")
    empty = " + ".join(f"count(*) FILTER (WHERE {c} IS NULL)" for c in columns)
    return f"SELECT '{name}' AS dataset, count(*) AS rows, CAST({len(columns)} AS BIGINT) AS columns, CAST({numeric} AS BIGINT) AS numeric_columns, {empty} AS null_cells, ({empty}) / (count(*) * {len(columns)}.0::DOUBLE) AS null_ratio, {season} AS unique_seasons, {area} AS unique_areas, {day[0]} AS date_start, {day[1]} AS date_end"


_PARTS = {
    "fields": ("(SELECT CAST(s_suppkey AS VARCHAR) AS season_id, CASE WHEN s_suppkey % 3 = 0 THEN NULL ELSE s_name END AS area_label, s_acctbal FROM supplier)", ["season_id", "area_label", "s_acctbal"], 1, "count(DISTINCT season_id)", "count(DISTINCT area_label)", None),
    "days": ("(SELECT CAST(ts AS DATE) AS date, CASE WHEN event_id % 7 = 0 THEN NULL ELSE value END AS value, user_id AS season_id, value > 20 AS high FROM events)", ["date", "value", "season_id", "high"], 3, "count(DISTINCT season_id)", "NULL::BIGINT", "date"),
    "orders": ("orders", ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"], 3, "NULL::BIGINT", "NULL::BIGINT", None),
}


@query(" UNION ALL ".join(f"{_overview_sql(n, c, k, s, a, d)}, '{', '.join(c[:8])}' AS sample_columns FROM {t}" for n, (t, c, k, s, a, d) in _PARTS.items()))
def table_overviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three tables: with seasons and areas, with dates and a boolean, and with neither."""
    fields = columns_of(read(spark, sf_dir, "supplier"), {"season_id": "CAST(s_suppkey AS STRING)", "area_label": "CASE WHEN s_suppkey % 3 = 0 THEN NULL ELSE s_name END", "s_acctbal": "s_acctbal"})
    days = columns_of(read(spark, sf_dir, "events"), {"date": "CAST(ts AS DATE)", "value": "CASE WHEN event_id % 7 = 0 THEN NULL ELSE value END", "season_id": "user_id", "high": "value > 20"})
    out = R.overview({"fields": fields, "days": days, "orders": read(spark, sf_dir, "orders")})
    return out.withColumns({c: F.col(c).cast("date") for c in ("date_start", "date_end")})


def _profile_sql(dataset: str, table: str, columns: list[str]) -> str:
    return " UNION ALL ".join(f"""SELECT '{dataset}' AS dataset, '{c}' AS variable, count({c}) AS count, count(*) - count({c}) AS missing, round((count(*) - count({c})) / count(*), 6) AS missing_ratio, round(avg({c}), 6) AS mean, round(median({c}), 6) AS median, round(stddev_samp({c}), 6) AS std, round(min({c}), 6) AS min, round(quantile_cont({c}, 0.25), 6) AS q1,
  round(quantile_cont({c}, 0.75), 6) AS q3, round(max({c}), 6) AS max, round(abs(stddev_samp({c}) / avg({c})), 6) AS cv, round(skewness({c}), 5) AS skew, round(kurtosis({c}), 5) AS kurtosis FROM {table}""" for c in columns)


HOURLY = ["precipitation_mm", "temp_avg_c", "humidity_avg_pct"]


@query(f"WITH hours AS ({table_of(HOURS, 'orders')}) {_profile_sql('hours', 'hours', HOURLY)} UNION ALL {_profile_sql('customers', 'customer', ['c_acctbal'])}")
def dataset_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    tables = {"hours": columns_of(read(spark, sf_dir, "orders"), HOURS), "customers": read(spark, sf_dir, "customer")}
    out = R.numeric_profiles(tables, {"hours": (*HOURLY, "absent"), "customers": ("c_acctbal",), "none": ("x",)})
    return rounded(out.withColumns({c: F.round(c, 5) for c in ("skew", "kurtosis")}))


@query(f"""WITH {PANEL}, p AS (SELECT *, 'A' || season_id AS area_label FROM panel), b AS (SELECT comparison_pair FROM p GROUP BY ALL HAVING bool_or(treatment = 'tecnologia_4_0') AND bool_or(treatment = 'convencional')), w AS (
  SELECT comparison_pair, week_start, min(season_id) FILTER (WHERE treatment = 'tecnologia_4_0') AS a, min(season_id) FILTER (WHERE treatment = 'convencional') AS b, max(ndvi_mean_week) FILTER (WHERE treatment = 'tecnologia_4_0') AS x, max(ndvi_mean_week) FILTER (WHERE treatment = 'convencional') AS y FROM p WHERE comparison_pair IN (SELECT * FROM b) GROUP BY ALL
) SELECT comparison_pair, week_start, a AS season_id_4_0, b AS season_id_convencional, 'A' || a AS tech_area_label, 'A' || b AS conv_area_label, a IS NOT NULL AND b IS NOT NULL AS paired_week_flag, round(x, 6) AS ndvi_mean_week_4_0, round(y, 6) AS ndvi_mean_week_convencional, round(x - y, 6) AS gap_ndvi_mean_week_4_0_minus_convencional FROM w WHERE coalesce(a, b) IS NOT NULL""")
def gaps_by_week(spark: SparkSession, sf_dir: str) -> DataFrame:
    weeks = panel(spark, sf_dir).withColumn("area_label", F.concat(F.lit("A"), F.col("season_id").cast("string")))
    return rounded(R.pair_weekly_gaps(weeks).drop("area_label_4_0", "area_label_convencional"))


RULED = {"harvest_yield_mean_kg_ha": "CASE o_orderkey % 5 WHEN 0 THEN NULL WHEN 1 THEN -1.0 ELSE o_totalprice / 10 END", "planting_population_mean_ha": "o_totalprice - 1000", "overlap_area_pct_bbox": "CASE WHEN o_orderkey % 10 < 9 THEN 0.0 ELSE 1.0 END", "stop_duration_h_per_bbox_ha": "CASE WHEN o_orderkey % 2 = 0 THEN 0.0 ELSE 1.0 END", "empty": "CAST(NULL AS STRING)"}


def _rule(table: str, rule: str, domain: str, severity: str, dimension: str, columns: str, hit: str, source: str, total: str = "count(*)", action: str = "mantido_com_alerta") -> str:
    return f"SELECT '{table}' AS table_name, '{rule}' AS rule_id, '{domain}' AS domain, '{severity}' AS severity, '{dimension}' AS dimension, {columns} AS affected_columns, '{action}' AS action, CAST({hit} AS BIGINT) AS affected_rows, {total} AS total_rows FROM {source}"


def _hits(condition: str) -> str:
    return f"count(*) FILTER (WHERE {condition})"


_NONE = "CAST(NULL AS BIGINT)"
_SEASON_RULES = [
    _rule("ndvi_raw", "ndvi_b1_valid_pixels_zero", "NDVI", "info", "completude", "'b1_valid_pixels, filename, season_id'", _hits("coalesce(b1_valid_pixels, 0) <= 0"), "scenes", action="descartado_da_base_analitica"),
    _rule("ndvi_raw", "ndvi_b1_mean_outside_range", "NDVI", "warning", "validade_fisica", "'b1_mean'", _hits("b1_mean < -1 OR b1_mean > 1"), "scenes"),
    _rule("ndvi_raw", "ndvi_b1_pct_solo_outside_pct", "NDVI", "warning", "validade_fisica", "'b1_pct_solo'", "0", "scenes"),
    _rule("ndvi_raw", "ndvi_b1_pct_veg_densa_outside_pct", "NDVI", "warning", "validade_fisica", "'b1_pct_veg_densa'", "0", "scenes"),
    _rule("ndvi_raw", "ndvi_soil_dense_veg_pct_sum_gt_100", "NDVI", "warning", "consistencia", "'b1_pct_solo, b1_pct_veg_densa'", "0", "scenes"),
    _rule("ndvi_raw", "ndvi_duplicate_scene_key", "NDVI", "warning", "consistencia", "'season_id, filename, date'", _hits("same > 1"), "(SELECT *, count(*) OVER (PARTITION BY season_id, filename) AS same FROM scenes)"),
    _rule("ndvi_raw", "ndvi_temporal_gap_gt_12_days", "NDVI", "info", "atualidade", "'season_id, date'", _hits("date_diff('day', previous, date) > 12"), "(SELECT *, lag(date) OVER (PARTITION BY season_id ORDER BY date, filename) AS previous FROM scenes)"),
    _rule("ndvi_clean", "ndvi_clean_missing_keys", "NDVI", "error", "completude", "'season_id, date, ndvi_mean'", _hits("season_id IS NULL OR date IS NULL OR ndvi_mean IS NULL"), "clean", action="bloqueia_confianca_da_linha"),
    _rule("weather_daily", "weather_temp_avg_implausible", "Clima", "warning", "validade_fisica", "'temp_avg_c'", _hits("temp_avg_c < -10 OR temp_avg_c > 50"), "weather"),
    _rule("weather_daily", "weather_humidity_outside_pct", "Clima", "warning", "validade_fisica", "'humidity_avg_pct'", _hits("humidity_avg_pct < 0 OR humidity_avg_pct > 100"), "weather"),
    _rule("weather_daily", "weather_wind_implausible", "Clima", "warning", "precisao", "'wind_avg_kmh'", _hits("wind_avg_kmh > 120"), "weather"),
    _rule("weather_daily", "weather_precipitation_negative_or_extreme", "Clima", "warning", "validade_fisica", "'precipitation_mm'", _hits("precipitation_mm < 0 OR precipitation_mm > 300"), "weather"),
    _rule("weather_daily", "weather_starts_after_ndvi_window", "Clima", "warning", "atualidade", "'date, has_weather_coverage, water_balance_mm_week'", _hits("date < (SELECT min(date) FROM weather)"), "clean"),
    _rule("ops_area_daily", "ops_yield_negative_or_extreme", "Operação", "warning", "validade_fisica", "'harvest_yield_mean_kg_ha'", _hits("harvest_yield_mean_kg_ha < 0 OR harvest_yield_mean_kg_ha > 25000"), "ruled"),
    _rule("ops_area_daily", "ops_yield_zero_or_missing", "Operação", "info", "completude", "'harvest_yield_mean_kg_ha'", _hits("coalesce(harvest_yield_mean_kg_ha, 0) <= 0"), "ruled"),
    _rule("ops_area_daily", "ops_population_implausible", "Operação", "info", "precisao", "'planting_population_mean_ha'", _hits("planting_population_mean_ha <= 0 OR planting_population_mean_ha > 200000"), "ruled"),
    *[_rule("ops_area_daily", f"ops_{c}_mostly_zero", "Operação", "info", "completude", f"'{c}'", f"CASE WHEN {_hits(f'{c} = 0')} > 0.8 * count(*) THEN {_hits(f'{c} = 0')} ELSE 0 END", "ruled") for c in ("overlap_area_pct_bbox", "stop_duration_h_per_bbox_ha")],
    _rule("miip_daily", "miip_pest_negative_or_extreme", "MIIP", "warning", "validade_fisica", "'avg_pest_count, total_pest_count'", _hits("avg_pest_count < 0 OR avg_pest_count > 10000"), "traps"),
    _rule("miip_daily", "miip_missing_spatial_assignment", "MIIP", "warning", "inconsistencia_espacial", "'season_id, area_label'", _hits("season_id IS NULL OR area_label IS NULL"), "traps"),
    *[_rule(t, f"{t}_empty_columns", "Estrutura", "info", "completude", f"'{c}'", str(int(c != "")), "(SELECT 1)", _NONE, "mantido_visivel_com_alerta") for t, c in (("ndvi_raw", ""), ("ndvi_clean", ""), ("weather_daily", ""), ("ops_area_daily", "empty"), ("miip_daily", ""))],
    *[_rule(t, f"{t}_duplicate_columns", "Estrutura", "warning", "consistencia", "''", "0", "(SELECT 1)", _NONE, "bloqueia_confianca_da_coluna") for t in ("ndvi_raw", "ndvi_clean", "weather_daily", "ops_area_daily", "miip_daily")],
]
MIIP = {"season_id": "CASE WHEN event_id % 50 = 0 THEN NULL ELSE CAST(user_id AS STRING) END", "area_label": "CASE WHEN event_id % 70 = 0 THEN NULL ELSE event_type END", "avg_pest_count": "CASE WHEN event_id % 13 = 0 THEN -value ELSE value * 100 END"}


@query(f"WITH {CLEAN}, {WEATHER_DAYS}, ruled AS ({table_of(RULED, 'orders')}), traps AS ({table_of(MIIP, 'events')}), r AS ({' UNION ALL '.join(_SEASON_RULES)}) SELECT *, CASE WHEN affected_rows = 0 THEN 'ok' ELSE 'atenção' END AS status FROM r")
def quality_of_season(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All rules of a season's five tables, with dimension, columns and action."""
    valid = clean(spark, sf_dir)
    return Q.quality_summary(scenes(spark, sf_dir), valid.select("season_id", "date", "filename", "ndvi_mean"), weather_days(spark, sf_dir), columns_of(read(spark, sf_dir, "orders"), RULED), columns_of(read(spark, sf_dir, "events"), MIIP))


@query(f"""WITH r AS (SELECT 'orders' AS table_name, unnest(['a', 'b', 'c', 'd']) AS rule_id, unnest(['info', 'error', 'warning', 'warning']) AS severity, unnest([{_hits("o_totalprice > 1000")}, {_hits("o_totalprice > 300000")}, {_hits("o_totalprice > 200000")}, {_hits("o_totalprice > 100000")}]) AS affected_rows FROM orders)
SELECT rule_id, CAST(row_number() OVER (ORDER BY CASE severity WHEN 'error' THEN 1 WHEN 'warning' THEN 2 ELSE 3 END, affected_rows DESC, rule_id) AS INTEGER) AS place FROM r""")
def rules_by_severity(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = [Q.Rule(i, s, F.col("o_totalprice") > least) for i, s, least in (("a", "info", 1000), ("b", "error", 300_000), ("c", "warning", 200_000), ("d", "warning", 100_000))]
    ordered = Q.severity_order(Q.run_rules(read(spark, sf_dir, "orders"), rules, "orders")).select("rule_id")
    return ordered.agg(F.collect_list("rule_id").alias("r")).select(F.posexplode("r").alias("at", "rule_id")).select("rule_id", (F.col("at") + 1).alias("place"))  # four rules
