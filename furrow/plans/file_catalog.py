"""Queries that write a drop of CSV files from the driver's tables into the shared folder, read it by the library's sources, and the same in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from furrow.operators import evidence as EV
from furrow.operators import narrative as NA
from furrow.operators import pairs as P
from furrow.plans.catalog import query, read, rounded
from furrow.plans.season_catalog import columns_of, table_of
from furrow.sources import catalog as K
from furrow.sources import csv as C
from furrow.sources import sinks
from furrow.sources.scratch import new_folder


def dropped(spark: SparkSession, sf_dir: str, name: str, table: str, columns: dict[str, str]) -> str:
    """The path, found by its source's pattern, of a table's columns written as that source's CSV: a folder of parts, as Spark writes files."""
    root = new_folder(spark, "drop")
    pattern, sep, _ = C.SOURCES[name]
    columns_of(read(spark, sf_dir, table), columns).write.csv(f"{root}/{pattern.replace('*', '1', 1).replace('*.csv', 'w.csv')}", header=True, sep=sep, escape='"')
    return C.find_source(spark, root, name)


def comma(e: str, digits: int = 4) -> str:
    """A number as a drop writes it: a decimal comma."""
    return f"REPLACE(CAST(CAST({e} AS DECIMAL(18, {digits})) AS STRING), '.', ',')"


SCENE = {"filename": "CONCAT('s_', SUBSTR(CAST(CAST(l_shipdate AS DATE) AS STRING), 1, 10), '.tiff')", "season_id": "CONCAT('s', CAST(l_suppkey AS STRING))", "crs": "'EPSG:3857'", "b1_mean": "CASE WHEN l_linenumber = 1 THEN '-' ELSE CAST(CAST(l_discount AS DECIMAL(9, 3)) AS STRING) END", "b1_valid_pixels": "CASE WHEN l_linenumber = 2 THEN 'nan' ELSE CAST(l_orderkey AS STRING) END"}


@query("""SELECT 's' || l_suppkey AS season_id, CAST(l_shipdate AS DATE) AS date, 's_' || strftime(l_shipdate, '%Y-%m-%d') || '.jpg' AS image_path, count(*) AS scenes, round(sum(CASE WHEN l_linenumber <> 1 THEN l_discount END), 6) AS means, CAST(sum(CASE WHEN l_linenumber <> 2 THEN l_orderkey END) AS DOUBLE) AS pixels FROM lineitem GROUP BY ALL""")
def scenes_from_a_drop(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = C.load_scenes(spark, dropped(spark, sf_dir, "ndvi_metadata", "lineitem", SCENE))
    return rounded(found.groupBy("season_id", "date", "image_path").agg(F.count(F.lit(1)).alias("scenes"), F.sum("b1_mean").alias("means"), F.sum("b1_valid_pixels").alias("pixels")))


STATION = {"Data": "CONCAT(SUBSTR(CAST(CAST(o_orderdate AS DATE) AS STRING), 9, 2), '/', SUBSTR(CAST(CAST(o_orderdate AS DATE) AS STRING), 6, 2), '/', SUBSTR(CAST(CAST(o_orderdate AS DATE) AS STRING), 1, 4), ' - 10:00 / GMT -3')", "Precipitação (mm)": f"CASE WHEN o_orderkey % 9 = 0 THEN '-' ELSE {comma('o_totalprice / 1003.3')} END", "Temp. Média (°C)": "CAST(o_custkey AS STRING)"}


@query("""SELECT CAST(o_orderdate AS DATE) AS date, count(*) AS hours, round(sum(CASE WHEN o_orderkey % 9 > 0 THEN CAST(o_totalprice / 1003.3 AS DECIMAL(18, 4)) END), 4)::DOUBLE AS rain, CAST(sum(o_custkey) AS DOUBLE) AS heat, CAST(0 AS BIGINT) AS winds FROM orders GROUP BY ALL""")
def weather_from_a_drop(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Headers with accents, decimal commas, zones, and a station without most of the columns."""
    hours = C.load_weather(spark, dropped(spark, sf_dir, "weather_hourly", "orders", STATION))
    return rounded(hours.groupBy("date").agg(F.count("timestamp").alias("hours"), F.sum("precipitation_mm").alias("rain"), F.sum("temp_avg_c").alias("heat"), F.count("wind_avg_kmh").alias("winds")), 4)


TRACK = {"Date Time": "CONCAT('0', CAST(event_id % 9 + 1 AS STRING), '/02/2026 10:11:12')", "Operation": "event_type", "Speed - km/h": f"CASE WHEN event_id % 5 = 0 THEN 'nan' ELSE {comma('value')} END", "geometry": "CASE WHEN event_id % 7 = 0 THEN 'LINESTRING EMPTY' ELSE CONCAT('LINESTRING (', CAST(user_id AS STRING), ' 1, ', CAST(user_id + 2 AS STRING), ' 1)') END"}


@query("""SELECT make_date(2026, 2, CAST(event_id % 9 + 1 AS INTEGER)) AS date, event_type AS "Operation", count(*) AS rows, round(sum(CASE WHEN event_id % 5 > 0 THEN CAST(value AS DECIMAL(18, 4)) END)::DOUBLE, 4) AS speed, CAST(sum(CASE WHEN event_id % 7 > 0 THEN user_id + 1 END) AS DOUBLE) AS lon, count(*) FILTER (WHERE event_id % 7 > 0) AS places FROM events GROUP BY ALL""")
def layer_from_a_drop(spark: SparkSession, sf_dir: str) -> DataFrame:
    track = C.load_layer(spark, dropped(spark, sf_dir, "speed_layer", "events", TRACK), ["Speed - km/h"])
    return rounded(track.groupBy("date", "Operation").agg(F.count("timestamp").alias("rows"), F.sum("Speed - km/h").alias("speed"), F.sum("centroid_lon").alias("lon"), F.count("centroid_lat").alias("places")), 4)


LISTED_TRAPS = {"code": "CONCAT('T', CAST(c_custkey % 100 AS STRING))", "type": "c_mktsegment", "plot": "CASE c_custkey % 3 WHEN 0 THEN 'nan' WHEN 1 THEN ' ' ELSE 'P1' END", "latitude": comma("0 - c_custkey % 10"), "longitude": "'1,5'", "id": "CAST(c_custkey AS STRING)", "farm": "'1'", "businessUnit": "'2'", "radius": "'3,5'", "installationDate": "CASE WHEN c_custkey % 2 = 0 THEN '2025-01-02' END"}


@query("""SELECT DISTINCT 'T' || c_custkey % 100 AS code, c_mktsegment AS type, CASE c_custkey % 3 WHEN 2 THEN 'P1' END AS plot, CAST(-(c_custkey % 10) AS DOUBLE) AS latitude, 3.5::DOUBLE AS radius FROM customer""")
def traps_from_a_drop(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.load_traps(spark, dropped(spark, sf_dir, "traps_list", "customer", LISTED_TRAPS)).select("code", "type", "plot", "latitude", "radius")


TRAP_ROWS = {"trapCode": "CONCAT('T', CAST(user_id AS STRING))", "trapType": "event_type", "doneMissionCount": "'1'", "idBusinessUnit": "'2'", "lateMissionCount": "'x'", "pendingMissionCount": "''", "pestCount": comma("value"), "trapId": "CAST(event_id AS STRING)", "createdAt": "CASE WHEN event_id % 11 = 0 THEN 'bad' ELSE CONCAT(SUBSTR(CAST(ts AS STRING), 1, 10), 'T10:00:00Z') END"}


@query("""SELECT 'T' || user_id AS "trapCode", CASE WHEN event_id % 11 > 0 THEN CAST(ts AS DATE) END AS event_date, count(*) AS rows, round(sum(CAST(value AS DECIMAL(18, 4)))::DOUBLE, 4) AS pests, CAST(count(*) AS DOUBLE) AS done, CAST(0 AS BIGINT) AS late FROM events GROUP BY ALL""")
def trap_rows_from_a_drop(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = C.load_trap_data(spark, dropped(spark, sf_dir, "traps_data", "events", TRAP_ROWS))
    return rounded(rows.groupBy("trapCode", "event_date").agg(F.count(F.lit(1)).alias("rows"), F.sum("pestCount").alias("pests"), F.sum("doneMissionCount").alias("done"), F.count("lateMissionCount").alias("late")), 4)


PEST_ROWS = {"MIIP_PEST_ID": "CAST(p_partkey AS STRING)", "MIIP_PEST_NAME_POPULAR": "p_name", "MIIP_PEST_NAME_SCIENTIFIC": "p_type", "MIIP_PEST_ALERT": comma("p_retailprice"), "MIIP_PEST_CONTROL": "'-'", "MIIP_PEST_DAMAGE": "CAST(p_size AS STRING)"}
PEST_DETAILS = {"id": "CAST(p_partkey AS STRING)", "namePopular": "CONCAT(p_name, ' \"x\" ')", "nameScientific": "p_type", "alert": "'1'", "control": "'2,5'", "damage": "CAST(p_size AS STRING)", "actionRay": comma("p_retailprice"), "daysAdhesiveFloor": "'1'", "daysPheromone": "'1'"}


@query("""SELECT p_name AS name, count(*) AS rows, round(sum(p_retailprice), 4) AS alerts, count(*) FILTER (WHERE false) AS controls, CAST(sum(p_size) AS DOUBLE) AS damages FROM part GROUP BY p_name""")
def pests_from_a_drop(spark: SparkSession, sf_dir: str) -> DataFrame:
    pests = C.load_pest_list(spark, dropped(spark, sf_dir, "pest_list", "part", PEST_ROWS))
    return rounded(pests.groupBy("name").agg(F.count(F.lit(1)).alias("rows"), F.sum("alert_threshold").alias("alerts"), F.count("control_threshold").alias("controls"), F.sum("damage_threshold").alias("damages")), 4)


@query("""SELECT p_name || ' "x"' AS name, count(*) AS rows, round(sum(p_retailprice), 4) AS rays, 2.5::DOUBLE * count(*) AS controls FROM part GROUP BY p_name""")
def pest_details_from_a_drop(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names with quotes in them."""
    pests = C.load_pest_details(spark, dropped(spark, sf_dir, "pest_details", "part", PEST_DETAILS))
    return rounded(pests.groupBy(F.trim("name").alias("name")).agg(F.count(F.lit(1)).alias("rows"), F.sum("action_ray_m").alias("rays"), F.sum("control_threshold").alias("controls")), 4)


SAMPLES = {"AMOSTRA": "CONCAT('A', CAST(p_partkey AS STRING))", "PH": comma("p_size / 7.0"), "Argila": "CASE WHEN p_partkey % 2 = 0 THEN 'None' ELSE CAST(p_size AS STRING) END"}


@query("""SELECT 'A' || p_partkey AS "AMOSTRA", CAST(CAST(p_size / 7.0 AS DECIMAL(18, 4)) AS DOUBLE) AS "PH", CASE WHEN p_partkey % 2 = 1 THEN CAST(p_size AS DOUBLE) END AS "Argila" FROM part""")
def soil_from_a_drop(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.load_soil(spark, dropped(spark, sf_dir, "soil_analysis", "part", SAMPLES))


@query("""SELECT 'EKOS' AS place, ';' AS separator, 'UTF-8' AS encoding, 4 AS columns, CAST((SELECT count(*) FROM events) AS BIGINT) AS rows, CAST((SELECT make_date(2026, 2, CAST(min(event_id % 9) + 1 AS INTEGER)) FROM events) AS DATE) AS first_day, CAST((SELECT make_date(2026, 2, CAST(max(event_id % 9) + 1 AS INTEGER)) FROM events) AS DATE) AS last_day
UNION ALL SELECT 'OneSoil', ',', 'UTF-8', 5, (SELECT count(*) FROM lineitem), (SELECT CAST(min(l_shipdate) AS DATE) FROM lineitem), (SELECT CAST(max(l_shipdate) AS DATE) FROM lineitem)""")
def files_of_a_drop(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facts of all files, found in tasks over their splits, summed up by the source's folder."""
    root = new_folder(spark, "drop")
    for name, table, columns in (("speed_layer", "events", TRACK), ("ndvi_metadata", "lineitem", SCENE)):
        pattern, sep, _ = C.SOURCES[name]
        columns_of(read(spark, sf_dir, table), columns).write.csv(f"{root}/{pattern.replace('*', '1', 1)}", header=True, sep=sep)
    place = F.regexp_extract("path", "/(EKOS|OneSoil)1/", 1)
    facts = K.file_catalog(spark, root).groupBy(place.alias("place"), "separator", "encoding", "columns")
    return facts.agg(F.sum("rows").alias("rows"), F.to_date(F.min("temporal_min")).alias("first_day"), F.to_date(F.max("temporal_max")).alias("last_day"))


@query("""SELECT s_suppkey, s_name, s_acctbal, n_name, '["' || s_nationkey || '","x"]' AS tags FROM supplier JOIN nation ON s_nationkey = n_nationkey""")
def tables_published_and_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two versions of two tables as CSV; the last one is read back with its types, lists as JSON."""
    folder = new_folder(spark, "published")
    suppliers = read(spark, sf_dir, "supplier").withColumn("tags", F.array(F.col("s_nationkey").cast("string"), F.lit("x")))
    sinks.publish(spark, {"suppliers": suppliers.limit(0)}, folder, "csv")
    sinks.publish(spark, {"suppliers": suppliers, "nations": read(spark, sf_dir, "nation")}, folder, "csv")
    back = sinks.published(spark, folder)
    return back["suppliers"].join(back["nations"], F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", "s_name", "s_acctbal", "n_name", "tags")


@query("""SELECT s_nationkey, round(sum(s_acctbal), 2) AS balance FROM supplier GROUP BY s_nationkey""")
def table_built_or_loaded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Built and saved once; the second call finds it and does not build again."""
    name = "furrow_balances_" + new_folder(spark, "name").rsplit("-", 1)[1]
    build = lambda: read(spark, sf_dir, "supplier").groupBy("s_nationkey").agg(F.round(F.sum("s_acctbal"), 2).alias("balance"))
    sinks.ensure_table(spark, name, build)
    return sinks.ensure_table(spark, name, lambda: build().limit(0))


EFFECTS = {"c_custkey": "c_custkey", "n": "c_custkey % 12", "advantage": "c_acctbal / 3001.7", "low": "(c_acctbal - 900) / 3001.7", "high": "(c_acctbal + 1100) / 3001.7", "p_value": "CASE WHEN c_custkey % 13 = 0 THEN NULL ELSE (c_custkey % 30) / 200.0 END",
           "shapiro_p": "CASE c_custkey % 4 WHEN 0 THEN NULL ELSE (c_custkey % 17) / 100.0 END", "t_p": "CASE c_custkey % 5 WHEN 0 THEN NULL ELSE (c_custkey % 19) / 150.0 END", "wilcoxon_p": "CASE c_custkey % 3 WHEN 0 THEN NULL ELSE (c_custkey % 23) / 150.0 END"}


@query(f"""WITH e AS ({table_of(EFFECTS, "customer")}), r AS (SELECT *, CASE WHEN shapiro_p >= 0.05 AND t_p IS NOT NULL THEN 'ttest_1samp' WHEN wilcoxon_p IS NOT NULL THEN 'wilcoxon' WHEN t_p IS NOT NULL THEN 'ttest_1samp' ELSE 'sem_teste' END AS test FROM e), p AS (SELECT *, CASE WHEN test = 'wilcoxon' THEN wilcoxon_p ELSE t_p END AS rp FROM r)
SELECT c_custkey, CASE WHEN advantage >= 0.5 AND low > 0 THEN 'favorece_4_0' WHEN advantage <= -0.5 AND high < 0 THEN 'favorece_convencional' ELSE 'inconclusivo' END AS winner, CASE WHEN n < 4 THEN 'baixa' WHEN n >= 8 AND (low > 0 OR high < 0) AND p_value <= 0.05 AND abs(advantage) >= 0.5 THEN 'alta' WHEN n >= 6 AND (((low > 0 OR high < 0) AND abs(advantage) >= 0.5) OR p_value <= 0.10) THEN 'media' ELSE 'baixa' END AS evidence_level,
  test AS recommended_test, coalesce(rp <= 0.05, false) AS significant, CASE WHEN rp <= 0.05 AND advantage >= 0.5 THEN 'favorece_4_0' WHEN rp <= 0.05 AND advantage <= -0.5 THEN 'favorece_convencional' ELSE 'inconclusivo' END AS favors FROM p""")
def verdicts_of_effects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Winner and evidence of an effect, and the test that a gap is judged by, for every case of the rules."""
    e = columns_of(read(spark, sf_dir, "customer"), EFFECTS)
    args, least = (F.col("advantage"), F.col("low"), F.col("high")), F.lit(0.5)
    e = e.withColumns({"winner": P.winner(*args, least), "evidence_level": P.evidence(F.col("n"), *args, F.col("p_value"), least)})
    return P.recommended(e.drop("p_value"), F.col("advantage"), least).select("c_custkey", "winner", "evidence_level", "recommended_test", "significant", "favors")


_SIDES = {"season_id": "c_custkey", "comparison_pair": "CONCAT('p', CAST(c_custkey % 400 AS STRING))", "treatment": "CASE WHEN c_custkey % 7 = 0 THEN 'outro' WHEN c_custkey < 750 THEN 'tecnologia_4_0' ELSE 'convencional' END", "area_label": "c_name", "mapping_source": "CASE WHEN c_custkey % 50 = 0 THEN 'auto_missing' ELSE 'official' END"}
INVENTORY = {**_SIDES, "ndvi_mean": "c_acctbal / 99999.7", "harvest_yield_mean_kg_ha": "CASE WHEN c_custkey % 6 = 0 THEN NULL ELSE c_acctbal / 7.3 END", "avg_pest_count": "CASE WHEN c_custkey % 5 = 0 THEN NULL ELSE c_acctbal / 1003.3 END", "overlap_area_pct_bbox": "c_acctbal / 100003.1",
             "stop_duration_h_per_bbox_ha": "c_acctbal / 50003.9", "fert_dose_gap_abs_mean_kg_ha": "c_acctbal / 301.7", "miip_days": "c_custkey % 9", "soil_samples_available": "c_custkey % 20"}
FEATURED = {"comparison_pair": "CONCAT('p', CAST(o_custkey % 400 AS STRING))", "has_weather_coverage_week": "o_custkey % 400 > 100"}
_METRICS = [("ndvi_mean", "NDVI medio da safra", "", 0.02, 1), ("harvest_yield_mean_kg_ha", "Produtividade de colheita", " kg/ha", 100.0, 1), ("avg_pest_count", "Pressao media de pragas", " insetos", 2.0, -1), ("overlap_area_pct_bbox", "Sobreposicao operacional por area", " ha/ha", 0.01, -1),
            ("stop_duration_h_per_bbox_ha", "Horas de parada por area", " h/ha", 0.05, -1), ("fert_dose_gap_abs_mean_kg_ha", "Conformidade media de dose em adubacao", " kg/ha", 10.0, -1)]


def _said(side: str, sign: int) -> str:
    return ", ".join(f"CASE WHEN abs(t.{c} - v.{c}) >= {least}::DOUBLE AND {'' if sign > 0 else 'NOT '}({better} * (t.{c} - v.{c}) {'>' if better > 0 else '>='} 0) THEN '{label}: {side} leva vantagem (' || printf('%+.2f', t.{c} - v.{c}) || '{unit}).' END" for c, label, unit, least, better in _METRICS)


@query(f"""WITH i AS ({table_of(INVENTORY, "customer")}), f AS ({table_of(FEATURED, "orders")}), n AS (SELECT *, row_number() OVER (PARTITION BY comparison_pair, treatment ORDER BY area_label) AS k FROM i), g AS (SELECT comparison_pair, max(soil_samples_available) <= 8 AS little, bool_or(mapping_source = 'auto_missing') AS unmapped, count(harvest_yield_mean_kg_ha) = 0 AS yieldless FROM i GROUP BY ALL),
c AS (SELECT comparison_pair, bool_and(has_weather_coverage_week) AS covered FROM f GROUP BY ALL), x AS (SELECT g.comparison_pair, {" + ".join(f"coalesce((abs(t.{c} - v.{c}) >= {least}::DOUBLE)::INT, 0)" for c, _, _, least, _ in _METRICS)} AS found, concat_ws(' | ', {_said("4.0", 1)}) AS a, concat_ws(' | ', {_said("convencional", -1)}) AS b,
  t.season_id IS NOT NULL AND v.season_id IS NOT NULL AND (t.harvest_yield_mean_kg_ha IS NULL) <> (v.harvest_yield_mean_kg_ha IS NULL) AS no_yield, t.season_id IS NOT NULL AND v.season_id IS NOT NULL AND (t.avg_pest_count IS NULL) <> (v.avg_pest_count IS NULL) AS no_traps,
  coalesce(least(t.miip_days, v.miip_days) > 0 AND t.miip_days IS NOT NULL AND v.miip_days IS NOT NULL AND greatest(t.miip_days, v.miip_days) / least(t.miip_days, v.miip_days) >= 2, false) AS days, covered, little, unmapped, yieldless
  FROM g LEFT JOIN n t ON t.comparison_pair = g.comparison_pair AND t.treatment = 'tecnologia_4_0' AND t.k = 1 LEFT JOIN n v ON v.comparison_pair = g.comparison_pair AND v.treatment = 'convencional' AND v.k = 1 LEFT JOIN c ON c.comparison_pair = g.comparison_pair),
y AS (SELECT *, CASE WHEN found >= 4 THEN 3 WHEN found >= 2 THEN 2 ELSE 1 END AS level, no_yield::INT + no_traps::INT AS gaps FROM x)
SELECT comparison_pair AS pair, CASE greatest(level - gaps, 1) WHEN 3 THEN 'alta' WHEN 2 THEN 'media' ELSE 'baixa' END AS evidence_strength, CASE a WHEN '' THEN 'Sem evidencia clara favoravel ao 4.0.' ELSE a END AS supports_4_0, CASE b WHEN '' THEN 'Sem evidencia clara favoravel ao convencional.' ELSE b END AS supports_convencional,
  coalesce(nullif(concat_ws(' | ', CASE WHEN no_yield THEN 'Produtividade consolidada ausente em um dos lados do par.' END, CASE WHEN no_traps THEN 'MIIP sem cobertura nos dois lados do par; comparacao de pragas fica parcial.' END, CASE WHEN days THEN 'MIIP com cobertura muito desigual entre as areas do par.' END, CASE WHEN NOT covered THEN 'Parte da serie NDVI deste par nao tem cobertura local de clima.' END,
    CASE WHEN little THEN 'Solo disponivel apenas como contexto; sem chave espacial completa por talhao.' END, CASE WHEN unmapped THEN 'Existe area sem mapeamento oficial consolidado.' END, CASE WHEN yieldless THEN 'Nao ha produtividade consolidada suficiente para este par.' END), ''), 'Sem lacunas adicionais alem das gerais da fase 1.') AS known_gaps FROM y""")
def matrix_of_hypotheses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Evidence of some hundred pairs by the inventory of their fields, with what is known to lack."""
    return NA.hypothesis_matrix_texts(columns_of(read(spark, sf_dir, "customer"), INVENTORY), columns_of(read(spark, sf_dir, "orders"), FEATURED))


SCORED = {"season_id": "c_custkey", "area_label": "c_name", "comparison_pair": "CONCAT('p', CAST(c_custkey % 700 AS STRING))", "trajectory_score": "CAST(CAST(abs(c_acctbal) / 100.3 AS DECIMAL(9, 2)) AS DOUBLE)", "latest_phase": "c_mktsegment", "latest_event": "CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE 'queda' END",
          "low_vigor_share": "(c_custkey % 10) / 10.0", "major_drop_share": "(c_custkey % 7) / 10.0", "pest_risk_share": "CASE WHEN c_custkey % 4 = 0 THEN NULL ELSE (c_custkey % 5) / 10.0 END", "ops_risk_share": "(c_custkey % 3) / 10.0", "weather_stress_share": "(c_custkey % 11) / 20.0", "telemetry_risk_share": "0.0"}
_RISKS = {"low_vigor_share": "baixo_vigor_recorrente", "major_drop_share": "quedas_relevantes_de_ndvi", "pest_risk_share": "pressao_de_praga", "ops_risk_share": "risco_operacional", "weather_stress_share": "estresse_climatico", "telemetry_risk_share": "telemetria_instavel"}
_ACT = [("'pressao_de_praga' IN r", "Reforcar validacao agronomica e resposta MIIP nas janelas com limiares."), ("('risco_operacional' IN r OR 'quedas_relevantes_de_ndvi' IN r)", "Revisar calibracao, sobreposicao, paradas e aderencia operacional nas semanas de queda."), ("'baixo_vigor_recorrente' IN r", "Inspecionar estande, solo exposto e manejo localizado nas faixas de menor vigor."), ("'estresse_climatico' IN r", "Separar o efeito do clima do efeito de manejo ao interpretar a diferenca de NDVI.")]


@query(f"""WITH s AS ({table_of(SCORED, "customer")}), o AS (SELECT *, first_value(season_id) OVER w AS k1, first_value(trajectory_score) OVER w AS s1, nth_value(trajectory_score, 2) OVER w AS s2 FROM s WINDOW w AS (PARTITION BY comparison_pair ORDER BY season_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)),
g AS (SELECT *, trajectory_score - CASE WHEN k1 = season_id THEN s2 ELSE s1 END AS gap, list_transform(list_sort(list_filter([{", ".join(f"CASE WHEN {c} >= 0.2 THEN {{'w': -{c}::DOUBLE, 'l': '{label}'}} END" for c, label in _RISKS.items())}], lambda x: x IS NOT NULL))[1:3], lambda x: x.l) AS r FROM o),
e AS (SELECT *, CASE WHEN gap IS NULL THEN 'sem_referencia_no_par' WHEN gap >= 6 THEN 'tende_a_chegar_acima_do_par' WHEN gap <= -6 THEN 'tende_a_chegar_abaixo_do_par' ELSE 'sem_vantagem_clara_no_par' END AS expected_vs_pair FROM g)
SELECT season_id, expected_vs_pair, coalesce(nullif(array_to_string(r, ' | '), ''), 'Sem risco dominante alem dos limites gerais do pacote.') AS top_risks, CASE expected_vs_pair WHEN 'tende_a_chegar_acima_do_par' THEN area_label || ' tende a chegar a colheita em condicao relativa superior no par, mantendo o perfil recente de NDVI.' WHEN 'tende_a_chegar_abaixo_do_par' THEN area_label || ' tende a chegar a colheita em condicao relativa inferior no par se o padrao recente de NDVI persistir.'
  ELSE area_label || ' nao mostra vantagem clara no par; a leitura atual e ' || latest_phase || ' com evento recente ' || coalesce(latest_event, 'sem evento forte') || '.' END AS expected_harvest_note, coalesce(nullif(concat_ws(' | ', {", ".join(f"CASE WHEN {c} THEN '{text}' END" for c, text in _ACT)}), ''), 'Manter monitoramento semanal e validar em campo os sinais de NDVI antes de conclusao forte.') AS recommended_actions, 'Sem leitura comparativa adicional.' AS pair_context FROM e""")
def outlook_of_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Risks, expectation against the pair, harvest note and actions; pairs have one to three fields."""
    ahead = EV.outlook(columns_of(read(spark, sf_dir, "customer"), SCORED))
    none = spark.createDataFrame([], "pair string, ndvi_interpretation string")
    return NA.outlook_texts(ahead, none).select("season_id", "expected_vs_pair", "top_risks", "expected_harvest_note", "recommended_actions", "pair_context")
