"""Queries over the driver's tables that run the operators of places, workspaces, lineage and texts, and the same in SQL.

Places lie on the equator, where a way on the ellipsoid is its radius times the
angle, so that SQL can tell geodesic distances.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from furrow.functions import exprs as X
from furrow.operators import evidence as EV
from furrow.operators import index as I
from furrow.operators import lineage as L
from furrow.operators import narrative as NA
from furrow.operators import spatial as S
from furrow.operators import timeline as T
from furrow.operators import trial as TR
from furrow.operators import windows as W
from furrow.operators import workspace as WS
from furrow.plans.catalog import EDGES, PANEL, SCENES, edges, panel, query, read, rounded, scenes
from furrow.plans.season_catalog import CLEAN, READINGS, TELEMETRY, TRAPS, areas, clean, columns_of, readings, six, table_of, telemetry
from furrow.sources import catalog as K

FIELDS = {"season_id": "CAST(c_custkey AS STRING)", "center_lon": "(c_custkey * 37 % 997) * 0.00731", "center_lat": "0.0"}
METRES = "6378137.0::DOUBLE * radians(abs({}))"


@query(f"""WITH f AS ({table_of(FIELDS, "customer")}), t AS ({table_of(TRAPS, "supplier")}), n AS (SELECT season_id, code, plot, {METRES.format("center_lon - longitude")} AS d, row_number() OVER (PARTITION BY season_id ORDER BY abs(center_lon - longitude), code) AS place FROM f, t WHERE latitude IS NOT NULL)
SELECT season_id, CAST(place AS INTEGER) AS place, code AS site, plot, round(d, 3) AS distance_m FROM n WHERE place <= 3""")
def three_nearest_traps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metres on the ellipsoid; the broadcast side is first measured on the sphere."""
    fields = columns_of(read(spark, sf_dir, "customer"), FIELDS).withColumnsRenamed({"center_lon": "lon", "center_lat": "lat"})
    traps = columns_of(read(spark, sf_dir, "supplier"), TRAPS).select(F.col("code").alias("site"), F.col("longitude").alias("s_lon"), F.col("latitude").alias("s_lat"), "plot")
    near = S.k_nearest(fields, traps).select("season_id", F.posexplode("nearest").alias("at", "n"))
    return near.select("season_id", (F.col("at") + 1).alias("place"), "n.site", "n.plot", F.round("n.distance_m", 3).alias("distance_m"))


@query(f"""WITH f AS ({table_of(FIELDS, "customer")}), t AS ({table_of(TRAPS, "supplier")}), n AS (SELECT season_id, code, type, plot, {METRES.format("center_lon - longitude")} AS d, row_number() OVER (PARTITION BY season_id ORDER BY abs(center_lon - longitude), code) AS place FROM f, t WHERE latitude IS NOT NULL),
c AS (SELECT season_id, coalesce(arg_min(struct_pack(code := code, type := type, plot := plot, d := d), place) FILTER (WHERE place <= 3 AND plot IS NOT NULL AND d <= 1.25 * least_), arg_min(struct_pack(code := code, type := type, plot := plot, d := d), place)) AS s, string_agg(code || ' (' || CAST(floor(round(d, 1)) AS BIGINT) || ' m)', ', ' ORDER BY place) FILTER (WHERE place <= 3) AS supporting_traps
  FROM (SELECT *, min(d) OVER (PARTITION BY season_id) AS least_ FROM n) GROUP BY season_id)
SELECT season_id, coalesce(s.plot, 'sem_talhão') AS suggested_plot, CASE s.type WHEN 'ELECTRONIC' THEN 'tecnologia_4_0' WHEN 'CONVENTIONAL' THEN 'convencional' ELSE 'indefinido' END AS suggested_treatment, s.code AS closest_trap, round(s.d, 1) AS distance_to_closest_trap_m, 'Área ' || substr(season_id, 1, 8) AS suggested_area_label, supporting_traps FROM c""")
def suggested_mapping(spark: SparkSession, sf_dir: str) -> DataFrame:
    return WS.suggested_mapping(columns_of(read(spark, sf_dir, "customer"), FIELDS), columns_of(read(spark, sf_dir, "supplier"), TRAPS))


@query(f"""WITH f AS ({table_of(FIELDS, "customer")}), t AS ({table_of(TRAPS, "supplier")}), p AS (SELECT season_id, code, {METRES.format("center_lon - longitude")} AS d FROM f, t WHERE latitude IS NOT NULL) SELECT season_id, code, round(d, 3) AS distance_m FROM p WHERE d <= 350""")
def traps_within_radius(spark: SparkSession, sf_dir: str) -> DataFrame:
    left = columns_of(read(spark, sf_dir, "customer"), FIELDS).withColumnsRenamed({"center_lon": "lon", "center_lat": "lat"})
    right = columns_of(read(spark, sf_dir, "supplier"), TRAPS).where("latitude is not null").select("code", F.col("longitude").alias("r_lon"), F.col("latitude").alias("r_lat"))
    return S.within_radius(left, right, 350.0).select("season_id", "code", F.round("distance_m", 3).alias("distance_m"))


@query(f"""WITH f AS ({table_of(FIELDS, "customer")}), t AS ({table_of(TRAPS, "supplier")}), r AS ({table_of(READINGS, "events")}), n AS (SELECT *, row_number() OVER (PARTITION BY "trapCode" ORDER BY "createdAt" DESC, "trapId" DESC) AS k FROM r),
p AS (SELECT season_id, type, "pestCount", "primaryPest" FROM f, (SELECT t.*, n."pestCount", n."primaryPest" FROM t LEFT JOIN n ON "trapCode" = code AND k = 1 WHERE latitude IS NOT NULL) x WHERE {METRES.format("center_lon - longitude")} <= 350)
SELECT f.season_id, count(*) FILTER (WHERE p.type = 'ELECTRONIC') AS electronic_traps, count(*) FILTER (WHERE p.type = 'CONVENTIONAL') AS conventional_traps, round(avg(p."pestCount"), 6) AS avg_pest_count, coalesce(string_agg(DISTINCT p."primaryPest", ', ' ORDER BY p."primaryPest") FILTER (WHERE trim(p."primaryPest") <> ''), '') AS primary_pests FROM f LEFT JOIN p USING (season_id) GROUP BY f.season_id""")
def traps_nearby(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(WS.nearby_traps(columns_of(read(spark, sf_dir, "customer"), FIELDS), columns_of(read(spark, sf_dir, "supplier"), TRAPS), readings(spark, sf_dir)))


CENTROIDS = {"c_custkey": "c_custkey", "centroid_lon": "CASE WHEN c_custkey % 50 = 0 THEN NULL ELSE (c_custkey * 37 % 997) * 0.00731 END", "centroid_lat": "0.0"}
STRIPS = {"season_id": "s_suppkey", "min_lon": "s_suppkey * 0.07", "max_lon": "s_suppkey * 0.07 + 0.021", "min_lat": "0.0 - 0.01", "max_lat": "0.01", "center_lon": "s_suppkey * 0.07 + 0.0105", "center_lat": "0.0"}


@query(f"""WITH p AS ({table_of(CENTROIDS, "customer")}), b AS ({table_of(STRIPS, "supplier")}), m AS (SELECT c_custkey, any_value(centroid_lon) AS lon, min(season_id) FILTER (WHERE centroid_lon BETWEEN min_lon AND max_lon) AS inside, arg_min(season_id, {{'d': round(abs(centroid_lon - center_lon), 9), 'k': season_id}}) AS near FROM p, b GROUP BY c_custkey)
SELECT c_custkey, CASE WHEN lon IS NOT NULL THEN coalesce(inside, near) END AS season_id, CASE WHEN lon IS NULL THEN 'missing_geometry' WHEN inside IS NOT NULL THEN 'contains' ELSE 'nearest_bbox' END AS assignment_method FROM m""")
def rows_to_polygons(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = WS.assign_to_polygons(columns_of(read(spark, sf_dir, "customer"), CENTROIDS), columns_of(read(spark, sf_dir, "supplier"), STRIPS), max_boxes=0)
    return out.select("c_custkey", "season_id", "assignment_method")


BOUNDS = {"season_id": "CAST(l_suppkey AS STRING)", "date": "CAST(l_shipdate AS DATE)", "bounds_left": "CASE WHEN l_orderkey % 3 = 0 THEN NULL ELSE CAST(l_suppkey * 1000 AS DOUBLE) END", "bounds_bottom": "CAST(l_suppkey * 500 AS DOUBLE)", "bounds_right": "CAST(l_suppkey * 1000 + 700 AS DOUBLE)", "bounds_top": "CASE WHEN l_orderkey % 4 = 0 THEN NULL ELSE CAST(l_suppkey * 500 + 300 AS DOUBLE) END"}


@query(f"""WITH b AS ({table_of(BOUNDS, "lineitem")}), o AS (SELECT season_id, max(bounds_left) AS l, max(bounds_bottom) AS b, max(bounds_right) AS r, max(bounds_top) AS t FROM b GROUP BY ALL), d AS (
  SELECT season_id, degrees(l / 6378137.0::DOUBLE) AS min_lon, degrees(2 * atan(exp(b / 6378137.0::DOUBLE)) - pi() / 2) AS min_lat, degrees(r / 6378137.0::DOUBLE) AS max_lon, degrees(2 * atan(exp(t / 6378137.0::DOUBLE)) - pi() / 2) AS max_lat, (r - l) * (t - b) / 10000 AS bbox_area_ha FROM o)
SELECT season_id, {six(["min_lon", "min_lat", "max_lon", "max_lat", "bbox_area_ha"], 9)}, round((min_lon + max_lon) / 2, 9) AS center_lon, round((min_lat + max_lat) / 2, 9) AS center_lat FROM d""")
def boxes_of_seasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first known bounds of each field, though its first scene may lack some."""
    return rounded(S.season_boxes(columns_of(read(spark, sf_dir, "lineitem"), BOUNDS)), 9)


ROWS = f"rows_ AS ({table_of(TELEMETRY, 'events')})"


@query(f"""WITH {ROWS} SELECT season_id, round(avg("Yield - kg/ha"), 6) AS yield_mean_kg_ha, round(quantile_cont("Yield - kg/ha", 0.9), 6) AS yield_p90_kg_ha, count(*) AS harvest_points FROM rows_ WHERE contains(upper("Operation"), 'COLHEITA') AND coalesce("Yield - kg/ha", 0) > 0 GROUP BY season_id""")
def harvest_by_season(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(WS.harvest_summary(telemetry(spark, sf_dir)))


@query(f"""WITH {ROWS} SELECT season_id, round(avg("Population - ha"), 6) AS population_mean_ha, round(quantile_cont("Population - ha", 0.9), 6) AS population_p90_ha, count(*) AS planting_points FROM rows_ WHERE contains(upper("Operation"), 'PLANTIO') GROUP BY season_id""")
def planting_by_season(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(WS.planting_summary(telemetry(spark, sf_dir)))


@query(f"""WITH r AS ({table_of(READINGS, "events")}) SELECT date AS event_date, "trapType", round(avg("pestCount"), 6) AS avg_pest_count, count(*) AS observations FROM r WHERE "trapType" IS NOT NULL GROUP BY ALL""")
def pests_by_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(WS.pest_daily(readings(spark, sf_dir).withColumnRenamed("date", "event_date")))


@query(f"""WITH {SCENES}, {ROWS} SELECT (SELECT count(*) FROM scenes) AS ndvi_images, (SELECT count(DISTINCT season_id) FROM scenes) AS ndvi_seasons, (SELECT count(*) FROM part) AS soil_samples, (SELECT count(*) FROM events) AS trap_records, (SELECT count(DISTINCT s_suppkey) FROM supplier) AS unique_traps, (SELECT count(*) FROM orders) AS weather_rows,
  (SELECT count(*) FROM rows_) AS harvest_rows, (SELECT count(*) FROM rows_) AS planting_rows""")
def inventory_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = telemetry(spark, sf_dir)
    traps = columns_of(read(spark, sf_dir, "supplier"), TRAPS)
    return WS.inventory_counts(scenes(spark, sf_dir), read(spark, sf_dir, "part"), traps, read(spark, sf_dir, "events"), read(spark, sf_dir, "orders"), rows, rows)


WORK = {"Operation": "CASE l_linenumber % 3 WHEN 0 THEN 'plantio' WHEN 1 THEN 'Colheita' END", "timestamp": "CASE WHEN l_linenumber % 3 = 0 THEN CAST(l_shipdate AS DATE) ELSE CAST(l_shipdate AS DATE) - INTERVAL 400 DAY END"}


@query(f"""WITH w AS ({table_of(WORK, "lineitem")}), c AS (SELECT min(timestamp) FILTER (WHERE "Operation" = 'plantio') AS a, max(timestamp) FILTER (WHERE "Operation" = 'plantio') AS b, min(timestamp) FILTER (WHERE "Operation" = 'Colheita') AS c, max(timestamp) FILTER (WHERE "Operation" = 'Colheita') AS d FROM w), {SCENES}
SELECT season_id, CAST(a AS DATE) AS planting_start, CAST(b AS DATE) AS planting_end, CAST(c AS DATE) AS harvest_start, CAST(d AS DATE) AS harvest_end, count(*) AS scenes FROM scenes, c WHERE coalesce(b1_valid_pixels, 0) > 0 AND date BETWEEN a AND d GROUP BY ALL""")
def scenes_in_crop_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    work = columns_of(read(spark, sf_dir, "lineitem"), WORK)
    window = WS.crop_window(work, work)
    held = WS.scenes_in_window(scenes(spark, sf_dir), window).groupBy("season_id").agg(F.count(F.lit(1)).alias("scenes"))
    return held.join(F.broadcast(window.select(*[F.to_date(c).alias(c) for c in window.columns])))  # one row


PROOF = {"season_id": "CAST(s_suppkey AS STRING)", "yield_mean_kg_ha": "CASE WHEN s_suppkey % 5 = 0 THEN NULL ELSE s_acctbal END", "ndvi_mean": "s_acctbal / 9999.3", "population_mean_ha": "CASE WHEN s_suppkey % 3 = 0 THEN NULL ELSE CAST(s_suppkey * 1000.3017 AS DOUBLE) END", "avg_pest_count": "CASE WHEN s_suppkey % 2 = 0 THEN NULL ELSE CAST(s_suppkey * 0.3719 AS DOUBLE) END",
         "electronic_traps": "s_suppkey % 3", "conventional_traps": "s_suppkey % 4", "treatment": "CASE s_suppkey % 3 WHEN 0 THEN 'tecnologia_4_0' WHEN 1 THEN 'convencional' END", "area_label": "CONCAT('A', CAST(s_suppkey % 7 AS STRING))"}


@query(f"""WITH {SCENES}, p AS ({table_of(PROOF, "supplier")}), s AS (SELECT season_id, avg(b1_mean) AS ndvi_mean, max(b1_mean) AS ndvi_peak, arg_max(b1_mean, {{'d': date, 'f': filename}}) AS ndvi_last, count(*) AS valid_images FROM scenes GROUP BY season_id), e AS (SELECT p.* EXCLUDE (ndvi_mean), s.* EXCLUDE (season_id) FROM p LEFT JOIN s USING (season_id)),
m AS (SELECT median(yield_mean_kg_ha) AS y, median(ndvi_mean) AS v FROM e), t AS (SELECT e.*, concat_ws(' ', CASE WHEN yield_mean_kg_ha >= y THEN 'Produtividade acima da mediana entre os recortes monitorados.' WHEN yield_mean_kg_ha < y THEN 'Produtividade abaixo da mediana entre os recortes monitorados.' END,
  CASE WHEN ndvi_mean >= v THEN 'O vigor vegetativo médio no período útil ficou acima da referência interna.' WHEN ndvi_mean < v THEN 'O vigor vegetativo médio no período útil ficou abaixo da referência interna.' END,
  CASE WHEN electronic_traps > 0 THEN 'Existe cobertura de armadilhas eletrônicas no entorno imediato (' || electronic_traps || ').' WHEN conventional_traps > 0 THEN 'O monitoramento no entorno detectado é majoritariamente convencional.' END,
  CASE WHEN population_mean_ha IS NOT NULL THEN 'População média de plantio observada: ' || printf('%.0f', population_mean_ha::DOUBLE) || ' plantas/ha.' END, CASE WHEN avg_pest_count IS NOT NULL THEN 'Média recente de contagem de pragas nas armadilhas próximas: ' || printf('%.1f', avg_pest_count::DOUBLE) || '.' END) AS d FROM e, m)
SELECT season_id, round(ndvi_mean, 6) AS ndvi_mean, ndvi_peak, ndvi_last, valid_images, CASE WHEN d = '' THEN 'Ainda não há evidências suficientes para explicar esta área com segurança.' ELSE d END AS diagnostic FROM t""")
def evidence_by_field(spark: SparkSession, sf_dir: str) -> DataFrame:
    proof = columns_of(read(spark, sf_dir, "supplier"), PROOF)
    out = WS.evidence_table(proof.select("season_id", "treatment"), scenes(spark, sf_dir), proof.select("season_id", "yield_mean_kg_ha"), proof.select("season_id", "population_mean_ha"), proof.select("season_id", "avg_pest_count", "electronic_traps", "conventional_traps"))
    return rounded(out.select("season_id", "ndvi_mean", "ndvi_peak", "ndvi_last", "valid_images", "diagnostic"))


@query(f"""WITH p AS ({table_of(PROOF, "supplier")}) SELECT treatment, count(DISTINCT season_id) AS areas, round(avg(yield_mean_kg_ha), 6) AS yield_mean_kg_ha, round(avg(ndvi_mean), 6) AS ndvi_mean, CAST(sum(electronic_traps) AS BIGINT) AS electronic_traps, CAST(sum(conventional_traps) AS BIGINT) AS conventional_traps FROM p WHERE treatment IS NOT NULL GROUP BY treatment""")
def fields_by_treatment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(WS.treatment_summary(columns_of(read(spark, sf_dir, "supplier"), PROOF)))


@query(f"""WITH p AS ({table_of(PROOF, "supplier")}), c AS (SELECT CAST(l_suppkey AS VARCHAR) AS season_id, CASE WHEN l_linenumber = 1 THEN NULL ELSE l_tax * 100 END AS c FROM lineitem), s AS (SELECT season_id, coalesce(sum(c), 0) AS total FROM c GROUP BY season_id)
SELECT season_id, round(total, 4) AS total_cost_per_ha_brl, yield_mean_kg_ha, round(yield_mean_kg_ha / nullif(total, 0), 6) AS kg_per_brl FROM s LEFT JOIN p USING (season_id)""")
def costs_by_season(spark: SparkSession, sf_dir: str) -> DataFrame:
    cost = F.when(F.col("l_linenumber") == 1, "sem custo").otherwise((F.col("l_tax") * 100).cast("string"))
    costs = read(spark, sf_dir, "lineitem").select(F.col("l_suppkey").cast("string").alias("season_id"), cost.alias("cost_per_ha_brl"))
    out = WS.cost_summary(costs, columns_of(read(spark, sf_dir, "supplier"), PROOF))
    return out.select("season_id", F.round("total_cost_per_ha_brl", 4).alias("total_cost_per_ha_brl"), "yield_mean_kg_ha", F.round("kg_per_brl", 6).alias("kg_per_brl"))


@query(f"""WITH {CLEAN}, s AS (SELECT *, (ndvi_mean - avg(ndvi_mean) OVER w) / nullif(stddev_pop(ndvi_mean) OVER w, 0) AS z, median(ndvi_mean) OVER w AS med FROM clean WINDOW w AS (PARTITION BY season_id)), r AS (SELECT *, 0.6745::DOUBLE * (ndvi_mean - med) / nullif(median(abs(ndvi_mean - med)) OVER (PARTITION BY season_id), 0) AS rz FROM s)
SELECT area_label, count(date) AS cenas, count(*) FILTER (WHERE coalesce(abs(z) >= 1.5, false) OR coalesce(abs(rz) >= 1.1, false)) AS outliers, count(*) FILTER (WHERE abs(z) >= 1.5) AS por_zscore, count(*) FILTER (WHERE abs(rz) >= 1.1) AS por_robust_zscore, round(min(z), 6) AS menor_zscore, round(max(z), 6) AS maior_zscore FROM r GROUP BY area_label""")
def outliers_by_area(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(WS.outlier_summary(W.scores(clean(spark, sf_dir), "ndvi_mean", ["season_id"]), 1.5, 1.1))


def _walk_sql(start: str, depth: int, fan_out: int, total: int) -> str:
    """The budgeted walk step by step: new nodes of a step in their order, as many as the budget has left."""
    steps, seen = [f"s0 AS (SELECT '{start}' AS node, 'start' AS direction, 0 AS depth, 0::BIGINT AS place)"], ["s0"]
    for direction, here, there in (("up", "dst", "src"), ("down", "src", "dst")):
        front = "s0"
        for step in range(1, depth + 1):
            name, all_ = f"{direction}{step}", " UNION ALL ".join(f"SELECT node FROM {s}" for s in seen)
            steps.append(f"""{name}_all AS ({all_}), {name}_hit AS (SELECT {there} AS node, f.place AS pos, row_number() OVER (PARTITION BY f.node ORDER BY {there}) AS n FROM {front} f JOIN e ON {here} = f.node),
{name}_new AS (SELECT node, row_number() OVER (ORDER BY min(pos * 1000 + n)) - 1 AS place FROM {name}_hit WHERE n <= {fan_out} AND node NOT IN (SELECT node FROM {name}_all) GROUP BY node),
{name} AS (SELECT node, '{direction}' AS direction, {step} AS depth, place FROM {name}_new WHERE place < {total} - (SELECT count(*) FROM {name}_all))""")
            seen.append(name)
            front = name
    return f"WITH e AS ({EDGES}), " + ", ".join(steps) + " " + " UNION ALL ".join(f"SELECT node, direction, depth, CAST(place AS INTEGER) AS place FROM {s}" for s in seen)


@query(_walk_sql("n7", 3, 4, 5))
def flow_within_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From a nation up to its region and down to its suppliers, five nodes at most."""
    return L.budgeted_flow(edges(spark, sf_dir), "n7", 3, 4, 5)


@query(f"""WITH RECURSIVE e AS ({EDGES}), n AS (SELECT src AS node FROM e UNION SELECT dst FROM e), w AS (SELECT node, 0 AS layer FROM n UNION ALL SELECT dst, layer + 1 FROM w JOIN e ON src = node WHERE layer < 5) SELECT node, CAST(max(layer) AS INTEGER) AS layer FROM w GROUP BY node""")
def layers_of_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    links = edges(spark, sf_dir)
    nodes = links.select(F.explode(F.array("src", "dst")).alias("node"))
    return L.layers(links, nodes).select("node", F.col("layer").cast("int").alias("layer"))


LISTED = {"target": "CONCAT('t', CAST(p_partkey AS STRING))", "name": "CONCAT('c', CAST(p_size AS STRING))", "sources": "CONCAT(' c', CAST(p_size + 1 AS STRING), ' | c', CAST(p_size % 7 AS STRING), '||c', CAST(p_size + 1 AS STRING))", "text": "CONCAT(p_name, ' É ', p_type)"}


@query("SELECT DISTINCT 'c' || unnest([p_size + 1, p_size % 7]) AS src, 't' || p_partkey AS dst FROM part")
def edges_from_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges of pipe-separated lists with blanks, gaps and repeats."""
    return L.edges_of(columns_of(read(spark, sf_dir, "part"), LISTED), "target", "sources")


@query("""WITH p AS (SELECT p_partkey FROM part WHERE p_partkey < 3), t AS (SELECT 'c' || unnest([p_size + 1, p_size % 7]) AS c FROM part WHERE p_partkey < 3) SELECT 't' || p_partkey AS target FROM part WHERE p_partkey < 3 OR 'c' || p_size IN (SELECT c FROM t)""")
def records_of_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = columns_of(read(spark, sf_dir, "part"), LISTED)
    first = records.where("target in ('t0', 't1', 't2')")
    return L.expand_tokens(records, first, "target", "name", "sources").select("target")


@query("""SELECT 't' || p_partkey AS target FROM part WHERE contains(p_name, 'ring') AND contains(lower(p_type), 'economy')""")
def records_with_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.find(columns_of(read(spark, sf_dir, "part"), LISTED), ["RÍNG", "ECONOMY"], ["text"]).select("target")


FILES = {"zone": "CASE WHEN l_orderkey % 3 = 0 THEN 'raw' ELSE 'output' END", "size_bytes": "l_extendedprice * 1000"}


@query(f"""WITH f AS ({table_of(FILES, "lineitem")}), m AS (SELECT zone, size_bytes / 1048576 AS mb FROM f) SELECT round(sum(mb) FILTER (WHERE zone = 'raw'), 3) AS raw_mb, round(max(mb), 6) AS largest_mb, count(*) FILTER (WHERE mb >= 80) AS large_files, CASE WHEN sum(mb) FILTER (WHERE zone = 'raw') >= 250 OR max(mb) >= 80 THEN 'hybrid' ELSE 'local' END AS recommendation FROM m""")
def storage_advice(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.storage_advice(columns_of(read(spark, sf_dir, "lineitem"), FILES)).select(F.round("raw_mb", 3).alias("raw_mb"), F.round("largest_mb", 6).alias("largest_mb"), "large_files", "recommendation")


FEATURES = {"position": "p_partkey", "feature": "CONCAT(REPLACE(p_name, ' ', '_'), CASE p_partkey % 3 WHEN 0 THEN '_week' WHEN 1 THEN '_flag' ELSE '' END)"}
NAMES = {"table": "CASE l_linenumber % 3 WHEN 0 THEN 'event_driver_lift.csv' ELSE 'a.csv' END", "column": """CASE l_partkey % 11 WHEN 0 THEN CONCAT('gap_', REPLACE(l_returnflag, 'A', 'red_ring_week'), '_4_0_minus_convencional') WHEN 1 THEN 'red_ring_rate' WHEN 2 THEN 'delta_pp' WHEN 3 THEN 'big_red_ring_week_x' WHEN 4 THEN 'trajectory_score' WHEN 5 THEN 'small_ring_convencional' WHEN 6 THEN 'problem_weeks'
  WHEN 7 THEN 'nothing' WHEN 8 THEN 'small_widget_mean' WHEN 9 THEN 'red_ring_flag' ELSE CONCAT('x', l_returnflag) END"""}


@query(f"""WITH f AS (SELECT feature, min(position) AS position FROM ({table_of(FEATURES, "part")}) GROUP BY feature), c AS (SELECT DISTINCT "table", "column" FROM ({table_of(NAMES, "lineitem")})), a AS (SELECT *, CASE "column" WHEN 'delta_pp' THEN 'risk_flag_count' WHEN 'trajectory_score' THEN 'risk_flag_count' END AS special FROM c),
s AS (SELECT "table", "column", unnest(["column", replace(replace("column", 'gap_', ''), '_4_0_minus_convencional', ''), replace(replace("column", '_4_0', ''), '_convencional', ''), replace("column", '_mean', ''), replace("column", '_rate', '_flag'), special]) AS stem, unnest([0::BIGINT, 2, 3, 4, 5, 6]) AS rank FROM a),
h AS (SELECT "table", "column", stem AS feature, rank * 1000000000 AS rank FROM s WHERE stem IN (SELECT feature FROM f) UNION ALL SELECT "table", "column", 'risk_flag_count', 1000000000 FROM a WHERE "table" = 'event_driver_lift.csv' AND "column" IN ('driver', 'problem_rate', 'baseline_rate', 'delta_pp', 'lift_ratio', 'evidence_level')
  UNION ALL SELECT "table", "column", feature, 9000000000 + position FROM a JOIN f ON contains("column", feature))
SELECT c."table", c."column", arg_min(feature, rank) AS feature FROM c LEFT JOIN h USING ("table", "column") GROUP BY ALL""")
def features_of_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names inferred in the registry's order: by themselves, by the lift, by replacement, by the special names, by a part."""
    registry = columns_of(read(spark, sf_dir, "part"), FEATURES).groupBy("feature").agg(F.min("position").alias("position"))
    return I.inferred(columns_of(read(spark, sf_dir, "lineitem"), NAMES).distinct(), registry).select("table", "column", "feature")


INDEX = {"layer": "CASE WHEN p_partkey % 3 = 0 THEN 'bruto' ELSE 'csv_final' END", "table": "p_brand", "column": "CONCAT(p_name, CAST(p_size AS STRING))", "mapping_status": "CASE p_partkey % 4 WHEN 0 THEN 'mapeado' WHEN 1 THEN 'mapeado_por_feature' WHEN 2 THEN 'parcial_por_csv_exportado' ELSE 'ausente' END"}
EXPECTED = {"csv": "p_brand", "column_name": "CONCAT(p_name, CAST(p_size AS STRING))"}
COVERED = f"""i AS ({table_of(INDEX, "part")}), x AS (SELECT DISTINCT * FROM ({table_of(EXPECTED, "part")})), f AS (SELECT "table" AS csv, "column" AS column_name, bool_or(mapping_status IN ('mapeado', 'mapeado_por_feature')) AS strong FROM i WHERE layer = 'csv_final' GROUP BY ALL),
coverage AS (SELECT x.csv, count(*) AS columns_total, count(strong) AS columns_with_lineage, count(*) FILTER (WHERE strong) AS strong_or_partial_lineage, count(strong) / count(*) AS coverage_pct, coalesce(string_agg(column_name, ', ' ORDER BY column_name) FILTER (WHERE strong IS NULL), '') AS unmapped_columns FROM x LEFT JOIN f USING (csv, column_name) GROUP BY x.csv)"""


@query(f"WITH {COVERED} SELECT csv, columns_total, columns_with_lineage, strong_or_partial_lineage, round(coverage_pct, 6) AS coverage_pct, unmapped_columns FROM coverage")
def coverage_of_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = read(spark, sf_dir, "part")
    return rounded(I.csv_coverage(columns_of(part, INDEX), columns_of(part, EXPECTED)))


@query(f"""WITH {COVERED}, q AS (SELECT p_size AS affected_rows FROM part WHERE p_partkey < 40), m AS (SELECT (SELECT min(coverage_pct) FROM coverage) AS a, (SELECT avg((mapping_status <> 'ausente')::INT) FROM i WHERE layer = 'csv_final') AS b, (SELECT avg((mapping_status IN ('mapeado', 'mapeado_por_feature'))::INT) FROM i WHERE layer = 'csv_final') AS c, (SELECT avg((s_suppkey % 5 > 0)::INT) FROM supplier) AS d, (SELECT count(*) FROM q) AS e, (SELECT count(*) FROM q WHERE affected_rows > 0) AS f),
g AS (SELECT unnest(['G1_final_csv_coverage', 'G2_final_columns_auditable', 'G3_strong_or_documented_lineage', 'G4_critical_targets', 'G5_quality_rules_visible', 'G6_known_limitations_visible']) AS gate_id, unnest([a, b, c, d, e, 4.0]) AS metric, unnest([CASE WHEN a >= 1 THEN 'ok' ELSE 'falha' END, CASE WHEN b >= 1 THEN 'ok' ELSE 'falha' END, CASE WHEN c >= 0.6 THEN 'ok' ELSE 'aceito_com_limitacao' END, CASE WHEN d >= 1 THEN 'ok' ELSE 'falha' END, CASE WHEN e > 0 THEN 'ok' ELSE 'falha' END, 'aceito_com_limitacao']) AS status, f FROM m)
SELECT gate_id, status, round(CAST(metric AS DOUBLE), 6) AS metric, CASE substr(gate_id, 1, 2) WHEN 'G1' THEN 'Cobertura minima por CSV final: ' || printf('%.0f%%', metric * 100) || '.' WHEN 'G2' THEN 'Colunas finais auditaveis: ' || printf('%.0f%%', metric * 100) || '.' WHEN 'G3' THEN 'Mapeamento forte por feature/driver: ' || printf('%.0f%%', metric * 100) || '.' WHEN 'G4' THEN 'Alvos criticos aprovados: ' || printf('%.0f%%', metric * 100) || '.'
  WHEN 'G5' THEN CAST(metric AS BIGINT) || ' regras de qualidade calculadas; ' || f || ' com linhas afetadas.' ELSE '4 limitacoes estruturais devem aparecer na documentacao e na UI.' END AS evidence FROM g""")
def gates_of_lineage(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = read(spark, sf_dir, "part")
    index = columns_of(part, INDEX)
    critical = read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("target"), F.lit(5).alias("checks"), F.when(F.col("s_suppkey") % 5 > 0, 5).otherwise(4).alias("passed"))
    rules = part.where("p_partkey < 40").select(F.col("p_size").alias("affected_rows"))
    out = I.acceptance_gates(index, I.csv_coverage(index, columns_of(part, EXPECTED)), critical, rules, 4)
    return rounded(out.select("gate_id", "status", "metric", "evidence"))


@query(f"""WITH {CLEAN}, t AS (SELECT season_id, week_start, any_value(treatment) AS treatment, count(*) AS n, avg(ndvi_mean) AS v FROM clean WHERE season_id IN ('1', '2', '3') GROUP BY season_id, week_start), g AS (SELECT *, v < 0.0412345 AS low_flag, n > 2 AS many_flag, CAST(n - 1 AS INTEGER) AS risk_flag_count FROM t),
r AS (SELECT season_id, week_start, least(count(*), 8) AS raw FROM clean GROUP BY ALL)
SELECT g.season_id, g.week_start, 'audit:' || g.season_id || ':' || strftime(g.week_start, '%Y-%m-%d') AS audit_id, concat_ws(',', CASE WHEN low_flag THEN 'low_flag' END, CASE WHEN many_flag THEN 'many_flag' END, CASE WHEN risk_flag_count <> 0 THEN 'risk_flag_count' END) AS flags, CAST(raw AS INTEGER) AS raw_rows, CAST(CASE WHEN many_flag THEN 1 ELSE 0 END AS INTEGER) AS event_rows, CAST(1 AS INTEGER) AS pair_rows FROM g JOIN r USING (season_id, week_start)""")
def audit_of_weeks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three fields' weeks with their flags, events, raw scenes and gap rows."""
    raw = clean(spark, sf_dir).withColumn("week_start", F.to_date("week_start"))
    v = F.col("v")
    weeks = raw.where("season_id in ('1', '2', '3')").groupBy("season_id", "week_start").agg(F.count(F.lit(1)).alias("n"), F.avg("ndvi_mean").alias("v"))
    line = weeks.select("season_id", "week_start", F.col("season_id").alias("comparison_pair"), (v < 0.0412345).alias("low_flag"), (F.col("n") > 2).alias("many_flag"), (F.col("n") - 1).cast("int").alias("risk_flag_count"))
    gaps = line.select("comparison_pair", "week_start", F.lit(0.5).alias("gap"))
    images = raw.select("season_id", "date", F.col("filename").alias("path"))
    out = I.audit_index(line, line.where("many_flag").select("season_id", "week_start", "many_flag"), gaps, raw.select("season_id", "week_start", "filename"), images)
    return out.select("season_id", "week_start", "audit_id", F.array_join("active_flags", ",").alias("flags"), *[F.size(c).alias(c) for c in ("raw_rows", "event_rows", "pair_rows")])


WORDS = {
    "doc": "l_orderkey * 10 + l_linenumber", "file": "CONCAT('ndvi_', l_returnflag, '_', SUBSTR(CAST(CAST(l_shipdate AS DATE) AS STRING), 1, 10), CASE l_linenumber % 3 WHEN 0 THEN '.tiff' WHEN 1 THEN '.jpg' ELSE '.png' END)", "zoned": "CONCAT(CAST(l_quantity AS STRING), ' / GMT -3', l_returnflag)",
    "list": "CONCAT(l_returnflag, ' | ', l_linestatus, ' ||', l_returnflag, '| x')", "path": "CONCAT('/home/', l_returnflag, l_linestatus, '/d.csv')", "yes": "CASE l_linenumber % 5 WHEN 0 THEN 'TRUE' WHEN 1 THEN '1' WHEN 2 THEN 'Sim' WHEN 3 THEN 'x' END", "a": "CASE WHEN l_linenumber = 2 THEN NULL ELSE l_quantity END",
    "b": "CASE WHEN l_linenumber = 3 THEN 0.0 ELSE l_tax END", "when": "CASE l_linenumber % 4 WHEN 0 THEN '2024-03-05 10:11:12' WHEN 1 THEN '05/03/2024 - 10:11' WHEN 2 THEN '1709633472' ELSE '1899-01-01' END",
}


@query(rf"""WITH w AS ({table_of(WORDS, "lineitem")}) SELECT doc, CASE WHEN regexp_matches(file, '_\d{{4}}-\d{{2}}-\d{{2}}\.(tiff|jpg)$') THEN CAST(substr(file, 8, 10) AS DATE) END AS day, replace(file, '.tiff', '.jpg') AS image, regexp_replace(zoned, '\s*/ GMT.*$', '') AS local, array_to_string(list_distinct(list_filter(list_transform(string_split(list, '|'), lambda x: trim(x)), lambda x: x <> '')).list_sort(), ',') AS items,
  '/home/<user>/d.csv' AS hidden, coalesce(lower(yes) IN ('true', '1', 'sim'), false) AS yes, round(a / nullif(b, 0), 6) AS ratio, CASE WHEN a IS NULL THEN 1.0 ELSE greatest(0.0, least(1.0, a / 40)) END AS clipped, CASE substr("when", 1, 4) WHEN '1899' THEN NULL WHEN '05/0' THEN '2024-03-05 10:11:00' ELSE '2024-03-05 10:11:12' END AS at FROM w""")
def helpers_of_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """File dates, image names, zones, lists, redaction, truth, guarded division, clipping, moments."""
    w = columns_of(read(spark, sf_dir, "lineitem"), WORDS)
    return w.select(
        "doc", X.filename_date("file").alias("day"), X.image_name("file").alias("image"), X.strip_zone("zoned").alias("local"), F.array_join(F.sort_array(X.pipe_list("list")), ",").alias("items"), X.redact_paths("path").alias("hidden"), X.truthy("yes").alias("yes"),
        F.round(X.safe_divide(F.col("a"), F.col("b").cast("double")), 6).alias("ratio"), X.clip01(F.col("a") / 40).cast("double").alias("clipped"), F.date_format(K.moment(F.col("when")), "yyyy-MM-dd HH:mm:ss").alias("at"),
    )


@query("""SELECT s_suppkey, s_name FROM (SELECT *, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_acctbal, s_suppkey) AS n FROM supplier) WHERE n = 1""")
def first_supplier_of_nation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return W.first_rows(read(spark, sf_dir, "supplier"), ["s_nationkey"], ["s_acctbal", "s_suppkey"]).select("s_suppkey", "s_name")


@query("""SELECT event_id FROM events WHERE CAST(ts AS DATE) >= DATE '2024-01-10' AND CAST(ts AS DATE) <= DATE '2024-01-12'""")
def rows_in_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = read(spark, sf_dir, "events").withColumn("date", F.to_date("ts"))
    return TR.in_window(events, "date", F.lit("2024-01-10 23:00:00").cast("timestamp"), F.lit("2024-01-12").cast("date")).select("event_id")


@query("""SELECT season, count(*) AS rows, min(event_id) AS least FROM (SELECT CAST(user_id AS VARCHAR) AS season, event_id FROM events WHERE CAST(date_trunc('week', ts) AS DATE) = DATE '2024-01-08' AND user_id = 7) GROUP BY season""")
def rows_of_a_week(spark: SparkSession, sf_dir: str) -> DataFrame:
    weeks = read(spark, sf_dir, "events").select(F.col("user_id").alias("season_id"), "event_id", X.week_start("ts").alias("week_start"))
    some = TR.rows_of_week(weeks, {"season_id": "7"}, "2024-01-08T00:00:00", limit=1_000_000)
    return some.groupBy(F.col("season_id").cast("string").alias("season")).agg(F.count(F.lit(1)).alias("rows"), F.min("event_id").alias("least"))


@query("""SELECT kind || ':' || id AS entity_id, kind, label FROM (SELECT 'field' AS kind, CAST(s_suppkey AS VARCHAR) AS id, s_name AS label FROM supplier UNION ALL SELECT 'pair', CAST(n_nationkey AS VARCHAR), n_name FROM nation)""")
def entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.entity_index({"field": (read(spark, sf_dir, "supplier").unionAll(read(spark, sf_dir, "supplier")), "s_suppkey", "s_name"), "pair": (read(spark, sf_dir, "nation"), "n_nationkey", "n_name")})


#: What the panel lacks of a week's facts.
FACTS = {
    "season_id": "season_id", "comparison_pair": "comparison_pair", "treatment": "treatment", "week_start": "week_start", "ndvi_mean_week": "ndvi_mean_week", "soil_pct_week": "quantity_week % 83", "water_balance_mm_week": "quantity_week - 300", "precipitation_mm_week": "image_count_week * 3",
    "avg_pest_count_week": "quantity_week % 37", "alert_hits_week": "image_count_week % 23 - 21", "damage_hits_week": "0", "fert_dose_gap_abs_mean_kg_ha_week": "quantity_week % 101", "overlap_area_pct_bbox_week": "quantity_week % 53", "stop_duration_h_per_bbox_ha_week": "quantity_week % 29",
    "alarm_events_week": "image_count_week % 19 - 17", "engine_temp_max_c_week": "quantity_week % 97", "engine_idle_share_week": "quantity_week % 11", "fuel_zero_share_week": "(image_count_week % 10) * 0.05", "has_weather_coverage_week": "image_count_week % 3 > 0",
    "area_label": "CASE WHEN season_id % 5 = 0 THEN NULL ELSE CONCAT('Campo ', CAST(season_id AS STRING)) END",
}
QUANTILES = {"soil": ("soil_pct_week", 0.75), "water": ("water_balance_mm_week", 0.25), "pest": ("avg_pest_count_week", 0.75), "fert": ("fert_dose_gap_abs_mean_kg_ha_week", 0.75), "overlap": ("overlap_area_pct_bbox_week", 0.75), "stop": ("stop_duration_h_per_bbox_ha_week", 0.75), "hot": ("engine_temp_max_c_week", 0.9), "idle": ("engine_idle_share_week", 0.75)}
FLAGGED = f"""{PANEL}, facts AS ({table_of(FACTS, "panel")}), lim AS (SELECT {", ".join(f"quantile_cont({c}, {q}) AS {n}" for n, (c, q) in QUANTILES.items())} FROM facts), d AS (
  SELECT *, ndvi_mean_week - lag(ndvi_mean_week) OVER w AS delta, (ndvi_mean_week - min(ndvi_mean_week) OVER s) / nullif(max(ndvi_mean_week) OVER s - min(ndvi_mean_week) OVER s, 0) AS norm, first_value(week_start) OVER (PARTITION BY season_id ORDER BY ndvi_mean_week DESC, week_start) AS peak FROM facts WINDOW w AS (PARTITION BY season_id ORDER BY week_start), s AS (PARTITION BY season_id)
), flags AS (SELECT d.*, date_diff('day', peak, week_start) / 7.0::DOUBLE AS from_peak, coalesce(delta <= -0.08, false) AS major_drop_flag, coalesce(delta <= -0.15, false) AS severe_drop_flag, coalesce(delta >= 0.08, false) AS recovery_flag, coalesce(norm <= 0.35, false) AS low_vigor_flag, soil_pct_week >= soil AS high_soil_flag,
  has_weather_coverage_week AND water_balance_mm_week <= water AS weather_stress_flag, has_weather_coverage_week AND water_balance_mm_week > 0 AND precipitation_mm_week > 20 AS weather_relief_flag, avg_pest_count_week >= pest OR alert_hits_week > 0 AS pest_risk_flag, fert_dose_gap_abs_mean_kg_ha_week >= fert AS fert_risk_flag, overlap_area_pct_bbox_week >= overlap AS overlap_risk_flag,
  stop_duration_h_per_bbox_ha_week >= stop AS stop_risk_flag, false AS telemetry_risk_flag, alarm_events_week > 0 AS alert_risk_flag, engine_temp_max_c_week >= hot OR engine_idle_share_week >= idle OR fuel_zero_share_week >= 0.4 AS engine_risk_flag FROM d, lim
), sums AS (SELECT *, fert_risk_flag OR overlap_risk_flag OR stop_risk_flag OR alert_risk_flag OR engine_risk_flag AS ops_risk_flag, high_soil_flag::INT + weather_stress_flag::INT + pest_risk_flag::INT + fert_risk_flag::INT + overlap_risk_flag::INT + stop_risk_flag::INT + alert_risk_flag::INT + engine_risk_flag::INT AS risk_flag_count FROM flags)"""
ALL_FLAGS = ["major_drop_flag", "severe_drop_flag", "recovery_flag", "low_vigor_flag", "high_soil_flag", "weather_stress_flag", "weather_relief_flag", "pest_risk_flag", "fert_risk_flag", "overlap_risk_flag", "stop_risk_flag", "telemetry_risk_flag", "alert_risk_flag", "engine_risk_flag", "ops_risk_flag"]


def told(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.phase_timeline(columns_of(panel(spark, sf_dir), FACTS))


@query(f"WITH {FLAGGED} SELECT season_id, week_start, {', '.join(ALL_FLAGS)}, risk_flag_count FROM sums")
def flags_of_weeks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All flags of a week, by eight quantiles of the whole panel."""
    return told(spark, sf_dir).select("season_id", "week_start", *ALL_FLAGS, "risk_flag_count")


_HELD = [(3.0, "pest_risk_flag OR {lag}", "pressao_de_pragas"), (2.8, "weather_stress_flag OR {lag}", "estresse_climatico"), (2.2, "high_soil_flag", "solo_exposto"), (2.0, "fert_risk_flag OR {lag}", "falha_de_dose_na_adubacao"), (1.7, "overlap_risk_flag OR {lag}", "sobreposicao_operacional"),
         (1.5, "stop_risk_flag OR {lag}", "paradas_operacionais"), (1.2, "alert_risk_flag OR {lag}", "alertas_de_maquina"), (1.0, "engine_risk_flag OR {lag}", "risco_de_maquina"), (2.3, "phase = 'recuperacao' AND weather_relief_flag", "alivio_climatico"),
         (1.6, "phase = 'recuperacao' AND NOT pest_risk_flag AND NOT high_soil_flag", "ambiente_mais_estavel"), (1.3, "phase = 'recuperacao' AND NOT ops_risk_flag", "operacao_sem_desvio_forte")]
_LAGGED = ("major_drop_flag", "pest_risk_flag", "weather_stress_flag", "fert_risk_flag", "overlap_risk_flag", "stop_risk_flag", "alert_risk_flag", "engine_risk_flag")
STORIES = f"""{FLAGGED}, lags AS (SELECT *, {", ".join(f"coalesce(lag({f}) OVER w, false) AS {f}_lag" for f in _LAGGED)}, max(CASE WHEN treatment = 'tecnologia_4_0' THEN ndvi_mean_week END) OVER p - max(CASE WHEN treatment = 'convencional' THEN ndvi_mean_week END) OVER p AS gap FROM sums WINDOW w AS (PARTITION BY season_id ORDER BY week_start), p AS (PARTITION BY comparison_pair, week_start)),
phased AS (SELECT *, CASE WHEN severe_drop_flag THEN 'queda_forte' WHEN major_drop_flag THEN 'queda' WHEN recovery_flag AND major_drop_flag_lag THEN 'recuperacao' WHEN coalesce(norm, 0) <= 0.35 AND from_peak < 0 THEN 'estabelecimento' WHEN coalesce(norm, 0) >= 0.85 AND abs(coalesce(delta, 0)) <= 0.05 THEN 'pico' WHEN from_peak > 0 AND coalesce(delta, 0) < -0.02 THEN 'senescencia' WHEN coalesce(delta, 0) > 0.05 THEN 'expansao' ELSE 'estavel' END AS phase,
  CASE WHEN treatment = 'convencional' THEN -gap ELSE gap END AS own FROM lags), evented AS (SELECT *, CASE WHEN phase IN ('queda_forte', 'queda', 'recuperacao', 'pico') THEN phase WHEN low_vigor_flag AND risk_flag_count >= 2 THEN 'baixo_vigor' END AS event_type FROM phased),
driven AS (SELECT *, list_sort(list_filter([{", ".join(f"CASE WHEN {c.format(lag=c.split(' ')[0] + '_lag')} THEN {{'w': {-w}::DOUBLE, 'l': '{label}'}} END" for w, c, label in _HELD)}], lambda x: x IS NOT NULL)) AS held FROM evented)"""


@query(f"""WITH {STORIES}, t AS (SELECT *, coalesce(nullif(array_to_string(list_transform(held[1:3], lambda x: x.l), ' | '), ''), 'Sem driver forte observado no pacote atual.') AS drivers_summary, CASE WHEN own IS NULL THEN 'sem_par_no_periodo' WHEN abs(own) < 0.03 THEN 'equilibrado' WHEN own > 0 THEN 'acima_do_par' ELSE 'abaixo_do_par' END AS pair_position FROM driven)
SELECT season_id, week_start, phase, event_type, pair_position, coalesce(held[1].l, 'sem_driver_forte') AS primary_driver, drivers_summary, strftime(week_start, '%Y-%m-%d') || ': ' || coalesce(area_label, 'None') || ' ficou em fase ' || phase || ', evento ' || coalesce(event_type, 'sem_evento') || ', NDVI ' AS story FROM t WHERE event_type IS NOT NULL""")
def stories_of_weeks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weeks with an event: phase, place in the pair, heaviest drivers and the sentence up to its numbers."""
    weeks = told(spark, sf_dir)
    sides = weeks.groupBy("comparison_pair", "week_start").agg(*[F.max(F.when(F.col("treatment") == s, F.col("ndvi_mean_week"))).alias(n) for n, s in (("__a", "tecnologia_4_0"), ("__b", "convencional"))])
    gap = F.col("__a") - F.col("__b")
    line = weeks.join(sides, ["comparison_pair", "week_start"]).withColumn("pair_position", T.pair_position(F.when(F.col("treatment") == "convencional", -gap).otherwise(gap)))
    out = NA.events(NA.with_story(line))
    return out.select("season_id", "week_start", "phase", "event_type", "pair_position", "primary_driver", "drivers_summary", F.regexp_replace("story_sentence", "(, NDVI ).*$", "$1").alias("story"))


EFFECT = {
    "comparison_pair": "CONCAT('p', CAST(c_custkey AS STRING))", "metric_label": "CASE k WHEN 0 THEN 'NDVI medio semanal' WHEN 1 THEN 'Semanas de baixo vigor' ELSE 'Semanas de queda relevante' END", "advantage_4_0": "c_acctbal / (997.3 + k)", "ci_low": "c_acctbal / (1003.7 + k)", "ci_high": "c_acctbal / (881.9 + k)",
    "p_value": "CASE WHEN c_custkey % 9 = 0 THEN NULL ELSE abs(c_acctbal) / 100003.7 END", "winner": "CASE (c_custkey + k * (1 + c_custkey % 2)) % 4 WHEN 0 THEN 'favorece_4_0' WHEN 1 THEN 'favorece_convencional' ELSE 'inconclusivo' END", "evidence_level": "CASE c_custkey % 3 WHEN 0 THEN 'alta' WHEN 1 THEN 'media' ELSE 'baixa' END",
}
LIFT = {"comparison_pair": "CONCAT('p', CAST(c_custkey AS STRING))", "driver": "CASE k WHEN 0 THEN 'solo_exposto' WHEN 1 THEN 'tempo_parado' ELSE 'risco_de_motor' END", "delta_pp": "CASE WHEN c_custkey % 7 = k THEN NULL ELSE c_acctbal / (97.3 + k) END", "lift_ratio": "CASE WHEN c_custkey % 5 = 0 THEN NULL ELSE c_acctbal / 3001.9 END", "evidence_level": "CASE (c_custkey + k) % 3 WHEN 0 THEN 'alta' WHEN 1 THEN 'media' ELSE 'baixa' END"}
AHEAD = {"comparison_pair": "CONCAT('p', CAST(c_custkey AS STRING))", "treatment": "CASE WHEN k = 0 AND c_custkey % 6 > 0 THEN 'tecnologia_4_0' ELSE 'convencional' END", "trajectory_score": "abs(c_acctbal) / (101.3 + k)", "outlook_band": "CASE c_custkey % 2 WHEN 0 THEN 'misto' ELSE 'atencao' END",
         "expected_vs_pair": "CASE c_custkey % 4 WHEN 0 THEN 'tende_a_chegar_acima_do_par' WHEN 1 THEN 'tende_a_chegar_abaixo_do_par' WHEN 2 THEN 'sem_vantagem_clara_no_par' ELSE 'sem_referencia_no_par' END", "top_risks": "CASE c_custkey % 3 WHEN 0 THEN 'risco_operacional' ELSE 'estresse_climatico | telemetria_instavel' END"}
DIAGNOSED = {"pair": "CONCAT('p', CAST(c_custkey AS STRING))", "trajectory_winner": "CASE c_custkey % 3 WHEN 0 THEN '4.0' WHEN 1 THEN 'convencional' ELSE 'sem vantagem clara' END", "known_gaps": "c_mktsegment"}
_THREE = "customer, (VALUES (0), (1), (2)) AS n(k)"


def _in_threes(spark: SparkSession, sf_dir: str, columns: dict[str, str]) -> DataFrame:
    return columns_of(read(spark, sf_dir, "customer").withColumn("k", F.explode(F.array(*map(F.lit, range(3))))), columns)


def _three(c: str) -> str:
    return f"coalesce(printf('%.3f', {c}), 'NA')"


_BASIS = "CASE WHEN {m}.metric_label IS NULL THEN 'Sem base suficiente.' ELSE {m}.metric_label || ': vantagem_4_0=' || " + _three("{m}.advantage_4_0") + " || ', IC95% [' || " + _three("{m}.ci_low") + " || ', ' || " + _three("{m}.ci_high") + " || '], p=' || " + _three("{m}.p_value") + " || ', evidencia=' || {m}.evidence_level || '.' END"
_STATE = "CASE {m}.winner WHEN 'favorece_4_0' THEN 'suportada' WHEN 'favorece_convencional' THEN 'nao_suportada' ELSE 'inconclusiva' END"
PROVEN = f"""e AS ({table_of(EFFECT, _THREE)}), l AS (SELECT *, row_number() OVER (PARTITION BY comparison_pair ORDER BY delta_pp DESC NULLS LAST, driver) AS n FROM ({table_of(LIFT, _THREE)})), o AS (SELECT * FROM ({table_of(AHEAD, _THREE)}) WHERE treatment = 'tecnologia_4_0'), g AS ({table_of(DIAGNOSED, "customer")}),
w AS (SELECT g.pair AS comparison_pair, g.known_gaps, g.trajectory_winner, {", ".join(f"{_STATE.format(m=m)} AS {m}_state, {_BASIS.format(m=m)} AS {m}_basis" for m in ("vigor", "low", "fall"))}, vigor.winner AS vigor_winner, vigor.advantage_4_0 AS vigor_value, l.driver, l.delta_pp, l.lift_ratio, l.evidence_level, o.trajectory_score, o.outlook_band, o.expected_vs_pair, o.top_risks
  FROM g JOIN e vigor ON vigor.comparison_pair = pair AND vigor.metric_label = 'NDVI medio semanal' JOIN e low ON low.comparison_pair = pair AND low.metric_label = 'Semanas de baixo vigor' JOIN e fall ON fall.comparison_pair = pair AND fall.metric_label = 'Semanas de queda relevante' JOIN l ON l.comparison_pair = pair AND n = 1 LEFT JOIN o ON o.comparison_pair = pair),
h AS (SELECT comparison_pair, known_gaps AS known_limits, unnest(['H1', 'H2', 'H3', 'H4']) AS hypothesis_id, unnest(['4.0 sustenta maior nivel temporal de NDVI no par.', '4.0 reduz semanas de problema no NDVI.', 'As semanas problema do NDVI apresentam drivers identificaveis no pacote atual.', 'O outlook pre-colheita favorece o 4.0 dentro do par.']) AS hypothesis,
  unnest([vigor_state, CASE WHEN 'suportada' IN (low_state, fall_state) AND 'nao_suportada' IN (low_state, fall_state) THEN 'parcialmente_suportada' WHEN 'suportada' IN (low_state, fall_state) THEN 'suportada' WHEN 'nao_suportada' IN (low_state, fall_state) THEN 'nao_suportada' ELSE 'inconclusiva' END,
    CASE WHEN evidence_level IN ('alta', 'media') AND delta_pp > 0 THEN 'suportada' ELSE 'inconclusiva' END, CASE expected_vs_pair WHEN 'tende_a_chegar_acima_do_par' THEN 'suportada' WHEN 'tende_a_chegar_abaixo_do_par' THEN 'nao_suportada' ELSE 'inconclusiva' END]) AS status,
  unnest([vigor_basis, low_basis || ' | ' || fall_basis, 'Driver dominante: ' || driver || ' com delta=' || {_three("delta_pp")} || ' pp, lift=' || {_three("lift_ratio")} || ', evidencia=' || evidence_level || '.',
    CASE WHEN expected_vs_pair IS NULL THEN 'Sem outlook 4.0 disponivel.' ELSE 'Outlook 4.0: score=' || {_three("trajectory_score")} || ', faixa=' || outlook_band || ', esperado=' || expected_vs_pair || ', riscos=' || top_risks || '.' END]) AS proof_basis FROM w)"""


def proven(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    three = [_in_threes(spark, sf_dir, c) for c in (EFFECT, LIFT, AHEAD)]
    return three[0], three[1], three[2], columns_of(read(spark, sf_dir, "customer"), DIAGNOSED)


@query(f"WITH {PROVEN} SELECT * FROM h")
def register_of_hypotheses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four hypotheses a pair with status and basis; pairs are customers, their effects and lifts derived from balances."""
    return NA.register(*proven(spark, sf_dir))


@query(f"""WITH {PROVEN}, c AS (SELECT comparison_pair, count(*) FILTER (WHERE status = 'suportada') AS supported_hypotheses, count(*) FILTER (WHERE status = 'nao_suportada') AS not_supported_hypotheses FROM h GROUP BY ALL)
SELECT comparison_pair, trajectory_winner AS temporal_winner, vigor_winner AS ndvi_effect_direction, round(vigor_value, 6) AS ndvi_effect_value, driver AS top_problem_driver, supported_hypotheses, not_supported_hypotheses, expected_vs_pair AS expected_vs_pair_4_0,
  'No par ' || comparison_pair || ', ' || CASE vigor_winner WHEN 'favorece_convencional' THEN 'o convencional segue a referencia temporal de NDVI' WHEN 'favorece_4_0' THEN 'o 4.0 sustenta vantagem temporal de NDVI' ELSE 'o NDVI ainda nao fecha vencedor estatistico' END || '; o principal bloco de risco associado e ' || driver || '; o outlook 4.0 atual e ' || coalesce(expected_vs_pair, '<NA>') || '.' AS decision_message,
  CASE expected_vs_pair WHEN 'tende_a_chegar_abaixo_do_par' THEN 'Priorizar plano corretivo em ' || driver || ' e reavaliar a aderencia operacional do 4.0 no par ' || comparison_pair || '.' WHEN 'tende_a_chegar_acima_do_par' THEN 'Preservar a consistencia operacional e monitorar ' || driver || ' para confirmar a vantagem pre-colheita no par ' || comparison_pair || '.' ELSE 'Coletar mais cobertura e revisar ' || driver || ' antes de fechar conclusao executiva no par ' || comparison_pair || '.' END AS next_step FROM w JOIN c USING (comparison_pair)""")
def decisions_of_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    effects, lift, ahead, diagnosed = proven(spark, sf_dir)
    return rounded(NA.decisions(effects, lift, ahead, diagnosed, NA.register(effects, lift, ahead, diagnosed)))
