"""Queries over the driver's tables that run the library's operators, and the same in SQL.

The tables stand in for the field-trial data: a nation is a field, its region the
pair, the region's first and second nation the treated and the control side,
the mean discount the vegetation index; events are daily facts of users.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from furrow.functions import exprs as X
from furrow.functions import wkt as WKT
from furrow.operators import daily as D
from furrow.operators import evidence as EV
from furrow.operators import lineage as L
from furrow.operators import nearest as N
from furrow.operators import pairs as P
from furrow.operators import profile as PR
from furrow.operators import quality as Q
from furrow.operators import ridge as R
from furrow.operators import spatial as S
from furrow.operators import timeline as T
from furrow.operators import trial as TR
from furrow.operators import weekly as WK
from furrow.operators import windows as W

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
SIDES = ("tecnologia_4_0", "convencional")


def query(sql: str | None = None):
    def add(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.select(*[F.round(c, digits).alias(c) if kind == "double" else F.col(c) for c, kind in df.dtypes])


def panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The weekly panel: season_id, comparison_pair, treatment, week_start, ndvi_mean_week, soil_pct_week, image_count_week."""
    lines = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_shipdate", "l_discount", "l_tax", "l_quantity")
    orders = read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    customers = read(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    weeks = (
        lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).join(customers, F.col("o_custkey") == F.col("c_custkey"))
        .groupBy("c_nationkey", X.week_start("l_shipdate").cast("date").alias("week_start"))
        .agg(F.avg("l_discount").alias("ndvi_mean_week"), F.avg("l_tax").alias("soil_pct_week"), F.sum("l_quantity").alias("quantity_week"), F.count(F.lit(1)).alias("image_count_week"))
    )
    nations = read(spark, sf_dir, "nation")
    place = F.row_number().over(W.over(["n_regionkey"], "n_nationkey"))
    side = nations.withColumn("__n", place).withColumn("treatment", F.when(F.col("__n") == 1, SIDES[0]).when(F.col("__n") == 2, SIDES[1]).otherwise("outro"))
    return weeks.join(side, F.col("c_nationkey") == F.col("n_nationkey")).select(
        F.col("n_nationkey").alias("season_id"), F.concat(F.lit("par_"), F.col("n_regionkey").cast("string")).alias("comparison_pair"), "treatment", "week_start", "ndvi_mean_week", "soil_pct_week", "quantity_week", "image_count_week"
    )


PANEL = """
panel AS (
  SELECT n.n_nationkey AS season_id, 'par_' || n.n_regionkey AS comparison_pair,
    CASE row_number() OVER (PARTITION BY n.n_regionkey, w.week_start ORDER BY n.n_nationkey) WHEN -1 THEN '' ELSE s.treatment END AS treatment,
    w.week_start, w.ndvi_mean_week, w.soil_pct_week, w.quantity_week, w.image_count_week
  FROM (
    SELECT c_nationkey, CAST(date_trunc('week', l_shipdate) AS DATE) AS week_start, avg(l_discount) AS ndvi_mean_week, avg(l_tax) AS soil_pct_week, sum(l_quantity) AS quantity_week, count(*) AS image_count_week
    FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey GROUP BY ALL
  ) w
  JOIN nation n ON n.n_nationkey = w.c_nationkey
  JOIN (SELECT n_nationkey, CASE row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) WHEN 1 THEN 'tecnologia_4_0' WHEN 2 THEN 'convencional' ELSE 'outro' END AS treatment FROM nation) s ON s.n_nationkey = n.n_nationkey
)
"""


@query(f"""WITH {PANEL}, p AS (
  SELECT comparison_pair, week_start, max(ndvi_mean_week) FILTER (WHERE treatment = 'tecnologia_4_0') AS a, max(ndvi_mean_week) FILTER (WHERE treatment = 'convencional') AS b FROM panel GROUP BY ALL
) SELECT comparison_pair, count(*) AS weeks, count(a - b) AS paired_weeks, round(avg(a - b), 6) AS mean_gap, round(avg(a - b) / stddev_samp(a - b), 6) AS effect_size FROM p GROUP BY comparison_pair""")
def weekly_pair_gap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per pair the mean weekly gap of treated and control: one join chain, one weekly rollup, one pivot by aggregation."""
    wide = WK.pair_panel(panel(spark, sf_dir), ["ndvi_mean_week"])
    gap = F.col("gap_ndvi_mean_week_4_0_minus_convencional")
    return rounded(wide.groupBy("comparison_pair").agg(F.count(F.lit(1)).alias("weeks"), F.count(gap).alias("paired_weeks"), F.avg(gap).alias("mean_gap"), F.try_divide(F.avg(gap), F.stddev_samp(gap)).alias("effect_size")))


@query(f"""WITH {PANEL} SELECT season_id, comparison_pair, treatment, week_start, round(max(CASE WHEN treatment = 'tecnologia_4_0' THEN ndvi_mean_week END) OVER w - max(CASE WHEN treatment = 'convencional' THEN ndvi_mean_week END) OVER w, 6) AS pair_gap
FROM panel WINDOW w AS (PARTITION BY comparison_pair, week_start)""")
def pair_gap_on_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(WK.pair_gap(panel(spark, sf_dir), "ndvi_mean_week", name="pair_gap").select("season_id", "comparison_pair", "treatment", "week_start", "pair_gap"))


@query(f"""WITH {PANEL}, p AS (
  SELECT comparison_pair, week_start, max(ndvi_mean_week) FILTER (WHERE treatment = 'tecnologia_4_0') AS a, max(ndvi_mean_week) FILTER (WHERE treatment = 'convencional') AS b,
    max(soil_pct_week) FILTER (WHERE treatment = 'tecnologia_4_0') AS c, max(soil_pct_week) FILTER (WHERE treatment = 'convencional') AS d FROM panel GROUP BY ALL
) SELECT comparison_pair, week_start, round(a, 6) AS ndvi_4_0, round(b, 6) AS ndvi_convencional, round(a - b, 6) AS ndvi_gap, round(c - d, 6) AS soil_gap, a IS NOT NULL AND b IS NOT NULL AS paired_week_flag FROM p""")
def pair_weekly_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    wide = WK.pair_panel(panel(spark, sf_dir), ["ndvi_mean_week", "soil_pct_week"])
    return rounded(wide.select("comparison_pair", "week_start", F.col("ndvi_mean_week_4_0").alias("ndvi_4_0"), F.col("ndvi_mean_week_convencional").alias("ndvi_convencional"), F.col("gap_ndvi_mean_week_4_0_minus_convencional").alias("ndvi_gap"), F.col("gap_soil_pct_week_4_0_minus_convencional").alias("soil_gap"), "paired_week_flag"))


@query(f"""WITH {PANEL}, v AS (
  SELECT comparison_pair, week_start, metric, max(value) FILTER (WHERE treatment = 'tecnologia_4_0') AS tech, max(value) FILTER (WHERE treatment = 'convencional') AS conv
  FROM (SELECT comparison_pair, week_start, treatment, unnest(['ndvi_mean_week', 'soil_pct_week']) AS metric, unnest([ndvi_mean_week, soil_pct_week]) AS value FROM panel) GROUP BY ALL
) SELECT comparison_pair, metric, count(*) AS n_pairs, round(avg(tech), 6) AS mean_4_0, round(avg(conv), 6) AS mean_convencional, round(avg(tech - conv), 6) AS mean_gap, round(avg(tech - conv) / stddev_samp(tech - conv), 6) AS effect_size,
  round(avg(tech - conv) * sqrt(count(*)) / stddev_samp(tech - conv), 6) AS mean_zscore FROM v WHERE tech IS NOT NULL AND conv IS NOT NULL GROUP BY ALL""")
def paired_effect_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(P.effect_summary(P.paired_values(panel(spark, sf_dir), ["ndvi_mean_week", "soil_pct_week"]), ["comparison_pair", "metric"]))


@query()
def pair_effects_resampled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seeded bootstrap and sign-flip draws have no SQL form."""
    return P.pair_effects(panel(spark, sf_dir), {"ndvi_mean_week": (0.0005, True), "soil_pct_week": (0.0005, False)})


@query()
def pair_classic_tests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shapiro, t and Wilcoxon tails have no SQL form."""
    return P.classic_tests(panel(spark, sf_dir), {"ndvi_mean_week": (0.0005, True), "soil_pct_week": (0.0005, False)})


#: Season 0's weeks again as seasons of one week, of two, of one value and of a steep fall, for the ends of rules.
EDGES_OF_WEEKS = """edged AS (
  SELECT season_id, comparison_pair, week_start, ndvi_mean_week FROM panel UNION ALL
  SELECT s, comparison_pair, week_start, CASE s WHEN 1002 THEN 0.05 WHEN 1003 THEN -0.01 * k + ndvi_mean_week ELSE ndvi_mean_week END FROM (SELECT *, row_number() OVER (ORDER BY week_start) AS k FROM panel WHERE season_id = 0), (VALUES (1000, 1), (1001, 2), (1002, 1000000), (1003, 1000000)) AS e(s, most) WHERE k <= most)"""


def edged(weeks: DataFrame) -> DataFrame:
    k = F.row_number().over(W.over([], "week_start"))  # the weeks of one season
    cases = F.array(*[F.struct(F.lit(s).alias("s"), F.lit(most).alias("most")) for s, most in ((1000, 1), (1001, 2), (1002, 1_000_000), (1003, 1_000_000))])
    more = weeks.where("season_id = 0").withColumn("k", k).withColumn("e", F.explode(cases)).where("k <= e.most")
    value = F.when(F.col("e.s") == 1002, 0.05).when(F.col("e.s") == 1003, -0.01 * F.col("k") + F.col("ndvi_mean_week")).otherwise(F.col("ndvi_mean_week"))
    columns = ["season_id", "comparison_pair", "week_start", "ndvi_mean_week"]
    return weeks.select(*columns).union(more.select(F.col("e.s").cast(weeks.schema["season_id"].dataType), "comparison_pair", "week_start", value))


@query(f"""WITH {PANEL}, {EDGES_OF_WEEKS}, x AS (SELECT *, CAST(row_number() OVER (PARTITION BY season_id ORDER BY week_start) - 1 AS DOUBLE) AS x FROM edged), g AS (
  SELECT season_id, count(*) AS n, CASE WHEN count(*) > 1 THEN regr_slope(ndvi_mean_week, x) END AS slope, CASE WHEN count(*) > 1 THEN regr_intercept(ndvi_mean_week, x) END AS intercept, CASE WHEN count(*) > 1 THEN CASE WHEN min(ndvi_mean_week) < max(ndvi_mean_week) THEN corr(ndvi_mean_week, x) ELSE 0 END END AS r, var_pop(ndvi_mean_week) / nullif(var_pop(x), 0) AS ratio FROM x GROUP BY season_id
), t AS ( -- beyond the two-sided 5 percent point of Student's t, by its expansion about 1.959964
  SELECT *, CASE n WHEN 1 THEN NULL WHEN 2 THEN r <> 0 ELSE abs(r) >= 1 OR abs(r) * sqrt((n - 2) / (1 - r * r)) >= 1.959964 + 2.372271 / (n - 2) + 2.822501 / (n - 2) ^ 2 + 2.555852 / (n - 2) ^ 3 END AS sure FROM g
) SELECT season_id, n, round(slope, 8) AS slope, round(intercept, 6) AS intercept, round(r, 6) AS r, round(r * r, 6) AS r2, round(CASE n WHEN 1 THEN NULL WHEN 2 THEN 0 ELSE sqrt(greatest(0, 1 - r * r) * ratio / (n - 2)) END, 8) AS stderr,
  CASE WHEN slope IS NULL THEN 'sem_tendencia_estimada' WHEN sure AND slope > 0 THEN 'crescimento_significativo' WHEN sure AND slope < 0 THEN 'queda_significativa' WHEN slope > 0 THEN 'leve_crescimento_sem_significancia' WHEN slope < 0 THEN 'leve_queda_sem_significancia' ELSE 'estavel' END AS direction FROM t""")
def weekly_trends(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = P.trends(edged(panel(spark, sf_dir)), "ndvi_mean_week", ["season_id"])
    return out.select("season_id", "n", *[F.round(c, 8).alias(c) for c in ("slope", "stderr")], *[F.round(c, 6).alias(c) for c in ("intercept", "r", "r2")], "direction")


@query(f"""WITH {PANEL}, l AS (
  SELECT s AS scope, f AS feature, ndvi_mean_week AS y, x FROM (
    SELECT ndvi_mean_week, comparison_pair, unnest(['soil_pct_week', 'quantity_week', 'image_count_week', 'constante']) AS f, unnest([soil_pct_week, quantity_week, CAST(image_count_week AS DOUBLE), 1.5::DOUBLE]) AS x FROM panel), unnest(['geral', comparison_pair]) AS u(s)
), r AS (SELECT *, rank() OVER (PARTITION BY scope, feature ORDER BY x) + (count(*) OVER (PARTITION BY scope, feature, x) - 1) / 2.0::DOUBLE AS rx, rank() OVER (PARTITION BY scope, feature ORDER BY y) + (count(*) OVER (PARTITION BY scope, feature, y) - 1) / 2.0::DOUBLE AS ry FROM l)
, c AS (SELECT scope, feature, count(*) AS n, CASE WHEN min(x) < max(x) AND min(y) < max(y) THEN corr(x, y) END AS p, CASE WHEN min(x) < max(x) AND min(y) < max(y) THEN corr(rx, ry) END AS s FROM r GROUP BY ALL HAVING count(*) >= 5),
b AS (SELECT *, CASE WHEN abs(s) > abs(p) THEN s ELSE p END AS best FROM c)
SELECT scope, feature, n, round(p, 6) AS pearson, round(s, 6) AS spearman, CASE WHEN best IS NULL THEN 'sem_relacao' WHEN best > 0 THEN 'positiva' WHEN best < 0 THEN 'negativa' ELSE 'nula' END AS direction,
  CASE WHEN best IS NULL THEN 'sem_relacao' WHEN abs(best) >= 0.7 THEN 'forte' WHEN abs(best) >= 0.4 THEN 'moderada' WHEN abs(best) >= 0.2 THEN 'fraca' ELSE 'muito_fraca' END AS strength FROM b""")
def weekly_correlations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One feature is constant: its coefficients are unknown, its row stays."""
    weeks = panel(spark, sf_dir).withColumn("constante", F.lit(1.5))
    out = P.correlations(weeks, ["ndvi_mean_week"], ["soil_pct_week", "quantity_week", "image_count_week", "constante", "ndvi_mean_week"], "comparison_pair")
    return rounded(out.select("scope", "feature", "n", "pearson", "spearman", "direction", "strength"))


@query(f"""WITH {PANEL}, d AS (
  SELECT *, ndvi_mean_week - lag(ndvi_mean_week) OVER w AS delta, (ndvi_mean_week - min(ndvi_mean_week) OVER s) / nullif(max(ndvi_mean_week) OVER s - min(ndvi_mean_week) OVER s, 0) AS norm,
    first_value(week_start) OVER (PARTITION BY season_id ORDER BY ndvi_mean_week DESC, week_start) AS peak
  FROM panel WINDOW w AS (PARTITION BY season_id ORDER BY week_start), s AS (PARTITION BY season_id)
), t AS (SELECT quantile_cont(soil_pct_week, 0.75) AS soil FROM d), f AS (
  SELECT d.*, coalesce(delta <= -0.08, false) AS major, coalesce(delta <= -0.15, false) AS severe, coalesce(delta >= 0.08, false) AS recovery, coalesce(norm <= 0.35, false) AS low_vigor, coalesce(soil_pct_week >= soil, false) AS soil_flag,
    date_diff('day', peak, week_start) / 7.0::DOUBLE AS from_peak FROM d, t
), g AS (SELECT *, coalesce(lag(major) OVER (PARTITION BY season_id ORDER BY week_start), false) AS major_lag FROM f), h AS (
  SELECT *, CASE WHEN severe THEN 'queda_forte' WHEN major THEN 'queda' WHEN recovery AND major_lag THEN 'recuperacao' WHEN coalesce(norm, 0) <= 0.35 AND from_peak < 0 THEN 'estabelecimento'
    WHEN coalesce(norm, 0) >= 0.85 AND abs(coalesce(delta, 0)) <= 0.05 THEN 'pico' WHEN from_peak > 0 AND coalesce(delta, 0) < -0.02 THEN 'senescencia' WHEN coalesce(delta, 0) > 0.05 THEN 'expansao' ELSE 'estavel' END AS phase FROM g
) SELECT season_id, week_start, round(delta, 6) AS delta, round(norm, 6) AS norm, round(from_peak, 6) AS weeks_from_peak, low_vigor AS low_vigor_flag, soil_flag AS high_soil_flag, phase,
  CASE WHEN phase IN ('queda_forte', 'queda', 'recuperacao', 'pico') THEN phase END AS event_type, -- weights: solo_exposto 2.2, and in recovery without soil or operations at risk ambiente_mais_estavel 1.6, operacao_sem_desvio_forte 1.3
  CASE WHEN soil_flag THEN 'solo_exposto' WHEN phase = 'recuperacao' THEN 'ambiente_mais_estavel' ELSE 'sem_driver_forte' END AS primary_driver, CASE WHEN phase = 'recuperacao' THEN 'operacao_sem_desvio_forte' END AS secondary_driver FROM h""")
def phase_timeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = T.phase_timeline(panel(spark, sf_dir))
    return rounded(t.select("season_id", "week_start", F.col("ndvi_delta_week").alias("delta"), F.col("ndvi_norm_week").alias("norm"), "weeks_from_peak", "low_vigor_flag", "high_soil_flag", "phase", "event_type", "primary_driver", "secondary_driver"))


@query(f"""WITH {PANEL}, s AS (
  SELECT *, (ndvi_mean_week - avg(ndvi_mean_week) OVER w) / nullif(stddev_pop(ndvi_mean_week) OVER w, 0) AS z, median(ndvi_mean_week) OVER w AS med FROM panel WINDOW w AS (PARTITION BY season_id)
), r AS (SELECT *, 0.6745 * (ndvi_mean_week - med) / nullif(median(abs(ndvi_mean_week - med)) OVER (PARTITION BY season_id), 0) AS rz FROM s)
SELECT season_id, week_start, round(z, 6) AS z_score, round(rz, 6) AS robust_z_score, CASE WHEN z < 0 THEN 'ndvi_mean_week_abaixo_do_padrao' ELSE 'ndvi_mean_week_acima_do_padrao' END AS direction FROM r WHERE coalesce(abs(z) >= 2.0, false) OR coalesce(abs(rz) >= 3.5, false)""")
def weekly_outliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(W.outliers(panel(spark, sf_dir), "ndvi_mean_week", ["season_id"]).select("season_id", "week_start", "z_score", "robust_z_score", "direction"))


@query(f"""WITH {PANEL}, k AS (SELECT *, row_number() OVER (PARTITION BY season_id ORDER BY week_start DESC) AS rn FROM panel) SELECT season_id, round(avg(ndvi_mean_week), 6) AS last4_mean FROM k WHERE rn <= 4 GROUP BY season_id""")
def last_four_weeks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(W.tail_mean(panel(spark, sf_dir), "ndvi_mean_week", ["season_id"], ["week_start"], 4, "last4_mean"))


def transitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return W.lead_delta(panel(spark, sf_dir), "ndvi_mean_week", ["season_id"], ["week_start"], "target")


@query(f"""WITH {PANEL}, n AS (SELECT *, lead(ndvi_mean_week) OVER (PARTITION BY season_id ORDER BY week_start) - ndvi_mean_week AS target FROM panel) SELECT season_id, week_start, round(target, 6) AS target FROM n WHERE target IS NOT NULL""")
def next_week_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(transitions(spark, sf_dir).select("season_id", "week_start", "target"))


@query()
def transition_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ridge with leave-one-season-out validation on a category too: more normal equations than SQL can solve; see transition_predictions."""
    model = R.fit(transitions(spark, sf_dir), ["ndvi_mean_week", "soil_pct_week", "quantity_week"], [], ["treatment"], "target")
    return model.summary


#: Normal equations of two standardised numbers and an intercept, over all rows (fold -1) and without each season, by Cramer's rule.
TWO_FEATURES = f"""WITH {PANEL}, n AS (SELECT *, lead(ndvi_mean_week) OVER (PARTITION BY season_id ORDER BY week_start) - ndvi_mean_week AS y FROM panel), m AS (
  SELECT avg(soil_pct_week) AS ma, stddev_pop(soil_pct_week) AS sa, avg(quantity_week) AS mb, stddev_pop(quantity_week) AS sb FROM n WHERE y IS NOT NULL
), d AS (SELECT season_id, week_start, y, (soil_pct_week - ma) / sa AS a, (quantity_week - mb) / sb AS b, ma, sa, mb, sb FROM n, m WHERE y IS NOT NULL),
f AS (SELECT -1 AS fold UNION ALL SELECT DISTINCT season_id FROM d), g AS (
  SELECT fold, count(*) AS k, sum(a) AS ka, sum(b) AS kb, sum(a * a) + 1 AS aa, sum(a * b) AS ab, sum(b * b) + 1 AS bb, sum(y) AS ky, sum(a * y) AS ay, sum(b * y) AS yb FROM f JOIN d ON season_id <> fold GROUP BY fold
), e AS (SELECT *, k * (aa * bb - ab * ab) - ka * (ka * bb - ab * kb) + kb * (ka * ab - aa * kb) AS det FROM g), w AS (
  SELECT fold, (ky * (aa * bb - ab * ab) - ka * (ay * bb - ab * yb) + kb * (ay * ab - aa * yb)) / det AS w0, (k * (ay * bb - ab * yb) - ky * (ka * bb - ab * kb) + kb * (ka * yb - ay * kb)) / det AS wa,
    (k * (aa * yb - ay * ab) - ka * (ka * yb - ay * kb) + ky * (ka * ab - aa * kb)) / det AS wb FROM e
), p AS (SELECT d.*, all_.w0 + all_.wa * a + all_.wb * b AS predicted, own.w0 + own.wa * a + own.wb * b AS loo FROM d JOIN w all_ ON all_.fold = -1 JOIN w own ON own.fold = d.season_id)"""


def two_features(spark: SparkSession, sf_dir: str) -> R.Model:
    return R.fit(transitions(spark, sf_dir), ["soil_pct_week", "quantity_week"], [], [], "target")


@query(f"""{TWO_FEATURES} SELECT season_id, week_start, round(predicted, 9) AS predicted, round(loo, 9) AS loo_predicted, round(y - predicted, 9) AS residual, round(y - loo, 9) AS loo_residual FROM p""")
def transition_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(two_features(spark, sf_dir).predictions.select("season_id", "week_start", "predicted", "loo_predicted", "residual", "loo_residual"), 9)


@query(f"""{TWO_FEATURES}, c AS (SELECT unnest(['soil_pct_week', 'quantity_week']) AS feature, unnest([wa, wb]) AS c, unnest([ma, mb]) AS m, unnest([sa, sb]) AS s FROM w, m WHERE fold = -1)
SELECT feature, round(c, 9) AS coefficient, round(abs(c), 9) AS abs_coefficient, CASE WHEN c > 0 THEN 'aumenta_ndvi_futuro' ELSE 'pressiona_ndvi_futuro' END AS direction, round(m, 9) AS feature_mean, round(s, 9) AS feature_std FROM c""")
def transition_coefficients(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(two_features(spark, sf_dir).coefficients, 9)


@query(f"""{TWO_FEATURES} SELECT count(*) AS observations, CAST(2 AS BIGINT) AS features, 1.0::DOUBLE AS alpha, round(avg(abs(y - predicted)), 9) AS in_sample_mae, round(sqrt(avg((y - predicted) ** 2)), 9) AS in_sample_rmse, round(1 - avg((y - predicted) ** 2) / var_pop(y), 9) AS in_sample_r2,
  round(avg(abs(y - loo)), 9) AS loo_mae, round(sqrt(avg((y - loo) ** 2)), 9) AS loo_rmse, round(1 - avg((y - loo) ** 2) / var_pop(y), 9) AS loo_r2 FROM p""")
def transition_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(two_features(spark, sf_dir).summary.drop("model_choice", "model_note"), 9)


EVENT_DAYS = "SELECT user_id, CAST(ts AS DATE) AS date, event_type, value, props FROM events"


def event_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "events").withColumn("date", F.to_date("ts"))


@query(f"""SELECT user_id, date, count(*) AS points, round(sum(value), 4) AS total, round(avg(value), 6) AS mean, round(quantile_cont(value, 0.9), 6) AS p90, round(avg(CASE WHEN value <= 1.0 THEN 1.0 ELSE 0.0 END), 6) AS zero_share
FROM ({EVENT_DAYS}) WHERE event_type = 'click' GROUP BY ALL""")
def daily_layer(spark: SparkSession, sf_dir: str) -> DataFrame:
    layer = D.Layer({"points": D.rows(), "total": D.total("value"), "mean": D.mean("value"), "p90": D.p90("value"), "zero_share": D.share(F.col("value") <= 1.0)}, F.col("event_type") == "click")
    out = layer.summarize(event_days(spark, sf_dir), ("user_id", "date"))
    return out.select("user_id", "date", "points", F.round("total", 4).alias("total"), *[F.round(c, 6).alias(c) for c in ("mean", "p90", "zero_share")])


@query(f"""SELECT user_id, date, count(*) FILTER (WHERE event_type = 'click') AS clicks, count(*) FILTER (WHERE event_type = 'error') AS errors, round(sum(value) FILTER (WHERE event_type = 'purchase'), 4) AS spent
FROM ({EVENT_DAYS}) WHERE event_type IN ('click', 'error', 'purchase') GROUP BY ALL""")
def merged_daily_layers(spark: SparkSession, sf_dir: str) -> DataFrame:
    days = event_days(spark, sf_dir)
    keys = ("user_id", "date")
    part = lambda kind, name, c: D.Layer({name: c}, F.col("event_type") == kind).summarize(days, keys)
    out = D.merge_daily([part("click", "clicks", D.rows()), part("error", "errors", D.rows()), part("purchase", "spent", F.sum("value"))], keys)
    return out.select(*keys, F.coalesce("clicks", F.lit(0)).alias("clicks"), F.coalesce("errors", F.lit(0)).alias("errors"), F.round("spent", 4).alias("spent"))


@query(f"""WITH d AS ({EVENT_DAYS}), t AS (SELECT quantile_cont(value, 0.9) AS hot FROM d) SELECT user_id, date, count(*) AS engine_temp_points, round(avg(value), 6) AS engine_temp_mean_c, max(value) AS engine_temp_max_c, round(avg(CASE WHEN value >= hot THEN 1.0 ELSE 0.0 END), 6) AS engine_temp_hot_share FROM d, t GROUP BY ALL""")
def hot_share_by_layer_quantile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(D.hot_share(event_days(spark, sf_dir), "value", keys=("user_id", "date")))


@query(f"""WITH s AS (SELECT user_id, date, CASE event_type WHEN 'click' THEN 'operation' WHEN 'view' THEN 'transit' WHEN 'error' THEN 'stop' ELSE 'other' END AS state FROM ({EVENT_DAYS}))
SELECT user_id, date, count(*) AS state_points, round(avg((state = 'operation')::INT), 6) AS state_operation_share, round(avg((state = 'transit')::INT), 6) AS state_transit_share, round(avg((state = 'stop')::INT), 6) AS state_stop_share FROM s GROUP BY ALL""")
def machine_state_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = {"click": "Operação em campo", "view": "DESLOCAMENTO", "error": "Máquina parada"}
    text = F.create_map(*[F.lit(x) for kv in words.items() for x in kv])
    days = event_days(spark, sf_dir).withColumns({"MachineState": F.try_element_at(text, F.col("event_type")), "season_id": F.col("user_id")})
    return rounded(D.summarize_layer(days, "state").select(F.col("season_id").alias("user_id"), "date", "state_points", "state_operation_share", "state_transit_share", "state_stop_share"))


@query(f"""SELECT user_id, CAST(date_trunc('week', date) AS DATE) AS week_start, round(sum(value), 4) AS value_week, CAST(count(DISTINCT date) AS BIGINT) AS date_week FROM ({EVENT_DAYS}) GROUP BY ALL""")
def weekly_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = WK.weekly(event_days(spark, sf_dir), {"value": "sum", "date": "days"}, "user_id")
    return out.select("user_id", F.col("week_start").cast("date").alias("week_start"), F.round("value_week", 4).alias("value_week"), "date_week")


@query(f"""WITH d AS (SELECT date, sum(value) AS rain FROM ({EVENT_DAYS}) GROUP BY date) SELECT date, round(avg(rain) OVER (ORDER BY date ROWS 6 PRECEDING), 6) AS ma7, round(avg(rain) OVER (ORDER BY date ROWS 13 PRECEDING), 6) AS ma14 FROM d""")
def rolling_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    days = event_days(spark, sf_dir).groupBy("date").agg(F.sum("value").alias("rain"))
    return rounded(W.rolling_mean(W.rolling_mean(days, "rain", 7, [], "date", "ma7"), "rain", 14, [], "date", "ma14").select("date", "ma7", "ma14"), 6)


@query(f"""WITH d AS (SELECT user_id, date, avg(value) AS v FROM ({EVENT_DAYS}) GROUP BY ALL), s AS (SELECT *, coalesce(date_diff('day', lag(date) OVER w, date) * (lag(v) OVER w + v) / 2, 0) AS step, v - lag(v) OVER w AS delta FROM d WINDOW w AS (PARTITION BY user_id ORDER BY date))
SELECT user_id, date, round(delta, 6) AS delta, round(sum(step) OVER (PARTITION BY user_id ORDER BY date ROWS UNBOUNDED PRECEDING), 7) AS auc FROM s""")
def running_area(spark: SparkSession, sf_dir: str) -> DataFrame:
    days = event_days(spark, sf_dir).groupBy("user_id", "date").agg(F.avg("value").alias("v"))
    out = W.running_area(W.delta(days, "v", ["user_id"], ["date"], "delta"), "v", ["user_id"], "date", [], "auc")
    return out.select("user_id", "date", F.round("delta", 6).alias("delta"), F.round("auc", 7).alias("auc"))


@query("""WITH g AS (SELECT o_custkey, o_orderkey, CAST(o_orderdate AS DATE) AS d, lag(CAST(o_orderdate AS DATE)) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS previous_date FROM orders) SELECT o_custkey, o_orderkey, d, previous_date, date_diff('day', previous_date, d) AS gap_days FROM g WHERE date_diff('day', previous_date, d) > 300""")
def temporal_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = read(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", F.to_date("o_orderdate").alias("d"))
    return Q.temporal_gaps(orders, "d", ["o_custkey"], ["o_orderkey"], 300).select("o_custkey", "o_orderkey", "d", "previous_date", F.col("gap_days").cast("long").alias("gap_days"))


@query("""SELECT o_custkey, o_orderkey, o_totalprice FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS rn FROM orders) WHERE rn = 1""")
def latest_per_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return W.latest(read(spark, sf_dir, "orders"), ["o_custkey"], "o_orderdate", ["o_orderkey"]).select("o_custkey", "o_orderkey", "o_totalprice")


@query("""WITH n AS (SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY ALL HAVING count(*) > 1) SELECT CAST(count(*) AS BIGINT) AS duplicate_rows FROM lineitem JOIN n USING (l_orderkey, l_linenumber)""")
def duplicate_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Q.duplicate_keys(read(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber"]).agg(F.count(F.lit(1)).alias("duplicate_rows"))


BOXES = "SELECT n_nationkey AS season_id, n_nationkey * 40.0::DOUBLE AS min_lon, n_nationkey * 300.0::DOUBLE AS min_lat, n_nationkey * 40.0::DOUBLE + 60 AS max_lon, n_nationkey * 300.0::DOUBLE + 900 AS max_lat FROM nation"


def boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("n_nationkey").cast("double")
    df = read(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("season_id"), (k * 40).alias("min_lon"), (k * 300).alias("min_lat"), (k * 40 + 60).alias("max_lon"), (k * 300 + 900).alias("max_lat"))
    return df.withColumns({"center_lon": (F.col("min_lon") + F.col("max_lon")) / 2, "center_lat": (F.col("min_lat") + F.col("max_lat")) / 2})


@query(f"""WITH b AS ({BOXES}), p AS (SELECT c_custkey, CAST(c_custkey % 1100 AS DOUBLE) AS lon, CASE WHEN c_custkey % 97 = 0 THEN NULL ELSE c_acctbal END AS lat FROM customer), m AS (
  SELECT c_custkey, min(CASE WHEN lon BETWEEN min_lon AND max_lon AND lat BETWEEN min_lat AND max_lat THEN season_id END) AS inside, arg_min(season_id, {{'d': (lon - (min_lon + max_lon) / 2) * (lon - (min_lon + max_lon) / 2) + (lat - (min_lat + max_lat) / 2) * (lat - (min_lat + max_lat) / 2), 'k': season_id}}) AS near, any_value(lat) AS lat FROM p, b GROUP BY c_custkey
) SELECT c_custkey, CASE WHEN lat IS NOT NULL THEN coalesce(inside, near) END AS season_id, CASE WHEN lat IS NULL THEN 'missing_coordinates' WHEN inside IS NOT NULL THEN 'bbox_contains' ELSE 'nearest_center' END AS assignment_method FROM m""")
def points_to_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = read(spark, sf_dir, "customer").select("c_custkey", (F.col("c_custkey") % 1100).cast("double").alias("lon"), F.when(F.col("c_custkey") % 97 != 0, F.col("c_acctbal")).alias("lat"))
    return S.assign_points(points, boxes(spark, sf_dir), "lon", "lat").select("c_custkey", "season_id", "assignment_method")


#: A box per part, of its size by its retail price, in a plane of 1100 by 11000.
PART_BOXES = """SELECT p_partkey AS season_id, lon AS min_lon, lat AS min_lat, lon + size AS max_lon, lat + size AS max_lat, lon + size / 2 AS center_lon, lat + size / 2 AS center_lat
  FROM (SELECT p_partkey, CAST((p_partkey * 7919) % 1103 AS DOUBLE) AS lon, CAST((p_partkey * 104729) % 11003 - 1000 AS DOUBLE) AS lat, CAST(p_size AS DOUBLE) AS size FROM part)"""


def part_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, size = F.col("p_partkey"), F.col("p_size").cast("double")
    lon, lat = ((k * 7919) % 1103).cast("double"), ((k * 104729) % 11003 - 1000).cast("double")
    return read(spark, sf_dir, "part").select(k.alias("season_id"), lon.alias("min_lon"), lat.alias("min_lat"), (lon + size).alias("max_lon"), (lat + size).alias("max_lat"), (lon + size / 2).alias("center_lon"), (lat + size / 2).alias("center_lat"))


@query(f"""WITH b AS ({PART_BOXES}), p AS (SELECT c_custkey, CAST(c_custkey % 1100 AS DOUBLE) AS lon, CASE WHEN c_custkey % 97 = 0 THEN NULL ELSE c_acctbal END AS lat FROM customer), m AS (
  SELECT c_custkey, min(CASE WHEN lon BETWEEN min_lon AND max_lon AND lat BETWEEN min_lat AND max_lat THEN season_id END) AS inside, arg_min(season_id, {{'d': (lon - center_lon) * (lon - center_lon) + (lat - center_lat) * (lat - center_lat), 'k': season_id}}) AS near, any_value(lat) AS lat FROM p, b GROUP BY c_custkey
) SELECT c_custkey, CASE WHEN lat IS NOT NULL THEN coalesce(inside, near) END AS season_id, CASE WHEN lat IS NULL THEN 'missing_coordinates' WHEN inside IS NOT NULL THEN 'bbox_contains' ELSE 'nearest_center' END AS assignment_method FROM m""")
def points_to_boxes_on_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The way for any number of boxes: a box per part, no broadcast, no pair of all points and boxes."""
    points = read(spark, sf_dir, "customer").select("c_custkey", (F.col("c_custkey") % 1100).cast("double").alias("lon"), F.when(F.col("c_custkey") % 97 != 0, F.col("c_acctbal")).alias("lat"))
    return S.assign_points(points, part_boxes(spark, sf_dir), "lon", "lat", max_boxes=0).select("c_custkey", "season_id", "assignment_method")


@query(f"""WITH b AS ({PART_BOXES}), n AS (
  SELECT c_custkey, season_id, row_number() OVER (PARTITION BY c_custkey ORDER BY ((c_custkey % 1100) - center_lon) ** 2 + (c_acctbal - center_lat) ** 2, season_id) AS place FROM customer, b
) SELECT c_custkey, CAST(place AS INTEGER) AS place, season_id AS site FROM n WHERE place <= 3""")
def three_nearest_sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = read(spark, sf_dir, "customer").select("c_custkey", (F.col("c_custkey") % 1100).cast("double").alias("lon"), F.col("c_acctbal").alias("lat"))
    sites = part_boxes(spark, sf_dir).select(F.col("season_id").alias("site"), F.col("center_lon").alias("s_lon"), F.col("center_lat").alias("s_lat"))
    near = N.nearest_sites(N.places_of(points, "lon", "lat"), sites, 3, geodesic=False)
    out = points.join(near, ["lon", "lat"]).select("c_custkey", F.posexplode("nearest").alias("at", "n"))
    return out.select("c_custkey", (F.col("at") + 1).alias("place"), "n.site")


@query("""WITH p AS (SELECT c_custkey, CAST(c_custkey % 360 - 180 AS DOUBLE) AS x, CAST(c_custkey % 170 - 85 AS DOUBLE) AS y, c_custkey % 8 AS k FROM customer)
SELECT c_custkey, round(CASE k WHEN 0 THEN x WHEN 1 THEN (24 * (x + 2) - 2 * (x + 1.5)) / 22 WHEN 2 THEN (4 * (x + 1) + 8 * (x + 6)) / 12 WHEN 3 THEN (3 * (x + 1.5) + 4 * (x + 3)) / 7 WHEN 4 THEN x + 1 WHEN 5 THEN x + 2 END, 8) AS lon,
  round(CASE k WHEN 0 THEN y WHEN 1 THEN (24 * (y + 3) - 2 * (y + 2)) / 22 WHEN 2 THEN (4 * (y + 1) + 8 * (y + 2)) / 12 WHEN 3 THEN (3 * y + 4 * (y + 2)) / 7 WHEN 4 THEN y WHEN 5 THEN y END, 8) AS lat FROM p""")
def wkt_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A point, a polygon with a hole, two polygons, a line, two points, a flat polygon, an empty geometry and a bad one."""
    x, y = F.col("c_custkey") % 360 - 180, F.col("c_custkey") % 170 - 85
    shapes = [
        "POINT ({0} {1})", "POLYGON (({0} {1}, {4} {1}, {4} {6}, {0} {6}, {0} {1}), ({1x} {1y}, {2} {1y}, {2} {3y}, {1x} {3y}, {1x} {1y}))", "SRID=4326;MULTIPOLYGON Z ((({0} {1} 5,{2} {1} 5,{2} {2y} 5,{0} {2y} 5,{0} {1} 5)),(({5} {1} 5,{7} {1} 5,{7} {4y} 5,{5} {4y} 5,{5} {1} 5)))",
        "LINESTRING ({0} {1}, {3} {1}, {3} {4y})", "MULTIPOINT (({0} {1}), ({2} {1}))", "POLYGON (({0} {1}, {4} {1}, {0} {1}, {4} {1}))", "POINT EMPTY", "POLYGON ((a b, c d))",
    ]
    holes = {"{0}": x, "{1x}": x + 1, "{2}": x + 2, "{3}": x + 3, "{4}": x + 4, "{5}": x + 5, "{7}": x + 7, "{1}": y, "{1y}": y + 1, "{2y}": y + 2, "{3y}": y + 3, "{4y}": y + 4, "{6}": y + 6}
    text = F.element_at(F.array(*map(F.lit, shapes)), (F.col("c_custkey") % 8 + 1).cast("int"))
    for hole, value in holes.items():
        text = F.replace(text, F.lit(hole), value.cast("string"))
    out = WKT.with_centroid(read(spark, sf_dir, "customer").select("c_custkey", text.alias("geometry")))
    return out.select("c_custkey", F.round("centroid_lon", 8).alias("lon"), F.round("centroid_lat", 8).alias("lat"))


@query("""SELECT c_custkey, round(degrees(c_acctbal * 100 / 6378137.0::DOUBLE), 8) AS lon, round(degrees(2 * atan(exp(c_acctbal * 100 / 6378137.0::DOUBLE)) - pi() / 2), 8) AS lat FROM customer""")
def inverse_mercator(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = F.col("c_acctbal") * 100
    return read(spark, sf_dir, "customer").select("c_custkey", F.round(S.lon_of(m), 8).alias("lon"), F.round(S.lat_of(m), 8).alias("lat"))


@query("""WITH e AS (SELECT event_id, user_id, CAST(ts AS DATE) AS d FROM events WHERE event_type = 'error'), i AS (SELECT event_id, user_id, CAST(ts AS DATE) AS d FROM events WHERE event_type = 'purchase'), n AS (
  SELECT e.event_id, i.event_id AS image, abs(date_diff('day', e.d, i.d)) AS gap, row_number() OVER (PARTITION BY e.event_id ORDER BY abs(date_diff('day', e.d, i.d)), i.event_id) AS rn FROM e LEFT JOIN i USING (user_id)
) SELECT event_id, image AS nearest_image, gap AS gap_days FROM n WHERE rn = 1""")
def nearest_in_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = read(spark, sf_dir, "events").select("event_id", "user_id", "event_type", F.to_date("ts").alias("d"))
    images = events.where("event_type = 'purchase'").select("user_id", F.col("event_id").alias("image"), F.col("d").alias("image_date"), F.col("event_id").alias("ord"))
    left = events.where("event_type = 'error'").select("event_id", "user_id", "d")
    out = PR.nearest_row(left, images, "user_id", "d", "image_date", "image", "ord")
    return out.select("event_id", "nearest_image", F.col("gap_days").cast("long").alias("gap_days"))


@query("""SELECT event_id, CAST(len(x) AS INTEGER) AS boxes, x[1] AS first_name FROM (SELECT event_id, CASE WHEN event_id % 7 = 0 THEN [] ELSE ['k' || json_extract_string(props, '$.k')] END AS x FROM events)""")
def nested_detections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A JSON array whose second item is a JSON text of an array of records."""
    events = read(spark, sf_dir, "events").withColumn("k", F.get_json_object("props", "$.k"))
    inner = F.format_string('[{"name":"k%s","confidence":0.9}]', "k")
    payload = F.when(F.col("event_id") % 7 == 0, "not json").otherwise(F.to_json(F.array(F.lit("[]"), inner)))
    found = events.withColumn("found", X.detections(payload))
    return found.select("event_id", F.size("found").alias("boxes"), F.get("found", F.lit(0))["name"].alias("first_name"))


@query("""SELECT x AS text, CASE WHEN x IN ('', '-', 'nan', 'None') THEN NULL WHEN regexp_full_match(x, '-?\\d+(\\.\\d+)?([eE][+-]?\\d+)?') THEN CAST(x AS DOUBLE) WHEN contains(x, ',') AND regexp_full_match(replace(replace(x, '.', ''), ',', '.'), '-?\\d+(\\.\\d+)?([eE][+-]?\\d+)?') THEN CAST(replace(replace(x, '.', ''), ',', '.') AS DOUBLE) END AS number, count(*) AS n FROM (
  SELECT CASE CAST(l_quantity AS INTEGER) % 6 WHEN 0 THEN '1.234,5' WHEN 1 THEN '-' WHEN 2 THEN replace(CAST(l_discount AS VARCHAR), '.', ',') WHEN 3 THEN '1.234.567' WHEN 4 THEN 'abc' ELSE '1,234' END AS x FROM lineitem) GROUP BY ALL""")
def locale_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("l_quantity").cast("int") % 6
    text = F.when(k == 0, "1.234,5").when(k == 1, "-").when(k == 2, F.replace(F.col("l_discount").cast("string"), F.lit("."), F.lit(","))).when(k == 3, "1.234.567").when(k == 4, "abc").otherwise("1,234")
    return read(spark, sf_dir, "lineitem").select(text.alias("text")).groupBy("text", X.parse_number("text").alias("number")).agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT doc_id FROM documents WHERE contains(strip_accents(lower(coalesce(text, ''))), 'cion') """)
def folded_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return PR.search(read(spark, sf_dir, "documents").select("doc_id", "text"), "CIÓN", ["text"]).select("doc_id")


@query("""SELECT doc_id, source FROM documents ORDER BY doc_id LIMIT 50 OFFSET 100""")
def table_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    return PR.page(read(spark, sf_dir, "documents").select("doc_id", "source"), ["doc_id"], 100, 50)


def _profile_sql(columns: list[str]) -> str:
    return "SELECT variable, count(v) AS n, round(avg(v), 6) AS mean, round(median(v), 6) AS median, round(stddev_samp(v), 6) AS std, min(v) AS min, round(quantile_cont(v, 0.25), 6) AS q1, round(quantile_cont(v, 0.75), 6) AS q3, max(v) AS max, round(stddev_samp(v) / avg(v), 6) AS cv, round(skewness(v), 6) AS skewness, round(kurtosis(v), 6) AS kurtosis FROM (" + " UNION ALL ".join(f"SELECT '{c}' AS variable, CAST({c} AS DOUBLE) AS v FROM lineitem" for c in columns) + ") GROUP BY variable"


@query(_profile_sql(["l_quantity", "l_discount", "l_tax"]))
def numeric_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    columns = ["l_quantity", "l_discount", "l_tax"]
    return rounded(PR.numeric_profile(read(spark, sf_dir, "lineitem").select(*columns), columns).drop("missing", "missing_ratio"))


@query("""SELECT 'c_mktsegment' AS column_name, 'string' AS data_type, round(avg((c_mktsegment IS NULL)::INT) * 100, 6) AS null_pct, count(DISTINCT c_mktsegment) AS distinct_count, min(c_mktsegment) AS min_value, max(c_mktsegment) AS max_value FROM customer
UNION ALL SELECT 'c_nationkey', 'int', round(avg((c_nationkey IS NULL)::INT) * 100, 6), count(DISTINCT c_nationkey), CAST(min(c_nationkey) AS VARCHAR), CAST(max(c_nationkey) AS VARCHAR) FROM customer""")
def column_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(PR.column_profile(read(spark, sf_dir, "customer"), ["c_mktsegment", "c_nationkey"]))


@query("""SELECT p_brand AS value, count(*) AS n FROM part GROUP BY p_brand ORDER BY n DESC, value LIMIT 20""")
def value_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return PR.top_values(read(spark, sf_dir, "part"), "p_brand")


@query("""WITH e AS (SELECT min(o_totalprice) AS lo, max(o_totalprice) AS hi FROM orders) SELECT CAST(least(19, floor((o_totalprice - lo) / (hi - lo) * 20)) AS INTEGER) AS bin, count(*) AS n FROM orders, e GROUP BY bin""")
def value_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return PR.histogram(read(spark, sf_dir, "orders"), "o_totalprice").select("bin", "n")


@query("""SELECT 'lineitem' AS table_name, unnest(['quantity_outside', 'discount_high', 'price_missing']) AS rule_id, unnest([count(*) FILTER (WHERE l_quantity < 2 OR l_quantity > 45), count(*) FILTER (WHERE l_discount > 0.08), count(*) FILTER (WHERE coalesce(l_extendedprice, 0) <= 0)]) AS affected_rows, count(*) AS total_rows FROM lineitem""")
def quality_rule_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = [Q.Rule("quantity_outside", "warning", Q.outside("l_quantity", 2, 45)), Q.Rule("discount_high", "info", Q.outside("l_discount", None, 0.08)), Q.Rule("price_missing", "error", Q.not_positive("l_extendedprice"))]
    return Q.run_rules(read(spark, sf_dir, "lineitem"), rules, "lineitem").select("table_name", "rule_id", "affected_rows", "total_rows")


EDGES = "SELECT 'r' || n_regionkey AS src, 'n' || n_nationkey AS dst FROM nation UNION ALL SELECT 'n' || s_nationkey, 's' || s_suppkey FROM supplier"


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    nations = read(spark, sf_dir, "nation").select(name("r", "n_regionkey").alias("src"), name("n", "n_nationkey").alias("dst"))
    return nations.union(read(spark, sf_dir, "supplier").select(name("n", "s_nationkey").alias("src"), name("s", "s_suppkey").alias("dst")))


@query(f"""WITH RECURSIVE e AS ({EDGES}), u AS (SELECT src, dst FROM e UNION SELECT dst, src FROM e), w AS (SELECT 's1' AS node, 0 AS depth UNION SELECT dst, depth + 1 FROM w JOIN u ON node = src WHERE depth < 3) SELECT node, min(depth) AS depth FROM w GROUP BY node""")
def lineage_neighbourhood(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.neighbourhood(edges(spark, sf_dir), spark.createDataFrame([("s1",)], "node string"), 3)


@query(f"""WITH e AS ({EDGES}), k AS (SELECT *, row_number() OVER (PARTITION BY src ORDER BY dst) AS rn FROM (SELECT DISTINCT * FROM e)), a AS (SELECT src, dst, 1 AS depth FROM k WHERE rn <= 4 AND src = 'r2'), b AS (SELECT src, dst, 2 AS depth FROM k WHERE rn <= 4 AND src IN (SELECT dst FROM a)) SELECT * FROM a UNION ALL SELECT * FROM b""")
def lineage_flow(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.flow(edges(spark, sf_dir), spark.createDataFrame([("r2",)], "node string"), 6, 4)


@query("""SELECT 'nation' || (s_nationkey % 3) AS table_name, count(DISTINCT s_suppkey % 10) AS expected, count(DISTINCT CASE WHEN s_suppkey % 10 < 7 THEN s_suppkey % 10 END) AS mapped FROM supplier GROUP BY 1""")
def lineage_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "supplier").select(F.concat(F.lit("nation"), (F.col("s_nationkey") % 3).cast("string")).alias("table_name"), (F.col("s_suppkey") % 10).cast("string").alias("column_name"))
    return L.coverage(rows, rows.where("cast(column_name as int) < 7")).select("table_name", "expected", "mapped")


@query("""SELECT n.n_name, CAST(count(s_suppkey) AS BIGINT) AS suppliers, round(sum(s_acctbal), 2) AS balance FROM nation n LEFT JOIN supplier ON n_nationkey = s_nationkey AND s_acctbal > 5000 GROUP BY n.n_name""")
def dimension_left_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    nations, suppliers = read(spark, sf_dir, "nation"), read(spark, sf_dir, "supplier").where("s_acctbal > 5000")
    return nations.join(suppliers, F.col("n_nationkey") == F.col("s_nationkey"), "left").groupBy("n_name").agg(F.count("s_suppkey").alias("suppliers"), F.round(F.sum("s_acctbal"), 2).alias("balance"))


@query("""SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 400000)""")
def anti_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "customer").join(read(spark, sf_dir, "orders").where("o_totalprice > 400000").select(F.col("o_custkey").alias("c_custkey")), "c_custkey", "left_anti").select("c_custkey")


@query(f"""WITH {PANEL}, f AS (SELECT *, ndvi_mean_week - lag(ndvi_mean_week) OVER (PARTITION BY season_id ORDER BY week_start) AS d FROM panel), g AS (SELECT comparison_pair, coalesce(d <= -0.01, false) AS problem, CASE WHEN soil_pct_week >= 0.04 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS hit FROM (
  SELECT comparison_pair, d, soil_pct_week FROM f UNION ALL SELECT e.p, e.d, soil_pct_week FROM f, (VALUES ('so_problemas', -1.0::DOUBLE), ('sem_problemas', 1.0::DOUBLE)) AS e(p, d) WHERE comparison_pair = 'par_0')),
r AS (SELECT comparison_pair, count(*) FILTER (WHERE problem) AS problem_weeks, avg(hit) FILTER (WHERE problem) AS p, avg(hit) FILTER (WHERE NOT problem) AS b FROM g GROUP BY comparison_pair)
SELECT comparison_pair, 'solo_exposto' AS driver, problem_weeks, round(p, 6) AS problem_rate, round(b, 6) AS baseline_rate, round((p - b) * 100, 6) AS delta_pp, round(CASE WHEN b > 0 THEN p / b END, 6) AS lift_ratio,
  CASE WHEN problem_weeks < 3 THEN 'baixa' WHEN (p - b) * 100 >= 20 THEN 'alta' WHEN (p - b) * 100 >= 10 THEN 'media' ELSE 'baixa' END AS evidence_level FROM r""")
def driver_lift(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two more pairs have problem weeks alone, and none: their other rate is unknown."""
    t = W.delta(panel(spark, sf_dir), "ndvi_mean_week", ["season_id"], ["week_start"], "d")
    ends = F.array(*[F.struct(F.lit(p).alias("p"), F.lit(d).alias("d")) for p, d in (("so_problemas", -1.0), ("sem_problemas", 1.0))])
    more = t.where("comparison_pair = 'par_0'").withColumn("e", F.explode(ends)).withColumns({"comparison_pair": F.col("e.p"), "d": F.col("e.d")}).drop("e")
    t = t.union(more).withColumns({"major_drop_flag": X.flag(F.col("d") <= -0.01), "low_vigor_flag": F.lit(False), "event_type": F.lit(None).cast("string"), "soil": F.col("soil_pct_week") >= 0.04})
    return rounded(T.driver_lift(t, {"soil": "solo_exposto"}).select("comparison_pair", "driver", "problem_weeks", "problem_rate", "baseline_rate", "delta_pp", "lift_ratio", "evidence_level"))


@query("""SELECT substr(sha1('part|' || p_partkey), 1, 16) AS id, lower(regexp_replace(p_name, '[\\s_-]', '', 'g')) AS name_key FROM part""")
def opaque_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "part").select(X.short_id(F.lit("part"), F.col("p_partkey").cast("string")).alias("id"), X.column_key("p_name").alias("name_key"))


@query("""SELECT p_brand, string_agg(DISTINCT p_type, ', ' ORDER BY p_type) AS types FROM part GROUP BY p_brand""")
def distinct_joined(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "part").groupBy("p_brand").agg(X.distinct_joined("p_type").alias("types"))


@query(f"""WITH {PANEL}, a AS (SELECT comparison_pair, treatment, avg(ndvi_mean_week) AS v, avg(soil_pct_week) AS s FROM panel GROUP BY ALL), w AS (
  SELECT comparison_pair, max(v) FILTER (WHERE treatment = 'tecnologia_4_0') - max(v) FILTER (WHERE treatment = 'convencional') AS dv, max(s) FILTER (WHERE treatment = 'convencional') - max(s) FILTER (WHERE treatment = 'tecnologia_4_0') AS ds FROM a GROUP BY ALL
), n AS (SELECT comparison_pair, CAST(coalesce((dv >= 0.0002)::INT, 0) + coalesce((ds >= 0.0002)::INT, 0) AS INTEGER) AS n_4_0, CAST(coalesce((dv <= -0.0002)::INT, 0) + coalesce((ds <= -0.0002)::INT, 0) AS INTEGER) AS n_convencional FROM w)
SELECT *, CASE WHEN n_4_0 > n_convencional THEN '4.0' WHEN n_convencional > n_4_0 THEN 'convencional' ELSE 'equilibrio' END AS winner FROM n""")
def directional_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    fields = panel(spark, sf_dir).groupBy("comparison_pair", "treatment").agg(F.avg("ndvi_mean_week").alias("v"), F.avg("soil_pct_week").alias("s"))
    out = EV.directional(fields, {"v": (0.0002, True), "s": (0.0002, False)})
    return out.select("comparison_pair", F.size("supports_4_0").alias("n_4_0"), F.size("supports_convencional").alias("n_convencional"), "winner")


@query("""SELECT l_suppkey, CAST(count(DISTINCT CAST(l_shipdate AS DATE)) AS BIGINT) AS ops_days, CAST(count(DISTINCT CASE WHEN l_tax > 0 THEN CAST(l_shipdate AS DATE) END) AS BIGINT) AS l_tax_days, round(sum(l_discount * l_quantity) / sum(l_quantity), 6) AS l_discount FROM lineitem GROUP BY l_suppkey""")
def weighted_area_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = read(spark, sf_dir, "lineitem").withColumn("date", F.to_date("l_shipdate"))
    return rounded(EV.ops_summary(lines, {"l_discount": "l_quantity"}, [], ["l_tax"], "l_suppkey"))


@query(f"""WITH {PANEL}, d AS (
  SELECT *, ndvi_mean_week - lag(ndvi_mean_week) OVER w AS delta, (ndvi_mean_week - min(ndvi_mean_week) OVER s) / nullif(max(ndvi_mean_week) OVER s - min(ndvi_mean_week) OVER s, 0) AS norm,
    row_number() OVER (PARTITION BY season_id ORDER BY week_start DESC) AS rn
  FROM panel WINDOW w AS (PARTITION BY season_id ORDER BY week_start), s AS (PARTITION BY season_id)
), e AS (
  SELECT season_id, comparison_pair, max(ndvi_mean_week) AS peak, avg(norm) FILTER (WHERE rn <= 4) AS last4, avg(delta) FILTER (WHERE rn <= 3) AS trend, avg(coalesce(norm <= 0.35, false)::INT) AS low_vigor, avg(coalesce(delta <= -0.08, false)::INT) AS major FROM d GROUP BY ALL
), f AS (
  SELECT *, round_even(100 * (0.30::DOUBLE * coalesce(last4, 0.5) + 0.20::DOUBLE * greatest(0, least(1, peak / 0.85::DOUBLE)) + 0.15::DOUBLE * (1 - low_vigor) + 0.10::DOUBLE * (1 - major) + 0.10::DOUBLE + 0.10::DOUBLE + 0.05::DOUBLE * coalesce(greatest(0, least(1, (trend + 0.12::DOUBLE) / 0.24::DOUBLE)), 0.5)), 2) AS score FROM e
), g AS (SELECT *, row_number() OVER p AS k, first_value(score) OVER q AS one, nth_value(score, 2) OVER q AS two FROM f WINDOW p AS (PARTITION BY comparison_pair ORDER BY season_id), q AS (PARTITION BY comparison_pair ORDER BY season_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)),
h AS (SELECT *, score - CASE WHEN k = 1 THEN two ELSE one END AS gap FROM g)
SELECT season_id, comparison_pair, score AS trajectory_score, CASE WHEN score >= 75 THEN 'favoravel' WHEN score >= 65 THEN 'positivo_com_ressalvas' WHEN score >= 50 THEN 'misto' ELSE 'atencao' END AS outlook_band,
  CASE WHEN gap IS NULL THEN 'sem_referencia_no_par' WHEN gap >= 6 THEN 'tende_a_chegar_acima_do_par' WHEN gap <= -6 THEN 'tende_a_chegar_abaixo_do_par' ELSE 'sem_vantagem_clara_no_par' END AS expected_vs_pair,
  concat_ws(' | ', CASE WHEN low_vigor >= 0.2 AND low_vigor >= major THEN 'baixo_vigor_recorrente' END, CASE WHEN major >= 0.2 THEN 'quedas_relevantes_de_ndvi' END, CASE WHEN low_vigor >= 0.2 AND low_vigor < major THEN 'baixo_vigor_recorrente' END) AS top_risks FROM h""")
def season_outlook(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seven weighted parts per field and the comparison with its pair."""
    t = T.phase_timeline(panel(spark, sf_dir))
    out = EV.outlook(EV.season_summary(t, ["season_id", "comparison_pair", "treatment"]))
    return rounded(out.select("season_id", "comparison_pair", "trajectory_score", "outlook_band", "expected_vs_pair", F.array_join("top_risks", " | ").alias("top_risks")))


@query()
def hypotheses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seeded resampling stands behind H1 and H2, so there is no SQL."""
    t = T.phase_timeline(panel(spark, sf_dir))
    effects = P.pair_effects(t, {"ndvi_mean_week": (0.0005, True), "low_vigor_flag": (0.02, False), "major_drop_flag": (0.02, False)})
    lift = T.driver_lift(t, {"high_soil_flag": "solo_exposto"})
    register = EV.hypothesis_register(effects, lift, EV.outlook(EV.season_summary(t, ["season_id", "comparison_pair", "treatment"])))
    return register.join(EV.decision_summary(register).select("comparison_pair", "decision"), "comparison_pair")


@query("""SELECT 'lineitem' AS dataset, count(*) AS rows, 11 AS columns, 8 AS numeric_columns, CAST(0 AS BIGINT) AS null_cells, 0.0::DOUBLE AS null_ratio FROM lineitem""")
def dataset_overview(spark: SparkSession, sf_dir: str) -> DataFrame:
    return PR.overview(read(spark, sf_dir, "lineitem"), "lineitem")


@query("""SELECT 'geral' AS scope, round(avg(l_discount), 6) AS mean, count(*) AS n FROM lineitem UNION ALL SELECT l_returnflag, round(avg(l_discount), 6), count(*) FROM lineitem GROUP BY l_returnflag""")
def total_and_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The total and the groups in one pass by grouping sets."""
    df = read(spark, sf_dir, "lineitem").select("l_returnflag", "l_discount")
    out = df.rollup("l_returnflag").agg(F.round(F.avg("l_discount"), 6).alias("mean"), F.count(F.lit(1)).alias("n"), F.grouping("l_returnflag").alias("g"))
    return out.select(F.when(F.col("g") == 1, "geral").otherwise(F.col("l_returnflag")).alias("scope"), "mean", "n")


@query("""SELECT l_returnflag, count(l_tax) AS n, round(avg(l_tax), 6) AS mean, round(median(l_tax), 6) AS median, round(stddev_samp(l_tax), 6) AS std FROM lineitem GROUP BY l_returnflag""")
def profiles_by_area(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(PR.numeric_profile(read(spark, sf_dir, "lineitem").select("l_returnflag", "l_tax"), ["l_tax"], ["l_returnflag"]).select("l_returnflag", "n", "mean", "median", "std"))


@query("""SELECT o_orderkey, o_totalprice FROM orders WHERE coalesce(o_totalprice < 20000 OR o_totalprice > 490000, false) ORDER BY o_orderkey LIMIT 50""")
def rule_examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Q.examples(read(spark, sf_dir, "orders"), Q.Rule("price", "info", Q.outside("o_totalprice", 20000, 490000)), ["o_orderkey"]).select("o_orderkey", "o_totalprice")


SCENES = """scenes AS (SELECT CAST(l_suppkey AS VARCHAR) AS season_id, l_orderkey || '-' || l_linenumber AS filename, CAST(l_shipdate AS DATE) AS date, CASE l_orderkey % 5 WHEN 0 THEN 0.0::DOUBLE WHEN 1 THEN NULL ELSE l_quantity END AS b1_valid_pixels, l_discount AS b1_mean FROM lineitem)"""
AREAS = """official AS (SELECT CAST(s_suppkey AS VARCHAR) AS season_id, s_name AS area_label, CASE s_suppkey % 4 WHEN 0 THEN 'tecnologia_4_0' ELSE 'convencional' END AS treatment FROM supplier WHERE s_suppkey % 3 > 0),
manual AS (SELECT CAST(s_suppkey AS VARCHAR) AS season_id, 'Manual ' || s_suppkey AS m FROM supplier WHERE s_suppkey % 7 = 0),
areas AS (SELECT season_id, coalesce(m, area_label, 'Area ' || substr(season_id, 1, 8)) AS area_label, CASE WHEN area_label IS NULL THEN 'indefinido' ELSE treatment END AS treatment, CASE WHEN area_label IS NULL THEN 'auto_missing' END AS mapping_source FROM (SELECT DISTINCT season_id FROM scenes) LEFT JOIN official USING (season_id) LEFT JOIN manual USING (season_id))"""


def scenes(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("l_orderkey") % 5
    return read(spark, sf_dir, "lineitem").select(
        F.col("l_suppkey").cast("string").alias("season_id"), F.concat_ws("-", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string")).alias("filename"), F.to_date("l_shipdate").alias("date"),
        F.when(k == 0, 0.0).when(k != 1, F.col("l_quantity")).alias("b1_valid_pixels"), F.col("l_discount").alias("b1_mean"), F.col("l_tax").alias("b1_std"), F.lit(10.0).alias("b1_pct_solo"), F.lit(80.0).alias("b1_pct_veg_densa"),
    )


def areas(spark: SparkSession, sf_dir: str) -> DataFrame:
    suppliers, name = read(spark, sf_dir, "supplier"), F.col("s_suppkey").cast("string").alias("season_id")
    official = suppliers.where("s_suppkey % 3 > 0").select(name, F.col("s_name").alias("area_label"), F.when(F.col("s_suppkey") % 4 == 0, SIDES[0]).otherwise(SIDES[1]).alias("treatment"))
    manual = suppliers.where("s_suppkey % 7 = 0").select(name, F.concat(F.lit("Manual "), F.col("s_suppkey").cast("string")).alias("area_label"))
    return TR.area_metadata(scenes(spark, sf_dir), official, manual)


@query(f"""WITH {SCENES}, {AREAS} SELECT * FROM areas""")
def area_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    return areas(spark, sf_dir).select("season_id", "area_label", "treatment", "mapping_source")


@query(f"""WITH {SCENES}, {AREAS}, w AS (SELECT min(CAST(o_orderdate AS DATE)) + 400 AS a, max(CAST(o_orderdate AS DATE)) - 400 AS b FROM orders), v AS (
  SELECT *, lag(b1_mean) OVER s AS before, lag(date) OVER s AS day FROM scenes WHERE coalesce(b1_valid_pixels, 0) > 0 WINDOW s AS (PARTITION BY season_id ORDER BY date, filename)
) SELECT season_id, filename, area_label, date, CAST(date_trunc('week', date) AS DATE) AS week_start, round(b1_mean - before, 6) AS ndvi_delta,
  round(sum(coalesce(date_diff('day', day, date) * (before + b1_mean) / 2, 0)) OVER (PARTITION BY season_id ORDER BY date, filename ROWS UNBOUNDED PRECEDING), 4) AS ndvi_auc, date BETWEEN a AND b AS has_weather_coverage
FROM v LEFT JOIN areas USING (season_id), w""")
def clean_scenes(spark: SparkSession, sf_dir: str) -> DataFrame:
    day = F.to_date("o_orderdate")
    weather = read(spark, sf_dir, "orders").agg(F.explode(F.array(F.date_add(F.min(day), 400), F.date_sub(F.max(day), 400))).alias("date"))
    out = TR.clean_scenes(scenes(spark, sf_dir), areas(spark, sf_dir), weather)
    return out.select("season_id", "filename", "area_label", "date", F.to_date("week_start").alias("week_start"), F.round("ndvi_delta", 6).alias("ndvi_delta"), F.round("ndvi_auc", 4).alias("ndvi_auc"), "has_weather_coverage")


@query(f"""WITH {SCENES} SELECT season_id, count(*) AS total_images, count(*) FILTER (WHERE coalesce(b1_valid_pixels, 0) > 0) AS total_valid_images, min(date) AS first_scene, max(date) AS last_scene FROM scenes GROUP BY season_id""")
def scene_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return TR.scene_summary(scenes(spark, sf_dir))
