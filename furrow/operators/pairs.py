"""Paired comparison: effects with resampled intervals, classic tests, trends and correlations.

Rows of a metric are unpivoted, so one grouped pass serves all metrics. The
grouped functions get one pair and metric at a time, a value a week.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from furrow.functions.special import bootstrap_ci, correlation_p, shapiro_p, sign_flip_p, ttest_p, wilcoxon_p
from furrow.operators.order import average_ranks, joined
from furrow.sources.scratch import staged

# Metrics with the least difference that counts, and whether more is better.
EFFECTS = {
    "ndvi_mean_week": (0.015, True), "ndvi_auc_week": (0.25, True), "low_vigor_flag": (0.10, False), "major_drop_flag": (0.08, False), "pest_risk_flag": (0.08, False), "ops_risk_flag": (0.08, False),
    "high_soil_flag": (0.08, False),
}
CLASSIC = {
    **EFFECTS, "avg_pest_count_week": (1.0, False), "fert_dose_gap_abs_mean_kg_ha_week": (20.0, False), "overlap_area_pct_bbox_week": (0.01, False), "stop_duration_h_per_bbox_ha_week": (0.05, False),
    "invalid_telemetry_share_week": (0.05, False), "alarm_events_week": (5.0, False),
}
SIDES = ("tecnologia_4_0", "convencional")


def paired_values(df: DataFrame, metrics: list[str], pair: str = "comparison_pair", week: str = "week_start", side: str = "treatment", sides: tuple[str, str] = SIDES) -> DataFrame:
    """(pair, week, metric, tech, conv, gap) of the weeks in which both sides have the metric."""
    long = df.select(pair, week, side, F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value")) for m in metrics if m in df.columns])).alias("m"))
    wide = long.groupBy(pair, week, F.col("m.metric").alias("metric")).agg(*[F.max(F.when(F.col(side) == s, F.col("m.value"))).alias(n) for s, n in zip(sides, ("tech", "conv"), strict=True)])
    return wide.where("tech is not null and conv is not null").withColumn("gap", F.col("tech") - F.col("conv"))


def effect_summary(values: DataFrame, keys: list[str]) -> DataFrame:
    """n, means, gap, standardised effect (null for a constant gap), t statistic and mean z-score, all native."""
    sd = F.stddev_samp("gap")
    root = F.sqrt(F.count("gap").cast("double"))
    return values.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_pairs"), F.avg("tech").alias("mean_4_0"), F.avg("conv").alias("mean_convencional"), F.avg("gap").alias("mean_gap"),
        F.try_divide(F.avg("gap"), sd).alias("effect_size"), F.try_divide(F.avg("gap") * root, sd).alias("mean_zscore"),
    )


def winner(advantage: Column, low: Column, high: Column, least: Column) -> Column:
    return F.when((advantage >= least) & (low > 0), "favorece_4_0").when((advantage <= -least) & (high < 0), "favorece_convencional").otherwise("inconclusivo")


def evidence(n: Column, advantage: Column, low: Column, high: Column, p: Column, least: Column) -> Column:
    apart, large = (low > 0) | (high < 0), F.abs(advantage) >= least
    return F.when(n < 4, "baixa").when((n >= 8) & apart & (p <= 0.05) & large, "alta").when((n >= 6) & ((apart & large) | (p <= 0.10)), "media").otherwise("baixa")


def _rules(spec: dict[str, tuple[float, bool]], i: int) -> Column:
    return F.element_at(F.create_map(*[x for m, r in spec.items() for x in (F.lit(m), F.lit(r[i]))]), F.col("metric"))


def higher_is_better(metric: str, spec: dict[str, tuple[float, bool]] | None = None) -> Column:
    """Whether more of the named metric is better."""
    return F.try_element_at(F.create_map(*[x for m, r in (spec or CLASSIC).items() for x in (F.lit(m), F.lit(r[1]))]), F.col(metric))


def pair_effects(df: DataFrame, spec: dict[str, tuple[float, bool]] | None = None, pair: str = "comparison_pair", week: str = "week_start") -> DataFrame:
    """A row per pair and metric: means, advantage (positive favours 4.0), bootstrap interval, sign-flip p, winner, evidence."""
    spec = spec or EFFECTS
    values = paired_values(df, list(spec), pair, week).withColumn("better", F.when(_rules(spec, 1), F.col("gap")).otherwise(-F.col("gap")))

    def resample(rows: pd.DataFrame) -> pd.DataFrame:
        v = rows.sort_values(week)["better"].to_numpy()
        low, high = bootstrap_ci(v)
        sd = v.std(ddof=1) if len(v) > 1 else 0.0
        return pd.DataFrame({pair: [rows[pair].iloc[0]], "metric": [rows["metric"].iloc[0]], "n": [len(v)], "mean_4_0": [rows["tech"].mean()], "mean_convencional": [rows["conv"].mean()], "advantage_4_0": [v.mean()], "ci_low": [low], "ci_high": [high], "p_value": [sign_flip_p(v)], "effect_size": [v.mean() / sd if sd else None]})

    out = values.groupBy(pair, "metric").applyInPandas(resample, f"{pair} string, metric string, n long, mean_4_0 double, mean_convencional double, advantage_4_0 double, ci_low double, ci_high double, p_value double, effect_size double")
    least = _rules(spec, 0)
    args = (F.col("advantage_4_0"), F.col("ci_low"), F.col("ci_high"))
    return out.withColumns({"winner": winner(*args, least), "evidence_level": evidence(F.col("n"), *args, F.col("p_value"), least)})


def classic_tests(df: DataFrame, spec: dict[str, tuple[float, bool]] | None = None, pair: str = "comparison_pair", week: str = "week_start") -> DataFrame:
    """Shapiro, t and Wilcoxon p of the paired gaps, the recommended test and the side it favours."""
    spec = spec or CLASSIC

    def tests(rows: pd.DataFrame) -> pd.DataFrame:
        v = rows.sort_values(week)["gap"].to_numpy()
        return pd.DataFrame({pair: [rows[pair].iloc[0]], "metric": [rows["metric"].iloc[0]], "n": [len(v)], "mean_gap": [v.mean()], "shapiro_p": [shapiro_p(v)], "t_p": [ttest_p(v)], "wilcoxon_p": [wilcoxon_p(v)]})

    out = paired_values(df, list(spec), pair, week).groupBy(pair, "metric").applyInPandas(tests, f"{pair} string, metric string, n long, mean_gap double, shapiro_p double, t_p double, wilcoxon_p double")
    better = F.when(_rules(spec, 1), F.col("mean_gap")).otherwise(-F.col("mean_gap"))
    return recommended(out, better, _rules(spec, 0))


def recommended(tests: DataFrame, better: Column, least: Column) -> DataFrame:
    """tests (shapiro_p, t_p, wilcoxon_p) with the recommended test, its p, whether that is significant, and the side that a gap in the better direction favours."""
    test = F.when((F.col("shapiro_p") >= 0.05) & F.col("t_p").isNotNull(), "ttest_1samp").when(F.col("wilcoxon_p").isNotNull(), "wilcoxon").when(F.col("t_p").isNotNull(), "ttest_1samp").otherwise("sem_teste")
    out = tests.withColumn("recommended_test", test)
    p = F.when(F.col("recommended_test") == "wilcoxon", F.col("wilcoxon_p")).otherwise(F.col("t_p"))
    favours = F.when((p <= 0.05) & (better >= least), "favorece_4_0").when((p <= 0.05) & (better <= -least), "favorece_convencional").otherwise("inconclusivo")
    return out.withColumns({"p_value": p, "significant": F.coalesce(p <= 0.05, F.lit(False)), "favors": favours})


def trends(df: DataFrame, value: str, keys: list[str], week: str = "week_start") -> DataFrame:
    """Linear trend of value over the index of its known weeks: n, slope, intercept, r, r2, p_value, stderr, direction.

    A key of one known week has a row without estimates; a constant value has r
    and r2 of 0. Two weeks fit exactly: their p is 0, or 1 if they are equal.
    """
    known = df.where(F.col(value).isNotNull()).withColumn("x", (F.row_number().over(Window.partitionBy(*keys).orderBy(week)) - 1).cast("double"))
    out = known.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.regr_slope(value, "x").alias("slope"), F.regr_intercept(value, "x").alias("intercept"),
        F.when(F.count(F.lit(1)) > 1, F.coalesce(_corr(value, "x"), F.lit(0.0))).alias("r"), F.try_divide(F.var_pop(value), F.var_pop("x")).alias("__ratio"),
    )
    r2, n, slope = F.col("r") * F.col("r"), F.col("n"), F.col("slope")
    p = F.when(n == 2, F.when(F.col("r") == 0, 1.0).otherwise(0.0)).otherwise(_p_of("r", "n"))
    stderr = F.when(n == 2, 0.0).otherwise(F.sqrt(F.greatest(F.lit(0.0), 1 - r2) * F.col("__ratio") / (n - 2)))
    out = out.withColumns({"r2": r2, "p_value": p, "stderr": F.when(n > 1, stderr)}).drop("__ratio")
    sure = F.col("p_value") <= 0.05
    direction = (
        F.when(slope.isNull(), "sem_tendencia_estimada").when(sure & (slope > 0), "crescimento_significativo").when(sure & (slope < 0), "queda_significativa")
        .when(slope > 0, "leve_crescimento_sem_significancia").when(slope < 0, "leve_queda_sem_significancia").otherwise("estavel")
    )
    return out.withColumn("direction", direction)


def _corr(x: str, y: str) -> Column:
    """Pearson's coefficient; null where a side is constant, which corr divides by."""
    varies = (F.min(x) < F.max(x)) & (F.min(y) < F.max(y))
    return F.when(varies, F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y)))


def _p_of(r: str, n: str) -> Column:
    @F.pandas_udf("double")
    def p(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([correlation_p(x, int(k)) if pd.notna(x) else None for x, k in zip(a, b, strict=True)], dtype="float64")

    return F.nullif(p(r, n), F.lit(float("nan")))


def correlations(df: DataFrame, targets: list[str], features: list[str], group: str, total: str = "geral", least: int = 5, with_p: bool = False) -> DataFrame:
    """Pearson and Spearman of every target and other feature, over all rows (group total) and within each group.

    Pairwise complete rows, at least so many; where a side is constant there is no
    coefficient, and direction and strength say so. The pairs are unpivoted once.
    Ranks come from counts by value (average_ranks), never from a window over a
    group, and meet as counted pairs of values.
    """
    pairs = [F.struct(F.lit(t).alias("target"), F.lit(f).alias("feature"), F.col(t).cast("double").alias("y"), F.col(f).cast("double").alias("x")) for t in targets for f in features if f in df.columns and f != t]
    long = df.select(F.explode(F.array(F.lit(total), F.col(group).cast("string"))).alias("scope"), F.array(*pairs).alias("p")).select("scope", F.explode("p").alias("p")).select("scope", "p.*")
    long = long.where("x is not null and y is not null and scope is not null")
    keys = ["scope", "target", "feature"]
    met = staged(long.groupBy(*keys, "x", "y").agg(F.count(F.lit(1)).alias("w")), "pairs")  # equal pairs of values count once
    sides = met.select(*keys, F.explode(F.array(*[F.struct(F.lit(s).alias("side"), F.col(s).alias("v")) for s in ("x", "y")])).alias("u"), "w").select(*keys, "u.*", "w")
    ranks = average_ranks(sides, [*keys, "side"], "v", "w")
    for s in ("x", "y"):
        # off the mean rank, so that no large squares cancel
        of = ranks.where(F.col("side") == s).select(*keys, F.col("v").alias(s), (F.col("rank") - (F.col("total") + 1) / 2).alias(f"r{s}"))
        met = joined(met, of, [*keys, s])
    total_ = lambda c: F.sum(F.col("w") * c)
    spread = F.sqrt(total_(F.col("rx") * F.col("rx"))) * F.sqrt(total_(F.col("ry") * F.col("ry")))
    spearman = met.groupBy(*keys).agg(F.try_divide(total_(F.col("rx") * F.col("ry")), spread).alias("spearman"))
    out = long.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), _corr("x", "y").alias("pearson")).where(F.col("n") >= least)
    out = joined(out, spearman, keys)
    best = F.when(F.abs("spearman") > F.abs("pearson"), F.col("spearman")).otherwise(F.col("pearson"))
    out = out.withColumn("strongest", best)
    size = F.abs("strongest")
    out = out.withColumns({"direction": F.when(F.col("strongest") > 0, "positiva").when(F.col("strongest") < 0, "negativa").when(F.col("strongest") == 0, "nula").otherwise("sem_relacao"), "strength": F.when(size >= 0.7, "forte").when(size >= 0.4, "moderada").when(size >= 0.2, "fraca").when(size >= 0, "muito_fraca").otherwise("sem_relacao")})
    return out.withColumns({"pearson_p": _p_of("pearson", "n"), "spearman_p": _p_of("spearman", "n")}) if with_p else out


def r2(actual: np.ndarray, predicted: np.ndarray) -> float | None:
    spread = ((actual - actual.mean()) ** 2).sum()
    return None if spread == 0 else float(1 - ((actual - predicted) ** 2).sum() / spread)
