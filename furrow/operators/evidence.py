"""Season summaries per field, directional evidence per pair, outlook, hypotheses and decisions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from furrow.operators.daily import merge_daily
from furrow.operators.pairs import SIDES
from furrow.operators.timeline import outlook_band, outlook_score
from furrow.operators.windows import first_rows, tail_mean

# Metrics with their least difference and whether more is better.
HYPOTHESIS_METRICS = {
    "ndvi_mean": (0.02, True), "harvest_yield_mean_kg_ha": (100.0, True), "avg_pest_count": (2.0, False), "overlap_area_pct_bbox": (0.01, False), "stop_duration_h_per_bbox_ha": (0.05, False),
    "fert_dose_gap_abs_mean_kg_ha": (10.0, False),
}
DIAGNOSTIC_METRICS = {
    "ndvi_mean_season": (0.02, True), "ndvi_peak": (0.03, True), "ndvi_norm_last": (0.08, True), "ndvi_auc_last": (5.0, True), "major_drop_weeks": (1.0, False), "low_vigor_weeks": (1.0, False),
    "pest_risk_weeks": (1.0, False), "ops_risk_weeks": (1.0, False),
}
RISK_SHARES = {
    "low_vigor_share": "baixo_vigor_recorrente", "major_drop_share": "quedas_relevantes_de_ndvi", "pest_risk_share": "pressao_de_praga", "ops_risk_share": "risco_operacional",
    "weather_stress_share": "estresse_climatico", "telemetry_risk_share": "telemetria_instavel",
}


def weighted_mean(value: str, weight: str) -> Column:
    """Mean by positive weights of rows that have both; null without any."""
    ok = F.col(value).isNotNull() & (F.col(weight) > 0)
    return F.try_divide(F.sum(F.when(ok, F.col(value) * F.col(weight))), F.sum(F.when(ok, F.col(weight))))


def ops_summary(daily: DataFrame, weighted: dict[str, str], sums: list[str], active: list[str], key: str = "season_id") -> DataFrame:
    """Days, days with a positive value, weighted means (value by weight) and sums that stay null where all is null."""
    return daily.groupBy(key).agg(
        F.count_distinct("date").alias("ops_days"), *[F.count_distinct(F.when(F.col(c) > 0, F.col("date"))).alias(f"{c}_days") for c in active], *[weighted_mean(v, w).alias(v) for v, w in weighted.items()], *[F.sum(c).alias(c) for c in sums]
    )


def inventory(metadata: DataFrame, parts: list[DataFrame], key: str = "season_id") -> DataFrame:
    """Field metadata with any number of summaries by field: one merge of the summaries, one join."""
    return metadata.join(merge_daily(parts, (key,)), key, "left") if parts else metadata


def audit_status(valid_ratio: Column, weather_ratio: Column, pest_ratio: Column) -> Column:
    return F.when(valid_ratio < 0.55, "critico").when((weather_ratio < 0.40) | (pest_ratio < 0.30), "atencao").otherwise("ok")


def season_summary(timeline: DataFrame, keys: list[str], week: str = "week_start") -> DataFrame:
    """A phase timeline by field: means, peak, last known values, weeks and shares of flags, outlook score and band."""
    last = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), F.col(week)))
    flags = ("major_drop", "severe_drop", "recovery", "low_vigor", "weather_stress", "pest_risk", "ops_risk", "telemetry_risk")
    covered = F.count_if(F.coalesce(F.col("has_weather_coverage_week").cast("boolean"), F.lit(False))) if "has_weather_coverage_week" in timeline.columns else F.lit(None).cast("long")
    area = F.max("ndvi_auc_week") if "ndvi_auc_week" in timeline.columns else F.lit(None).cast("double")
    out = timeline.groupBy(*keys).agg(
        area.alias("ndvi_auc_last"), covered.alias("weather_weeks"), F.avg("ndvi_mean_week").alias("ndvi_mean_season"), F.max("ndvi_mean_week").alias("ndvi_peak"), last("ndvi_norm_week").alias("ndvi_norm_last"), F.count("ndvi_mean_week").alias("valid_weeks"), last("phase").alias("latest_phase"),
        last("event_type").alias("latest_event"), *[F.count_if(F.col(f"{f}_flag")).alias(f"{f}_weeks") for f in flags], *[F.avg(F.col(f"{f}_flag").cast("double")).alias(f"{f}_share") for f in flags],
    )
    out = out.join(tail_mean(timeline, "ndvi_norm_week", keys, [week], 4, "last4_ndvi_norm_mean"), keys, "left").join(tail_mean(timeline, "ndvi_delta_week", keys, [week], 3, "recent_ndvi_delta_mean"), keys, "left")
    score = outlook_score(F.col("last4_ndvi_norm_mean"), F.col("ndvi_peak"), F.col("low_vigor_share"), F.col("major_drop_share"), F.col("pest_risk_share"), F.col("ops_risk_share"), F.col("recent_ndvi_delta_mean"))
    out = out.withColumn("weather_coverage_share", F.try_divide("weather_weeks", "valid_weeks"))
    return out.withColumn("trajectory_score", score).withColumn("outlook_band", outlook_band(F.col("trajectory_score")))


def outlook(summary: DataFrame, pair: str = "comparison_pair", key: str = "season_id", least: float = 6.0) -> DataFrame:
    """Each field's score against the first other field of its pair, and its three greatest risks of a fifth or more."""
    w = Window.partitionBy(pair).orderBy(key).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    field = F.struct(F.col(key).alias("k"), F.col("trajectory_score").alias("score"))
    one, two = F.first(field).over(w), F.nth_value(field, 2).over(w)
    summary = summary.withColumns({"__one": one, "__two": two})
    gap = F.col("trajectory_score") - F.when(F.col("__one.k") == F.col(key), F.col("__two.score")).otherwise(F.col("__one.score"))
    against = F.when(gap.isNull(), "sem_referencia_no_par").when(gap >= least, "tende_a_chegar_acima_do_par").when(gap <= -least, "tende_a_chegar_abaixo_do_par").otherwise("sem_vantagem_clara_no_par")
    held = [F.when(F.col(c) >= 0.20, F.struct((-F.col(c)).alias("w"), F.lit(label).alias("label"))) for c, label in RISK_SHARES.items()]
    risks = F.transform(F.slice(F.array_sort(F.filter(F.array(*held), lambda e: e.isNotNull())), 1, 3), lambda e: e["label"])
    return summary.withColumns({"expected_vs_pair": against, "top_risks": risks}).drop("__one", "__two")


def directional(df: DataFrame, spec: dict[str, tuple[float, bool]], pair: str = "comparison_pair", side: str = "treatment", sides: tuple[str, str] = SIDES) -> DataFrame:
    """Per pair the metrics that speak for each side: a difference of the threshold or more in the better direction.

    (pair, supports_4_0, supports_convencional, evidence_count, winner); a metric that a side lacks says nothing.
    """
    known = {m: r for m, r in spec.items() if m in df.columns}
    wide = df.groupBy(pair).agg(*[F.max(F.when(F.col(side) == s, F.col(m).cast("double"))).alias(f"{m}__{i}") for m in known for i, s in enumerate(sides)])
    for_side: list[list[Column]] = [[], []]
    for m, (least, higher) in known.items():
        gain = (F.col(f"{m}__0") - F.col(f"{m}__1")) * (1 if higher else -1)
        for_side[0].append(F.when(gain >= least, F.lit(m)))
        for_side[1].append(F.when(gain <= -least, F.lit(m)))
    lists = [F.filter(F.array(*c), lambda x: x.isNotNull()) for c in for_side]
    out = wide.select(pair, lists[0].alias("supports_4_0"), lists[1].alias("supports_convencional"))
    a, b = F.size("supports_4_0"), F.size("supports_convencional")
    return out.withColumns({"evidence_count": a + b, "winner": F.when(a > b, "4.0").when(b > a, "convencional").otherwise("equilibrio")})


def strength(count: Column, high: int, medium: int) -> Column:
    return F.when(count >= high, "alta").when(count >= medium, "media").otherwise("baixa")


def lowered(level: Column, gaps: Column) -> Column:
    """A level by its critical gaps: one takes a step, two or more make it low."""
    return F.when((level == "alta") & (gaps == 1), "media").when((level == "alta") & (gaps >= 2), "baixa").when((level == "media") & (gaps >= 1), "baixa").otherwise(level)


def hypothesis_matrix(inventory_: DataFrame, gaps: Column | None = None, pair: str = "comparison_pair") -> DataFrame:
    """Directional evidence of the season's inventory with its strength, lowered by missing yield or trap counts."""
    missing = inventory_.groupBy(pair).agg(*[F.bool_or(F.col(c).isNull()).cast("int").alias(f"__{c}") if c in inventory_.columns else F.lit(1).alias(f"__{c}") for c in ("harvest_yield_mean_kg_ha", "avg_pest_count")])
    out = directional(inventory_, HYPOTHESIS_METRICS, pair).join(missing, pair)
    n = F.col("__harvest_yield_mean_kg_ha") + F.col("__avg_pest_count")
    texts = F.filter(F.array(F.when(F.col("__harvest_yield_mean_kg_ha") == 1, "colheita_parcial"), F.when(F.col("__avg_pest_count") == 1, "pragas_parciais")), lambda x: x.isNotNull())
    return out.withColumns({"known_gaps": texts, "evidence_strength": lowered(strength(F.col("evidence_count"), 4, 2), n)}).drop("__harvest_yield_mean_kg_ha", "__avg_pest_count")


def status_of(winner: Column) -> Column:
    return F.when(winner == "favorece_4_0", "suportada").when(winner == "favorece_convencional", "nao_suportada").otherwise("inconclusiva")


def hypothesis_register(effects: DataFrame, lift: DataFrame, outlooks: DataFrame, pair: str = "comparison_pair") -> DataFrame:
    """Four rows a pair: H1 vigor, H2 fewer problem weeks, H3 a driver behind them, H4 the outlook of the treated field."""
    by = effects.groupBy(pair).agg(*[F.max(F.when(F.col("metric") == m, status_of(F.col("winner")))).alias(n) for n, m in (("h1", "ndvi_mean_week"), ("low", "low_vigor_flag"), ("drop", "major_drop_flag"))])
    yes, no = (F.lit(False) | (F.col("low") == s) | (F.col("drop") == s) for s in ("suportada", "nao_suportada"))
    yes, no = F.coalesce(yes, F.lit(False)), F.coalesce(no, F.lit(False))
    h2 = F.when(yes & no, "parcialmente_suportada").when(yes, "suportada").when(no, "nao_suportada").otherwise("inconclusiva")
    top = first_rows(lift, [pair], [F.desc("delta_pp"), "driver"]).select(pair, F.when(F.col("evidence_level").isin("alta", "media") & (F.col("delta_pp") > 0), "suportada").otherwise("inconclusiva").alias("h3"))
    seen = F.when(F.col("expected_vs_pair") == "tende_a_chegar_acima_do_par", "suportada").when(F.col("expected_vs_pair") == "tende_a_chegar_abaixo_do_par", "nao_suportada").otherwise("inconclusiva")
    treated = outlooks.where(F.col("treatment") == SIDES[0]).groupBy(pair).agg(F.min(seen).alias("h4"))
    wide = by.join(top, pair, "left").join(treated, pair, "left").withColumn("h2", h2)
    rows = F.array(*[F.struct(F.lit(h.upper()).alias("hypothesis"), F.coalesce(h, F.lit("inconclusiva")).alias("status")) for h in ("h1", "h2", "h3", "h4")])
    return wide.select(pair, F.explode(rows).alias("r")).select(pair, "r.*")


def decision_summary(register: DataFrame, pair: str = "comparison_pair") -> DataFrame:
    """Per pair how many hypotheses hold or fail, and the decision they suggest."""
    out = register.groupBy(pair).agg(F.count_if(F.col("status") == "suportada").alias("supported"), F.count_if(F.col("status") == "nao_suportada").alias("rejected"), F.count_if(F.col("status").isin("inconclusiva", "parcialmente_suportada")).alias("open"))
    return out.withColumn("decision", F.when((F.col("supported") >= 2) & (F.col("rejected") == 0), "avancar_4_0").when(F.col("rejected") > F.col("supported"), "rever_4_0").otherwise("manter_observacao"))
