"""Interpretable ridge regression from Gram matrices, with leave-one-group-out validation.

Rows never reach the driver. A task adds up the products of its rows by group;
a group's matrix is the sum of the tasks' parts, and its fold is solved where
that sum is made, as the total less the group's own. The driver sees the total
alone, a matrix of the features squared, whose number is checked.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from furrow.operators.order import joined, quantile_row
from furrow.sources.scratch import staged

#: Design columns at most: the matrices have their number squared.
MAX_FEATURES = 2_000
#: Numbers that a task holds in its groups' matrices before it hands them on.
HELD = 1 << 23

# Features of the weekly transition model, its target, and texts of its tables.
NUMBERS = (
    "ndvi_mean_week", "ndvi_delta_week", "soil_pct_week", "dense_veg_pct_week", "precipitation_mm_week", "water_balance_mm_week", "temp_avg_c_week", "humidity_avg_pct_week", "avg_pest_count_week",
    "fert_dose_gap_abs_mean_kg_ha_week", "overlap_area_pct_bbox_week", "stop_duration_h_per_bbox_ha_week", "invalid_telemetry_share_week", "alarm_events_week", "engine_temp_hot_share_week", "risk_flag_count",
)
FLAGS = (
    "low_vigor_flag", "major_drop_flag", "high_soil_flag", "weather_stress_flag", "pest_risk_flag", "ops_risk_flag", "fert_risk_flag", "overlap_risk_flag", "stop_risk_flag", "telemetry_risk_flag", "alert_risk_flag",
    "engine_risk_flag",
)
CATEGORIES = ("comparison_pair", "treatment", "phase")
TARGET = "target_next_ndvi_delta"
ROW = ("season_id", "week_start", "area_label", "comparison_pair", "treatment", "phase")
MISSING = "desconhecido"
DIRECTIONS = ("aumenta_ndvi_futuro", "pressiona_ndvi_futuro")
CHOICE = "ridge_linear_interpretavel"
NOTE = "Base pequena para yield/ROI final; o modelo foi restrito a transicao semanal do NDVI para manter interpretabilidade."


class Model(NamedTuple):
    """The tables of a fit: one row of scores, a row per design column, a row per row of the frame."""

    summary: DataFrame
    coefficients: DataFrame
    predictions: DataFrame


def transition_frame(timeline: DataFrame) -> DataFrame:
    """Weeks with a next week's change as target, with the model's 16 numbers, 12 flags (unknown: 0) and 3 categories; columns that lack are null."""
    from furrow.operators.windows import lead_delta

    has = set(timeline.columns)
    frame = lead_delta(timeline, "ndvi_mean_week", ["season_id"], ["week_start"], TARGET)
    text = lambda c: F.col(c).alias(c) if c in has else F.lit(None).cast("string").alias(c)
    number = lambda c: F.col(c).cast("double").alias(c) if c in has else F.lit(None).cast("double").alias(c)
    on = lambda c: F.coalesce(F.col(c).cast("boolean").cast("double"), F.lit(0.0)).alias(c) if c in has else F.lit(0.0).alias(c)
    return frame.select(*map(text, ROW), TARGET, *map(number, NUMBERS), *map(on, FLAGS))


def design(df: DataFrame, numeric: list[str], booleans: list[str], categories: list[str], missing: str = MISSING) -> tuple[DataFrame, list[str], np.ndarray, np.ndarray]:
    """df with __x, the standardised design row after a leading 1; the columns' names, means and population deviations (1 if 0).

    Numbers by their median where null (0 if all null), flags as 0 and 1, a 0/1
    column per category value. More than MAX_FEATURES columns are an error.
    """
    medians = quantile_row(df, [], {c: (c, 0.5) for c in numeric}).first() if numeric else {}
    columns: list[tuple[str, Column]] = [(c, F.coalesce(F.col(c).cast("double"), F.lit(float(medians[c] or 0.0)))) for c in numeric]
    columns += [(c, F.coalesce(F.col(c).cast("double"), F.lit(0.0))) for c in booleans]
    for c in categories:
        value = F.coalesce(F.col(c), F.lit(missing))
        levels = sorted(r[0] for r in df.select(value).distinct().limit(MAX_FEATURES + 1).collect())
        columns += [(f"{c}_{v}", (value == v).cast("double")) for v in levels]
    if len(columns) > MAX_FEATURES:
        raise ValueError(f"over {MAX_FEATURES} design columns: a category has too many values")
    stats = df.agg(*[f(x).alias(f"{n}{i}") for i, (_, x) in enumerate(columns) for n, f in (("m", F.avg), ("s", F.stddev_pop))]).first()
    mean = np.array([stats[f"m{i}"] or 0.0 for i in range(len(columns))])
    sd = np.array([stats[f"s{i}"] or 1.0 for i in range(len(columns))])
    x = F.array(F.lit(1.0), *[(c - F.lit(float(m))) / F.lit(float(s)) for (_, c), m, s in zip(columns, mean, sd, strict=True)])
    return df.withColumn("__x", x), [name for name, _ in columns], mean, sd


def grams(ready: DataFrame, size: int, target: str, group: str) -> DataFrame:
    """(group, g): parts of each group's matrix of products of (__x, target), a few a task and group."""
    kind = dict(ready.dtypes)[group]
    wide = size + 1

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict = {}

        def out() -> pa.RecordBatch:
            values = pa.ListArray.from_arrays(pa.array(np.arange(len(held) + 1) * wide * wide, pa.int32()), pa.array(np.concatenate([g.ravel() for g in held.values()])))
            return pa.RecordBatch.from_arrays([pa.array(list(held), group_type), values], ["group", "g"])

        for batch in batches:
            group_type = batch.schema.field(0).type
            z = np.column_stack((batch.column(1).flatten().to_numpy().reshape(-1, size), batch.column(2).to_numpy()))
            codes = batch.column(0).dictionary_encode(null_encoding="encode")
            names, at = codes.dictionary.to_pylist(), codes.indices.to_numpy()
            for i, name in enumerate(names):
                rows = z[at == i] if len(names) > 1 else z
                held[name] = held.get(name, 0) + rows.T @ rows
            if len(held) * wide * wide > HELD:
                yield out()
                held = {}
        if held:
            yield out()

    return ready.select(F.col(group), "__x", F.col(target).cast("double").alias("y")).mapInArrow(parts, f"`group` {kind}, g array<double>")


def solve(g: np.ndarray, alpha: float = 1.0) -> np.ndarray:
    """Intercept and weights; the intercept is not shrunk."""
    penalty = alpha * np.eye(len(g) - 1)
    penalty[0, 0] = 0
    return np.linalg.pinv(g[:-1, :-1] + penalty) @ g[:-1, -1]


def total_of(parts: DataFrame, wide: int) -> np.ndarray:
    """The sum of all parts, added up cell by cell in tasks."""
    cells = parts.select(F.posexplode("g").alias("at", "v")).groupBy("at").agg(F.sum("v").alias("v")).collect()  # the features squared
    out = np.zeros(wide * wide)
    for at, v in cells:
        out[at] = v
    return out.reshape(wide, wide)


def fold_weights(parts: DataFrame, total: np.ndarray, alpha: float) -> DataFrame:
    """(group, w): weights of a fit without the group's rows; null where what remains is no more rows than features."""
    wide = len(total)
    kind = dict(parts.dtypes)["group"]

    def fold(rows: pd.DataFrame) -> pd.DataFrame:
        rest = total - np.sum(np.stack(rows["g"].to_numpy()), 0).reshape(wide, wide)
        return pd.DataFrame({"group": rows["group"].iloc[:1], "w": [solve(rest, alpha) if round(rest[0, 0]) > wide - 2 else None]})

    return parts.groupBy("group").applyInPandas(fold, f"`group` {kind}, w array<double>")


def _dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda u, v: u * v), F.lit(0.0), lambda s, e: s + e)


def scores(rows: DataFrame, actual: str, predicted: dict[str, str]) -> list[Column]:
    """Aggregates <prefix>_mae, _rmse and _r2 (population; null for constant actual values) of rows with a prediction."""
    out = []
    for prefix, c in predicted.items():
        known = F.col(c).isNotNull()
        error, y = F.col(actual) - F.col(c), F.when(known, F.col(actual))
        spread = F.when(F.min(y) < F.max(y), F.var_pop(y))
        out += [F.avg(F.abs(error)).alias(f"{prefix}_mae"), F.sqrt(F.avg(error * error)).alias(f"{prefix}_rmse"), (1 - F.try_divide(F.avg(error * error), spread)).alias(f"{prefix}_r2")]
    return out


def fit(df: DataFrame, numeric: list[str], booleans: list[str], categories: list[str], target: str = TARGET, group: str = "season_id", alpha: float = 1.0) -> Model:
    """Ridge of target, over all rows and, for each group, without its rows.

    Rows without a target are left out; null groups are one. predictions keeps
    the frame's columns and adds predicted, loo_predicted (null where the other
    groups have too few rows), residual and loo_residual.
    """
    spark = df.sparkSession
    known = staged(df.where(F.col(target).isNotNull()), "frame")
    ready, names, mean, sd = design(known, numeric, booleans, categories)
    ready = staged(ready, "design")
    parts = staged(grams(ready, len(names) + 1, target, group), "grams")
    total = total_of(parts, len(names) + 2)
    weights = solve(total, alpha)
    folds = staged(fold_weights(parts, total, alpha), "folds").toDF(group, "__w")
    whole = F.lit([float(w) for w in weights]).cast("array<double>")
    out = joined(ready, folds, [group], "left")
    out = out.withColumns({"predicted": _dot(F.col("__x"), whole), "loo_predicted": F.when(F.col("__w").isNotNull(), _dot(F.col("__x"), F.col("__w")))}).drop("__x", "__w")
    out = out.withColumns({"residual": F.col(target) - F.col("predicted"), "loo_residual": F.col(target) - F.col("loo_predicted")})
    rows = [(n, float(w), abs(float(w)), DIRECTIONS[0] if w > 0 else DIRECTIONS[1], float(m), float(s)) for n, w, m, s in zip(names, weights[1:], mean, sd, strict=True)]
    kinds = "feature string, coefficient double, abs_coefficient double, direction string, feature_mean double, feature_std double"
    coefficients = spark.createDataFrame(sorted(rows, key=lambda r: -r[2]), kinds)  # a row per design column
    summary = out.agg(F.count(F.lit(1)).alias("observations"), *scores(out, target, {"in_sample": "predicted", "loo": "loo_predicted"}))
    summary = summary.select("observations", F.lit(len(names)).cast("long").alias("features"), F.lit(float(alpha)).alias("alpha"), *[c for c in summary.columns if c != "observations"], F.lit(CHOICE).alias("model_choice"), F.lit(NOTE).alias("model_note"))
    return Model(summary, coefficients, out)


def transition_model(timeline: DataFrame, alpha: float = 1.0) -> Model:
    """The weekly transition model of a phase timeline, its tables under their names."""
    model = fit(transition_frame(timeline), list(NUMBERS), list(FLAGS), list(CATEGORIES), alpha=alpha)
    names = {"predicted": "predicted_next_ndvi_delta", "loo_predicted": "loo_predicted_next_ndvi_delta"}
    return Model(model.summary, model.coefficients, model.predictions.withColumnsRenamed(names).select(*ROW, TARGET, *names.values(), "residual", "loo_residual"))
