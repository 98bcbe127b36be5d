"""Ordered-series operators over one partitioning: deltas, areas, rolling means, lags, ranks, scores.

Every window here has a partition key, unless the caller gives none (a farm-wide
daily series, one row a day); order is made total by the tie columns given.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from furrow.functions.exprs import exact_mean
from furrow.operators.order import joined, quantile_row
from furrow.sources.scratch import staged


def over(keys: list[str], *order: str | Column) -> Window:
    w = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))
    return w.orderBy(*order) if order else w


def delta(df: DataFrame, value: str, keys: list[str], order: list[str], name: str) -> DataFrame:
    return df.withColumn(name, F.col(value) - F.lag(value).over(over(keys, *order)))


def running_area(df: DataFrame, value: str, keys: list[str], date: str, ties: list[str], name: str) -> DataFrame:
    """Trapezoid area under value by days up to each row; 0 at the first row, segments with a null end add nothing."""
    w = over(keys, date, *ties)
    days = F.greatest(F.date_diff(date, F.lag(date).over(w)), F.lit(0))
    stepped = df.withColumn("__step", F.coalesce(days * (F.lag(value).over(w) + F.col(value)) / 2, F.lit(0.0)))
    return stepped.withColumn(name, F.sum("__step").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("__step")


def rolling_mean(df: DataFrame, value: str, rows: int, keys: list[str], order: str, name: str) -> DataFrame:
    """Mean of the last rows rows, not days."""
    return df.withColumn(name, F.avg(value).over(over(keys, order).rowsBetween(1 - rows, 0)))


def min_max(df: DataFrame, value: str, keys: list[str], name: str) -> DataFrame:
    """Value on the scale from the least to the greatest of its partition, within 0 and 1; null for a partition of one value."""
    w = over(keys)
    least, most = F.min(value).over(w), F.max(value).over(w)
    scaled = F.try_divide(F.col(value) - least, most - least)  # greatest and least would pass over a null
    return df.withColumn(name, F.when(scaled.isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(1.0), scaled))))


def weeks_from_peak(df: DataFrame, value: str, keys: list[str], week: str, name: str = "weeks_from_peak") -> DataFrame:
    """Weeks since the week of the greatest value, the earliest of equals."""
    peak = F.max(F.when(F.col(value).isNotNull(), F.struct(F.col(value).alias("v"), (-F.unix_date(F.to_date(week))).alias("d")))).over(over(keys))
    return df.withColumn(name, (F.unix_date(F.to_date(week)) + peak["d"]) / 7)


def lag_flags(df: DataFrame, flags: list[str], keys: list[str], order: list[str], suffix: str = "_lag1") -> DataFrame:
    w = over(keys, *order)
    return df.withColumns({f + suffix: F.coalesce(F.lag(f).over(w), F.lit(False)) for f in flags})


def lead_delta(df: DataFrame, value: str, keys: list[str], order: list[str], name: str) -> DataFrame:
    """The change to the next row as a target; rows without one go."""
    return df.withColumn(name, F.lead(value).over(over(keys, *order)) - F.col(value)).where(F.col(name).isNotNull())


def latest(df: DataFrame, keys: list[str], date: str, ties: list[str]) -> DataFrame:
    """The last row of each key by date; a null date comes after all dates."""
    w = over(keys, F.desc_nulls_first(date), *[F.desc(t) for t in ties])
    return df.withColumn("__at", F.row_number().over(w)).where("__at = 1").drop("__at")


def first_rows(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    return df.withColumn("__at", F.row_number().over(over(keys, *order))).where("__at = 1").drop("__at")


def gaps(df: DataFrame, date: str, keys: list[str], ties: list[str], longer_than: int = 12) -> DataFrame:
    """Rows that come more than so many days after the row before."""
    w = over(keys, date, *ties)
    return df.withColumns({"previous_date": F.lag(date).over(w), "gap_days": F.date_diff(date, F.lag(date).over(w))}).where(F.col("gap_days") > longer_than)


def scores(df: DataFrame, value: str, keys: list[str]) -> DataFrame:
    """z_score (population deviation) and robust_z_score 0.6745 * (x - median) / MAD; null where the spread is 0.

    The mean is exact, so that a row at it scores 0 and not a rest of either sign.
    Sums and medians by key are joined to the rows, of which a key may have any number.
    """
    df = staged(df, "scored")
    sums = df.groupBy(*keys).agg(exact_mean(value).alias("__mean"), F.stddev_pop(value).alias("__sd"))
    df = joined(joined(df, sums, keys), quantile_row(df, keys, {"__median": (value, 0.5)}), keys, "left")
    df = df.withColumn("__off", F.abs(F.col(value) - F.col("__median")))
    df = joined(df, quantile_row(df.select(*keys, "__off"), keys, {"__mad": ("__off", 0.5)}), keys, "left")
    df = df.withColumns({"z_score": F.try_divide(F.col(value) - F.col("__mean"), F.col("__sd")), "robust_z_score": F.try_divide(0.6745 * (F.col(value) - F.col("__median")), F.col("__mad"))})
    return df.drop("__mean", "__sd", "__median", "__off", "__mad")


def outliers(df: DataFrame, value: str, keys: list[str], z: float = 2.0, robust: float = 3.5) -> DataFrame:
    """Rows beyond either score, with their side; an unknown z-score counts as above."""
    scored = scores(df, value, keys)
    out = F.coalesce(F.abs("z_score") >= z, F.lit(False)) | F.coalesce(F.abs("robust_z_score") >= robust, F.lit(False))
    return scored.where(out).withColumn("direction", F.when(F.col("z_score") < 0, f"{value}_abaixo_do_padrao").otherwise(f"{value}_acima_do_padrao"))


def tail_mean(df: DataFrame, value: str, keys: list[str], order: list[str], k: int, name: str) -> DataFrame:
    """Mean of the last k known values of each key."""
    w = over(keys, *[F.desc(o) for o in order])
    known = df.where(F.col(value).isNotNull()).withColumn("__at", F.row_number().over(w)).where(F.col("__at") <= k)
    return known.groupBy(*keys).agg(F.avg(value).alias(name))


def duplicates(df: DataFrame, keys: list[str], name: str = "is_duplicate") -> DataFrame:
    """df with whether its keys (null ones are equal) come more than once. Keys are counted, so that no key's rows gather in a window."""
    more = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n")).where("__n > 1")
    return joined(df, more, keys, "left").withColumn(name, F.col("__n").isNotNull()).drop("__n")
