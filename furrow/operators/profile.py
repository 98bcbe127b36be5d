"""Profiles: numeric summaries by group, column profiles, distributions, table overviews, pages and search."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from furrow.functions.exprs import text_key
from furrow.operators.order import joined, quantiles, unpivoted


def series_profile(value: Column) -> dict[str, Column]:
    """Aggregates of a numeric column: counts, mean, spread and bias-corrected shape (null for too few values); quartiles are no partial sums, see numeric_profile."""
    n = F.count(value).cast("double")
    sd = F.stddev_samp(value)
    skew = F.when(n > 2, F.sqrt(n * (n - 1)) / (n - 2) * F.skewness(value))
    kurt = F.when(n > 3, (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * F.kurtosis(value) + 6))
    return {
        "n": F.count(value), "missing": F.count_if(value.isNull()), "missing_ratio": F.avg(value.isNull().cast("double")), "mean": F.avg(value), "std": sd, "min": F.min(value),
        "max": F.max(value), "cv": F.abs(F.try_divide(sd, F.avg(value))), "skewness": skew, "kurtosis": kurt,
    }


def numeric_profile(df: DataFrame, columns: list[str], by: list[str] | None = None) -> DataFrame:
    """A profile row per variable (and group): the unpivoted columns are grouped once, and their median and quartiles are counted out exactly."""
    keys = [*(by or []), "variable"]
    long = unpivoted(df, by or [], [c for c in columns if c in df.columns])
    sums = long.groupBy(*keys).agg(*[c.alias(n) for n, c in series_profile(F.col("v")).items()])
    quarters = quantiles(long, keys, "v", [0.25, 0.5, 0.75]).toDF(*keys, "q1", "median", "q3")
    out = joined(sums, quarters, keys, "left")
    return out.select(*keys, "n", "missing", "missing_ratio", "mean", "median", "std", "min", "q1", "q3", "max", "cv", "skewness", "kurtosis")


def overview(df: DataFrame, name: str) -> DataFrame:
    """Rows, columns, numeric columns, empty cells and their share."""
    cells = reduce(lambda a, b: a + b, [F.count_if(F.col(f"`{c}`").isNull()) for c in df.columns])
    numeric = sum(isinstance(f.dataType, NumericType) for f in df.schema)
    n = F.count(F.lit(1))
    return df.agg(n.alias("rows"), cells.alias("null_cells"), F.try_divide(cells.cast("double"), n * len(df.columns)).alias("null_ratio")).select(F.lit(name).alias("dataset"), "rows", F.lit(len(df.columns)).alias("columns"), F.lit(numeric).alias("numeric_columns"), "null_cells", "null_ratio")


def column_profile(df: DataFrame, columns: list[str] | None = None, exact: bool = True) -> DataFrame:
    """Per column its type, null share, distinct values, least and greatest as text. Over all rows; exact or approximate distinct counts."""
    columns = columns or df.columns
    kinds = dict(df.dtypes)
    distinct = F.count_distinct if exact else F.approx_count_distinct
    one = [
        F.struct(F.lit(c).alias("column_name"), F.lit(kinds[c]).alias("data_type"), F.coalesce(F.avg(F.col(f"`{c}`").isNull().cast("double")) * 100, F.lit(0.0)).alias("null_pct"), distinct(F.col(f"`{c}`")).alias("distinct_count"), F.min(F.col(f"`{c}`")).cast("string").alias("min_value"), F.max(F.col(f"`{c}`")).cast("string").alias("max_value"))
        for c in columns
    ]
    return df.agg(F.array(*one).alias("p")).select(F.explode("p").alias("p")).select("p.*")


def top_values(df: DataFrame, column: str, k: int = 20) -> DataFrame:
    return df.groupBy(F.col(column).cast("string").alias("value")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), F.asc_nulls_last("value")).limit(k)


def histogram(df: DataFrame, column: str, bins: int = 20) -> DataFrame:
    """Equal-width bins from least to greatest: bin (0-based), its low edge and count; a column of one value has one bin."""
    ends = df.agg(F.min(column).cast("double").alias("lo"), F.max(column).cast("double").alias("hi"))
    at = F.when(F.col("lo") == F.col("hi"), 0).otherwise(F.least(F.lit(bins - 1), F.floor((F.col(column) - F.col("lo")) / (F.col("hi") - F.col("lo")) * bins))).cast("int")
    rows = df.where(F.col(column).isNotNull()).join(F.broadcast(ends))  # one row of ends
    return rows.groupBy(at.alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.first(F.col("lo") + at * (F.col("hi") - F.col("lo")) / bins).alias("low_edge"))


def search(df: DataFrame, query: str, columns: list[str] | None = None) -> DataFrame:
    """Rows of which a cell holds the query, letter case and accents aside."""
    wanted = text_key(F.lit(query[:160]))
    hits = [F.contains(text_key(F.col(f"`{c}`").cast("string")), wanted) for c in columns or df.columns]
    return df.where(reduce(lambda a, b: a | b, hits))


def page(df: DataFrame, order: list[str], offset: int = 0, limit: int = 100, query: str | None = None, columns: list[str] | None = None) -> DataFrame:
    """A page in a total order; limit within 1 to 500, offset up to 5,000,000."""
    rows = search(df, query, columns) if query else df
    return rows.orderBy(*order).offset(max(0, min(offset, 5_000_000))).limit(max(1, min(limit, 500)))


def nearest_row(left: DataFrame, right: DataFrame, key: str, left_date: str, right_date: str, value: str, ties: str) -> DataFrame:
    """For each left row the right row of its key with the least gap in days, the first by ties among equals.

    Both sides' dates are put in one ordered series per key, so every left row
    reads only its neighbours: no pair of all left and right rows is made.
    """
    # of the right rows of one day only the first by ties can be chosen
    right = right.where(F.col(right_date).isNotNull()).groupBy(key, right_date).agg(F.min(F.struct(F.col(ties).alias("t"), F.col(value).alias("v"))).alias("r"))
    right = right.select(key, F.col(right_date).alias("__d"), F.lit(0).alias("__side"), F.struct(F.col(right_date).alias("d"), "r.t", "r.v").alias("__r"))
    rows = left.withColumns({"__d": F.col(left_date), "__side": F.lit(1)}).unionByName(right, allowMissingColumns=True)
    w = Window.partitionBy(key).orderBy("__d", "__side")
    before = F.last("__r", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    # the same from the other end: a frame that only grows is summed up once, one that shrinks again for every row
    after = F.last("__r", ignorenulls=True).over(Window.partitionBy(key).orderBy(F.desc("__d"), F.desc("__side")).rowsBetween(Window.unboundedPreceding, 0))
    rows = rows.withColumns({"__b": before, "__a": after}).where("__side = 1")
    gap = lambda c: F.abs(F.date_diff(left_date, F.col(f"{c}.d")))
    first = F.when(F.col("__a").isNull(), True).when(F.col("__b").isNull(), False).otherwise((gap("__b") < gap("__a")) | ((gap("__b") == gap("__a")) & (F.col("__b.t") <= F.col("__a.t"))))
    picked = F.when(first, F.col("__b")).otherwise(F.col("__a"))
    return rows.withColumn("__p", picked).withColumns({f"nearest_{value}": F.col("__p.v"), "gap_days": F.abs(F.date_diff(left_date, F.col("__p.d")))}).drop("__d", "__side", "__r", "__b", "__a", "__p")
