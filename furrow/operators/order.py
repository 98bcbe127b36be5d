"""Exact quantiles and ranks of whole tables from counts by value: no task holds a column or a key.

Equal values are counted first, so a value that a third of all rows have is one
row. More than ONE_RANGE distinct values, which are counted, are dealt by range of
key and value, whatever the sizes of the keys, and written with the number of
their range; fewer are one range, with the same result. What a key has
before a range is a running sum over its ranges, as many rows as there are
partitions at most; what a range has before a value is a running sum within it.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from furrow.sources.scratch import staged

#: Distinct values of all keys together that one task may put in order.
ONE_RANGE = 1_000_000


def joined(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """left with the other columns of right, by keys that may be null; without keys right is one row."""
    if not keys:
        return left.join(F.broadcast(right))
    renamed = right.withColumnsRenamed({k: f"__r_{k}" for k in keys})
    on = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"__r_{k}")) for k in keys])
    return left.join(renamed, on, how).drop(*[f"__r_{k}" for k in keys])


def _dealt(df: DataFrame, keys: list[str], value: str, weight: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Distinct values (keys, value, n, __range), and by key and range the rows before it (__before) and in the key (total)."""
    counts = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg((F.sum(weight) if weight else F.count(F.lit(1))).alias("n"))
    counts = staged(counts, "counts")
    if counts.count() <= ONE_RANGE:
        dealt = counts.withColumn("__range", F.lit(0))
    else:
        parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        dealt = staged(counts.repartitionByRange(parts, *keys, value).withColumn("__range", F.spark_partition_id()), "order")
    # the sums have as many rows as there are keys and ranges together at most
    sums = dealt.groupBy(*keys, "__range").agg(F.sum("n").alias("__n"))
    key = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))
    before = F.sum("__n").over(key.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1))
    return dealt, sums.withColumns({"__before": F.coalesce(before, F.lit(0)), "total": F.sum("__n").over(key)})


def _counted_up(dealt: DataFrame, sums: DataFrame, keys: list[str], value: str) -> DataFrame:
    here = Window.partitionBy(*keys, "__range").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    rows = joined(dealt, sums.drop("__n"), [*keys, "__range"])
    return rows.withColumn("before", F.col("__before") + F.coalesce(F.sum("n").over(here), F.lit(0))).select(*keys, value, "n", "before", "total")


def values_in_order(df: DataFrame, keys: list[str], value: str, weight: str | None = None) -> DataFrame:
    """(keys, value, n, before, total): each distinct known value of a key, its rows, those of lesser values, and all of the key; a row may stand for weight rows."""
    return _counted_up(*_dealt(df, keys, value, weight), keys, value)


def average_ranks(df: DataFrame, keys: list[str], value: str, weight: str | None = None) -> DataFrame:
    """values_in_order with rank from 1, equals sharing their mean rank."""
    return values_in_order(df, keys, value, weight).withColumn("rank", F.col("before") + (F.col("n") + 1) / 2)


def quantiles(df: DataFrame, keys: list[str], value: str, at: list[float]) -> DataFrame:
    """(keys, q0, q1, ...): exact quantiles of a key's known values, linear between the two next to them; keys without any have no row.

    Only ranges that hold a wanted rank are counted up value by value.
    """
    dealt, sums = _dealt(df, keys, value)
    place = lambda p: (F.col("total") - 1) * F.lit(float(p))
    ends = [f(place(p)) for p in at for f in (F.floor, F.ceil)]
    inside = lambda rank, low, n: (rank >= F.col(low)) & (rank < F.col(low) + F.col(n))
    wanted = sums.where(reduce(lambda a, b: a | b, [inside(r, "__before", "__n") for r in ends]))
    rows = _counted_up(dealt, wanted, keys, value)
    picked = rows.groupBy(*keys).agg(F.max("total").alias("total"), *[F.max(F.when(inside(r, "before", "n"), F.col(value))).alias(f"__e{i}") for i, r in enumerate(ends)])
    between = lambda i, p: F.col(f"__e{2 * i}") + (F.col(f"__e{2 * i + 1}") - F.col(f"__e{2 * i}")) * (place(p) - F.floor(place(p)))
    return picked.select(*keys, *[between(i, p).alias(f"q{i}") for i, p in enumerate(at)])


def unpivoted(df: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """(keys, variable, v): the columns as doubles below each other."""
    each = F.explode(F.array(*[F.struct(F.lit(c).alias("variable"), F.col(f"`{c}`").cast("double").alias("v")) for c in columns]))
    return df.select(*keys, each.alias("__u")).select(*keys, "__u.*")


def quantile_row(df: DataFrame, keys: list[str], wanted: dict[str, tuple[str, float]]) -> DataFrame:
    """A row per key (without keys one row, of an empty table too) with quantiles by name: name -> (column, share)."""
    columns, at = sorted({c for c, _ in wanted.values()}), sorted({p for _, p in wanted.values()})
    found = quantiles(unpivoted(df, keys, columns), [*keys, "variable"], "v", at)
    value = lambda c, p: F.max(F.when(F.col("variable") == c, F.col(f"q{at.index(p)}")))
    return found.groupBy(*keys).agg(*[value(c, p).alias(name) for name, (c, p) in wanted.items()])
