"""Reproducible sharding: a Feistel permutation of global row numbers, walked along its cycles.

Row r of n goes to place p(r), p a permutation of 0..n-1; shard p % shards, slot
p // shards. Both are computable from r, n and the seed, and any two shards'
row counts are at most one apart (law ``rows``).
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from furrow.llm.folder import table, written

ROUNDS = 6
SEED = 20_240
SHARDS = 24


def domain(n: int) -> tuple[int, int]:
    """Sides a, b of the permuted rectangle: a * b >= n, a not far from b, with the fewest places beyond n."""
    if n <= 1:
        return 1, 1
    root = math.isqrt(n - 1) + 1
    a = min(range(root, 2 * root + 1), key=lambda side: (-n % side, side)) if root < 1_000_000 else next(s for s in range(root, 2 * root + 1) if -n % s <= 64)
    return a, -(-n // a)


def permute(r: Column, n: int, seed: int = SEED, rounds: int = ROUNDS) -> Column:
    """The place of row number r (0..n-1) among n; a place at or beyond n is permuted again until it is below."""
    a, b = domain(n)

    def once(v: Column) -> Column:
        x = F.pmod(v, F.lit(a).cast("long"))
        y = F.call_function("div", v, F.lit(a).cast("long"))
        for i in range(rounds):
            if i % 2 == 0:
                x = F.pmod(x + F.pmod(F.xxhash64(y, F.lit(seed), F.lit(i)), F.lit(a).cast("long")), F.lit(a).cast("long"))
            else:
                y = F.pmod(y + F.pmod(F.xxhash64(x, F.lit(seed), F.lit(i)), F.lit(b).cast("long")), F.lit(b).cast("long"))
        return y * F.lit(a).cast("long") + x

    place = once(r.cast("long"))
    beyond = a * b - n
    if beyond == 0:
        return place
    # a cycle has no more than `beyond` places outside, so that many steps always suffice
    return F.aggregate(F.sequence(F.lit(1), F.lit(beyond)), place, lambda p, _: F.when(p >= n, once(p)).otherwise(p))


def numbered(df: DataFrame, order: list[str], name: str = "numbered") -> tuple[DataFrame, int]:
    """df with its global row number in the given order (``row``, from 0), and the number of rows.

    Rows are range-partitioned and sorted; each partition's offset is the sum of
    the counts before it, so no task sees more than its own range. Rows that agree
    in the whole order are told apart by their place in df, so that a range holds
    no more of them than of others.
    """
    order = [*order, "__tie"]
    ranged = df.withColumn("__tie", F.monotonically_increasing_id()).repartitionByRange(*order).sortWithinPartitions(*order).drop("__tie")
    ranged = written(ranged.withColumns({"__part": F.spark_partition_id(), "__at": F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)}), name)
    counts = ranged.groupBy("__part").agg(F.count(F.lit(1)).alias("n")).orderBy("__part").collect()  # one row a partition
    before, pairs = 0, []
    for part, n in counts:
        pairs.append((part, before))
        before += n
    offsets = df.sparkSession.createDataFrame(pairs, "__part int, __before long")
    return ranged.join(F.broadcast(offsets), "__part").withColumn("row", F.col("__before") + F.col("__at")).drop("__part", "__at", "__before"), before


def shard_rows(df: DataFrame, order: list[str], shards: int = SHARDS, seed: int = SEED) -> DataFrame:
    """df with row (global number in the given order), shard (int) and slot (long, gapless from 0 in each shard).

    Rows that agree in all columns of order are numbered among themselves in no
    fixed order; nulls come first. Columns of df named row, shard or slot are
    replaced. An empty df stays empty.
    """
    rows, n = numbered(df.drop("row", "shard", "slot"), order)
    placed = rows.withColumn("__place", permute(F.col("row"), n, seed))
    return placed.withColumns({"shard": F.pmod("__place", F.lit(shards)).cast("int"), "slot": F.call_function("div", F.col("__place"), F.lit(shards).cast("long"))}).drop("__place")


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Null texts count as empty: size 8, checksum 0."""
    docs = table(spark, sf_dir, "documents")
    facts = docs.select(
        "doc_id", (F.coalesce(F.octet_length("text"), F.lit(0)) + 8).cast("long").alias("size"), F.coalesce(F.crc32(F.col("text").cast("binary")), F.lit(0)).cast("long").alias("text_crc32")
    )
    placed = shard_rows(facts, ["doc_id", "text_crc32", "size"])
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
