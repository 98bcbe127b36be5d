"""Filter interaction audit: what each of five filters removes, at each step of each order of them.

A document's failures are one mask. Documents are counted by part and mask
first, so the long form (cells by orders by steps) grows with the parts alone,
not with the documents: at most 32 cells a part, 600 steps a cell.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from furrow.llm.folder import table, written
from furrow.llm.rules import _parts

FILTERS = "ABCDE"
MIN_WORDS, MIN_DISTINCT_PERCENT, MAX_CAPITALS_PERCENT, SYMBOLS = 200, 50, 3, "[#$%&*|]"
_CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def failures(docs: DataFrame) -> DataFrame:
    """Each row's doc_id, part (its lang; null: empty string) and the bits of the filters that it fails (A: 1, B: 2, C: 4, D: 8, E: 16).

    A, B, C and D look at the whole text (null: empty; an empty text fails A
    alone of these). E fails a row whose text also stands under a smaller
    doc_id: rows of the smallest doc_id, repeated ones too, pass, and so does a
    null doc_id, which is neither smaller nor larger than another. Texts are
    told apart by SHA-256. The smallest doc_id of a text is an aggregate, and it
    finds its rows again by text and doc_id together: no number of copies of a
    text makes a hot key. An empty table has no rows.
    """
    text = docs.select("doc_id", F.coalesce("lang", F.lit("")).alias("part"), F.coalesce("text", F.lit("")).alias("text"))
    words = _parts(text, "words")
    counted = words.select("doc_id", "part", "text", F.size("words").alias("n"), F.size(F.array_distinct("words")).alias("distinct"))
    n, capitals = F.col("n"), F.length("text") - F.length(F.translate("text", _CAPITALS, ""))
    fails = [n < MIN_WORDS, 100 * F.col("distinct") < MIN_DISTINCT_PERCENT * n, 100 * capitals > MAX_CAPITALS_PERCENT * F.length("text"), F.col("text").rlike(SYMBOLS)]
    mask = sum((F.when(f, 1 << i).otherwise(0) for i, f in enumerate(fails)), F.lit(0))
    narrow = written(counted.select("doc_id", "part", mask.alias("mask"), F.unhex(F.sha2("text", 256)).alias("digest")), "failures")
    first = narrow.groupBy("digest").agg(F.min("doc_id").alias("doc_id")).where("doc_id is not null").withColumn("first", F.lit(True))
    found = narrow.join(first, ["digest", "doc_id"], "left")
    copy = F.col("first").isNull() & F.col("doc_id").isNotNull()
    return found.select("doc_id", "part", (F.col("mask") + F.when(copy, 16).otherwise(0)).alias("mask"))


def audit(masks: DataFrame, filters: str = FILTERS) -> DataFrame:
    """Of rows with part, mask, good and toxic: a row per part, order of the filters and step, zeros included.

    One letter a filter, its bit by its place in filters; the orders are all
    permutations, so filters are few. good and toxic are booleans. Long counts:
    kept (after the step), removed (here), redundant (failing this filter,
    removed before), unique_fails (failing this filter only), good_lost and
    toxic_lost (removed here), shapley (the filter's removed over all orders).
    The cells are dealt by part, at most 32 a part for five filters; all that
    follows stays where they are.
    """
    cells = masks.groupBy("part", "mask").agg(F.count(F.lit(1)).alias("n"), F.count_if("good").alias("good"), F.count_if("toxic").alias("toxic"))
    orders = cells.repartition("part").withColumn("filter_order", F.explode(F.array(*[F.lit("".join(p)) for p in permutations(filters)])))
    steps = orders.select("*", F.posexplode(F.split("filter_order", "(?<=.)(?=.)")).alias("at", "filter"))
    bits = F.create_map(*[F.lit(x) for i, f in enumerate(filters) for x in (f, 1 << i)])
    steps = steps.withColumn("bit", F.try_element_at(bits, F.col("filter"))).withColumn("failed", F.col("mask").bitwiseAND(F.col("bit")))
    earlier = Window.partitionBy("part", "mask", "filter_order").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    steps = steps.withColumn("before", F.coalesce(F.bit_or("failed").over(earlier), F.lit(0)))
    fails, gone = F.col("failed") != 0, F.col("before") != 0

    def total(count: str, where: Column) -> Column:
        return F.sum(F.when(where, F.col(count)).otherwise(0))

    counts = steps.groupBy("part", "filter_order", (F.col("at") + 1).alias("step"), "filter").agg(
        total("n", ~fails & ~gone).alias("kept"),
        total("n", fails & ~gone).alias("removed"),
        total("n", fails & gone).alias("redundant"),
        total("n", F.col("mask") == F.col("bit")).alias("unique_fails"),
        total("good", fails & ~gone).alias("good_lost"),
        total("toxic", fails & ~gone).alias("toxic_lost"),
    )
    return counts.withColumn("shapley", F.sum("removed").over(Window.partitionBy("part", "filter"))).drop("filter")


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The audit of all documents; of several labels of a doc_id any 1 counts, and null labels are none."""
    labels = table(spark, sf_dir, "labels").groupBy("doc_id").agg(F.max(F.col("quality") == 1).alias("good"), F.max(F.col("toxic") == 1).alias("toxic"))
    return audit(failures(table(spark, sf_dir, "documents")).join(labels, "doc_id", "left").select("part", "mask", "good", "toxic"))


OP11_SQL = r"""WITH w AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents
), f AS (
  SELECT doc_id, part, [len(ws) < 200, 100 * len(list_distinct(ws)) < 50 * len(ws), 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 3 * length(t), regexp_matches(t, '[#$%&*|]'), coalesce(doc_id > min(doc_id) OVER (PARTITION BY t), false)] AS fails FROM w
), l AS (SELECT doc_id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS toxic FROM labels GROUP BY doc_id),
c AS (SELECT part, fails, count(*) AS n, count(*) FILTER (WHERE good = 1) AS good, count(*) FILTER (WHERE toxic = 1) AS toxic FROM f LEFT JOIN l USING (doc_id) GROUP BY ALL),
i(k) AS (VALUES (1), (2), (3), (4), (5)),
o AS (SELECT [a.k, b.k, c.k, d.k, e.k] AS ks FROM i a JOIN i b ON b.k <> a.k JOIN i c ON c.k NOT IN (a.k, b.k) JOIN i d ON d.k NOT IN (a.k, b.k, c.k) JOIN i e ON e.k NOT IN (a.k, b.k, c.k, d.k)),
s AS (SELECT part, array_to_string(list_transform(ks, lambda k: substr('ABCDE', k, 1)), '') AS filter_order, i.k AS step, ks[i.k] AS f, n, good, toxic, fails[ks[i.k]] AS fail,
  len(list_filter(ks[1:i.k - 1], lambda k: fails[k])) > 0 AS gone, fail AND len(list_filter(fails, lambda x: x)) = 1 AS alone FROM c, o, i),
r AS (SELECT part, filter_order, CAST(step AS INTEGER) AS step, f, CAST(coalesce(sum(n) FILTER (WHERE NOT fail AND NOT gone), 0) AS BIGINT) AS kept, CAST(coalesce(sum(n) FILTER (WHERE fail AND NOT gone), 0) AS BIGINT) AS removed,
  CAST(coalesce(sum(n) FILTER (WHERE fail AND gone), 0) AS BIGINT) AS redundant, CAST(coalesce(sum(n) FILTER (WHERE alone), 0) AS BIGINT) AS unique_fails,
  CAST(coalesce(sum(good) FILTER (WHERE fail AND NOT gone), 0) AS BIGINT) AS good_lost, CAST(coalesce(sum(toxic) FILTER (WHERE fail AND NOT gone), 0) AS BIGINT) AS toxic_lost FROM s GROUP BY ALL)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, f) AS BIGINT) AS shapley FROM r"""
