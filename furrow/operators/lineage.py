"""Lineage graphs as edge tables: neighbourhoods, bounded flow paths, layers, coverage and token expansion."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from furrow.functions.exprs import pipe_list, text_key

MB = 1 << 20


def neighbourhood(edges: DataFrame, starts: DataFrame, radius: int) -> DataFrame:
    """(node, depth) within radius steps of the start nodes along edges (src, dst) in either direction, with the least depth."""
    both = edges.select("src", "dst").union(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).where("src is not null and dst is not null").distinct()
    seen = starts.select("node").where("node is not null").distinct().withColumn("depth", F.lit(0))
    for step in range(1, radius + 1):
        reached = seen.where(F.col("depth") == step - 1).join(both, F.col("node") == F.col("src")).select(F.col("dst").alias("node"), F.lit(step).alias("depth"))
        seen = seen.union(reached).groupBy("node").agg(F.min("depth").alias("depth"))
    return seen


def flow(edges: DataFrame, starts: DataFrame, depth: int = 6, fan_out: int = 14, downstream: bool = True) -> DataFrame:
    """(src, dst, depth) of the flow from the starts, each node's first fan_out edges by name a step, depth steps at most."""
    directed = edges.select("src", "dst") if downstream else edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    some = directed.distinct().withColumn("__n", F.row_number().over(Window.partitionBy("src").orderBy("dst"))).where(F.col("__n") <= fan_out).drop("__n")
    front, out = starts.select(F.col("node").alias("src")).distinct(), None
    for step in range(1, depth + 1):
        taken = some.join(front, "src").withColumn("depth", F.lit(step))
        out = taken if out is None else out.union(taken)
        front = taken.select(F.col("dst").alias("src")).distinct()
    return out.groupBy("src", "dst").agg(F.min("depth").alias("depth"))


def budgeted_flow(edges: DataFrame, start: str, depth: int = 6, fan_out: int = 14, total: int = 96, order: str = "dst") -> DataFrame:
    """(node, direction, depth, place): the flow into and then out of start, total nodes at most, itself (depth 0, place 0) included.

    Both directions share the budget. Each step goes on from the nodes that the
    step before it found new, in their order; of each the first fan_out edges
    count, by the column order (dst: by the neighbour's name), and a neighbour is
    reached at its first place in that. What is on the driver is the result,
    total rows at most. Null ends are no edges.
    """
    spark = edges.sparkSession
    kind = dict(edges.dtypes)["src"]
    found = {start: (start, "start", 0, 0)}
    for direction, here, there in (("up", "dst", "src"), ("down", "src", "dst")):
        front = [start]
        for step in range(1, depth + 1):
            if not front or len(found) >= total:
                break
            places = F.broadcast(spark.createDataFrame(list(zip(front, range(len(front)))), f"node {kind}, pos int"))
            seen = F.broadcast(spark.createDataFrame([(n,) for n in found], f"next {kind}"))
            hits = edges.where("src is not null and dst is not null").select(F.col(here).alias("node"), F.col(there).alias("next"), F.col(there if order == "dst" else order).alias("by")).join(places, "node")
            some = hits.withColumn("n", F.row_number().over(Window.partitionBy("pos").orderBy("by", "next"))).where(F.col("n") <= fan_out)
            fresh = some.join(seen, "next", "left_anti").groupBy("next").agg(F.min(F.struct("pos", "n")).alias("at"))
            front = [r["next"] for r in fresh.orderBy("at").limit(total - len(found)).collect()]
            found |= {n: (n, direction, step, i) for i, n in enumerate(front)}
    return spark.createDataFrame(list(found.values()), f"node {kind}, direction string, depth int, place int")


def layers(edges: DataFrame, nodes: DataFrame, passes: int = 5, cap: int = 11) -> DataFrame:
    """(node, layer): a node lies one layer after its latest source; so many relaxations, layers up to cap."""
    at = nodes.select("node").distinct().withColumn("layer", F.lit(0))
    for _ in range(passes):
        pushed = edges.join(at, F.col("src") == F.col("node")).groupBy("dst").agg((F.max("layer") + 1).alias("up"))
        at = at.join(pushed, F.col("node") == F.col("dst"), "left").select("node", F.least(F.lit(cap), F.greatest("layer", F.coalesce("up", F.lit(0)))).alias("layer"))
    return at


def edges_of(records: DataFrame, target: str, sources: str) -> DataFrame:
    """Edges (src, dst) from a record's pipe-separated sources to its target."""
    return records.select(F.explode(pipe_list(sources)).alias("src"), F.col(target).alias("dst")).where("dst is not null").distinct()


def expand_tokens(records: DataFrame, primary: DataFrame, key: str, name: str, tokens: str) -> DataFrame:
    """primary and the records that its pipe-separated tokens name, each once."""
    named = primary.select(F.explode(pipe_list(tokens)).alias(name)).distinct()
    return primary.union(records.join(named, name, "left_semi").select(*primary.columns)).dropDuplicates([key])


def coverage(expected: DataFrame, mapped: DataFrame) -> DataFrame:
    """Per table: expected columns, mapped ones, their share in percent, and the missing ones in order. Both sides: (table_name, column_name)."""
    have = mapped.select("table_name", "column_name").distinct().withColumn("__has", F.lit(True))
    both = expected.select("table_name", "column_name").distinct().join(have, ["table_name", "column_name"], "left")
    n, got = F.count(F.lit(1)), F.count("__has")
    return both.groupBy("table_name").agg(n.alias("expected"), got.alias("mapped"), (got / n * 100).alias("coverage_pct"), F.array_join(F.array_sort(F.collect_list(F.when(F.col("__has").isNull(), F.col("column_name")))), ", ").alias("missing"))


def find(records: DataFrame, words: list[str], columns: list[str]) -> DataFrame:
    """Records of which every word is part of some column, letter case and accents aside."""
    text = F.concat_ws("\u0001", *[text_key(c) for c in columns])
    out = records
    for word in words:
        out = out.where(F.contains(text, text_key(F.lit(word))))
    return out


def column_catalog(tables: dict[str, DataFrame]) -> list[tuple[str, str, str, int]]:
    """(table, column, type, place) of every table's schema."""
    return [(t, c, kind, i) for t, df in tables.items() for i, (c, kind) in enumerate(df.dtypes)]


def storage_advice(files: DataFrame, most_mb: float = 250.0, large_mb: float = 80.0) -> DataFrame:
    """One row: raw MB (of 2^20 bytes), the largest file, large files, and local or hybrid storage. files: (zone, size_bytes)."""
    mb = F.col("size_bytes") / MB
    raw = files.agg(F.coalesce(F.sum(F.when(F.col("zone") == "raw", mb)), F.lit(0.0)).alias("raw_mb"), F.coalesce(F.max(mb), F.lit(0.0)).alias("largest_mb"), F.count_if(mb >= large_mb).alias("large_files"))
    return raw.withColumn("recommendation", F.when((F.col("raw_mb") >= most_mb) | (F.col("largest_mb") >= large_mb), "hybrid").otherwise("local"))


def critical_targets(records: DataFrame, targets: DataFrame, checks: dict[str, str]) -> DataFrame:
    """Per target (target, needle) how many named columns of some record hold its needle, folded: checks maps names to columns.

    The needles are few; every record is looked at once for each of them.
    """
    needles = [(r["target"], r["needle"]) for r in targets.select("target", "needle").collect()]
    hits = [F.array(*[F.struct(F.lit(t).alias("target"), F.lit(name).alias("check"), F.contains(text_key(c), text_key(F.lit(n))).alias("hit")) for name, c in checks.items()]) for t, n in needles]
    rows = records.select(F.explode(F.flatten(F.array(*hits))).alias("h")).select("h.*")
    found = rows.groupBy("target", "check").agg(F.bool_or("hit").alias("found"))
    return found.groupBy("target").agg(F.count_if("found").alias("passed"), F.count(F.lit(1)).alias("checks"), F.array_join(F.array_sort(F.collect_list(F.when(~F.col("found"), F.col("check")))), ", ").alias("missing"))


def gates(coverage_: DataFrame, targets: DataFrame, quality: DataFrame, least_coverage: float = 95.0) -> DataFrame:
    """Acceptance gates (gate, passed): every table's coverage, all targets' checks, no failed rule of severity error."""
    one = coverage_.agg(F.coalesce(F.min("coverage_pct") >= least_coverage, F.lit(False)).alias("passed")).select(F.lit("coverage").alias("gate"), "passed")
    two = targets.agg(F.coalesce(F.bool_and(F.col("passed") == F.col("checks")), F.lit(False)).alias("passed")).select(F.lit("critical_targets").alias("gate"), "passed")
    three = quality.agg((F.count_if((F.col("severity") == "error") & (F.col("affected_rows") > 0)) == 0).alias("passed")).select(F.lit("quality").alias("gate"), "passed")
    return one.union(two).union(three)
