"""Exact Jaccard join of word n-gram sets with count-vector R-trees.

Two filters say which sets may meet at all. A set with too many shingles that
occur in no other set has no partner: that needs sums by shingle alone. What is
left is ordered by the shingles' frequency: linked sets share one of their
rarest shingles, and where it stands in both bounds the sizes that may link. So
passages that many texts share bring no texts together that differ elsewhere.

What these shingles connect is verified in blocks by R-trees over count vectors:
shingles are hashed into groups, a set is the point of its groups' counts, and
the overlap of two sets is at most the sum over groups of the lesser count, a
bound that holds for whole nodes by their greatest counts. Pairs that pass it
are verified on the whole sets, unless they are connected already.

Equal sets are one node from the start. A large block is cut into cells by size
and hash; members that its leader links need no pair among themselves, the rest
meet cell by cell, so no task holds more than two cells.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from furrow.llm.components import components
from furrow.llm.folder import table, written
from furrow.llm.words import mix, ngrams, slices, words

WORDS = 4
PERCENT = 85
#: Shingles of a cell, so that a task holds a few tens of MB.
CELL = 2_000_000
#: Share of all shingles, those of the least hashes, that tell whether a set has too many of its own.
PROBE = 0.5
#: Probed shingles that are summed up in a task before they are shuffled.
CHUNK = 2_000_000
DIMENSIONS = 64
FANOUT = 16


def least_overlap(sizes, percent: int):
    """Least intersection of two sets whose sizes add up to sizes, for 100 * intersection >= percent * union."""
    return -(-percent * sizes // (100 + percent))


def shingles(data: np.ndarray, offsets: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct hashes of each row's k-word windows, and first[r]; fewer words make one shingle of all."""
    w = words(data, offsets, lower=True)
    value, first = ngrams(w, k)
    row = np.repeat(np.arange(len(first) - 1), np.diff(first))
    counts = w.counts
    short = np.flatnonzero((counts > 0) & (counts < k))
    if len(short):
        whole = np.full(len(short), np.uint64(0x51ED270B))
        for i in range(k - 1):
            has = counts[short] > i
            whole[has] = mix(whole[has] * np.uint64(0x9E3779B97F4A7C15) + w.hash[w.first[:-1][short[has]] + i])
        value, row = np.concatenate((value, whole)), np.concatenate((row, short))
    order = np.lexsort((value, row))
    value, row = value[order], row[order]
    if len(value):
        new = np.concatenate(([True], (value[1:] != value[:-1]) | (row[1:] != row[:-1])))
        value, row = value[new], row[new]
    return value, np.searchsorted(row, np.arange(len(offsets)))


def _sums(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(values, dtype=np.uint64)))
    return total[first[1:]] - total[first[:-1]]


def _digests(value: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit digests of each set: a set is told apart by both."""
    n = np.diff(first).astype(np.uint64)
    one, two = _sums(mix(value), first), _sums(mix(value ^ np.uint64(0xD6E8FEB86659FD93)), first)
    return mix(one + n).view(np.int64), mix(two).view(np.int64)


def _facts(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lo, hi, data, offsets in slices(batch.column("text")):
            value, first = shingles(data, offsets, k)
            one, two = _digests(value, first)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(lo, hi - lo), pa.array(np.diff(first).astype(np.int64)), pa.array(one), pa.array(two)], names=["doc_id", "n", "key", "check"])


def _probes(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    """(h, key, many) of the probed shingles: a row per shingle and chunk of a task, many if several sets of the chunk have it."""
    limit = np.uint64(int(PROBE * (1 << 64)))
    seen: set[tuple[int, int]] = set()
    held: list[tuple[np.ndarray, np.ndarray]] = []

    def out() -> pa.RecordBatch:
        h, key = (np.concatenate([x[i] for x in held]) for i in (0, 1))
        order = np.argsort(h, kind="stable")
        h, key = h[order], key[order]
        begin = np.flatnonzero(np.concatenate(([True], h[1:] != h[:-1])))
        return pa.RecordBatch.from_arrays([pa.array(h[begin].view(np.int64)), pa.array(key[begin]), pa.array(np.diff(np.append(begin, len(h))) > 1)], names=["h", "key", "many"])

    for batch in batches:
        for _, _, data, offsets in slices(batch.column("text")):
            value, first = shingles(data, offsets, k)
            key, check = _digests(value, first)
            new = np.zeros(len(key), bool)
            for i, pair in enumerate(zip(key.tolist(), check.tolist(), strict=True)):
                if pair not in seen:
                    seen.add(pair)
                    new[i] = True
            row = np.repeat(np.arange(len(key)), np.diff(first))
            keep = new[row] & (value < limit)
            if keep.any():
                held.append((value[keep], key[row[keep]]))
            if sum(len(x[0]) for x in held) >= CHUNK:
                yield out()
                held = []
    if held:
        yield out()


def _sets(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    """(node, n, shingles) of the texts whose digests are those asked for; of repeated ones in a task the first."""
    seen: set[int] = set()
    for batch in batches:
        for lo, hi, data, offsets in slices(batch.column("text")):
            value, first = shingles(data, offsets, k)
            key, check = _digests(value, first)
            part = batch.slice(lo, hi - lo)
            right = (key == part.column("key").to_numpy()) & (check == part.column("check").to_numpy())
            nodes = part.column("node").to_numpy()
            rows = []
            for i in np.flatnonzero(right):
                if int(nodes[i]) not in seen:
                    seen.add(int(nodes[i]))
                    rows.append(i)
            packed = [value[first[i] : first[i + 1]].tobytes() for i in rows]
            rows = np.array(rows, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(nodes[rows], pa.int64()), pa.array(np.diff(first)[rows], pa.int64()), pa.array(packed, pa.binary())], names=["node", "n", "shingles"])


def _unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lo, hi, data, _ in slices(batch.column("shingles"), 1 << 23):
            n = batch.column("n").slice(lo, hi - lo).to_numpy()
            yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(data, np.int64)), pa.array(np.repeat(batch.column("node").slice(lo, hi - lo).to_numpy(), n)), pa.array(np.repeat(n, n))], names=["h", "node", "n"])


class RTree:
    """Packed R-tree over count vectors of sets, ordered by size; nodes hold the greatest counts and the range of sizes."""

    def __init__(self, counts: np.ndarray, sizes: np.ndarray):
        self.counts, self.sizes = counts, sizes
        starts = np.arange(0, len(sizes), FANOUT)
        self.levels = [(np.maximum.reduceat(counts, starts), np.minimum.reduceat(sizes, starts), np.maximum.reduceat(sizes, starts))]
        while len(self.levels[-1][1]) > FANOUT:
            top, low, high = self.levels[-1]
            starts = np.arange(0, len(low), FANOUT)
            self.levels.append((np.maximum.reduceat(top, starts), np.minimum.reduceat(low, starts), np.maximum.reduceat(high, starts)))

    def within(self, counts: np.ndarray, size: int, percent: int) -> np.ndarray:
        """Entries that the bound does not exclude."""
        at = np.arange(len(self.levels[-1][1]))
        for depth in range(len(self.levels) - 1, -1, -1):
            top, low, high = (x[at] for x in self.levels[depth])
            fit = (100 * low <= size * 100 * 100 // percent) & (100 * high >= percent * size)
            fit[fit] = np.minimum(top[fit], counts).sum(1) >= least_overlap(size + np.maximum(low[fit], -(-percent * size // 100)), percent)
            at = (at[fit][:, None] * FANOUT + np.arange(FANOUT)).ravel()
            at = at[at < (len(self.sizes) if depth == 0 else len(self.levels[depth - 1][1]))]
        fit = np.minimum(self.counts[at], counts).sum(1) >= least_overlap(size + self.sizes[at], percent)
        return at[fit]


def _overlap(a: np.ndarray, b: np.ndarray) -> int:
    if len(a) > len(b):
        a, b = b, a
    at = np.minimum(np.searchsorted(b, a), len(b) - 1)
    return int((b[at] == a).sum())


class Labels:
    """Labels of connected members; the smaller of two groups is relabelled, so all unions together take n log n steps."""

    def __init__(self, n: int):
        self.of, self.members = np.arange(n), [[i] for i in range(n)]

    def union(self, i: int, j: int) -> None:
        a, b = int(self.of[i]), int(self.of[j])
        if len(self.members[a]) < len(self.members[b]):
            a, b = b, a
        self.of[self.members[b]] = a
        self.members[a] += self.members[b]
        self.members[b] = []


def linked(sets: list[np.ndarray], left: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """Links that connect all that the join of the left sets with all sets connects: a spanning forest of them."""
    if len(sets) < 2:
        return []
    sizes = np.array([len(s) for s in sets])
    order = np.argsort(sizes, kind="stable")
    counts = np.array([np.bincount((s >> np.uint64(58)).astype(np.int64), minlength=DIMENSIONS) for s in sets], np.int32)
    tree, found = RTree(counts[order], sizes[order]), []
    labels = Labels(len(sets))
    for q in np.flatnonzero(left):
        near = order[tree.within(counts[q], int(sizes[q]), percent)]
        near = near[labels.of[near] != labels.of[q]]
        while len(near):
            other, near = near[0], near[1:]
            if 100 * (both := _overlap(sets[q], sets[other])) >= percent * (int(sizes[q] + sizes[other]) - both):
                found.append((int(q), int(other)))
                labels.union(int(q), int(other))
                near = near[labels.of[near] != labels.of[q]]
    return found


def _verified(members: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) among members (block, part, node, left): within a part of a block, left members against all."""
    rows = members.join(sets, "node").select("block", "part", "node", "left", "shingles")

    def verify(block: pa.Table) -> pa.Table:
        nodes, left = block.column("node").to_numpy(), block.column("left").to_numpy()
        held = [np.frombuffer(s.as_buffer(), np.uint64) for s in block.column("shingles")]
        part = block.column("part").to_numpy()
        order = np.argsort(part, kind="stable")
        links: list[tuple[int, int]] = []
        for own in np.split(order, np.flatnonzero(np.diff(part[order])) + 1):
            links += [(own[i], own[j]) for i, j in linked([held[i] for i in own], left[own], percent)]
        a, b = (nodes[np.array([x[s] for x in links], np.int64)] for s in (0, 1))
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return rows.groupBy("block").applyInArrow(verify, "a long, b long")


def _band(percent: int) -> Column:
    """Band of sizes (n): linked sets are in one band or in neighbouring ones."""
    return F.floor(F.log(F.col("n").cast("double")) / (float(np.log(100 / percent)) + 1e-9)).cast("int")


def rarest(rows: DataFrame, percent: int) -> DataFrame:
    """(h, node, n, most) of the shingles by which a set of rows (h, node, n) may meet others: most is the greatest size of a partner.

    In the order of frequency, then of hashes, a pair's first common shingle at
    place i (from 0) of a set of n leaves it n - i shingles to share at most.
    Shingles of one set alone come first in each, and meet nothing.
    """
    often = written(rows.groupBy("h").agg(F.count(F.lit(1)).alias("c")).where("c > 1"), "often")
    shared = rows.join(often, "h")
    of = W.partitionBy("node")
    # repeated rows of a set have one rank
    shared = shared.withColumn("rank", F.dense_rank().over(of.orderBy("c", "h"))).withColumn("shared", F.max("rank").over(of))
    most = F.expr(f"(shared - rank + 1) * {100 + percent} div {percent} - n")
    return shared.withColumn("most", most).where(f"100 * most >= {percent} * n").select("h", "node", "n", "most")


def _stars(marks: DataFrame, percent: int) -> DataFrame:
    """Edges (a, b) that connect all sets of marks which share a shingle and whose sizes may link."""
    marks = marks.withColumn("band", _band(percent))
    # of a pair the smaller set (or either of two equal ones) may have a partner of its own size or above
    low = written(marks.groupBy("h").agg(F.min(F.expr("if(most >= n, n, null)")).alias("low"), F.min("node").alias("x"), F.max("node").alias("y")).where("low is not null and x < y").select("h", "low"), "low")
    kept = written(marks.join(low, "h").where("most >= low").select("h", "band", "node"), "kept")
    leaders = written(kept.groupBy("h", "band").agg(F.min("node").alias("leader")), "leaders")
    within = kept.join(leaders, ["h", "band"]).select(F.col("node").alias("a"), F.col("leader").alias("b"))
    above = leaders.select("h", (F.col("band") - 1).alias("band"), F.col("leader").alias("a")).join(leaders, ["h", "band"]).select("a", F.col("leader").alias("b"))
    return within.union(above).where("a <> b").distinct()


def _cells(found: DataFrame, percent: int, cell: int) -> DataFrame:
    """Members (node, n, label) of large components with their cell: a band of sizes, cut by hash into parts of about cell shingles."""
    found = found.withColumn("band", _band(percent))
    parts = found.groupBy("label", "band").agg(F.ceil(F.sum("n") / cell).cast("int").alias("parts"), F.min("node").alias("leader"))
    return found.join(parts, ["label", "band"]).withColumn("at", F.pmod(F.xxhash64("node", F.lit("cell")), F.col("parts")).cast("int"))


def near_duplicates(docs: DataFrame, k: int = WORDS, percent: int = PERCENT, cell: int = CELL) -> DataFrame:
    """Per row of docs: doc_id, n_shingles and component_id, the least doc_id that links reach.

    Sets of shingles are linked if 100 * intersection >= percent * union; a text of
    fewer than k words is one shingle. Null texts and texts without words are
    empty and linked with nothing, also not with each other. Rows of one doc_id
    count as one document; rows with a null id are linked with nothing and have
    a null component_id. doc_id must be a whole number. An empty table stays
    empty. Shingles are told apart by 64 bits of hash, sets by 128.
    """
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    facts = written(texts.mapInArrow(lambda b: _facts(b, k), "doc_id long, n long, key long, check long"), "facts")
    classes = facts.where("n > 0 and doc_id is not null").groupBy("key", "check").agg(F.min("doc_id").alias("id"), F.first("n").alias("n"))
    # sets that differ but agree in one digest are nodes of their own, and always go on
    twin = F.count(F.lit(1)).over(W.partitionBy("key")) > 1
    classes = written(classes.withColumn("twin", twin).withColumn("node", F.when(F.col("twin"), F.xxhash64("key", "check")).otherwise(F.col("key"))), "classes")

    probes = texts.where("doc_id is not null").mapInArrow(lambda b: _probes(b, k), "h long, key long, many boolean")
    alone = probes.groupBy("h").agg(F.min("key").alias("key"), F.max("key").alias("other"), F.max("many").alias("many")).where("key = other and not many")
    alone = alone.groupBy("key").agg(F.count(F.lit(1)).alias("alone"))
    asked = classes.join(alone, "key", "left").where(f"twin or 100 * (n - coalesce(alone, 0)) >= {percent} * n").select("id", "key", "check", "node")
    asked = written(asked, "asked")
    sets = written(texts.withColumnRenamed("doc_id", "id").join(asked.hint("shuffle_hash"), "id").mapInArrow(lambda b: _sets(b, k), "node long, n long, shingles binary"), "sets")

    groups = components(_stars(written(rarest(sets.mapInArrow(_unpacked, "h long, node long, n long"), percent), "marks"), percent))
    found = written(groups.join(classes, "node").select("node", "n", "label"), "found")
    sizes = written(found.groupBy("label").agg(F.sum("n").alias("size")), "sizes")
    small = found.join(sizes.where(F.col("size") <= cell).select("label"), "label")
    large = found.join(sizes.where(F.col("size") > cell).select("label"), "label")

    blocks = max(1, -(-(small.agg(F.sum("n")).first()[0] or 0) // cell))
    sets = sets.select("node", "shingles")
    links = _verified(small.select(F.pmod(F.xxhash64("label"), F.lit(blocks)).cast("string").alias("block"), F.col("label").alias("part"), "node", F.lit(True).alias("left")), sets, percent)
    if large.limit(1).count():
        links = links.union(_large(large, sets, percent, cell))
    # rows that share an id are one document, so ids are the nodes from here on
    a, b = (classes.select(F.col("node").alias(x), F.col("id").alias(f"{x}_id")) for x in ("a", "b"))
    merged = components(written(links, "links").join(a, "a").join(b, "b").select(F.col("a_id").alias("a"), F.col("b_id").alias("b")))

    named = facts.join(classes.select("key", "check", "id"), ["key", "check"], "left").join(merged, F.col("id") == F.col("node"), "left")
    component = F.when(F.col("n") == 0, F.col("doc_id")).otherwise(F.coalesce("label", "id"))
    return named.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), component).alias("component_id"))


def _large(large: DataFrame, sets: DataFrame, percent: int, cell: int) -> DataFrame:
    """Links of large components: leaders against their bands, then the cells that still have members apart."""
    cells = written(_cells(large, percent, cell), "cells")
    name = F.concat_ws("/", "label", "band", "at")
    members = cells.select(name.alias("block"), "node", F.lit(False).alias("left"))
    leaders = cells.select(name.alias("block"), F.col("leader").alias("node"), F.lit(True).alias("left")).distinct()
    first = members.union(leaders).groupBy("block", "node").agg(F.max("left").alias("left")).withColumn("part", F.lit(0).cast("long"))
    starred = written(_verified(first, sets, percent), "starred")
    held = starred.select(F.col("b").alias("node")).union(starred.select(F.col("a").alias("node"))).distinct().withColumn("held", F.lit(True))
    cells = written(cells.drop("parts", "at").join(held, "node", "left").withColumn("held", F.coalesce("held", F.lit(False))), "cells")

    # cells anew, apart for held and other members; two held cells of one band need not meet
    parts = cells.groupBy("label", "band", "held").agg(F.ceil(F.sum("n") / cell).cast("int").alias("parts"))
    here = cells.join(parts, ["label", "band", "held"]).withColumn("at", F.pmod(F.xxhash64("node", F.lit("cell")), F.col("parts")).cast("int"))
    spots = parts.withColumn("at", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).select("label", "band", "held", "at")
    one = spots.select("label", *[F.col(c).alias(f"{c}1") for c in ("band", "held", "at")])
    two = spots.select("label", *[F.col(c).alias(f"{c}2") for c in ("band", "held", "at")])
    # pairs of cells, not of rows: (band, held, at) in order, bands next to each other
    near = one.withColumn("band2", F.explode(F.array("band1", F.col("band1") + 1))).join(two, ["label", "band2"])
    near = near.where("(band1 < band2 or struct(held1, at1) <= struct(held2, at2)) and not (band1 = band2 and held1 and held2)")
    near = near.withColumn("block", F.concat_ws("/", "label", "band1", "held1", "at1", "band2", "held2", "at2"))
    a = near.select("block", "label", F.col("band1").alias("band"), F.col("held1").alias("held"), F.col("at1").alias("at"), F.lit(True).alias("left"))
    b = near.select("block", "label", F.col("band2").alias("band"), F.col("held2").alias("held"), F.col("at2").alias("at"), F.lit(False).alias("left"))
    sent = here.join(a.union(b), ["label", "band", "held", "at"]).groupBy("block", "node").agg(F.max("left").alias("left")).withColumn("part", F.lit(0).cast("long"))
    return starred.union(_verified(sent, sets, percent))


OP5_SQL = """
WITH RECURSIVE d AS (
  SELECT row_number() OVER () AS r, doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents
), s AS (
  SELECT DISTINCT r, array_to_string(w[i:i + 3], ' ') AS shingle FROM d, unnest(range(1, greatest(len(w) - 2, 2))) AS u(i) WHERE len(w) > 0
), n AS (
  SELECT r, count(*) AS n, hash(list(shingle ORDER BY shingle)) AS whole FROM s GROUP BY r
), class AS (
  SELECT whole, min(r) AS c, any_value(n) AS n FROM n GROUP BY whole
), t AS (
  SELECT c, n, shingle FROM s JOIN class ON r = c
), pair AS (
  SELECT a.c AS a, b.c AS b FROM t a JOIN t b ON a.shingle = b.shingle AND a.c < b.c GROUP BY a.c, b.c, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))
), node AS (
  SELECT r, c, doc_id FROM n JOIN class USING (whole) JOIN d USING (r)
), edge AS (
  SELECT a, b FROM pair UNION SELECT b, a FROM pair
), reach AS (
  SELECT c AS a, c AS b FROM class
  UNION SELECT reach.a, edge.b FROM reach JOIN edge ON reach.b = edge.a
), least AS (
  SELECT reach.a AS c, min(doc_id) AS component FROM reach JOIN node ON node.c = reach.b GROUP BY reach.a
)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, CASE WHEN d.doc_id IS NOT NULL THEN coalesce(least.component, d.doc_id) END AS component_id
FROM d LEFT JOIN n USING (r) LEFT JOIN node USING (r) LEFT JOIN least ON node.c = least.c
"""


def op5_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
