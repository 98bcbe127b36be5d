"""Substring deduplication by FM-indexes of shards.

A word is removed if a window of LENGTH words that covers it also starts in a
document of a smaller doc_id. Every window has an anchor, its least hash of ANCHOR
consecutive words; windows that are equal have equal anchors. Runs of windows
whose anchor occurs in several texts go, with their words, to the shard of the
anchor. There a compressed FM-index over the shard's runs is searched backwards
with each run, and the intervals of at least LENGTH words that an earlier
document has are reported. An anchor with more than HOT words of runs would fill
a shard by itself: its runs are dealt to several tasks, and each of these
indexes what the runs have in common, which is the windows of several documents,
once, as it stands in the first of these.

Copies of a text are one text from the start: all but the first lose all their
words if they have LENGTH or more.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from furrow.llm.fmindex import FMIndex, earlier_intervals
from furrow.llm.folder import table, written
from furrow.llm.words import Words, mix, ngrams, slices, words

LENGTH = 50
ANCHOR = 8
#: Words of a shard; its index takes some 100 bytes a word while it is built.
SHARD = 400_000
#: Words of an anchor's runs from which they are dealt to several tasks.
HOT = 100_000
_RUNS = "anchor long, node long, id long, start long, n long, text binary"


def _keys(w: Words) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit digests of each row's sequence of words."""
    place = np.arange(len(w.hash)) - np.repeat(w.first[:-1], w.counts)
    out = []
    for salt in (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93):
        each = mix(w.hash + mix(place.astype(np.uint64) * np.uint64(salt | 1) + np.uint64(salt & 0xFFFF)))
        total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(each, dtype=np.uint64)))
        out.append(mix(total[w.first[1:]] - total[w.first[:-1]] + w.counts.astype(np.uint64)).view(np.int64))
    return out[0], out[1]


def _window_anchors(w: Words, length: int, anchor: int) -> tuple[np.ndarray, np.ndarray]:
    """The anchor of each window of length words, and first[r] of windows."""
    grams, gram_first = ngrams(w, anchor)
    span = length - anchor + 1
    per_row = np.maximum(np.diff(gram_first) - span + 1, 0)
    first = np.concatenate(([0], np.cumsum(per_row)))
    if not first[-1]:
        return np.zeros(0, np.uint64), first
    least, width = grams, 1
    while 2 * width <= span:
        least = np.minimum(least[: len(least) - width], least[width:])
        width *= 2
    if width < span:
        n = len(grams) - span + 1
        least = np.minimum(least[:n], least[span - width : span - width + n])
    at = np.arange(first[-1]) + np.repeat(gram_first[:-1] - first[:-1], per_row)
    return least[at], first


def _facts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lo, hi, data, offsets in slices(batch.column("text")):
            w = words(data, offsets)
            key, check = _keys(w)
            raw, base = data.tobytes(), offsets[0]
            kept = [hashlib.sha256(b" ".join(raw[a - base : b - base].split())).hexdigest() for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").slice(lo, hi - lo), pa.array(w.counts.astype(np.int64)), pa.array(key), pa.array(check), pa.array(kept)], names=["doc_id", "n_words", "key", "check", "whole"]
            )


def _anchors(batches: Iterator[pa.RecordBatch], length: int, anchor: int) -> Iterator[pa.RecordBatch]:
    """(anchor, key, check) of the texts' runs of windows; of copies in a task the first."""
    seen: set[tuple[int, int]] = set()
    for batch in batches:
        for _, _, data, offsets in slices(batch.column("text")):
            w = words(data, offsets)
            value, first = _window_anchors(w, length, anchor)
            if not len(value):
                continue
            key, check = _keys(w)
            fresh = np.zeros(len(key), bool)
            for i in np.flatnonzero(np.diff(first)).tolist():
                if (pair := (int(key[i]), int(check[i]))) not in seen:
                    seen.add(pair)
                    fresh[i] = True
            row = np.repeat(np.arange(len(key)), np.diff(first))
            new = np.concatenate(([True], (value[1:] != value[:-1]) | (row[1:] != row[:-1]))) & fresh[row]
            yield pa.RecordBatch.from_arrays([pa.array(value[new].view(np.int64)), pa.array(key[row[new]]), pa.array(check[row[new]])], names=["anchor", "key", "check"])


def _asked_for(w: Words, part: pa.RecordBatch) -> np.ndarray:
    """Rows whose text is the one asked for: another text under a repeated id has other digests."""
    key, check = _keys(w)
    return (key == part.column("key").to_numpy()) & (check == part.column("check").to_numpy())


def _stretches(place: np.ndarray, *same: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where stretches of consecutive places with equal values begin, and how many places each has."""
    new = np.concatenate(([True], np.diff(place) != 1))
    for x in same:
        new[1:] |= x[1:] != x[:-1]
    begin = np.flatnonzero(new)
    return begin, np.diff(np.append(begin, len(place)))


def _runs(batches: Iterator[pa.RecordBatch], length: int, anchor: int) -> Iterator[pa.RecordBatch]:
    """Runs of windows with one shared anchor: (anchor, node, id, start, n, text) with the text of their words."""
    for batch in batches:
        shared = batch.column("anchors")
        for lo, hi, data, offsets in slices(batch.column("text")):
            w = words(data, offsets)
            value, first = _window_anchors(w, length, anchor)
            part = shared.slice(lo, hi - lo)
            wanted = part.flatten().to_numpy().view(np.uint64)
            wanted_row = np.repeat(np.arange(hi - lo), part.value_lengths().to_numpy())
            row = np.repeat(np.arange(hi - lo), np.diff(first))
            right = _asked_for(w, batch.slice(lo, hi - lo))
            codes = np.unique(np.concatenate((wanted, value)), return_inverse=True)[1]
            keep = np.isin(codes[len(wanted) :] * (hi - lo) + row, codes[: len(wanted)] * (hi - lo) + wanted_row) & right[row]
            place = np.flatnonzero(keep)
            if not len(place):
                continue
            at, count = _stretches(place, value[place], row[place])
            begin = place[at]
            start = begin - first[row[begin]]
            word = w.first[row[begin]] + start
            n = count + length - 1
            raw = data.tobytes()
            texts = [raw[a:b] for a, b in zip(w.start[word].tolist(), w.end[word + n - 1].tolist(), strict=True)]
            rows = pa.array(row[begin] + lo)
            yield pa.RecordBatch.from_arrays(
                [pa.array(value[begin].view(np.int64)), batch.column("node").take(rows), batch.column("id").take(rows), pa.array(start), pa.array(n), pa.array(texts, pa.binary())],
                names=["anchor", "node", "id", "start", "n", "text"],
            )


def _matched(shard: pa.Table, length: int) -> pa.Table:
    """Intervals (node, start, end) of the runs asked that a run indexed for an earlier document has, by an FM-index of these."""
    ids, nodes, starts = (shard.column(c).to_numpy() for c in ("id", "node", "start"))
    indexed, asked = (np.flatnonzero(shard.column(c).to_numpy()) for c in ("indexed", "asked"))
    none = pa.table({"node": pa.array([], pa.int64()), "start": pa.array([], pa.int64()), "end": pa.array([], pa.int64())})
    if not len(indexed) or not len(asked):
        return none
    hashes, counts = [], []
    for _, _, data, offsets in slices(shard.column("text")):
        w = words(data, offsets)
        hashes.append(w.hash)
        counts.append(w.counts)
    count = np.concatenate(counts)
    symbols, text = np.unique(np.concatenate(hashes), return_inverse=True)
    text = text + 1
    first = np.concatenate(([0], np.cumsum(count)))
    owners = np.unique(ids, return_inverse=True)[1]

    def part(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        ends = np.concatenate(([0], np.cumsum(count[rows])))
        return text[np.arange(ends[-1]) - np.repeat(ends[:-1] - first[rows], count[rows])], ends

    # a 0 ends each run in the index
    held, ends = part(indexed)
    index = FMIndex(np.insert(held, ends[1:], 0), np.repeat(owners[indexed], count[indexed] + 1), len(symbols) + 1, length)
    q, a, b = earlier_intervals(index, *part(asked), owners[asked], length)
    q = asked[q]
    return pa.table({"node": pa.array(nodes[q], pa.int64()), "start": pa.array(starts[q] + a, pa.int64()), "end": pa.array(starts[q] + b, pa.int64())})


def _window_hashes(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """(window, id, node, run, start) of every window of the runs; run is where its run starts."""
    for batch in batches:
        for lo, hi, data, offsets in slices(batch.column("text")):
            value, first = ngrams(words(data, offsets), length)
            per_row = np.diff(first)
            row = np.repeat(np.arange(hi - lo), per_row)
            run = batch.column("start").slice(lo, hi - lo).to_numpy()[row]
            part = pa.array(row + lo)
            yield pa.RecordBatch.from_arrays(
                [pa.array(value.view(np.int64)), batch.column("id").take(part), batch.column("node").take(part), pa.array(run), pa.array(run + np.arange(len(value)) - first[row])], names=["window", "id", "node", "run", "start"]
            )


def _passages(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """Runs cut down to the windows that start at the places given (starts)."""
    for batch in batches:
        for lo, hi, data, offsets in slices(batch.column("text")):
            w = words(data, offsets)
            part = batch.slice(lo, hi - lo)
            starts = part.column("starts")
            row = np.repeat(np.arange(hi - lo), starts.value_lengths().to_numpy())
            place = starts.flatten().to_numpy() - part.column("start").to_numpy()[row] + w.first[row]
            order = np.argsort(place, kind="stable")
            row, place = row[order], place[order]
            at, count = _stretches(place, row)
            begin, n = place[at], count + length - 1
            raw, rows = data.tobytes(), pa.array(row[at])
            texts = [raw[a:b] for a, b in zip(w.start[begin].tolist(), w.end[begin + n - 1].tolist(), strict=True)]
            start = begin - w.first[row[at]] + part.column("start").to_numpy()[row[at]]
            yield pa.RecordBatch.from_arrays(
                [part.column("anchor").take(rows), part.column("node").take(rows), part.column("id").take(rows), pa.array(start), pa.array(n), pa.array(texts, pa.binary())],
                names=["anchor", "node", "id", "start", "n", "text"],
            )


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out: dict[str, list] = {"node": [], "n_removed": [], "kept": []}
        for lo, hi, data, offsets in slices(batch.column("text")):
            w = words(data, offsets)
            right = _asked_for(w, batch.slice(lo, hi - lo))
            raw = data.tobytes()
            for r in np.flatnonzero(right).tolist():
                gone = np.zeros(w.counts[r] + 1, np.int64)
                for span in batch.column("spans")[lo + r].as_py():
                    gone[span["start"]] += 1
                    gone[span["end"]] -= 1
                keep = np.flatnonzero(np.cumsum(gone)[:-1] == 0) + w.first[r]
                kept = b" ".join(raw[a:b] for a, b in zip(w.start[keep].tolist(), w.end[keep].tolist(), strict=True))
                for name, x in zip(out, (batch.column("node")[lo + r].as_py(), int(w.counts[r] - len(keep)), hashlib.sha256(kept).hexdigest()), strict=True):
                    out[name].append(x)
        yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(out.values(), (pa.int64(), pa.int64(), pa.string()), strict=True)], names=list(out))


def _dealt(many: DataFrame, length: int, shard: int) -> DataFrame:
    """Rows for _matched of the runs of hot anchors, in groups of about shard words that are asked and as many indexed."""
    many = written(many, "many")
    windows = many.mapInArrow(lambda b: _window_hashes(b, length), "window long, id long, node long, run long, start long")
    first = windows.groupBy("window").agg(F.min(F.struct("id", "node", "run", "start")).alias("own"), F.max("id").alias("last")).where("own.id < last")
    owned = first.groupBy("own.node", F.col("own.run").alias("start")).agg(F.collect_list("own.start").alias("starts"))  # as many as a text has windows
    common = written(many.join(owned, ["node", "start"]).mapInArrow(lambda b: _passages(b, length), _RUNS), "common")

    tasks = many.groupBy("anchor").agg(F.ceil(F.sum("n") / shard).cast("int").alias("tasks"))
    parts = common.groupBy("anchor").agg(F.ceil(F.sum("n") / shard).cast("int").alias("parts"))
    sizes = written(tasks.join(parts, "anchor"), "sizes")  # an anchor without common windows is done
    at = lambda c: F.pmod(F.xxhash64("node", "start", F.lit("deal")), F.col(c)).cast("int")
    every = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
    asked = many.join(sizes, "anchor").withColumn("task", at("tasks")).withColumn("part", every("parts"))
    indexed = common.join(sizes, "anchor").withColumn("part", at("parts")).withColumn("task", every("tasks"))
    both = asked.withColumns({"indexed": F.lit(False), "asked": F.lit(True)}).unionByName(indexed.withColumns({"indexed": F.lit(True), "asked": F.lit(False)}))
    return both.withColumn("shard", F.concat_ws("/", "anchor", "part", "task"))


def repeated_spans(docs: DataFrame, length: int = LENGTH, anchor: int = ANCHOR, hot: int = HOT, shard: int = SHARD) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(facts, classes, texts, spans): digests of all rows, their distinct texts, those that share anchors, and the intervals of words to remove by text (node)."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    facts = written(texts.mapInArrow(_facts, "doc_id long, n_words long, key long, check long, whole string"), "facts")
    classes = facts.where((F.col("n_words") >= length) & F.col("doc_id").isNotNull()).groupBy("key", "check").agg(F.min("doc_id").alias("id"))
    # texts that differ but agree in one digest are nodes of their own
    node = F.when(F.count(F.lit(1)).over(W.partitionBy("key")) > 1, F.xxhash64("key", "check")).otherwise(F.col("key"))
    classes = written(classes.withColumn("node", node), "classes")

    each = written(texts.where("doc_id is not null").mapInArrow(lambda b: _anchors(b, length, anchor), "anchor long, key long, check long"), "each")
    spread = each.groupBy("anchor").agg(*[f(c).alias(f"{c}{i}") for c in ("key", "check") for i, f in enumerate((F.min, F.max))]).where("key0 < key1 or check0 < check1").select("anchor")
    asked = each.join(written(spread, "spread"), "anchor").groupBy("key", "check").agg(F.collect_set("anchor").alias("anchors"))  # as many as a text has anchors
    asked = written(asked.join(classes, ["key", "check"]), "asked")
    chosen = written(texts.withColumnRenamed("doc_id", "id").join(asked.hint("shuffle_hash"), "id"), "chosen")

    runs = written(chosen.mapInArrow(lambda b: _runs(b, length, anchor), _RUNS), "runs")
    heavy = written(runs.groupBy("anchor").agg(F.sum("n").alias("words")).where(F.col("words") > hot).select("anchor"), "heavy")
    total = runs.agg(F.sum("n")).first()[0] or 0
    shards = max(1, -(-total // shard))
    few = runs.join(heavy, "anchor", "left_anti").withColumns({"indexed": F.lit(True), "asked": F.lit(True), "shard": F.pmod(F.xxhash64("anchor"), F.lit(shards)).cast("string")})
    columns = ["shard", "id", "node", "start", "text", "indexed", "asked"]
    matched = lambda df: df.select(*columns).groupBy("shard").applyInArrow(lambda t: _matched(t, length), "node long, start long, end long")
    spans = matched(few)
    if heavy.limit(1).count():
        spans = spans.union(matched(_dealt(runs.join(heavy, "anchor", "left_semi"), length, shard)))
    return facts, classes, chosen, spans


def dedup_substrings(docs: DataFrame, length: int = LENGTH, anchor: int = ANCHOR, hot: int = HOT, shard: int = SHARD) -> DataFrame:
    """Per row of docs: doc_id, n_words, n_removed and kept_sha256 of the kept words joined by single spaces.

    Null and empty texts have no words and keep none. Repeated rows of one id
    count as one document each: neither is earlier than the other. Rows with a
    null id come in no order: they lose nothing and take nothing from others.
    Words are told apart by 64 bits of hash, texts by 128. An empty table stays
    empty. A text of any length is read whole; its longest run is in one task.
    """
    facts, classes, chosen, spans = repeated_spans(docs, length, anchor, hot, shard)
    of = spans.groupBy("node").agg(F.collect_list(F.struct("start", "end")).alias("spans"))
    cut = chosen.select("key", "check", "node", "text").join(of, "node").mapInArrow(_cut, "node long, n_removed long, kept string")
    cut = cut.groupBy("node").agg(F.first("n_removed").alias("n_removed"), F.first("kept").alias("kept"))
    known = written(classes.join(cut, "node", "left").drop("node"), "known")
    both = facts.join(known, ["key", "check"], "left")
    copy = F.col("doc_id") > F.col("id")  # null for null ids and for texts under the length
    in_order = F.col("doc_id").isNotNull()
    return both.select(
        "doc_id", "n_words",
        F.when(copy, F.col("n_words")).when(in_order, F.coalesce("n_removed", F.lit(0))).otherwise(0).cast("long").alias("n_removed"),
        F.when(copy, F.sha2(F.lit(b""), 256)).when(in_order, F.coalesce("kept", "whole")).otherwise(F.col("whole")).alias("kept_sha256"),
    )


OP7_SQL = """
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents
), g AS (
  SELECT r, doc_id, i AS start, array_to_string(w[i:i + 49], ' ') AS window_ FROM d, unnest(range(1, len(w) - 48)) AS u(i) WHERE doc_id IS NOT NULL
), later AS (
  SELECT r, start FROM (SELECT r, doc_id, start, min(doc_id) OVER (PARTITION BY window_) AS least FROM g) WHERE least < doc_id
), gone AS (
  SELECT DISTINCT r, start + k AS i FROM later, range(50) AS t(k)
), lost AS (
  SELECT r, count(*) AS n, list(i) AS places FROM gone GROUP BY r
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n, 0) AS BIGINT) AS n_removed,
  sha256(array_to_string(CASE WHEN places IS NULL THEN w ELSE list_transform(list_filter(list_zip(w, range(1, len(w) + 1)), lambda x: NOT list_contains(places, x[2])), lambda x: x[1]) END, ' ')) AS kept_sha256
FROM d LEFT JOIN lost USING (r)
"""


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_substrings(table(spark, sf_dir, "documents"))
