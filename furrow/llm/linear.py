"""Hashed word n-gram logistic regression, trained by follow-the-regularised-leader.

A text's tokens are runs of letters and digits and runs of one symbol; a token
equal to the one before it becomes a repeat mark. Unigrams and bigrams of the
tokens are hashed into 2**BITS bins. An n-gram found c times among n weighs
SCALE * c / n ("share", for traits of a whole text) or c ("count", for traits
that a few words show). Null and empty texts have no n-gram and score by the
intercept.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from furrow.llm.words import TOKEN_CLASS, lists, mix, slices, words

BITS = 18
SCALE = 30.0
#: A classifier is fitted on so many labelled rows at most, those of the smallest hash.
MAX_LABELLED = 16_384
SHARDS = 4
_REPEAT = np.uint64(0x5851F42D4C957F2D)


def _bins(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bins of all n-grams of a slice, by row: all unigrams, then all bigrams; their rows; n-grams by row."""
    w = words(data, offsets, classes=TOKEN_CLASS)
    rows = len(offsets) - 1
    row = w.row
    h = w.hash.copy()
    if len(h) > 1:
        same = (w.hash[1:] == w.hash[:-1]) & (row[1:] == row[:-1])
        h[1:][same] = _REPEAT
        inside = row[1:] == row[:-1]
        two = mix(h[:-1] * np.uint64(3) + h[1:])[inside]
        both = np.concatenate((h, two))
        row = np.concatenate((row, row[1:][inside]))
    else:
        both = h
    return (both >> np.uint64(64 - BITS)).astype(np.int32), row, np.bincount(row, minlength=rows)


def _scale(n: np.ndarray, weigh: str) -> np.ndarray:
    return SCALE / np.maximum(n, 1) if weigh == "share" else np.ones(len(n))


def margins(column: pa.Array, weights: np.ndarray, weigh: str = "share") -> np.ndarray:
    """Sparse dot products of every text with each column of weights (2**BITS + 1 rows, the last the intercept)."""
    out = np.zeros((len(column), weights.shape[1]))
    for lo, hi, data, offsets in slices(column):
        bins, row, n = _bins(data, offsets)
        for k in range(weights.shape[1]):
            out[lo:hi, k] = np.bincount(row, weights[bins, k], minlength=hi - lo) * _scale(n, weigh)
    return out + weights[-1]


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def _features(batches: Iterator[pa.RecordBatch], weigh: str) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lo, hi, data, offsets in slices(batch.column("text")):
            bins, row, n = _bins(data, offsets)
            key, count = np.unique(row.astype(np.int64) << BITS | bins, return_counts=True)
            at = key >> BITS
            first = np.searchsorted(at, np.arange(hi - lo + 1))
            part = batch.slice(lo, hi - lo)
            yield pa.RecordBatch.from_arrays(
                [part.column("r"), part.column("y"), lists((key & ((1 << BITS) - 1)).astype(np.int32), first, pa.int32()), lists((count * _scale(n, weigh)[at]).astype(np.float32), first, pa.float32())],
                names=["r", "y", "bins", "x"],
            )


def ftrl(rows: Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]], outputs: int, alpha: float = 0.5, beta: float = 1.0, l1: float = 0.05, l2: float = 1.0) -> np.ndarray:
    """Per-coordinate FTRL-proximal over (bins, values, targets) in the order given."""
    z = np.zeros(((1 << BITS) + 1, outputs))
    n = np.zeros_like(z)

    def weights(zi: np.ndarray, ni: np.ndarray) -> np.ndarray:
        return np.where(np.abs(zi) <= l1, 0.0, -(zi - np.sign(zi) * l1) / ((beta + np.sqrt(ni)) / alpha + l2))

    for bins, x, y in rows:
        at = np.append(bins, 1 << BITS)
        x = np.append(x, 1.0)[:, None]
        zi, ni = z[at], n[at]
        w = weights(zi, ni)
        g = (sigmoid((w * x).sum(0)) - y) * x
        grown = ni + g * g
        z[at] = zi + g - (np.sqrt(grown) - np.sqrt(ni)) / alpha * w
        n[at] = grown
    return weights(z, n)


def train(docs: DataFrame, labelled: DataFrame, outputs: int, max_labelled: int = MAX_LABELLED, weigh: str = "share", l1: float = 0.05, alpha: float = 0.5) -> np.ndarray:
    """Weights (2**BITS + 1, outputs) from labelled (doc_id, y array<double>) and the texts of docs.

    Labelled rows with a null id or target are left out; of ids labelled more
    than once the greatest target counts. At most max_labelled rows, those of the
    smallest hash of their id, are used; every shard of them trains one model in
    hash order, and the shards' weights are averaged. Without labelled rows all
    weights are 0.
    """
    some = (
        labelled.where("doc_id is not null and y is not null").groupBy("doc_id").agg(F.max("y").alias("y"))
        .withColumn("r", F.xxhash64("doc_id", F.lit("train"))).orderBy("r").limit(max_labelled)
    )
    rows = docs.select("doc_id", F.col("text").cast("binary").alias("text")).join(F.broadcast(some), "doc_id")
    features = rows.select("r", "y", "text").mapInArrow(lambda batches: _features(batches, weigh), "r long, y array<double>, bins array<int>, x array<float>")

    def shard(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = [0]

        def each():
            for batch in batches:
                columns = [batch.column(k) for k in ("bins", "x", "y")]
                for i in range(batch.num_rows):
                    seen[0] += 1
                    yield tuple(c[i].values.to_numpy(zero_copy_only=False) for c in columns)

        w = ftrl(each(), outputs, alpha=alpha, l1=l1)
        at = np.flatnonzero(np.abs(w).sum(1))
        if seen[0]:
            at = np.union1d(at, [len(w) - 1])
            yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), lists(w[at].ravel(), np.arange(len(at) + 1) * outputs, pa.float64())], names=["bin", "w"])

    dealt = features.repartition(SHARDS, F.pmod("r", F.lit(SHARDS))).sortWithinPartitions("r")
    trained = dealt.mapInArrow(shard, "bin int, w array<double>")
    sums = trained.groupBy("bin").agg(*[F.sum(F.col("w")[k]).alias(f"w{k}") for k in range(outputs)], F.count(F.lit(1)).alias("n"))
    found = sums.toPandas()  # one row per bin, 2**BITS + 1 at most
    weights = np.zeros(((1 << BITS) + 1, outputs))
    if len(found):
        shards = found.loc[found.bin == 1 << BITS, "n"].max()
        weights[found.bin.to_numpy()] = found[[f"w{k}" for k in range(outputs)]].to_numpy() / shards
    return weights
