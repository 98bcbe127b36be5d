"""Mixing to target weights by soft membership.

A classifier fitted on the labelled table gives every document a posterior over
domains (clean, toxic, junk). Projected-gradient least squares then finds a rate
in [0, max_rate] for every document, so that the rates' expected token totals by
domain match the targets. Each step sums K numbers over all documents; a rate is
recomputed from the few K-vectors of the steps so far, so no state is kept.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from furrow.llm.folder import table, written
from furrow.llm.linear import MAX_LABELLED, margins, sigmoid, train
from furrow.llm.words import slices, words

DOMAINS = ("clean", "toxic", "junk")
#: Share of each domain's expected tokens in the mixture.
TARGETS = {"clean": 0.97, "toxic": 0.02, "junk": 0.01}
STEPS = 30
FIT = {"weigh": "count", "l1": 3.0, "alpha": 0.3}
CLOSE = 1e-4


def memberships(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED) -> DataFrame:
    """Per row of docs: doc_id, n_tokens (words; null text: 0), and p_<domain> that sum to 1.

    Domains come of labels (doc_id, quality, toxic): junk if quality is 0, else
    toxic if toxic is 1, else clean; rows with a null label are left out.
    """
    domain = F.when(F.col("quality") == 0, "junk").when(F.col("toxic") == 1, "toxic").otherwise("clean")
    y = labels.where("quality is not null and toxic is not null").select("doc_id", F.array(*[(domain == d).cast("double") for d in DOMAINS]).alias("y"))
    model = docs.sparkSession.sparkContext.broadcast(train(docs, y, len(DOMAINS), max_labelled, **FIT))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            each = sigmoid(margins(batch.column("text"), model.value, FIT["weigh"]))
            p = each / each.sum(1, keepdims=True)
            n = np.concatenate([np.zeros(0, np.int64), *(words(data, offsets).counts for _, _, data, offsets in slices(batch.column("text")))])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n.astype(np.int64)), *(pa.array(p[:, k].copy()) for k in range(len(DOMAINS)))], names=["doc_id", "n_tokens", *(f"p_{d}" for d in DOMAINS)])

    kind = dict(docs.dtypes)["doc_id"]
    return docs.select("doc_id", F.col("text").cast("binary").alias("text")).mapInArrow(score, f"doc_id {kind}, n_tokens long, " + ", ".join(f"p_{d} double" for d in DOMAINS))


def _rate(steps: list[np.ndarray], max_rate: float) -> Column:
    """The rate after the steps: from 1, each step moves it along the posterior and clips it."""
    if not steps:
        return F.lit(1.0)
    moves = ",".join("array(" + ",".join(f"{x!r}D" for x in map(float, v)) + ")" for v in steps)
    along = " + ".join(f"p_{d} * v[{k}]" for k, d in enumerate(DOMAINS))
    return F.expr(f"aggregate(array({moves}), 1.0D, (r, v) -> least({max_rate!r}D, greatest(0.0D, r - ({along}))))")


def fit_rates(members: DataFrame, targets: dict[str, float], anchor: str = "clean", max_rate: float = 1.0, steps: int = STEPS) -> DataFrame:
    """members with rate, such that the expected totals sum(rate * n_tokens * p_d) match the targets, and misfit.

    misfit is the greatest difference of a domain's total from its target, as a
    share of all tokens, the same in every row: at most CLOSE, unless no rates
    within the bounds come closer or the steps were used up before.

    Minimised are the squared differences of the totals, each relative to its
    domain's natural total. The targets are shares; their scale is such that the anchor's target is all
    of its expected tokens, and no target exceeds max_rate times what there is
    of its domain. A domain without a target, or without tokens, keeps its natural total.
    """
    k = range(len(DOMAINS))
    moments = members.agg(
        *[F.sum(F.expr(f"n_tokens * p_{d}")).alias(f"e{i}") for i, d in enumerate(DOMAINS)],
        *[F.sum(F.expr(f"n_tokens * p_{DOMAINS[i]} * p_{DOMAINS[j]}")).alias(f"m{i}_{j}") for i in k for j in k],
    ).first()
    natural = np.array([moments[f"e{i}"] or 0.0 for i in k])
    total = natural.sum()
    if total == 0:
        return members.withColumns({"rate": F.lit(1.0), "misfit": F.lit(0.0)})
    scale = natural[DOMAINS.index(anchor)] / targets[anchor]
    want = np.array([min(targets[d] * scale, max_rate * natural[i]) if d in targets else natural[i] for i, d in enumerate(DOMAINS)])
    gram = np.array([[moments[f"m{i}_{j}"] for j in k] for i in k]) / total
    # residuals count relative to what there is of a domain; the step is the greatest that is safe
    weigh = np.array([total / e if e > 0 else 0.0 for e in natural])
    root = np.sqrt(weigh)
    step = 1 / max(np.linalg.eigvalsh(root[:, None] * gram * root).max(), 1e-12)
    taken: list[np.ndarray] = []
    have = natural
    cost = lambda totals: float((weigh * (totals - want) ** 2).sum())
    for _ in range(steps):
        if np.abs(have - want).max() <= CLOSE * total:
            break
        tried = [*taken, step * weigh * (have - want) / total]
        rate = _rate(tried, max_rate)
        sums = members.select("n_tokens", *[f"p_{d}" for d in DOMAINS], rate.alias("rate")).agg(*[F.sum(F.expr(f"rate * n_tokens * p_{d}")) for d in DOMAINS]).first()
        # rates at their bounds no longer move, so a longer step may do; one that does harm is taken back
        if cost(got := np.array(list(sums))) < cost(have):
            taken, have, step = tried, got, 2 * step
        else:
            step /= 4
    return members.withColumns({"rate": _rate(taken, max_rate), "misfit": F.lit(float(np.abs(have - want).max() / total))})


def copies(rate: Column, key: str = "doc_id") -> Column:
    """Whole copies of a document: the rate, rounded up or down by a hash of its id in proportion."""
    chance = F.pmod(F.xxhash64(key, F.lit("mix")), F.lit(1 << 32)) / float(1 << 32)
    return (F.floor(rate) + (chance < rate - F.floor(rate)).cast("long")).cast("long")


def mix_to_targets(docs: DataFrame, labels: DataFrame, targets: dict[str, float] = TARGETS, anchor: str = "clean", max_rate: float = 1.0) -> DataFrame:
    """Per row of docs: doc_id, n_tokens, p_<domain>, rate, misfit (see fit_rates) and copies. Null and empty texts weigh nothing; repeated rows weigh as they come."""
    rated = fit_rates(written(memberships(docs, labels), "memberships"), targets, anchor, max_rate)
    return rated.withColumn("copies", copies(F.col("rate")))


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_to_targets(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
