import math
import re
from collections import Counter

from pyspark.sql import functions as F

from furrow.llm.folder import table
from furrow.llm.linear import SCALE, SHARDS
from furrow.llm.quality import op3_quality_classifier, score_quality

SF = "/root/testdata/sf0.01"


def test_held_out_accuracy(spark):
    got = op3_quality_classifier(spark, SF).join(table(spark, SF, "labels"), "doc_id").where("held_out").toPandas()
    rank = got.score.rank()
    good = got.quality == 1
    auc = (rank[good].sum() - good.sum() * (good.sum() + 1) / 2) / (good.sum() * (~good).sum())
    assert auc > 0.95
    assert (got[good].predicted == 1).mean() > 0.95


def test_edges(spark):
    docs = spark.createDataFrame([(1, None, 0.5), (1, "", 0.5), (None, "a b", 0.5), (2, "x " * 50_000, 0.5), (2, "x " * 50_000, 0.5)], "doc_id long, text string, score double")
    labels = spark.createDataFrame([(1, 1), (2, 0), (2, 0), (None, 1), (9, None)], "doc_id long, quality int")
    rows = score_quality(docs, labels).collect()
    assert len(rows) == 5 and all(0 <= r.score <= 1 and r.predicted in (0, 1) for r in rows)
    by = {}
    for r in rows:
        by.setdefault(r.text, set()).add(r.score)
    assert all(len(s) == 1 for s in by.values()) and by[None] == by[""]
    assert score_quality(docs.limit(0), labels).count() == 0
    assert {r.score for r in score_quality(docs, labels.limit(0)).collect()} == {0.5}


def grams(text, share):
    """Weights of a text's unigrams and bigrams, by name instead of by bin; a token equal to the one before is a mark."""
    low = [m[0] for m in re.finditer(r"[A-Za-z0-9]+|([^A-Za-z0-9\s])\1*", text or "")]
    tokens = ["<again>" if i and t == low[i - 1] else t for i, t in enumerate(low)]
    found = Counter([(t,) for t in tokens] + list(zip(tokens, tokens[1:])))
    return {p: c * (SCALE / sum(found.values()) if share else 1.0) for p, c in found.items()}


def plain_scores(spark, rows, targets, l1=0.05, alpha=0.5, share=True, beta=1.0, l2=1.0):
    """Scores of FTRL-proximal as it is written down: a dictionary per shard, one coordinate at a time, then the mean of the shards' weights."""
    ids = spark.createDataFrame([(i,) for i in targets], "i long").select("i", F.xxhash64("i", F.lit("train")).alias("r"))
    dealt = ids.withColumn("shard", F.pmod(F.hash(F.pmod("r", F.lit(SHARDS))), F.lit(SHARDS))).collect()
    order, shard_of = {r.i: r.r for r in dealt}, {r.i: r.shard for r in dealt}
    texts = dict(rows)
    k = len(next(iter(targets.values())))
    models = []
    for shard in range(SHARDS):
        ids = sorted((i for i in targets if shard_of[i] == shard), key=order.get)
        z, n = Counter(), Counter()

        def weight(f):
            return 0.0 if abs(z[f]) <= l1 else -(z[f] - math.copysign(l1, z[f])) / ((beta + math.sqrt(n[f])) / alpha + l2)

        for i in ids:
            x = {**grams(texts[i], share), "one": 1.0}
            for out in range(k):
                w = {f: weight((f, out)) for f in x}
                miss = 1 / (1 + math.exp(-sum(w[f] * x[f] for f in x))) - float(targets[i][out])
                for f in x:
                    g = miss * x[f]
                    z[f, out] += g - (math.sqrt(n[f, out] + g * g) - math.sqrt(n[f, out])) / alpha * w[f]
                    n[f, out] += g * g
        if ids:
            models.append({f: weight(f) for f in list(z)})
    out = {}
    for i, t in rows:
        x = {**grams(t, share), "one": 1.0}
        out[i] = [1 / (1 + math.exp(-sum(x[f] * sum(m.get((f, j), 0.0) for m in models) / len(models) for f in x))) for j in range(k)]
    return out


def test_scores_are_those_of_a_plain_learner(spark):
    rows = [(i, f"w{i % 7} w{i % 5} some plain text") for i in range(40)] + [(100 + i, f"%% $$ w{i % 4} w{i % 4} w{i % 4}") for i in range(25)] + [(300, None), (301, "")]
    labels = [(i, 1) for i in range(0, 40, 2)] + [(100 + i, 0) for i in range(0, 25, 2)] + [(300, 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    expected = plain_scores(spark, rows, {i: (q,) for i, q in labels})
    for r in score_quality(docs, spark.createDataFrame(labels, "doc_id long, quality int")).collect():
        assert math.isclose(r.score, expected[r.doc_id][0], abs_tol=1e-5)
