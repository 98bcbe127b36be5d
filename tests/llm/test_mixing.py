import numpy as np
import pytest
from pyspark.sql import functions as F

from furrow.llm.mixing import DOMAINS, FIT, copies, fit_rates, memberships, mix_to_targets


def members(spark, n=400):
    rng = np.random.default_rng(1)
    p = rng.dirichlet([4, 0.5, 0.7], n)
    rows = [(i, int(t), *map(float, q)) for i, (t, q) in enumerate(zip(rng.integers(0, 900, n), p))]
    return spark.createDataFrame(rows, "doc_id long, n_tokens long, " + ", ".join(f"p_{d} double" for d in DOMAINS)).cache()


@pytest.mark.parametrize("targets", [{"clean": 0.97, "toxic": 0.02, "junk": 0.01}, {"clean": 0.8, "toxic": 0.1, "junk": 0.1}, {"clean": 1.0}])
def test_totals_come_close_to_the_targets(spark, targets):
    rated = fit_rates(members(spark), targets).toPandas()
    assert rated.rate.between(0, 1).all()
    p, tokens = rated[[f"p_{d}" for d in DOMAINS]].to_numpy(), rated.n_tokens.to_numpy()
    natural = p.T @ tokens
    scale = natural[0] / targets["clean"]
    want = np.array([min(targets[d] * scale, natural[i]) if d in targets else natural[i] for i, d in enumerate(DOMAINS)])

    def cost(rate):
        return ((((p.T @ (rate * tokens)) - want) / natural) ** 2).sum()

    best = np.ones(len(p))
    for _ in range(5000):
        best = np.clip(best - 0.5 * p @ ((p.T @ (best * tokens) - want) / natural), 0, 1)
    assert cost(rated.rate.to_numpy()) <= 1.2 * cost(best) + 1e-4
    assert cost(best) <= cost(np.ones(len(p))) + 1e-12
    assert np.allclose(rated.misfit, np.abs(p.T @ (rated.rate.to_numpy() * tokens) - want).max() / natural.sum())


def test_copies_keep_the_expectation(spark):
    got = spark.range(20_000).select(F.sum(copies(F.lit(0.3), "id")).alias("a"), F.sum(copies(F.lit(1.0), "id")).alias("b"), F.sum(copies(F.lit(0.0), "id")).alias("c"), F.sum(copies(F.lit(2.5), "id")).alias("d")).first()
    assert abs(got.a - 6000) < 300 and got.b == 20_000 and got.c == 0 and abs(got.d - 50_000) < 400


def test_edges(spark):
    docs = spark.createDataFrame([(1, None), (2, ""), (None, "a b c"), (3, "idiot " * 40_000), (3, "idiot")], "doc_id long, text string").selectExpr("*", "1 as rate")
    labels = spark.createDataFrame([(1, 1, 0), (3, 1, 1), (3, 1, 1), (None, 1, 0), (4, None, 1)], "doc_id long, quality int, toxic int")
    out = mix_to_targets(docs, labels).collect()
    assert len(out) == 5 and all(abs(r.p_clean + r.p_toxic + r.p_junk - 1) < 1e-9 and 0 <= r.rate <= 1 for r in out)
    assert {r.copies for r in out} <= {0, 1} and len({r.misfit for r in out}) == 1
    assert mix_to_targets(docs.limit(0), labels.limit(0)).count() == 0


def test_posteriors_are_those_of_a_plain_learner(spark):
    from tests.llm.test_quality import plain_scores

    rows = [(i, f"w{i % 7} w{i % 5} plain text number{i % 3}") for i in range(40)] + [(100 + i, f"idiot w{i % 4} fool") for i in range(15)] + [(200 + i, "%% $$ w1 w2") for i in range(9)] + [(300, None)]
    labels = [(i, 1, 0) for i in range(0, 40, 2)] + [(100 + i, 1, 1) for i in range(12)] + [(200 + i, 0, i % 2) for i in range(6)] + [(300, 1, 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    domain = {i: (q == 1 and not t, q == 1 and t == 1, q == 0) for i, q, t in labels}
    each = plain_scores(spark, rows, domain, l1=FIT["l1"], alpha=FIT["alpha"], share=False)
    for r in memberships(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect():
        p = np.array(each[r.doc_id])
        assert np.allclose([r.p_clean, r.p_toxic, r.p_junk], p / p.sum(), atol=1e-5)
