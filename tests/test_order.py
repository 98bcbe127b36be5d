import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from furrow.operators import order
from furrow.operators.order import average_ranks, quantile_row, quantiles, values_in_order
from furrow.operators.pairs import correlations


@pytest.fixture(params=[order.ONE_RANGE, 0], autouse=True)
def ranges(request, monkeypatch):
    """Either way: one range, and values dealt by range."""
    monkeypatch.setattr(order, "ONE_RANGE", request.param)


def rows_of(seed, n, keys=("a", "b", None)):
    r = random.Random(seed)
    return [(r.choice(keys), r.choice([None, 0.0, -1.5, float(r.randrange(50)), r.gauss(0, 1e6)])) for _ in range(n)]


def known(rows):
    out = {}
    for k, v in rows:
        out.setdefault(k, [])
        if v is not None:
            out[k].append(v)
    return out


def test_quantiles_by_key_equal_those_of_the_sorted_values(spark):
    rows = rows_of(1, 700) + [("one", 4.0), ("none", None)]
    at = [0.0, 0.25, 0.5, 0.9, 1.0]
    got = {r.k: tuple(r)[1:] for r in quantiles(spark.createDataFrame(rows, "k string, v double").repartition(7), ["k"], "v", at).collect()}
    expected = {k: np.quantile(v, at) for k, v in known(rows).items() if v}
    assert got.keys() == expected.keys()
    assert all(np.allclose(got[k], expected[k], rtol=1e-12) for k in got)


def test_row_of_quantiles_without_keys_and_of_an_empty_table(spark):
    df = spark.createDataFrame([(float(i), None) for i in range(11)], "x double, y double")
    assert tuple(quantile_row(df, [], {"m": ("x", 0.5), "q": ("x", 0.95), "none": ("y", 0.5)}).first()) == (5.0, 9.5, None)
    assert [tuple(r) for r in quantile_row(df.limit(0), [], {"m": ("x", 0.5)}).collect()] == [(None,)]


def test_ranks_share_their_mean_and_follow_weights(spark):
    rows = rows_of(2, 300)
    got = {(r.k, r.v): (r.n, r.before, r.total, r.rank) for r in average_ranks(spark.createDataFrame(rows, "k string, v double"), ["k"], "v").collect()}
    for k, values in known(rows).items():
        for v in set(values):
            before, n = sum(x < v for x in values), values.count(v)
            assert got[k, v] == (n, before, len(values), before + (n + 1) / 2)
    weighted = spark.createDataFrame([("a", 1.0, 3), ("a", 2.0, 2), ("a", 1.0, 1)], "k string, v double, w int")
    assert [(r.v, r.n, r.before, r.total) for r in values_in_order(weighted, ["k"], "v", "w").orderBy("v").collect()] == [(1.0, 4, 0, 6), (2.0, 2, 4, 6)]


def test_one_key_of_a_million_values_is_dealt_over_all_ranges(spark):
    df = spark.range(1_000_000).select(F.lit("hot").alias("k"), ((F.col("id") * 7919) % 1_000_003).cast("double").alias("v"))
    df = df.union(spark.createDataFrame([("small", 1.0), ("small", 2.0)], "k string, v double"))
    values = np.sort((np.arange(1_000_000) * 7919) % 1_000_003)
    got = {r.k: tuple(r)[1:] for r in quantiles(df, ["k"], "v", [0.5, 0.9]).collect()}
    assert np.allclose(got["hot"], np.quantile(values, [0.5, 0.9])) and np.allclose(got["small"], (1.5, 1.9))
    counted = values_in_order(df, ["k"], "v").groupBy(F.spark_partition_id()).count().collect()
    assert len(counted) > 1 and max(r["count"] for r in counted) < 600_000


def test_spearman_equals_ranks_by_hand_with_ties_and_a_constant_side(spark):
    r = random.Random(3)
    rows = [("p", float(r.randrange(6)), float(r.randrange(4)), 2.0, None if r.random() < 0.2 else r.random()) for _ in range(200)] + [("few", 1.0, 2.0, 2.0, 3.0)] * 4
    out = {(x.scope, x.feature): x for x in correlations(spark.createDataFrame(rows, "g string, y double, x double, c double, z double"), ["y"], ["x", "c", "z", "y", "absent"], "g").collect()}
    assert out.keys() == {(s, f) for s in ("geral", "p") for f in ("x", "c", "z")}

    def rank(v):
        v = np.array(v)
        return np.array([(v < x).sum() + ((v == x).sum() + 1) / 2 for x in v])

    for scope in ("geral", "p"):
        here = [row for row in rows if scope == "geral" or row[0] == scope]
        for feature, i in (("x", 2), ("z", 4)):
            both = [(row[1], row[i]) for row in here if row[i] is not None]
            y, x = (np.array(v) for v in zip(*both, strict=True))
            assert np.isclose(out[scope, feature].pearson, np.corrcoef(x, y)[0, 1]) and np.isclose(out[scope, feature].spearman, np.corrcoef(rank(x), rank(y))[0, 1])
            assert out[scope, feature].n == len(both)
        c = out[scope, "c"]
        assert (c.pearson, c.spearman, c.direction, c.strength) == (None, None, "sem_relacao", "sem_relacao")


def test_a_row_at_the_mean_scores_zero_in_any_order(spark):
    from furrow.operators.windows import scores

    values = [0.1, 0.05, 0.03, 0.02, 0.05, 0.07, 0.03, 0.05]  # their mean is 0.05; sums of doubles in most orders miss it
    rows = [(k, v) for k in range(40) for v in np.random.default_rng(k).permutation(values).tolist()]
    rows += [(99, 1e30), (99, 3e30), (98, None), (98, 1.0)]
    out = scores(spark.createDataFrame(rows, "k long, v double"), "v", ["k"]).collect()
    assert {r.z_score for r in out if r.k < 40 and r.v == 0.05} == {0.0} and {round(r.z_score, 9) for r in out if r.k == 99} == {-1.0, 1.0}


def test_the_mean_of_an_area_is_exact_in_any_order(spark):
    from furrow.operators.review import stats_by_area

    values = [0.1] * 4 + [0.05] * 3 + [0.07] * 9 + [0.09] * 16  # 2.62 of 32: 0.081875, which rounds up
    rows = [(k, v) for k in range(60) for v in np.random.default_rng(k).permutation(values).tolist()]
    df = spark.createDataFrame([*rows, (99, None)], "season_id long, ndvi_mean double")
    names = {c: F.lit("x") for c in ("area_label", "treatment", "crop_type", "comparison_pair", "date", "week_start")}
    out = stats_by_area(df.withColumns({**names, "soil_pct": F.lit(1.0), "dense_veg_pct": F.lit(2.0)})).collect()
    assert {r["mean"] for r in out} == {0.081875, None} and {r["count"] for r in out} == {32, 0}
