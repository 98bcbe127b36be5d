import itertools
import math
import re
import zlib
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from furrow.llm import hmm
from furrow.llm.folder import table


def model(states=3, symbols=5, seed=2):
    rng = np.random.default_rng(seed)
    norm = lambda x, axis: x / x.sum(axis, keepdims=True)
    return hmm.Model(norm(rng.random(states), 0), norm(rng.random((states, states)), 1), norm(rng.random((symbols, states)), 0))


def path_sum(m, s):
    total = 0.0
    for path in itertools.product(range(len(m.start)), repeat=len(s)):
        p = m.start[path[0]] * m.emit[s[0], path[0]]
        for i in range(1, len(s)):
            p *= m.moves[path[i - 1], path[i]] * m.emit[s[i], path[i]]
        total += p
    return math.log10(total)


def test_forward_is_the_sum_over_paths(monkeypatch):
    m, rng = model(), np.random.default_rng(3)
    sequences = [rng.integers(0, 5, n).astype(np.uint16) for n in (1, 2, 3, 5, 7, 7)]
    expected = [path_sum(m, s) for s in sequences]
    assert np.allclose(m.log10(sequences), expected)
    monkeypatch.setattr(hmm, "STRETCH", 2)
    assert np.allclose(m.log10(sequences), expected)


def test_expected_counts_and_growth_of_likelihood():
    m, rng = model(), np.random.default_rng(4)
    sequences = [rng.integers(0, 5, n).astype(np.uint16) for n in (1, 4, 9, 30)]
    before = m.log10(sequences).sum()
    for _ in range(3):
        emitted, moved, started = np.zeros_like(m.emit), np.zeros_like(m.moves), np.zeros(3)
        m.expected(sequences, emitted, moved, started)
        assert math.isclose(emitted.sum(), 44) and math.isclose(moved.sum(), 40) and math.isclose(started.sum(), 4)
        m = hmm.Model(started / started.sum(), moved / moved.sum(1, keepdims=True), emitted / emitted.sum(0))
        after = m.log10(sequences).sum()
        assert after > before
        before = after


def counts(m, sequences):
    emitted, moved, started = np.zeros_like(m.emit), np.zeros_like(m.moves), np.zeros(len(m.start))
    m.expected(sequences, emitted, moved, started)
    return emitted, moved, started


def test_expected_counts_are_sums_over_paths_of_whole_sequences(monkeypatch):
    m, rng = model(), np.random.default_rng(6)
    sequences = [rng.integers(0, 5, n).astype(np.int32) for n in (1, 2, 3, 5, 6, 7, 7)]
    emitted, moved, started = np.zeros_like(m.emit), np.zeros_like(m.moves), np.zeros(3)
    for s in sequences:
        whole = 10 ** path_sum(m, s)
        for path in itertools.product(range(3), repeat=len(s)):
            p = m.start[path[0]] * m.emit[s[0], path[0]]
            for i in range(1, len(s)):
                p *= m.moves[path[i - 1], path[i]] * m.emit[s[i], path[i]]
            started[path[0]] += p / whole
            for i, k in enumerate(path):
                emitted[s[i], k] += p / whole
            for a, b in zip(path, path[1:]):
                moved[a, b] += p / whole
    for stretch in (1024, 2, 3, 1):
        monkeypatch.setattr(hmm, "STRETCH", stretch)
        assert all(np.allclose(x, y) for x, y in zip(counts(m, sequences), (emitted, moved, started)))


def test_stretches_of_long_sequences_hand_on_their_states(monkeypatch):
    m, rng = model(), np.random.default_rng(7)
    sequences = [rng.integers(0, 5, n).astype(np.int32) for n in (900, 40, 333, 1024, 1, 2)]
    whole = counts(m, sequences)
    monkeypatch.setattr(hmm, "STRETCH", 64)
    monkeypatch.setattr(hmm, "BLOCK", 300)
    assert all(np.allclose(x, y) for x, y in zip(counts(m, sequences), whole))


def test_base_scores_and_held_out_gain(spark):
    docs = table(spark, "/root/testdata/sf0.001", "documents")
    got = hmm.score_texts(docs, F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 != 1, head=500).toPandas().set_index("doc_id")
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    texts = {r.doc_id: [*re.findall(r"[^\x20\x09-\x0D]+", (r.text or "").translate(low)), None] for r in docs.collect()}
    c = Counter(w for i, t in texts.items() if zlib.crc32(str(i).encode()) % 5 != 1 for w in t)
    n, v = sum(c.values()), len(c)
    for i, t in texts.items():
        r = got.loc[i]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(t), sum(c[w] > 0 for w in t), n)
        assert math.isclose(r.base_score, sum(math.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in t), rel_tol=1e-9)
    held = [i for i in texts if zlib.crc32(str(i).encode()) % 5 == 1]
    assert got.loc[held].score.sum() > got.loc[held].base_score.sum()


def test_edges(spark):
    docs = spark.createDataFrame([(1, None), (1, ""), (None, "a B a"), (2, "b " * 6000), (2, "b " * 6000)], "doc_id long, text string").selectExpr("*", "1 as row")
    out = hmm.score_texts(docs, F.col("doc_id") > 0).collect()
    assert sorted(r.n_tokens for r in out) == [1, 1, 4, 6001, 6001] and all(math.isfinite(r.score) for r in out)
    assert all(r.train_tokens == 12_004 for r in out)
    assert hmm.score_texts(docs.limit(0), F.lit(True)).count() == 0
    assert all(r.n_known == 0 for r in hmm.score_texts(docs, F.lit(False)).collect())


def test_every_word_has_emissions_by_state(spark):
    """Scores do not depend on how many words are broadcast: the others are no less part of the model."""
    docs = table(spark, "/root/testdata/sf0.001", "documents").where("doc_id is not null").dropDuplicates(["doc_id"])
    train = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 != 1
    some, many, none = (hmm.score_texts(docs, train, head=n).toPandas().set_index("doc_id").sort_index() for n in (20, 5000, 0))
    assert np.allclose(some.score, many.score, rtol=1e-4) and np.allclose(none.score, many.score, rtol=1e-4)
    assert np.allclose(some.base_score, many.base_score)


def test_scores_are_those_of_the_plain_model(spark):
    """One state: the model is a unigram one, whose weights can be written down, also for the end and for words not learnt."""
    rows = [(1, "a b a c"), (2, "b b d"), (3, "a zz yy"), (4, None), (5, "A\tB")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    train = F.col("doc_id").isin(1, 2, 4)
    out = {r.doc_id: r for r in hmm.score_texts(docs, train, head=2, states=1).collect()}
    c = Counter(w for i, t in rows if i in (1, 2, 4) for w in [*(t or "").lower().split(), None])
    n, v = sum(c.values()), len(c)
    total = n + 0.5 * (v + 1)
    weight = {w: float(hmm.smoothed(np.array([float(x)]), np.array([[float(x)]]), np.ones(1), total)[0, 0]) for w, x in c.items()}
    unseen = float(hmm.smoothed(np.zeros(1), np.zeros((1, 1)), np.ones(1), total)[0, 0])
    norm = sum(weight.values()) + unseen
    for i, t in rows:
        expected = sum(math.log10(weight.get(w, unseen) / norm) for w in [*(t or "").lower().split(), None])
        assert math.isclose(out[i].score, expected, rel_tol=1e-5)
    assert math.isclose(norm, total + hmm.PRIOR, rel_tol=1e-9)
