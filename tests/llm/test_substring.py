import hashlib
import random

import numpy as np
import pytest

from furrow.llm import fmindex
from furrow.llm.fmindex import FMIndex, earlier_intervals
from furrow.llm.substring import dedup_substrings


def brute(rows, length):
    least = {}
    split = [(i, (t or "").split()) for i, t in rows]
    for i, w in split:
        for j in range(len(w) - length + 1):
            key = tuple(w[j : j + length])
            least[key] = min(least.get(key, i), i)
    out = []
    for i, w in split:
        gone = set()
        for j in range(len(w) - length + 1):
            if least[tuple(w[j : j + length])] < i:
                gone.update(range(j, j + length))
        kept = " ".join(x for j, x in enumerate(w) if j not in gone)
        out.append((i, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out)


def corpus(seed, n=60):
    rng = random.Random(seed)
    words = [f"v{i}é" for i in range(30)]
    passages = [[rng.choice(words) for _ in range(rng.randint(8, 30))] for _ in range(6)]
    rows = []
    for i in range(n):
        w = []
        for _ in range(rng.randint(0, 4)):
            w += [rng.choice(words) for _ in range(rng.randint(0, 12))] + (rng.choice(passages) if rng.random() < 0.7 else [])
        if rows and rng.random() < 0.2:
            w = (rng.choice(rows)[1] or "").split()
        if rng.random() < 0.1:
            w += [words[0]] * rng.randint(5, 60)
        rows.append((rng.randint(0, n), " ".join(w)))
    return [*{i: (i, t) for i, t in rows}.values(), (n + 1, None), (n + 2, "")]


@pytest.mark.parametrize("seed,hot,shard", [(1, 100_000, 400_000), (2, 60, 400_000), (3, 100_000, 100), (4, 20, 60)])
def test_against_brute_force(spark, seed, hot, shard):
    rows = corpus(seed)
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as key", "2 as id", "3 as start", "4 as node", "5 as window")
    got = sorted(tuple(r) for r in dedup_substrings(df, 10, 3, hot, shard).collect())
    assert got == brute(rows, 10)


def test_nulls_repeats_and_empty(spark):
    text = " ".join(f"x{i}" for i in range(60))
    rows = [(None, text), (3, text), (3, text), (5, text), (6, "short text"), (7, "short text")]
    got = sorted((r.doc_id or -1, r.n_words, r.n_removed) for r in dedup_substrings(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == [(-1, 60, 0), (3, 60, 0), (3, 60, 0), (5, 60, 60), (6, 2, 0), (7, 2, 0)]
    assert dedup_substrings(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_backward_search_counts_and_least_owners():
    rng = np.random.default_rng(3)
    for _ in range(40):
        text = np.append(rng.integers(1, 4, int(rng.integers(2, 60))), 0)
        owner = rng.integers(0, 9, len(text))
        index = FMIndex(text, owner, 4, 64)
        for _ in range(10):
            a = int(rng.integers(0, len(text) - 1))
            pattern = text[a : min(len(text) - 1, a + int(rng.integers(1, 6)))]
            lo, hi = np.array([0]), np.array([index.n])
            for s in pattern[::-1]:
                lo, hi = index.extend(np.array([s]), lo, hi)
            at = [i for i in range(len(text) - len(pattern) + 1) if (text[i : i + len(pattern)] == pattern).all()]
            assert hi[0] - lo[0] == len(at)
            assert index.least_owner(lo, hi)[0] == min(owner[at])


@pytest.mark.parametrize("few", [0, 5, 24])
def test_intervals_cover_exactly_the_earlier_windows(monkeypatch, few):
    monkeypatch.setattr(fmindex, "FEW", max(few, 1))
    rng = np.random.default_rng(4)
    for _ in range(60):
        length, symbols = int(rng.integers(2, 7)), int(rng.integers(2, 5))
        seqs = [rng.integers(1, symbols + 1, int(rng.integers(0, 25))) for _ in range(int(rng.integers(2, 12)))]
        seqs += [seqs[0][2:].copy(), seqs[1].copy(), np.full(int(rng.integers(0, 30)), 1), np.full(int(rng.integers(0, 60)), 1)]
        own = rng.integers(0, 8, len(seqs))
        text = np.concatenate([np.append(s, 0) for s in seqs]).astype(np.int64)
        index = FMIndex(text, np.concatenate([np.full(len(s) + 1, o) for s, o in zip(seqs, own)]), symbols + 1, 64)
        first = np.concatenate(([0], np.cumsum([len(s) for s in seqs])))
        q, a, b = earlier_intervals(index, np.concatenate(seqs).astype(np.int64), first, own, length)
        covered = [np.zeros(len(s), bool) for s in seqs]
        for i, x, y in zip(q, a, b):
            covered[i][x:y] = True
        least = {}
        for s, o in zip(seqs, own):
            for i in range(len(s) - length + 1):
                key = tuple(s[i : i + length])
                least[key] = min(least.get(key, o), o)
        for s, o, c in zip(seqs, own, covered):
            expected = np.zeros(len(s), bool)
            for i in range(len(s) - length + 1):
                if least[tuple(s[i : i + length])] < o:
                    expected[i : i + length] = True
            assert (c == expected).all()


@pytest.mark.parametrize("hot", [100_000, 400])
def test_very_long_texts_and_one_word_over_and_over(spark, hot):
    rng = random.Random(5)
    long = [f"w{rng.randrange(30_000)}" for _ in range(60_000)]
    rows = [(1, " ".join(long)), (2, " ".join(long[20_000:] + ["end"])), (3, "x " * 20_000), (4, "x " * 19_000 + "y"), (5, "x " * 30)]
    got = sorted((r.doc_id, r.n_words, r.n_removed) for r in dedup_substrings(spark.createDataFrame(rows, "doc_id long, text string"), hot=hot).collect())
    assert got == [(1, 60_000, 0), (2, 40_001, 40_000), (3, 20_000, 0), (4, 19_001, 19_000), (5, 30, 0)]
