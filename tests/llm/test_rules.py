import math
import re
from collections import Counter

import xxhash
from pyspark.sql import functions as F

from furrow.llm.rules import _BETWEEN, BINS, THRESHOLD, _hashed, _marks, _parts, base_rules, quality_rules, ratio_weights


def expected(text):
    t = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    at = {}
    for i in range(len(w) - 4):
        at.setdefault(tuple(w[i : i + 5]), []).append(i)
    covered = {j for v in at.values() if len(v) > 1 for i in v for j in range(i, i + 5)}
    seen, again = set(), 0
    for line in t.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            again += line in seen
            seen.add(line)
    return (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), again, len(covered), len(w) < 10 or 100 * len(covered) > 20 * len(w))


def test_base_counts(spark):
    texts = [
        None, "", " \t\n\x0b\x0c\r", "one", "a b c d e a b c d e f", "x " * 40, "é ü 漢字 " * 3 + "#*$%&|<>", "l1 a\nl1 a\n\n  \nl1 a \nl2", "  a\u0085b  c", "a a a a a a a", " lead\ttrail ",
        " ".join(f"w{i}" for i in range(30)) + " " + " ".join(f"w{i}" for i in range(5)), "word " * 30_000,
    ]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    for r in base_rules(df).collect():
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == expected(texts[r.doc_id]), texts[r.doc_id]


def test_tokens(spark):
    texts = [None, "", " \t\r\n", "one", "...", "a,b;;c", " (x) [y]`{z}~ ", "é!ü漢.字 a_b\\c ^d", "\x0b!? a\x0c1-2 \u0085x", "word, " * 20_000]
    rows = _parts(spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i long, text string"), "tokens", _BETWEEN).collect()
    for r in rows:
        assert r.tokens == re.findall(r"[!-/:-@\[-`{-~]+|[^!-/:-@\[-`{-~\x20\x09-\x0D]+", texts[r.i] or ""), r.i


def test_verdict(spark):
    good = [(i, " ".join(f"tree{(i * 7 + j) % 40} by the river" for j in range(12))) for i in range(40)]
    bad = [(100 + i, " ".join(f"q{(i * 5 + j) % 40}%%%" for j in range(30))) for i in range(10)]
    docs = spark.createDataFrame([*good, *bad, (None, None), (3, "")], "doc_id long, text string").selectExpr("*", "true as kept", "1 as bins")
    trusted = spark.createDataFrame([(i,) for i, _ in good] + [(None,)], "doc_id long")
    out = quality_rules(docs, trusted).collect()
    assert len(out) == 52
    assert all(not r.kept for r in out if (r.doc_id or 0) >= 100 or r.n_words == 0)
    assert all(r.kept for r in out if r.n_words and r.doc_id < 100 and not r.base_failed)
    assert quality_rules(docs.limit(0), trusted.limit(0)).count() == 0


def bins(text):
    """Bins of a text's unigrams and bigrams by the hash of the same name, written anew."""
    one = [xxhash.xxh64_intdigest(t.encode(), 42) for t in re.findall(r"[!-/:-@\[-`{-~]+|[^!-/:-@\[-`{-~\x20\x09-\x0D]+", text or "")]
    two = [xxhash.xxh64_intdigest(b.to_bytes(8, "little"), xxhash.xxh64_intdigest(a.to_bytes(8, "little"), 42)) for a, b in zip(one, one[1:])]
    return [(h - (1 << 64) if h >> 63 else h) % BINS for h in one + two]


def test_ratio_and_verdict_against_plain_counts(spark):
    rows = [(i, " ".join(f"tree{(i * 7 + j) % 40} by the river" for j in range(12))) for i in range(30)]
    rows += [(100 + i, " ".join(f"q{(i * 5 + j) % 40}%%%" for j in range(12 + i))) for i in range(10)] + [(None, "null ids count in the raw corpus"), (5, "again the same id"), (200, None), (201, "")]
    good = {i for i in range(0, 30, 2)} | {102}
    docs, trusted = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(i,) for i in good for _ in range(2)], "doc_id long")
    raw, target = Counter(b for _, t in rows for b in bins(t)), Counter(b for i, t in rows if i in good for b in bins(t))
    n, m = sum(raw.values()) + BINS, sum(target.values()) + BINS
    weight = lambda b: math.log((target[b] + 1) / m) - math.log((raw[b] + 1) / n)
    ratio = {t: sum(map(weight, bins(t))) / max(1, len(bins(t))) for _, t in rows}
    words = dict(rows)
    for r in quality_rules(docs, trusted).collect():
        if r.doc_id in (None, 5):
            continue
        assert math.isclose(r.mean_ratio, ratio[words[r.doc_id]], abs_tol=2e-6)
        assert r.kept == (not r.base_failed and ratio[words[r.doc_id]] >= THRESHOLD)


def test_trusted_ids_by_broadcast_or_dealt_give_the_same_and_shuffle_no_text(spark):
    rows = [(i if i % 7 else None, " ".join(f"w{(i * j) % 50}, x{j}" for j in range(i % 30))) for i in range(-100, 300)]
    good = [i for i in range(-200, 400, 3)] + [None, 5, 5]
    docs, ids = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(i,) for i in good], "doc_id long")
    one, two = ratio_weights(docs, ids), ratio_weights(docs, ids, most=0)
    assert one == two
    raw, target = Counter(b for _, t in rows for b in bins(t)), Counter(b for i, t in rows if i is not None and i in good for b in bins(t))
    n, m = sum(raw.values()) + BINS, sum(target.values()) + BINS
    assert all(math.isclose(w, math.log((target[b] + 1) / m) - math.log((raw[b] + 1) / n), abs_tol=1e-9) for b, w in enumerate(one))
    words_ = spark.createDataFrame([(str(i), t) for i, t in rows], "doc_id string, text string"), spark.createDataFrame([(str(i),) for i in good], "doc_id string")
    assert ratio_weights(*words_) == ratio_weights(*words_, most=0)
    marks, key, hit = _marks(ids)
    assert {r.doc_id for r in docs.withColumn("__key", F.expr(key)).join(marks, "__key").where(hit).collect()} == {i for i, _ in rows if i is not None and i in good}


def test_tokens_are_found_without_looking_around_at_every_character(spark):
    docs = spark.createDataFrame([(1, "$1 a,b (c) $0 \\d ...\t e")], "doc_id long, text string")
    rows = _hashed(docs)
    assert "(?" not in rows._jdf.queryExecution().optimizedPlan().toString()
    (row,) = rows.collect()
    pairs = [h % BINS for h in row["__one"]] + list(row["__two"])
    assert pairs == bins("$1 a,b (c) $0 \\d ...\t e")
