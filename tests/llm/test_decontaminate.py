import random
import string
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from furrow.llm import decontaminate as DC
from furrow.llm.decontaminate import MIN_LITERALS, SHORTEST, UNITS, WINDOW, grouped_items, op9_benchmark_decontamination

ITEM = "A train leaves Boston at 9 and travels 120 miles toward the coast before it stops at a small village near the river"
FILL = "some unrelated words stand here and then go on for a while without any meaning at all"


def contaminated(docs, benchmark, max_broadcast=DC.MAX_BROADCAST):
    """The matches with all items of each group."""
    matches = DC.contaminated(docs, benchmark, max_broadcast)
    pairs = matches.drop("item_id").join(grouped_items(benchmark)[1], "item_group")
    return pairs.groupBy("doc_id", "item_id").agg(F.max(F.struct("n_windows", "exact", "n_slots")).alias("b")).select("doc_id", "item_id", "b.*")


def test_templates(spark):
    docs = [
        (1, f"{FILL} {ITEM} {FILL}"), (2, f"{FILL} {ITEM.replace('120', '75').replace('Boston', 'Denver')}, {FILL}"), (3, FILL), (4, None), (5, ""), (None, ITEM), (6, ITEM), (6, ITEM), (7, "x " * 100_000 + ITEM), (8, "What is 2 plus two?"), (9, "Hi!"), (10, "hi there"),
    ]
    bench = [(10, ITEM), (11, None), (12, "What is 4 plus two"), (13, "hi"), (None, FILL)]
    df = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 as window", "2 as item_id")
    out = {(r.doc_id, r.item_id): r.exact for r in contaminated(df, spark.createDataFrame(bench, "item_id long, text string")).collect()}
    assert out == {(1, 10): True, (2, 10): False, (6, 10): True, (7, 10): True, (8, 12): False, (9, 13): True}
    shuffled = {(r.doc_id, r.item_id): r.exact for r in contaminated(df, spark.createDataFrame(bench, "item_id long, text string"), max_broadcast=0).collect()}
    assert shuffled == out


def test_slots_must_be_consistent(spark):
    item = "Anna gives five apples and takes five pears then Anna walks home alone through rain"
    clash = item.replace("Anna gives", "Bert gives")
    docs = spark.createDataFrame([(1, clash), (2, item.replace("Anna", "Bert"))], "doc_id long, text string")
    out = [r.doc_id for r in contaminated(docs, spark.createDataFrame([(1, item)], "item_id long, text string")).collect()]
    assert out == [2]


def test_empty(spark):
    schema = "doc_id long, text string"
    bench = spark.createDataFrame([(1, ITEM)], "item_id long, text string")
    assert contaminated(spark.createDataFrame([], schema), bench).count() == 0
    assert contaminated(spark.createDataFrame([(1, ITEM)], schema), bench.limit(0)).count() == 0


def test_occurrences_are_judged_one_by_one(spark):
    other = ITEM.replace("120", "75").replace("Boston", "Denver")
    window = "and travels 300 miles toward the coast before"
    repeated = "Tom has 3 apples and then buys more, Ann has 5 apples and then buys more"
    docs = [(1, f"{ITEM} {FILL} {other}"), (2, f"{FILL} {ITEM} {FILL} {window} {FILL}"), (3, f"{FILL} {repeated} {FILL}"), (4, repeated.replace("Tom", "Eve")), (5, ITEM), (5, other), (6, other)]
    bench = spark.createDataFrame([(10, ITEM), (11, repeated)], "item_id long, text string")
    df = spark.createDataFrame(docs, "doc_id long, text string")
    expected = {(1, 10): True, (2, 10): True, (3, 11): True, (4, 11): False, (5, 10): True, (6, 10): False}
    for size in (1_000_000, 0):
        assert {(r.doc_id, r.item_id): r.exact for r in contaminated(df, bench, max_broadcast=size).collect()} == expected


def test_case_does_not_hide_an_item(spark):
    item = "Yesterday Élodie gave 12 euros to the baker who sold very old bread near the station"
    shouted = "THEN A TRAIN LEAVES BOSTON AT 9 AND TRAVELS 120 MILES TOWARD THE COAST BEFORE IT STOPS"
    docs = [(1, ITEM.upper()), (2, ITEM.lower()), (3, shouted), (4, item.upper()), (5, item.replace("12", "50").lower()), (6, FILL.upper())]
    bench = spark.createDataFrame([(10, ITEM), (11, item)], "item_id long, text string")
    assert {(r.doc_id, r.item_id): r.exact for r in contaminated(spark.createDataFrame(docs, "doc_id long, text string"), bench).collect()} == {(1, 10): True, (2, 10): True, (3, 10): True, (4, 11): True, (5, 11): False}


def test_items_without_templates_match_exactly(spark):
    names = "Anna Bert 12 Carl Dora 15 Emil Fred 19 Gina Hugo 22"
    docs = [(1, f"{FILL} {names}, {FILL}"), (2, names.replace("19", "20")), (3, names), (4, "Paris"), (5, "in Paris today"), (6, "Anna Bert 12 Carl Dora 15 Emil Fred")]
    bench = spark.createDataFrame([(10, names), (11, "Paris"), (12, "  "), (13, "...")], "item_id long, text string")
    for size in (1_000_000, 0):
        assert {(r.doc_id, r.item_id) for r in contaminated(spark.createDataFrame(docs, "doc_id long, text string"), bench, max_broadcast=size).collect()} == {(1, 10), (3, 10), (4, 11)}


def plain(docs, items):
    """The rules written down word by word: all items against all documents and shifts."""
    units = set(UNITS.split())

    def template(text):
        w = [x for x in ((p.strip(string.punctuation)) for p in text.split()) if x]
        loud = [sum(c.isupper() for c in x) >= 2 and not any(c.islower() for c in x) for x in w]
        out = []
        for i, x in enumerate(w):
            low = x.lower()
            beside = any(0 <= j < len(w) and loud[j] for j in (i - 1, i + 1))
            single = sum(c.isupper() for c in x) == 1 and not any(c.islower() for c in x)
            if all(c in "0123456789.,+-/:%" for c in x) and any(c.isdigit() for c in x):
                out.append(("number", low, "number"))
            elif low in units:
                out.append(("unit", low, "unit"))
            elif x[0].isupper() and not loud[i] and not (single and beside):
                out.append(("name", low, low))
            else:
                out.append((low, low, low))
        return out

    slots, found = ("number", "unit", "name"), {}
    enough = lambda kinds: sum(k not in slots for k in kinds) >= -(-len(kinds) * MIN_LITERALS // WINDOW)
    for item_id, item in items:
        t = template(item)
        k = min(len(t), WINDOW)
        wanted = []  # (place, template words, values of slots)
        for i in range(len(t) - k + 1) if k >= SHORTEST else []:
            for form in (0, 2):
                kinds = [x[form] for x in t[i : i + k]]
                if enough(kinds) and (form == 0 or "name" in [x[0] for x in t[i : i + k]]):
                    wanted.append((i, kinds, [x[1] for x, y in zip(t[i : i + k], kinds) if y in slots]))
        if not any(enough([x[0] for x in t[i : i + k]]) for i, _, _ in wanted):
            wanted = []
        for doc_id, text in docs:
            d = template(text or "")
            best = None
            if not wanted:
                here = [x[1] for x in d]
                mine = [x[1] for x in t]
                if mine and (any(here[j : j + len(mine)] == mine for j in range(len(here))) if k >= SHORTEST else here == mine):
                    best = (len(t) - k + 1, True, 0)
            by_shift = defaultdict(list)
            for i, kinds, values in wanted:
                for j in range(len(d) - k + 1):
                    if [x[0] for x in d[j : j + k]] == kinds and enough(kinds):
                        by_shift[j - i].append(list(zip(values, [x[1] for x in d[j : j + k] if x[0] in slots])))
            for hits in by_shift.values():
                means = defaultdict(set)
                for a, b in (p for h in hits for p in h):
                    means[a].add(b)
                if all(len(v) == 1 for v in means.values()):
                    best = max(best or (0, False, 0), (len(hits), all(v == {a} for a, v in means.items()), len(means)))
            if best:
                found[doc_id, item_id] = best
    return found


@pytest.mark.parametrize("seed", [1, 2])
def test_against_brute_force(spark, seed):
    rng = random.Random(seed)
    pool = [f"w{i}" for i in range(12)] + ["Anna", "Bert", "12", "3.5", "km", "NASA", "A", "x,", "(then)", "Élan", "été"]
    text = lambda n: [rng.choice(pool) for _ in range(n)]
    items = [(i, text(rng.choice([0, 1, 3, 5, 8, 9, 14, 20]))) for i in range(25)] + [(30, ["Anna"] * 6), (31, ["12", "Bert"] * 6)]
    docs = []
    for i in range(60):
        w = text(rng.randint(0, 20))
        for _ in range(rng.randint(0, 2)):
            part = list(rng.choice(items)[1])
            swap = {x: rng.choice(pool) for x in rng.sample(["Anna", "Bert", "12", "3.5", "km"], rng.randint(0, 2))}
            part = [swap.get(x, x) for x in part] if rng.random() < 0.5 else part
            part = [x.upper() for x in part] if rng.random() < 0.2 else [x.lower() for x in part] if rng.random() < 0.2 else part
            w = w[: (at := rng.randint(0, len(w)))] + part + w[at:]
        docs.append((i, " ".join(w)))
    items = [(i, " ".join(w)) for i, w in items]
    expected = plain(docs, items)
    schema = "long, text string"
    for size in (1_000_000, 0):
        got = contaminated(spark.createDataFrame(docs, f"doc_id {schema}"), spark.createDataFrame(items, f"item_id {schema}"), max_broadcast=size).collect()
        assert {(r.doc_id, r.item_id): (r.n_windows, r.exact, r.n_slots) for r in got} == expected
    assert len(expected) > 15


def test_many_items_of_one_template_meet_documents_as_one(spark, tmp_path):
    rng = random.Random(3)
    make = lambda: ITEM.replace("120", str(rng.randrange(10**6))).replace("Boston", rng.choice(string.ascii_uppercase) + f"x{rng.randrange(10**6)}")
    twice = "Anna gives five apples and takes five pears then Anna walks home alone through rain"
    items = [(i, make()) for i in range(400)] + [(900, twice), (901, twice.replace("Anna gives", "Bert gives")), (902, twice.replace("Anna", "Carl"))]
    docs = [(i, f"{FILL} {make()}") for i in range(400)] + [(1000, items[7][1]), (1001, twice.replace("Anna", "Dora"))]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    rows = op9_benchmark_decontamination(spark, str(tmp_path)).collect()
    matches, members = ([r for r in rows if r.kind == k] for k in ("match", "member"))
    groups = {}
    for r in members:
        groups.setdefault(r.item_group, set()).add(r.item_id)
    assert set(range(400)) in groups.values() and {900, 902} in groups.values() and {901} in groups.values()
    assert len(matches) < 410  # a document and a template each
    found = {(r.doc_id, i) for r in matches for i in groups[r.item_group]}
    assert {(d, i) for d in range(400) for i in range(400)} <= found and {i for d, i in found if d == 1001} == {900, 901, 902}
    assert any(r.exact for r in matches if r.doc_id == 1000) and not any(r.exact for r in matches if r.doc_id == 3)
