from collections import Counter
from itertools import permutations

from furrow.llm.filter_audit import FILTERS, audit, failures, op11_filter_audit

SCHEMA = "doc_id long, text string, lang string, mask string, part string"
LONG = " ".join(f"w{i}" for i in range(220))
ROWS = [
    (1, LONG, "en", "x", "y"), (2, LONG, "en", "x", "y"), (2, LONG, "fr", "x", "y"), (0, LONG, None, "x", "y"), (0, LONG, "de", "x", "y"), (None, LONG, "en", "x", "y"),
    (3, "a a a a # B", "en", None, None), (4, None, "en", None, None), (5, "", "fr", None, None), (6, " \t\n\x0b\x0c\r ", "fr", None, None), (7, "ÀB   c", "fr", None, None),
    (8, LONG.upper(), "en", None, None), (9, "b " * 500_000, "en", None, None), (10, "b " * 500_000, "en", None, None), (11, LONG + " |", "de", None, None),
]


def plain_mask(rows, row):
    words = [w for w in (row[1] or "").replace("\t", " ").replace("\n", " ").replace("\x0b", " ").replace("\x0c", " ").replace("\r", " ").split(" ") if w]
    text = row[1] or ""
    fails = [len(words) < 200, 100 * len(set(words)) < 50 * len(words), 100 * sum("A" <= c <= "Z" for c in text) > 3 * len(text), any(c in "#$%&*|" for c in text)]
    fails.append(row[0] is not None and any(r[0] is not None and r[0] < row[0] and (r[1] or "") == text for r in rows))
    return sum(f << i for i, f in enumerate(fails))


def plain_audit(rows):
    """rows: (part, mask, good, toxic)."""
    out = {}
    for part in {r[0] for r in rows}:
        here = [r for r in rows if r[0] == part]
        shapley = Counter()
        for order in permutations(FILTERS):
            left = list(here)
            for step, f in enumerate(order, 1):
                bit = 1 << FILTERS.index(f)
                gone = [r for r in left if r[1] & bit]
                left_before, left = left, [r for r in left if not r[1] & bit]
                redundant = sum(bool(r[1] & bit) for r in here) - len(gone)
                shapley[f] += len(gone)
                assert len(left_before) == len(left) + len(gone)
                out[part, "".join(order), step] = (len(left), len(gone), redundant, sum(r[1] == bit for r in here), sum(r[2] is True for r in gone), sum(r[3] is True for r in gone), f)
        for key, value in out.items():
            if key[0] == part:
                out[key] = (*value[:6], shapley[value[6]])
    return out


def test_masks_of_ties_nulls_empty_and_long_texts(spark):
    got = Counter((r.doc_id, r.part, r.mask) for r in failures(spark.createDataFrame(ROWS, SCHEMA)).collect())
    assert got == Counter((r[0], r[2] or "", plain_mask(ROWS, r)) for r in ROWS)


def test_audit_equals_filters_applied_one_by_one(spark):
    rows = [(p, m, (m + i) % 3 == 0 or None, (m * i) % 5 == 1) for p in ("", "en") for m in range(32) for i in range(m % 4 + (p == "en"))]
    got = {(r.part, r.filter_order, r.step): tuple(r)[3:] for r in audit(spark.createDataFrame(rows, "part string, mask int, good boolean, toxic boolean")).collect()}
    assert got == plain_audit(rows) and len(got) == 2 * 120 * 5


def test_empty_table(spark):
    assert failures(spark.createDataFrame([], SCHEMA)).count() == 0
    assert audit(spark.createDataFrame([], "part string, mask int, good boolean, toxic boolean")).count() == 0


def test_query(spark, tmp_path):
    spark.createDataFrame(ROWS, SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    labels = [(1, 1, 0), (1, 0, None), (2, None, 1), (3, 1, 1), (4, 0, 1), (None, 1, 1), (99, 1, 1)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    flag = lambda d, k: any(x[0] == d and x[k] == 1 for x in labels) if d is not None else False
    expected = plain_audit([(r[2] or "", plain_mask(ROWS, r), flag(r[0], 1), flag(r[0], 2)) for r in ROWS])
    got = {(r.part, r.filter_order, r.step): tuple(r)[3:] for r in op11_filter_audit(spark, str(tmp_path)).collect()}
    assert got == expected
