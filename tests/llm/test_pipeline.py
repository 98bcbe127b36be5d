import corpus_pipeline as cp
from furrow.llm.decontaminate import contaminated
from furrow.llm.folder import table, written
from furrow.llm.jaccard import near_duplicates

SF = "/root/testdata/sf0.001"


def test_stages_one_after_the_other(spark):
    docs = table(spark, SF, "documents")
    columns = docs.columns
    kept = {r.doc_id for r in docs.collect()}
    for i, (name, stage) in enumerate(cp.STAGES):
        before, docs = docs, written(stage(spark, docs, SF), f"test{i}")
        now = {r.doc_id for r in docs.select("doc_id").collect()}
        assert now <= kept
        if i == 1:
            found = near_duplicates(before, cp.WORDS, cp.PERCENT)
            assert now == {r.component_id for r in found.collect()}
        if i == 2:
            assert kept - now == {r.doc_id for r in contaminated(before, table(spark, SF, "benchmark")).collect()}
        if i < len(cp.STAGES) - 1:
            assert docs.columns == columns
        kept = now
    assert {"shard", "slot"} <= set(docs.columns) and kept


def test_no_documents(spark):
    docs = table(spark, SF, "documents").limit(0)
    for i, (_, stage) in enumerate(cp.STAGES):
        docs = written(stage(spark, docs, SF), f"none{i}")
    assert docs.count() == 0


def test_each_stage_on_odd_rows(spark):
    """Null ids, repeated rows, empty and very long texts, a clashing extra column: every stage keeps its rules on its own input."""
    from tests.llm.test_decontaminate import plain
    from tests.llm.test_jaccard import brute

    bench = [(r.item_id, r.text) for r in table(spark, SF, "benchmark").collect()]
    some = [(r.doc_id, r.text) for r in table(spark, SF, "documents").where("doc_id < 25").collect()]
    long = " ".join(f"word{i * i % 7919} goes{i % 13}" for i in range(2_500))
    odd = [(None, None), (None, some[0][1]), (9001, ""), (9002, " \n"), (9003, None), (9004, long), (9004, long), (9005, long + " end"), (9006, "see: " + bench[0][1]), (9006, "see: " + bench[0][1])]
    rows = [(i, t, "en", "s", len(t or ""), "x") for i, t in some + odd]
    docs = written(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars int, shard string"), "odd")
    keyed = lambda df: sorted((r.doc_id if r.doc_id is not None else -1, r.text or "") for r in df.collect())
    all_rows = sorted((i if i is not None else -1, t or "") for i, t in some + odd)

    texts = dict(some + odd)
    real = [(i, t) for i, t in texts.items() if i is not None]
    first = {i: c for i, (_, c) in brute(real, cp.WORDS, cp.PERCENT).items()}
    near = keyed(cp.near_duplicate_stage(spark, docs, SF))
    assert near == [x for x in all_rows if x[0] == -1 or first[x[0]] == x[0]]
    leaks = {i for i, _ in plain(real, bench)}
    assert 9006 in leaks and 9004 not in leaks
    assert keyed(cp.decontamination_stage(spark, docs, SF)) == [x for x in all_rows if x[0] not in leaks]
    for stage in (cp.quality_stage, cp.mixing_stage):
        kept = keyed(stage(spark, docs, SF))
        assert kept and set(kept) <= set(all_rows) and all(kept.count(x) == all_rows.count(x) for x in kept)
    sharded = cp.sharding_stage(spark, docs, SF).collect()
    assert len(sharded) == len(rows) and len({(r.shard, r.slot) for r in sharded}) == len(rows)
    sizes = [sum(r.shard == s for r in sharded) for s in range(24)]
    assert max(sizes) - min(sizes) <= 1
