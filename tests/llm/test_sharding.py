import zlib

import pytest
from pyspark.sql import functions as F

from furrow.llm.folder import table
from furrow.llm.sharding import SHARDS, domain, numbered, op2_sharding, permute, shard_rows

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("n", [1, 2, 3, 5, 24, 25, 97, 1000, 4099])
def test_permutation_is_a_bijection(spark, n):
    a, b = domain(n)
    assert a * b >= n
    places = [r.p for r in spark.range(n).select(permute(F.col("id"), n).alias("p")).collect()]
    assert sorted(places) == list(range(n))
    if n >= 97:
        assert sum(p == i for i, p in enumerate(places)) < n / 5


def test_large_domains_have_few_places_beyond():
    for n in (10**9 + 7, 10**12 + 39):
        a, b = domain(n)
        assert 0 <= a * b - n <= 64


def test_shards_are_even_gapless_and_reproducible(spark):
    rows = [(i % 50 if i % 7 else None, f"t{i}", "clash") for i in range(203)]
    df = spark.createDataFrame(rows, "doc_id long, text string, shard string")
    one = {(r.doc_id, r.text): (r.shard, r.slot) for r in shard_rows(df, ["doc_id", "text"], 8).collect()}
    two = {(r.doc_id, r.text): (r.shard, r.slot) for r in shard_rows(df.repartition(5), ["doc_id", "text"], 8).collect()}
    assert one == two and len(one) == 203
    slots = {}
    for shard, slot in one.values():
        slots.setdefault(shard, []).append(slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert max(map(len, slots.values())) - min(map(len, slots.values())) <= 1


def test_empty(spark):
    assert shard_rows(spark.createDataFrame([], "doc_id long"), ["doc_id"]).count() == 0


def test_query_against_plain_sums(spark):
    texts = {r.doc_id: r.text for r in table(spark, SF, "documents").collect()}
    rows = op2_sharding(spark, SF).collect()
    assert {r.doc_id for r in rows} == set(texts) and len(rows) == len(texts)
    slots = {}
    for r in rows:
        raw = (texts[r.doc_id] or "").encode()
        assert (r["size"], r.text_crc32, r.law, r.grown_shard) == (len(raw) + 8, zlib.crc32(raw), "rows", None)
        slots.setdefault(r.shard, []).append(r.slot)
    assert set(slots) == set(range(SHARDS)) and all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert max(map(len, slots.values())) - min(map(len, slots.values())) <= 1


def test_nulls_long_texts_and_many_equal_rows(spark, tmp_path):
    rows = [(None, None)] * 4000 + [(7, "é" * 200_000), (8, ""), (None, "x")]
    spark.createDataFrame(rows, "doc_id long, text string").repartition(4).write.parquet(str(tmp_path / "documents.parquet"))
    got = op2_sharding(spark, str(tmp_path)).collect()
    assert len({(r.shard, r.slot) for r in got}) == len(rows)
    by = {r.doc_id: (r["size"], r.text_crc32) for r in got if r.doc_id}
    assert by == {7: (400_008, zlib.crc32(("é" * 200_000).encode())), 8: (8, 0)}
    # no range holds most of the equal rows
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        ranged, n = numbered(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), ["doc_id"])
        sizes = [r["count"] for r in ranged.groupBy(F.input_file_name()).count().collect()]
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert n == len(rows) and sorted(r.row for r in ranged.select("row").collect()) == list(range(n)) and max(sizes) < n / 2
