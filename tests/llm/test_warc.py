import base64
import gzip
import hashlib
import io

import pytest

from furrow.llm.folder import shared_folder
from furrow.llm.warc import archive_round_trip, normalise, record, records, with_revisits, write_archives

SCHEMA = "page_id long, url string, html string, payload string"


def test_round_trip_with_revisits_nulls_and_repeats(spark):
    rows = [(3, "http://a/é b", "<p>x</p>", "z"), (1, None, "<p>x</p>", None), (2, "u\n", None, ""), (4, "u", "", ""), (5, "v", "é" * 100_000, ""), (None, "w", "<p>x</p>", ""), (7, "r", "same", ""), (7, "r", "same", "")]
    out = archive_round_trip(spark.createDataFrame(rows, SCHEMA)).collect()
    got = sorted((r.page_id or -1, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in out)
    expected = []
    for page, _, html, _ in rows:
        payload = (html or "").encode()
        least = min(p for p, _, h, _ in rows if p is not None and (h or "") == (html or ""))
        first = page == least
        expected.append((page or -1, len(payload), base64.b32encode(hashlib.sha1(payload).digest()).decode(), "response" if first else "revisit", None if first else least))
    assert got == sorted(expected)


def test_empty_table(spark):
    assert archive_round_trip(spark.createDataFrame([], SCHEMA)).count() == 0


def test_every_record_is_a_member_at_its_offset(spark, tmp_path):
    pages = spark.createDataFrame([(i, f"http://h/{i}", "t" * i, "") for i in range(20)], SCHEMA).coalesce(1)
    raw = write_archives(with_revisits(pages).coalesce(1), f"file://{tmp_path}/raw").collect()
    normal = normalise(spark.createDataFrame(raw), f"file://{tmp_path}/n").collect()
    assert sum(r.records for r in raw) == 20 == sum(r.records for r in normal)
    mono = open(raw[0].path, "rb").read()
    data = open(normal[0].path, "rb").read()
    assert gzip.decompress(mono) == gzip.decompress(data)
    for line in open(normal[0]["index"]):
        page, at, size, _ = line.rstrip("\n").split("\t")
        (head, _), = records(io.BytesIO(gzip.decompress(data[int(at) : int(at) + int(size)])))
        assert head["x-page-id"] == page


def test_cut_off_records_are_errors():
    whole = record(1, "http://a", b"payload", None)
    with pytest.raises(ValueError):
        list(records(io.BytesIO(whole[:-20])))
    with pytest.raises(ValueError):
        list(records(io.BytesIO(b"HTTP/1.1 200\r\n\r\n")))


def test_shared_folder_is_one(spark):
    assert shared_folder(spark) == shared_folder(spark)
