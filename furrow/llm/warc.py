"""WARC archives: a writer of whole-file gzip streams, their normaliser, and a reader by offset.

``write_archives`` makes one monolithic gzip stream per partition. ``normalise``
inflates each stream once, rewrites every record as a gzip member of its own and
writes a sidecar index of offsets. ``read_records`` fetches members by offset.
Files go to the cluster's shared folder under a name of the attempt and are then
moved, so a repeated or speculative task leaves whole files only.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyarrow import fs as afs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from furrow.llm.folder import new_folder, table, written

_DATE = "2024-01-01T00:00:00Z"
_HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def _files(folder: str) -> tuple[afs.FileSystem, str]:
    return afs.FileSystem.from_uri(folder) if "://" in folder or folder.startswith("file:") else (afs.LocalFileSystem(), folder)


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    """A response record, or a revisit record without the payload if refers_to is given."""
    name = lambda i: uuid.uuid5(uuid.NAMESPACE_URL, f"page:{i}").urn
    uri = quote(url, safe="!#$%&'()*+,/:;=?@[]~") if url else f"urn:page:{page_id}"
    head = [
        "WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <{name(page_id)}>", f"WARC-Date: {_DATE}", f"WARC-Target-URI: {uri}",
        f"WARC-Payload-Digest: sha1:{digest(payload)}", f"X-Payload-Length: {len(payload)}", "Content-Type: application/http; msgtype=response",
    ]
    if page_id is not None:
        head.append(f"X-Page-ID: {page_id}")
    if refers_to is not None:
        head += [f"WARC-Profile: {_PROFILE}", f"WARC-Refers-To: <{name(refers_to)}>", f"X-Refers-To-Page-ID: {refers_to}"]
    block = _HTTP % len(payload) + (payload if refers_to is None else b"")
    head.append(f"Content-Length: {len(block)}")
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def _headers(lines: bytes) -> dict[str, str]:
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines.decode().split("\r\n")[1:]) if k}


def records(stream: io.BufferedIOBase) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, whole record) one after the other from an inflated stream; a cut-off record is a ValueError."""
    while line := stream.readline():
        if not line.strip():
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError(f"not the start of a WARC record: {line[:40]!r}")
        head = [line]
        while (line := stream.readline()) not in (b"\r\n", b"\n"):
            if not line:
                raise ValueError("the stream ends within a record's head")
            head.append(line)
        top = b"".join(head)
        found = _headers(top)
        body = stream.read(size := int(found["content-length"]))
        if len(body) < size:
            raise ValueError("the stream ends within a record's block")
        yield found, top + b"\r\n" + body + b"\r\n\r\n"


def write_archives(pages: DataFrame, folder: str) -> DataFrame:
    """Archives of pages (page_id, url, payload binary, refers_to): (path, records) of one gzip stream per partition."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        files, root = _files(folder)
        files.create_dir(root, recursive=True)
        path, n = f"{root}/part-{task.partitionId():06d}.warc.gz", 0
        part = f"{root}/.{task.taskAttemptId()}-{uuid.uuid4().hex}"
        with files.open_output_stream(part) as out:
            pack = zlib.compressobj(6, zlib.DEFLATED, 31)
            for batch in batches:
                for page, url, payload, refers in zip(*(batch.column(k) for k in ("page_id", "url", "payload", "refers_to")), strict=True):
                    out.write(pack.compress(record(page.as_py(), url.as_py(), payload.as_py() or b"", refers.as_py())))
                    n += 1
            out.write(pack.flush())
        if n:
            files.move(part, path)
            yield pa.RecordBatch.from_pydict({"path": [path], "records": pa.array([n], pa.int64())})
        else:
            files.delete_file(part)

    return pages.select("page_id", "url", "payload", "refers_to").mapInArrow(write, "path string, records long")


def normalise(archives: DataFrame, folder: str) -> DataFrame:
    """Each archive of archives (path) with a gzip member per record, and a sidecar .cdx of tab-separated page, offset, length.

    Returns (path, index, records). The stream is inflated once, a record at a
    time in memory; an archive that has a member per record already comes out
    the same way. The monolithic archive is left in place.
    """

    def rewrite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, root = _files(folder)
        files.create_dir(root, recursive=True)
        attempt = f"{TaskContext.get().taskAttemptId()}-{uuid.uuid4().hex}"
        for batch in batches:
            for path in batch.column("path").to_pylist():
                name = path.rsplit("/", 1)[-1]
                at, n, index = 0, 0, f"{root}/{name.removesuffix('.warc.gz')}.cdx"
                with files.open_input_stream(path, compression=None) as raw, files.open_output_stream(f"{root}/.{attempt}-{name}", compression=None) as out, files.open_output_stream(f"{root}/.{attempt}-cdx") as cdx:
                    for head, whole in records(io.BufferedReader(gzip.GzipFile(fileobj=raw), 1 << 16)):
                        pack = zlib.compressobj(6, zlib.DEFLATED, 31)
                        member = pack.compress(whole) + pack.flush()
                        out.write(member)
                        cdx.write(f"{head.get('x-page-id', '')}\t{at}\t{len(member)}\t{root}/{name}\n".encode())
                        at, n = at + len(member), n + 1
                files.move(f"{root}/.{attempt}-{name}", f"{root}/{name}")
                files.move(f"{root}/.{attempt}-cdx", index)
                yield pa.RecordBatch.from_pydict({"path": [f"{root}/{name}"], "index": [index], "records": pa.array([n], pa.int64())})

    return archives.select("path").mapInArrow(rewrite, "path string, index string, records long")


def read_records(index: DataFrame, folder: str) -> DataFrame:
    """Records named by index (path, offset, length), each from its own member: headers and payload digest.

    A response's payload is hashed anew and must agree with its header.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, _ = _files(folder)
        opened: tuple[str, pa.NativeFile] | None = None
        for batch in batches:
            rows: dict[str, list] = {k: [] for k in ("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")}
            for path, at, size in zip(*(batch.column(k).to_pylist() for k in ("path", "offset", "length")), strict=True):
                if opened is None or opened[0] != path:
                    opened = (path, files.open_input_file(path))
                opened[1].seek(at)
                top, _, block = zlib.decompress(opened[1].read(size), 31).partition(b"\r\n\r\n")
                head = _headers(top)
                given = head["warc-payload-digest"].removeprefix("sha1:")
                if head["warc-type"] == "response":
                    payload = block[: int(head["content-length"])].partition(b"\r\n\r\n")[2]
                    if digest(payload) != given or len(payload) != int(head["x-payload-length"]):
                        raise ValueError(f"payload of {path} at {at} does not agree with its head")
                rows["page_id"].append(int(head["x-page-id"]) if "x-page-id" in head else None)
                rows["payload_bytes"].append(int(head["x-payload-length"]))
                rows["payload_digest"].append(given)
                rows["record_type"].append(head["warc-type"])
                rows["refers_to"].append(int(head["x-refers-to-page-id"]) if "x-refers-to-page-id" in head else None)
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(rows.values(), kinds, strict=True)], names=list(rows))

    return index.select("path", "offset", "length").mapInArrow(read, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")


def with_revisits(pages: DataFrame) -> DataFrame:
    """pages (page_id, url, html) as page_id, url, payload (UTF-8; null: empty) and refers_to.

    Of pages with equal payloads the smallest page_id is the response
    (refers_to null), the others refer to it. Rows that repeat that id with that
    payload are responses too; a null id is a response only if all its equals
    have null ids. The response of each digest is found by sums; digests and ids
    alone (no payloads) meet it, in a join that Spark splits where a payload is
    that of very many pages, and payloads meet by page and digest.
    """
    pages = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", F.coalesce(F.col("html").cast("binary"), F.lit(b"")).alias("payload")).withColumn("sha", F.sha1("payload"))
    first = pages.groupBy("sha").agg(F.min("page_id").alias("response"))
    known = pages.select("page_id", "sha").distinct().join(first, "sha").withColumnsRenamed({"page_id": "__id", "sha": "__sha"})
    both = pages.join(known, (F.col("sha") == F.col("__sha")) & F.col("page_id").eqNullSafe(F.col("__id")))
    refers = F.when(~F.col("page_id").eqNullSafe(F.col("response")), F.col("response"))
    return both.select("page_id", "url", "payload", refers.alias("refers_to"))


def archive_round_trip(pages: DataFrame) -> DataFrame:
    """pages written as monolithic archives, normalised, and read back by the sidecar index. No page, no archive, no row."""
    spark = pages.sparkSession
    root = new_folder(spark, "warc")
    archives = written(write_archives(with_revisits(pages), f"{root}/raw"), "archives")
    tasks = max(1, archives.count())
    normal = written(normalise(archives.repartition(tasks), f"{root}/normal"), "normal")
    if not normal.count():
        return spark.createDataFrame([], "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")
    index = spark.read.schema("page string, offset long, length long, path string").option("sep", "\t").csv(f"{root}/normal/*.cdx")
    return read_records(index, f"{root}/normal")


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archive_round_trip(table(spark, sf_dir, "pages"))


OP1_SQL = """
WITH p AS (
  SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS h FROM pages
), q AS (
  SELECT page_id, CAST(strlen(html) AS BIGINT) AS payload_bytes, h, min(page_id) OVER (PARTITION BY h) AS response FROM p
)
SELECT page_id, payload_bytes,
  array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + CAST(((CAST('0x' || substr(h, CAST(1 + 5 * (i // 4) AS BIGINT), 5) AS BIGINT) >> CAST(15 - 5 * (i % 4) AS BIGINT)) & 31) AS BIGINT), 1)), '') AS payload_digest,
  CASE WHEN page_id IS DISTINCT FROM response THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN page_id IS DISTINCT FROM response THEN response END AS refers_to
FROM q
"""
