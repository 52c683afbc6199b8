"""WARC archives: a writer and a sequential reader.

Archives hold one gzip member for each record. The reader inflates a file piece by piece, frames each record by
its content length, and verifies digests; it holds one record at a time.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stackloom.llm.common import Scratch, keep, small

#: Payloads from this size on are stored once; archive files end after so many bytes; bytes read at a time.
LEAST, FILE_BYTES, PIECE, LEVEL = 100, 1 << 28, 1 << 20, 3
DATE = "1970-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def _fs(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri if ":/" in uri else f"file://{uri}")


def _digest(data: bytes) -> str:
    return "sha256:" + base64.b32encode(hashlib.sha256(data).digest()).decode().rstrip("=")


def _hex(digest: str) -> str:
    b = digest.partition(":")[2]
    return base64.b32decode(b + "=" * (-len(b) % 8)).hex()


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, revisit: bool, name: str) -> bytes:
    """One record as a gzip member. A revisit has the HTTP head, whose content length is the payload's, and no payload.

    Record ids are made from ``name``, which is unique in a set of archives; pages have headers of their own, as ids of pages may repeat.
    """
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = head if revisit else head + payload
    lines = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: <urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, name)}>", f"WARC-Date: {DATE}"]
    if page_id is not None:
        lines.append(f"Page-Id: {page_id}")
    if url is not None:
        lines.append(f"WARC-Target-URI: {quote(url, safe=':/?#[]@!$&()*+,;=%-._~' + chr(39))}")
    if revisit:
        lines += [f"WARC-Profile: {PROFILE}", f"Refers-To-Page-Id: {refers_to}"]
    lines += [f"WARC-Payload-Digest: {_digest(payload)}", f"WARC-Block-Digest: {_digest(block)}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    z = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
    return z.compress("\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n") + z.flush()


def members(stream) -> Iterator[bytes]:
    """The inflated gzip members of a file, one after another; both sides move in pieces, so no more than a member and two pieces is held."""
    left, z, parts = b"", None, []
    while True:
        if not left:
            left = stream.read(PIECE)
            if not left:
                if z is not None:
                    raise ValueError("the archive ends inside a record")
                return
        z = z or zlib.decompressobj(31)
        parts.append(z.decompress(left, PIECE))
        left = z.unused_data if z.eof else z.unconsumed_tail
        if z.eof:
            yield b"".join(parts)
            z, parts = None, []
        elif not left and len(parts[-1]) == PIECE:  # the output was full: more may be waiting inside
            while more := z.decompress(b"", PIECE):
                parts.append(more)
            if z.eof:
                left = z.unused_data
                yield b"".join(parts)
                z, parts = None, []


def _headers(head: bytes) -> dict[str, str]:
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in head.decode().split("\r\n")[1:])}


def parse(member: bytes) -> tuple[dict[str, str], bytes, bytes]:
    """Headers, HTTP head and payload of a record; raises where framing or a digest is wrong."""
    head, mark, rest = member.partition(b"\r\n\r\n")
    if not mark or not head.startswith(b"WARC/1."):
        raise ValueError("not a WARC record")
    h = _headers(head)
    n = int(h["content-length"])
    block = rest[:n]
    if len(block) != n or rest[n:] != b"\r\n\r\n":
        raise ValueError(f"content length of {h.get('warc-record-id')} does not frame its block")
    if "warc-block-digest" in h and h["warc-block-digest"] != _digest(block):
        raise ValueError(f"block digest of {h.get('warc-record-id')} is wrong")
    http, _, payload = block.partition(b"\r\n\r\n")
    if h["warc-type"] == "response" and h["warc-payload-digest"] != _digest(payload):
        raise ValueError(f"payload digest of {h.get('warc-record-id')} is wrong")
    return h, http, payload


def _page(value: str | None) -> int | None:
    return None if value is None else int(value)


def plan(pages: DataFrame, scratch: Scratch, least: int = LEAST) -> DataFrame:
    """page_id, url, html, and the page each row repeats, if any. Digests with more than one page are counted before the join."""
    p = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.coalesce(F.col("html"), F.lit("")).alias("html"))
    digest = F.when(F.octet_length("html") >= least, F.sha2(F.col("html").cast("binary"), 256))
    repeated = scratch.save(p.select(digest.alias("d"), "page_id").where("d is not null").groupBy("d").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1").drop("n"))
    out = p.withColumn("digest", digest).join(small(repeated), F.col("digest") == F.col("d"), "left")
    return out.select("page_id", "url", "html", F.when(~F.col("page_id").eqNullSafe(F.col("first")), F.col("first")).alias("refers_to"))


def write(rows: DataFrame, root: str) -> DataFrame:
    """Writes the rows of ``plan`` to archives under ``root``; returns a row (path, records) for each file.

    Every attempt of a task writes files of its own, and only those of attempts that ended are returned, so lost
    executors and speculative copies do no harm.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, path = _fs(root)
        fs.create_dir(path, recursive=True)
        task = TaskContext.get()
        out, name, size, count, files, row = None, "", 0, 0, [], 0
        for b in batches:
            for page_id, url, html, refers in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if out is None:
                    name = f"part-{task.partitionId():06d}-{task.taskAttemptId()}-{len(files):04d}.warc.gz"
                    out, size, count = fs.open_output_stream(f"{path}/{name}", compression=None), 0, 0
                data = record(page_id, url, html.encode("utf-8", "surrogatepass"), refers, refers is not None, f"{path}/{task.partitionId()}-{row}")
                row += 1
                out.write(data)
                size, count = size + len(data), count + 1
                if size >= FILE_BYTES:
                    out.close()
                    files.append((name, count))
                    out = None
        if out is not None:
            out.close()
            files.append((name, count))
        yield pa.RecordBatch.from_arrays([pa.array([f"{root}/{n}" for n, _ in files], pa.string()), pa.array([c for _, c in files], pa.int64())], ["path", "records"])

    return rows.mapInArrow(run, "path string, records long")


def read(paths: DataFrame, payloads: bool = False) -> DataFrame:
    """A row for each record of the archives in ``paths`` (path, records); the payload too, if asked for.

    A file that does not hold as many records as ``records`` says is an error.
    """
    names = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", *(["payload"] if payloads else [])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for uri, records in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                fs, path = _fs(uri)
                rows, seen, held = [], 0, 0
                with fs.open_input_stream(path, compression=None) as stream:
                    for m in members(stream):
                        h, http, payload = parse(m)
                        seen += 1
                        revisit = h["warc-type"] == "revisit"
                        rows.append((_page(h.get("page-id")), h.get("warc-target-uri"), int(_headers(http)["content-length"]), _hex(h["warc-payload-digest"]), h["warc-type"], _page(h.get("refers-to-page-id")) if revisit else None, *([payload] if payloads else [])))
                        held += len(payload) * payloads
                        if len(rows) == 4096 or held > 1 << 25:
                            yield batch(rows)
                            rows, held = [], 0
                if records is not None and seen != records:
                    raise ValueError(f"{uri} has {seen} records, {records} were written")
                if rows:
                    yield batch(rows)

    kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), *([pa.binary()] if payloads else [])]

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    return paths.select("path", "records").mapInArrow(run, "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long" + ", payload binary" * payloads)


def verify(rows: DataFrame) -> None:
    """An error where a revisit's digest is not that of the response it refers to, or where that is not there."""
    # sizes of what a reader made are guessed, so no side may be broadcast on a guess
    ends = rows.where("record_type = 'response'").select(F.col("page_id").alias("page_"), F.col("payload_digest").alias("digest_")).hint("merge")
    lost = rows.where("record_type = 'revisit'").join(ends, (F.col("refers_to") == F.col("page_")) & (F.col("payload_digest") == F.col("digest_")), "left_anti").select("page_id", "refers_to").take(1)
    if lost:
        raise ValueError(f"the revisit of page {lost[0]['page_id']} differs from the response of page {lost[0]['refers_to']}")


def round_trip(pages: DataFrame) -> DataFrame:
    """Archives every row of ``pages``, reads the archives back and returns what they say.

    Null html is an empty payload; very long ones are one record. Rows of one page_id are all the response of their payload; where every page_id of a
    payload is null there is no revisit. Extra columns are not read.
    """
    spark = pages.sparkSession
    with Scratch(spark) as scratch:
        root = f"{scratch.root}/archive-{uuid.uuid4().hex}"
        files = scratch.save(write(plan(pages, scratch), root))
        out = keep(read(files.repartition(max(1, files.count()), "path")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"))
        verify(out)
        return out


def round_trip_sql(least: int = LEAST) -> str:
    """DuckDB SQL for the rows of round_trip() over ``pages``."""
    return f"""
    WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
    f AS (SELECT payload_digest, min(page_id) AS first FROM p WHERE payload_bytes >= {least} GROUP BY 1 HAVING count(*) > 1)
    SELECT page_id, payload_bytes::BIGINT AS payload_bytes, p.payload_digest, CASE WHEN first IS NOT NULL AND page_id IS DISTINCT FROM first THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN page_id IS DISTINCT FROM first THEN first END AS refers_to FROM p LEFT JOIN f ON f.payload_digest = p.payload_digest
    """
