"""A content-addressed WARC archive.

Payloads are stored once under their SHA-256, compressed one by one; the exact header block of every record (WARC and HTTP headers) is
stored apart with the digest that it refers to. A record is rebuilt as header, payload and the closing line ends by a join on the
digest, and no payload is handed out whose digest is another than its key. Of equal payloads of at least `least_bytes` bytes the page
with the greatest page_id is the response and the others are revisits of it.

Writing moves the page's key and digest through one shuffle and payloads, compressed and without the copies that stand near each other
in the input, through another; reading moves payloads once. A payload that a third of all pages have is one row of the store; the pages are joined with it from tables that are read
from files, so Spark splits the hot digest.

Results, by case: a null html is an empty payload; a null url has no WARC-Target-URI, and line ends in a url are percent-encoded; a
null page_id is less than all others, and its record has no number; rows with one page_id and one payload are all responses if one is;
a table without rows gives an archive without records; extra columns are left out. A payload is held whole in memory, alone.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vertexloom.llm.scratch import Scratch
from vertexloom.llm.textops import pieces, text_buffers

FIRST_ID = -(1 << 63)
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "1970-01-01T00:00:00Z"
END = b"\r\n\r\n"
_RECORD = re.compile(rb"WARC/1\.1\r\n(.*?)\r\n\r\n", re.S)


@dataclass
class Archive:
    """Where the tables are: heads (page_id, record_type, refers_to, digest, head) and payloads (digest, body)."""

    spark: object
    heads: str
    payloads: str

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(getattr(self, name))


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _payloads(batch: pa.RecordBatch) -> list[bytes]:
    data, offs = text_buffers(batch.column(batch.schema.get_field_index("html")))
    return [data[a:b].tobytes() for a, b in zip(offs[:-1], offs[1:], strict=True)]


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in pieces(batches, "html"):
        body = _payloads(batch)
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([hashlib.sha256(b).digest() for b in body], pa.binary()), pa.array(list(map(base32_sha1, body)), pa.string()), pa.array(list(map(len, body)), pa.int64())], ["page_id", "url", "digest", "sha1", "n"])


def _compressed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of equal payloads in 32 MB of pages only that with the greatest page_id goes on: no other can be the response."""
    squeeze = zstandard.ZstdCompressor(level=3)
    for batch in pieces(batches, "html", most=32 << 20):
        body, page = _payloads(batch), [FIRST_ID if p is None else p for p in batch.column(0).to_pylist()]
        digests = [hashlib.sha256(b).digest() for b in body]
        best: dict[bytes, int] = {}
        for i, d in enumerate(digests):
            if d not in best or page[i] > page[best[d]]:
                best[d] = i
        keep = sorted(best.values())
        yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(keep, pa.int64())), pa.array([digests[i] for i in keep], pa.binary()), pa.array([squeeze.compress(body[i]) for i in keep], pa.binary())], ["page_id", "digest", "body"])


def _heads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The exact header blocks."""
    for batch in batches:
        out = []
        for page, url, sha1, n, kind, refers in zip(*(batch.column(batch.schema.get_field_index(k)).to_pylist() for k in ("page_id", "url", "sha1", "n", "record_type", "refers_to")), strict=True):
            http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {n}\r\n\r\n"
            target = [] if url is None else ["WARC-Target-URI: " + url.replace("\r", "%0D").replace("\n", "%0A")]
            link = [f"WARC-Refers-To: <urn:page:{refers}>", f"WARC-Profile: {PROFILE}"] if kind == "revisit" else []
            size = len(http) + (n if kind == "response" else 0)
            lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:page:{'' if page is None else page}>", f"WARC-Date: {DATE}", *target, f"WARC-Payload-Digest: sha1:{sha1}", *link, "Content-Type: application/http; msgtype=response", f"Content-Length: {size}"]
            out.append("\r\n".join(lines) + "\r\n\r\n" + http)
        keep = [batch.schema.get_field_index(k) for k in ("page_id", "record_type", "refers_to", "digest")]
        yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in keep), pa.array(out, pa.string())], ["page_id", "record_type", "refers_to", "digest", "head"])


def write(pages: DataFrame, scratch: Scratch, least_bytes: int = 0) -> Archive:
    """An archive with a record for each row of pages (page_id, url, html), in the scratch folder."""
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), "html")
    known = scratch.table(rows.mapInArrow(_digests, "page_id long, url string, digest binary, sha1 string, n long"), "digests")
    origin = scratch.table(known.groupBy("digest").agg(F.max(F.coalesce("page_id", F.lit(FIRST_ID))).alias("origin")), "origins")
    own = F.coalesce("page_id", F.lit(FIRST_ID)) == F.col("origin")
    response = own | (F.col("n") < least_bytes)
    placed = known.join(origin, "digest").select("page_id", "url", "digest", "sha1", "n", F.when(response, "response").otherwise("revisit").alias("record_type"), F.when(~response, F.col("origin")).alias("refers_to"))
    placed.mapInArrow(_heads, "page_id long, record_type string, refers_to long, digest binary, head string").write.parquet(scratch.path("heads"))
    bodies = rows.select("page_id", "html").mapInArrow(_compressed, "page_id long, digest binary, body binary").withColumn("origin", F.coalesce("page_id", F.lit(FIRST_ID)))
    # one row for each digest; a page that occurs twice with one payload is stored once
    bodies.join(origin, ["digest", "origin"]).select("digest", "origin", "body").dropDuplicates(["digest", "origin"]).select("digest", "body").write.parquet(scratch.path("payloads"))
    scratch.drop("digests", "origins")
    return Archive(pages.sparkSession, scratch.path("heads"), scratch.path("payloads"))


def _opened(digest: bytes, body: bytes) -> bytes:
    payload = zstandard.ZstdDecompressor().decompress(body) if len(body) else b""
    if hashlib.sha256(payload).digest() != digest:
        raise ValueError(f"a stored payload does not have the digest {digest.hex()}")
    return payload


def records(archive: Archive) -> DataFrame:
    """page_id and the bytes of each record, rebuilt."""
    heads = archive.table("heads")
    whole = heads.where("record_type = 'response'").join(archive.table("payloads"), "digest").select("page_id", "head", "digest", "body")

    def join_bytes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in pieces(batches, "body", most=1 << 20):
            _, head, digest, body = (c.to_pylist() for c in part.columns)
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array([h.encode() + _opened(d, b) + END for h, d, b in zip(head, digest, body, strict=True)], pa.binary())], ["page_id", "record"])

    rest = heads.where("record_type = 'revisit'").select("page_id", F.concat(F.col("head").cast("binary"), F.lit(END)).alias("record"))
    return whole.mapInArrow(join_bytes, "page_id long, record binary").union(rest)


def parse(record: bytes) -> dict:
    """The headers and the block of one record; the block's length and the payload's digest are verified."""
    m = _RECORD.match(record)
    if not m or not record.endswith(END):
        raise ValueError("not a record of WARC/1.1")
    head = dict(line.split(": ", 1) for line in m[1].decode().split("\r\n"))
    block = record[m.end() : -len(END)]
    if len(block) != int(head["Content-Length"]):
        raise ValueError("the block of a record is shorter or longer than its Content-Length")
    http, _, payload = block.partition(b"\r\n\r\n")
    if head["WARC-Type"] == "response" and head["WARC-Payload-Digest"] != f"sha1:{base32_sha1(payload)}":
        raise ValueError("the payload of a record does not have its digest")
    size = int(re.search(rb"Content-Length: (\d+)", http)[1])
    return {"headers": head, "payload": payload, "payload_bytes": len(payload) if head["WARC-Type"] == "response" else size}


def _number(uri: str | None) -> int | None:
    digits = (uri or "").removeprefix("<urn:page:").removesuffix(">")
    return int(digits) if digits else None


def listing(found: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type and refers_to, read from the records' bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "record"):
            got = [parse(r) for r in batch.column(0).to_pylist()]
            heads = [g["headers"] for g in got]
            yield pa.RecordBatch.from_arrays([
                pa.array([_number(h["WARC-Record-ID"]) for h in heads], pa.int64()),
                pa.array([g["payload_bytes"] for g in got], pa.int64()),
                pa.array([h["WARC-Payload-Digest"].removeprefix("sha1:") for h in heads], pa.string()),
                pa.array([h["WARC-Type"] for h in heads], pa.string()),
                pa.array([_number(h.get("WARC-Refers-To")) for h in heads], pa.int64()),
            ], ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"])

    return found.select("record").mapInArrow(run, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")


def restore(archive: Archive) -> DataFrame:
    """page_id and the html of every page, revisits included."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in pieces(batches, "body", most=1 << 20):
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array([_opened(d, b).decode("utf-8", "replace") for d, b in zip(part.column(1).to_pylist(), part.column(2).to_pylist(), strict=True)], pa.string())], ["page_id", "html"])

    return archive.table("heads").select("page_id", "digest").join(archive.table("payloads"), "digest").select("page_id", "digest", "body").mapInArrow(run, "page_id long, html string")


def export(found: DataFrame, path: str) -> None:
    """Records as files that any WARC reader takes: Spark's text writer, with the end of a record for the end of a line."""
    text = F.expr("substring(record, 1, octet_length(record) - 4)").cast("string")
    found.select(text.alias("value")).write.option("lineSep", "\r\n\r\n").option("compression", "gzip").text(path)
