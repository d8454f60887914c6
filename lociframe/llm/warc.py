"""WARC archives: one gzip member a record, written and read sequentially.

``write_archives`` writes a response record for each page, or a revisit record where an
equal payload of at least ``least_bytes`` is a response already. ``read_archives`` reads the
files as streams: members are inflated bit by bit, records are framed by their
Content-Length, and block and payload digests are verified.

Each task writes its own files under names no other attempt has, and lists them in its
output; only files that a finished task lists are read.

Defined cases: null html is an empty payload; a null url has no WARC-Target-URI; control
characters in a url are percent-encoded; of equal payloads those with the largest page_id
are responses, more than one where that page_id is repeated; a null page_id never is a
revisit.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lociframe.llm.scratch import filesystem, materialize, new_path

DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
BROADCAST_ROWS = 500_000
ARCHIVE_BYTES = 256 << 20
READ = 1 << 18

RECORD = "page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string"


def revisits(pages: DataFrame, least_bytes: int = 1000) -> DataFrame:
    """(page_id, digest, refers_to) of pages whose payload an other page, with a larger page_id, has too."""
    payload = F.coalesce("html", F.lit(""))
    narrow = pages.where(F.octet_length("html") >= least_bytes).select("page_id", F.unhex(F.sha1(payload)).alias("digest"))
    narrow = materialize(narrow, "payloads")
    groups = narrow.groupBy("digest").agg(F.max("page_id").alias("refers_to"), F.count("*").alias("n")).where("n > 1").drop("n")
    groups = materialize(groups, "repeated")
    joined = narrow.join(F.broadcast(groups) if groups.count() <= BROADCAST_ROWS else groups, "digest")
    return materialize(joined.where("page_id < refers_to").select("page_id", "digest", "refers_to").distinct(), "revisits")


def _sha1(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def _record(page_id: int | None, url: str | None, payload: bytes | None, refers_to: int | None, digest: str, length: int) -> bytes:
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % length + (payload or b"")
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <urn:page:{page_id}>", f"WARC-Date: {DATE}"]
    if url is not None:
        head.append("WARC-Target-URI: " + re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url))
    if refers_to is not None:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    head += ["Content-Type: application/http;msgtype=response", f"WARC-Payload-Digest: {digest}", f"WARC-Block-Digest: {_sha1(block)}", f"Content-Length: {len(block)}"]
    pack = zlib.compressobj(6, zlib.DEFLATED, 31)
    return pack.compress("\r\n".join(head).encode() + b"\r\n\r\n") + pack.compress(block) + pack.compress(b"\r\n\r\n") + pack.flush()


def write_archives(pages: DataFrame, folder: str, least_bytes: int = 1000, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Write ``pages`` (page_id, url, html) as archives below ``folder``; returns (path, records, bytes)."""
    again = revisits(pages, least_bytes).withColumnRenamed("page_id", "again_id")
    again = F.broadcast(again) if again.count() <= BROADCAST_ROWS else again
    digest = F.unhex(F.sha1(F.coalesce("html", F.lit(""))))
    rows = pages.select("page_id", "url", "html", digest.alias("sha1"))
    same = (F.col("page_id") == F.col("again_id")) & (F.col("sha1") == F.col("digest")) & (F.octet_length("html") >= least_bytes)
    rows = rows.join(again, same, "left").select(
        "page_id", "url", "refers_to", "sha1", F.coalesce(F.octet_length("html"), F.lit(0)).alias("length"), F.when(F.col("refers_to").isNull(), F.coalesce("html", F.lit(""))).alias("html")
    )

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = filesystem(folder)
        fs.create_dir(root, recursive=True)
        done: list[tuple[str, int, int]] = []
        out, path, records, size = None, "", 0, 0
        for batch in batches:
            for page_id, url, refers_to, sha1, length, html in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if out is None:
                    path, records, size = f"{uuid.uuid4().hex}.warc.gz", 0, 0
                    out = fs.open_output_stream(f"{root}/{path}")
                digest = "sha1:" + base64.b32encode(sha1).decode()
                data = _record(page_id, url, None if html is None else html.encode(), refers_to, digest, length)
                out.write(data)
                records, size = records + 1, size + len(data)
                if size >= archive_bytes:
                    out.close()
                    done.append((f"{folder}/{path}", records, size))
                    out = None
        if out is not None:
            out.close()
            done.append((f"{folder}/{path}", records, size))
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*done, strict=True)], names=["path", "records", "bytes"])

    return materialize(rows.mapInArrow(write, "path string, records long, bytes long"), "archives")


class Member:
    """Bytes of one gzip member of a stream, inflated as they are asked for."""

    def __init__(self, stream, rest: bytes):
        self.stream, self.raw, self.inflate, self.plain = stream, rest, zlib.decompressobj(31), b""

    def _more(self) -> bool:
        if self.inflate.eof:
            return False
        data = self.raw or self.stream.read(READ)
        got = self.inflate.decompress(data, READ)
        if not data and not got and not self.inflate.eof:
            raise ValueError("the archive ends within a record")
        self.plain += got
        self.raw = self.inflate.unconsumed_tail or self.inflate.unused_data
        return True

    def line(self) -> bytes:
        while b"\r\n" not in self.plain:
            if not self._more():
                raise ValueError("a header line has no end")
        line, _, self.plain = self.plain.partition(b"\r\n")
        return line

    def take(self, n: int) -> Iterator[bytes]:
        """``n`` bytes, piece by piece."""
        while n:
            if not self.plain and not self._more():
                raise ValueError("a block is shorter than its Content-Length")
            piece, self.plain = self.plain[:n], self.plain[n:]
            n -= len(piece)
            if piece:
                yield piece

    def end(self) -> bytes:
        """What follows the member in the stream."""
        while self._more():
            pass
        if self.plain != b"\r\n\r\n":
            raise ValueError("a record does not end as it should")
        return self.inflate.unused_data


def records(stream) -> Iterator[dict]:
    """Records of one archive in order, with their payload's length and verified digests."""
    rest = stream.read(READ)
    while rest:
        member = Member(stream, rest)
        if not member.line().startswith(b"WARC/"):
            raise ValueError("not a WARC record")
        head: dict[str, str] = {}
        while line := member.line():
            name, _, value = line.decode().partition(":")
            head[name.strip().lower()] = value.strip()
        block, payload, http, length = hashlib.sha1(), hashlib.sha1(), b"", 0
        in_http = True
        for piece in member.take(int(head["content-length"])):
            block.update(piece)
            if in_http:
                http += piece
                if (at := http.find(b"\r\n\r\n")) < 0:
                    continue
                in_http, http, piece = False, http[:at], http[at + 4 :]
            payload.update(piece)
            length += len(piece)
        name = lambda h: "sha1:" + base64.b32encode(h.digest()).decode()
        if head["warc-block-digest"] != name(block):
            raise ValueError(f"block digest of {head['warc-record-id']} differs")
        said = int(re.search(rb"(?i)\r\ncontent-length:\s*(\d+)", http)[1])
        if head["warc-type"] == "response" and (head["warc-payload-digest"] != name(payload) or said != length):
            raise ValueError(f"payload of {head['warc-record-id']} differs")
        yield head | {"payload_bytes": said}
        rest = member.end() or stream.read(READ)


def _page(urn: str | None) -> int | None:
    found = re.fullmatch(r"<urn:page:(-?\d+)>", urn or "")
    return int(found[1]) if found else None


def read_archives(archives: DataFrame) -> DataFrame:
    """Records of the archives that ``archives`` lists by ``path``, one task a file or several."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column(0).to_pylist():
                fs, at = filesystem(path)
                rows: list[tuple] = []
                with fs.open_input_stream(at) as stream:
                    for r in records(stream):
                        digest = base64.b32decode(r["warc-payload-digest"].removeprefix("sha1:")).hex()
                        rows.append((_page(r["warc-record-id"]), r.get("warc-target-uri"), r["warc-type"], _page(r.get("warc-refers-to")), r["payload_bytes"], digest))
                        if len(rows) == 4096:
                            yield _batch(rows)
                            rows = []
                if rows:
                    yield _batch(rows)

    files = archives.select("path")
    return files.repartition(max(1, min(files.count(), 10_000))).mapInArrow(read, RECORD)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    types = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string()]
    names = ["page_id", "url", "record_type", "refers_to", "payload_bytes", "payload_digest"]
    return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)


def round_trip(pages: DataFrame) -> DataFrame:
    """Write all pages to new archives and read the records back."""
    return read_archives(write_archives(pages, new_path(pages.sparkSession, "warc")))
