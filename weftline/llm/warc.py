"""WARC archives: one gzip member per record, written by Spark and read sequentially.

Writing goes through Spark's text writer, so files appear by its commit
protocol, on any file system it knows, and a lost executor's attempt leaves
nothing behind. A record is one gzip member; members are strung together up to
``FILE_BYTES``, and that is one row of the writer and one file. A member's last
byte, the top of its length, is zero below 16 MiB, and that byte is what the
writer puts after each row. A larger record is followed by an empty member,
which ends so too.

Reading takes one archive at a time, of bounded size, or of one record where a
record is larger. It inflates a member bit by bit, finds the header's end,
takes Content-Length bytes as the block, checks what must follow, and
recomputes the digest. A revisit states its payload's size and digest; both
are checked against the response that was read back.

Defined results: null html is an empty payload, a null url an ``urn:`` of its
own; of records with equal payloads of ``least_bytes`` or more the one with
the smallest page_id is a response and the others revisit it; rows that repeat
that page_id are responses too; rows without page_id revisit if any row with
one has the payload, else are responses; an empty table writes no record and
gives an empty one; other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import io
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.session import materialize, scratch_path

DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Bytes at which an archive ends; a record is never split.
FILE_BYTES = 32 << 20
#: Pages with a copy of their payload before them that are broadcast to the writers, at most.
MOST_BROADCAST = 1_000_000
#: Bytes read, and inflated, at a time.
CHUNK = 1 << 16
EMPTY_MEMBER = bytes.fromhex("1f8b08000000000000ff0300") + bytes(8)


class BadArchive(ValueError):
    """What a reader raises for bytes that break the format or a digest."""


def base32_sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_id(page_id: int | None) -> str:
    return f"<urn:x-page:{'none' if page_id is None else page_id}>"


def make_record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    """A record as a gzip member: a response, or a revisit of page ``refers_to``."""
    target = quote(url, safe="%:/?#[]@!$&'()*+,;=~") if url else f"urn:x-page:{page_id}"
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if refers_to is not None else http + payload
    head = [
        "WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {record_id(page_id)}", f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {target}", "Content-Type: application/http; msgtype=response",
        f"WARC-Payload-Digest: sha1:{base32_sha1(payload)}", f"WARC-Block-Digest: sha1:{base32_sha1(block)}", f"Content-Length: {len(block)}",
    ]
    if refers_to is not None:
        head += [f"WARC-Refers-To: {record_id(refers_to)}", f"WARC-Profile: {PROFILE}"]
    deflate = zlib.compressobj(6, zlib.DEFLATED, 31)
    member = deflate.compress("\r\n".join(head).encode() + b"\r\n\r\n") + deflate.compress(block) + deflate.compress(b"\r\n\r\n") + deflate.flush()
    return member if member[-1] == 0 else member + EMPTY_MEMBER


class Member:
    """One gzip member of a stream, inflated as it is asked for."""

    def __init__(self, stream, ahead: bytes):
        self.stream, self.ahead, self.inflate, self.ready = stream, ahead, zlib.decompressobj(31), b""

    def _more(self) -> bool:
        if self.inflate.eof:
            return False
        if not self.ahead:
            self.ahead = self.stream.read(CHUNK)
            if not self.ahead:
                raise BadArchive("the file ends within a member")
        try:
            self.ready += self.inflate.decompress(self.ahead, CHUNK)
        except zlib.error as e:
            raise BadArchive(str(e)) from e
        self.ahead = self.inflate.unused_data if self.inflate.eof else self.inflate.unconsumed_tail
        return True

    def until(self, mark: bytes) -> bytes:
        """What lies before ``mark``; takes the mark too. Empty if the member is."""
        while (at := self.ready.find(mark)) < 0:
            if not self._more():
                if self.ready:
                    raise BadArchive("a header doesn't end")
                return b""
        out, self.ready = self.ready[:at], self.ready[at + len(mark) :]
        return out

    def take(self, n: int) -> Iterator[bytes]:
        """The next n bytes in pieces."""
        while n:
            if not self.ready and not self._more():
                raise BadArchive("a block is shorter than its Content-Length")
            piece, self.ready = self.ready[:n], self.ready[n:]
            n -= len(piece)
            if piece:
                yield piece

    def end(self) -> bytes:
        """Checks that nothing but the record's end is left; what of the stream was read beyond."""
        while self._more():
            pass
        if self.ready != b"\r\n\r\n":
            raise BadArchive("a record doesn't end after its block")
        return self.ahead


def fields(head: bytes) -> dict[str, str]:
    lines = head.decode("utf-8").split("\r\n")
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])} | {"": lines[0]}


def read_records(stream, keep_payload: bool = False) -> Iterator[tuple[dict[str, str], int, str, bytes | None]]:
    """(header fields, payload bytes, payload digest, payload if kept) of each record of a stream, digests verified.

    Of a revisit the bytes and the digest are those its headers give for the
    full payload, which ``check_revisits`` compares with the response.
    """
    ahead = b""
    while ahead or (ahead := stream.read(CHUNK)):
        member = Member(stream, ahead)
        head = member.until(b"\r\n\r\n")
        if not head:  # an empty member
            ahead = member.ahead
            continue
        got = fields(head)
        if not got[""].startswith("WARC/") or not got.get("content-length", "").isdigit():
            raise BadArchive("no record header")
        whole, own, http, kept = hashlib.sha1(), hashlib.sha1(), b"", []
        inside, size = False, 0
        for piece in member.take(int(got["content-length"])):
            whole.update(piece)
            if not inside:
                http += piece
                at = http.find(b"\r\n\r\n")
                if at < 0:
                    continue
                inside, piece, http = True, http[at + 4 :], http[:at]
            own.update(piece)
            size += len(piece)
            if keep_payload:
                kept.append(piece)
        if not inside:
            raise BadArchive("a block without an HTTP header")
        ahead = member.end()
        if got.get("warc-block-digest") != "sha1:" + base64.b32encode(whole.digest()).decode():
            raise BadArchive("a block's digest differs")
        stated = got["warc-payload-digest"].removeprefix("sha1:")
        if got["warc-type"] == "revisit":
            yield got, int(fields(http)["content-length"]), stated, None
            continue
        if base64.b32encode(own.digest()).decode() != stated:
            raise BadArchive("a payload's digest differs")
        yield got, size, stated, b"".join(kept) if keep_payload else None


def _page(urn: str | None) -> int | None:
    text = (urn or "").removeprefix("<urn:x-page:").removesuffix(">")
    return int(text) if text.lstrip("-").isdigit() else None


def write(pages: DataFrame, path: str, least_bytes: int = 0, file_bytes: int = FILE_BYTES, most_broadcast: int = MOST_BROADCAST) -> None:
    """Archives of ``pages`` (page_id, url, html) at ``path``.

    Which record is the response comes from a partially aggregated minimum of
    ids by payload hash, over the payloads that occur twice or more. They go
    to the pages by broadcast if they are ``most_broadcast`` at most, so that
    payloads stay where they are; beyond, by a join that may be split where
    one payload is hot.
    """
    rows = pages.select("page_id", F.col("url").cast("string").alias("url"), F.coalesce("html", F.lit("")).cast("binary").alias("payload"))
    rows = rows.withColumn("hash", F.sha2("payload", 256))
    first = rows.where(F.length("payload") >= least_bytes).groupBy("hash").agg(F.min("page_id").alias("first"), F.count("*").alias("n"))
    first = materialize(first.where("n > 1 AND first IS NOT NULL").select("hash", "first"), "first")
    few = first.limit(most_broadcast + 1).count() <= most_broadcast
    joined = rows.join(F.broadcast(first) if few else first, "hash", "left")
    refers = F.when(~F.col("page_id").eqNullSafe(F.col("first")), F.col("first"))

    def build(batches):
        held: list[bytes] = []
        size = 0
        for b in batches:
            for x in zip(*(b.column(c).to_pylist() for c in ("page_id", "url", "payload", "refers"))):
                held.append(make_record(*x))
                size += len(held[-1])
                if size >= file_bytes:
                    yield pa.RecordBatch.from_arrays([pa.array([b"".join(held)[:-1]], pa.binary())], ["value"])
                    held, size = [], 0
        if held:
            yield pa.RecordBatch.from_arrays([pa.array([b"".join(held)[:-1]], pa.binary())], ["value"])

    made = joined.select(F.col("page_id").cast("long").alias("page_id"), "url", "payload", refers.cast("long").alias("refers")).mapInArrow(build, "value binary")
    # the writer copies the bytes of a string as they are
    made.select(F.col("value").cast("string").alias("value")).write.option("lineSep", "\x00").option("maxRecordsPerFile", 1).text(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    """One row per record of the archives at ``path``: page_id, payload_bytes, payload_digest, record_type, refers_to."""

    def parse(batches):
        for b in batches:
            for content in b.column("content"):
                found = [(_page(h["warc-record-id"]), n, d, h["warc-type"], _page(h.get("warc-refers-to"))) for h, n, d, _ in read_records(io.BytesIO(content.as_buffer()))]
                kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()]
                columns = list(zip(*found)) or [[]] * 5
                yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds)], ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"])

    files = spark.read.format("binaryFile").load(path).where(F.col("length") > 0).select("content")
    return files.mapInArrow(parse, "page_id bigint, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint")


def check_revisits(records: DataFrame) -> None:
    """Raises unless every revisit states the size and digest of a response that was read, whose digest was recomputed.

    Revisits of one page are one row before they meet its response.
    """
    stated = records.where("record_type = 'revisit'").select("refers_to", "payload_bytes", "payload_digest").distinct()
    held = records.where("record_type = 'response'").select(F.col("page_id").alias("refers_to"), "payload_bytes", "payload_digest").distinct()
    lost = stated.join(held, ["refers_to", "payload_bytes", "payload_digest"], "left_anti").limit(1).collect()
    if lost:
        raise BadArchive(f"a revisit's response is missing or differs: {lost[0]}")


def round_trip(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """``pages`` written to archives in the shared folder and read back, revisits checked against their responses."""
    path = scratch_path(pages.sparkSession, "warc")
    write(pages, path, least_bytes)
    records = materialize(read(pages.sparkSession, path), "records")
    check_revisits(records)
    return records


ORACLE = """
WITH p AS (
  SELECT page_id, encode(coalesce(html, '')) AS b FROM pages
), f AS (
  SELECT *, min(page_id) OVER (PARTITION BY b) AS first FROM p
), h AS (
  SELECT *, list_transform(range(8), lambda i: CAST('0x' || substr(sha1(b), CAST(5 * i + 1 AS BIGINT), 5) AS BIGINT)) AS x FROM f
)
SELECT page_id, octet_length(b) AS payload_bytes,
       array_to_string(list_transform(x, lambda v: array_to_string(list_transform([15, 10, 5, 0], lambda s: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((v >> s) & 31) + 1, 1)), '')), '') AS payload_digest,
       CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> first THEN first END AS refers_to
FROM h
"""
