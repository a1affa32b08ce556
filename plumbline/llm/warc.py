"""Operator 10: WARC archives, one gzip member a record, and a sequential reader.

`write_archives` stores one record per page in real ``.warc.gz`` files under
the shared folder. Of the pages with an equal payload of at least `min_bytes`
bytes, the one with the smallest page_id becomes a response record; the others
become revisit records without a body that carry the full payload's digest and
length. `read_archives` goes through the files front to back: zlib inflates
member by member, Content-Length frames the blocks, and SHA-1 digests are
verified. A truncated member, a bad frame or a wrong digest raises ValueError.

Defined cases: null html is an empty payload; null page_id sorts after every
number, so such a page is the response only where no numbered page has its
payload; repeated rows of the response's page_id are responses too; a null url
becomes ``urn:page:unknown``; an empty table gives no archive and no row.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from typing import BinaryIO

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm import common

VERSION = b"WARC/1.1"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "1970-01-01T00:00:00Z"
#: A new archive begins once the present one has so many bytes.
ROLL_BYTES = 1 << 30
HTTP_HEAD = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"


def digest32(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def _header_value(value: str) -> str:
    """A header value on one line: control characters percent-encoded."""
    return "".join(c if c >= " " and c != "\x7f" else f"%{ord(c):02X}" for c in value)


def encode_record(page_id: int | None, url: str | None, payload: bytes, revisits: bool, refers_to: int | None, record_id: str) -> bytes:
    """One record as a gzip member of its own."""
    head = {"WARC-Type": "revisit" if revisits else "response", "WARC-Record-ID": f"<urn:uuid:{record_id}>", "WARC-Date": DATE, "WARC-Target-URI": _header_value(url or "urn:page:unknown")}
    head |= {"WARC-Payload-Digest": f"sha1:{digest32(payload)}", "X-Payload-Length": str(len(payload))}
    if page_id is not None:
        head["X-Page-ID"] = str(page_id)
    if revisits:
        head["WARC-Profile"] = PROFILE
        if refers_to is not None:
            head["X-Refers-To-Page-ID"] = str(refers_to)
    block = HTTP_HEAD + (b"" if revisits else payload)
    head |= {"WARC-Block-Digest": f"sha1:{digest32(block)}", "Content-Type": "application/http; msgtype=response", "Content-Length": str(len(block))}
    lines = b"".join(f"{k}: {v}\r\n".encode() for k, v in head.items())
    deflate = zlib.compressobj(6, zlib.DEFLATED, 31)
    return deflate.compress(b"%s\r\n%s\r\n%s\r\n\r\n" % (VERSION, lines, block)) + deflate.flush()


class Members:
    """Inflates a stream of gzip members bit by bit; bytes never cross a member's end."""

    def __init__(self, stream: BinaryIO, step: int = 1 << 16):
        self.stream, self.step, self.raw, self.plain = stream, step, b"", b""
        self.inflate = None

    def begin(self) -> bool:
        """Opens the next member; False at the end of the file."""
        if self.plain or self.inflate is not None:
            raise ValueError("a member has data after its record")
        if not self.raw:
            self.raw = self.stream.read(self.step)
        self.inflate = zlib.decompressobj(31) if self.raw else None
        return self.inflate is not None

    def _more(self) -> bool:
        """Inflates a bit more; False where the member is at its end."""
        while self.inflate is not None:
            data = self.raw or self.stream.read(self.step)
            if not data:
                raise ValueError("truncated member")
            try:
                out = self.inflate.decompress(data, self.step)
            except zlib.error as e:
                raise ValueError(f"broken member: {e}") from e
            if self.inflate.eof:
                self.raw, self.inflate = self.inflate.unused_data, None
            else:
                self.raw = self.inflate.unconsumed_tail
            if out:
                self.plain += out
                return True
        return False

    def line(self) -> bytes:
        while (at := self.plain.find(b"\r\n")) < 0:
            if not self._more():
                raise ValueError("a header line has no end")
        out, self.plain = self.plain[:at], self.plain[at + 2 :]
        return out

    def exactly(self, n: int) -> bytes:
        parts, have = [self.plain], len(self.plain)
        while have < n:
            self.plain = b""
            if not self._more():
                raise ValueError("a block is shorter than its Content-Length")
            parts.append(self.plain)
            have += len(self.plain)
        whole = b"".join(parts)
        self.plain = whole[n:]
        return whole[:n]

    def end(self) -> None:
        """The member must end here, its checksum included."""
        if self.plain or self._more():
            raise ValueError("a member has data after its record")


def read_records(stream: BinaryIO) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers with lower-case names, block) of each record, digests verified."""
    members = Members(stream)
    while members.begin():
        if not members.line().startswith(b"WARC/"):
            raise ValueError("no WARC version line")
        head = {}
        while line := members.line():
            name, colon, value = line.partition(b":")
            if not colon:
                raise ValueError("a header line has no colon")
            head[name.strip().lower().decode()] = value.strip().decode()
        block = members.exactly(int(head["content-length"]))
        if members.exactly(4) != b"\r\n\r\n":
            raise ValueError("a record has no end mark")
        members.end()
        if head.get("warc-block-digest", want := f"sha1:{digest32(block)}") != want:
            raise ValueError("block digest differs")
        yield head, block


def page_of(head: dict[str, str], block: bytes) -> tuple[int | None, int, str, str, int | None]:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of a record; the payload's digest is verified."""
    number = lambda k: int(head[k]) if k in head else None
    digest, kind = head["warc-payload-digest"].removeprefix("sha1:"), head["warc-type"]
    size = int(head["x-payload-length"])
    if kind == "response":
        payload = block[block.index(b"\r\n\r\n") + 4 :]
        if len(payload) != size or digest32(payload) != digest:
            raise ValueError("payload digest differs")
    return number("x-page-id"), size, digest, kind, number("x-refers-to-page-id")


def _writer(base: str):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        stem = f"{base}/part-{context.partitionId():06d}-{context.taskAttemptId()}"
        done, out, path, count, size = [], None, "", 0, 0
        fs, _ = common.open_fs(base)
        try:
            for batch in batches:
                for row in batch.to_pylist():
                    if out is None:
                        path, count, size = f"{stem}-{len(done):03d}.warc.gz", 0, 0
                        local = common.open_fs(path)[1]
                        fs.create_dir(local.rpartition("/")[0], recursive=True)
                        out = fs.open_output_stream(local, compression=None)
                    record_id = str(uuid.uuid5(uuid.NAMESPACE_URL, f"{path}#{count}"))
                    data = encode_record(row["page_id"], row["url"], row["payload"], row["revisits"], row["refers_to"], record_id)
                    out.write(data)
                    count, size = count + 1, size + len(data)
                    if size >= ROLL_BYTES:
                        out.close()
                        done.append((path, count, size))
                        out = None
        finally:
            if out is not None:
                out.close()
                done.append((path, count, size))
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done, strict=True), (pa.string(), pa.int64(), pa.int64()), strict=True)], names=["path", "records", "bytes"])

    return write


def write_archives(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """Writes the archives; a written table of path, records, bytes. Only files it lists are valid."""
    spark = pages.sparkSession
    payload = F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), common.column_or_null(pages, "url", "string"), payload.alias("payload")).withColumn("sha", F.sha1("payload"))
    sized = rows.select("page_id", "sha", F.octet_length("payload").alias("n")).filter(F.col("n") >= min_bytes)
    first = sized.groupBy("sha").agg(F.min("page_id").alias("refers_to"))
    revisits = sized.join(first, "sha").filter(~F.col("page_id").eqNullSafe(F.col("refers_to"))).select(F.col("page_id").alias("r_page"), F.col("sha").alias("r_sha"), "refers_to").distinct().withColumn("revisits", F.lit(True))
    joined = rows.join(revisits, F.col("page_id").eqNullSafe(F.col("r_page")) & (F.col("sha") == F.col("r_sha")), "left")
    base = common.fresh_path(spark, "warc")
    todo = joined.select("page_id", "url", "payload", F.coalesce("revisits", F.lit(False)).alias("revisits"), "refers_to")
    return common.materialize(todo.mapInArrow(_writer(base), "path string, records long, bytes long"), "warc-list")


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64())
    names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    pack = lambda rows: pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)
    for batch in batches:
        for row in batch.to_pylist():
            fs, local = common.open_fs(row["path"])
            rows = []
            with fs.open_input_stream(local, compression=None) as stream:
                for head, block in read_records(stream):
                    rows.append(page_of(head, block))
                    if len(rows) == 5000:
                        yield pack(rows)
                        rows = []
                if rows:
                    yield pack(rows)


def read_archives(listing: DataFrame) -> DataFrame:
    """One row per record of the listed archives; each file is read by one task, front to back."""
    n = common.partitions(listing.sparkSession)
    return listing.select("path").repartition(n, "path").mapInArrow(_read, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")


def op10_warc(spark, sf_dir) -> DataFrame:
    return read_archives(write_archives(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")))
