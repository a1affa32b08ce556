"""Operator 8: media columns with content-defined payload chunks.

A payload (UTF-8 text, padded with zero bytes to a positive multiple of 64) is
cut where a rolling gear hash of its last 32 bytes falls below a bound, so equal
passages give equal chunks wherever they stand. Chunk digests are deduplicated
by Spark joins: of the distinct payloads that hold a chunk, the one with the
smallest digest owns it. The written media table holds, once per distinct
payload, its ordered chunk list and the chunks it owns; a payload's other
chunks are references. Reading back joins the references to their owners'
chunks, verifies every chunk and the whole payload, and computes features from
the bytes read.

The stored form of a payload, whose size and digest are reported, is its chunk
list (digest and length a chunk) followed by its chunks as 8-bit samples. Equal
payloads are written once: copies meet by digest, in partial aggregates.

Defined cases: null text counts as empty (64 zero bytes); an empty table gives
no rows; repeated rows share one stored form; other columns are ignored. A
chunk or payload whose digest differs raises ValueError.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm import common

UNIT = 64
LEAST, MOST, AVERAGE_BITS, WINDOW = 1 << 10, 1 << 16, 12, 32
#: The gear table: a random 32-bit number for each byte.
GEAR = np.random.default_rng(2016).integers(0, 1 << 32, 256, dtype=np.uint32)
#: Chunks and payloads are known by the first 128 bits of their SHA-256.
KEY = 16
ENTRY = struct.Struct("<16sI")
LEVEL = 12


def key_of(data: bytes) -> bytes:
    return hashlib.sha256(data).digest()[:KEY]


def payload_of(text: bytes | None) -> bytes:
    text = text or b""
    return text + bytes(-len(text) % UNIT or (0 if text else UNIT))


def cuts(payload: bytes) -> list[int]:
    """Where the chunks end: LEAST to MOST bytes each, the last one maybe shorter."""
    n = len(payload)
    if n <= LEAST:
        return [n]
    h = GEAR[np.frombuffer(payload, np.uint8)]
    k = 1
    while k < WINDOW:
        h[k:] += h[:-k] << np.uint32(k)  # the right side is evaluated before it is added
        k *= 2
    marks = np.flatnonzero(h < np.uint32(1 << (32 - AVERAGE_BITS))) + 1
    out, start = [], 0
    while n - start > LEAST:
        i = int(np.searchsorted(marks, start + LEAST))
        end = min(int(marks[i]) if i < len(marks) else n, start + MOST, n)
        out.append(end)
        start = end
    if start < n:
        out.append(n)
    return out


def chunks_of(payload: bytes) -> list[tuple[bytes, bytes]]:
    """(key, bytes) of each chunk, in order."""
    out, start = [], 0
    for end in cuts(payload):
        piece = payload[start:end]
        out.append((key_of(piece), piece))
        start = end
    return out


def _survey(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """doc_id, media (the payload's key), n_bytes, chunks: keys, null where this task saw the payload before."""
    seen = set()
    for batch in batches:
        out = []
        for doc_id, text in zip(batch.column(0), batch.column(1), strict=True):
            raw = text.as_py() or b""
            payload = payload_of(raw)
            media = key_of(payload)
            out.append((doc_id.as_py(), media, len(raw), None if media in seen else [d for d, _ in chunks_of(payload)]))
            seen.add(media)
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True) if out else [[]] * 4, (pa.int64(), pa.binary(), pa.int64(), pa.list_(pa.binary())), strict=True)], names=["doc_id", "media", "n_bytes", "chunks"])


def _payloads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """media, packed (the payload, compressed), once a task."""
    seen, pack = set(), zstandard.ZstdCompressor(level=LEVEL).compress
    for batch in batches:
        out = []
        for text in batch.column(1):
            payload = payload_of(text.as_py())
            media = key_of(payload)
            if media not in seen:
                seen.add(media)
                out.append((media, pack(payload)))
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.binary()) for c in (zip(*out, strict=True) if out else [[], []])], names=["media", "packed"])


CHUNK = pa.list_(pa.struct([("digest", pa.binary()), ("data", pa.binary())]))


def _store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """media, listing, own, shared, foreign: `shared` are own chunks that other payloads refer to."""
    unpack = zstandard.ZstdDecompressor().decompress
    for whole in batches:
        for lo in range(0, whole.num_rows, 500):
            out = []
            for row in whole.slice(lo, 500).to_pylist():
                roles = {r["digest"]: r["owner"] == row["media"] for r in row["roles"] or []}
                found = chunks_of(unpack(row["packed"]))
                first = dict(found)
                listing = b"".join(ENTRY.pack(d, len(x)) for d, x in found)
                own = [{"digest": d, "data": x} for d, x in first.items() if d not in roles]
                shared = [{"digest": d, "data": x} for d, x in first.items() if roles.get(d)]
                out.append((row["media"], listing, own, shared, [d for d in first if roles.get(d) is False]))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.binary(), pa.binary(), CHUNK, CHUNK, pa.list_(pa.binary())), strict=True)], names=["media", "listing", "own", "shared", "foreign"])


def features(payload: bytes, pieces: int) -> str:
    """A few statistics of the samples, written with fixed precision."""
    x = np.bincount(np.frombuffer(payload, np.uint8), minlength=256)
    p = x[x > 0] / len(payload)
    mean = float((x * np.arange(256)).sum()) / len(payload)
    return f"chunks={pieces};values={len(p)};mean={mean:.4f};bits={float(-(p * np.log2(p)).sum()) + 0.0:.4f}"


def _read_back(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kinds = (pa.binary(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
    for batch in batches:
        for lo in range(0, batch.num_rows, 500):
            out = []
            for row in batch.slice(lo, 500).to_pylist():
                held = {c["digest"]: c["data"] for k in ("own", "shared", "fetched") for c in row[k] or []}
                parts, done = [], set()
                for digest, size in ENTRY.iter_unpack(row["listing"]):
                    data = held.get(digest)
                    if data is None or len(data) != size or (digest not in done and key_of(data) != digest):
                        raise ValueError("a chunk is missing or differs")
                    done.add(digest)
                    parts.append(data)
                payload = b"".join(parts)
                whole = hashlib.sha256(payload)
                if whole.digest()[:KEY] != row["media"]:
                    raise ValueError("a payload differs")
                form = row["listing"] + payload
                out.append((row["media"], len(payload), whole.hexdigest(), zlib.crc32(payload[-UNIT:]), len(form), hashlib.sha256(form).hexdigest(), features(payload, len(parts))))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names=["media", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"])


READ = "media binary, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def write_media(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(documents: doc_id, media, n_bytes; the written media table)."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").cast("binary").alias("text"))
    survey = common.materialize(rows.mapInArrow(_survey, "doc_id long, media binary, n_bytes long, chunks array<binary>"), "media-survey")
    held = survey.filter("chunks is not null").select("media", F.explode(F.array_distinct("chunks")).alias("digest")).distinct()
    owners = held.groupBy("digest").agg(F.min("media").alias("owner"), F.count(F.lit(1)).alias("n")).filter("n > 1").select("digest", "owner")
    roles = held.join(owners, "digest").groupBy("media").agg(F.collect_list(F.struct("digest", "owner")).alias("roles"))
    payloads = rows.mapInArrow(_payloads, "media binary, packed binary").groupBy("media").agg(F.first("packed").alias("packed"))
    chunk = "array<struct<digest:binary,data:binary>>"
    stored = payloads.join(roles, "media", "left").mapInArrow(_store, f"media binary, listing binary, own {chunk}, shared {chunk}, foreign array<binary>")
    return survey.select("doc_id", "media", "n_bytes"), common.materialize(stored, "media", 9)


def read_media(stored: DataFrame) -> DataFrame:
    """media and what is computed from the bytes read back, one row a stored payload."""
    refers = F.size("foreign") > 0
    chunk = "array<struct<digest:binary,data:binary>>"
    alone = stored.filter(~refers).select("media", "listing", "own", "shared", F.lit(None).cast(chunk).alias("fetched"))
    wanted = stored.filter(refers).select("media", F.explode("foreign").alias("digest"))
    store = stored.filter(F.size("shared") > 0).select(F.explode("shared").alias("c")).select("c.digest", "c.data")
    fetched = wanted.join(store, "digest").groupBy("media").agg(F.collect_list(F.struct("digest", "data")).alias("fetched"))
    mixed = stored.filter(refers).select("media", "listing", "own", "shared").join(fetched, "media")
    return alone.unionByName(mixed).mapInArrow(_read_back, READ)


def op8_media_chunks(spark, sf_dir) -> DataFrame:
    documents, stored = write_media(common.documents(spark, sf_dir))
    out = documents.join(read_media(stored), "media")
    return out.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature")
