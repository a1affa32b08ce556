"""Operator 4: byte-level BPE by a global shuffle of distinct words.

1. Every task cuts its texts into words (units that the tokenizer encodes on
   their own, see `units`), numbers the distinct ones per chunk of texts and
   writes, per chunk, the texts as word numbers in order of position and the
   words in runs by hash bucket. The written table fixes the chunks for all
   later steps.
2. The runs are shuffled by bucket. A task streams its runs bucket by bucket in
   groups of GROUP_BYTES, encodes every distinct word of a group once, but for
   those of the group before, and answers each run with the ids of its words,
   in their order.
3. The answers are joined to their chunk, whose table is bucketed so that only
   the answers move, and the ids are laid out by position.
Decoding maps the ids through the token-byte table, whose size the vocabulary
fixes. Frequent words cost one entry a chunk, so no key is hot.

Chunks grow with the text and a chunk has MAX_RUNS runs at most, whatever the
number of partitions, so the runs grow with the text. Tasks hold a chunk or two
groups of runs; a bucket of several groups encodes some words again, once a
group at most. Texts are laid out a slice at a time.

Defined cases: null text counts as empty and gives no ids; repeated rows are
encoded row by row; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm import common, units

#: Bytes of text a chunk; a longer document is a chunk by itself.
CHUNK_BYTES = 10 << 20
#: Runs of words a chunk, at most.
MAX_RUNS = 1024
#: Bytes of runs that are encoded together, and words or tokens that are laid out at a time.
GROUP_BYTES, SLICE = 4 << 20, 1 << 18
#: Words of a run are joined by this byte, which UTF-8 never contains.
SEPARATOR = b"\xff"


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def _planes(values: np.ndarray) -> bytes:
    """Unsigned 32-bit numbers as four byte planes, compressed."""
    return zstandard.ZstdCompressor(level=3).compress(values.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes())


def _numbers(blob: bytes) -> np.ndarray:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), np.uint8)
    return raw.reshape(4, -1).T.copy().view("<u4").reshape(-1)


def _pack(n_buckets: int, limit: int):
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        zip_ = zstandard.ZstdCompressor(level=3).compress
        part = TaskContext.get().partitionId()
        for seq, table in enumerate(units.chunks(batches, limit)):
            codes, counts, words = units.unitize(table.column("text").chunk(0))
            bucket = np.fromiter((zlib.crc32(w.encode()) % n_buckets for w in units.strings_of(words)), np.int32, len(words))
            # Words are numbered by bucket and in alphabetical order, which compresses well; codes are ranks by frequency.
            order = pc.sort_indices(pa.table({"b": bucket, "w": words}), [("b", "ascending"), ("w", "ascending")]).to_numpy()
            number = np.empty(len(words), np.uint32)
            number[order] = np.arange(len(words))
            ends = np.searchsorted(bucket[order], np.arange(n_buckets), "right")
            starts = np.concatenate([[0], ends[:-1]])
            sorted_words = words.take(pa.array(order))
            vocab = [{"bucket": b, "words": zip_(SEPARATOR.join(w.encode() for w in units.strings_of(sorted_words.slice(s, e - s))))} for b, (s, e) in enumerate(zip(starts.tolist(), ends.tolist(), strict=True)) if e > s]
            freq = np.argsort(-np.bincount(codes, minlength=len(words)), kind="stable")
            rank = np.empty(len(words), np.uint32)
            rank[freq] = np.arange(len(words))
            yield pa.RecordBatch.from_pydict(
                {"chunk": [part << 32 | seq], "doc_ids": [table.column("doc_id").to_pylist()], "counts": [_planes(counts)], "codes": [_planes(rank[codes])], "order": [_planes(number[freq])], "vocab": [vocab]},
                schema=pa.schema([("chunk", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("counts", pa.binary()), ("codes", pa.binary()), ("order", pa.binary()), ("vocab", pa.list_(pa.struct([("bucket", pa.int32()), ("words", pa.binary())])))]),
            )

    return pack


PACKED = "chunk long, doc_ids array<long>, counts binary, codes binary, order binary, vocab array<struct<bucket:int,words:binary>>"


def _encoder(ranks, pattern: str, group_bytes: int):
    """Answers the runs, sorted by bucket, with ids in the order of their words."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import tiktoken

        bpe = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks.value, special_tokens={})
        unzip, memory, held, size = zstandard.ZstdDecompressor().decompress, units.Memory(), [], 0

        def make(words: pa.LargeStringArray) -> tuple[np.ndarray, np.ndarray]:
            ids = [bpe.encode_ordinary(w) for w in units.strings_of(words)]
            return np.fromiter((i for x in ids for i in x), np.uint32), np.fromiter(map(len, ids), np.int64, len(ids))

        def answers() -> Iterator[pa.RecordBatch]:
            distinct = pa.concat_arrays([w for _, _, w in held]).dictionary_encode()
            ids, sizes = memory.lookup(distinct.dictionary, make)
            starts, codes, at = units.starts_of(sizes), distinct.indices.to_numpy(), 0
            for chunk, bucket, words in held:
                own = codes[at : at + len(words)]
                at += len(words)
                values = (chunk, bucket, _planes(units.gather(ids, starts, sizes, own)), _planes(sizes[own]))
                yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(values, (pa.int64(), pa.int32(), pa.binary(), pa.binary()), strict=True)], names=["chunk", "bucket", "ids", "lengths"])

        for batch in batches:
            for chunk, bucket, blob in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                raw = np.frombuffer(unzip(blob), np.uint8)
                breaks = np.concatenate([[-1], np.flatnonzero(raw == SEPARATOR[0]), [len(raw)]])
                lengths = np.diff(breaks) - 1
                held.append((chunk, bucket, units.strings_from(raw[units.ranges(breaks[:-1] + 1, lengths)], lengths)))
                size += len(raw)
                if size >= group_bytes:
                    yield from answers()
                    held, size = [], 0
        if held:
            yield from answers()

    return encode


def _layout(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, np.ndarray, Iterator[tuple[int, np.ndarray]]]]:
    """(doc_ids, ids a document, the (document's place, ids) in order) of each chunk; long documents come in several pieces."""
    for batch in batches:
        for i in range(batch.num_rows):
            row = batch.slice(i, 1).to_pylist()[0]
            answers = sorted(row["answers"] or [], key=lambda x: x["bucket"])
            flat = np.concatenate([_numbers(x["ids"]) for x in answers] or [np.zeros(0, np.uint32)])
            lengths = np.concatenate([_numbers(x["lengths"]) for x in answers] or [np.zeros(0, np.uint32)]).astype(np.int32)
            order, counts = _numbers(row["order"]).astype(np.int32), _numbers(row["counts"]).astype(np.int64)
            codes = order[_numbers(row["codes"])]
            n = np.add.reduceat(np.append(lengths[codes], 0), np.minimum(np.cumsum(counts) - counts, len(codes)), dtype=np.int64) if len(counts) else counts

            def pieces(flat=flat, lengths=lengths, codes=codes, counts=counts):
                starts, at = units.starts_of(lengths.astype(np.int64)), 0
                for doc, k in enumerate(counts.tolist()):
                    for lo in range(at, at + max(k, 1), SLICE):
                        yield doc, units.gather(flat, starts, lengths, codes[lo : min(lo + SLICE, at + k)])
                    at += k

            yield row["doc_ids"], np.where(counts > 0, n, 0), pieces()


def _digester(ranks):
    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = sorted(ranks.value.items(), key=lambda x: x[1])
        size = np.zeros(tokens[-1][1] + 1, np.int64)
        for b, i in tokens:
            size[i] = len(b)
        flat, starts = np.frombuffer(b"".join(b for b, _ in tokens), np.uint8), units.starts_of(size)
        for doc_ids, n, pieces in _layout(batches):
            shas, decoded = [hashlib.sha256() for _ in doc_ids], [hashlib.sha256() for _ in doc_ids]
            for doc, ids in pieces:
                shas[doc].update(ids.astype("<u4").tobytes())
                for lo in range(0, len(ids), SLICE):
                    decoded[doc].update(units.gather(flat, starts, size, ids[lo : lo + SLICE]).tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(doc_ids, pa.int64()), pa.array(n, pa.int64()), pa.array([x.hexdigest() for x in shas], pa.string()), pa.array([x.hexdigest() for x in decoded], pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return digest


def _lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for doc_ids, n, pieces in _layout(batches):
        ids = np.concatenate([np.zeros(0, np.uint32), *(x for _, x in pieces)])
        ends = np.concatenate([[0], np.cumsum(n)])
        yield pa.RecordBatch.from_arrays([pa.array(doc_ids, pa.int64()), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(ids.astype(np.int32), pa.int32()))], names=["doc_id", "ids"])


def _answered(docs: DataFrame, ranks, pattern: str, chunk_bytes: int) -> DataFrame:
    spark = docs.sparkSession
    n_buckets = min(2 * common.partitions(spark), MAX_RUNS)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    packed = common.materialize_bucketed(rows.mapInArrow(_pack(n_buckets, chunk_bytes), PACKED), "bpe", "chunk")
    runs = packed.select("chunk", F.explode("vocab").alias("v")).select("chunk", "v.bucket", "v.words")
    dealt = runs.repartition(common.partitions(spark), "bucket").sortWithinPartitions("bucket")
    answers = dealt.mapInArrow(_encoder(ranks, pattern, GROUP_BYTES), "chunk long, bucket int, ids binary, lengths binary")
    by_chunk = answers.groupBy("chunk").agg(F.collect_list(F.struct("bucket", "ids", "lengths")).alias("answers"))
    return packed.drop("vocab").join(by_chunk, "chunk", "left")


def _tokenizer(spark, path: str | None, pattern: str | None):
    if path is None or pattern is None:
        import public_tokenizers

        path, pattern = path or public_tokenizers.path("byte_bpe_50k.tiktoken"), pattern or public_tokenizers.PATTERN
    return spark.sparkContext.broadcast(load_ranks(path)), pattern


def encode(docs: DataFrame, ranks_path: str | None = None, pattern: str | None = None, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """doc_id, ids (array<int>) per row of `docs`."""
    ranks, pattern = _tokenizer(docs.sparkSession, ranks_path, pattern)
    return _answered(docs, ranks, pattern, chunk_bytes).mapInArrow(_lists, "doc_id long, ids array<int>")


def round_trip(docs: DataFrame, ranks_path: str | None = None, pattern: str | None = None, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 per row of `docs`: encodes, then decodes the ids."""
    ranks, pattern = _tokenizer(docs.sparkSession, ranks_path, pattern)
    return _answered(docs, ranks, pattern, chunk_bytes).mapInArrow(_digester(ranks), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op4_bpe_round_trip(spark, sf_dir) -> DataFrame:
    return round_trip(common.documents(spark, sf_dir))
