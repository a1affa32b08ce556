"""Operator 6: token ids in sorted-string-table shards.

Documents are dealt by ranges of doc_id, sorted, encoded and written as shard
files under the shared folder. A shard holds blocks of prefix-compressed
entries (restart points every 16 keys), a Bloom filter, a sparse index with one
entry a block, and a footer; `SSTable` looks a key up by Bloom filter, then
binary search in the index and the block's restarts, and scans in order.

Keys: one byte (0 null, 1 number) and the doc_id as big-endian bytes with the
sign bit flipped, so byte order is ascending doc_id, null first. Values: ids as
little-endian unsigned numbers of two bytes where the vocabulary allows, else
four. Blocks are zstd-compressed and carry a CRC-32.

Defined cases: null text is empty and holds the end id only; rows of equal
doc_id are kept, ordered by text; an empty table gives no shard and no row;
other columns are ignored.
"""

from __future__ import annotations

import bisect
import json
import os
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plumbline.llm import common, units

MAGIC = b"PLSST001"
BLOCK_BYTES = 64 << 10
RESTART = 16
BLOOM_BITS, BLOOM_HASHES = 10, 7
#: A new shard begins once the present one has so many bytes.
ROLL_BYTES = 256 << 20
END_ID = 2
CHUNK_BYTES = 8 << 20
FOOTER = struct.Struct("<QQQQQQIB8s")


def key_of(doc_id: int | None) -> bytes:
    return b"\0" + bytes(8) if doc_id is None else b"\1" + ((doc_id + (1 << 63)) & ((1 << 64) - 1)).to_bytes(8, "big")


def doc_of(key: bytes) -> int | None:
    return None if key[0] == 0 else int.from_bytes(key[1:], "big") - (1 << 63)


def _varint(n: int) -> bytes:
    out = bytearray()
    while n >= 128:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def _read_varint(data: bytes, at: int) -> tuple[int, int]:
    n = shift = 0
    while True:
        b = data[at]
        n |= (b & 127) << shift
        at, shift = at + 1, shift + 7
        if b < 128:
            return n, at


def _hashes(key: bytes) -> tuple[int, int]:
    return zlib.crc32(key), zlib.crc32(key, 0x9E3779B9) | 1


class Writer:
    """Writes one shard to a binary stream; keys come in ascending order."""

    def __init__(self, stream, width: int):
        self.stream, self.width, self.at = stream, width, 0
        self.index, self.hashes = [], []
        self.docs = self.tokens = 0
        self._begin()

    def _begin(self) -> None:
        self.block, self.restarts, self.count, self.last, self.first = bytearray(), [], 0, b"", b""

    def add(self, key: bytes, value: bytes) -> None:
        if self.count % RESTART == 0:
            self.restarts.append(len(self.block))
            shared = 0
        else:
            shared = len(os.path.commonprefix([key, self.last]))
        self.first = self.first or key
        self.block += _varint(shared) + _varint(len(key) - shared) + _varint(len(value)) + key[shared:] + value
        self.last, self.count = key, self.count + 1
        self.hashes.append(_hashes(key))
        self.docs, self.tokens = self.docs + 1, self.tokens + len(value) // self.width
        if len(self.block) >= BLOCK_BYTES:
            self._flush()

    def _put(self, data: bytes) -> tuple[int, int]:
        self.stream.write(data)
        at, self.at = self.at, self.at + len(data)
        return at, len(data)

    def _flush(self) -> None:
        if self.count:
            raw = bytes(self.block) + struct.pack(f"<{len(self.restarts)}II", *self.restarts, len(self.restarts))
            data = zstandard.ZstdCompressor(level=3).compress(raw)
            at, n = self._put(struct.pack("<I", zlib.crc32(data)) + data)
            self.index.append((self.first, at, n))
            self._begin()

    def close(self) -> None:
        self._flush()
        m = max(64, len(self.hashes) * BLOOM_BITS)
        bits = np.zeros((m + 7) // 8 * 8, bool)
        h = np.array(self.hashes, np.uint64).reshape(-1, 2)
        for i in range(BLOOM_HASHES):
            bits[((h[:, 0] + np.uint64(i) * h[:, 1]) % np.uint64(m)).astype(np.int64)] = True
        bloom = self._put(struct.pack("<Q", m) + np.packbits(bits, bitorder="little").tobytes())
        index = self._put(b"".join(_varint(len(k)) + k + _varint(at) + _varint(n) for k, at, n in self.index))
        self.stream.write(FOOTER.pack(*bloom, *index, self.docs, self.tokens, len(self.index), self.width, MAGIC))


class SSTable:
    """Reads a shard from a seekable file."""

    def __init__(self, file):
        self.file = file
        file.seek(0, 2)
        size = file.tell()
        if size < FOOTER.size:
            raise ValueError("no shard")
        bloom_at, bloom_n, index_at, index_n, self.docs, self.tokens, blocks, self.width, magic = FOOTER.unpack(self._bytes(size - FOOTER.size, FOOTER.size))
        if magic != MAGIC:
            raise ValueError("no shard")
        bloom = self._bytes(bloom_at, bloom_n)
        self.bits, self.bloom = struct.unpack_from("<Q", bloom)[0], bloom[8:]
        data, at, self.index = self._bytes(index_at, index_n), 0, []
        for _ in range(blocks):
            k, at = _read_varint(data, at)
            key, at = data[at : at + k], at + k
            where, at = _read_varint(data, at)
            n, at = _read_varint(data, at)
            self.index.append((key, where, n))

    def _bytes(self, at: int, n: int) -> bytes:
        self.file.seek(at)
        return self.file.read(n)

    def _block(self, i: int) -> tuple[bytes, list[int]]:
        _, at, n = self.index[i]
        data = self._bytes(at, n)
        if struct.unpack_from("<I", data)[0] != zlib.crc32(data[4:]):
            raise ValueError("a block's checksum differs")
        raw = zstandard.ZstdDecompressor().decompress(data[4:])
        count = struct.unpack_from("<I", raw, len(raw) - 4)[0]
        end = len(raw) - 4 - 4 * count
        return raw[:end], list(struct.unpack_from(f"<{count}I", raw, end))

    @staticmethod
    def _entries(raw: bytes, at: int) -> Iterator[tuple[bytes, bytes]]:
        key = b""
        while at < len(raw):
            shared, at = _read_varint(raw, at)
            rest, at = _read_varint(raw, at)
            size, at = _read_varint(raw, at)
            key = key[:shared] + raw[at : at + rest]
            yield key, raw[at + rest : at + rest + size]
            at += rest + size

    def ids(self, value: bytes) -> np.ndarray:
        return np.frombuffer(value, f"<u{self.width}").astype("<u4")

    def might_hold(self, key: bytes) -> bool:
        a, b = _hashes(key)
        return all(self.bloom[p >> 3] >> (p & 7) & 1 for p in ((a + i * b) % self.bits for i in range(BLOOM_HASHES)))

    def get(self, doc_id: int | None) -> np.ndarray | None:
        """The ids of a document, or None; of rows with an equal doc_id, the first in its block."""
        key = key_of(doc_id)
        if not self.index or not self.might_hold(key):
            return None
        i = max(0, bisect.bisect_left(self.index, key, key=lambda x: x[0]) - 1)
        for block in range(i, min(i + 2, len(self.index))):
            raw, restarts = self._block(block)
            at = max(0, bisect.bisect_left(restarts, key, key=lambda r: next(self._entries(raw, r))[0]) - 1)
            for k, v in self._entries(raw, restarts[at]):
                if k >= key:
                    if k == key:
                        return self.ids(v)
                    break
        return None

    def scan(self) -> Iterator[tuple[int | None, np.ndarray]]:
        for i in range(len(self.index)):
            for k, v in self._entries(self._block(i)[0], 0):
                yield doc_of(k), self.ids(v)


def _byte_characters() -> dict[int, str]:
    """The character that a byte-level vocabulary writes for each byte: printable Latin-1 as it is, the rest from U+0100 on."""
    plain = [b for b in range(256) if 0x21 <= b <= 0x7E or 0xA1 <= b <= 0xAC or b >= 0xAE]
    rest = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


class UnitEncoder:
    """Ids of units of text (see `units`) by the tokenizers library, as it encodes them with add_special_tokens=False.

    A unit is cut into a line feed before it, a stem and the punctuation after a
    plain Latin letter, each of which is a match of its own under the
    tokenizer's pattern. Stems of letters alone are one match; the library
    encodes a batch of them in one call, in which they are split by line feeds,
    and the lengths of the tokens tell which ids belong to which. All other
    parts go to the library one by one. The parts of the last chunk are
    remembered, no others, so memory is bounded by the size of a chunk.
    """

    #: Letters in every version of Unicode in use, and the ends of units that may follow them; the apostrophe begins contractions.
    LETTERS = r"A-Za-z\x{aa}\x{b5}\x{ba}\x{c0}-\x{d6}\x{d8}-\x{f6}\x{f8}-\x{233}"
    PUNCTUATION = "".join(chr(c) for c in range(0x21, 0x7F) if not chr(c).isalnum() and chr(c) != "'")
    JOINED, BATCH = 1000, 16

    def __init__(self, tokenizer_json: str, width: int | None = None):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, models, pre_tokenizers

        self.tokenizer = Tokenizer.from_str(tokenizer_json)
        self.width = width or (2 if self.tokenizer.get_vocab_size() <= 1 << 16 else 4)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        spec, model = json.loads(tokenizer_json), self.tokenizer.model
        pre = spec.get("pre_tokenizer") or {}
        byte_level = pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space") and not spec.get("normalizer")
        self.plain = byte_level and isinstance(model, models.BPE) and not (model.dropout or model.unk_token or model.continuing_subword_prefix or model.end_of_word_suffix)
        if self.plain:
            self.joined = Tokenizer(model)
            self.joined.pre_tokenizer = pre_tokenizers.Split("\n", "removed")
            vocab = self.tokenizer.get_vocab(with_added_tokens=False)
            self.size = np.zeros(max(vocab.values()) + 1, np.int64)
            self.size[list(vocab.values())] = list(map(len, vocab))
            self.table = _byte_characters() | {0x0A: "\n"}
            self.punctuated = f"[{self.LETTERS}][{re.escape(self.PUNCTUATION)}]+\\z"
            self.alphabetic = rf"\A ?[{self.LETTERS}]+\z"
        self.memory = units.Memory()

    def _singly(self, words: pa.LargeStringArray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all words, one after another; ids a word), every word on its own."""
        ids, lengths = [], []
        for lo in range(0, len(words), 10_000):
            found = [e.ids for e in self.tokenizer.encode_batch_fast(units.strings_of(words.slice(lo, 10_000)), add_special_tokens=False)]
            lengths += map(len, found)
            ids.append(np.fromiter((i for x in found for i in x), np.uint32))
        return np.concatenate([np.zeros(0, np.uint32), *ids]), np.array(lengths, np.int64)

    def _letters(self, words: pa.LargeStringArray) -> tuple[np.ndarray, np.ndarray]:
        """The same for words of letters, with or without a space before."""
        ids, lengths = [], []
        for lo in range(0, len(words), self.JOINED * self.BATCH):
            some = words.slice(lo, self.JOINED * self.BATCH)
            bounds = [*range(0, len(some), self.JOINED), len(some)]
            raws = [x.as_py().encode() for x in pc.binary_join(pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), some), pa.scalar("\n", pa.large_string()))]
            for raw, found in zip(raws, self.joined.encode_batch_fast([r.decode("latin-1").translate(self.table) for r in raws], add_special_tokens=False), strict=True):
                got = np.array(found.ids, np.uint32)
                breaks = np.append(np.flatnonzero(np.frombuffer(raw, np.uint8) == 10), len(raw))
                ends = np.searchsorted(np.cumsum(self.size[got]), breaks - np.arange(len(breaks))) + 1
                ids.append(got)
                lengths.append(np.diff(ends, prepend=0))
        return np.concatenate([np.zeros(0, np.uint32), *ids]), np.concatenate([np.zeros(0, np.int64), *lengths])

    def _parts(self, parts: pa.LargeStringArray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all distinct parts, ids a part)."""
        letters = pc.match_substring_regex(parts, self.alphabetic)
        (a, n), (b, m) = self._letters(parts.filter(letters)), self._singly(parts.filter(pc.invert(letters)))
        was = letters.to_numpy(zero_copy_only=False)
        sizes, place = np.concatenate([n, m]), np.empty(len(parts), np.int64)
        place[was], place[~was] = np.arange(len(n)), len(n) + np.arange(len(m))
        return units.gather(np.concatenate([a, b]), units.starts_of(sizes), sizes, place), sizes[place]

    def encode(self, words: pa.LargeStringArray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all units, one after another; ids a unit)."""
        if not self.plain:
            return self._singly(words)
        data, start, size = units.layout_of(words)
        cut = pc.match_substring_regex(words, self.punctuated)
        line = pc.and_(pc.starts_with(words, "\n"), pc.match_substring_regex(words, r"\A\n\S"))
        for token in self.special:
            free = pc.invert(pc.match_substring(words, token))
            cut, line = pc.and_(cut, free), pc.and_(line, free)
        cut, line = (x.to_numpy(zero_copy_only=False) for x in (cut, line))
        stem = size.copy()
        stem[cut] = units.layout_of(pc.utf8_rtrim(words.filter(pa.array(cut)), self.PUNCTUATION))[2]
        pieces = np.stack([line, stem - line, size - stem])  # bytes of the line feed, the stem and the end
        starts = np.stack([start, start + line, start + stem])
        lengths, starts = pieces.T.ravel(), starts.T.ravel()
        there = np.flatnonzero(lengths)
        parts = units.strings_from(data[units.ranges(starts[there], lengths[there])], lengths[there]).dictionary_encode()
        ids, sizes = self.memory.lookup(parts.dictionary, self._parts)
        codes = parts.indices.to_numpy(zero_copy_only=False)
        each = np.zeros(len(lengths), np.int64)
        each[there] = sizes[codes]
        return units.gather(ids, units.starts_of(sizes), sizes, codes), each.reshape(-1, 3).sum(1)


#: One encoder a Python worker; besides the tokenizer it holds the parts of one chunk.
_ENCODERS: dict[tuple, UnitEncoder] = {}


def _writer(base: str, tokenizer_json, end_id: int):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = (zlib.crc32(tokenizer_json.value.encode()), end_id >= 1 << 16)
        if key not in _ENCODERS:
            _ENCODERS[key] = UnitEncoder(tokenizer_json.value, 4 if key[1] else None)
        encoder = _ENCODERS[key]
        width, context, done, out = encoder.width, TaskContext.get(), [], None
        end = end_id.to_bytes(width, "little")
        for table in units.chunks(batches, CHUNK_BYTES):
            codes, counts, words = units.unitize(table.column("text").chunk(0))
            flat, lengths = encoder.encode(words)
            flat, at, starts = flat.astype(f"<u{width}"), 0, units.starts_of(lengths)
            for doc_id, n in zip(table.column("doc_id").to_pylist(), counts.tolist(), strict=True):
                if out is None:
                    path = f"{base}/part-{context.partitionId():06d}-{context.taskAttemptId()}-{len(done):03d}.sst"
                    fs, local = common.open_fs(path)
                    fs.create_dir(local.rpartition("/")[0], recursive=True)
                    file = fs.open_output_stream(local, compression=None)
                    out = Writer(file, width)
                out.add(key_of(doc_id), units.gather(flat, starts, lengths, codes[at : at + n]).tobytes() + end)
                at += n
                if out.at >= ROLL_BYTES:
                    out.close()
                    file.close()
                    done.append((path, context.partitionId(), len(done), out.docs, out.tokens))
                    out = None
        if out is not None:
            out.close()
            file.close()
            done.append((path, context.partitionId(), len(done), out.docs, out.tokens))
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done, strict=True), (pa.string(), pa.int32(), pa.int32(), pa.int64(), pa.int64()), strict=True)], names=["path", "part", "seq", "docs", "tokens"])

    return write


def write_shards(docs: DataFrame, tokenizer_path: str | None = None, end_id: int = END_ID) -> DataFrame:
    """Writes the shards; a written table of path, part, seq, docs, tokens, start (ids in earlier shards).

    Parts follow each other in ascending doc_id. Only files it lists are valid.
    """
    spark = docs.sparkSession
    if tokenizer_path is None:
        import public_tokenizers

        tokenizer_path = public_tokenizers.path("byte_bpe_50k.json")
    with open(tokenizer_path, encoding="utf-8") as f:
        shared = spark.sparkContext.broadcast(f.read())
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    dealt = rows.repartitionByRange(common.partitions(spark), "doc_id").sortWithinPartitions("doc_id", "text")
    listing = common.materialize(dealt.mapInArrow(_writer(common.fresh_path(spark, "sst"), shared, end_id), "path string, part int, seq int, docs long, tokens long"), "sst-list")
    before = Window.orderBy("part", "seq").rowsBetween(Window.unboundedPreceding, -1)  # one row a shard file
    return listing.withColumn("start", F.coalesce(F.sum("tokens").over(before), F.lit(0)))


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kinds, names = (pa.int64(),) * 4, ["doc_id", "start", "n_tokens", "ids_crc32"]
    pack = lambda rows: pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)
    for batch in batches:
        for row in batch.to_pylist():
            fs, local = common.open_fs(row["path"])
            at, rows = row["start"], []
            with fs.open_input_file(local) as file:
                for doc_id, ids in SSTable(file).scan():
                    rows.append((doc_id, at, len(ids), zlib.crc32(ids.tobytes())))
                    at += len(ids)
                    if len(rows) == 10_000:
                        yield pack(rows)
                        rows = []
            if rows:
                yield pack(rows)


def read_shards(listing: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document in the listed shards."""
    n = common.partitions(listing.sparkSession)
    return listing.select("path", "start").repartition(n, "path").mapInArrow(_read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def op6_token_sstable(spark, sf_dir) -> DataFrame:
    return read_shards(write_shards(common.documents(spark, sf_dir)))
