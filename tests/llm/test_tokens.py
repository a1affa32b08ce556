"""Operators 4 and 6 against the libraries on whole texts."""

import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from plumbline.llm import bpe, common, sstable, units

from tests.llm import fixtures


@pytest.fixture(scope="module")
def tik():
    import tiktoken

    return tiktoken.Encoding("t", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.load_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken")), special_tokens={})


def test_units_rebuild_and_encode_alike(tik):
    rng = random.Random(3)
    texts = ["".join(rng.choice([" ", " ", "\n", "\n", "\t", "a", "bc", "É", "9", ".", "'s", "’", "\u00a0"]) for _ in range(rng.randrange(1, 14))) for _ in range(3000)]
    texts += ["", " ", "a", "a b", " a", "a ", "a  b", "a \nb", "a\n b", "x  y", "x  y", "it's 'tis", "\x1c a\x1c b", "é è  ê\t\t z", None]
    codes, counts, vocabulary = units.unitize(pa.array(texts, pa.string()))
    vocabulary = vocabulary.to_pylist()
    assert len(set(vocabulary)) == len(vocabulary)
    at = 0
    for t, n in zip(texts, counts):
        pieces = [vocabulary[c] for c in codes[at : at + n]]
        at += n
        assert "".join(pieces) == (t or "")
        assert [i for p in pieces for i in tik.encode_ordinary(p)] == tik.encode_ordinary(t or "")


def check_bpe(df, tik, **kw):
    want = []
    for r in df.select("doc_id", "text").collect():
        t = r.text or ""
        ids = tik.encode_ordinary(t)
        want.append((r.doc_id, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(t.encode()).hexdigest()))
    assert fixtures.rows(bpe.round_trip(df, **kw)) == sorted(want, key=repr)


def test_bpe_edge_cases(spark, tik):
    check_bpe(fixtures.documents(spark), tik)
    check_bpe(fixtures.documents(spark), tik, chunk_bytes=200)
    assert bpe.round_trip(fixtures.empty(spark)).count() == 0


def test_bpe_on_documents(spark, tik):
    df = common.documents(spark, "/root/testdata/sf0.001")
    check_bpe(df, tik)
    got = {r.doc_id: r.ids for r in bpe.encode(df).collect()}
    for r in df.limit(20).collect():
        assert got[r.doc_id] == tik.encode_ordinary(r.text)


def check_sst(df):
    from tokenizers import Tokenizer

    model = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    docs = sorted(df.select("doc_id", "text").collect(), key=lambda r: (r.doc_id is not None, r.doc_id or 0, (r.text or "").encode()))
    want, at = [], 0
    for r in docs:
        ids = model.encode(r.text or "", add_special_tokens=False).ids + [2]
        want.append((r.doc_id, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    listing = sstable.write_shards(df)
    assert fixtures.rows(sstable.read_shards(listing)) == sorted(want, key=repr)
    return listing


def test_sstable_edge_cases(spark):
    check_sst(fixtures.documents(spark))
    empty = sstable.write_shards(fixtures.empty(spark))
    assert empty.count() == 0 and sstable.read_shards(empty).count() == 0


def test_unit_encoder_equals_the_library():
    from tokenizers import Tokenizer

    with open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as f:
        raw = f.read()
    model, encoder = Tokenizer.from_str(raw), sstable.UnitEncoder(raw)
    assert encoder.plain
    rng = random.Random(4)
    words = ["", " ", " x<|endoftext|>", "<|endoftext|>", " <|endoftext|>.", "\n<|endoftext|>", " don't.", " 'tis", " a's.", " é..", " a1.", " ...", " ab.'s", "a\n.b.", " ʼn.", " ªb", " abc’s.", "\n", "\nab.", "\n\nab", "\n ab."]
    words += [rng.choice(["", " ", "\n"]) + "".join(rng.choice("abcXéß.,;!'9–") for _ in range(rng.randrange(1, 12))) for _ in range(4000)]
    for part in (words[:2500], words[1500:], words[:10], []):
        part = list(dict.fromkeys(part))
        ids, lengths = encoder.encode(pa.array(part, pa.large_string()))
        want = [model.encode(w, add_special_tokens=False).ids for w in part]
        assert lengths.tolist() == list(map(len, want)) and ids.tolist() == [i for w in want for i in w]


def test_texts_of_megabytes(spark, tik):
    rng = random.Random(6)
    texts = [" ".join(fixtures.words(rng, 50) for _ in range(6000)) + "\n", "ab" * 600_000, "x.\n" * 400_000, "short <|endoftext|> text"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    check_bpe(df.filter("doc_id <> 1"), tik)
    check_sst(df.filter("doc_id <> 1"))


def test_small_groups_and_few_runs(spark, tik, monkeypatch):
    monkeypatch.setattr(bpe, "MAX_RUNS", 3)
    monkeypatch.setattr(bpe, "GROUP_BYTES", 500)
    check_bpe(common.documents(spark, "/root/testdata/sf0.001"), tik, chunk_bytes=20_000)


def test_sstable_lookup(spark):
    df = common.documents(spark, "/root/testdata/sf0.001")
    listing = check_sst(df)
    crc = {r.doc_id: r.ids_crc32 for r in sstable.read_shards(listing).collect()}
    false = 0
    for r in listing.collect():
        fs, local = common.open_fs(r.path)
        with fs.open_input_file(local) as f:
            table = sstable.SSTable(f)
            for doc_id, _ in table.scan():
                assert zlib.crc32(table.get(doc_id).tobytes()) == crc[doc_id]
            for k in range(10_000, 12_000):
                assert table.get(k) is None
                false += table.might_hold(sstable.key_of(k))
    assert false < 200


def test_sstable_many_blocks_and_damage(tmp_path):
    path = tmp_path / "x.sst"
    with open(path, "wb") as f:
        w = sstable.Writer(f, 2)
        for i in range(-500, 3000, 3):
            w.add(sstable.key_of(i), np.arange(abs(i) % 700, dtype="<u2").tobytes())
        w.close()
    with open(path, "rb") as f:
        t = sstable.SSTable(f)
        assert len(t.index) > 5 and t.docs == len(range(-500, 3000, 3))
        assert len(t.get(-500)) == 500 and len(t.get(700)) == 0 and t.get(701) is None
        assert [d for d, _ in t.scan()] == list(range(-500, 3000, 3))
    data = bytearray(path.read_bytes())
    data[100] ^= 1
    path.write_bytes(data)
    with open(path, "rb") as f, pytest.raises(ValueError):
        list(sstable.SSTable(f).scan())
