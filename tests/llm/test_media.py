"""Operator 8: exact round trips."""

import hashlib
import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from plumbline.llm import common, media
from pyspark.sql import functions as F

from tests.llm import fixtures


def naive_cuts(payload):
    out, start = [], 0
    h = [sum(int(media.GEAR[payload[i - j]]) << j for j in range(32) if i >= j) & 0xFFFFFFFF for i in range(len(payload))]
    while start < len(payload):
        end = len(payload)
        for e in range(start + 1024, min(start + 65536, len(payload)) + 1):
            if h[e - 1] < 1 << 20 or e == start + 65536:
                end = e
                break
        out.append(end)
        start = end
    return out


def test_cuts():
    rng = random.Random(2)
    for n in (64, 1024, 1088, 30_016):
        p = bytes(rng.choice(b"abcdefgh ") for _ in range(n))
        assert media.cuts(p) == naive_cuts(p)
    same = bytes(200_000)
    assert media.cuts(same)[-1] == 200_000 and max(np.diff([0, *media.cuts(same)])) <= 65536
    a = rng.randbytes(60_000)
    shared = {d for d, _ in media.chunks_of(a)} & {d for d, _ in media.chunks_of(b"other start " + a)}
    assert len(shared) >= 8


def plain_feature(payload, pieces):
    counts = Counter(payload)
    bits = sum(-c / len(payload) * math.log2(c / len(payload)) for c in counts.values())
    return f"chunks={pieces};values={len(counts)};mean={sum(payload) / len(payload):.4f};bits={bits + 0.0:.4f}"


def want(df):
    out = []
    for r in df.select("doc_id", "text").collect():
        raw = (r.text or "").encode()
        p = raw + bytes(-len(raw) % 64 or (0 if raw else 64))
        ends = [0, *media.cuts(p)]
        pieces = [p[a:b] for a, b in zip(ends, ends[1:])]
        form = b"".join(hashlib.sha256(x).digest()[:16] + len(x).to_bytes(4, "little") for x in pieces) + p
        out.append((r.doc_id, len(raw), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:]), len(form), hashlib.sha256(form).hexdigest(), plain_feature(p, len(pieces))))
    return sorted(out, key=repr)


def check(df):
    documents, stored = media.write_media(df)
    got = documents.join(media.read_media(stored), "media")
    assert fixtures.rows(got.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature")) == want(df)
    return got, stored


def test_round_trip(spark):
    got, stored = check(fixtures.documents(spark))
    assert stored.count() == len({(r.text or '').rstrip('\0') for r in fixtures.documents(spark).collect()})
    assert stored.filter("size(foreign) > 0").count() >= 1  # the long text with a tail refers to chunks of the long text
    check(common.documents(spark, "/root/testdata/sf0.001"))
    _, none = check(fixtures.empty(spark))
    assert none.count() == 0


def test_a_text_of_megabytes(spark):
    rng = random.Random(3)
    text = " ".join(fixtures.words(rng, 400) for _ in range(1000))
    check(spark.createDataFrame([(1, text), (2, text[500_000:] + "x"), (3, "ab" * 700_000)], "doc_id long, text string"))


def test_each_chunk_is_stored_once(spark):
    base = " ".join(f"word{i}" for i in range(9000))
    df = spark.createDataFrame([(i, base[: 40_000 + 900 * (i % 5)]) for i in range(20)], "doc_id long, text string")
    got, stored = check(df)
    chunks = stored.select(F.explode(F.concat("own", "shared")).alias("c")).select("c.digest")
    assert chunks.count() == chunks.distinct().count() and stored.count() == 5


def test_damage_is_found(spark):
    _, stored = media.write_media(spark.createDataFrame([(1, "some text")], "doc_id long, text string"))
    bad = stored.withColumn("own", F.transform("own", lambda c: F.struct(c["digest"], F.lit(b"x" * 64).alias("data"))))
    with pytest.raises(Exception, match="differs"):
        media.read_media(bad).collect()
