"""Operator 2 against brute force."""

import random
import re

import numpy as np
import pytest
import xxhash
from plumbline.llm import common, simhash
from plumbline.llm.components import components
from pyspark.sql import functions as F

from tests.llm import fixtures

WORD = re.compile("[^\x20\x09-\x0d]+")


def brute_fp(text):
    words = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    if not words:
        return 0
    sh = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(fps, ids, limit):
    parent = list(range(len(fps)))

    def find(i):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if bin(fps[i] ^ fps[j]).count("1") <= limit:
                parent[find(i)] = find(j)
    least = {}
    for i, d in enumerate(ids):
        r = find(i)
        least[r] = d if least.get(r) is None else least[r] if d is None else min(least[r], d)
    return [least[find(i)] for i in range(len(fps))]


def check(df):
    docs = df.collect()
    fps = [brute_fp(r.text) for r in docs]
    want = list(zip([r.doc_id for r in docs], [f"{f:016x}" for f in fps], brute_components(fps, [r.doc_id for r in docs], 4)))
    out = simhash.near_duplicates(df).select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0"), "component_id")
    assert fixtures.rows(out) == sorted(want, key=repr)


def test_documents(spark):
    check(fixtures.documents(spark))
    check(common.documents(spark, "/root/testdata/sf0.001"))
    assert simhash.near_duplicates(fixtures.empty(spark)).count() == 0


def clustered(rng, n):
    out = []
    while len(out) < n:
        c = rng.getrandbits(64)
        for _ in range(rng.choice([1, 1, 2, 60])):
            f = c
            for b in rng.sample(range(64), rng.randrange(6)):
                f ^= 1 << b
            out.append(f)
    return sorted(set(out))[: n * 2]


@pytest.mark.parametrize("seed,hot", [(1, 4096), (2, 16)])
def test_links_lose_nothing(spark, seed, hot):
    fps = clustered(random.Random(seed), 500)
    signed = np.array(fps, np.uint64).view(np.int64).tolist()
    df = spark.createDataFrame([(x,) for x in signed], "fp long")
    roots = {r.node: r.root for r in components(simhash.links(df, 4, hot)).collect()}
    want = brute_components(fps, signed, 4)
    assert [roots.get(x, x) for x in signed] == want


def test_allocation_covers_every_pair():
    rng = np.random.default_rng(1)
    for n in (10, 10**5, 10**10):
        chance = simhash.distances(np.ones((8, 256)))
        layout, t, _ = simhash.allocate(chance, n)
        assert sum(t) == 4 - len(layout) + 1
        order = list(range(64))
        for _ in range(300):
            a = int(rng.integers(0, 2**63))
            b = a
            for bit in rng.choice(64, 4, replace=False):
                b ^= 1 << int(bit)
            at, ok = 0, False
            for g, k in zip(layout, t):
                mask = (1 << 8 * g) - 1
                ok |= bin((a >> at & mask) ^ (b >> at & mask)).count("1") <= k
                at += 8 * g
            assert ok
    skew = np.ones((8, 256))
    skew[:4] = 0
    skew[:4, 7] = 1
    layout, t, _ = simhash.allocate(simhash.distances(skew), 10**6)
    assert t[0] == -1  # constant bits are no help
    assert sorted(simhash.order_bits(np.eye(64) * 5, 10)) == order


def test_one_of_each(spark):
    df = fixtures.documents(spark)
    kept = simhash.one_of_each(df)
    assert kept.columns == df.columns
    want = {r.component_id for r in simhash.near_duplicates(df).collect()}
    assert sorted((x.doc_id for x in kept.collect()), key=repr) == sorted(want, key=repr)


def test_components_of_paths(spark):
    rng = random.Random(3)
    ids = rng.sample(range(10**6), 60)
    df = spark.createDataFrame([(a, b) for run in (ids[:30], ids[30:59]) for a, b in zip(run, run[1:])], "u long, v long")
    got = {r.node: r.root for r in components(df).collect()}
    assert all(got.get(x, x) == min(run) for run in (ids[:30], ids[30:59]) for x in run)
    assert components(df.limit(0)).count() == 0


def test_few_links_are_joined_without_rounds(spark):
    rng = random.Random(7)
    rows = [(rng.randrange(-600, 600) << 40, rng.randrange(-600, 600) << 40) for _ in range(700)] + [(5, 5), (5, 4), (4, 5)]
    df = common.materialize(spark.createDataFrame(rows, "u long, v long"), "links")
    by_rounds = {r.node: r.root for r in components(df, few=0).collect()}
    spark.sparkContext.setJobGroup("few links", "")
    got = {r.node: r.root for r in components(df).collect()}
    jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup("few links"))
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert got == by_rounds and got[5] == 4 and len(set(got.values())) > 1
    assert jobs <= 6  # rounds make some ten jobs each
