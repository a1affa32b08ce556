"""Operator 3 against a word-by-word mix."""

import re
from collections import Counter

import pytest
from plumbline.llm import common, mixture

from tests.llm import fixtures

WORD = re.compile("[^\x20\x09-\x0d]+")


@pytest.mark.parametrize("n", [1, 2, 3, 7, 64, 100, 1025])
def test_permutation(n):
    keys = mixture.round_keys(3, 1, 0)
    got = [mixture.permute(j, n, keys) for j in range(n)]
    assert sorted(got) == list(range(n)) and [mixture.unpermute(x, n, keys) for x in got] == list(range(n))
    assert mixture._permute_array(mixture.np.arange(n), n, keys).tolist() == got


def test_targets():
    assert mixture.targets([10, 10, 10], [1, 1, 1]) == [10, 10, 10]
    assert mixture.targets([1, 100], [3, 1]) == [3, 98]
    assert mixture.targets([0, 0], [1, 2]) == [0, 0] and mixture.targets([], []) == []
    got = mixture.targets([1, 2, 100, 100], [5, 5, 1, 1])
    assert got[:2] == [3, 6] and sum(got) == pytest.approx(203)


@pytest.mark.parametrize("block", [1, 4, 64])
def test_slots_take_exactly_the_words(block):
    for size in (1, 3, 8, 65, 200):
        n = -(-size // block)
        last = size - (n - 1) * block
        for words in range(1, 3 * size + 1):
            slots, cut = mixture.slots_for(words, size, n, last, block, 5, 2)
            got = 0
            for j in range(slots):
                b = mixture.permute(j % n, n, mixture.round_keys(5, 2, j // n))
                have = last if b == n - 1 else block
                got += min(have, cut) if j == slots - 1 else have
            assert got == words and slots <= 3 * n, (size, words)


def test_draws_meet_the_totals():
    draws = mixture.draw_shards([1000, 0, 333, 5], 100, 1)
    assert [sum(d[i] for d in draws) for i in range(4)] == [1000, 0, 333, 5] and all(sum(d) == 100 for d in draws[:-1])


def check(df, block):
    docs = df.collect()
    size = [len(WORD.findall(r.text or "")) for r in docs]
    out = mixture.mixture(df, block=block, shard_slots=64)
    got = out.collect()
    assert Counter((r.doc_id, r.size) for r in got) == Counter((r.doc_id, n) for r, n in zip(docs, size))
    names = sorted({(r.source is None, r.source or "") for r in docs})
    sums = {k: sum(n for r, n in zip(docs, size) if (r.source is None, r.source or "") == k) for k in names}
    goal = mixture.targets([sums[k] for k in names], [(1, 2, 3)[i % 3] for i in range(len(names))])
    key = lambda k: "1" if k[0] else "0" + k[1]
    for k, t in zip(names, goal):
        rows = [r for r in got if r.skey == key(k)]
        assert all(r.source_size == sums[k] and r.target == pytest.approx(t) for r in rows)
        assert abs(sum(r.taken for r in rows) - t) <= 0.5 + 1e-6
    assert all(0 <= r.taken <= 3 * r.size for r in got)
    assert fixtures.rows(out) == sorted((tuple(r) for r in got), key=repr)


def test_mixture(spark):
    check(fixtures.documents(spark), 8)
    check(common.documents(spark, "/root/testdata/sf0.001"), 64)
    assert mixture.mixture(fixtures.empty(spark)).count() == 0
    assert [r.taken for r in mixture.mixture(fixtures.documents(spark).filter("doc_id in (2, 3)")).collect()] == [0, 0]


def test_slots_and_documents_agree(spark):
    """Laid out word by word, the slots give each document the words that the digest says."""
    df = common.documents(spark, "/root/testdata/sf0.001").limit(60)
    streams = mixture.packed(df).collect()
    sizes = Counter()
    for r in streams:
        sizes[r.skey] += r["size"]
    chosen = mixture.plan(dict(sizes), 16)
    owner = {k: [None] * n for k, n in sizes.items()}
    for r in streams:
        owner[r.skey][r.start : r.start + r["size"]] = [r.doc_id] * r["size"]
    want = Counter()
    for s in mixture.mix_slots(spark, chosen).collect():
        want.update(owner[s.skey][s.block * 16 : min(s.block * 16 + 16, s.block * 16 + s.limit)])
    assert {r.doc_id: r.taken for r in mixture.mixture(df, block=16).collect()} == {r.doc_id: want[r.doc_id] for r in streams}


def test_whole_documents_follow_the_slots(spark):
    """Copies of documents are the slots of their blocks: epochs by Feistel permutations, shards by the multinomial draws."""
    df = common.documents(spark, "/root/testdata/sf0.001")
    rows, row = common.keyed(df)
    copies, plan = mixture.document_slots(rows, row, block=16, shard_slots=200)
    got = Counter((r[row], r.slot) for r in copies.collect())
    streams, want = mixture.packed(rows, "source", row).collect(), Counter()
    for s in plan["sources"]:
        n, keys, docs = s["blocks"], mixture.round_keys(17, s["source_no"], s["whole"]), [r for r in streams if r.skey == s["skey"] and r["size"]]
        block = {r[row]: (r.start + r["size"] // 2) // 16 for r in docs}
        last = {r[row]: mixture.unpermute(block[r[row]], n, keys) for r in docs}
        for e in range(s["whole"]):
            want.update((r[row], e * n + mixture.unpermute(block[r[row]], n, mixture.round_keys(17, s["source_no"], e))) for r in docs)
        words = 0
        for r in sorted(docs, key=lambda r: (last[r[row]], r.start)):
            if 2 * words + r["size"] <= 2 * s["rest"]:
                want[r[row], s["whole"] * n + last[r[row]]] += 1
            words += r["size"]
    assert got == want and max(got.values()) == 1
    assert len(plan["shards"]) > 5 and all(0 < sum(d) <= 200 for d in plan["shards"])
    done, of = Counter(), {}
    for i, draws in enumerate(plan["shards"]):
        for k, n in enumerate(draws):
            of |= {(plan["sources"][k]["skey"], j): i for j in range(done[k], done[k] + n)}
            done[k] += n
    assert "BroadcastHashJoin [skey" not in copies._jdf.queryExecution().executedPlan().toString()  # the slots grow with the input
    key = {r[row]: r.skey for r in streams}
    assert all(of[key[r[row]], r.slot] == r.shard for r in copies.collect())
    taken = Counter(r.doc_id for r in mixture.taken_documents(df).collect())
    whole, _ = mixture.document_slots(rows, row)
    assert taken == Counter(r.doc_id for r in rows.join(whole, row).collect())


@pytest.mark.parametrize("n", [1, 2, 3, 64, 1025])
def test_permutation_back(n):
    keys = mixture.round_keys(3, 1, 0)
    assert mixture._unpermute_array(mixture._permute_array(mixture.np.arange(n), n, keys), n, keys).tolist() == list(range(n))
