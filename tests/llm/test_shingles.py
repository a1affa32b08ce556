"""The pipeline's near-duplicates against brute force: fingerprints of all pairs, then exact Jaccard similarity."""

import random
from collections import Counter

import corpus_pipeline
import numpy as np
import xxhash
from plumbline.llm import common, shingles, simhash

from tests.llm import fixtures


def brute_sets(text):
    words = (text or "").encode().lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))}


def brute_marks(text):
    """A fingerprint a family, bit by bit."""
    hashed = [xxhash.xxh64_intdigest(b" ".join(x), 42) for x in brute_sets(text)]
    out = []
    for factor in shingles._FACTORS.tolist():
        counts = [0] * 64
        for h in hashed:
            h = h * factor % 2**64
            h = (h ^ h >> 32) * 0xD6E8FEB86659FD93 % 2**64
            h ^= h >> 32
            for b in range(64):
                counts[b] += h >> b & 1
        out.append(sum(1 << b for b in range(64) if 2 * counts[b] > len(hashed)))
    return out


def similar_pairs(texts):
    """(i, j, similarity) of all pairs at 0.8 or more."""
    sets, holders = [brute_sets(t) for t in texts], {}
    for i, s in enumerate(sets):
        for j, both in Counter(j for x in s for j in holders.get(x, ())).items():
            if 5 * both >= 4 * (len(s) + len(sets[j]) - both):
                yield j, i, both / (len(s) + len(sets[j]) - both)
        for x in s:
            holders.setdefault(x, []).append(i)


def brute_groups(texts, candidates_only=True):
    parent = list(range(len(texts)))
    marks = [brute_marks(t) for t in texts] if candidates_only else None

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, j, _ in similar_pairs(texts):
        if not candidates_only or any((a ^ b).bit_count() <= 7 for a, b in zip(marks[i], marks[j])):
            parent[find(i)] = find(j)
    return [find(i) for i in range(len(texts))]


def check(df):
    docs = df.collect()
    least = {}
    for r, g in zip(docs, brute_groups([r.text for r in docs])):
        rank = (r.doc_id is None, r.doc_id or 0)
        least[g] = min(least.get(g, rank), rank)
    got = corpus_pipeline.near_duplicates(df.sparkSession, df, "").collect()
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in got) == sorted(least.values())


def edited(rng, n, share):
    words = [f"w{rng.randrange(5000)}" for _ in range(n)]
    return " ".join(words), " ".join(f"x{rng.randrange(5000)}" if rng.random() < share else w for w in words)


def test_stage_finds_what_brute_force_finds(spark):
    rng = random.Random(7)
    texts = [t for _ in range(60) for t in edited(rng, rng.randrange(60, 400), rng.choice([0.005, 0.015, 0.02, 0.03, 0.06]))]
    assert len(set(brute_groups(texts))) < len(texts) - 20
    check(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    check(fixtures.documents(spark))
    check(common.documents(spark, "/root/testdata/sf0.01"))


def test_a_failed_neighbour_hides_no_link(spark):
    """Chains of edits: ends are not similar, each step is."""
    rng, rows = random.Random(8), []
    for _ in range(10):
        words = [f"w{rng.randrange(5000)}" for _ in range(120)]
        for _ in range(12):
            rows.append((len(rows), " ".join(words)))
            words[rng.randrange(120)] = f"y{rng.randrange(5000)}"
    rng.shuffle(rows)
    check(spark.createDataFrame(rows, "doc_id long, text string"))


def test_similar_counts_exactly():
    a = " ".join(map(str, range(13))).encode()
    assert shingles.similar(a, a + b" x y") and not shingles.similar(a, a + b" x y z") and shingles.similar(b" ", None)


def test_candidates_by_similarity():
    """The share of pairs within LIMIT bits in some family, as the module's text states it."""
    rng = random.Random(11)
    hit, total = Counter(), Counter()
    while min(total[k] for k in (16, 17, 18, 19)) < 60:
        a, b = edited(rng, rng.randrange(80, 400), rng.choice([0.004, 0.008, 0.012, 0.016, 0.02]))
        for _, _, s in similar_pairs([a, b]):
            near = simhash.near(shingles.fingerprints(a.encode()), shingles.fingerprints(b.encode()), shingles.LIMIT).any()
            hit[int(s * 20)] += near
            total[int(s * 20)] += 1
    assert hit[16] > 0.65 * total[16] and hit[17] > 0.9 * total[17] and hit[18] > 0.97 * total[18] and hit[19] == total[19]


def test_groups_of_documents(spark):
    """Pairs of distinct documents at 0.87 or more share a group, and no group joins documents that brute force keeps apart."""
    df = common.documents(spark, "/root/testdata/sf0.01")
    docs = df.collect()
    roots = {r._row: r.root for r in shingles.groups(df.selectExpr("doc_id AS _row", "text")).collect()}
    assert all(roots[docs[i].doc_id] == roots[docs[j].doc_id] for i, j, s in similar_pairs([r.text for r in docs]) if s >= 0.87)
    truth = brute_groups([r.text for r in docs], False)
    by_id = {r.doc_id: t for r, t in zip(docs, truth)}
    first = {}
    assert all(first.setdefault(roots[r.doc_id], by_id[r.doc_id]) == by_id[r.doc_id] for r in docs)  # no false group


def test_buckets_cut_into_blocks(monkeypatch):
    rng = np.random.default_rng(3)
    fp = rng.integers(0, 1 << 62, 30)[rng.integers(0, 30, 400)] ^ (np.int64(1) << rng.integers(0, 60, 400))
    sub, node, exact, label = np.sort(rng.integers(0, 3, 400)), rng.permutation(400), rng.random(400) < 0.5, rng.integers(0, 50, 400)
    want = {(min(node[i], node[j]), max(node[i], node[j])) for i in range(400) for j in range(i) if sub[i] == sub[j] and (exact[i] or exact[j]) and label[i] != label[j] and bin(int(fp[i] ^ fp[j])).count("1") <= 7}
    for most in (48, 1000):
        monkeypatch.setattr(simhash, "SHIFT_ROWS", most)
        got = {(min(node[i], node[j]), max(node[i], node[j])) for a, b in shingles._near_pairs(sub, fp, exact, label) for i, j in zip(a, b)}
        assert got == want and len(want) > 50
        u, v = shingles._star_pairs(sub, fp, exact, node, label)
        at = {n: c for n, c in zip(node.tolist(), label.tolist())}
        assert all(at[a] != at[b] for a, b in zip(u.tolist(), v.tolist())) and 0 < len(u) < len(want)


def test_open_buckets_give_rows_of_nodes_not_of_pairs():
    """A bucket of mutual candidates of different labels: a row a node, and links that join just what is similar."""
    import pyarrow as pa

    rng, texts = random.Random(5), []
    for _ in range(4):
        words = [f"w{rng.randrange(5000)}" for _ in range(60)]
        for _ in range(30):
            texts.append(" ".join(words).encode())
            words[rng.randrange(60)] = f"y{rng.randrange(5000)}"
    n = len(texts)
    sub, fp, exact, node = np.zeros(n, np.int64), np.zeros(n, np.int64), np.ones(n, bool), np.arange(n) + 7
    batch = pa.RecordBatch.from_arrays([pa.array(x) for x in (sub, fp, exact, sub, node, node)], names=["sub", "fp", "exact", "family", "node", "label"])
    assert sum(b.num_rows for b in shingles._open_rows(iter([batch]))) == n
    u, v = shingles._bucket_links(sub, fp, exact, node, node, texts)
    root = list(range(n))
    for a, b in zip(u, v):
        assert shingles.similar(texts[a - 7], texts[b - 7])
        x, y = root[a - 7], root[b - 7]
        root = [x if r == y else r for r in root]
    want = brute_groups([t.decode() for t in texts], False)
    assert len({*zip(root, want)}) == len(set(root)) == len(set(want)) and len(u) < n


def test_narrow_tables_are_few_files(spark):
    """Each file of a local disk costs an executor a process or two."""
    import glob

    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", 96)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        rows = [(i, " ".join(f"w{i % 150}x{j}" for j in range(40)) + f" end{i}") for i in range(300)]
        roots = shingles.groups(spark.createDataFrame(rows, "_row long, text string"))
        assert len({r.root for r in roots.collect()}) == 150
        assert len(glob.glob(f"{roots.plumbline_path.removeprefix('file://')}/part-*")) <= 6
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
