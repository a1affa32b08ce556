"""Operator 1 against brute force."""

import hashlib
import random
import zlib

import numpy as np
import pyarrow as pa
from plumbline.llm import common, suffixes

from tests.llm import fixtures


def brute(docs):
    """docs: (doc_id, text); one row a document."""
    rows = [(d, (t or "").encode()) for d, t in docs]
    key = lambda d, b: (suffixes.NO_ID if d is None else d, zlib.crc32(b))
    seen, out = set(), {}
    for k, b in sorted({key(d, b): b for d, b in rows}.items()):
        gone = bytearray(len(b))
        for i in range(len(b) - 99):
            w = b[i : i + 100]
            if w in seen:
                gone[i : i + 100] = b"\1" * 100
            seen.add(w)
        kept = bytes(x for x, g in zip(b, gone) if not g)
        runs = sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
        out[k] = (len(b), sum(gone), runs, hashlib.sha256(kept).hexdigest())
    return sorted(((d, *out[key(d, b)]) for d, b in rows), key=repr)


def check(df, **kw):
    want = brute([(r.doc_id, r.text) for r in df.collect()])
    assert fixtures.rows(suffixes.dedup(df, **kw)) == want
    return want


def test_edge_cases(spark):
    want = check(fixtures.documents(spark))
    assert sum(w[2] for w in want) > 1000
    assert suffixes.dedup(fixtures.empty(spark)).count() == 0
    check(fixtures.documents(spark).filter("doc_id in (2, 3, 4)"))


def test_documents(spark):
    want = check(common.documents(spark, "/root/testdata/sf0.001").repartition(5))
    assert sum(w[3] for w in want) > 5


def test_shared_passages(spark):
    rng = random.Random(4)
    say = lambda n: "".join(rng.choice("abcdefgh é\x00") for _ in range(n))
    passages = [say(n) for n in (99, 100, 101, 140, 260, 900)]
    docs = [(i, say(rng.randrange(60)) + "".join(rng.choice(passages)[rng.randrange(40) :] + say(rng.randrange(30)) for _ in range(rng.randrange(5)))) for i in range(120)]
    docs += [(i, "ab" * rng.randrange(300)) for i in range(200, 206)] + [(300, "x" * 5000), (301, "y" + "x" * 700)]
    rng.shuffle(docs)
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(7)
    check(df)
    assert len(suffixes.hot_anchors(suffixes.written_texts(df), 1)) > 20
    check(df, contexts=1)


def test_a_passage_in_most_documents(spark):
    """Its anchors at both ends have a context a document; they are hot, and no suffix array holds them."""
    rng = random.Random(9)
    say = lambda n: "".join(rng.choice("abcdefgh é") for _ in range(n))
    passage = say(300)
    df = spark.createDataFrame([(i, say(150) + passage + say(150)) for i in range(400)], "doc_id long, text string").repartition(4)
    texts = suffixes.written_texts(df)
    assert 0 < len(suffixes.hot_anchors(texts)) < 30
    check(df)
    _, groups = suffixes.repeats(texts)
    assert groups.groupBy("grp").count().filter("count > 100").isEmpty()


def test_a_text_of_megabytes(spark):
    rng = random.Random(10)
    text = "".join(rng.choice("abcdefgh é") for _ in range(1_500_000))
    check(spark.createDataFrame([(1, text + text[:700_000]), (2, text[1_000_000:1_200_000]), (3, "ab" * 300_000)], "doc_id long, text string"))


def test_every_occurrence_is_reached(spark):
    """Of each maximal repeat, all places where its bytes stand, also those in copies that were collapsed early."""
    rng = random.Random(12)
    say = lambda n: "".join(rng.choice("abcdefgh") for _ in range(n))
    a, b = say(180), say(130)
    docs = [(1, say(50) + a + say(40) + b), (2, a + say(70)), (3, say(20) + b + a + say(9))]
    docs += [(i, docs[i % 3][1]) for i in range(4, 12)] + [(20, say(33) + docs[2][1])]
    texts = suffixes.written_texts(spark.createDataFrame(docs, "doc_id long, text string").repartition(3))
    copies, groups = suffixes.repeats(texts)
    text = dict(docs)
    found = {}
    for r in suffixes.occurrences(copies, groups).collect():
        found.setdefault((r.grp, text[r.oid][r.start : r.start + r.size]), set()).add((r.oid, r.start))
    assert len(found) == len({g for g, _ in found}) > 3
    assert {w[i : i + 100] for _, w in found for i in range(len(w) - 99)} >= {x[i : i + 100] for x in (a, b) for i in range(len(x) - 99)}
    for (_, w), places in found.items():
        assert places == {(d, i) for d, t in docs for i in range(len(t)) if t.startswith(w, i)}


def test_small_blocks(monkeypatch):
    """Segments cover every window once, also across block borders."""
    data = np.frombuffer(random.Random(1).randbytes(3000), np.uint8)
    valid = np.ones(3000, bool)
    valid[-99:] = False
    for block in (1 << 18, 256, 64):
        monkeypatch.setattr(suffixes, "BLOCK", block)
        suffixes._powers.clear()
        anchor, _, _, start, size = suffixes.segments(data, valid)
        windows = [i for s, z in zip(start, size) for i in range(s, s + z - 99)]
        assert sorted(windows) == list(range(2901))
        assert size.max() <= 168
        split = suffixes.segments(data, valid, np.unique(anchor)[::2])
        assert sorted(i for s, z in zip(*split[3:]) for i in range(s, s + z - 99)) == list(range(2901))
    suffixes._powers.clear()


def test_suffix_array_and_maximal_repeats():
    rng = random.Random(8)
    for least in (3, 5):
        pieces = ["".join(rng.choice("ab") for _ in range(rng.randrange(least, 30))).encode() for _ in range(9)]
        tree = suffixes.SuffixArray(pieces, least)
        tail = [pieces[tree.piece[i]][i - tree.begin[tree.piece[i]] :] for i in tree.suffix]
        assert tail == sorted(p[i:] for p in pieces for i in range(len(p) - least + 1))
        common_ = lambda a, b: next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
        assert tree.lcp.tolist() == [common_(a, b) for a, b in zip(tail, tail[1:])]
        got = sorted((size, sorted(tree.suffix[lo:hi].tolist())) for size, lo, hi in tree.maximal_repeats(least))
        at, want = {}, []
        for k, p in enumerate(pieces):
            for i in range(len(p)):
                for j in range(i + least, len(p) + 1):
                    at.setdefault(p[i:j], []).append((k, i))
        for w, places in at.items():
            if len(places) > 1:
                right = {pieces[k][i + len(w) : i + len(w) + 1] or (k, "end") for k, i in places}
                before = {pieces[k][i - 1 : i] if i else (k, "start") for k, i in places}
                unknown = any(i == 0 for _, i in places)
                ends = any(i + len(w) == len(pieces[k]) for k, i in places)
                if (len(right) > 1 or ends) and (len(before) > 1 or unknown):
                    want.append((len(w), sorted(int(tree.begin[k]) + i for k, i in places)))
        assert got == sorted(want)


def test_nested_repeats_give_rows_in_proportion():
    """A place in many nested repeats has one row, with the finish of the longest that also starts earlier."""
    rng = random.Random(21)
    say = lambda n: bytes(rng.randrange(97, 123) for _ in range(n))
    passage, counts = say(160), []
    for n in (30, 60):
        cut = [100 + rng.randrange(60) if i >= 60 else 100 + i for i in range(n)]
        rng.shuffle(cut)
        docs = [passage[:c] + say(8) for c in cut]
        table = pa.table({"oid": range(n), "tie": [0] * n, "start": [0] * n, "data": pa.array(docs, pa.binary())}, schema=pa.schema([("oid", pa.int64()), ("tie", pa.int64()), ("start", pa.int64()), ("data", pa.binary())]))
        rows, _ = suffixes._block_repeats(table, 0)
        windows = sum(len(d) - 99 for d in docs)
        assert n < rows.num_rows <= 2 * windows
        intervals, places = ([r for r in rows.to_pylist() if (r["size"] is None) == k] for k in (False, True))
        listed = sum(r["high"] - r["low"] for r in intervals)
        counts.append((len(intervals), len(places), listed))
        for r in places:
            d, at = docs[r["oid"]], r["start"]
            longest = max((k for k in range(100, len(d) - at + 1) if any(x.find(d[at : at + k]) >= 0 for x in docs[: r["oid"]])), default=None)
            assert r["finish"] == (longest and at + longest)
    (i, p, listed), (i2, p2, listed2) = counts
    assert i2 + p2 <= 3 * (i + p) and listed2 > 3 * listed
