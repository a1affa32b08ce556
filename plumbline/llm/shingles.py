"""Operator 2 for whole corpora: SimHash near-duplicates of a Jaccard similarity of 0.8 or more between sets of five-word shingles.

Equal texts (in words, ASCII case aside) are one node. A node has FAMILIES
fingerprints of 64 majority bits over its distinct shingles, from independent
hashes. The generalised pigeonhole of `simhash` finds the pairs of nodes that
differ in LIMIT bits or fewer within some family, and each such candidate is
verified on the exact sets. Two sets of similarity s have an angle of
acos(2 s / (1 + s)), which is the share of bits in which they differ, so a pair
at 0.8 is a candidate with a probability of about 0.76, at 0.85 of 0.96, at 0.9
of 0.998; one family would give 0.21, 0.41 and 0.66.

A pass over all nodes finds those that have any candidate; only these go on. Then
one family after another gives the links that could still join components: in a
bucket, a star over one node of each component, so a group of mutual copies is
linked without all its pairs. At last the nodes that still have a candidate in
another component are put into their buckets with their texts, and the tasks verify all such pairs there: a row a node and bucket, never
a row a pair, so no candidate's link is lost.

Defined cases: texts of fewer than five words are one shingle; null text and
text without words are equal; of each component the row with the smallest
(doc_id, text digest, row key) stays, null ids last; an empty table gives no
rows; other columns are kept.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm import common, simhash
from plumbline.llm.components import components, forest

SHINGLE, SEED = 5, 42
#: Similarity of 4 / 5 at least.
SHARED, OF = 4, 5
FAMILIES, LIMIT = 6, 7

_FACTORS = np.random.default_rng(SEED).integers(0, 1 << 63, FAMILIES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingles(text: bytes | None, size: int = SHINGLE) -> set[bytes]:
    words = (text or b"").lower().split()
    return {b" ".join(words[i : i + size]) for i in range(max(1, len(words) - size + 1))}


def similar(a: bytes | None, b: bytes | None) -> bool:
    x, y = shingles(a), shingles(b)
    both = len(x & y)
    return OF * both >= SHARED * (len(x) + len(y) - both)


def fingerprints(text: bytes | None) -> np.ndarray:
    """A fingerprint a family."""
    import xxhash

    hashed = xxhash.xxh64_intdigest
    h = np.fromiter((hashed(s, SEED) for s in shingles(text)), np.uint64)
    ones = np.zeros((FAMILIES, simhash.BITS), np.int64)
    for lo in range(0, len(h), 1 << 14):
        x = h[None, lo : lo + (1 << 14)] * _FACTORS[:, None]
        x ^= x >> np.uint64(32)
        x *= np.uint64(0xD6E8FEB86659FD93)
        x ^= x >> np.uint64(32)
        ones += np.unpackbits(x.view(np.uint8).reshape(FAMILIES, -1, 8), axis=2, bitorder="little").sum(1, dtype=np.int64)
    return np.packbits(2 * ones > len(h), axis=1, bitorder="little").view("<i8").ravel()


MARKS = "_row long, node long, fps array<long>"


def _marks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    import xxhash

    for batch in batches:
        nodes, marks = np.zeros(batch.num_rows, np.uint64), np.zeros((batch.num_rows, FAMILIES), np.int64)
        for i, t in enumerate(batch.column(1)):
            text = t.as_py() or b""
            nodes[i] = xxhash.xxh64_intdigest(b" ".join(text.lower().split()), SEED)
            marks[i] = fingerprints(text)
        lists = pa.ListArray.from_arrays(pa.array(np.arange(0, marks.size + 1, FAMILIES, dtype=np.int32)), pa.array(marks.ravel()))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(nodes.view(np.int64)), lists], names=["_row", "node", "fps"])


def _chunk_marks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """`_marks` of text and key."""
    for batch in batches:
        text, key = batch.columns
        text = text if pa.types.is_binary(text.type) else text.cast(pa.string()).cast(pa.binary())
        yield from _marks(iter([pa.RecordBatch.from_arrays([key, text], names=["_row", "text"])]))


def _near_pairs(sub, fp, exact, label) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places of pairs of different labels within LIMIT bits in one bucket (rows sorted by `sub`), one of them exact; a part at a time."""
    edges = np.flatnonzero(np.concatenate([[True], sub[1:] != sub[:-1], [True]])) if len(sub) else np.zeros(1, np.int64)
    sizes = np.diff(edges)
    small = np.flatnonzero(np.repeat(sizes <= simhash.SHIFT_ROWS, sizes))
    k, f, e, c = (x[small] for x in (sub, fp, exact, label))
    for s in range(1, int(sizes[sizes <= simhash.SHIFT_ROWS].max(initial=0))):
        pick = np.flatnonzero((k[s:] == k[:-s]) & (e[s:] | e[:-s]) & (c[s:] != c[:-s]))
        pick = pick[simhash.near(f[pick], f[pick + s], LIMIT)]
        if len(pick):
            yield small[pick], small[pick + s]
    for i in np.flatnonzero(sizes > simhash.SHIFT_ROWS):
        at = np.arange(edges[i], edges[i + 1])
        own = at[exact[at]]
        for lo in range(0, len(at), 256):
            rows = at[lo : lo + 256]
            hit, to = np.nonzero(simhash.near(fp[rows, None], fp[own][None, :], LIMIT) & (label[rows, None] != label[own][None, :]))
            if len(hit):
                yield rows[hit], own[to]


def _near_nodes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The nodes that have a candidate."""
    for sub, fp, exact, _, node in simhash.whole_buckets(batches):
        found = np.zeros(len(node), bool)
        for i, j in _near_pairs(sub, fp, exact, node):
            found[i] = found[j] = True
        yield pa.RecordBatch.from_arrays([pa.array(np.unique(node[found]))], names=["node"])


def _star_pairs(sub, fp, exact, node, label) -> tuple[np.ndarray, np.ndarray]:
    """Of each cluster of candidates the smallest node with one node of each other label."""
    nodes, first = np.unique(node, return_index=True)
    us, vs = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for i, j in _near_pairs(sub, fp, exact, label):
        u, v = forest(node[i], node[j])
        us.append(u)
        vs.append(v)
    u, v = forest(np.concatenate(us), np.concatenate(vs))  # v is the smallest of its cluster
    of = lambda x: label[first[np.searchsorted(nodes, x)]]
    pick = np.flatnonzero(of(u) != of(v))
    _, one = np.unique(np.stack([v[pick], of(u)[pick]], axis=1), axis=0, return_index=True)
    return v[pick][one], u[pick][one]


def _stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for sub, fp, exact, _, node, label in simhash.whole_buckets(batches):
        u, v = _star_pairs(sub, fp, exact, node, label)
        yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], names=["u", "v"])


OPEN = "sub long, fp long, exact boolean, node long, label long"


def _open_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows of buckets that have a candidate of another label there."""
    for sub, fp, exact, _, node, label in simhash.whole_buckets(batches):
        found = np.zeros(len(node), bool)
        for i, j in _near_pairs(sub, fp, exact, label):
            found[i] = found[j] = True
        yield pa.RecordBatch.from_arrays([pa.array(x[found]) for x in (sub, fp, exact, node, label)], names=["sub", "fp", "exact", "node", "label"])


def _bucket_links(sub, fp, exact, node, label, text) -> tuple[list[int], list[int]]:
    """Similar pairs of nodes of different labels: so many that all of them that are candidates get joined."""
    numbers: dict[bytes, int] = {}
    sets: dict[int, np.ndarray] = {}
    parent: dict[int, int] = {}

    def find(x: int) -> int:
        while (up := parent.get(x, x)) != x:
            parent[x] = parent.get(up, up)
            x = up
        return x

    def ids(i: int) -> np.ndarray:
        n = int(node[i])
        if n not in sets:
            sets[n] = np.fromiter((numbers.setdefault(s, len(numbers)) for s in shingles(text[i])), np.int64)
        return sets[n]

    us, vs = [], []
    for left, right in _near_pairs(sub, fp, exact, label):
        order = np.argsort(left, kind="stable")
        mark, last = np.zeros(0, bool), -1
        for i, j in zip(left[order].tolist(), right[order].tolist(), strict=True):
            x, y = find(int(label[i])), find(int(label[j]))
            if x == y:
                continue
            a, b = ids(i), ids(j)
            if i != last or len(mark) < len(numbers):
                mark, last = np.zeros(len(numbers), bool), i
                mark[a] = True
            both = int(mark[b].sum())
            if OF * both >= SHARED * (len(a) + len(b) - both):
                parent[max(x, y)] = min(x, y)
                us.append(int(node[i]))
                vs.append(int(node[j]))
    return us, vs


def _open_links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for columns in simhash.whole_buckets(batches):
        u, v = _bucket_links(*columns)
        yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], names=["u", "v"])


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        u, v, a, b = batch.columns
        yield batch.select(["u", "v"]).filter(pa.array([similar(x.as_py(), y.as_py()) for x, y in zip(a, b, strict=True)], pa.bool_()))


def _verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs (u, v) whose texts are similar."""
    sides = pairs.join(texts.select(F.col("node").alias("u"), F.col("text").alias("a")), "u").join(texts.select(F.col("node").alias("v"), F.col("text").alias("b")), "v")
    return common.materialize_narrow(sides.select("u", "v", "a", "b").mapInArrow(_verify, "u long, v long"), "verified")


def groups(rows: DataFrame, chunks: common.Chunks | None = None) -> DataFrame:
    """_row, root per row of `rows` (columns _row and text): one root a component of similar texts. A written table.

    If `rows` come from chunks, their texts are read and taken there.
    """
    spark = rows.sparkSession
    each = lambda df, *more: df.select(F.posexplode("fps").alias("family", "fp"), "node", *more).select("fp", F.col("family").cast("long").alias("family"), "node", *more)
    with common.temporary(spark) as keep:
        texts = rows.select("_row", F.col("text").cast("string").cast("binary").alias("text"))
        marks = common.materialize(chunks.map(_chunk_marks, MARKS, ["text"]) if chunks else texts.mapInArrow(_marks, MARKS), "shingles")
        # A node is known by the least _row of its texts, which is shorter than its hash.
        nodes = marks.groupBy(F.col("node").alias("hash")).agg(F.min("_row").alias("node"), F.first("fps").alias("fps"))
        nodes = common.materialize(nodes, "nodes")
        every = each(nodes)
        parts = simhash.parts_of(every, LIMIT, FAMILIES)
        hot = simhash.hot_buckets(every, parts)
        some = common.materialize_narrow(simhash.dealt(every, parts, hot).mapInArrow(_near_nodes, "node long").distinct(), "near")
        common.release(spark)
        some = common.materialize(nodes.join(some, "node", "left_semi").select("node", "fps"), "candidates")
        # The key comes back as the column beside the texts.
        held = chunks.take(some.select(F.col("node").alias("key"), "node"), ["text"]) if chunks else some.select("node").join(texts, F.col("node") == F.col("_row"))
        written = common.materialize(held.select("node", F.col("text").cast("string").cast("binary").alias("text")), "texts")
        common.release(spark)
        labels, tried, found = some.select("node", F.col("node").alias("label")), None, None
        renamed = lambda links: some.select("node").join(components(links, written=True), "node", "left").select("node", F.coalesce("root", "node").alias("label"))
        here = lambda: each(some.join(labels, "node"), "label")
        for family in range(FAMILIES):
            pairs = simhash.dealt(here().filter(F.col("family") == family), parts, hot).mapInArrow(_stars, "u long, v long").distinct()
            pairs = common.materialize_narrow(pairs if tried is None else pairs.join(tried, ["u", "v"], "left_anti"), "pairs")
            if pairs.isEmpty():  # nothing that this family could still join
                continue
            right = _verified(pairs, written)
            tried, found = (pairs, right) if tried is None else (tried.unionByName(pairs), found.unionByName(right))
            if not right.isEmpty():
                labels = renamed(found)
        rows_left = common.materialize_narrow(simhash.dealt(here(), parts, hot).mapInArrow(_open_rows, OPEN), "open")  # all that is left
        if not rows_left.isEmpty():
            told = rows_left.join(written, "node").select("sub", "fp", "exact", "node", "label", "text").repartition(common.partitions(spark), "sub").sortWithinPartitions("sub")
            right = common.materialize_narrow(told.mapInArrow(_open_links, "u long, v long"), "verified")
            if not right.isEmpty():
                labels = renamed(right if found is None else found.unionByName(right))
        named = nodes.select("hash", "node").join(labels, "node", "left").select("hash", F.coalesce("label", "node").alias("root"))
        return keep(common.materialize_narrow(marks.select("_row", F.col("node").alias("hash")).join(named, "hash").select("_row", "root"), "roots"))


def one_of_each(docs: DataFrame) -> DataFrame:
    """One row of `docs` of each group of near-duplicates."""
    chunks = common.Chunks(docs)
    rows = chunks.rows("doc_id", "text")
    roots = groups(rows.select(F.col(chunks.row).alias("_row"), "text"), chunks)
    return chunks.take(common.least_keys(rows, chunks.row, roots.withColumnRenamed("_row", "row"))).select(*docs.columns)
