"""Operator 2: SimHash near-duplicates by the generalised pigeonhole principle.

Fingerprints are 64 majority bits over the XXH64 of word shingles. Distinct
fingerprints are compared, not documents. The 64 bits are ordered so that
correlated ones stand together and cut into parts; if two fingerprints differ
in at most T bits, then for any thresholds t_i with sum T - parts + 1 they
differ in at most t_i bits within some part i. The parts and thresholds (-1:
unused) are allocated by dynamic programming on the estimated number of probes
and candidates, from the exact distribution of values of every UNIT bits. Every fingerprint is put into a bucket per part, probes the buckets
within t_i, and what meets in a bucket is verified on all 64 bits.

A task gives a spanning forest of the links it verifies, never all pairs. A
bucket with more than HOT_ROWS rows is cut into blocks; its pairs of blocks are
tasks of their own. Components come from `components`.

Defined cases: null text and text without words have fingerprint zero; repeated
rows and equal texts share a fingerprint; a null doc_id is never a component's
name unless the component has no other; an empty table gives no rows; other
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm import common
from plumbline.llm.components import components, forest

SHINGLE, SEED, BITS = 4, 42, 64
MAX_DISTANCE = 4
#: Ways to cut the bits into parts, in units of UNIT bits.
UNIT = 4
LAYOUTS = ((8, 8), (6, 6, 4), (4, 4, 4, 4), (4, 4, 4, 2, 2), (4, 3, 3, 3, 3))
#: Cost of a compared candidate, a shuffled probe being 1. Measured: 18 to 32 ns in `bucket_links`, 1.8 to 2.8 us in Spark.
CANDIDATE_COST = 0.01
HOT_ROWS = 4096
#: So many hot buckets at most are broadcast, 24 bytes each.
BROADCAST_ROWS = 1 << 18
#: Buckets up to this size are compared by shifts of the sorted rows, larger ones by blocks.
SHIFT_ROWS = 48


def fingerprint(text: bytes | None, size: int = SHINGLE) -> int:
    import xxhash

    words = (text or b"").lower().split()
    if not words:
        return 0
    hashed = xxhash.xxh64_intdigest
    if len(words) <= size:
        return hashed(b" ".join(words), SEED)
    h = np.array([hashed(b" ".join(w), SEED) for w in zip(*(words[i:] for i in range(size)), strict=False)], "<u8")
    ones = np.zeros(BITS, np.int64)
    for i in range(0, len(h), 1 << 16):
        ones += np.unpackbits(h[i : i + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(h), bitorder="little").view("<u8")[0])


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        values = np.fromiter((fingerprint(t.as_py()) for t in batch.column(1)), np.uint64, batch.num_rows)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(values.view(np.int64))], names=["doc_id", "fp"])


def _bits(fp: np.ndarray) -> np.ndarray:
    return np.unpackbits(fp.astype("<i8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")


def _pair_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros((BITS, BITS))
    for batch in batches:
        fp = batch.column(0).to_numpy()
        for i in range(0, len(fp), 1 << 16):
            b = _bits(fp[i : i + (1 << 16)]).astype(np.float32)
            total += b.T @ b
    i, j = np.indices(total.shape)
    yield pa.RecordBatch.from_arrays([pa.array(i.ravel()), pa.array(j.ravel()), pa.array(total.ravel())], names=["i", "j", "n"])


def order_bits(pairs: np.ndarray, n: int) -> list[int]:
    """The bits in groups of eight: a group grows by the bit most correlated with its members."""
    p = np.diag(pairs) / max(n, 1)
    spread = np.sqrt(np.maximum(p * (1 - p), 1e-12))
    correlation = np.abs((pairs / max(n, 1) - np.outer(p, p)) / np.outer(spread, spread))
    np.fill_diagonal(correlation, 0)
    left, order = set(range(BITS)), []
    while left:
        group = [max(left, key=lambda b: (correlation[b, list(left)].sum(), -b))]
        left.discard(group[0])
        while len(group) < 8:
            best = max(left, key=lambda b: (correlation[b, group].sum(), -b))
            group.append(best)
            left.discard(best)
        order += group
    return order


def _group_values(fp: np.ndarray, order: list[int]) -> np.ndarray:
    """The value of each UNIT bits of the order, one column a unit."""
    return np.packbits(_bits(fp)[:, order].reshape(len(fp), -1, UNIT), axis=2, bitorder="little")[:, :, 0]


def _histogram(order: list[int]):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((BITS // UNIT, 1 << UNIT), np.int64)
        for batch in batches:
            values = _group_values(batch.column(0).to_numpy(), order)
            for g in range(len(total)):
                total[g] += np.bincount(values[:, g], minlength=1 << UNIT)
        g, v = np.indices(total.shape)
        yield pa.RecordBatch.from_arrays([pa.array(g.ravel()), pa.array(v.ravel()), pa.array(total.ravel())], names=["i", "j", "n"])

    return count


def distances(histogram: np.ndarray) -> np.ndarray:
    """Per group of bits, the probability that two fingerprints differ in 0, 1 and so on of them."""
    values = histogram.shape[1]
    pop = np.array([bin(x).count("1") for x in range(values)])
    xor = np.bitwise_xor.outer(np.arange(values), np.arange(values))
    out = np.zeros((len(histogram), values.bit_length()))
    for g, h in enumerate(histogram / np.maximum(histogram.sum(1, keepdims=True), 1)):
        out[g] = np.bincount(pop[xor].ravel(), np.outer(h, h).ravel(), minlength=out.shape[1])
    return out


def allocate(chance: np.ndarray, n: int, limit: int = MAX_DISTANCE, families: int = 1) -> tuple[tuple[int, ...], tuple[int, ...], float]:
    """(groups a part, thresholds, cost): the cheapest layout and thresholds by dynamic programming.

    The n fingerprints are of so many families, and only those of one family meet.
    """
    best, bits = None, BITS // len(chance)
    for units in LAYOUTS:
        if any(u * UNIT % bits for u in units):
            continue
        layout = tuple(u * UNIT // bits for u in units)
        costs, at = [], 0
        for groups in layout:
            spread = np.ones(1)
            for g in range(at, at + groups):
                spread = np.convolve(spread, chance[g])
            at += groups
            width, cost = bits * groups, {-1: 0.0}
            for t in range(limit + 1):
                probes = 1 + sum(comb(width, k) for k in range(1, t + 1)) / 2
                cost[t] = n * probes + CANDIDATE_COST * n * n / 2 / families * spread[: t + 1].sum()
            costs.append(cost)
        want = limit - len(layout) + 1
        table = {0: (0.0, ())}  # sum of the thresholds so far -> cheapest
        for cost in costs:
            new: dict[int, tuple[float, tuple[int, ...]]] = {}
            for s, (c, chosen) in table.items():
                for t, extra in cost.items():
                    if s + t not in new or c + extra < new[s + t][0]:
                        new[s + t] = (c + extra, (*chosen, t))
            table = new
        if want in table and (best is None or table[want][0] < best[2]):
            best = (layout, table[want][1], table[want][0])
    return best


def _prober(order: list[int], layout: tuple[int, ...], thresholds: tuple[int, ...]):
    """Rows (key, fp, exact, other columns): a fingerprint's own bucket a part, and those within the threshold with a larger value.

    A column `family` keeps fingerprints of different kinds apart.
    """

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            others = [n for n in whole.schema.names if n != "fp"]
            for lo in range(0, whole.num_rows, 20_000):
                batch = whole.slice(lo, 20_000)
                fp = batch.column("fp").to_numpy()
                family = batch.column("family").to_numpy().astype(np.int64) << 48 if "family" in others else np.int64(0)
                values, at = _group_values(fp, order), 0
                for part, (groups, t) in enumerate(zip(layout, thresholds, strict=True)):
                    value = np.zeros(len(fp), np.int64)
                    for g in range(groups):
                        value |= values[:, at + g].astype(np.int64) << (UNIT * g)
                    at += groups
                    if t < 0:
                        continue
                    name, every = family | np.int64(part) << 40, np.arange(len(fp))
                    out = [(name | value, every, np.ones(len(fp), bool))]
                    for k in range(1, t + 1):
                        for bits in combinations(range(UNIT * groups), k):
                            other = value ^ sum(1 << b for b in bits)
                            up = np.flatnonzero(other > value)
                            out.append(((name | other)[up], up, np.zeros(len(up), bool)))
                    key, row, exact = (np.concatenate(c) for c in zip(*out, strict=True))
                    rows = pa.array(row)
                    yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(fp[row]), pa.array(exact), *(batch.column(n).take(rows) for n in others)], names=["key", "fp", "exact", *others])

    return probe


def near(a: np.ndarray, b: np.ndarray, limit: int) -> np.ndarray:
    return np.bitwise_count((a ^ b).view(np.uint64)) <= limit


def bucket_links(key: np.ndarray, fp: np.ndarray, exact: np.ndarray, limit: int) -> tuple[np.ndarray, np.ndarray]:
    """Links between the rows of equal key, sorted by key, of which one is exact: stars of their components."""
    us, vs = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    edges = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1], [True]])) if len(key) else np.zeros(1, np.int64)
    sizes = np.diff(edges)
    large = np.repeat(sizes > SHIFT_ROWS, sizes)
    k, f, e = key[~large], fp[~large], exact[~large]
    for s in range(1, int(sizes[sizes <= SHIFT_ROWS].max(initial=0))):
        pick = np.flatnonzero((k[s:] == k[:-s]) & (e[s:] | e[:-s]))
        pick = pick[near(f[pick], f[pick + s], limit)]
        us.append(f[pick])
        vs.append(f[pick + s])
    for i in np.flatnonzero(sizes > SHIFT_ROWS):
        f, e = fp[edges[i] : edges[i + 1]], exact[edges[i] : edges[i + 1]]
        own = f[e]
        for lo in range(0, len(f), 256):
            hit, to = np.nonzero(near(f[lo : lo + 256, None], own[None, :], limit))
            if len(hit):
                u, v = forest(f[lo : lo + 256][hit], own[to])
                us.append(u)
                vs.append(v)
    u, v = np.concatenate(us), np.concatenate(vs)
    differ = u != v
    return forest(u[differ], v[differ])


def whole_buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[list[np.ndarray]]:
    """The columns of sorted batches, regrouped so that rows of one bucket (the first column) stay together."""
    held: list[list[np.ndarray]] = []
    for batch in batches:
        columns = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
        if not len(columns[0]):
            continue
        last = int(np.searchsorted(columns[0], columns[0][-1]))
        if held and held[-1][0][-1] != columns[0][0]:
            yield [np.concatenate(c) for c in zip(*held, strict=True)]
            held = []
        if last:
            yield [np.concatenate(c) for c in zip(*held, [c[:last] for c in columns], strict=True)]
            held = []
        held.append([c[last:] for c in columns])
    if held:
        yield [np.concatenate(c) for c in zip(*held, strict=True)]


def _linker(limit: int):
    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for sub, fp, exact in whole_buckets(batches):
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in bucket_links(sub, fp, exact, limit)], names=["u", "v"])

    return link


def _table(df: DataFrame, shape: tuple[int, int]) -> np.ndarray:
    out = np.zeros(shape)
    for r in df.groupBy("i", "j").agg(F.sum("n").alias("n")).collect():
        out[r["i"], r["j"]] = r["n"]
    return out


def parts_of(fps: DataFrame, limit: int, families: int = 1) -> tuple[list[int], tuple[int, ...], tuple[int, ...]]:
    """(order of the bits, groups a part, thresholds) for the fingerprints `fp`."""
    pairs = _table(fps.select("fp").mapInArrow(_pair_counts, "i long, j long, n double"), (BITS, BITS))
    n = fps.count()
    order = order_bits(pairs, n)
    chance = distances(_table(fps.select("fp").mapInArrow(_histogram(order), "i long, j long, n long"), (BITS // UNIT, 1 << UNIT)))
    return order, *allocate(chance, n, limit, families)[:2]


def hot_buckets(fps: DataFrame, parts, hot_rows: int = HOT_ROWS) -> DataFrame:
    """hot (key), blocks of the buckets with more than `hot_rows` own fingerprints: a bucket's pairs have one that is its own."""
    order, layout, thresholds = parts
    own = fps.mapInArrow(_prober(order, layout, tuple(min(t, 0) for t in thresholds)), _probed(fps))
    hot = own.groupBy("key").count().filter(F.col("count") > hot_rows).select(F.col("key").alias("hot"), F.ceil(F.col("count") / hot_rows).cast("int").alias("blocks"))
    hot = common.materialize_narrow(hot, "hot")
    return F.broadcast(hot) if hot.count() <= BROADCAST_ROWS else hot


def _probed(fps: DataFrame) -> str:
    return ", ".join(["key long, fp long, exact boolean", *(f"{c} long" for c in fps.columns if c != "fp")])


def dealt(fps: DataFrame, parts, hot: DataFrame) -> DataFrame:
    """The rows of `fps` (fp and other columns of type long) in every bucket they probe: sub, fp, exact, the others.

    Two fingerprints of one family that differ in as many bits as `parts` were
    made for, or fewer, share a `sub` in which one of them is exact. The rows
    are dealt and sorted by sub; a hot bucket is cut into blocks, each pair of
    which is a sub of its own. `parts` and `hot` may come from a larger set of
    fingerprints: any allocation finds all pairs, only its cost is chosen.
    """
    others = [c for c in fps.columns if c != "fp"]
    rows = fps.mapInArrow(_prober(*parts), _probed(fps))
    wide = rows.join(hot, F.col("key") == F.col("hot"), "left")
    block = F.pmod(F.xxhash64("fp", *others), F.col("blocks")).cast("int")
    other = F.explode(F.when(F.col("blocks").isNull(), F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.col("blocks") - 1)))
    cut = wide.select("key", "hot", "fp", "exact", *others, F.coalesce(block, F.lit(0)).alias("b"), other.alias("o"))
    cut = cut.select(F.when(F.col("hot").isNull(), F.col("key")).otherwise(F.xxhash64("key", F.least("b", "o"), F.greatest("b", "o"))).alias("sub"), "fp", "exact", *others)
    return cut.repartition(common.partitions(fps.sparkSession), "sub").sortWithinPartitions("sub")


def links(fps: DataFrame, limit: int = MAX_DISTANCE, hot_rows: int = HOT_ROWS) -> DataFrame:
    """u, v: a link table with the same components as all pairs of distinct `fp` that differ in at most `limit` bits."""
    parts = parts_of(fps, limit)
    return dealt(fps, parts, hot_buckets(fps, parts, hot_rows)).mapInArrow(_linker(limit), "u long, v long")


def near_duplicates(docs: DataFrame, limit: int = MAX_DISTANCE, hot_rows: int = HOT_ROWS) -> DataFrame:
    """doc_id, fp, component_id per row of `docs`."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").cast("binary").alias("text"))
    marked = common.materialize(rows.mapInArrow(_fingerprints, "doc_id long, fp long"), "simhash")
    fps = common.materialize(marked.groupBy("fp").agg(F.min("doc_id").alias("least")), "fps")
    roots = components(links(fps.select("fp"), limit, hot_rows))
    named = fps.join(roots, F.col("fp") == F.col("node"), "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    smallest = named.groupBy("root").agg(F.min("least").alias("component_id"))
    by_fp = named.join(smallest, "root").select(F.col("fp").alias("of"), "component_id")
    return marked.join(by_fp, F.col("fp") == F.col("of")).select("doc_id", "fp", "component_id")


def one_of_each(docs: DataFrame, limit: int = MAX_DISTANCE) -> DataFrame:
    """One row of `docs` of each group, also among rows with equal or null doc_id."""
    rows, row = common.keyed(docs)
    named = near_duplicates(rows.select(F.col(row).alias("doc_id"), "text"), limit)
    return common.least_of_each(rows, row, named.select(F.col("doc_id").alias("row"), F.col("component_id").alias("root"))).select(*docs.columns)


def op2_simhash(spark, sf_dir) -> DataFrame:
    out = near_duplicates(common.documents(spark, sf_dir))
    return out.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
