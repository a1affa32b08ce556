"""Operator 3: mixing sources to target weights.

Each source's documents, in a fixed order, form one stream of words, packed
into blocks of BLOCK words (the last may be shorter). Targets share the whole
size by weight, none above EPOCHS times its source. The mix is a list of slots,
dealt to output shards: for each shard a multinomial draw over what the sources
still have to give says how many of its slots go to each, and the last shard
takes the rest, so the totals are met. Slot j of a source is block perm_e(j mod
n) of epoch e = j div n, where perm_e is a keyed Feistel permutation of the n
block indices; slots and blocks are then joined by (source, index). A source's
last slot is cut to the words that its target still lacks.

So every whole epoch takes each block once, no document exceeds EPOCHS times
its size, and the same input and seed give the same mix. Stream offsets are a
prefix sum over two levels of hash buckets, so no source is sorted as a whole.

Defined cases: null text has size 0; a null source is a source of its own, the
last; documents without words and sources without words take nothing; repeated
rows are documents of their own; an empty table gives no rows; other columns
are ignored.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.llm import common

BLOCK = 64
WEIGHTS = (1, 2, 3)
EPOCHS = 3
#: Slots of an output shard at least, and the most shards that are drawn.
SHARD_SLOTS, MAX_SHARDS = 1 << 16, 4096
#: Slots that are laid out at a time.
STEP = 1 << 16
SEED = 17
FANOUT = 128
ROUNDS = 4


def targets(sizes: list[int], weights: list[float], epochs: int = EPOCHS) -> list[float]:
    """Shares of the total by weight, none above `epochs` times its size; what is over goes to the others by weight."""
    out, rest, free = [0.0] * len(sizes), float(sum(sizes)), list(range(len(sizes)))
    while free:
        scale = rest / sum(weights[i] for i in free)
        full = [i for i in free if weights[i] * scale > epochs * sizes[i]]
        if not full:
            for i in free:
                out[i] = weights[i] * scale
            break
        for i in full:
            out[i] = float(epochs * sizes[i])
            rest -= out[i]
        free = [i for i in free if i not in full]
    return out


def _bits(n: int) -> int:
    """Half the width of the Feistel network: 2 ** (2 * bits) is n at least."""
    return max(1, ((max(n, 2) - 1).bit_length() + 1) // 2)


def _mixed(value: int, key: int, mask: int) -> int:
    x = (value * 0x9E3779B1 + key) & 0x7FFFFFFF
    x ^= x >> 15
    x = (x * 0x2C1B3C6D) & 0x7FFFFFFF
    return (x ^ (x >> 13)) & mask


def round_keys(seed: int, source: int, epoch: int) -> list[int]:
    return [int(k) for k in np.random.default_rng([seed, source, epoch]).integers(0, 1 << 31, ROUNDS)]


def permute(j: int, n: int, keys: list[int]) -> int:
    """Place j of 0..n-1 under the permutation: Feistel rounds, walked until the value is below n."""
    half = _bits(n)
    mask = (1 << half) - 1
    while True:
        left, right = j >> half, j & mask
        for k in keys:
            left, right = right, left ^ _mixed(right, k, mask)
        j = left << half | right
        if j < n:
            return j


def unpermute(j: int, n: int, keys: list[int]) -> int:
    half = _bits(n)
    mask = (1 << half) - 1
    while True:
        left, right = j >> half, j & mask
        for k in reversed(keys):
            left, right = right ^ _mixed(left, k, mask), left
        j = left << half | right
        if j < n:
            return j


def _permute_array(j: np.ndarray, n: int, keys: list[int], back: bool = False) -> np.ndarray:
    """`permute` over an array."""
    half = _bits(n)
    mask = (1 << half) - 1

    def rounds(v):
        left, right = v >> half, v & mask
        left, right = (right, left) if back else (left, right)
        for k in reversed(keys) if back else keys:
            x = (right * 0x9E3779B1 + k) & 0x7FFFFFFF
            x ^= x >> 15
            x = (x * 0x2C1B3C6D) & 0x7FFFFFFF
            left, right = right, left ^ ((x ^ (x >> 13)) & mask)
        left, right = (right, left) if back else (left, right)
        return left << half | right

    out = rounds(j.astype(np.int64))
    while (bad := out >= n).any():
        out[bad] = rounds(out[bad])
    return out


def _unpermute_array(j: np.ndarray, n: int, keys: list[int]) -> np.ndarray:
    """`unpermute` over an array."""
    return _permute_array(j, n, keys, back=True)


def slots_for(words: int, size: int, n: int, last: int, block: int, seed: int, source: int) -> tuple[int, int]:
    """(slots, words of the last slot) that take exactly `words` words of a source.

    A whole epoch is n slots and `size` words. Within an epoch every slot has
    `block` words but the one that permutes to the short last block.
    """
    epochs, rest = divmod(words, size)
    if not rest:
        return epochs * n, (block if n > 1 or last == block else last) if words else 0
    short = unpermute(n - 1, n, round_keys(seed, source, epochs))
    before = short * block
    if rest <= before:
        k = -(-rest // block)
        return epochs * n + k, rest - (k - 1) * block
    if rest <= before + last:
        return epochs * n + short + 1, rest - before
    k = short + 1 + -(-(rest - before - last) // block)
    return epochs * n + k, rest - before - last - (k - short - 2) * block


def draw_shards(slots: list[int], shard_slots: int, seed: int) -> list[list[int]]:
    """Slots of each source in each shard: multinomial by what is left, the last shard takes the rest."""
    left = np.array(slots, np.int64)
    rng, out = np.random.default_rng([seed, 1]), []
    while (total := int(left.sum())) > 0:
        if total <= shard_slots:
            take = left.copy()
        else:
            take = np.minimum(rng.multinomial(shard_slots, left / total), left)
        out.append([int(x) for x in take])
        left -= take
    return out


def source_key(source: Column) -> Column:
    """A string that is never null and sorts as the source does, null last."""
    return F.coalesce(F.concat(F.lit("0"), source), F.lit("1"))


def word_count() -> Column:
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return F.size(F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")).cast("long")


def packed(docs: DataFrame, source: str = "source", *more: str) -> DataFrame:
    """doc_id, skey, size, start and the columns `more`: every document's place in its source's stream of words."""
    rows = docs.select(*more, F.col("doc_id").cast("long").alias("doc_id"), source_key(common.column_or_null(docs, source, "string")).alias("skey"), word_count().alias("size"))
    mark = F.xxhash64("doc_id", "size")
    sized = common.materialize(rows.withColumn("b1", F.pmod(mark, F.lit(FANOUT)).cast("int")).withColumn("b2", F.pmod(F.shiftright(mark, 20), F.lit(FANOUT)).cast("int")), "mixture")
    before = lambda keys, order: Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    inner = sized.groupBy("skey", "b1", "b2").agg(F.sum("size").alias("s"))
    outer = inner.groupBy("skey", "b1").agg(F.sum("s").alias("s"))
    outer = outer.select("skey", "b1", F.coalesce(F.sum("s").over(before(["skey"], ["b1"])), F.lit(0)).alias("o1"))
    inner = inner.select("skey", "b1", "b2", F.coalesce(F.sum("s").over(before(["skey", "b1"], ["b2"])), F.lit(0)).alias("o2"))
    base = inner.join(outer, ["skey", "b1"]).select("skey", "b1", "b2", (F.col("o1") + F.col("o2")).alias("base"))
    own = sized.withColumn("o3", F.coalesce(F.sum("size").over(before(["skey", "b1", "b2"], ["doc_id", "size", *more])), F.lit(0)))
    return own.join(base, ["skey", "b1", "b2"]).select(*more, "doc_id", "skey", "size", (F.col("base") + F.col("o3")).alias("start"))


def plan(sizes: dict[str, int], block: int, weights=WEIGHTS, epochs: int = EPOCHS, seed: int = SEED, shard_slots: int = SHARD_SLOTS) -> dict:
    """The targets, and per source the number, the blocks, the slots and the cut of its last slot; the shards' draws."""
    keys = sorted(sizes)
    goal = targets([sizes[k] for k in keys], [weights[i % len(weights)] for i in range(len(keys))], epochs)
    sources = []
    for i, k in enumerate(keys):
        n = -(-sizes[k] // block)
        words = min(round(goal[i]), epochs * sizes[k])
        slots, cut = slots_for(words, sizes[k], n, sizes[k] - (n - 1) * block, block, seed, i) if n and words else (0, 0)
        sources.append({"skey": k, "source_no": i, "size": sizes[k], "target": goal[i], "blocks": n, "slots": slots, "cut": cut})
    return {"sources": sources, "shards": draw_shards([s["slots"] for s in sources], max(shard_slots, -(-sum(s["slots"] for s in sources) // MAX_SHARDS)), seed)}


def _slot_batches(sources: list[dict], seed: int):
    import pyarrow as pa

    def make(batches):
        for batch in batches:
            for row in batch.to_pylist():
                s = sources[row["source_no"]]
                j = np.arange(row["first"], row["first"] + row["n"], dtype=np.int64)
                block = np.empty(len(j), np.int64)
                for epoch in np.unique(j // max(s["blocks"], 1)).tolist():
                    at = j // s["blocks"] == epoch
                    block[at] = _permute_array(j[at] % s["blocks"], s["blocks"], round_keys(seed, s["source_no"], epoch))
                words = np.where(j == s["slots"] - 1, s["cut"], 1 << 40)
                yield pa.RecordBatch.from_arrays([pa.array([row["shard"]] * len(j), pa.int64()), pa.array(j), pa.array([s["skey"]] * len(j), pa.string()), pa.array(block), pa.array(words)], names=["shard", "slot", "skey", "block", "limit"])

    return make


def mix_slots(spark, plan_: dict, seed: int = SEED) -> DataFrame:
    """shard, slot, skey, block, limit (words the slot takes at most): the mix, in any order."""
    rows, done = [], [0] * len(plan_["sources"])
    for shard, draws in enumerate(plan_["shards"]):
        for i, n in enumerate(draws):
            if n:
                rows.append((shard, i, done[i], n))
                done[i] += n
    df = spark.createDataFrame(rows, "shard long, source_no int, first long, n long").withColumn("step", F.explode(F.expr(f"sequence(0L, n - 1, {STEP}L)")))
    df = df.select("shard", "source_no", (F.col("first") + F.col("step")).alias("first"), F.least(F.col("n") - F.col("step"), F.lit(STEP)).alias("n")).repartition(common.partitions(spark), "shard", "source_no", "first")
    return df.mapInArrow(_slot_batches(plan_["sources"], seed), "shard long, slot long, skey string, block long, limit long")


def doc_pieces(streams: DataFrame, block: int) -> DataFrame:
    """One row per document and block that it has words in: begin and end are places in the block."""
    last = F.floor((F.col("start") + F.col("size") - 1) / block)
    each = streams.filter("size > 0").withColumn("block", F.explode(F.sequence(F.floor(F.col("start") / block), last)))
    at = F.col("block") * block
    return each.select("doc_id", "skey", "start", "size", "block", F.greatest(F.col("start") - at, F.lit(0)).alias("begin"), F.least(F.col("start") + F.col("size") - at, F.lit(block)).alias("finish"))


def mixture(docs: DataFrame, source: str = "source", block: int = BLOCK, weights=WEIGHTS, epochs: int = EPOCHS, seed: int = SEED, shard_slots: int = SHARD_SLOTS) -> DataFrame:
    """doc_id, skey, size, source_size, target, taken per row of `docs`. One row a source goes to the driver."""
    spark = docs.sparkSession
    streams = common.materialize(packed(docs, source), "streams")
    sizes = {r["skey"]: r["size"] for r in streams.groupBy("skey").agg(F.sum("size").alias("size")).collect()}
    chosen = plan(sizes, block, weights, epochs, seed, shard_slots)
    # How often a block is taken, and the shorter limits of its cut slots; the slots of a block are EPOCHS at most.
    times = mix_slots(spark, chosen, seed).groupBy("skey", "block").agg(F.collect_list("limit").alias("limits"))
    pieces = doc_pieces(streams, block).join(times, ["skey", "block"])
    word = lambda limit: F.greatest(F.least(F.col("finish"), limit) - F.col("begin"), F.lit(0))
    words = F.aggregate("limits", F.lit(0).cast("long"), lambda acc, x: acc + word(x))
    taken = pieces.withColumn("words", words).groupBy("skey", "start", "size").agg(F.sum("words").alias("taken"))
    table = spark.createDataFrame([(s["skey"], s["size"], s["target"]) for s in chosen["sources"]], "skey string, source_size long, target double")
    joined = streams.join(taken, ["skey", "start", "size"], "left").withColumn("taken", F.coalesce("taken", F.lit(0)).cast("long"))
    return joined.join(table, "skey").select("doc_id", "skey", "size", "source_size", "target", "taken")


def _last_slots(sources: list[dict], seed: int):
    """block and slot of documents: the block that holds a document's middle word, and that block's slot in the source's last epoch."""
    import pyarrow as pa

    by_key = {s["skey"]: s for s in sources}

    def place(batches):
        for batch in batches:
            keys = np.array(batch.column("skey").to_pylist(), object)
            block = (batch.column("start").to_numpy() + batch.column("size").to_numpy() // 2) // sources[0]["block"]
            slot = np.zeros(len(block), np.int64)
            for k in set(keys):
                s, at = by_key[k], keys == k
                slot[at] = _unpermute_array(block[at], s["blocks"], round_keys(seed, s["source_no"], s["whole"]))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(block), pa.array(slot)], names=[*batch.schema.names, "block", "slot"])

    return place


def _words_before(places: DataFrame, row: str) -> DataFrame:
    """Adds `before`: the words of a source's documents that come earlier by (slot, start), summed over two levels of ranges of slots."""
    before = lambda keys, order: Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    fine = F.floor(F.col("slot") * (FANOUT * FANOUT) / F.col("blocks"))
    ranged = places.withColumn("b1", F.floor(fine / FANOUT).cast("int")).withColumn("b2", (fine % FANOUT).cast("int"))
    inner = ranged.groupBy("skey", "b1", "b2").agg(F.sum("size").alias("s"))
    outer = inner.groupBy("skey", "b1").agg(F.sum("s").alias("s")).select("skey", "b1", F.coalesce(F.sum("s").over(before(["skey"], ["b1"])), F.lit(0)).alias("o1"))
    base = inner.select("skey", "b1", "b2", F.coalesce(F.sum("s").over(before(["skey", "b1"], ["b2"])), F.lit(0)).alias("o2")).join(outer, ["skey", "b1"])
    own = ranged.withColumn("o3", F.coalesce(F.sum("size").over(before(["skey", "b1", "b2"], ["slot", "start", row])), F.lit(0)))
    return own.join(base, ["skey", "b1", "b2"]).withColumn("before", F.col("o1") + F.col("o2") + F.col("o3")).drop("b1", "b2", "o1", "o2", "o3")


def document_slots(rows: DataFrame, row: str, source: str = "source", block: int = BLOCK, weights=WEIGHTS, epochs: int = EPOCHS, seed: int = SEED, shard_slots: int | None = None) -> tuple[DataFrame, dict]:
    """(shard, slot and the key `row` of every copy that the mix takes, its plan): whole documents by the operator's slots.

    A document goes with the block that holds its middle word, once for each slot
    of that block. Of the last epoch, documents are taken in the order of their
    slots until the words meet the target, which also ends the source's slots.
    """
    spark = rows.sparkSession
    streams = common.materialize(packed(rows, source, row), "streams")
    sizes = {r["skey"]: r["size"] for r in streams.groupBy("skey").agg(F.sum("size").alias("size")).collect()}
    keys = sorted(sizes)
    goal = targets([sizes[k] for k in keys], [weights[i % len(weights)] for i in range(len(keys))], epochs)
    sources = []
    for i, k in enumerate(keys):
        whole, rest = divmod(min(round(goal[i]), epochs * sizes[k]), max(sizes[k], 1))
        sources.append({"skey": k, "source_no": i, "block": block, "size": sizes[k], "target": goal[i], "blocks": -(-sizes[k] // block), "whole": whole, "rest": rest, "cut": block})
    table = spark.createDataFrame([(s["skey"], s["blocks"], s["whole"], s["rest"]) for s in sources], "skey string, blocks long, whole long, rest long")
    sized = streams.filter("size > 0").select("skey", "size", "start", row)
    placed = sized.mapInArrow(_last_slots(sources, seed), f"skey string, size long, start long, `{row}` long, block long, slot long").join(F.broadcast(table), "skey")
    taken = 2 * F.col("before") + F.col("size") <= 2 * F.col("rest")
    ordered = common.materialize(_words_before(placed, row).select(row, "skey", "block", (F.col("whole") * F.col("blocks")).alias("full"), "slot", taken.alias("again")), "places")
    ends = {r["skey"]: r["slot"] + 1 for r in ordered.filter("again").groupBy("skey").agg(F.max("slot").alias("slot")).collect()}
    for s in sources:
        s["slots"] = s["whole"] * s["blocks"] + ends.get(s["skey"], 0)
    total = sum(s["slots"] for s in sources)
    least = shard_slots or min(SHARD_SLOTS, -(-total // common.partitions(spark)))
    chosen = {"sources": sources, "shards": draw_shards([s["slots"] for s in sources], max(least, -(-total // MAX_SHARDS), 1), seed)}
    slots = mix_slots(spark, chosen, seed).select("shard", F.col("slot").alias("at"), "skey", "block")
    # Spark takes the slots for as small as the table they are made from, and would broadcast them.
    copies = ordered.drop("slot").join(slots.hint("merge"), ["skey", "block"]).filter((F.col("at") < F.col("full")) | F.col("again"))
    return copies.select("shard", F.col("at").alias("slot"), row), chosen


def taken_documents(docs: DataFrame, source: str = "source", weights=WEIGHTS, epochs: int = EPOCHS) -> DataFrame:
    """`docs` mixed in whole documents to the same targets by the slots of `document_slots`, dealt by output shard.

    A source's words miss its target by half a document at most.
    """
    chunks = common.Chunks(docs)
    rows, row = chunks.rows("doc_id", source, "text"), chunks.row
    shard, slot, again = common.free_names(docs, 4)[1:]
    copies, _ = document_slots(rows, row, source, weights=weights, epochs=epochs)
    mixed = chunks.take(copies.select(row, F.col("shard").alias(shard), F.col("slot").alias(slot), F.col(row).alias(again)))
    return mixed.repartition(common.partitions(docs.sparkSession), shard).sortWithinPartitions(shard, slot, again).select(*docs.columns)


def op3_mixture(spark, sf_dir) -> DataFrame:
    return mixture(common.documents(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken")
