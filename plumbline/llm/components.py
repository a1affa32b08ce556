"""Connected components of a link table by alternating large-star and small-star steps.

All steps are joins and partial minima over the links; nothing goes to the
driver but a count and a checksum a round. Links of a component shrink to a
star around its smallest node in a logarithmic number of rounds. A table of
few links is read by one task instead: its rounds would be nothing but tasks and files.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm import common

#: So many distinct links at most are joined by one task, 16 bytes each.
FEW_LINKS = 1 << 18


def forest(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The same components as the links u, v, as (node, smallest node reached)."""
    nodes, ends = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = ends[: len(u)], ends[len(u) :]
    label = np.arange(len(nodes))
    while True:
        old = label.copy()
        least = np.minimum(label[a], label[b])
        np.minimum.at(label, label[a], least)
        np.minimum.at(label, label[b], least)
        while (label[label] != label).any():
            label = label[label]
        if (label == old).all():
            break
    other = label != np.arange(len(nodes))
    return nodes[other], nodes[label[other]]


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    links = [[c.to_numpy() for c in batch.columns] for batch in batches]
    u, v = (np.concatenate(c) for c in zip([np.zeros(0, np.int64)] * 2, *links, strict=True))
    yield pa.RecordBatch.from_arrays([pa.array(x) for x in forest(u, v)], names=["node", "root"])


def _large_star(links: DataFrame) -> DataFrame:
    both = links.select("u", "v").unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("n"), F.least("u", "m").alias("m"))
    return both.filter(F.col("v") > F.col("u")).join(least, F.col("u") == F.col("n")).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(links: DataFrame) -> DataFrame:
    least = links.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("n"), "m")
    pairs = links.join(least, F.col("u") == F.col("n"))
    return pairs.filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select(F.col("n").alias("u"), F.col("m").alias("v"))).distinct()


def components(links: DataFrame, few: int = FEW_LINKS, written: bool = False) -> DataFrame:
    """node, root: every node of `links` (columns u, v, long) but the roots, with its component's smallest node.

    Links that are `written` are not written once more where they are few.
    """
    spark = links.sparkSession
    joined = lambda rows: common.materialize(rows.select("u", "v").coalesce(1).mapInArrow(_forest, "node long, root long"), "links")
    if written and links.count() <= few:
        return joined(links)
    now = common.materialize(links.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "links")
    if now.count() <= few:
        return joined(now)
    state = None
    while True:
        before, now = now, common.materialize(_small_star(_large_star(now)), "links")
        common.drop(spark, before)
        seen = tuple(now.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first())
        if seen == state or not seen[0]:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
        state = seen
