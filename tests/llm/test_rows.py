"""Near-duplicate groups of rows with repeated or null doc_id."""

import random
from collections import Counter

import corpus_pipeline
import pytest
from plumbline.llm import common, mixture, secrets, shingles, simhash
from pyspark.sql import functions as F

from tests.llm import fixtures


@pytest.mark.parametrize("one_of_each", [simhash.one_of_each, shingles.one_of_each])
def test_rows_not_ids_are_kept(spark, one_of_each):
    rng = random.Random(9)
    a, b, c, d = (" ".join(f"w{rng.randrange(9999)}" for _ in range(80)) for _ in range(4))
    rows = [(1, a), (1, b), (2, a), (None, c), (None, c), (None, b), (3, d), (3, d)]
    got = one_of_each(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    assert sorted((tuple(r) for r in got), key=repr) == sorted([(1, a), (1, b), (None, c), (3, d)], key=repr)


CLASHES = ["_words", "_copy", "_size", "_copies", "_doc", "_keys", "_row", "row", "root", "skey", "size", "start", "PLUMBLINE_0", "plumbline_1", "label", "value", "found"]


def test_columns_of_any_name_are_kept(spark):
    docs = fixtures.documents(spark).select("doc_id", "text", "lang", "source", "n_chars")
    wide = docs.select("*", *[F.concat(F.lit(c), F.coalesce(F.col("doc_id"), F.lit(0))).alias(c) for c in CLASHES])
    stages = [(n, lambda df, s=s: s(spark, df, "/root/testdata/sf0.001")) for n, s in corpus_pipeline.STAGES[:-1]]
    for name, stage in [*stages, ("one_of_each", simhash.one_of_each), ("mask", secrets.mask_secrets), ("mix", mixture.taken_documents)]:
        out = stage(wide)
        assert out.columns == wide.columns, name
        assert all(r[c] == f"{c}{r.doc_id or 0}" for r in out.collect() for c in CLASHES), name
        assert fixtures.rows(out.select(docs.columns)) == fixtures.rows(stage(docs)), name


def test_chunks_give_every_row_by_its_key(spark):
    texts = [None, "", "a b", "x" * 50_000, *(f"row {i} " * (i % 40) for i in range(900))]
    docs = spark.createDataFrame([(i % 7 or None, t, [i]) for i, t in enumerate(texts)], "doc_id long, text string, `a, b` array<int>").repartition(3)
    chunks = common.Chunks(docs)
    rows = {r[-1]: tuple(r)[:-1] for r in chunks.rows("doc_id", "text", "a, b").collect()}
    assert Counter(map(str, rows.values())) == Counter(str(tuple(r)) for r in docs.collect())
    keys = [k for k in rows if k % 3] * 2
    wanted = spark.createDataFrame([(k, n) for n, k in enumerate(keys)], "k long, n long")
    assert {r[-1]: tuple(r)[:-1] for r in chunks.take(wanted).collect()} == {n: rows[k] for n, k in enumerate(keys)}
    assert common.Chunks(docs.limit(0)).rows("text").count() == 0


def test_texts_are_moved_only_to_their_output_shards(spark):
    """Exchanges of texts in the stages' plans, when nothing is small enough to be broadcast by size."""
    docs = fixtures.documents(spark)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for stage, most in ((shingles.one_of_each, 0), (secrets.mask_secrets, 0), (mixture.taken_documents, 1)):
            out = stage(docs)
            moved, todo = 0, [out._jdf.queryExecution().executedPlan()]
            while todo:
                node = todo.pop()
                if node.nodeName() == "AdaptiveSparkPlan":
                    todo.append(node.inputPlan())
                    continue
                moved += node.nodeName() == "Exchange" and any(node.output().apply(i).name() == "text" for i in range(node.output().size()))
                todo += [node.children().apply(i) for i in range(node.children().size())]
            assert moved == most, stage
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
