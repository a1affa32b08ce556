"""The pipeline against a brute-force version of its stages."""

import hashlib
from collections import Counter

import corpus_pipeline
import numpy as np
import public_tokenizers
from plumbline.llm import bpe, common, mixture, quality, secrets

from tests.llm import fixtures
from tests.llm.test_scans import WORD, brute_counts
from tests.llm.test_shingles import brute_groups


def test_stage_contract(spark):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "near_duplicates", "secret_scan", "mixture", "bpe"]
    docs = fixtures.documents(spark)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        for df in (docs, docs.limit(0)):
            out = stage(spark, df, "/root/testdata/sf0.001")
            assert out.columns == df.columns and [t for _, t in out.dtypes] == [t for _, t in df.dtypes]
            if df is not docs:
                assert out.count() == 0
    assert corpus_pipeline.STAGES[-1][1](spark, docs.limit(0), "").count() == 0


def test_run(spark):
    import tiktoken

    sf = "/root/testdata/sf0.001"
    table = common.documents(spark, sf)
    labels = spark.read.parquet(f"{sf}/labels.parquet").select("doc_id", "quality")
    docs = [r.asDict() for r in table.collect()]
    # Quality: base rules, and the cutoffs that the labels certify (tested elsewhere).
    cutoffs = quality.certified_cutoffs(common.materialize(quality.with_counts(table.select("doc_id", "lang", "text")), "q"), labels)
    kept = []
    for d in docs:
        n, chars, symbols, dup, repeat = brute_counts(d["text"])
        if n < 50 or 100 * repeat > 50 * n:
            continue
        lines = sum(bool(x.split()) for x in d["text"].split("\n"))
        value = {"symbol_ratio": symbols / chars, "dup_line_ratio": dup / lines, "repeat_ratio": repeat / n, "mean_word_chars": chars / n}
        if all(value[r] <= c for r, c in cutoffs.of(d["lang"]).items()):
            kept.append(d)
    least = {}
    for d, g in zip(kept, groups := brute_groups([d["text"] for d in kept])):
        least[g] = min(least.get(g, d["doc_id"]), d["doc_id"])
    kept = [d for d, g in zip(kept, groups) if d["doc_id"] == least[g]]
    owners: dict = {}
    for d in kept:
        for s in secrets.token_candidates(d["text"], secrets.base_spans(d["text"])):
            owners.setdefault(s[3], set()).add(d["source"])
    for d in kept:
        base = secrets.base_spans(d["text"])
        spans = base + [s for s in secrets.token_candidates(d["text"], base) if len(owners[s[3]]) <= secrets.MAX_OWNERS]
        gone = set()
        for s, _, e, _ in spans:
            gone |= set(range(s, e))
        d["text"] = "".join("" if i in gone and i - 1 in gone else "[SECRET]" if i in gone else c for i, c in enumerate(d["text"]))
    # The mix: every document whole epochs of its source, some of them once more, and the words of each source meet its target.
    size, longest = Counter(), Counter()
    words = lambda d: len(WORD.findall(d["text"] or ""))
    for d in kept:
        size[d["source"]] += words(d)
        longest[d["source"]] = max(longest[d["source"]], words(d))
    names = sorted(size)
    goal = dict(zip(names, mixture.targets([size[k] for k in names], [(1, 2, 3)[i % 3] for i in range(len(names))])))
    tik = tiktoken.Encoding("t", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.load_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken")), special_tokens={})
    known = {}
    for d in kept:
        ids = tik.encode_ordinary(d["text"])
        known[d["doc_id"], len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(d["text"].encode()).hexdigest()] = d
    assert len(known) == len(kept) > 50
    got = Counter(tuple(r) for r in corpus_pipeline.run(spark, sf).collect())
    assert set(got) <= set(known)
    taken = Counter()
    for row, d in known.items():
        whole = min(round(goal[d["source"]]), 3 * size[d["source"]]) // size[d["source"]]
        assert got[row] in (whole, whole + 1)
        taken[d["source"]] += got[row] * words(d)
    assert all(abs(taken[k] - goal[k]) <= longest[k] / 2 + 1 for k in names)
