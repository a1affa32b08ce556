"""The pipeline's mix of whole documents: words a source after the stage."""

import re
from collections import Counter

import corpus_pipeline
import pytest
from plumbline.llm import common, mixture

from tests.llm import fixtures

WORD = re.compile("[^\x20\x09-\x0d]+")


@pytest.mark.parametrize("sf", ["0.001", "0.01", None])
def test_words_of_each_source_meet_the_target(spark, sf):
    df = common.documents(spark, f"/root/testdata/sf{sf}") if sf else fixtures.documents(spark)
    key = lambda r: (r.source is None, r.source or "")
    size, longest, got, copies = Counter(), Counter(), Counter(), Counter()
    for r in df.collect():
        n = len(WORD.findall(r.text or ""))
        size[key(r)] += n
        longest[key(r)] = max(longest[key(r)], n)
    for r in corpus_pipeline.mix_sources(spark, df, "").collect():
        got[key(r)] += len(WORD.findall(r.text))
        copies[r.doc_id, r.text, key(r)] += 1
    names = sorted(size)
    goal = mixture.targets([size[k] for k in names], [(1, 2, 3)[i % 3] for i in range(len(names))])
    assert all(abs(got[k] - t) <= longest[k] / 2 + 1 for k, t in zip(names, goal))
    whole = Counter((r.doc_id, r.text, key(r)) for r in df.collect())
    assert all(n <= 3 * whole[k] for k, n in copies.items())
