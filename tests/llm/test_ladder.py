"""Certified cutoffs on small holdouts."""

import math

from plumbline.llm import common, quality

from tests.llm.test_scans import brute_counts


def table(spark, sizes, junk_every=10, harmful=()):
    """Good and junk texts a stratum; in a harmful one, good texts look like junk."""
    good, junk = " ".join(f"word{i}" for i in range(60)), " ".join(f"word{i}###$$$" for i in range(60))
    rows = [(f"{s}{i}", junk if i % junk_every == 0 or (s in harmful and i % 5 == 0) else good, s, int(i % junk_every > 0)) for s, n in sizes.items() for i in range(n)]
    df = spark.createDataFrame(rows, "doc_id string, text string, lang string, quality int")
    return df.drop("quality"), df.select("doc_id", "quality")


def test_a_stratum_of_500_good_rows_is_certified(spark):
    docs, labels = table(spark, {"en": 560, "fr": 560, "es": 100})
    out = quality.quality_verdicts(docs, labels).join(labels, "doc_id")
    assert out.filter("kept <> (quality = 1)").count() == 0  # es by the pooled cutoffs


def test_a_harmful_rule_is_not_certified(spark):
    docs, labels = table(spark, {"en": 2000, "fr": 2000}, harmful=("fr",))
    counts = common.materialize(quality.with_counts(docs), "q")
    cutoffs = quality.certified_cutoffs(counts, labels)
    assert cutoffs.of("fr") == {} and cutoffs.of("en")["symbol_ratio"] == 0.02


def test_ladder_holds_every_rule_from_loose_to_strict():
    bad = {r: [len(cuts) - i if r == "dup_line_ratio" else 0 for i in range(len(cuts))] for r, cuts in quality.RULES.items()}
    steps = quality.ladder(bad)
    assert all([c for x, c in steps if x == r] == sorted(cuts, reverse=True) for r, cuts in quality.RULES.items())
    assert [r for r, _ in steps[: len(quality.RULES["dup_line_ratio"])]] == ["dup_line_ratio"] * len(quality.RULES["dup_line_ratio"])


def test_labelled_junk_is_rejected(spark):
    sf = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{sf}/labels.parquet").select("doc_id", "quality")
    out = quality.quality_verdicts(common.documents(spark, sf), labels).filter("NOT base_failed").join(labels, "doc_id")
    n = {r.quality: r for r in out.groupBy("quality").agg({"*": "count", "kept": "max"}).collect()}
    kept = {r.quality: r["count"] for r in out.filter("kept").groupBy("quality").count().collect()}
    assert kept.get(0, 0) < n[0]["count(1)"] / 4 and kept[1] >= 0.98 * n[1]["count(1)"]


def test_large_strata_test_every_rule(spark):
    """Good texts with repeated lines stop the ladder; symbols must be cut all the same."""
    good = " ".join(f"word{i}" for i in range(60))
    lines = "\n".join([good, "a b", "a b", "a b"])
    rows = [(i, f"{good} {'#' * 30}" if i % 9 == 0 else lines if i % 9 < 3 else good, "en", int(i % 9 > 0)) for i in range(9000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, quality int")
    cutoffs = quality.certified_cutoffs(common.materialize(quality.with_counts(df.drop("quality")), "q"), df.select("doc_id", "quality"))
    assert cutoffs.of("en")["symbol_ratio"] == 0.02 and cutoffs.of("en")["mean_word_chars"] == 8.0


def test_repeated_rows_certify_nothing(spark):
    good, junk = " ".join(f"word{i}" for i in range(60)), " ".join(f"word{i}###$$$" for i in range(60))
    df = spark.createDataFrame([(1, good, "en")] * 3000 + [(2, junk, "en")] * 500, "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(1, 1), (2, 0)], "doc_id long, quality int")
    cutoffs = quality.certified_cutoffs(common.materialize(quality.with_counts(df), "q"), labels)
    assert cutoffs == ({}, {})


def plain_bound(k, n, delta):
    """The p at which k or fewer of n have probability delta, by bisection over the plain sum."""
    if n == 0 or k >= n:
        return 1.0
    low, high = 0.0, 1.0
    for _ in range(60):
        p = (low + high) / 2
        tail = sum(math.exp(math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * math.log(p) + (n - i) * math.log1p(-p)) for i in range(k + 1))
        low, high = (p, high) if tail > delta else (low, p)
    return high


def plain_kept(docs, labels):
    """doc_id -> kept, recomputed without Spark: brute counts, one holdout row a document, strata and ladders by hand."""
    label = {}
    for r in labels:
        label.setdefault(r.doc_id, set()).add(r.quality)
    label = {k: v.pop() for k, v in label.items() if len(v) == 1 and None not in v}
    values, failed = {}, {}
    for d in docs:
        n, chars, symbols, dup, repeat = brute_counts(d.text)
        lines = sum(bool(x.split()) for x in (d.text or "").split("\n"))
        values[d.doc_id] = {"symbol_ratio": symbols / max(chars, 1), "dup_line_ratio": dup / max(lines, 1), "repeat_ratio": repeat / max(n, 1), "mean_word_chars": chars / max(n, 1)}
        failed[d.doc_id] = n < 50 or 100 * repeat > 50 * n
    rules, confidence, risk = quality.RULES, 0.05, 0.01
    held = [d for d in docs if not failed[d.doc_id] and d.doc_id in label]
    bad = {r: [sum(values[d.doc_id][r] > c for d in held if label[d.doc_id] == 0) for c in cuts] for r, cuts in rules.items()}
    steps = []
    rest = {r: len(cuts) for r, cuts in rules.items()}
    for r in sorted(rules, key=lambda r: -bad[r][0]):
        if bad[r][0]:
            loosest = max(i for i, b in enumerate(bad[r]) if b == bad[r][0])
            steps += [(r, rules[r][i]) for i in range(len(rules[r]) - 1, loosest - 1, -1)]
            rest[r] = loosest
    for level in range(1, 20):
        steps += [(r, rules[r][rest[r] - level]) for r in rules if level <= rest[r]]
    good = {}
    for d in held:
        if label[d.doc_id] == 1:
            good.setdefault(d.lang, []).append(values[d.doc_id])
    strata = {d.lang for d in docs}
    tested = sorted((s for s in good), key=lambda s: -len(good[s]))
    share = lambda: confidence / max(1, len(tested) + (len(tested) < len(strata)))
    while tested and plain_bound(0, len(good[tested[-1]]), share()) > risk:
        tested.pop()
    delta = share()

    def climb(rows):
        out = {}
        for k, (r, c) in enumerate(steps):
            if plain_bound(sum(any(v[a] > b for a, b in steps[: k + 1]) for v in rows), len(rows), delta) > risk:
                break
            out[r] = c
        return out

    every = [v for rows in good.values() for v in rows]
    cutoffs = {s: climb(every) for s in strata - set(tested)}
    each = delta / sum(map(len, rules.values()))
    for s in tested:
        if plain_bound(0, len(good[s]), each) <= risk / len(rules):
            ok = {r: [c for c in cuts if plain_bound(sum(v[r] > c for v in good[s]), len(good[s]), each) <= risk / len(rules)] for r, cuts in rules.items()}
            cutoffs[s] = {r: min(c) for r, c in ok.items() if c}
        else:
            cutoffs[s] = climb(good[s])
    return {d.doc_id: not failed[d.doc_id] and all(values[d.doc_id][r] <= c for r, c in cutoffs[d.lang].items()) for d in docs}, cutoffs


def test_verdicts_against_a_plain_version(spark):
    sf = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{sf}/labels.parquet").select("doc_id", "quality")
    docs = common.documents(spark, sf).select("doc_id", "lang", "text")
    want, cutoffs = plain_kept(docs.collect(), labels.collect())
    assert {r.doc_id: r.kept for r in quality.quality_verdicts(docs, labels).collect()} == want
    assert any(cutoffs.values())
