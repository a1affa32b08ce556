"""Operator 5: n-grams against a plain version, held-out accuracy, awkward rows."""

import random
import zlib

import numpy as np
import pyarrow as pa
from plumbline.llm import toxicity

from tests.llm import fixtures

BAD = ("idiot", "moron", "scum")


def test_word_grams():
    words = ["", "a", "ab", "naïve", "idiot", "\U0001f600x"]
    grams, counts = toxicity.word_grams(words)
    assert counts.tolist() == [sum(max(0, len(w) + 2 - n + 1) for n in toxicity.SIZES) + 1 for w in words]
    again, _ = toxicity.word_grams(["idiot"])
    at = counts[:4].sum()
    assert sorted(grams[at : at + counts[4]]) == sorted(again)  # a word's n-grams do not depend on its neighbours
    near = set(toxicity.word_grams(["idiots"])[0]) & set(again)
    assert len(near) >= 8
    assert len(toxicity.word_grams([])[0]) == 0


def plain_grams(word):
    """The buckets of a word's n-grams and of the word itself, character by character."""
    mask, chars = 2**64 - 1, [ord(c) for c in f"<{word}>"]

    def bucket(h):
        h = (h ^ h >> 33) * 0xFF51AFD7ED558CCD & mask
        return (h ^ h >> 29) % toxicity.BUCKETS

    out = []
    for n in toxicity.SIZES:
        for i in range(len(chars) - n + 1):
            h = 0
            for c in chars[i : i + n]:
                h = (h * 0x100000001B3 + c) & mask
            out.append(bucket((h + n) & mask))
    return [*out, bucket((sum(c * int(float(pow(0x100000001B3, k, 2**64))) for k, c in enumerate(chars)) + 99) & mask)]


def plain_words(text):
    return [w.strip(".,;:!?\"'()[]{}#$%&*|<>") for w in text.lower().split()]


def test_grams_and_scores_against_a_plain_version():
    rng, words = random.Random(2), ["", "a", "idiot", "naïve", "\U0001f600x"]
    grams, counts = toxicity.word_grams(words)
    ends = np.cumsum(counts)
    assert [sorted(grams[e - n : e]) for e, n in zip(ends, counts)] == [sorted(plain_grams(w)) for w in words]
    weights = np.random.default_rng(3).normal(0, 3, toxicity.BUCKETS).astype(np.float32)
    texts = ["", "  ", "one", "Idiot! you (idiot), naïve."] + [text(rng, i % 2) for i in range(20)]
    want = []
    for t in texts:
        means = [np.mean([float(weights[g]) for g in plain_grams(w)]) for w in plain_words(t)]
        want.append(1 / (1 + np.exp(-np.clip(0.3 + (np.mean(means) if means else 0.0), -60, 60))))
    assert np.allclose(toxicity.score_texts(pa.array(texts), weights, 0.3), want, atol=1e-9)


def plain_train(texts, labels, seed=7):
    """Dense matrices: the share of each word in a text, of each n-gram in a word; full-batch Adam on embeddings and softmax."""
    lists = [plain_words(t) for t in texts]
    words = list(dict.fromkeys(w for x in lists for w in x))
    often = [w for w in words if sum(w in x for x in lists) >= toxicity.MIN_TEXTS]
    share = np.array([[x.count(w) / len(x) for w in often] for x in lists]) * toxicity.SCALE
    grams = [plain_grams(w) for w in often]
    texts_of = [sum(w in x for x in lists) for w in often]
    pairs = {}
    for g, n in zip(grams, texts_of):
        for b in g:
            pairs[b] = pairs.get(b, 0) + n
    present = sorted(b for b, n in pairs.items() if n >= min(toxicity.MIN_PAIRS, len(texts) // 10))
    bag = np.array([[g.count(b) / len(g) for b in present] for g in grams])
    x, target = share @ bag, np.eye(2)[labels]
    rng = np.random.default_rng(seed)
    params = [rng.normal(0, 0.1, (len(present), toxicity.DIM)), rng.normal(0, 0.5, (toxicity.DIM, 2)), np.zeros(2)]
    first, second = [0 * p for p in params], [0 * p for p in params]
    for step in range(1, toxicity.STEPS + 1):
        e, s, b = params
        p = np.exp(x @ e @ s + b)
        delta = (p / p.sum(1, keepdims=True) - target) / len(texts)
        for i, g in enumerate((x.T @ delta @ s.T + toxicity.DECAY / len(present) * e, (x @ e).T @ delta + toxicity.DECAY * s, delta.sum(0))):
            first[i], second[i] = 0.9 * first[i] + 0.1 * g, 0.99 * second[i] + 0.01 * g * g
            rate = toxicity.RATE * min(1.0, 2 * (1 - step / (toxicity.STEPS + 1)))
            params[i] = params[i] - rate * (first[i] / (1 - 0.9**step)) / (np.sqrt(second[i] / (1 - 0.99**step)) + 1e-12)
    e, s, b = params
    weights = np.zeros(toxicity.BUCKETS)
    weights[present] = toxicity.SCALE * (e @ (s[:, 1] - s[:, 0]))
    return weights, b[1] - b[0]


def test_training_against_a_plain_version():
    rng = random.Random(4)
    pool = ["".join(rng.choice("aeiournst") for _ in range(rng.randrange(2, 6))) for _ in range(25)]
    labels = [i % 3 == 0 for i in range(60)]
    texts = [" ".join([rng.choice(pool) for _ in range(20)] + ([rng.choice(BAD)] * 2 if t else [])) for t in labels]
    got, bias = toxicity.train(pa.array(texts), np.array(labels, np.int64))
    want, plain_bias = plain_train(texts, np.array(labels, np.int64))
    assert np.allclose(got, want, rtol=1e-3, atol=1e-2) and abs(bias - plain_bias) < 1e-3 and np.abs(want).max() > 1


def test_the_sample_is_bounded_and_repeats_count_once(spark):
    rows = [(i % 300, f"text number {i % 300}") for i in range(900)]
    docs, labels = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(i, i % 2) for i in range(300)], "doc_id long, toxic int")
    once = docs.distinct()
    assert toxicity.fit(docs, labels) == toxicity.fit(once, labels)
    assert toxicity.fit(docs, labels, 40) == toxicity.fit(once.repartition(3), labels, 40) != toxicity.fit(docs, labels)


def text(rng, toxic):
    words = ["".join(rng.choice("aeiournst") for _ in range(rng.randrange(2, 9))) for _ in range(rng.randrange(30, 200))]
    if toxic:
        for _ in range(max(2, len(words) // 40)):
            bad = rng.choice(BAD)
            i = rng.randrange(len(bad))
            words[rng.randrange(len(words))] = bad if rng.random() < 0.5 else bad[: i + 1] + bad[i:]
    return " ".join(words)


def test_held_out_accuracy(spark):
    rng = random.Random(11)
    rows = [(i, text(rng, i % 5 == 0), "s", 9.0, 1) for i in range(4000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, score double, predicted int")
    labels = spark.createDataFrame([(i, int(i % 5 == 0)) for i in range(4000)], "doc_id long, toxic int")
    got = toxicity.toxicity_scores(docs, labels).collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got)
    held = [r for r in got if r.held_out]
    true = sum(r.predicted == (r.doc_id % 5 == 0) for r in held)
    assert len(held) > 900 and true / len(held) > 0.9
    bad, good = ([r.score for r in held if (r.doc_id % 5 == 0) == b] for b in (True, False))
    assert np.mean([x > y for x in bad for y in good]) > 0.98
    assert all((r.score >= 0.3) == (r.predicted == 1) and 0 <= r.score <= 1 for r in got)


def test_equal_texts_score_alike_and_labels_matter_only_in_training(spark):
    docs = fixtures.documents(spark)
    labels = spark.createDataFrame([(1, 1), (5, 0), (5, 1), (8, 0), (9, 0), (None, 1), (17, None)], "doc_id long, toxic int")
    got = toxicity.toxicity_scores(docs, labels).collect()
    assert len(got) == 21 and all(0 <= r.score <= 1 for r in got)
    assert len({r.score for r in got if r.doc_id in (2, 3, 4)}) == 1 and len({r.score for r in got if r.doc_id in (5, 6)}) == 1
    assert toxicity.toxicity_scores(fixtures.empty(spark), labels).count() == 0
    none = toxicity.toxicity_scores(docs, labels.limit(0)).collect()
    assert {r.score for r in none} == {0.5}


def test_one_class_gives_its_rate():
    weights, bias = toxicity.train(pa.array(["a b", "c"]), np.array([0, 0]))
    assert not weights.any() and abs(1 / (1 + np.exp(-bias)) - 0.25) < 1e-9
