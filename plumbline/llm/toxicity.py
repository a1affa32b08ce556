"""Operator 5: toxicity by subword-bag embeddings and a linear softmax.

A word's vector is the mean of the embeddings of its hashed character n-grams
(word ends marked, the whole word included), a text's vector the mean over its
words, and a linear softmax gives the two classes. Embeddings and softmax are
trained jointly (full-batch Adam, numpy) in one task on a bounded sample of
labelled rows; SAMPLE_ROWS is that bound. As everything up to the softmax is
linear, scoring needs one number per n-gram bucket: every text is scored whole,
and unseen spellings share the n-grams of seen ones.

Inputs of a score are the text alone. Labels are learnt only from rows whose
crc32(doc_id) mod 4 is not 2. Defined cases: null text counts as empty, and an
empty text scores the bias; a null doc_id is not held out; rows with
contradictory or null labels are not learnt from; without labels of both
classes the score is the smoothed rate of label 1; an empty table gives no
rows; repeated rows are scored row by row; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm import common, units

#: The most labelled rows to learn from, chosen by a hash of doc_id.
SAMPLE_ROWS = 8_000
BUCKETS = 1 << 16
DIM = 4
SIZES = (3, 4, 5)
STEPS, RATE, DECAY = 80, 0.1, 1e-2
#: The mean word vector is multiplied by this, so that one word in a hundred can decide.
SCALE = 100.0
#: Words in fewer training texts, and n-grams in fewer pairs of text and word, aren't learnt from.
MIN_TEXTS, MIN_PAIRS = 2, 20
THRESHOLD = 0.3
CHUNK_BYTES = 8 << 20


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    return h ^ (h >> np.uint64(29))


def word_grams(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(n-gram buckets of all words one after another, how many each word has)."""
    marked = [f"<{w}>" for w in words]
    lengths = np.fromiter(map(len, marked), np.int64, len(marked))
    if not len(marked):
        return np.zeros(0, np.int64), lengths
    chars = np.frombuffer("".join(marked).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    owner = np.repeat(np.arange(len(marked)), lengths)
    left = np.repeat(np.cumsum(lengths), lengths) - np.arange(len(chars))  # characters up to the word's end
    rolled, hashes, owners = np.zeros(len(chars), np.uint64), [], []
    base = np.uint64(0x100000001B3)
    for n in range(1, max(SIZES) + 1):
        rolled = rolled[: len(chars) - n + 1] * base + chars[n - 1 :] if n > 1 else chars.copy()
        if n in SIZES:
            ok = left[: len(rolled)] >= n
            hashes.append(_mix(rolled[ok] + np.uint64(n)))
            owners.append(owner[: len(rolled)][ok])
    starts = np.cumsum(lengths) - lengths
    # The powers are rounded to doubles, so a long word's mark keeps its high bits only; models differ with it, so it stays.
    weights = np.concatenate([[1], np.cumprod(np.full(int(lengths.max()), base, np.uint64))[:-1]]).astype(np.uint64)
    whole = np.add.reduceat(chars * weights[np.arange(len(chars)) - np.repeat(starts, lengths)], starts)
    hashes.append(_mix(whole + np.uint64(99)))
    owners.append(np.arange(len(marked)))
    order = np.argsort(np.concatenate(owners), kind="stable")
    return (np.concatenate(hashes)[order] % np.uint64(BUCKETS)).astype(np.int64), np.bincount(np.concatenate(owners), minlength=len(marked))


def split_words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """(word numbers, words a text, distinct words): lower case, surrounding punctuation cut off."""
    lower = pc.utf8_lower(pc.fill_null(texts.cast(pa.large_string()), ""))
    trimmed = pc.utf8_trim_whitespace(lower)
    parts = pc.utf8_split_whitespace(trimmed)
    counts = pc.list_value_length(parts).to_numpy(zero_copy_only=False).astype(np.int64)
    blank = pc.equal(trimmed, "").to_numpy(zero_copy_only=False)  # such a text splits into one empty part
    found = parts.flatten().filter(pa.array(np.repeat(~blank, counts)))
    counts = np.where(blank, 0, counts)
    values = pc.utf8_trim(found, characters=".,;:!?\"'()[]{}#$%&*|<>")
    encoded = values.dictionary_encode()
    return encoded.indices.to_numpy(zero_copy_only=False).astype(np.int64), counts, units.strings_of(encoded.dictionary)


def _segment_sum(values: np.ndarray, counts: np.ndarray) -> np.ndarray:
    ends = np.concatenate([[0], np.cumsum(counts)])
    total = np.concatenate([np.zeros((1, *values.shape[1:])), np.cumsum(values, axis=0, dtype=np.float64)])
    return total[ends[1:]] - total[ends[:-1]]


def train(texts: pa.Array, labels: np.ndarray, seed: int = 7) -> tuple[np.ndarray, float]:
    """(a number per n-gram bucket, the bias) whose sigmoid is the softmax's probability of label 1."""
    n = len(labels)
    if not n or labels.min() == labels.max():
        rate = (float(labels.sum()) + 1) / (n + 2)
        return np.zeros(BUCKETS, np.float32), float(np.log(rate / (1 - rate)))
    codes, counts, words = split_words(texts)
    rows = np.repeat(np.arange(n), counts)
    pairs, times = np.unique(rows * len(words) + codes, return_counts=True)  # (text, word) with its count
    rows, codes = pairs // len(words), pairs % len(words)
    often = np.bincount(codes, minlength=len(words)) >= MIN_TEXTS
    if not often.any():
        often[:] = True
    weight = SCALE * (times / np.maximum(counts, 1)[rows])[often[codes]]
    rows, codes = rows[often[codes]], (np.cumsum(often) - 1)[codes[often[codes]]]
    grams, per_word = word_grams([w for w, o in zip(words, often, strict=True) if o])
    word_of = np.repeat(np.arange(len(per_word)), per_word)
    common_gram = np.bincount(grams, np.bincount(codes, minlength=len(per_word))[word_of], BUCKETS) >= min(MIN_PAIRS, n // 10)
    grams, word_of = grams[common_gram[grams]], word_of[common_gram[grams]]
    kept = np.bincount(word_of, minlength=len(per_word))
    present, grams = np.unique(grams, return_inverse=True)
    by_word = np.argsort(codes, kind="stable")
    by_gram = np.argsort(grams, kind="stable")
    gram_counts, word_counts, row_counts = np.bincount(grams, minlength=len(present)), np.bincount(codes, minlength=len(per_word)), np.bincount(rows, minlength=n)
    rng = np.random.default_rng(seed)
    params = [rng.normal(0, 0.1, (len(present), DIM)), rng.normal(0, 0.5, (DIM, 2)), np.zeros(2)]
    first, second = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    target = np.eye(2)[labels]
    for step in range(1, STEPS + 1):
        embed, soft, bias = params
        word = _segment_sum(embed[grams], kept) / per_word[:, None]
        doc = _segment_sum(word[codes] * weight[:, None], row_counts)
        logits = doc @ soft + bias
        p = np.exp(logits - logits.max(1, keepdims=True))
        delta = (p / p.sum(1, keepdims=True) - target) / n
        d_doc = delta @ soft.T
        d_word = _segment_sum((d_doc[rows] * weight[:, None])[by_word], word_counts) / per_word[:, None]
        d_embed = _segment_sum(d_word[word_of[by_gram]], gram_counts)
        for i, g in enumerate((d_embed + DECAY / len(present) * embed, doc.T @ delta + DECAY * soft, delta.sum(0))):
            first[i] = 0.9 * first[i] + 0.1 * g
            second[i] = 0.99 * second[i] + 0.01 * g * g
            params[i] = params[i] - RATE * min(1.0, 2 * (1 - step / (STEPS + 1))) * (first[i] / (1 - 0.9**step)) / (np.sqrt(second[i] / (1 - 0.99**step)) + 1e-12)
    embed, soft, bias = params
    out = np.zeros(BUCKETS, np.float32)
    out[present] = SCALE * (embed @ (soft[:, 1] - soft[:, 0]))
    return out, float(bias[1] - bias[0])


def score_texts(texts: pa.Array, weights: np.ndarray, bias: float) -> np.ndarray:
    codes, counts, words = split_words(texts)
    grams, per_word = word_grams(words)
    by_word = _segment_sum(weights[grams].astype(np.float64), per_word) / np.maximum(per_word, 1)
    logits = bias + _segment_sum(by_word[codes], counts) / np.maximum(counts, 1)
    return 1 / (1 + np.exp(-np.clip(logits, -60, 60)))


def _train_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held = list(batches)
    table = pa.Table.from_batches(held).sort_by([("doc_id", "ascending"), ("text", "ascending")]) if held else None
    texts, labels = (pa.array([], pa.string()), np.zeros(0, np.int64)) if table is None else (table.column("text").combine_chunks(), table.column("toxic").to_numpy().astype(np.int64))
    weights, bias = train(texts, labels)
    yield pa.RecordBatch.from_pydict({"weights": [weights.astype("<f4").tobytes()], "bias": [bias]}, schema=pa.schema([("weights", pa.binary()), ("bias", pa.float64())]))


def remainder(doc_id) -> F.Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % 4


def fit(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> tuple[bytes, float]:
    """Weights and bias, learnt in one task from `sample_rows` labelled documents at most, those of least hash; a doc_id is one document, of repeated rows the one with the least text."""
    known = labels.groupBy("doc_id").agg(F.min("toxic").alias("toxic"), F.max("toxic").alias("other")).filter(F.col("toxic").isin(0, 1) & (F.col("toxic") == F.col("other")) & (remainder(F.col("doc_id")) != 2)).select("doc_id", "toxic")
    share = min(1.0, sample_rows / max(1, known.count()))
    mark = F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000))
    chosen = known.filter(mark <= int(share * 1_100_000)).orderBy(mark, "doc_id").limit(sample_rows)
    rows = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "toxic").agg(F.min("text").alias("text")).select("doc_id", "text", "toxic")
    found = rows.repartition(1).mapInArrow(_train_batches, "weights binary, bias double").collect()
    if not found:  # Spark leaves out a task whose input is known to be empty
        return np.zeros(BUCKETS, "<f4").tobytes(), 0.0
    return bytes(found[0]["weights"]), found[0]["bias"]


def _scorer(model):
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, bias = np.frombuffer(model.value[0], "<f4"), model.value[1]
        for table in units.chunks(batches, CHUNK_BYTES):
            scores = score_texts(table.column("text").chunk(0), weights, bias)
            yield pa.RecordBatch.from_arrays([*(table.column(c).chunk(0) for c in ("doc_id", "held_out")), pa.array(scores)], names=["doc_id", "held_out", "score"])

    return score


def toxicity_scores(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted of every row of `docs`."""
    spark = docs.sparkSession
    model = spark.sparkContext.broadcast(fit(docs, labels, sample_rows))
    doc_id = F.col("doc_id").cast("long")
    rows = docs.select(doc_id.alias("doc_id"), F.coalesce(remainder(doc_id) == 2, F.lit(False)).alias("held_out"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(_scorer(model), "doc_id long, held_out boolean, score double").withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def op5_toxicity(spark, sf_dir) -> DataFrame:
    return toxicity_scores(common.documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic"))
