"""Operator 9: quality rules with risk-controlled thresholds.

Base counts per text come from one pass over whole texts. Thresholds are not
hand-set: labelled good documents are the holdout, the number of them that a set
of cutoffs would reject is a binomial count, and the set may be used only if the
exact (Clopper-Pearson) upper bound of its false rejection rate stays under the
risk. The sets form one ladder from loose to strict, on which a step tightens
one rule; its order comes from the labelled bad documents alone, so it is fixed
for the good ones. A stratum climbs until the first step that is not certified
(fixed-sequence testing), so only the strata share the error probability, not
the rules or cutoffs. In strata large enough for it, every rule and cutoff is
tested on its own instead (Bonferroni), so no rule holds up another. Strata with too few good documents to certify anything
take the cutoffs certified on the good documents of all strata; for those the
risk holds over the whole table, not in the stratum.

Defined cases: null text counts as no words; an empty table gives an empty
result; repeated rows are scored row by row but count once in the holdout, where
each doc_id stands for one document; null strata form their own stratum;
documents with contradictory or null labels are no holdout; other columns are
ignored.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.llm import common

SYMBOLS = "#*$%&|<>"
SPACES = " \t\n\x0b\x0c\r"
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50

#: Rule name -> candidate cutoffs, strictest first; a text with a value above the cutoff is rejected.
RULES: dict[str, tuple[float, ...]] = {
    "symbol_ratio": (0.02, 0.04, 0.06, 0.08, 0.1, 0.15, 0.2, 0.3, 0.4),
    "dup_line_ratio": (0.05, 0.1, 0.15, 0.2, 0.3, 0.4, 0.5, 0.7),
    "repeat_ratio": (0.05, 0.1, 0.15, 0.2, 0.25, 0.3, 0.35, 0.4, 0.45),
    "mean_word_chars": (8.0, 9.0, 10.0, 11.0, 12.0, 14.0, 18.0, 25.0),
}
RISK = 0.01
CONFIDENCE = 0.95

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines")


def text_counts(text: str | None) -> tuple[int, int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines (lines with a word)."""
    if not text:
        return 0, 0, 0, 0, 0, 0
    words = text.encode("utf-8", "surrogatepass").split()
    n = len(words)
    chars = len(text) - sum(map(text.count, SPACES))
    symbols = sum(map(text.count, SYMBOLS))
    lines = [x for x in text.split("\n") if x.strip(SPACES)]
    windows = list(zip(words, words[1:], words[2:], strict=False))
    first: dict = {}
    repeated = 0
    if len(set(windows)) < len(windows):
        marks = bytearray(n)
        for i, w in enumerate(windows):
            j = first.setdefault(w, i)
            if j != i:
                marks[i : i + 3] = b"\1\1\1"
                marks[j : j + 3] = b"\1\1\1"
        repeated = sum(marks)
    return n, chars, symbols, len(lines) - len(set(lines)), repeated, len(lines)


def _count_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [text_counts(x.as_py()) for x in batch.column(batch.schema.get_field_index("text"))]
        kept = [i for i, f in enumerate(batch.schema) if f.name != "text"]
        columns = [batch.column(i) for i in kept] + [pa.array(c, pa.int64()) for c in (zip(*rows, strict=True) if rows else [[]] * len(COUNTS))]
        yield pa.RecordBatch.from_arrays(columns, names=[batch.schema.field(i).name for i in kept] + list(COUNTS))


def with_counts(df: DataFrame) -> DataFrame:
    """`df` (with a string column text) without its text and with the base counts."""
    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema if f.name != "text")
    return df.mapInArrow(_count_batches, ", ".join(filter(None, [kept, *(f"{c} bigint" for c in COUNTS)])))


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (F.col("n_repeat_words") * 100 > F.col("n_words") * MAX_REPEAT_PERCENT)


def rule_values() -> dict[str, Column]:
    ratio = lambda a, b: F.col(a).cast("double") / F.greatest(F.col(b), F.lit(1)).cast("double")
    return {"symbol_ratio": ratio("n_symbols", "word_chars"), "dup_line_ratio": ratio("n_dup_lines", "n_lines"), "repeat_ratio": ratio("n_repeat_words", "n_words"), "mean_word_chars": ratio("word_chars", "n_words")}


def _beta_continued(a: float, b: float, x: float) -> float:
    """The continued fraction of the incomplete beta function (Lentz)."""
    tiny, c, d = 1e-300, 1.0, 1 - (a + b) * x / (a + 1)
    d = 1 / (d or tiny)
    h = d
    for m in range(1, 10_000):
        for top in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 / ((1 + top * d) or tiny)
            c = (1 + top / c) or tiny
            h *= d * c
        if abs(d * c - 1) < 1e-14:
            break
    return h


def beta_cdf(a: float, b: float, x: float) -> float:
    if x <= 0 or x >= 1:
        return float(x >= 1)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    return front * _beta_continued(a, b, x) / a if x < (a + 1) / (a + b + 2) else 1 - front * _beta_continued(b, a, 1 - x) / b


def upper_bound(rejected: int, n: int, delta: float) -> float:
    """Exact binomial upper bound: the p at which `rejected` or fewer of n has probability delta."""
    if n == 0 or rejected >= n:
        return 1.0
    low, high = rejected / n, 1.0
    for _ in range(80):
        mid = (low + high) / 2
        low, high = (mid, high) if beta_cdf(rejected + 1, n - rejected, mid) < 1 - delta else (low, mid)
    return high


def ladder(bad: dict[str, list[int]]) -> list[tuple[str, float]]:
    """(rule, cutoff) steps from loose to strict; `bad` has the labelled bad documents above each cutoff of RULES.

    The rules follow each other by the bad documents they can reject, each down
    to the loosest cutoff that rejects all of these; the cutoffs left over
    reject no more and come last, rule by rule in turn.
    """
    at, steps = {r: len(cuts) for r, cuts in RULES.items()}, []
    for r in sorted(bad, key=lambda r: -bad[r][0]):
        while bad[r][0] and (at[r] == len(bad[r]) or bad[r][at[r]] < bad[r][0]):
            at[r] -= 1
            steps.append((r, RULES[r][at[r]]))
    while any(at.values()):
        for r in [r for r in RULES if at[r]]:
            at[r] -= 1
            steps.append((r, RULES[r][at[r]]))
    return steps


def climb(steps: list[tuple[str, float]], firsts: dict[int, int], risk: float, delta: float) -> dict[str, float]:
    """The last certified cutoffs; `firsts` counts good documents by the first step that rejects them (none: len(steps))."""
    n, rejected, chosen = sum(firsts.values()), 0, {}
    for k, (r, cut) in enumerate(steps):
        rejected += firsts.get(k, 0)
        if upper_bound(rejected, n, delta) > risk:
            break
        chosen[r] = cut
    return chosen


class Cutoffs(NamedTuple):
    """Rule -> cutoff: of the strata with a test of their own, and of all others."""

    own: dict[str | None, dict[str, float]]
    rest: dict[str, float]

    def of(self, stratum: str | None) -> dict[str, float]:
        return self.own.get(stratum, self.rest)


def holdout(counts: DataFrame, labels: DataFrame, stratum: str) -> DataFrame:
    """stratum, label and rule values of the labelled documents that pass the base rules, one row a doc_id.

    Repeated rows are no independent draws. Of rows with one doc_id the one with the least values counts.
    """
    clear = labels.groupBy("doc_id").agg(F.min("quality").alias("label"), F.max("quality").alias("best")).filter("label = best").select("doc_id", "label")
    rows = counts.filter(~base_failed()).join(clear, "doc_id")
    values = F.struct(*[v.alias(r) for r, v in rule_values().items()], F.col(stratum).alias("stratum"))
    return rows.groupBy("doc_id", "label").agg(F.min(values).alias("v")).select("label", "v.*")


def certified_cutoffs(counts: DataFrame, labels: DataFrame, stratum: str = "lang", risk: float = RISK, confidence: float = CONFIDENCE) -> Cutoffs:
    """Per stratum, rule -> the strictest cutoff reached; all rules of a stratum together keep the risk.

    `counts` needs doc_id, the stratum and the base counts; `labels` doc_id and
    quality (1: good). Strata with too few labelled good documents for any test
    are counted, not named, so at most a row per step goes to the driver for
    each of the others, of which the labels allow only so many.
    """
    held = common.materialize(holdout(counts, labels, stratum), "holdout")
    good = held.filter("label = 1")
    above = held.filter("label = 0").agg(*[F.count_if(F.col(r) > c).alias(f"{r}_{i}") for r, cuts in RULES.items() for i, c in enumerate(cuts)]).first()
    steps = ladder({r: [above[f"{r}_{i}"] for i in range(len(cuts))] for r, cuts in RULES.items()})
    first = F.coalesce(*[F.when(F.col(r) > c, F.lit(k)) for k, (r, c) in enumerate(steps)], F.lit(len(steps)))
    n_strata = counts.select(F.count_distinct(stratum) + F.max(F.col(stratum).isNull().cast("int"))).first()[0] or 0
    needed = next(n for n in range(1, 1 << 20) if upper_bound(0, n, 1 - confidence) <= risk)
    sizes = {r["stratum"]: r["count"] for r in good.groupBy("stratum").count().filter(F.col("count") >= needed).collect()}
    # How a stratum is tested follows from its size alone; those too small for any test of their own share a pooled one.
    tested = sorted(sizes, key=lambda s: (-sizes[s], s is None, s or ""))
    while tested and upper_bound(0, sizes[tested[-1]], (1 - confidence) / (len(tested) + (len(tested) < n_strata))) > risk:
        tested.pop()
    delta = (1 - confidence) / max(1, len(tested) + (len(tested) < n_strata))
    named = F.col("stratum").isin([s for s in tested if s is not None]) | (F.col("stratum").isNull() & F.lit(None in tested))
    firsts: dict[str | None, dict[int, int]] = {s: {} for s in tested}
    for row in good.filter(named).groupBy("stratum", first.alias("first")).count().collect():
        firsts[row["stratum"]][row["first"]] = row["count"]
    pooled = {r["first"]: r["count"] for r in good.groupBy(first.alias("first")).count().collect()}
    out = {s: climb(steps, own, risk, delta) for s, own in firsts.items()}
    # Large strata: every rule and cutoff on its own, the risk shared by the rules and the error by all tests.
    each = delta / sum(map(len, RULES.values()))
    large = [s for s in tested if upper_bound(0, sizes[s], each) <= risk / len(RULES)]
    if large:
        tests = [F.count_if(F.col(r) > c).alias(f"{r}_{i}") for r, cuts in RULES.items() for i, c in enumerate(cuts)]
        for row in good.filter(named).groupBy("stratum").agg(F.count(F.lit(1)).alias("n"), *tests).collect():
            if row["stratum"] in large:
                ok = {r: [c for i, c in enumerate(cuts) if upper_bound(row[f"{r}_{i}"], row["n"], each) <= risk / len(RULES)] for r, cuts in RULES.items()}
                out[row["stratum"]] = {r: min(c) for r, c in ok.items() if c}
    return Cutoffs(out, climb(steps, pooled, risk, delta))


def verdict(cutoffs: Cutoffs, stratum: str = "lang") -> Column:
    """True where the text neither fails the base rules nor exceeds a certified cutoff of its stratum."""
    values, never = rule_values(), F.lit(False)
    exceeds = lambda chosen: functools.reduce(Column.__or__, [values[r] > cut for r, cut in chosen.items()], never)
    bad = exceeds(cutoffs.rest)
    for s, chosen in cutoffs.own.items():
        bad = F.when(F.col(stratum).eqNullSafe(F.lit(s)), exceeds(chosen)).otherwise(bad)
    return ~base_failed() & ~bad


def quality_verdicts(docs: DataFrame, labels: DataFrame, stratum: str = "lang", risk: float = RISK, confidence: float = CONFIDENCE) -> DataFrame:
    """One row per row of `docs`: doc_id, the stratum, base counts, base_failed, kept."""
    counts = common.materialize(with_counts(docs.select("doc_id", common.column_or_null(docs, stratum, "string"), F.col("text").cast("string").alias("text"))), "quality")
    cutoffs = certified_cutoffs(counts, labels, stratum, risk, confidence)
    return counts.withColumn("base_failed", base_failed()).withColumn("kept", verdict(cutoffs, stratum))


def keep_good(docs: DataFrame, labels: DataFrame, stratum: str = "lang", risk: float = RISK, confidence: float = CONFIDENCE) -> DataFrame:
    """`docs` without the rejected rows. The texts are read twice rather than shuffled to their verdicts."""
    counts = common.materialize(with_counts(docs.select("doc_id", common.column_or_null(docs, stratum, "string"), F.col("text").cast("string").alias("text"))), "quality")
    cutoffs = certified_cutoffs(counts, labels, stratum, risk, confidence)
    names = docs.columns
    tagged = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"), common.column_or_null(docs, stratum, "string"), F.col("text").cast("string").alias("text"))
    return with_counts(tagged).filter(verdict(cutoffs, stratum)).select(*[F.col("row").getField(c).alias(c) for c in names])


def op9_quality_rules(spark, sf_dir) -> DataFrame:
    out = quality_verdicts(common.documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
