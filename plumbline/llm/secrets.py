"""Operator 7: secret scans with corpus-wide ownership frequency.

Three base patterns (assign, access, hex) are found in whole texts. A fourth,
looser kind (token: long, high-entropy runs that no base span covers) gives
candidates only. The SHA-256 of every candidate's value is counted over the
corpus by distinct repositories (documents) and owners (source). A value is a
widely copied example where more than MAX_OWNERS owners hold it, or more than
MAX_REPOS repositories, be they of one owner; else it is owner-specific and
looks live. Token candidates become spans where their value looks live; base
spans stay in either case, and are only told apart in n_live and n_copied.

Defined cases: null text counts as empty; a null owner is an owner of its own;
repeated rows are scanned row by row but count as one repository where doc_id
is equal; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm import common

KINDS = ("assign", "access", "hex", "token")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ASSIGN_WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
RUN = re.compile(r"[A-Za-z0-9+/_-]{20,}")
ASSIGN_CHARS, ACCESS_CHARS = 6, 20
#: Bits a character that a token needs, and the most owners and repositories of a live-looking value.
TOKEN_BITS = 3.5
MAX_OWNERS = 2
MAX_REPOS = 10
#: So many live tokens at most are broadcast, 32 bytes each.
BROADCAST_TOKENS = 1 << 16


def _bits(value: str) -> float:
    n = len(value)
    return -sum(c / n * math.log2(c / n) for c in Counter(value).values())


def base_spans(text: str) -> list[tuple[int, int, int, str]]:
    """(start, kind number, end, value), ordered; positions are code points, the end exclusive."""
    out = []
    lower = text.lower()
    if any(w in lower for w in ASSIGN_WORDS):
        out += [(m.start(), 0, m.end(), m[2]) for m in ASSIGN.finditer(text) if len(m[2]) >= ASSIGN_CHARS]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end(), m[0]) for m in ACCESS.finditer(text) if len(m[0]) >= ACCESS_CHARS]
    out += [(m.start(), 2, m.end(), m[0]) for m in HEX.finditer(text)]  # a run of 24 or more is matched whole, a shorter one never
    return sorted(out)


def token_candidates(text: str, base: list[tuple[int, int, int, str]]) -> list[tuple[int, int, int, str]]:
    """Long runs with letters, digits and high entropy that overlap no base span; one pass over both, as both are ordered."""
    out, at, reach = [], 0, 0
    for m in RUN.finditer(text):
        s, e, v = m.start(), m.end(), m[0]
        while at < len(base) and base[at][0] < e:  # spans that begin before this run's end; `reach` is how far they go
            reach = max(reach, base[at][2])
            at += 1
        if reach > s:
            continue
        if any(c.isdigit() for c in v) and any(c.isalpha() for c in v) and _bits(v) >= TOKEN_BITS:
            out.append((s, 3, e, v))
    return out


def joined(spans: list[tuple[int, int, int, str]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e, _ in spans)


FOUND = pa.list_(pa.struct([("start", pa.int64()), ("kind", pa.int32()), ("end", pa.int64()), ("key", pa.binary())]))
FOUND_DDL = "array<struct<start:bigint,kind:int,`end`:bigint,key:binary>>"


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        digests, found = [], []
        for text in batch.column(2):
            t = text.as_py() or ""
            base = base_spans(t)
            digests.append(hashlib.sha256(joined(base).encode()).hexdigest())
            found.append([{"start": s, "kind": k, "end": e, "key": hashlib.sha256(v.encode()).digest()} for s, k, e, v in sorted(base + token_candidates(t, base))])
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(digests, pa.string()), pa.array(found, FOUND)], names=["doc_id", "owner", "base_sha256", "found"])


def scan(docs: DataFrame, owner: str = "source") -> DataFrame:
    """One written row per row of `docs`: uid, doc_id, owner, base_sha256 and all candidates found."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), common.column_or_null(docs, owner, "string").alias("owner"), F.col("text").cast("string").alias("text"))
    return common.materialize(rows.mapInArrow(_scan, f"doc_id long, owner string, base_sha256 string, found {FOUND_DDL}").withColumn("uid", F.monotonically_increasing_id()), "secrets")


def ownership(scanned: DataFrame) -> DataFrame:
    """key, n_repos, n_owners: over the whole corpus, both sums partial before the shuffle."""
    held = scanned.select("doc_id", "owner", F.explode(F.array_distinct(F.transform("found", lambda x: x["key"]))).alias("key"))
    by_owner = held.distinct().groupBy("key", "owner").agg(F.count(F.lit(1)).alias("n"))
    return by_owner.groupBy("key").agg(F.sum("n").alias("n_repos"), F.count(F.lit(1)).alias("n_owners"))


def looks_live(max_owners: int, max_repos: int) -> F.Column:
    return (F.col("n_owners") <= max_owners) & (F.col("n_repos") <= max_repos)


def find_secrets(docs: DataFrame, owner: str = "source", max_owners: int = MAX_OWNERS, max_repos: int = MAX_REPOS) -> DataFrame:
    """uid, doc_id, base_sha256, all (array of start, kind, end: base and live tokens), n_live, n_copied."""
    scanned = scan(docs, owner)
    seen = ownership(scanned)
    each = scanned.select("uid", F.explode("found").alias("f")).select("uid", "f.*").join(seen, "key")
    live = looks_live(max_owners, max_repos)
    span = F.struct("start", "kind", "end")
    by_doc = each.groupBy("uid").agg(F.collect_list(F.when((F.col("kind") < 3) | live, span)).alias("spans"), F.count_if(live).alias("n_live"), F.count_if(~live).alias("n_copied"))
    out = scanned.select("uid", "doc_id", "base_sha256").join(by_doc, "uid", "left")
    none = F.array().cast("array<struct<start:bigint,kind:int,`end`:bigint>>")
    return out.select("uid", "doc_id", "base_sha256", F.array_sort(F.coalesce("spans", none)).alias("all"), *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("n_live", "n_copied")])


def span_string(spans) -> F.Column:
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def mask_secrets(docs: DataFrame, owner: str = "source", max_owners: int = MAX_OWNERS, max_repos: int = MAX_REPOS) -> DataFrame:
    """`docs` with every base and live span replaced by [SECRET]; n_chars, if there, follows the text.

    The hashes of a document's live tokens come by a join on doc_id; only documents with such tokens have any. Up to BROADCAST_TOKENS
    of them go to the texts, of more the texts are shuffled to them.
    """
    scanned = scan(docs, owner)
    doc, keys = common.free_names(docs, 2)
    tokens = scanned.select("doc_id", F.explode("found").alias("f")).filter("f.kind = 3").select("doc_id", "f.key")
    live = tokens.join(ownership(scanned).filter(looks_live(max_owners, max_repos)).select("key"), "key", "left_semi")
    by_doc = common.materialize(live.groupBy(F.col("doc_id").alias(doc)).agg(F.collect_set("key").alias(keys)), "live")
    if (by_doc.agg(F.sum(F.size(keys))).first()[0] or 0) <= BROADCAST_TOKENS:
        by_doc = F.broadcast(by_doc)
    wide = docs.join(by_doc, F.col("doc_id").cast("long").eqNullSafe(F.col(doc)), "left").drop(doc)
    schema = docs.schema
    out = wide.mapInArrow(_masker(keys), ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema))
    return out.withColumn("n_chars", F.length("text").cast(schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def _masker(keys_name: str):
    def mask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Masks base spans and the tokens whose value's hash is among the row's live keys."""
        for batch in batches:
            at, held = batch.schema.get_field_index("text"), batch.schema.get_field_index(keys_name)
            texts = []
            for text, keys in zip(batch.column(at), batch.column(held), strict=True):
                t = text.as_py()
                if t:
                    base = base_spans(t)
                    live = set(keys.as_py() or [])
                    spans = [(s, e) for s, _, e, _ in base]
                    if live:
                        spans += [(s, e) for s, _, e, v in token_candidates(t, base) if hashlib.sha256(v.encode()).digest() in live]
                    parts, done = [], 0
                    for s, e in sorted(spans):
                        if s >= done:
                            parts += [t[done:s], "[SECRET]"]
                        done = max(done, e)
                    t = "".join([*parts, t[done:]])
                texts.append(t)
            kept = [i for i in range(batch.num_columns) if i != held]
            yield pa.RecordBatch.from_arrays([pa.array(texts, pa.string()) if i == at else batch.column(i) for i in kept], names=[batch.schema.field(i).name for i in kept])

    return mask


def op7_secret_scan(spark, sf_dir) -> DataFrame:
    found = find_secrets(common.documents(spark, sf_dir))
    count = lambda k: F.size(F.filter("all", lambda s: s["kind"] == k)).cast("long")
    return found.select("doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"), "base_sha256", span_string(F.col("all")).alias("spans"), count(3).alias("n_token"), "n_live", "n_copied")
