"""Whole-word renames over all documents, non-ASCII ones included."""

import hashlib
import re

import duckdb
from plumbline.plans import catalogue

SF = "/root/testdata/sf0.001"


def digest(t):
    for old, new in (("tion", "ACTION"), ("zq", "ZQ")):
        t = re.sub(rf"(?<![A-Za-z0-9_]){old}(?![A-Za-z0-9_])", new, t)
    return hashlib.sha256(t.encode()).hexdigest()


def test_every_document_has_its_digest(spark):
    got = sorted(tuple(r) for r in catalogue.queries()["word_boundary_rename"](spark, SF).select("doc_id", "digest").collect())
    duck = duckdb.connect()
    duck.sql(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    texts = duck.sql("SELECT doc_id, text FROM documents").fetchall()
    assert got == sorted((i, digest(t)) for i, t in texts) and any(not t.isascii() for _, t in texts)
    assert got == sorted(duck.sql(f"SELECT doc_id, digest FROM ({catalogue.oracle_sql()['word_boundary_rename']})").fetchall())


def test_the_sql_finds_words_beside_non_ascii_and_each_other():
    texts = ["étion tion", "tion tion tion\ntion", "tioné zq", "xtion tion_ 9zq zq.zq", "zqzq", ""]
    duck = duckdb.connect()
    duck.sql("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    duck.executemany("INSERT INTO documents VALUES (?, ?)", list(enumerate(texts)))
    assert duck.sql(catalogue.oracle_sql()["word_boundary_rename"] + " ORDER BY 1").fetchall() == [(i, digest(t)) for i, t in enumerate(texts)]
