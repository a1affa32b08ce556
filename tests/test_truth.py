"""Annotations, ground truth, variants, governance and text rules on small cases."""

import json

import pytest
from plumbline.functions import tables, text
from plumbline.operators import governance, shred, truth
from plumbline.sinks import render
from pyspark.sql import functions as F

LINES = [
    ("a.go", 1, "x := aes() // @PS a1|AES-256|1|algorithm|first"), ("a.go", 2, "y /* @PS a2 | RSA-2048 | 3 | protocol */"), ("a.go", 3, "// @PS +a1"), ("a.go", 4, "z // @PS +"), ("a.go", 5, "z // @PS +a|b"),
    ("a.go", 6, "z // @PS a|b|c"), ("a.go", 7, "z // @PS |b|1|algorithm"), ("a.go", 8, "z // @PS a|b|x|algorithm"), ("a.go", 9, "z // @PS a|b|7|algorithm"), ("a.go", 10, "z // @PS a|b|1|thing"), ("a.go", 11, "z // @PS a||1|algorithm"),
    ("a.go", 12, "z @PS not a comment"), ("b.xml", 1, "<a/> <!-- @PS a3|TLSv1.3|4|protocol -->"), ("Makefile", 1, "k # @PS a4|MD5|4|algorithm"), ("c.bin", 1, "// @PS a9|X|1|algorithm"), ("b.xml", 2, "<b/> <!-- @PS +nope -->"), ("b.xml", 3, "plain"),
]


@pytest.fixture(scope="module")
def parsed(spark):
    return text.parse_annotations(spark.createDataFrame(LINES, "path string, line int, text string"))


def test_annotations(parsed):
    got = {(r.path, r.line): r for r in parsed.collect()}
    assert set(got) == {(p, n) for p, n, t in LINES if "@PS" in t and p != "c.bin"}
    assert {k[1]: r.error for k, r in got.items() if k[0] == "a.go"} == {1: None, 2: None, 3: None, 4: "alias without target", 5: "alias takes only an id", 6: "needs 4 or 5 fields", 7: "empty id", 8: "layer is no number", 9: "unknown layer", 10: "unknown asset type", 11: "empty algorithm", 12: "malformed"}
    a = got["a.go", 1]
    assert (a.id, a.algorithm, a.layer, a.asset_type, a.note) == ("a1", "AES-256", 1, "algorithm", "first")
    assert got["a.go", 3].target == "a1" and got["a.go", 2].note == "" and got["b.xml", 1].algorithm == "TLSv1.3"


def test_entries_and_defects(spark, parsed):
    more = spark.createDataFrame([("a7", "key.pem", None, "Ed25519", 6, "related-crypto-material", None)], "id string, path string, line int, algorithm string, layer int, asset_type string, note string")
    got = {r.id: r for r in truth.entries(parsed, more).collect()}
    assert set(got) == {"a1", "a2", "a3", "a4", "a7"} and got["a7"].line == 1
    assert [tuple(x) for x in got["a1"].accept_locations] == [("a.go", 3)] and got["a1"].layer_name == tables.LAYER_TITLES[1]
    assert {(r.path, r.line) for r in truth.defects(parsed).collect()} == {("a.go", n) for n in range(4, 13)} | {("b.xml", 2)}
    with pytest.raises(ValueError, match="layers"):
        render.truth_document({"project": "p"}, truth.entries(parsed, more))


def test_detectable_and_keys(spark):
    plants = spark.createDataFrame([("p", "a.go", 1, "AES-256"), ("q", "a.go", 2, "RSA-2048")], "id string, file string, line int, algorithm string")
    lines = spark.createDataFrame([("a.go", 1, "x := aes.NewCipher(k)"), ("a.go", 2, "y := key()")], "path string, line int, text string")
    assert {r.id: r.found for r in truth.detectable(plants, lines).collect()} == {"p": True, "q": False}
    assert all(r.found for r in truth.detectable(plants, lines, ("KEY(",)).collect())
    files = spark.createDataFrame([(1, b"xx -----BEGIN KEY"), (2, b"\x30\x82"), (3, b"\xfe\xed\xfe\xed!"), (4, b"text"), (5, b"")], "n int, content binary")
    assert {r.n: r.is_key for r in truth.key_material(files).collect()} == {1: True, 2: True, 3: True, 4: False, 5: False}


def test_variants(spark):
    lines = spark.createDataFrame([("f", i, t) for i, t in enumerate(["seal a_seal seal2 seal", "k1: 1", "k2: 2", "k3: 3", "end AES"], 1)], "path string, line int, text string")
    out = truth.variant_lines(lines, {"seal": "lock", "a_seal": "b$"}, [{"from": "AES", "to": "DES"}], 7, "^k[0-9]:")
    got = {r.line: r.text for r in out.collect()}
    assert got[1] == "lock b$ seal2 lock" and got[5] == "end DES" and sorted(got[i] for i in (2, 3, 4)) == ["k1: 1", "k2: 2", "k3: 3"]


def test_text_rules(spark):
    one = spark.range(1)
    row = one.select(
        text.scrub_paths(F.lit("/a/b/tool")), text.scrub_paths(F.lit("x @ /build/root/bin/tool y")), text.scrub_paths(F.lit("see http://host:9000/api/x")), text.first_line(F.lit("\x1b[1mv1.2\x1b[0m\nmore")), text.first_line(F.lit(" ")),
        text.status_path(F.lit("R  old.txt -> new.txt")), text.status_path(F.lit(" M src/x.py")), text.image_repository(F.lit("localhost:5000/tool")), text.image_repository(F.lit("a/b:1@sha256:0")),
    ).first()
    assert list(row) == ["<external>/tool", "x @ <external>/tool y", "see http://host:9000/api/x", "v1.2", "unknown", "new.txt", "src/x.py", "localhost:5000/tool", "a/b"]


def test_governance(spark):
    d = governance.table_digests(spark).collect()
    assert {r.table_name: r.entries for r in d} == {"oid_algorithms": 27, "token_aliases": 32, "family_markers": 43, "whole_token_only": 7, "location_property_names": 8, "line_property_names": 5, "known_unplanted": 15}
    known = {"oid_algorithms": "031a3c27915e6dde", "token_aliases": "637f0e9d5f2cf137", "whole_token_only": "88a20cf6715e9c84", "location_property_names": "0b8c15cc33ce242a", "line_property_names": "ed438ed351a5b930"}
    then = spark.createDataFrame([*known.items(), ("family_markers", "0")], "table_name string, sha256_16 string")
    states = {r.table_name: r.state for r in governance.digest_changes(governance.table_digests(spark), then).collect()}
    assert states == dict.fromkeys(known, "same") | {"family_markers": "then 0", "known_unplanted": "new"}
    docs = spark.createDataFrame([("s", json.dumps({"specVersion": "1.6", "components": [{"type": "thing", "name": "x"}, {"type": "library"}]}))], "source string, raw string")
    p = shred.parse(docs)
    assert {r.message for r in governance.structural_errors(p, shred.components(p)).collect()} == {"bomFormat must be CycloneDX", "type is not one of the enumeration", "name is required"}
    doc = json.loads(render.cbom_document(governance.cbom_components(spark.createDataFrame([("AES", "f", 1), ("AES", "f", 1), ("AES", "e", 2)], "name string, file string, line int"))))
    assert [x["location"] for x in doc["components"][0]["evidence"]["occurrences"]] == ["e", "f"] and len(doc["components"][0]["bom-ref"]) == 16
