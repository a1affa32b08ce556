"""Scoring a small project: places, names, duplicates, dependencies, false positives and hostile documents."""

import json
import zipfile

import pytest
from plumbline.operators import run, shred
from plumbline.sinks import render
from plumbline.sources import inventory
from plumbline.streaming import arrivals
from pyspark.sql import functions as F

PLANTS = [("a", "src/seal.go", 10, "AES-256-GCM", 1), ("b", "src/identity.go", 20, "RSA-2048", 1), ("c", "keys/node.pem", 1, "Ed25519", 6), ("d", "go.mod", 5, "golang.org/x/crypto", 5)]


@pytest.fixture(scope="module")
def truth(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("truth")
    assets = [{"id": i, "file": f, "line": n, "algorithm": g, "layer": y, "layer_name": "x", "cyclonedx_asset_type": "algorithm"} for i, f, n, g, y in PLANTS]
    assets[0]["accept_locations"] = [{"file": "src/seal.go", "line": 40}]
    (folder / "box.json").write_text(json.dumps({"project": "box", "language": "go", "corpus_path": "corpus/go/box", "assets": assets}))
    return inventory.ground_truth(spark, str(folder))


def part(name, location=None, line=None, **more):
    out = {"type": "cryptographic-asset", "name": name, "cryptoProperties": {"assetType": "algorithm"}, **more}
    if location:
        out["evidence"] = {"occurrences": [{"location": location, **({} if line is None else {"line": line})}]}
    return out


def doc(*parts):
    return json.dumps({"bomFormat": "CycloneDX", "specVersion": "1.6", "components": list(parts)})


CASES = {
    "names only": doc(part("AES"), part("RSA"), part("Ed25519")),
    "file without line": doc(part("AES", "/tmp/x/src/seal.go"), part("RSA-2048", "./src/identity.go")),
    "wrong file": doc(part("AES", "src/identity.go", 10)),
    "wrong family": doc(part("RSA", "src/seal.go", 10)),
    "same place thrice": doc(part("AES", "src/seal.go", 10) | {"evidence": {"occurrences": [{"location": "src/seal.go", "line": 10}] * 3}}),
    "off by three": doc(part("AES", "src/seal.go", 13)),
    "alternative": doc(part("AES", "src/seal.go", 41)),
    "unknown path": doc(part("AES", "no/such.go", 1)),
    "unknown family": doc(part("Blowfish", "src/seal.go", 10)),
    "dependency": doc({"type": "library", "name": "golang.org/x/crypto", "evidence": {"occurrences": [{"location": "go.mod"}]}}, {"type": "library", "name": "AES", "evidence": {"occurrences": [{"location": "src/seal.go"}]}}),
    "wrapped": json.dumps([{"bom": {"bom": json.loads(doc(part("AES", "src/seal.go", 10)))}}]),
    "properties": doc(part("AES", properties=[{"name": "cdx:SrcFile", "value": " "}, {"name": "cdx:SrcFile", "value": "src/seal.go"}, {"name": "line", "value": "x"}, {"name": "Line", "value": " 11 "}])),
    "nested": doc({"type": "application", "name": "app", "components": [part("AES", "src/seal.go", True), part("SHA-1", "src/seal.go", "0")]}, "no object"),
    "broken": '{"components": [',
    "no document": "[]",
    "null parts": '{"bomFormat": "CycloneDX", "components": null}',
}


@pytest.fixture(scope="module")
def scored(spark, truth):
    files = spark.createDataFrame([("box", f) for f in ("src/seal.go", "src/identity.go", "README.md", "go.mod")], "project string, path string")
    inputs = spark.createDataFrame([(k, "box", "go", "t", v) for k, v in CASES.items()], "source string, project string, language string, tool string, raw string")
    return run.score_documents(inputs, truth, files)


def test_results(scored):
    got = {r.source: r for r in scored.results.collect()}
    assert set(got) == set(CASES)
    detected = {k: r.detected for k, r in got.items()}
    assert detected == {"names only": 0, "file without line": 2, "wrong file": 0, "wrong family": 0, "same place thrice": 1, "off by three": 1, "alternative": 1, "unknown path": 0, "unknown family": 0, "dependency": 1, "wrapped": 1, "properties": 1, "nested": 1, "broken": 0, "no document": 0, "null parts": 0}
    assert all(r.total == 4 for r in got.values())
    assert got["same place thrice"].distinct_claims == 1 and got["same place thrice"].claim_precision == 1.0 and got["same place thrice"].total_occurrences == 3
    assert (got["unknown path"].phantom_location, got["unknown path"].phantom_algorithm) == (1, 0)
    assert (got["unknown family"].phantom_location, got["unknown family"].phantom_algorithm) == (0, 1)
    assert got["dependency"].crypto_components == 0 and got["dependency"].matched_components == 0
    assert {k for k, r in got.items() if r.parse_error} == {"broken", "no document"}
    assert got["names only"].unmatched_reports == 3 and got["nested"].phantom_algorithm == 1


def test_weaker_rules(scored):
    got = {(r.source, r.id): r for r in scored.verdicts.collect()}
    near = {s: got[s, "a"].located for s in ("off by three", "alternative", "file without line", "wrong family", "properties", "nested")}
    assert near == {"off by three": False, "alternative": True, "file without line": False, "wrong family": True, "properties": True, "nested": False}
    assert got["names only", "b"].name_only and not got["names only", "b"].file_only
    assert got["wrong file", "b"].file_only and not got["wrong file", "b"].detected
    assert got["nested", "a"].matched_component == 2  # the walk takes the last sibling first


def test_lines(spark):
    df = spark.createDataFrame([(x,) for x in ("1", "0", "-4", "true", "10.0", '"12"', '" 7 "', '"1_0"', '"x"', "null", '"12.0"')], "raw string")
    got = [r[0] for r in df.select(shred.coerce_line(F.try_parse_json("raw"))).collect()]
    assert got == [1, None, None, None, None, 12, 7, 10, None, None, None]


def test_reports(scored):
    text = render.render_markdown(scored)
    assert "| box" in text and "## Problems" in text and "broken" in text
    whole = json.loads(render.render_json(scored, {"run": 1}, "project = 'box'"))
    assert len(whole["results"]) == len(CASES) and all("file" not in a for r in whole["results"] for a in r["assets"])
    assert "Key, certificate or keystore file: 16" in render.render_misses(scored, "t")
    assert render.percent(1, 8) == "12% (1/8)" and render.percent(5, 8) == "62% (5/8)" and render.percent(0, 0) == "--"
    assert render.markdown_table(["a"], []) == "_No data._"


def test_inputs(spark, truth, tmp_path):
    raw = tmp_path / "raw"
    (raw / "tool-b").mkdir(parents=True)
    for name in ("box__tool-a.json", "acme_box__tool c.json", "mystery.json", "tool-b/box.json", "tool-b/none.json"):
        (raw / name).write_bytes(b'{"bad": "\xff"}')
    inputs, problems = inventory.raw_inputs(spark, str(raw), truth)
    assert {(r.source, r.project, r.tool) for r in inputs.collect()} == {("box__tool-a.json", "box", "tool-a"), ("acme_box__tool c.json", "box", "tool c"), ("tool-b/box.json", "box", "tool-b")}
    assert {r.source for r in problems.collect()} == {"mystery.json", "tool-b/none.json"}
    path = tmp_path / "x.zip"
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("7/tool-a/acme_box_tool-a.json", "{}")
        z.writestr("flat.json", "{}")
    inputs, problems = inventory.bundle_inputs(spark, str(path), truth)
    assert [(r.project, r.tool) for r in inputs.collect()] == [("box", "tool-a")] and problems.count() == 1
    with pytest.raises(ValueError):
        inventory.project_files(spark, str(raw), truth)


def test_stream(spark, truth, tmp_path):
    (tmp_path / "in").mkdir()
    row = {"source": "s", "project": "box", "language": "go", "tool": "t", "raw": CASES["file without line"]}
    (tmp_path / "in" / "1.json").write_text(json.dumps(row))
    files = spark.createDataFrame([("box", "src/seal.go")], "project string, path string")
    arrivals.score_stream(spark, str(tmp_path / "in"), truth, files, str(tmp_path / "out"), str(tmp_path / "c")).awaitTermination(120)
    assert [r.detected for r in spark.read.parquet(str(tmp_path / "out")).collect()] == [2]
