"""The command lines end to end on a small project, and the operators behind them."""

import json

import pytest
from plumbline import cli
from plumbline.operators import governance, truth
from plumbline.sinks import render
from plumbline.sources import inventory, reports
from pyspark.sql import functions as F

LINES = [
    "#!/usr/bin/env tool", "seal(AES-256-GCM); // @PS direct|AES-256-GCM|1|algorithm", "hash = SHA-256 // @PS digest | SHA-256 | 2 | algorithm | by name", "x = wrapper_seal(y); // @PS wrap|AES-256-GCM|3|algorithm",
    "again = wrapper_seal(z); // @PS +wrap", "suite: TLSv1.3 // @PS conf|TLSv1.3|4|protocol", "import libsodium // @PS dep|libsodium|5|related-crypto-material",
]
META = {
    "description": "a project", "build": ["make"], "toolchain": {"c": "17"}, "file_assets": [{"id": "pem", "path": "keys/a.pem", "algorithm": "RSA-2048", "layer": 6, "cyclonedx_asset_type": "related-crypto-material"}],
    "holdout": {"variant_name": "demo-v", "seed": 5, "rename_symbols": {"wrapper_seal": "outer_lock"}, "rename_files": {"src/a.c": "src/b.c"}, "substitutions": [{"from": "AES-256-GCM", "to": "AES-128-GCM"}]},
}


@pytest.fixture(scope="module")
def project(tmp_path_factory):
    root = tmp_path_factory.mktemp("cli")
    home = root / "templates" / "c" / "demo"
    (home / "src").mkdir(parents=True)
    (home / "keys").mkdir()
    (home / "project.json").write_text(json.dumps(META))
    (home / "src" / "a.c").write_text("\n".join(LINES))
    (home / "keys" / "a.pem").write_bytes(b"-----BEGIN RSA PRIVATE KEY-----\n\xff")
    return root


@pytest.fixture(scope="module")
def built(spark, project):
    assert cli.main(["build-truth", "--templates", f"{project}/templates", "--out", f"{project}/corpus", "--truth", f"{project}/truth", "--quiet"], spark) == 0
    return project


def test_build_and_check(spark, built):
    shipped = built / "corpus" / "c" / "demo"
    assert (shipped / "src" / "a.c").read_text().split("\n")[1] == "seal(AES-256-GCM);" and "@PS" not in (shipped / "src" / "a.c").read_text()
    assert (shipped / "keys" / "a.pem").read_bytes().endswith(b"\xff")
    doc = json.loads((built / "truth" / "demo.json").read_text())
    assert doc["asset_count"] == 6 and doc["layer_counts"] == {str(i): 1 for i in range(1, 7)} and doc["toolchain"] == {"c": "17"}
    assert next(x for x in doc["assets"] if x["id"] == "wrap")["accept_locations"] == [{"file": "src/a.c", "line": 5}]
    check = ["build-truth", "--templates", f"{built}/templates", "--out", f"{built}/corpus", "--truth", f"{built}/truth", "--check", "--quiet"]
    assert cli.main(check, spark) == 0
    (shipped / "extra.txt").write_text("x")
    assert cli.main(check, spark) == 0
    old = (shipped / "keys" / "a.pem").read_bytes()
    (shipped / "keys" / "a.pem").write_bytes(old + b"x")
    assert cli.main(check, spark) == 1
    (shipped / "keys" / "a.pem").write_bytes(old)
    assert cli.main(["build-truth", "--templates", f"{built}/nothing", "--out", "x", "--truth", "y"], spark) == 1


def test_variant(spark, built):
    assert cli.main(["variant", "--templates", f"{built}/templates", "--out", f"{built}/holdout", "--ground-truth-out", f"{built}/holdout-truth", "--quiet"], spark) == 0
    text = (built / "holdout" / "c" / "demo-v" / "src" / "b.c").read_text().split("\n")
    assert text[0] == LINES[0] and text[1].startswith("// ") and text[4] == "" and text[5] == "seal(AES-128-GCM);" and "outer_lock" in text[7]
    doc = json.loads((built / "holdout-truth" / "demo-v.json").read_text())
    assert doc["holdout"] and doc["seed"] == 5 and doc["derived_from"] == "demo" and {x["algorithm"] for x in doc["assets"]} >= {"AES-128-GCM", "SHA-256"}
    lines = {x["id"]: x["line"] for x in doc["assets"]}
    assert lines["direct"] == 6 and text[lines["wrap"] - 1].startswith("x = outer_lock")


def test_score_misses_and_withhold(spark, built, capsys):
    known = inventory.ground_truth(spark, f"{built}/truth")
    run = built / "run"
    (run / "cboms").mkdir(parents=True)
    for r in truth.sample_documents(known).collect():
        (run / "cboms" / f"{r.source}.json").write_text(r.raw)
    (run / "cboms" / "demo__broken.json").write_text('{"bomFormat": "Cyc')
    (run / "cboms" / "stranger.json").write_text("{}")
    told = {"run": {"started_utc": "then", "corpus_tree_dirty": True}, "tools": {"demo-noisy": {"version": "1"}}, "judgement_tables": {"oid_algorithms": {"entries": 1, "sha256_16": "00"}},
            "invocations": [{"tool": "t", "project": "demo", "status": "failed", "error": "e" * 100}, {"tool": "u", "project": "demo", "status": "ok"}]}
    (run / "manifest.json").write_text(json.dumps(told))
    assert cli.main(["score", "--documents", f"{run}/cboms", "--ground-truth", f"{built}/truth", "--files", f"{built}/corpus", "--out", f"{run}/results", "--manifest", f"{run}/manifest.json"], spark) == 0
    said = capsys.readouterr()
    assert "scored 4 documents of 4 tools" in said.out and "demo-precise           67% (4/6)" in said.out and "stranger.json" in said.err
    md = (run / "results" / "results.md").read_text()
    for part in ("## Provenance", "yes: not to be published", "1 entries, 00", "## Detected by language and layer", "### c", "## Evidence", "## Validity and false positives", "## Problems", "| demo__broken.json | invalid JSON |"):
        assert part in md, part
    assert "e" * 80 in md and "e" * 81 not in md
    doc = json.loads((run / "results" / "results.json").read_text())
    precise = doc["tools"]["demo-precise"]
    assert precise["by_layer"]["1"] == {"detected": 1, "total": 1, "rate": 1.0} and precise["by_layer"]["4"]["detected"] == 0 and precise["occurrences_per_component"] == 1.0
    assert doc["tools"]["demo-noisy"]["phantom_location"] == 1 and doc["tools"]["demo-noisy"]["phantom_algorithm"] == 1
    by_tool = {r["tool"]: r for r in doc["results"]}
    assert by_tool["demo-precise"]["schema_valid"] is True and "schema_valid" not in by_tool["broken"] and len(by_tool["demo-srcfile"]["assets"]) == 6
    assert cli.main(["misses", "--results", f"{run}/results/results.json", "--tool", "demo-precise", "--out", f"{run}/misses.md"], spark) == 0
    missed = (run / "misses.md").read_text()
    assert "2 of 6 assets" in missed and "| demo | c | .c | conf | TLSv1.3 | protocol | no | yes | no |" in missed and "src/a" not in missed
    assert cli.main(["misses", "--results", f"{run}/results/results.json", "--tool", "none"], spark) == 1
    assert cli.main(["score", "--documents", f"{run}/cboms", "--ground-truth", f"{built}/truth", "--files", f"{built}/corpus", "--out", f"{run}/x", "--line-tolerance", "-1"], spark) == 1
    assert cli.main(["withhold", "--run", f"{run}", "--archive", f"{built}/archive"], spark) == 0 and not (run / "cboms").exists()
    assert cli.main(["withhold", "--run", f"{run}", "--archive", f"{built}/archive", "--verify"], spark) == 0
    (built / "archive" / "stranger.json").write_text("{1}")
    assert cli.main(["withhold", "--run", f"{run}", "--archive", f"{built}/archive", "--verify"], spark) == 1


def test_collect(spark, built, monkeypatch):
    monkeypatch.setenv("TOOL_HOME", "/opt/tools")
    (built / "config.json").write_text(json.dumps({"tools": [{"name": "a", "command": "${TOOL_HOME}/a/bin"}, {"name": "b", "accept_exit_codes": [0, 3]}], "run": {"started_utc": "now", "config": "/home/me/x/config.json"}}))
    log = [{"tool": "a", "project": "demo", "exit_code": 1, "stderr": "\n".join(f"l{i}" for i in range(9)), "left": [f"f{i}" for i in range(30)]}, {"tool": "b", "project": "demo", "exit_code": 3, "payload": "{}"}]
    (built / "log.json").write_text("\n".join(map(json.dumps, log)))
    assert cli.main(["collect", "--config", f"{built}/config.json", "--log", f"{built}/log.json", "--out", f"{built}/collected", "--ground-truth", f"{built}/truth"], spark) == 0
    told = json.loads((built / "collected" / "manifest.json").read_text())
    assert told["run"] == {"started_utc": "now", "config": "<external>/config.json", "succeeded": 1, "attempted": 2} and told["tools"]["a"]["command"] == "<external>/bin"
    a, b = told["invocations"]
    assert a["status"] == "failed" and a["stderr_tail"] == "\n".join(f"l{i}" for i in range(3, 9)) and len(a["wrote_into_scan_tree"]) == 20
    assert b["status"] == "ok" and (built / "collected" / "cboms" / b["written"]).read_text() == "{}"


def test_governance_additions(spark):
    log = spark.createDataFrame([("no space", 0, False, 5, True), (None, 0, False, 5, True)], "export_error string, exit_code int, timed_out boolean, bytes int, is_json boolean").withColumn("accepted", F.array(F.lit(0)))
    assert sorted(r.status for r in governance.invocation_status(log).collect()) == ["export-failed", "ok"]
    image = spark.createDataFrame([("r/a:1", ["x@sha:0", "r/a@sha:1", "r/a@sha:2"]), ("r/a@sha:2", ["r/a@sha:1", "r/a@sha:2"]), ("r/a@sha:9", ["r/a@sha:1"]), ("r/b", ["r/a@sha:1"]), ("localhost:5/a", ["localhost:5/a@sha:3"])], "image string, digests array<string>")
    assert [r[0] for r in image.select(governance.image_digest(F.col("image"), F.col("digests"))).collect()] == ["sha:1", "sha:2", "sha:1", None, "sha:3"]


def test_symbol_links(spark):
    plants = spark.createDataFrame([("w", "AES"), ("lost", "AES"), ("none", "Falcon")], "id string, algorithm string")
    places = spark.createDataFrame([("w", "a.c", 1), ("lost", "a.c", 2), ("none", "a.c", 1)], "id string, file string, line int")
    lines = spark.createDataFrame([("a.c", 1, "x = Outer_Seal(y)"), ("a.c", 2, "y = f(z)")], "path string, line int, text string")
    files = spark.createDataFrame([("a.c", "x = Outer_Seal(y)\ny = f(z)"), ("b.c", "def outer_seal(): return aes()")], "path string, text string")
    hints = spark.createDataFrame([("AES", "aes"), ("Falcon", "falcon")], "algorithm string, hint string")
    got = {r.id: (r.held, r.linked) for r in truth.linked(plants, places, lines, files, hints).collect()}
    assert got == {"w": (True, True), "lost": (True, False), "none": (False, False)}


def test_report_sources(spark, tmp_path):
    (tmp_path / "l.json").write_text(json.dumps({"tool": {"name": "t"}, "inventory": {"algorithms": [{"name": "ECDSA", "files": ["a", "a", "b"]}], "curves": [{"name": "P-256", "files": ["c"]}]}}))
    assert sorted(tuple(r) for r in reports.listed_findings(spark, f"{tmp_path}/l.json").collect()) == [("algorithm", "ECDSA", "a"), ("algorithm", "ECDSA", "b"), ("curve", "P-256", "c")]
    assert reports.listed_findings(spark, f"{tmp_path}/l.json", curves=False).filter("kind = 'curve'").isEmpty()
    (tmp_path / "q.json").write_text(json.dumps({"#select": {"tuples": [[{"label": "MD5", "url": {"uri": "file:///s/a.c", "startLine": 7}}, "m"], [{"label": "DES"}]]}}))
    assert sorted(tuple(r) for r in reports.query_findings(spark, f"{tmp_path}/q.json").collect()) == [("DES", None, None), ("MD5", "/s/a.c", 7)]
    docs = spark.createDataFrame([("d", json.dumps({"root": "/s/x", "a": ["/s/x/b.c", {"absolutePath": 1, "k": "at /s/x"}]}))], "source string, raw string")
    assert json.loads(reports.without_root_anywhere(docs, "/s/x/").first().raw) == {"a": ["b.c", {"k": "at ."}]}
    found = spark.createDataFrame([("P-256",), ("ECDSA P-256",)], "name string")
    assert [r.name for r in reports.without_curves(found, r"p-?256|secp256r1").collect()] == ["ECDSA P-256"]
    assert render.scrubbed({"a": ["/x/y/z", "see http://h:1/a/b", "run /x/y/z now"]}) == {"a": ["<external>/z", "see http://h:1/a/b", "run <external>/z now"]}
