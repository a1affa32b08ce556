"""Command lines: score, build-truth, variant, collect, misses, withhold.

    python -m plumbline.cli score --documents DIR | --bundle PATH --ground-truth DIR --files DIR --out DIR
"""

from __future__ import annotations

import argparse
import json
import os
import shutil
import sys

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.functions import tables, text
from plumbline.operators import governance, rollups, truth
from plumbline.operators.run import score_documents
from plumbline.sinks import render
from plumbline.sources import inventory, reports

METADATA = "project.json"


def _session() -> SparkSession:
    return SparkSession.builder.appName("plumbline").config("spark.sql.variant.allowDuplicateKeys", "true").getOrCreate()


def _read_json(path: str):
    with open(path, encoding="utf-8") as f:
        return json.load(f)


def _write(path: str, content: str) -> None:
    os.makedirs(os.path.dirname(os.path.abspath(path)), exist_ok=True)
    with open(path, "w", encoding="utf-8") as f:
        f.write(content)


def score(spark: SparkSession, a) -> int:
    """Scores documents against ground truth; writes results.md and results.json."""
    if a.line_tolerance < 0:
        raise ValueError("the line tolerance is negative")
    if a.line_tolerance > tables.DEFAULT_TOLERANCE:
        print(f"warning: a line tolerance above {tables.DEFAULT_TOLERANCE} makes results incomparable", file=sys.stderr)
    known = inventory.ground_truth(spark, a.ground_truth)
    inputs, problems = inventory.bundle_inputs(spark, a.bundle, known) if a.bundle else inventory.raw_inputs(spark, a.documents, known)
    files = inventory.project_files(spark, a.files, known)
    run = score_documents(inputs, known, files, tolerance=a.line_tolerance, validate=not a.no_schema)
    meta: dict = {"line_tolerance": a.line_tolerance}
    if a.manifest:
        told = _read_json(a.manifest)
        now = {r["table_name"]: {"entries": r["entries"], "sha256_16": r["sha256_16"]} for r in governance.table_digests(spark).collect()}
        meta["run"] = {
            **told.get("run", {}), "manifest": os.path.basename(a.manifest), "tool_versions": {k: v.get("version") for k, v in told.get("tools", {}).items()}, "judgement_tables": now,
            "judgement_tables_collected": told.get("judgement_tables", {}), "failed_invocations": [x for x in told.get("invocations", []) if x["status"] != "ok"],
        }
    hidden = [r["project"] for r in known.filter("holdout").select("project").collect()]
    holdout = "project IN (" + ", ".join("'" + x.replace("'", "''") + "'" for x in hidden) + ")" if hidden else "false"
    os.makedirs(a.out, exist_ok=True)
    with open(os.path.join(a.out, "results.md"), "w", encoding="utf-8") as f:
        render.write_markdown(run, f, meta)
    with open(os.path.join(a.out, "results.json"), "w", encoding="utf-8") as f:
        render.write_json(run, f, meta, holdout)
    if not a.quiet:
        left_out = rollups.unscored(known, run.inputs, run.inputs).count()
        print(render.console_summary(run, left_out))
        for r in problems.toLocalIterator():
            print(f"  warning: {r['problem']}", file=sys.stderr)
    return 0


def _project_truth(spark: SparkSession, lines: DataFrame, metadata: dict, head: dict) -> str:
    parsed = text.parse_annotations(lines)
    bad = truth.defects(parsed).take(20)
    if bad:
        raise ValueError("; ".join(f"{r['path']}:{r['line']}: {r['error']}" for r in bad))
    listed = metadata.get("file_assets") or []
    assets = spark.createDataFrame([(x["id"], x["path"], x.get("line"), x["algorithm"], x["layer"], x["cyclonedx_asset_type"], x.get("note")) for x in listed], "id string, path string, line int, algorithm string, layer int, asset_type string, note string") if listed else None
    own = {k: metadata.get(k, d) for k, d in (("build", []), ("description", ""), ("toolchain", {}))}
    entries = truth.entries(parsed, assets).withColumnRenamed("asset_type", "cyclonedx_asset_type")
    return render.truth_document({**head, **own}, entries)


def _emitted(lines: DataFrame) -> DataFrame:
    """path, content of the files without their annotations."""
    plain = F.when(F.contains("text", F.lit(text.MARK)), F.regexp_replace("text", rf"\s*(?://|/\*|#|<!--)\s*{text.MARK}\s.*$", "")).otherwise(F.col("text"))
    ordered = F.array_sort(F.collect_list(F.struct("line", plain.alias("text"))))
    return lines.groupBy("path").agg(F.array_join(F.transform(ordered, lambda x: x["text"]), "\n").alias("content"))


def _each_project(spark: SparkSession, a):
    found = [(r["language"], r["project"]) for r in inventory.discover_projects(spark, a.templates, a.metadata).collect()]
    found = [x for x in found if not getattr(a, "project", None) or x[1] in a.project]
    if not found:
        raise ValueError(f"no project below {a.templates}")
    for language, project in found:
        folder = os.path.join(a.templates, language, project)
        yield language, project, folder, inventory.project_metadata(spark, folder, a.metadata), inventory.template_lines(spark, folder, a.metadata)


def build_truth(spark: SparkSession, a) -> int:
    """Writes the projects without annotations and their ground truth; with --check, only compares with what is there."""
    wrong = 0
    for language, project, folder, metadata, lines in _each_project(spark, a):
        document = _project_truth(spark, lines, metadata, {"project": project, "language": language, "corpus_path": f"corpus/{language}/{project}"}) + "\n"
        target, shipped = os.path.join(a.truth, f"{project}.json"), os.path.join(a.out, language, project)
        binary = inventory.template_binaries(spark, folder)
        emitted = _emitted(lines).select("path", F.col("content").cast("binary").alias("content")).unionByName(binary)
        if a.check:
            have = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(shipped).select(inventory.relative_path(shipped).alias("path"), "content")
            stale = governance.generated_and_shipped(emitted, have).filter("status <> 'ok'").orderBy("path").take(20)
            for r in stale:
                print(f"{project}: {r['path']}: {r['status']}", file=sys.stderr)
            same = os.path.exists(target) and open(target, encoding="utf-8").read() == document
            wrong += bool(stale) or not same
        else:
            _write(target, document)
            for r in emitted.toLocalIterator():
                path = os.path.join(shipped, r["path"])
                os.makedirs(os.path.dirname(path), exist_ok=True)
                with open(path, "wb") as f:
                    f.write(r["content"])
        if not a.quiet:
            print(f"{project}: {json.loads(document)['asset_count']} assets")
    return int(wrong > 0)


def variant(spark: SparkSession, a) -> int:
    """Writes a holdout variant of each project and its ground truth."""
    for language, project, folder, metadata, lines in _each_project(spark, a):
        spec = metadata.get("holdout") or {}
        seed = a.seed if a.seed is not None else spec.get("seed", 0)
        name, moves = spec.get("variant_name", f"{project}-v"), spec.get("rename_files") or {}
        movable = r"^[A-Za-z0-9_.-]+\s*[:=]" if spec.get("shuffle_config", True) else None
        other = truth.variant_lines(lines, spec.get("rename_symbols") or {}, spec.get("substitutions") or [], seed, movable, bool(spec.get("shift_lines", True)))
        if moves:
            other = other.replace(moves, subset=["path"])
            metadata = {**metadata, "file_assets": [{**x, "path": moves.get(x["path"], x["path"])} for x in metadata.get("file_assets") or []]}
        head = {"project": name, "derived_from": project, "language": language, "corpus_path": f"{os.path.basename(a.out.rstrip('/'))}/{language}/{name}", "holdout": True, "seed": seed}
        _write(os.path.join(a.ground_truth_out, f"{name}.json"), _project_truth(spark, other, metadata, head) + "\n")
        target = os.path.join(a.out, language, name)
        for r in _emitted(other).select("path", F.col("content").cast("binary").alias("content")).unionByName(inventory.template_binaries(spark, folder)).toLocalIterator():
            path = os.path.join(target, moves.get(r["path"], r["path"]))
            os.makedirs(os.path.dirname(path), exist_ok=True)
            with open(path, "wb") as f:
                f.write(r["content"])
        if not a.quiet:
            print(f"{name}: seed {seed}")
    return 0


LOG = "tool string, project string, exit_code int, timed_out boolean, export_error string, payload string, stderr string, duration_sec double, left array<string>"


def collect(spark: SparkSession, a) -> int:
    """The manifest and documents of a collection run, from its configuration and the log of its invocations (JSON rows of LOG); nothing is invoked."""
    config = reports.expand(_read_json(a.config), os.environ)
    known = inventory.ground_truth(spark, a.ground_truth)
    specs = spark.createDataFrame([(t["name"], [int(x) for x in t.get("accept_exit_codes", [0])]) for t in config["tools"]], "tool string, accepted array<int>")
    grid = reports.invocation_grid(specs, known, a.tool, a.project).join(specs, "tool")
    log = grid.join(spark.read.schema(LOG).json(a.log), ["tool", "project"], "left")
    log = log.withColumn("timed_out", F.coalesce("timed_out", F.lit(False))).withColumn("bytes", F.coalesce(F.octet_length("payload"), F.lit(0))).withColumn("is_json", F.try_parse_json("payload").isNotNull())
    done = governance.invocation_status(log)
    os.makedirs(os.path.join(a.out, "cboms"), exist_ok=True)
    invocations = []
    for r in done.orderBy("tool", "project").toLocalIterator():  # a document at a time
        row = {k: r[k] for k in ("tool", "project", "language", "status", "exit_code", "duration_sec", "bytes")}
        row |= {"error": r["export_error"]} if r["export_error"] else {}
        row |= {"stderr_tail": r["stderr"]} if r["stderr"] else {}
        row |= {"wrote_into_scan_tree": r["left"]} if r["left"] else {}
        if r["status"] == "ok":
            row["written"] = f"{r['project']}__{r['tool']}.json"
            _write(os.path.join(a.out, "cboms", row["written"]), r["payload"])
        invocations.append(row)
    digests = {r["table_name"]: {"entries": r["entries"], "sha256_16": r["sha256_16"]} for r in governance.table_digests(spark).collect()}
    tools = {t["name"]: {k: v for k, v in t.items() if k != "name"} for t in config["tools"]}
    _write(os.path.join(a.out, "manifest.json"), render.manifest(config.get("run", {}), invocations, judgement_tables=digests, tools=tools))
    print(f"{sum(x['status'] == 'ok' for x in invocations)}/{len(invocations)} invocations produced a document")
    return 0


def misses(spark: SparkSession, a) -> int:
    """What a tool missed, from a results file."""
    assets = inventory.results(spark, a.results).select("project", "language", "tool", F.explode("assets").alias("x")).select("project", "language", "tool", "x.*")
    if a.out:
        _write(a.out, "")
        with open(a.out, "w", encoding="utf-8") as f:
            f.writelines(render.miss_parts(assets, a.tool))
    else:
        sys.stdout.writelines(render.miss_parts(assets, a.tool))
    return 0


def withhold(spark: SparkSession, a) -> int:
    """Archives a run's documents and records their digests in its manifest; with --verify, compares the archive with them."""
    path = os.path.join(a.run, "manifest.json")
    told = _read_json(path)
    listing = lambda folder: governance.withheld_files(spark.read.format("binaryFile").option("pathGlobFilter", "*.json").load(folder))
    if a.verify:
        files = told["withheld_cboms"]["files"]
        recorded = spark.createDataFrame([(k, v["sha256"]) for k, v in files.items()], "name string, sha256 string")
        states = governance.verify(recorded, listing(a.archive)).orderBy("name").collect()
        for r in states:
            print(f"  {r['status']:<8} {r['name']}")
        return int(any(r["status"] in ("MISSING", "MISMATCH") for r in states))
    own = os.path.join(a.run, "cboms")
    os.makedirs(a.archive, exist_ok=True)
    before = listing(own)
    files = {r["name"]: {"sha256": r["sha256"], "bytes": r["bytes"]} for r in before.orderBy("name").collect()}
    for name in files:
        shutil.copy2(os.path.join(own, name), os.path.join(a.archive, name))
    if not governance.verify(before, listing(a.archive)).filter("status IN ('MISSING', 'MISMATCH')").isEmpty():
        raise ValueError("a copy differs; nothing is removed")
    told["withheld_cboms"] = {"reason": "holdout documents would show the places of planted assets", "count": len(files), "algorithm": "sha256", "verify_with": "plumbline.cli withhold --verify", "files": files}
    _write(path, json.dumps(told, indent=2) + "\n")
    if not a.keep:
        shutil.rmtree(own)
    print(f"archived {len(files)} documents")
    return 0


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="plumbline", description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    sub = p.add_subparsers(dest="command", required=True)

    def add(name, f, *required, **more):
        c = sub.add_parser(name, help=f.__doc__)
        c.set_defaults(call=f)
        for r in required:
            c.add_argument(f"--{r}", required=True)
        for k, v in more.items():
            c.add_argument("--" + k.replace("_", "-"), **v)
        return c

    flag, many = {"action": "store_true"}, {"action": "append"}
    c = add("score", score, "ground-truth", "files", "out", line_tolerance={"type": int, "default": tables.DEFAULT_TOLERANCE}, manifest={}, no_schema=flag, quiet=flag)
    one = c.add_mutually_exclusive_group(required=True)
    one.add_argument("--documents")
    one.add_argument("--bundle")
    add("build-truth", build_truth, "templates", "out", "truth", metadata={"default": METADATA}, check=flag, quiet=flag)
    add("variant", variant, "templates", "out", "ground-truth-out", metadata={"default": METADATA}, seed={"type": int}, project=many, quiet=flag)
    add("collect", collect, "config", "log", "out", "ground-truth", tool=many, project=many)
    add("misses", misses, "results", "tool", out={})
    add("withhold", withhold, "run", "archive", verify=flag, keep=flag)
    return p


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    a = parser().parse_args(argv)
    try:
        return a.call(spark or _session(), a)
    except (ValueError, OSError, KeyError, AnalysisException) as e:
        print(f"{a.command}: {e}", file=sys.stderr)
        return 1


if __name__ == "__main__":
    sys.exit(main())
