"""Reports: Markdown, JSON, the miss list, the console's summary and the manifest.

Tables a tool or a language are collected; rows a document or an asset come to
the driver one partition at a time and are written as they come, so a report of
many documents needs no more memory than one of few.
"""

from __future__ import annotations

import io
import json
import re
from collections.abc import Iterator
from decimal import ROUND_HALF_EVEN, Decimal
from typing import TextIO

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.functions import paths, tables
from plumbline.operators import rollups
from plumbline.operators.run import Run

#: Characters of a failure's detail, paths of what a run left behind, and last lines of its messages that are shown.
DETAIL_CHARS, LEFT_PATHS, LAST_LINES = 80, 20, 6


def percent(hit: int, total: int) -> str:
    """"12% (1/8)", rounded half to even; "--" without a total."""
    if not total:
        return "--"
    return f"{(Decimal(100 * hit) / Decimal(total)).quantize(Decimal(1), ROUND_HALF_EVEN)}% ({hit}/{total})"


def markdown_table(headers: list[str], rows: list[list]) -> str:
    if not rows:
        return "_No data._"
    cells = [[str(c) for c in r] for r in [headers, *rows]]
    widths = [max(len(r[i]) for r in cells) for i in range(len(headers))]
    line = lambda r: "| " + " | ".join(c.ljust(w) for c, w in zip(r, widths, strict=True)) + " |"
    return "\n".join([line(cells[0]), "|" + "|".join("-" * (w + 2) for w in widths) + "|", *map(line, cells[1:])])


def provenance(meta: dict) -> str:
    """What produced the figures, from the manifest's run (`meta["run"]`): the run, tool versions, digests of the judgement tables, failures."""
    run = meta.get("run")
    if not run:
        return "## Provenance\n\n> No run manifest was given, so these results record no versions."
    rows = [
        ["run started", run.get("started_utc") or "--"], ["commit", run.get("corpus_commit") or "--"], ["uncommitted changes", "yes: not to be published" if run.get("corpus_tree_dirty") else "no"],
        ["manifest", run.get("manifest") or "--"], ["line tolerance", meta.get("line_tolerance")], ["invocations", f"{run.get('succeeded', '?')} of {run.get('attempted', '?')} produced a document"],
    ]
    parts = ["## Provenance", markdown_table(["", ""], rows)]
    if versions := run.get("tool_versions"):
        parts += ["### Tool versions", markdown_table(["tool", "version"], [[k, v or "--"] for k, v in sorted(versions.items())])]
    if now := run.get("judgement_tables"):
        then = run.get("judgement_tables_collected") or {}
        old = lambda k: then.get(k) or {}
        state = lambda k, v: "same" if old(k).get("sha256_16") == v.get("sha256_16") else f"{old(k).get('entries', '?')} entries, {old(k).get('sha256_16', '?')}"
        rows = [[k, v.get("entries", "?"), v.get("sha256_16", "?"), *([state(k, v)] if then else [])] for k, v in sorted(now.items())]
        parts += ["### Judgement tables", markdown_table(["table", "entries", "sha256/16", *(["then"] if then else [])], rows)]
    if failed := run.get("failed_invocations"):
        detail = lambda f: (f.get("error") or f.get("stderr_tail") or "")[:DETAIL_CHARS]
        parts += ["### Invocations without a document", markdown_table(["tool", "project", "status", "detail"], [[f["tool"], f["project"], f["status"], detail(f)] for f in failed])]
    return "\n\n".join(parts)


def _streamed(headers: list[str], rows: Iterator[list]) -> Iterator[str]:
    """A Markdown table a row at a time; its cells aren't padded, as no row waits for the others."""
    yield "| " + " | ".join(headers) + " |\n|" + "---|" * len(headers) + "\n"
    for r in rows:
        yield "| " + " | ".join(map(str, r)) + " |\n"


def markdown_parts(run: Run, meta: dict | None = None, title: str = "Results") -> Iterator[str]:
    tools = [r.asDict() for r in rollups.per_tool(run.results).orderBy("tool").collect()]
    language = {(r["tool"], r["language"]): percent(r["detected"], r["total"]) for r in rollups.by_language(run.verdicts).collect()}
    languages = sorted({k for _, k in language if k != "all"})
    cell = lambda x: percent(x["detected"], x["total"]) if x else "--"
    layers = {r["tool"]: r["by_layer"] for r in rollups.layer_rates(run.verdicts).collect()}
    both = {(r["language"], r["tool"]): r["by_layer"] for r in rollups.layer_rates(run.verdicts, ("language", "tool")).collect()}
    weak = {r["tool"]: r for r in rollups.weaker_rules(run.verdicts).collect()}
    flags, titles = ("located", "file_only", "name_only"), [str(i) for i in tables.LAYER_TITLES]
    line = lambda by: [cell(by.get(i)) for i in titles]
    names = ["tool", *[f"L{i}" for i in titles]]
    share = lambda t: "not run" if not t["validated"] else percent(t["valid"], t["validated"])
    per_component = lambda t: f"{Decimal(t['total_occurrences']) / Decimal(t['crypto_components']):.2f}" if t["crypto_components"] else "--"
    parts = [
        f"# {title}", provenance(meta or {}),
        "## Detected by language", markdown_table(["tool", "all", *languages], [[t["tool"], language.get((t["tool"], "all"), "--"), *[language.get((t["tool"], k), "--") for k in languages]] for t in tools]),
        "## Detected by layer", markdown_table(names, [[t["tool"], *line(layers.get(t["tool"], {}))] for t in tools]),
        "## Detected by language and layer", *[x for k in languages for x in (f"### {k}", markdown_table(names, [[t["tool"], *line(both[k, t["tool"]])] for t in tools if (k, t["tool"]) in both]))],
        "## Evidence", markdown_table(["tool", "components", "with location", "with line", "as occurrences", "as properties only", "occurrences per component", "locations not found"], [
            [t["tool"], t["crypto_components"], *[percent(t[c], t["crypto_components"]) for c in ("with_location", "with_line", "using_spec_evidence")], t["using_properties_only"], per_component(t), t["unresolvable_locations"]] for t in tools]),
        "## Weaker rules", markdown_table(["tool", *flags], [[t["tool"], *[percent(weak[t["tool"]][f], weak[t["tool"]]["total"]) for f in flags]] for t in tools if t["tool"] in weak]),
        "## Precision", markdown_table(["tool", "claim precision", "component precision", "claims", "components", "recall"], [
            [t["tool"], percent(t["credited_claims"], t["distinct_claims"]), percent(t["matched_components"], t["crypto_components"]), t["distinct_claims"], t["crypto_components"], percent(t["detected"], t["total"])] for t in tools]),
        "## Validity and false positives", markdown_table(["tool", "schema valid", "phantom location", "phantom algorithm", "total", "unmatched", "unreadable"], [
            [t["tool"], share(t), t["phantom_location"], t["phantom_algorithm"], t["false_positives"], t["unmatched_reports"], t["parse_errors"]] for t in tools]),
        "## Per project",
    ]
    yield "\n\n".join(parts) + "\n\n"
    per = run.results.join(rollups.layer_text(run.verdicts), "source", "left").orderBy("language", "project", "tool").select("project", "language", "tool", "detected", "total", "by_layer", "false_positives")
    yield from _streamed(["project", "language", "tool", "detected", "by layer", "FP"], ([r["project"], r["language"], r["tool"], percent(r["detected"], r["total"]), r["by_layer"] or "", r["false_positives"]] for r in per.toLocalIterator()))
    invalid = F.when(F.size("schema_errors") > 0, F.array_join("schema_errors", "; "))
    bad = run.results.select("source", F.coalesce("parse_error", invalid).alias("problem")).filter("problem is not null").orderBy("source")
    for i, r in enumerate(bad.toLocalIterator()):
        yield ("\n## Problems\n\n| document | problem |\n|---|---|\n" if i == 0 else "") + f"| {r['source']} | {r['problem']} |\n"


def write_markdown(run: Run, out: TextIO, meta: dict | None = None, title: str = "Results") -> None:
    for part in markdown_parts(run, meta, title):
        out.write(part)


def render_markdown(run: Run, title: str = "Results", meta: dict | None = None) -> str:
    return "".join(markdown_parts(run, meta, title))


def asset_entries(verdict: DataFrame, holdout: str = "false") -> DataFrame:
    """source, assets: each document's verdicts in order of id; a held-out project shows neither file nor line, but the file's format."""
    shown = rollups.suppressed(verdict.withColumn("format", paths.file_format("file")), holdout)
    entry = F.struct("id", "algorithm", "layer", "asset_type", "format", "file", "line", "detected", "located", "file_only", "name_only", "matched_component")
    return shown.groupBy("source").agg(F.array_sort(F.collect_list(entry)).alias("assets"))


def json_results(run: Run, holdout: str = "false") -> DataFrame:
    """source, value: the JSON of each document's result, made on the executors."""
    layers = rollups.layer_rates(run.verdicts, ("source",))
    each = run.results.join(layers, "source", "left").join(asset_entries(run.verdicts, holdout), "source", "left")
    return each.select("source", F.to_json(F.struct(*each.columns)).alias("value"))


def write_json(run: Run, out: TextIO, meta: dict, holdout: str = "false") -> None:
    """{meta, tools, results}: one entry a tool and one a document, a document at a time."""
    layers = {r["tool"]: {k: v.asDict() for k, v in r["by_layer"].items()} for r in rollups.layer_rates(run.verdicts).collect()}
    tools = {r["tool"]: {**r.asDict(), "by_layer": layers.get(r["tool"], {})} for r in rollups.per_tool(run.results).orderBy("tool").collect()}
    out.write(f'{{"meta": {json.dumps(meta)},\n"tools": {json.dumps(tools)},\n"results": [')
    for i, r in enumerate(json_results(run, holdout).orderBy("source").toLocalIterator()):
        out.write(("," if i else "") + "\n" + r["value"])
    out.write("\n]}\n")


def render_json(run: Run, meta: dict, holdout: str = "false") -> str:
    out = io.StringIO()
    write_json(run, out, meta, holdout)
    return out.getvalue()


def console_summary(run: Run, unscored: int = 0) -> str:
    """A line a tool: detection rate and false positives, and how many pairs were left out rather than counted as zero."""
    tools = rollups.per_tool(run.results).orderBy("tool").collect()
    rate = lambda t: percent(t["detected"], t["total"]).partition(" ")[0]
    lines = [f"scored {sum(t['documents'] for t in tools)} documents of {len(tools)} tools"]
    lines += [f"  {t['tool']:<20} {rate(t):>5} ({t['detected']}/{t['total']})  false positives: {t['false_positives']}" for t in tools]
    return "\n".join([*lines, *([f"  {unscored} pairs of project and tool have no document; they are left out, not zero"] if unscored else [])])


def miss_parts(assets: DataFrame, tool: str) -> Iterator[str]:
    """The undetected assets of a tool by layer, without their places. `assets` has project, language, tool, id, algorithm, layer, asset_type, format and the flags."""
    own = assets.filter(F.col("tool") == tool)
    counts = {r["layer"]: (r["n"], r["lost"]) for r in own.groupBy("layer").agg(F.count(F.lit(1)).alias("n"), F.count_if(~F.col("detected")).alias("lost")).collect()}
    if not counts:
        raise ValueError(f"no results of {tool}")
    yield f"# What {tool} missed\n\n{sum(x for _, x in counts.values())} of {sum(n for n, _ in counts.values())} assets.\n"
    flags = ("located", "file_only", "name_only")
    headers = ["project", "language", "format", "id", "algorithm", "asset type", *flags]
    for layer, title in tables.LAYER_TITLES.items():
        yield f"\n## {title[0].upper()}{title[1:]}: {counts.get(layer, (0, 0))[1]}\n\n"
        lost = own.filter((F.col("layer") == layer) & ~F.col("detected")).orderBy("project", "id")
        yield from _streamed(headers, ([r["project"], r["language"], r["format"], r["id"], r["algorithm"], r["asset_type"], *["yes" if r[f] else "no" for f in flags]] for r in lost.toLocalIterator()))


def render_misses(run: Run, tool: str) -> str:
    return "".join(miss_parts(run.verdicts.withColumn("format", paths.file_format("file")), tool))


def scrubbed(value):
    """A manifest's value with absolute paths outside of it replaced in every text."""
    if isinstance(value, dict):
        return {k: scrubbed(v) for k, v in value.items()}
    if isinstance(value, list):
        return [scrubbed(v) for v in value]
    if not isinstance(value, str):
        return value
    if value.startswith("/"):
        return "<external>/" + value.rstrip("/").rpartition("/")[2]
    return re.sub(r"(?<![\w:/])/(?:[A-Za-z0-9_.+-]+/)+([A-Za-z0-9_.+-]+)", r"<external>/\1", value)


def manifest(run: dict, invocations: list[dict], **more) -> str:
    """A run's manifest: how many invocations gave a document, and each of them, without paths of the machine it ran on."""
    shown = [{**x, **({"wrote_into_scan_tree": sorted(x["wrote_into_scan_tree"])[:LEFT_PATHS]} if x.get("wrote_into_scan_tree") else {}), **({"stderr_tail": "\n".join(x["stderr_tail"].splitlines()[-LAST_LINES:])} if x.get("stderr_tail") else {})} for x in invocations]
    head = {**run, "succeeded": sum(x["status"] == "ok" for x in shown), "attempted": len(shown)}
    return json.dumps(scrubbed({"run": head, **more, "invocations": shown}), indent=2) + "\n"


def cbom_document(components: DataFrame) -> str:
    """An inventory document of components (name, ref, places)."""
    place = F.transform("places", lambda p: F.struct(p["file"].alias("location"), p["line"].alias("line")))
    rows = components.orderBy("name").select(F.to_json(F.struct(F.lit("cryptographic-asset").alias("type"), "name", F.col("ref").alias("bom-ref"), F.struct(F.lit("algorithm").alias("assetType")).alias("cryptoProperties"), F.struct(place.alias("occurrences")).alias("evidence")))).collect()
    return json.dumps({"bomFormat": "CycloneDX", "specVersion": "1.6", "version": 1, "components": [json.loads(r[0]) for r in rows]}, indent=2)


def truth_document(project: dict, entries: DataFrame) -> str:
    """A ground-truth document: a project's metadata and its entries by file and line. Raises where a layer has no entry."""
    rows = [r.asDict(recursive=True) for r in entries.orderBy("file", "line").collect()]
    bare = [i for i in tables.LAYER_TITLES if all(r["layer"] != i for r in rows)]
    if bare:
        raise ValueError(f"no planted asset in layers {bare}")
    keep = lambda r: {k: v for k, v in r.items() if not (k in ("note", "accept_locations") and not v)}
    counts = {str(i): sum(r["layer"] == i for r in rows) for i in tables.LAYER_TITLES}
    return json.dumps({**project, "layer_counts": counts, "asset_count": len(rows), "assets": [keep(r) for r in rows]}, indent=2)
