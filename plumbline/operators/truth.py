"""Ground truth from annotated templates, its checks, and holdout variants."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions import names as naming
from plumbline.functions import tables
from plumbline.functions.text import MARK, rename_words


def entries(parsed: DataFrame, file_assets: DataFrame | None = None) -> DataFrame:
    """id, file, line, algorithm, layer, layer_name, asset_type, note, accept_locations: annotations, their aliases and whole-file assets (line 1 by default)."""
    own = parsed.filter("error is null and target is null").select("id", F.col("path").alias("file"), "line", "algorithm", "layer", "asset_type", "note")
    if file_assets is not None:
        own = own.unionByName(file_assets.select("id", F.col("path").alias("file"), F.coalesce("line", F.lit(1)).alias("line"), "algorithm", "layer", "asset_type", F.coalesce("note", F.lit("")).alias("note")))
    also = parsed.filter("error is null and target is not null").groupBy(F.col("target").alias("id")).agg(F.array_sort(F.collect_list(F.struct(F.col("path").alias("file"), "line"))).alias("accept_locations"))
    titles = F.create_map(*[F.lit(x) for pair in tables.LAYER_TITLES.items() for x in pair])
    return own.join(also, "id", "left").withColumn("layer_name", titles[F.col("layer")])


def defects(parsed: DataFrame) -> DataFrame:
    """path, line, error: malformed annotations, repeated ids, aliases of unknown ids or of their own place."""
    bad = parsed.filter("error is not null").select("path", "line", "error")
    own = parsed.filter("error is null and target is null")
    twice = own.join(own.groupBy("id").count().filter("count > 1").select("id"), "id", "left_semi").select("path", "line", F.lit("repeated id").alias("error"))
    alias = parsed.filter("error is null and target is not null").select("path", "line", F.col("target").alias("id"))
    lost = alias.join(own.select("id"), "id", "left_anti").select("path", "line", F.lit("alias of an unknown id").alias("error"))
    same = alias.join(own.select("id", F.col("path").alias("_p"), F.col("line").alias("_l")), "id").filter("path = _p and line = _l").select("path", "line", F.lit("alias at the asset itself").alias("error"))
    return bad.unionByName(twice).unionByName(lost).unionByName(same)


def detectable(plants: DataFrame, lines: DataFrame, hints: tuple[str, ...] = ()) -> DataFrame:
    """plants with found: whether a token of the plant's own line (path, line, text) is compatible with its algorithm, or holds a hint."""
    own = plants.join(lines.select(F.col("path").alias("file"), "line", "text"), ["file", "line"])
    tokens = own.select("id", "algorithm", F.explode(F.regexp_extract_all("text", F.lit("[A-Za-z0-9_./-]+"), F.lit(0))).alias("name")).distinct()
    good = tokens.join(naming.compatible_pairs(plants, tokens), ["algorithm", "name"]).select("id").distinct().withColumn("_ok", F.lit(True))
    hint = F.lit(False)
    for h in hints:
        hint = hint | F.contains(F.lower("text"), F.lit(h.lower()))
    return own.join(good, "id", "left").withColumn("found", F.coalesce("_ok", F.lit(False)) | hint).drop("_ok")


def linked(plants: DataFrame, places: DataFrame, lines: DataFrame, files: DataFrame, hints: DataFrame) -> DataFrame:
    """id, held, linked of plants (id, algorithm): whether some file names the algorithm, and whether such a file holds a word of the plant's own lines.

    places: id, file, line, each plant's accepted ones; lines: path, line, text; files: path, text; hints: algorithm, hint (lower case).
    Words have four characters or more. Files are cut into words once, and the links are joins on words; a hint may be any text.
    """
    low = files.select("path", F.lower("text").alias("text"))
    wanted = plants.join(hints, "algorithm").select("id", "hint").distinct()
    # Hints and files meet by containment; the distinct hints are a table of the judgement tables' size.
    holders = low.select("path", "text").join(wanted.select("hint").distinct(), F.expr("instr(text, hint) > 0")).select("path", "hint").join(wanted, "hint").select("id", "path").distinct()
    own = places.join(lines.withColumnRenamed("path", "file"), ["file", "line"])
    symbols = own.select("id", F.explode(F.array_distinct(F.transform(F.regexp_extract_all("text", F.lit(r"([A-Za-z_][A-Za-z0-9_]{3,})"), F.lit(1)), F.lower))).alias("symbol"))
    pairs = holders.join(symbols, "id").join(low, "path").filter(F.expr("instr(text, symbol) > 0")).select("id").distinct().withColumn("linked", F.lit(True))
    held = holders.select("id").distinct().withColumn("held", F.lit(True))
    out = plants.select("id").join(held, "id", "left").join(pairs, "id", "left")
    return out.select("id", F.coalesce("held", F.lit(False)).alias("held"), F.coalesce("linked", F.lit(False)).alias("linked"))


def sample_documents(truth: DataFrame) -> DataFrame:
    """source, project, tool, raw: three sample inventories a project of ground truth.

    demo-precise places the plants of layers 1, 2 and 6 and the algorithms of 4; demo-srcfile names files without lines for layers
    1, 2, 4 and 6; demo-noisy places every second plant if of layer 1 or 3, and claims a file and an algorithm that are not there.
    """
    name = lambda a: F.concat(F.lit("crypto/"), a["id"].cast("string"))
    props = lambda kind: F.struct(kind.alias("assetType"))
    spot = lambda file, line: F.struct(F.array(F.struct(file.alias("location"), line.cast("long").alias("line"))).alias("occurrences"))
    no_evidence = F.lit(None).cast("struct<occurrences:array<struct<location:string,line:bigint>>>")
    no_list = F.lit(None).cast("array<struct<name:string,value:string>>")

    def part(ref, algorithm, kind, evidence, listed=no_list):
        return F.struct(F.lit("cryptographic-asset").alias("type"), ref.alias("bom-ref"), algorithm.alias("name"), props(kind).alias("cryptoProperties"), evidence.alias("evidence"), listed.alias("properties"))

    placed = lambda a: part(name(a), a["algorithm"], a["cyclonedx_asset_type"], spot(a["file"], a["line"]))
    bare = lambda a: part(name(a), a["algorithm"], a["cyclonedx_asset_type"], no_evidence, F.array(F.struct(F.lit("SrcFile").alias("name"), a["file"].alias("value"))))
    every_second = lambda a, i: a["layer"].isin(1, 3) & (i % 2 == 0)
    algorithm, head = F.lit("algorithm"), F.get("assets", F.lit(0))
    phantom_file = part(F.concat(F.lit("crypto/phantom-file/"), F.col("project")), F.lit("AES-256-GCM"), algorithm, spot(F.lit("src/does-not-exist.go"), F.lit(12)))
    phantom_name = part(F.concat(F.lit("crypto/phantom-algorithm/"), F.col("project")), F.lit("Blowfish-448"), algorithm, spot(head["file"], head["line"]))
    tools = {
        "demo-precise": F.transform(F.filter("assets", lambda a: a["layer"].isin(1, 2, 6) | ((a["layer"] == 4) & (a["cyclonedx_asset_type"] == "algorithm"))), placed),
        "demo-srcfile": F.transform(F.filter("assets", lambda a: a["layer"].isin(1, 2, 4, 6)), bare),
        "demo-noisy": F.concat(F.transform(F.filter("assets", every_second), placed), F.array(phantom_file, phantom_name)),
    }
    each = F.array(*[F.struct(F.lit(t).alias("tool"), c.alias("components")) for t, c in tools.items()])
    meta = F.struct(F.struct(F.array(F.struct(F.lit("application").alias("type"), F.col("s.tool").alias("name"), F.lit("0.0.0-demo").alias("version"))).alias("components")).alias("tools"))
    raw = F.to_json(F.struct(F.lit("CycloneDX").alias("bomFormat"), F.lit("1.6").alias("specVersion"), F.lit(1).alias("version"), meta.alias("metadata"), F.col("s.components").alias("components")))
    out = truth.select("project", F.explode(each).alias("s"))
    return out.select(F.concat_ws("__", "project", "s.tool").alias("source"), "project", F.col("s.tool").alias("tool"), raw.alias("raw"))


def key_material(files: DataFrame) -> DataFrame:
    """Adds is_key to binary files: a PEM header in the first 400 bytes, a DER sequence, or a JKS magic number."""
    content = F.col("content")
    head = F.substring(content, 1, 400)
    pem = F.contains(head.cast("string"), F.lit("-----BEGIN"))
    lead = F.hex(F.substring(content, 1, 4))
    return files.withColumn("is_key", F.coalesce(pem, F.lit(False)) | lead.startswith("30") | (lead == "FEEDFEED"))


def _split_annotation(text: Column) -> tuple[Column, Column]:
    """(code, annotation with the comment's beginning) of a line; the annotation is empty where the line has no mark after a comment's beginning."""
    mark = F.instr(text, MARK)
    before = F.substring(text, F.lit(1), mark - 1)
    last = lambda d: F.length(before) - F.length(F.substring_index(before, d, -1)) - len(d)
    at = F.coalesce(*[F.when((mark > 0) & F.contains(before, F.lit(d)), last(d)) for d in ("/*", "//", "#", "<!--")])
    return F.when(at.isNull(), text).otherwise(F.substring(text, F.lit(1), at)), F.when(at.isNull(), F.lit("")).otherwise(F.substring(text, at + 1, F.length(text)))


def substituted(text: Column, rules: list[dict[str, str]]) -> Column:
    """A line with rules (from, to, from_algorithm, to_algorithm) applied in order: the code's text and what its annotation says of it."""
    for rule in rules:
        old, new = rule["from"], rule["to"]
        old_name, new_name = rule.get("from_algorithm", old), rule.get("to_algorithm", new)
        code, note = _split_annotation(text)
        told = F.replace(note, F.lit(old_name), F.lit(new_name))
        told = F.replace(told, F.lit(old), F.lit(new)) if old != old_name else told
        text = F.when(F.contains(text, F.lit(old)), F.concat(F.replace(code, F.lit(old), F.lit(new)), told)).otherwise(text)
    return text


#: How a header's lines begin, by file suffix.
HEADERS = ((r"\.(go|java|js|ts|rs|c|h)$", "//"), (r"\.(py|yaml|yml|conf|toml|properties|cfg|options)$", "#"))
HEADER = (" Written as a variant; edits are lost.", "", " The same program as its original, with other names and another layout.")


def shifted(lines: DataFrame) -> DataFrame:
    """path, line, text with a header of comment lines and an empty one at the top, after a shebang, where the file's kind has such comments."""
    style = F.coalesce(*[F.when(F.lower("path").rlike(suffix), F.lit(sign)) for suffix, sign in HEADERS])
    tops = lines.groupBy("path").agg(F.coalesce(F.bool_or((F.col("line") == 1) & F.startswith("text", F.lit("#!"))), F.lit(False)).alias("_keep")).withColumn("_style", style)
    n = len(HEADER) + 1
    moved = lines.join(tops, "path").withColumn("line", F.when(F.col("_style").isNotNull() & ((F.col("line") > 1) | ~F.col("_keep")), F.col("line") + n).otherwise(F.col("line")))
    text = F.array(*[F.concat("_style", F.lit(x)) for x in HEADER], F.lit(""))
    new = tops.filter("_style is not null").select("path", "_keep", F.posexplode(text).alias("pos", "text"))
    return moved.select("path", "line", "text").unionByName(new.select("path", (F.col("pos") + 1 + F.col("_keep").cast("int")).cast(lines.schema["line"].dataType).alias("line"), "text"))


def variant_lines(lines: DataFrame, renames: dict[str, str], substitutions: list[dict[str, str]], seed: int, movable: str | None = None, shift: bool = False) -> DataFrame:
    """A holdout variant: words renamed, texts substituted in order, runs of movable lines shuffled by a seeded hash, a header put on top.

    The order within a run is by hash, so it is another variant than one a sequential generator would give, but as repeatable.
    """
    from pyspark.sql import Window

    from plumbline.functions.text import islands

    out = lines.withColumn("text", substituted(rename_words(F.col("text"), renames), substitutions))
    if movable is not None:
        kinded = islands(out.withColumn("_kind", F.col("text").rlike(movable)), ["path"], "line", "_kind")
        w = Window.partitionBy("path", "island")
        moved = F.row_number().over(w.orderBy(F.xxhash64(F.lit(seed), "line"))) + F.min("line").over(w) - 1
        out = kinded.withColumn("line", F.when(F.col("_kind"), moved).otherwise(F.col("line"))).select(*lines.columns)
    return shifted(out) if shift else out
