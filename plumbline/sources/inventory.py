"""Readers: inventory documents, ground truth, file listings, bundles, manifests.

Documents are read as bytes, decoded leniently and keyed by `source`; nothing
about one broken document stops the others. Dimensions that would silently
turn every figure to zero (no projects, an empty file listing) raise instead.
"""

from __future__ import annotations

import io
import json
import zipfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.functions import paths

TRUTH = """project string, language string, corpus_path string, description string, build array<string>, toolchain map<string,string>,
layer_counts map<string,int>, asset_count int, derived_from string, holdout boolean, seed int,
assets array<struct<id:string,file:string,line:int,algorithm:string,layer:int,layer_name:string,cyclonedx_asset_type:string,note:string,
accept_locations:array<struct<file:string,line:int>>>>"""

#: Folders that no file listing follows.
SKIPPED = (".git", "node_modules", "target", "dist", "__pycache__", ".venv")


def lenient_text(content: Column) -> Column:
    """Bytes as text, malformed sequences replaced."""
    return F.make_valid_utf8(content.cast("string"))


def ground_truth(spark: SparkSession, folder: str) -> DataFrame:
    """One row a project. Raises where the folder is missing or holds no project; of equal projects the last file wins."""
    docs = spark.read.schema(TRUTH).option("multiLine", True).option("pathGlobFilter", "*.json").json(folder)
    docs = docs.withColumn("_file", F.input_file_name()).filter("project is not null")
    last = docs.groupBy("project").agg(F.max("_file").alias("_file"))
    out = docs.join(last, ["project", "_file"]).drop("_file")
    if out.isEmpty():
        raise ValueError(f"no ground truth in {folder}")
    return out


def plants(truth: DataFrame) -> DataFrame:
    """project, language, id, file, line, algorithm, layer, asset_type, note: one row a planted asset."""
    each = truth.select("project", "language", F.explode("assets").alias("a"))
    return each.select("project", "language", "a.id", "a.file", "a.line", "a.algorithm", "a.layer", F.col("a.cyclonedx_asset_type").alias("asset_type"), "a.note")


def accepted_locations(truth: DataFrame) -> DataFrame:
    """project, id, file, line: each plant's own location and its declared alternatives."""
    each = truth.select("project", F.explode("assets").alias("a"))
    own = each.select("project", "a.id", "a.file", "a.line")
    return own.unionByName(each.select("project", "a.id", F.explode("a.accept_locations").alias("x")).select("project", "id", "x.file", "x.line"))


def relative_path(root: str) -> Column:
    """A file's path below the root folder, percent-decoded."""
    path = F.try_url_decode(F.regexp_replace(F.col("path"), r"\+", "%2B"))
    plain = F.regexp_replace(F.coalesce(path, F.col("path")), "^[a-z0-9]+:/+", "/")
    return F.regexp_replace(F.substring_index(F.concat(F.lit("/"), plain), "/" + root.strip("/") + "/", -1), "^/+", "")


def documents(spark: SparkSession, root: str) -> DataFrame:
    """source (path below the root), raw: every *.json below a folder."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.json").load(root)
    return files.select(relative_path(root).alias("source"), lenient_text(F.col("content")).alias("raw"))


def _unzip(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for content in batch.column(0):
            with zipfile.ZipFile(io.BytesIO(content.as_py())) as archive:
                for name in sorted(archive.namelist()):
                    if name.endswith(".json"):
                        yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([archive.read(name).decode("utf-8", "replace")])], names=["source", "raw"])


def bundle_documents(spark: SparkSession, path: str) -> DataFrame:
    """source, raw of a bundle: a folder or a zip archive."""
    if not path.endswith(".zip"):
        return documents(spark, path)
    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(_unzip, "source string, raw string")


def _assigned(found: DataFrame, truth: DataFrame, problem: Column) -> tuple[DataFrame, DataFrame]:
    """(inputs, problems) of documents with tool and candidate."""
    known = truth.select("project", "language")
    matched = paths.match_project(found, known).join(known, "project", "left")
    good = F.col("project").isNotNull() & (F.coalesce(F.col("tool"), F.lit("")) != "")
    return matched.filter(good).select("source", "project", "language", "tool", "raw"), matched.filter(~good).select("source", problem.alias("problem"))


def raw_inputs(spark: SparkSession, root: str, truth: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(inputs: source, project, language, tool, raw; problems) of <project>__<tool>.json or <tool>/<project>.json files."""
    parts = F.split("source", "/")
    stem = F.regexp_replace(F.element_at(parts, -1), r"\.json$", "")
    cut = F.instr(stem, "__")
    named = documents(spark, root).withColumn("candidate", F.when(cut > 0, F.substring(stem, F.lit(1), cut - 1)).when(F.size(parts) >= 2, stem).otherwise(""))
    named = named.withColumn("tool", F.when(cut > 0, F.trim(F.substring(stem, cut + 2, F.length(stem)))).when(F.size(parts) >= 2, F.element_at(parts, -2)))
    return _assigned(named, truth, F.concat("source", F.lit(": cannot tell project and tool apart")))


def bundle_inputs(spark: SparkSession, path: str, truth: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(inputs, problems) of a bundle: the tool is the folder above the file, whose stem may end in _<tool>."""
    parts = F.split("source", "/")
    tool = F.when(F.size(parts) >= 2, F.element_at(parts, -2))
    stem = F.regexp_replace(F.element_at(parts, -1), r"\.json$", "")
    bare = F.when(F.endswith(stem, F.concat(F.lit("_"), tool)), F.substring(stem, F.lit(1), F.length(stem) - F.length(tool) - 1)).otherwise(stem)
    named = bundle_documents(spark, path).withColumn("tool", tool).withColumn("candidate", F.when(tool.isNull(), "").otherwise(bare))
    return _assigned(named, truth, F.concat("source", F.lit(": no known project and tool")))


def project_files(spark: SparkSession, folder: str, truth: DataFrame) -> DataFrame:
    """project, path: the listing below each project's corpus_path. Raises where a project has no file.

    Only paths are selected, so file contents aren't read.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder).select(relative_path(folder).alias("path"))
    base = truth.select("project", F.regexp_replace("corpus_path", "^corpus/+|/+$", "").alias("base"))
    below = files.withColumn("base", F.array_join(F.slice(F.split("path", "/"), 1, 2), "/")).join(base, "base")
    inner = below.select("project", F.expr("substring(path, length(base) + 2)").alias("path"))
    out = inner.filter(~F.arrays_overlap(F.split("path", "/"), F.array(*map(F.lit, SKIPPED))))
    bare = truth.select("project").join(out, "project", "left_anti")
    if (lost := [r["project"] for r in bare.limit(5).collect()]):
        raise ValueError(f"no files for {', '.join(lost)} below {folder}")
    return out


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """A run manifest as one row."""
    return spark.read.option("multiLine", True).json(path)


def discover_projects(spark: SparkSession, folder: str, metadata_name: str) -> DataFrame:
    """language, project: the folders two levels below the root that hold a metadata file, by name."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", metadata_name).load(folder).select(relative_path(folder).alias("path"))
    parts = F.split("path", "/")
    return files.filter(F.size(parts) == 3).select(F.element_at(parts, 1).alias("language"), F.element_at(parts, 2).alias("project")).orderBy("language", "project")


def project_metadata(spark: SparkSession, folder: str, metadata_name: str) -> dict:
    """A project's metadata. Raises where the file is missing or no object; a project's file is small by nature."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", metadata_name).load(folder).select(lenient_text(F.col("content"))).take(1)
    if not found:
        raise ValueError(f"no {metadata_name} in {folder}")
    out = json.loads(found[0][0])
    if not isinstance(out, dict):
        raise ValueError(f"{metadata_name} in {folder} is no object")
    return out


#: The part of a results file that reports read again.
RESULTS = """meta map<string,string>, results array<struct<project:string,language:string,tool:string,source:string,detected:bigint,total:bigint,
assets:array<struct<id:string,algorithm:string,layer:int,asset_type:string,format:string,detected:boolean,located:boolean,file_only:boolean,name_only:boolean>>>>"""


def results(spark: SparkSession, path: str) -> DataFrame:
    """project, language, tool, source, detected, total, assets: the documents of a results file (or a folder of them), as `render.write_json` writes them."""
    return spark.read.schema(RESULTS).option("multiLine", True).json(path).select(F.explode("results").alias("r")).select("r.*")


#: Files of templates that are copied byte by byte.
BINARY = r"(?i)\.(pem|p12|der|jks|key|crt|png|jar|zip)$"


def template_binaries(spark: SparkSession, folder: str) -> DataFrame:
    """path, content of the template files that have no lines."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder).select(relative_path(folder).alias("path"), "content")
    return files.filter(F.col("path").rlike(BINARY))


def template_lines(spark: SparkSession, folder: str, metadata_name: str) -> DataFrame:
    """path (below the folder), line (from 1), text: text files of a template tree without its metadata files."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder).withColumn("path", relative_path(folder))
    skip = (".git", "__pycache__", "node_modules", "target", "build", ".gradle")
    kept = files.filter(~F.arrays_overlap(F.split("path", "/"), F.array(*map(F.lit, skip)))).filter(F.element_at(F.split("path", "/"), -1) != metadata_name)
    text = kept.filter(~F.col("path").rlike(BINARY)).select("path", F.posexplode(F.split(lenient_text(F.col("content")), "\n")).alias("pos", "text"))
    return text.select("path", (F.col("pos") + 1).alias("line"), "text")
