"""Inventory documents taken apart: components, names and occurrences, with VARIANT.

A document is a unit of its own: nothing is numbered, joined or limited across
documents. Components that hold no others are exploded natively; a document with
nested components is walked with a stack by the task that holds it, however many
components it has. JSON of more than 1,000 levels is invalid to Spark's parser.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions import tables
from plumbline.functions.names import strip
from plumbline.operators.split import Split, finite
from plumbline.sources.stored import cut

UNWRAPS = 8


def _kind(v: str | Column) -> Column:
    return F.coalesce(F.schema_of_variant(F.col(v) if isinstance(v, str) else v), F.lit("VOID"))


def _is_object(v) -> Column:
    return _kind(v).startswith("OBJECT")


def _is_array(v) -> Column:
    return _kind(v).startswith("ARRAY")


def text_at(v: Column, path: str) -> Column:
    """The trimmed string at a path; null where it is no string or blank."""
    inner = F.try_variant_get(v, path, "variant")
    value = strip(F.try_variant_get(v, path, "string"))
    return F.when((_kind(inner) == "STRING") & (value != ""), value)


def parse(inputs: DataFrame) -> DataFrame:
    """Adds bom (VARIANT object or null) and parse_error to inputs with raw. Wrappers are peeled up to eight times."""
    def peel(v: Column, _) -> Column:
        inner = F.try_variant_get(v, "$.bom", "variant")
        return F.when(_is_array(v), F.try_variant_get(v, "$[0]", "variant")).when(_is_object(v) & _is_object(inner), inner).otherwise(v)

    # One lambda applied eight times: the expression does not grow with the number of wrappers.
    df = inputs.withColumn("bom", F.try_parse_json("raw")).withColumn("_bad", F.col("bom").isNull())
    df = df.withColumn("bom", F.aggregate(F.sequence(F.lit(1), F.lit(UNWRAPS)), F.col("bom"), peel))
    usable = _is_object("bom") & (_kind("bom") != "OBJECT<>")
    df = df.withColumn("parse_error", F.when(F.col("_bad"), F.lit("invalid JSON")).when(~usable, F.lit("document contains no BOM object")))
    return df.withColumn("bom", F.when(usable, F.col("bom"))).drop("_bad", "raw")


def _elements(v: Column, path: str) -> Column:
    """The objects in the array at a path, each with its place; null where there is no array."""
    listed = F.transform(F.try_variant_get(v, path, "array<variant>"), lambda x, i: F.struct(i.alias("pos"), x.alias("value")))
    return F.filter(listed, lambda x: _is_object(x["value"]))


#: What is read of a component; the components below it are nodes of their own.
READ = ("type", "name", "version", "cryptoProperties", "evidence", "properties")
#: Components that the walker hands over at a time.
WALK_ROWS = 2000
#: Or so many characters of them.
WALK_BYTES = 4 << 20


def _walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """source, index, node of the components of documents, the last sibling first, nodes before their children."""
    for batch in batches:
        for source, raw in zip(batch.column(0), batch.column(1), strict=True):
            stack, index, nodes = list(json.loads(raw.as_py(), parse_float=finite)["components"]), 0, []
            while stack:
                node = stack.pop()
                if not isinstance(node, dict):
                    continue
                nodes.append(json.dumps({k: node[k] for k in READ if k in node}))
                below = node.get("components")
                if isinstance(below, list):
                    stack.extend(below)
                if len(nodes) == WALK_ROWS or not stack:
                    yield pa.RecordBatch.from_arrays([pa.repeat(source, len(nodes)).cast(pa.string()), pa.array(range(index, index + len(nodes)), pa.int32()), pa.array(nodes, pa.string())], names=["source", "index", "node"])
                    index, nodes = index + len(nodes), []
            if nodes:
                yield pa.RecordBatch.from_arrays([pa.repeat(source, len(nodes)).cast(pa.string()), pa.array(range(index, index + len(nodes)), pa.int32()), pa.array(nodes, pa.string())], names=["source", "index", "node"])


def components(parsed: DataFrame) -> DataFrame:
    """source, index, node: every component. The index follows a walk with the last sibling first, nodes before their children."""
    docs = parsed.filter("bom is not null").select("source", "bom", _elements(F.col("bom"), "$.components").alias("parts")).filter(F.size("parts") > 0)
    nested = F.exists("parts", lambda x: _is_array(F.try_variant_get(x["value"], "$.components", "variant")))
    flat = docs.filter(~nested).select("source", F.posexplode(F.reverse("parts")).alias("index", "part")).select("source", "index", F.col("part.value").alias("node"))
    deep = docs.filter(nested).select("source", F.to_json("bom").alias("raw")).mapInArrow(_walk, "source string, index int, node string")
    return flat.unionByName(deep.select("source", "index", F.parse_json("node").alias("node")))


#: What comes out of a document in pieces: of a list's element a node a row, `through` being the nodes up to its end, or a text that must be JSON
#: (index null); of the document its shell (list null) and the nodes of each of its lists.
SPLIT = "source string, list int, through long, index int, text string, totals array<long>"
_SPLIT = pa.schema([("source", pa.string()), ("list", pa.int32()), ("through", pa.int64()), ("index", pa.int32()), ("text", pa.string()), ("totals", pa.list_(pa.int64()))])


def _below(top: dict) -> Iterator[str]:
    """The nodes of a component, as `_walk` gives them."""
    stack = [top]
    while stack:
        node = stack.pop()
        if isinstance(node, dict):
            yield json.dumps({k: node[k] for k in READ if k in node})
            if isinstance(node.get("components"), list):
                stack.extend(node["components"])


def _split_rows(source: str, pieces: Iterator[str]) -> Iterator[tuple]:
    doc, totals = Split(pieces), []
    try:
        for number, value, text in doc.elements():
            totals += [0] * (number + 1 - len(totals))
            nested = isinstance(value, dict) and isinstance(value.get("components"), list)
            nodes = list(_below(value)) if nested else [text] if isinstance(value, dict) else []
            totals[number] += len(nodes)
            for i, node in enumerate(nodes):
                yield source, number, totals[number], i, node, None
            if len(nodes) != 1 or nested:
                yield source, number, None, None, text, None
    except (ValueError, RecursionError):
        yield source, None, None, None, None, None
        return
    yield source, None, None, None, doc.shell, totals + [0] * (doc.lists - len(totals))


def _split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Splits documents whose pieces (source, text) come in order."""
    each = ((s, t or "") for b in batches for s, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True))
    rows, size = [], 0
    batch = lambda: pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _SPLIT, strict=True)], schema=_SPLIT)
    for source, pieces in groupby(each, lambda x: x[0]):
        for row in _split_rows(source, (t for _, t in pieces)):
            rows.append(row)
            size += len(row[4] or "")
            if len(rows) == WALK_ROWS or size > WALK_BYTES:
                yield batch()
                rows, size = [], 0
    if rows:
        yield batch()


def shred_pieces(inputs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(parsed, components) as `parse` and `components` give them, of documents in pieces: a row a piece, `piece` its place, `raw` its text.

    No task holds a document, so its length has no limit; the bom that is returned lacks the components.
    """
    spark = inputs.sparkSession
    dealt = inputs.select("source", F.col("raw").cast("string").alias("text"), "piece").repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "source").sortWithinPartitions("source", "piece")
    found = dealt.select("source", "text").mapInArrow(_split, SPLIT)
    found = found.select("source", "list", "through", "index", F.when(F.col("list").isNotNull(), F.try_parse_json("text")).alias("node"), F.when(F.col("list").isNull(), F.col("text")).alias("shell"), "totals")
    found = cut(found, "split")
    broken = found.filter("list is not null and node is null").select("source").distinct().withColumn("_broken", F.lit(True))
    shells = found.filter("list is null").select("source", "shell", "totals").join(broken, "source", "left").select("source", F.when(F.col("_broken").isNull(), F.col("shell")).alias("raw"), "totals")
    heads = inputs.drop("raw", "piece").distinct()
    parsed = cut(parse(heads.join(shells, "source")), "parsed")
    chosen = F.try_variant_get("bom", "$.components[0]", "int")
    lists = parsed.select("source", chosen.alias("list"), F.get("totals", chosen).alias("total")).filter("list is not null")
    nodes = found.filter("index is not null").join(lists, ["source", "list"])
    return parsed.drop("totals"), nodes.select("source", (F.col("total") - F.col("through") + F.col("index")).cast("int").alias("index"), "node")


def coerce_line(v: Column) -> Column:
    """A positive whole number, or a string of one; booleans and fractions are no lines."""
    text = strip(F.try_variant_get(v, "$", "string"))
    whole = F.when(_kind(v) == "BIGINT", F.try_variant_get(v, "$", "bigint")).when((_kind(v) == "STRING") & text.rlike("^[+-]?[0-9]+(_[0-9]+)*$"), F.replace(text, F.lit("_"), F.lit("")).try_cast("bigint"))
    return F.when(whole > 0, whole)


def assets(nodes: DataFrame) -> DataFrame:
    """source, index, names, asset_type, oid, is_dependency, node: the components that are cryptographic or dependencies."""
    node = F.col("node")
    crypto = F.try_variant_get(node, "$.cryptoProperties", "variant")
    is_crypto = _is_object(crypto)
    kind = F.when(_kind(F.try_variant_get(node, "$.type", "variant")) == "STRING", F.try_variant_get(node, "$.type", "string"))
    dependency = ~is_crypto & F.coalesce(kind.isin("library", "framework"), F.lit(False))
    asset = is_crypto | F.coalesce(kind == "cryptographic-asset", F.lit(False))
    raw_oid = text_at(node, "$.cryptoProperties.oid")
    oid_names = F.create_map(*[F.lit(x) for pair in tables.OIDS.items() for x in pair])
    inner = lambda path: F.when(is_crypto, text_at(node, path))
    version = text_at(node, "$.version")
    listed = F.array(
        text_at(node, "$.name"),
        F.when(is_crypto, F.try_element_at(oid_names, raw_oid)),
        inner("$.cryptoProperties.algorithmProperties.parameterSetIdentifier"),
        inner("$.cryptoProperties.algorithmProperties.primitive"),
        inner("$.cryptoProperties.algorithmProperties.curve"),
        inner("$.cryptoProperties.relatedCryptoMaterialProperties.type"),
        inner("$.cryptoProperties.protocolProperties.type"),
        inner("$.cryptoProperties.protocolProperties.version"),
        F.when(F.length(version) < 24, version),
    )
    kept = nodes.filter(asset | dependency)
    return kept.select("source", "index", F.filter(listed, lambda x: x.isNotNull()).alias("names"), inner("$.cryptoProperties.assetType").alias("asset_type"), F.when(is_crypto, raw_oid).alias("oid"), dependency.alias("is_dependency"), "node")


def occurrences(found: DataFrame) -> DataFrame:
    """source, index, ordinal, file, line, shape: evidence occurrences with a file or a line, then at most one from properties."""
    exploded = lambda path: found.select("source", "index", F.explode(_elements(F.col("node"), path)).alias("e")).select("source", "index", "e.*")
    seen = exploded("$.evidence.occurrences")
    line = coerce_line(F.try_variant_get("value", "$.line", "variant"))
    spec = seen.select("source", "index", F.col("pos").alias("ordinal"), text_at(F.col("value"), "$.location").alias("file"), line.alias("line"), F.lit("evidence.occurrences").alias("shape")).filter("file is not null or line is not null")
    props = exploded("$.properties")
    leaf = F.substring_index(F.lower(strip(F.try_variant_get("value", "$.name", "string"))), ":", -1)
    value = F.try_variant_get("value", "$.value", "variant")
    file = F.when(leaf.isin(*tables.LOCATION_PROPERTIES), text_at(F.col("value"), "$.value"))
    number = F.when(leaf.isin(*tables.LINE_PROPERTIES), coerce_line(value))
    each = props.select("source", "index", "pos", file.alias("file"), number.alias("line"))
    first = lambda c: F.min_by(c, F.when(F.col(c).isNotNull(), F.col("pos"))).alias(c)
    derived = each.groupBy("source", "index").agg(first("file"), first("line")).filter("file is not null or line is not null")
    return spec.unionByName(derived.select("source", "index", F.lit(1 << 30).alias("ordinal"), "file", "line", F.lit("properties").alias("shape")))
