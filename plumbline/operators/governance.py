"""Digests, archives and listings held against each other."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions import tables
from plumbline.functions.text import image_repository


def table_digests(spark) -> DataFrame:
    """table_name, entries, sha256_16 of the judgement tables in this build."""
    markers = sorted(([m, f] for m, f in tables.MARKERS.items()), key=lambda x: -len(x[0]))
    allowed = sorted(a if p is None and f is None else str((a, p, f)) for a, p, f in tables.ALLOWANCES)
    named = {
        "oid_algorithms": tables.OIDS, "token_aliases": tables.ALIASES, "family_markers": markers, "whole_token_only": sorted(tables.WHOLE_ONLY),
        "location_property_names": sorted(tables.LOCATION_PROPERTIES), "line_property_names": sorted(tables.LINE_PROPERTIES), "known_unplanted": allowed,
    }
    return spark.createDataFrame([(k, len(v), tables.digest16(v)) for k, v in named.items()], "table_name string, entries long, sha256_16 string")


def digest_changes(now: DataFrame, then: DataFrame) -> DataFrame:
    """table_name, sha256_16, state: whether a run's tables were the same ones; "new" where it recorded none."""
    t = then.select("table_name", F.col("sha256_16").alias("_then"))
    state = F.when(F.col("_then").isNull(), "new").when(F.col("_then") == F.col("sha256_16"), "same").otherwise(F.concat(F.lit("then "), "_then"))
    return now.join(t, "table_name", "left").select("table_name", "entries", "sha256_16", state.alias("state"))


def verify(recorded: DataFrame, present: DataFrame, key: str = "name", digest: str = "sha256") -> DataFrame:
    """key, status: ok, MISSING (recorded only), MISMATCH or extra (present only)."""
    r = recorded.select(F.col(key).alias("_r"), F.col(digest).alias("_rd"))
    p = present.select(F.col(key).alias("_p"), F.col(digest).alias("_pd"))
    status = F.when(F.col("_p").isNull(), "MISSING").when(F.col("_r").isNull(), "extra").when(F.col("_rd") == F.col("_pd"), "ok").otherwise("MISMATCH")
    return r.join(p, F.col("_r") == F.col("_p"), "full_outer").select(F.coalesce("_r", "_p").alias(key), status.alias("status"))


def row_digests(df: DataFrame, key: str) -> DataFrame:
    """name, sha256 of each row's values, joined by a unit separator."""
    values = F.concat_ws("\x1f", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in df.columns])
    return df.select(F.col(key).cast("string").alias("name"), F.sha2(values, 256).alias("sha256"))


def generated_and_shipped(generated: DataFrame, shipped: DataFrame) -> DataFrame:
    """path, status (ok, missing, different) of every generated file (path, content): bytes are compared by digest; shipped files beside them are ignored."""
    mark = lambda df, name: df.select("path", F.sha2(F.col("content").cast("binary"), 256).alias(name))
    both = mark(generated, "_want").join(mark(shipped, "_have"), "path", "left")
    return both.select("path", F.when(F.col("_have").isNull(), "missing").when(F.col("_have") == F.col("_want"), "ok").otherwise("different").alias("status"))


def withheld_files(files: DataFrame) -> DataFrame:
    """name, sha256, bytes of files (path, content), as a manifest records them."""
    return files.select(F.element_at(F.split("path", "/"), -1).alias("name"), F.sha2("content", 256).alias("sha256"), F.octet_length("content").alias("bytes"))


def image_digest(image: Column, digests: Column) -> Column:
    """The digest an image ran as, of the references that were found for it: the pinned one if it is among them, else the first of its repository."""
    own = F.transform(F.filter(digests, lambda r: F.contains(r, F.lit("@")) & (F.substring_index(r, "@", 1) == image_repository(image))), lambda r: F.substring_index(r, "@", -1))
    pinned = F.when(F.contains(image, F.lit("@")), F.substring_index(image, "@", -1))
    return F.when(F.array_contains(own, pinned), pinned).otherwise(F.get(own, F.lit(0)))


def written_into(after: DataFrame, before: DataFrame) -> DataFrame:
    """The paths that a run left behind."""
    return after.select("path").exceptAll(before.select("path"))


def dirty(paths: DataFrame) -> DataFrame:
    """run, dirty: whether any uncommitted path lies outside the runs' own folders."""
    return paths.groupBy("run").agg(F.bool_or(~F.col("path").rlike("^runs/[^/]+/")).alias("dirty"))


def duplicates(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


def invocation_status(log: DataFrame) -> DataFrame:
    """Adds status to a log with exit_code, accepted (array), timed_out, bytes, is_json, and export_error where a project could not be exported."""
    exported = F.col("export_error").isNull() if "export_error" in log.columns else F.lit(True)
    status = F.when(~exported, "export-failed").when(F.col("timed_out"), "timeout").when(F.col("exit_code").isNull(), "error").when(~F.array_contains("accepted", F.col("exit_code")), "failed").when(F.col("bytes") == 0, "empty").when(~F.col("is_json"), "invalid-json").otherwise("ok")
    return log.withColumn("status", status)


def cbom_components(names: DataFrame) -> DataFrame:
    """One component a distinct name with its sorted set of (file, line) and a reference made from its digest."""
    places = F.array_sort(F.collect_set(F.struct("file", "line")))
    return names.groupBy("name").agg(places.alias("places")).select("name", F.substring(F.sha2("name", 256), 1, 16).alias("ref"), "places")


def structural_errors(parsed: DataFrame, components: DataFrame) -> DataFrame:
    """source, place, message: the structural rules a document must keep (a subset of its schema)."""
    get = lambda v, p: F.try_variant_get(v, p, "string")
    kinds = ("application", "framework", "library", "container", "platform", "operating-system", "device", "device-driver", "firmware", "file", "machine-learning-model", "data", "cryptographic-asset")
    head = parsed.select("source", F.lit(-1).alias("place"), F.array_compact(F.array(F.when(~F.coalesce(get("bom", "$.bomFormat") == "CycloneDX", F.lit(False)), "bomFormat must be CycloneDX"), F.when(get("bom", "$.specVersion").isNull(), "specVersion is required"))).alias("m"))
    kind, asset = get("node", "$.type"), get("node", "$.cryptoProperties.assetType")
    body = components.select("source", F.col("index").alias("place"), F.array_compact(F.array(F.when(~F.coalesce(kind.isin(*kinds), F.lit(False)), "type is not one of the enumeration"), F.when(get("node", "$.name").isNull(), "name is required"), F.when(~F.coalesce(asset, F.lit("algorithm")).isin(*tables.ASSET_TYPES), "assetType is not one of the enumeration"))).alias("m"))
    return reduce(DataFrame.unionByName, [head, body]).select("source", "place", F.explode("m").alias("message"))
