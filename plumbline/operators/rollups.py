"""Rollups over verdicts and results: matrices, coverage, misses, cuts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.operators.score import ratio

LAYERS = tuple(range(1, 7))


def by_language(verdict: DataFrame) -> DataFrame:
    """tool, language ("all" for the total), detected, total, rate: grouping sets."""
    each = verdict.groupingSets([["tool", "language"], ["tool"]], "tool", "language").agg(F.count_if("detected").alias("detected"), F.count(F.lit(1)).alias("total"), F.grouping("language").alias("_all"))
    return each.select("tool", F.when(F.col("_all") == 1, "all").otherwise(F.col("language")).alias("language"), "detected", "total", ratio(F.col("detected"), F.col("total")).alias("rate"))


def by_layer(verdict: DataFrame, keys=("tool",)) -> DataFrame:
    """Per key the detections of each layer, a column a layer; 0 where a layer has no plant."""
    wide = verdict.groupBy(*keys).pivot("layer", list(LAYERS)).agg(F.count_if("detected"))
    return wide.select(*keys, *[F.coalesce(F.col(str(i)), F.lit(0)).alias(f"layer_{i}") for i in LAYERS])


def layer_text(verdict: DataFrame) -> DataFrame:
    """source, by_layer: "layer:detected/total" in the order of the layers."""
    each = verdict.groupBy("source", "layer").agg(F.count_if("detected").alias("d"), F.count(F.lit(1)).alias("t"))
    cell = F.struct("layer", F.concat_ws("", F.col("layer").cast("string"), F.lit(":"), F.col("d").cast("string"), F.lit("/"), F.col("t").cast("string")).alias("cell"))
    return each.groupBy("source").agg(F.array_join(F.transform(F.array_sort(F.collect_list(cell)), lambda x: x["cell"]), " ").alias("by_layer"))


def weaker_rules(verdict: DataFrame) -> DataFrame:
    """tool, counts under the weaker rules, and their shares as ratios of sums."""
    flags = ("located", "file_only", "name_only")
    out = verdict.groupBy("tool").agg(F.count(F.lit(1)).alias("total"), *[F.count_if(f).alias(f) for f in flags])
    return out.select("tool", "total", *flags, *[ratio(F.col(f), F.col("total")).alias(f"{f}_rate") for f in flags])


#: What is summed per tool.
SUMS = (
    "detected", "total", "matched_components", "crypto_components", "credited_claims", "distinct_claims", "phantom_location", "phantom_algorithm", "false_positives", "unmatched_reports",
    "with_location", "with_line", "using_spec_evidence", "using_properties_only", "total_occurrences", "resolvable_locations", "unresolvable_locations",
)


def per_tool(results: DataFrame) -> DataFrame:
    """One row a tool: sums, ratios of sums (never means of ratios), and schema validity over the documents that were validated ("not run" if none was)."""
    total = results.groupBy("tool").agg(
        F.count(F.lit(1)).alias("documents"), F.count("parse_error").alias("parse_errors"), F.count_if("schema_valid").alias("valid"), F.count("schema_valid").alias("validated"), *[F.sum(c).alias(c) for c in SUMS]
    )
    rates = {"detection_rate": ("detected", "total"), "precision": ("matched_components", "crypto_components"), "claim_precision": ("credited_claims", "distinct_claims")}
    share = ratio(F.col("valid"), F.col("validated")).cast("string")
    return total.select(
        "*", *[ratio(F.col(a), F.col(b)).alias(c) for c, (a, b) in rates.items()], ratio(F.col("total_occurrences"), F.col("crypto_components"), 3).alias("occurrences_per_component"),
        F.when(F.col("validated") == 0, "not run").otherwise(share).alias("schema_valid"),
    )


def layer_rates(verdict: DataFrame, keys=("tool",)) -> DataFrame:
    """Keys, by_layer: layer (as text) -> detected, total, rate."""
    each = verdict.groupBy(*keys, "layer").agg(F.count_if("detected").alias("detected"), F.count(F.lit(1)).alias("total"))
    entry = F.struct(F.col("layer").cast("string").alias("key"), F.struct("detected", "total", ratio(F.col("detected"), F.col("total")).alias("rate")).alias("value"))
    return each.groupBy(*keys).agg(F.map_from_entries(F.array_sort(F.collect_list(entry))).alias("by_layer"))


def unscored(projects: DataFrame, tools: DataFrame, scored: DataFrame) -> DataFrame:
    """project, tool pairs without a scored document. Both dimensions are small by nature."""
    return projects.select("project").distinct().crossJoin(tools.select("tool").distinct()).join(scored.select("project", "tool"), ["project", "tool"], "left_anti")


def misses(verdict: DataFrame) -> DataFrame:
    """tool, layer, misses: also the layers without a miss."""
    spark = verdict.sparkSession
    layers = spark.createDataFrame([(i,) for i in LAYERS], "layer int")
    spine = verdict.select("tool").distinct().join(F.broadcast(layers))
    lost = verdict.filter("not detected").groupBy("tool", "layer").agg(F.count(F.lit(1)).alias("misses"))
    return spine.join(lost, ["tool", "layer"], "left").select("tool", "layer", F.coalesce("misses", F.lit(0)).alias("misses"))


def missing_layers(plants: DataFrame, keys=("project",)) -> DataFrame:
    """Keys and layers for which nothing is planted."""
    layers = plants.sparkSession.createDataFrame([(i,) for i in LAYERS], "layer int")
    return plants.select(*keys).distinct().join(F.broadcast(layers)).join(plants.select(*keys, "layer"), [*keys, "layer"], "left_anti")


def cuts(verdict: DataFrame, assets: str, projects: str) -> DataFrame:
    """Per tool: all plants, those an asset filter keeps, those a project filter keeps, and both."""
    a, p = F.expr(assets), F.expr(projects)
    cells = {"all": F.lit(True), "assets": a, "projects": p, "both": a & p}
    return verdict.groupBy("tool").agg(*[x for n, c in cells.items() for x in (F.count_if(c & F.col("detected")).alias(f"{n}_detected"), F.count_if(c).alias(f"{n}_total"))])


def suppressed(verdict: DataFrame, holdout: str) -> DataFrame:
    """Verdicts with file and line hidden where the project is held out."""
    hide = F.expr(holdout)
    return verdict.withColumn("file", F.when(~hide, F.col("file"))).withColumn("line", F.when(~hide, F.col("line")))


def per_source_errors(errors: DataFrame, most: int = 12) -> DataFrame:
    """source, errors: the first `most` messages by place, then a marker if there are more."""
    listed = F.transform(F.array_sort(F.collect_list(F.struct("place", "message"))), lambda x: x["message"])
    out = errors.groupBy("source").agg(listed.alias("_all"))
    more = F.when(F.size("_all") > most, F.array(F.lit("... more errors"))).otherwise(F.array().cast("array<string>"))
    return out.select("source", F.concat(F.slice("_all", 1, most), more).alias("errors"))
