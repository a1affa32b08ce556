"""Detections, claims, evidence and false positives: joins and aggregates over shredded inventories.

Frames: inputs (source, project, language, tool), plants (project, id, file,
line, algorithm, layer, asset_type), accepted (project, id, file, line), assets
(source, index, names, is_dependency), claims (source, index, file, line,
shape, resolved), files (project, path), allowances (algorithm, project, file).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions import names as naming
from plumbline.functions import paths, tables

DEPENDENCY_LAYER = 5


def resolve_claims(claims: DataFrame, inputs: DataFrame, files: DataFrame) -> DataFrame:
    """Adds resolved, the project file a claim's file means."""
    placed = claims if "project" in claims.columns else claims.join(inputs.select("source", "project"), "source")
    return placed.join(paths.resolve_paths(placed, files), ["project", "file"], "left")


def named(assets: DataFrame) -> DataFrame:
    return assets.select("source", "index", "is_dependency", F.explode("names").alias("name")).distinct()


def credible_algorithms(assets: DataFrame, plants: DataFrame) -> DataFrame:
    """source, index, is_dependency, algorithm: what planted algorithms an asset's names are credible for."""
    each = named(assets)
    return each.join(naming.compatible_pairs(plants, each), "name").select("source", "index", "is_dependency", "algorithm").distinct()


def may_answer(layer: Column, is_dependency: Column) -> Column:
    """A dependency answers plants of the dependency layer only."""
    return ~is_dependency | (layer == DEPENDENCY_LAYER)


def hits(inputs, plants, accepted, assets, claims, credible, tolerance: int = tables.DEFAULT_TOLERANCE) -> DataFrame:
    """source, id, index, is_dependency, file, ok, located: claims that land on an accepted file of a plant."""
    spots = accepted.join(plants.select("project", "id", "algorithm", "layer"), ["project", "id"]).withColumnRenamed("file", "resolved").withColumnRenamed("line", "spot_line")
    placed = claims.filter("resolved is not null").join(assets.select("source", "index", "is_dependency"), ["source", "index"])
    if "project" not in placed.columns:
        placed = placed.join(inputs.select("source", "project"), "source")
    met = placed.join(spots, ["project", "resolved"]).filter(may_answer(F.col("layer"), F.col("is_dependency")))
    near = F.coalesce(F.abs(F.col("line") - F.col("spot_line")) <= tolerance, F.lit(False))
    one = met.groupBy("source", "id", "algorithm", "index", "is_dependency", F.col("resolved").alias("file")).agg(F.bool_or(near).alias("located"))
    flagged = credible.select("source", "index", "algorithm", F.lit(True).alias("ok"))
    return one.join(flagged, ["source", "index", "algorithm"], "left").withColumn("ok", F.coalesce("ok", F.lit(False)))


def first_matches(hit: DataFrame) -> DataFrame:
    """source, id, _first (index, is_dependency): the first component that answers a plant at its place."""
    return hit.filter("ok").groupBy("source", "id").agg(F.min(F.struct("index", "is_dependency")).alias("_first"))


def verdicts(inputs, plants, assets, hit, credible) -> DataFrame:
    """One row per input and plant of its project: detected, located, file_only, name_only, matched_component, by_dependency."""
    spine = inputs.select("source", "project", "language", "tool").join(plants.select("project", "id", "file", "line", "algorithm", "layer", "asset_type"), "project")
    by_name = credible.groupBy("source", "algorithm").agg(F.bool_or(~F.col("is_dependency")).alias("_crypto"), F.bool_or("is_dependency").alias("_dependency"))
    first = F.min(F.when(F.col("ok"), F.struct("index", "is_dependency")))
    by_place = hit.groupBy("source", "id").agg(F.bool_or("ok").alias("detected"), F.bool_or("located").alias("located"), F.lit(True).alias("file_only"), first.alias("_first"))
    out = spine.join(by_name, ["source", "algorithm"], "left").join(by_place, ["source", "id"], "left")
    no = F.lit(False)
    name_only = F.coalesce("_crypto", no) | (F.coalesce("_dependency", no) & (F.col("layer") == DEPENDENCY_LAYER))
    flags = [F.coalesce(c, no).alias(c) for c in ("detected", "located", "file_only")]
    return out.select("source", "project", "language", "tool", "id", "file", "line", "algorithm", "layer", "asset_type", *flags, name_only.alias("name_only"), F.col("_first.index").alias("matched_component"), F.col("_first.is_dependency").alias("by_dependency"))


def matched_components(hit: DataFrame) -> DataFrame:
    """source, index: components that were some plant's first match; a dependency's match counts for no component."""
    return first_matches(hit).filter("not _first.is_dependency").select("source", "_first.index").distinct()


def credited_claims(hit: DataFrame) -> DataFrame:
    """source, index, file: what a component got right, at the grain of files."""
    return hit.filter("ok and not is_dependency").select("source", "index", "file").distinct()


def evidence(inputs, assets, claims) -> DataFrame:
    """One row per input: nine counters over its cryptographic components and their claims."""
    crypto = assets.filter("not is_dependency").select("source", "index")
    own = crypto.join(claims.select("source", "index", "file", "line", "shape", "resolved"), ["source", "index"], "left")
    some = F.col("shape").isNotNull()
    by_asset = own.groupBy("source", "index").agg(
        F.count_if(F.col("file").isNotNull()).alias("located"), F.count_if(F.col("file").isNotNull() & F.col("line").isNotNull()).alias("lined"),
        F.count_if(F.col("shape") == "evidence.occurrences").alias("spec"), F.count_if(some).alias("n"),
        F.count_if(F.col("file").isNotNull() & F.col("resolved").isNotNull()).alias("found"), F.count_if(F.col("file").isNotNull() & F.col("resolved").isNull()).alias("lost"),
        F.count_distinct(F.when(some, F.struct("resolved", "line"))).alias("claims"),
    )
    total = by_asset.groupBy("source").agg(
        F.count(F.lit(1)).alias("crypto_components"), F.count_if(F.col("located") > 0).alias("with_location"), F.count_if(F.col("lined") > 0).alias("with_line"),
        F.count_if(F.col("spec") > 0).alias("using_spec_evidence"), F.count_if((F.col("spec") == 0) & (F.col("n") > 0)).alias("using_properties_only"), F.sum("n").alias("total_occurrences"),
        F.sum("claims").alias("distinct_claims"), F.sum("found").alias("resolvable_locations"), F.sum("lost").alias("unresolvable_locations"),
    )
    counters = [c for c in total.columns if c != "source"]
    return inputs.select("source").join(total, "source", "left").select("source", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in counters])


def false_positive_classes(inputs, plants, accepted, assets, claims, matched, credible, allowances) -> DataFrame:
    """source, index, verdict of every unmatched cryptographic component.

    phantom_algorithm: names a family that neither the project's plants nor an
    allowance make credible. Else phantom_location: every location unresolved.
    Else unmatched: no location in a planted file. Else near.
    """
    own = assets.filter("not is_dependency").join(inputs.select("source", "project"), "source").select("source", "index", "project", "names")
    each = own.select("source", "index", "project", F.explode("names").alias("name"))
    features = naming.name_features(each.select("name").distinct()).filter("size(families) > 0").select("name")
    in_project = plants.select("project", "algorithm").distinct()
    by_plant = credible.join(inputs.select("source", "project"), "source").join(in_project, ["project", "algorithm"], "left_semi")
    allowed = each.join(naming.compatible_pairs(allowances, each), "name").join(allowances.select("algorithm", F.col("project").alias("a_project"), F.col("file").alias("a_file")), "algorithm")
    allowed = allowed.filter("a_project is null or a_project = project")
    spot = claims.filter("resolved is not null").select("source", "index", F.col("resolved").alias("a_file"))
    placed = claims if "project" in claims.columns else claims.join(inputs.select("source", "project"), "source")
    planted = accepted.select("project", F.col("file").alias("resolved")).distinct().withColumn("_planted", F.lit(True))
    placed = placed.join(planted, ["project", "resolved"], "left")
    # Every table says what it knows of a component; one aggregate brings it together.
    flags = ("own", "matched", "claims_family", "is_credible", "if_bare", "has_location", "some_resolved", "on_plant")
    say = lambda df, **known: df.select("source", "index", *[known.get(f, F.lit(False)).alias(f) for f in flags])
    yes = F.lit(True)
    told = [
        say(own, own=yes), say(matched, matched=yes), say(each.join(features, "name", "left_semi"), claims_family=yes), say(by_plant, is_credible=yes),
        say(allowed, is_credible=F.col("a_file").isNull(), if_bare=yes), say(allowed.filter("a_file is not null").join(spot, ["source", "index", "a_file"], "left_semi"), is_credible=yes),
        say(placed, has_location=F.col("file").isNotNull(), some_resolved=F.col("resolved").isNotNull(), on_plant=F.col("_planted").isNotNull()),
    ]
    joined = reduce(DataFrame.unionByName, told).groupBy("source", "index").agg(*[F.bool_or(f).alias(f) for f in flags]).filter("own and not matched")
    credible_ = F.col("is_credible") | (F.col("if_bare") & ~F.col("has_location"))
    kind = F.when(F.col("claims_family") & ~credible_, "phantom_algorithm").when(F.col("has_location") & ~F.col("some_resolved") & ~F.col("on_plant"), "phantom_location").when(~F.col("on_plant"), "unmatched").otherwise("near")
    return joined.select("source", "index", kind.alias("verdict"))


def ratio(hit: Column, total: Column, digits: int = 4) -> Column:
    """hit / total rounded half to even; 0 where total is 0."""
    return F.when(total == 0, F.lit(0.0)).otherwise(F.bround(hit.cast("double") / total.cast("double"), digits))


def results(inputs, verdict, hit, ev, classes) -> DataFrame:
    """One row per input: detections, precision and false positives."""
    seen = verdict.groupBy("source").agg(F.count_if("detected").alias("detected"), F.count(F.lit(1)).alias("total"))
    matched = matched_components(hit).groupBy("source").agg(F.count(F.lit(1)).alias("matched_components"))
    credited = credited_claims(hit).groupBy("source").agg(F.count(F.lit(1)).alias("credited_claims"))
    wrong = classes.groupBy("source").agg(*[F.count_if(F.col("verdict") == k).alias(c) for k, c in (("phantom_algorithm", "phantom_algorithm"), ("phantom_location", "phantom_location"), ("unmatched", "unmatched_reports"))])
    df = reduce(lambda a, b: a.join(b, "source", "left"), (seen, matched, credited, wrong, ev), inputs)
    df = df.fillna(0, [c for c, t in df.dtypes if t in ("bigint", "int") and c != "source"])
    return (
        df.withColumn("false_positives", F.col("phantom_algorithm") + F.col("phantom_location"))
        .withColumn("detection_rate", ratio(F.col("detected"), F.col("total")))
        .withColumn("precision", ratio(F.col("matched_components"), F.col("crypto_components")))
        .withColumn("claim_precision", ratio(F.col("credited_claims"), F.col("distinct_claims")))
        .withColumn("occurrences_per_component", ratio(F.col("total_occurrences"), F.col("crypto_components"), 3))
    )


def allowance_table(spark, rows=tables.ALLOWANCES) -> DataFrame:
    return spark.createDataFrame(list(rows), "algorithm string, project string, file string")
