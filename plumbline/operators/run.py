"""The scoring run: from documents to verdicts and results, all documents at once.

The frames that several later ones need are written once, so no plan repeats them.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.functions import tables
from plumbline.operators import governance, rollups, score, shred
from plumbline.sources import inventory
from plumbline.sources.stored import cut


@dataclass
class Run:
    inputs: DataFrame
    verdicts: DataFrame
    evidence: DataFrame
    classes: DataFrame
    results: DataFrame


def score_documents(inputs: DataFrame, truth: DataFrame, files: DataFrame, allowances: DataFrame | None = None, tolerance: int = tables.DEFAULT_TOLERANCE, validate: bool = False) -> Run:
    """Scores inputs (source, project, language, tool, raw) against ground truth and a file listing.

    Long documents come in pieces, a row each: `raw` is a piece's text and a further column `piece` its place.
    A project's ground truth may be dealt over several rows.
    Where asked to validate, results tell schema_valid and schema_errors; both are null otherwise and for documents that are no inventory.
    """
    spark = inputs.sparkSession
    allowances = score.allowance_table(spark) if allowances is None else allowances
    plants, accepted = cut(inventory.plants(truth), "plants"), cut(inventory.accepted_locations(truth), "accepted")
    # Files that plants name exist by definition, also where a listing lacks them.
    listing = files.select("project", "path").unionByName(accepted.select("project", F.col("file").alias("path"))).distinct()
    if "piece" in inputs.columns:
        parsed, nodes = shred.shred_pieces(inputs)
    else:
        parsed = cut(shred.parse(inputs), "parsed")
        nodes = shred.components(parsed)
    found = cut(shred.assets(nodes), "assets")
    assets = found.drop("node")
    heads = parsed.select("source", "project", "language", "tool", "parse_error")
    claims = cut(score.resolve_claims(shred.occurrences(found), heads, listing), "claims")
    credible = cut(score.credible_algorithms(assets, plants), "credible")
    hit = cut(score.hits(heads, plants, accepted, assets, claims, credible, tolerance), "hits")
    verdict = cut(score.verdicts(heads, plants, assets, hit, credible), "verdicts")
    ev = score.evidence(heads, assets, claims)
    classes = score.false_positive_classes(heads, plants, accepted, assets, claims, score.matched_components(hit), credible, allowances)
    results = score.results(heads, verdict, hit, ev, classes)
    if validate:
        errors = rollups.per_source_errors(governance.structural_errors(parsed.filter("bom is not null"), nodes)).withColumnRenamed("errors", "schema_errors")
        ran = F.col("parse_error").isNull()
        results = results.join(errors, "source", "left").withColumn("schema_valid", F.when(ran, F.col("schema_errors").isNull()))
    else:
        results = results.withColumn("schema_errors", F.lit(None).cast("array<string>")).withColumn("schema_valid", F.lit(None).cast("boolean"))
    return Run(heads, verdict, ev, classes, cut(results, "results"))
