"""Reported paths and the project files they mean."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions.names import strip


def normalize_path(path: Column) -> Column:
    """Forward slashes, no leading "./" and no leading slash."""
    return F.regexp_replace(F.regexp_replace(F.replace(strip(path), F.lit("\\"), F.lit("/")), r"^(\./)+", ""), "^/+", "")


def suffixes(path: Column) -> Column:
    """The path and every tail of it that begins after a slash, longest first."""
    parts = F.split(path, "/")
    return F.transform(parts, lambda _, i: F.array_join(F.slice(parts, i + 1, F.size(parts)), "/"))


def suffix_index(files: DataFrame) -> DataFrame:
    """project, suffix, path: the suffixes that exactly one file of a project (columns project, path) has."""
    each = files.select("project", "path").distinct().select("project", "path", F.explode(suffixes(F.col("path"))).alias("suffix"))
    return each.groupBy("project", "suffix").agg(F.count(F.lit(1)).alias("n"), F.min("path").alias("path")).filter("n = 1").drop("n")


def resolve_paths(reported: DataFrame, files: DataFrame) -> DataFrame:
    """project, file, resolved: each distinct reported file (columns project, file) and the project file it means, or null.

    An exact path wins; else the longest suffix that only one file has. Distinct paths are resolved once.
    """
    distinct = reported.select("project", "file").filter("file is not null").distinct().withColumn("_clean", normalize_path(F.col("file")))
    exact = files.select(F.col("project"), F.col("path").alias("_clean"), F.lit(True).alias("_exact")).distinct()
    tails = distinct.join(exact, ["project", "_clean"], "left").filter("_clean <> ''").select("project", "file", "_clean", "_exact", F.posexplode(suffixes(F.col("_clean"))).alias("_pos", "suffix"))
    found = tails.join(suffix_index(files), ["project", "suffix"], "left")
    best = found.groupBy("project", "file").agg(F.first(F.when(F.col("_exact"), F.col("_clean")), ignorenulls=True).alias("_own"), F.min_by("path", F.when(F.col("path").isNotNull(), F.col("_pos"))).alias("_tail"))
    out = best.select("project", "file", F.coalesce("_own", "_tail").alias("resolved"))
    return distinct.select("project", "file").join(out, ["project", "file"], "left")


def location_matches(planted_file: Column, planted_line: Column, file: Column, line: Column, tolerance: Column | int) -> Column:
    """Same file and lines within the tolerance; false where file or line is null."""
    return F.coalesce((planted_file == file) & (F.abs(line - planted_line) <= tolerance), F.lit(False))


def match_project(candidates: DataFrame, projects: DataFrame, column: str = "candidate") -> DataFrame:
    """Adds project: the known one that equals the candidate, or else the longest that ends it after "_" or "/".

    The tails of a candidate are joined to the projects, so no candidate meets every project.
    """
    trimmed = F.regexp_replace(strip(F.col(column)), "^/+|/+$", "")
    each = candidates.select(column).distinct().withColumn("_clean", trimmed)
    places = F.filter(F.sequence(F.lit(1), F.length("_clean") + 1), lambda i: (i == 1) | F.substring("_clean", i - 1, F.lit(1)).isin("_", "/"))
    tails = each.withColumn("_tail", F.explode(F.transform(places, lambda i: F.substring("_clean", i, F.length("_clean")))))
    known = projects.select(F.col("project")).distinct()
    best = tails.join(known, F.col("_tail") == F.col("project")).groupBy(column).agg(F.max_by("project", F.length("project")).alias("project"))
    return candidates.join(best, column, "left")


def file_format(path: Column) -> Column:
    """The extension with its dot; empty without one."""
    return F.regexp_extract(path, r"(\.[^./]+)$", 1)
