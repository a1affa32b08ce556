"""Text rules of the collection and truth tools: annotations, renames, scrubbing, image names, status lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions import tables

#: How comments begin and end, by file suffix or by file name.
STYLES = (
    (r"\.(c|h|java|rs|go|js|ts|mjs|cjs)$", (("//", ""), ("/*", "*/"))),
    (r"\.(mod|json)$", (("//", ""),)),
    (r"(\.(py|yaml|yml|conf|toml|sh|properties|cfg|txt|in|options|env|ini)|(^|/)(dockerfile|makefile|gemfile))$", (("#", ""),)),
    (r"\.(xml|pom|html)$", (("<!--", "-->"),)),
)
MARK = "@PS"


def annotation_body(text: Column, path: Column) -> Column:
    """What a trailing annotation says, trimmed; null where the line has none that is well formed."""
    out = F.lit(None).cast("string")
    for suffix, styles in STYLES:
        found = F.lit("")
        for begin, end in reversed(styles):
            close = rf"\Q{end}\E\s*" if end else ""
            body = F.regexp_extract(text, rf"\Q{begin}\E\s*\Q{MARK}\E\s+(.*?)\s*{close}$", 1)
            found = F.when(body != "", body).otherwise(found)
        out = F.when(F.lower(path).rlike(suffix), F.when(found != "", F.trim(found))).otherwise(out)
    return out


def parse_annotations(lines: DataFrame) -> DataFrame:
    """Adds to path, line, text what their annotations say: target for an alias, else id, algorithm, layer, asset_type, note; error names a defect.

    Lines without the mark, or in files without a comment style, get no row.
    """
    styled = F.lower("path").rlike("|".join(f"(?:{s})" for s, _ in STYLES))
    df = lines.filter(F.contains("text", F.lit(MARK)) & styled).withColumn("body", annotation_body(F.col("text"), F.col("path")))
    alias = F.startswith("body", F.lit("+"))
    parts = F.transform(F.split("body", r"\|"), lambda x: F.trim(x))
    n = F.size(parts)
    get = lambda i: F.when(~alias, F.get(parts, F.lit(i)))
    target = F.trim(F.substring("body", F.lit(2), F.length("body")))
    layer = F.when(get(2).rlike("^[+-]?[0-9]+$"), get(2).try_cast("int"))
    error = (
        F.when(F.col("body").isNull(), "malformed").when(alias & (target == ""), "alias without target").when(alias & F.contains(target, F.lit("|")), "alias takes only an id").when(alias, None)
        .when(~n.isin(4, 5), "needs 4 or 5 fields").when(get(0) == "", "empty id").when(layer.isNull(), "layer is no number").when(~layer.between(1, 6), "unknown layer")
        .when(~get(3).isin(*tables.ASSET_TYPES), "unknown asset type").when(get(1) == "", "empty algorithm")
    )
    note = F.when(n == 5, get(4)).otherwise(F.when(~alias, F.lit("")))
    return df.select("path", "line", F.when(alias, target).alias("target"), get(0).alias("id"), get(1).alias("algorithm"), layer.alias("layer"), get(3).alias("asset_type"), note.alias("note"), error.alias("error"))


def rename_words(text: Column, renames: dict[str, str]) -> Column:
    """Whole words replaced one after another, the longest first."""
    for old in sorted(renames, key=lambda x: (-len(x), x)):
        text = F.regexp_replace(text, rf"(?<![A-Za-z0-9_])\Q{old}\E(?![A-Za-z0-9_])", renames[old].replace("\\", "\\\\").replace("$", "\\$"))
    return text


def strip_ansi(text: Column) -> Column:
    return F.regexp_replace(text, "\x1b\\[[0-9;]*[A-Za-z]", "")


def first_line(text: Column) -> Column:
    """The first line of the trimmed text without styling; "unknown" for nothing."""
    line = F.element_at(F.split(F.trim(strip_ansi(text)), "\r?\n"), 1)
    return F.when(line == "", "unknown").otherwise(line)


def scrub_paths(text: Column) -> Column:
    """Absolute paths replaced by <external>/ and their last part; URLs stay."""
    whole = F.startswith(text, F.lit("/"))
    # Fixed value: the pattern of an absolute path within a text; the replaced texts must be equal.
    inner = F.regexp_replace(text, r"(?<![\w:/])/(?:[A-Za-z0-9_.+-]+/)+([A-Za-z0-9_.+-]+)", "<external>/$1")
    return F.when(whole, F.concat(F.lit("<external>/"), F.element_at(F.split(F.regexp_replace(text, "/+$", ""), "/"), -1))).otherwise(inner)


def image_repository(image: Column) -> Column:
    """An image's repository: no digest, no tag; a colon before the last slash is a port."""
    return F.regexp_replace(F.substring_index(image, "@", 1), ":[^/:]*$", "")


def status_path(line: Column) -> Column:
    """The path of a porcelain status line; a rename's target."""
    rest = F.substring(line, F.lit(4), F.length(line))
    return F.element_at(F.split(rest, " -> "), -1)


def islands(lines: DataFrame, keys, order: str, kind: str) -> DataFrame:
    """Adds island: runs of neighbouring lines with one kind are numbered from 0 within the keys."""
    from pyspark.sql import Window

    w = Window.partitionBy(*keys).orderBy(order)
    fresh = F.when(F.lag(kind).over(w).eqNullSafe(F.col(kind)), 0).otherwise(1)
    return lines.withColumn("_new", fresh).withColumn("island", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)) - 1).drop("_new")
