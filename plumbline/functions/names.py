"""Algorithm names as token sets, families and sizes: native expressions over distinct names.

A name is upper-cased, trimmed and cut at its first "@". Its parts are the runs
of A-Z and 0-9. Markers are sought in the squashed name (the parts joined), at
a part's start or right after a digit, so hyphenation does not matter and words
such as "universal-hash" show no family.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions import tables


def strings(values) -> Column:
    return F.array(*[F.lit(v) for v in values])


def strip(c: Column) -> Column:
    """Without surrounding white space of any kind."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def clean(name: Column) -> Column:
    return F.element_at(F.split(strip(F.upper(name)), "@", 2), 1)


def _lookup(table: dict[str, str], key: Column) -> Column:
    mapping = F.create_map(*[F.lit(x) for pair in table.items() for x in pair])
    return F.coalesce(F.try_element_at(mapping, key), key)


def _is_stop(x: Column) -> Column:
    return x.isin(*tables.STOPWORDS)


def _digit_at(text: Column, place: Column) -> Column:
    return (place >= 1) & F.substring(text, place, F.lit(1)).between("0", "9") if isinstance(place, Column) else F.lit(False)


def _shows(marker: Column, squashed: Column, starts: Column) -> Column:
    """Whether the marker stands in the squashed name at a place that counts."""
    size = F.length(marker)

    def counts(p: Column) -> Column:
        found = F.substring(squashed, p, size) == marker
        bounded = F.array_contains(starts, p - 1) | _digit_at(squashed, p - 1)
        tail = (marker == "DSA") & F.substring(squashed, F.lit(1), p - 1).rlike(f"({'|'.join(tables.DSA_PREFIXES)})$")
        longer = marker.rlike("[0-9]$") & F.substring(squashed, p + size, F.lit(1)).rlike("[0-9]")
        return found & bounded & ~tail & ~longer

    places = F.when(F.length(squashed) > 0, F.sequence(F.lit(1), F.length(squashed))).otherwise(F.array().cast("array<int>"))
    return F.exists(places, counts)


def bind(value: Column, f) -> Column:
    """f(value), with the value computed once: the lambda's variable stands for it in a tree that does not grow."""
    return F.element_at(F.transform(F.array(value), f), 1)


def _tokens(parts: Column, squashed: Column, starts: Column, telling: Column) -> Column:
    markers = F.array(*[F.struct(F.lit(m).alias("marker"), F.lit(f).alias("family")) for m, f in tables.MARKERS.items()])
    shown = F.transform(F.filter(markers, lambda m: _shows(m["marker"], squashed, starts)), lambda m: m["family"])
    none = F.array().cast("array<string>")

    def of_part(part: Column, i: Column) -> Column:
        before = F.when(i > 0, F.get(parts, i - 1)).otherwise(F.lit(""))

        def of_token(token: Column) -> Column:
            others = F.array_except(F.array_remove(telling, token), strings(tables.QUALIFIERS))
            word = token.isin(*tables.WHOLE_ONLY) & (F.size(others) > 0)
            numbered = token.rlike("^[A-Z]+[0-9]+$")
            stem = bind(_lookup(tables.ALIASES, F.regexp_extract(token, "^([A-Z]+)", 1)), lambda x: F.when(_is_stop(x), none).otherwise(F.array(x)))
            more = F.when(numbered, F.concat(stem, F.array(F.regexp_extract(token, "([0-9]+)$", 1)))).otherwise(none)
            return F.when(_is_stop(token) | word, none).otherwise(F.concat(F.array(token), more))

        tail = (part == "DSA") & before.isin(*tables.DSA_PREFIXES)
        return F.when(_is_stop(part) | tail, none).otherwise(bind(_lookup(tables.ALIASES, part), of_token))

    both = F.array_union(shown, F.flatten(F.transform(parts, of_part)))
    curve = lambda x: F.when(F.arrays_overlap(x, strings(tables.CURVES)), strings(["ECDSA"])).otherwise(none)
    return bind(both, lambda x: F.array_sort(F.array_union(x, curve(x))))


def features(name: Column) -> Column:
    """struct(parts, tokens, families, params) of a name."""

    def of_parts(parts: Column) -> Column:
        starts = F.transform(parts, lambda x, i: F.aggregate(F.slice(parts, F.lit(1), i), F.lit(0), lambda a, y: a + F.length(y)))
        telling = F.array_distinct(F.transform(F.filter(parts, lambda x: ~_is_stop(x) & ~x.rlike("^[0-9]+$")), lambda x: _lookup(tables.ALIASES, x)))

        def of_squashed(s: Column) -> Column:
            params = F.array_sort(F.array_intersect(F.regexp_extract_all(s, F.lit("[0-9]+"), F.lit(0)), strings(tables.SIZES)))
            tokens = bind(starts, lambda st: bind(telling, lambda te: _tokens(parts, s, st, te)))
            return bind(tokens, lambda t: F.struct(parts.alias("parts"), t.alias("tokens"), F.array_intersect(t, strings(tables.FAMILIES)).alias("families"), params.alias("params")))

        return bind(F.array_join(parts, ""), of_squashed)

    return bind(F.filter(F.split(clean(F.coalesce(name, F.lit(""))), "[^A-Z0-9]+"), lambda x: x != ""), of_parts)


def name_features(names: DataFrame, column: str = "name") -> DataFrame:
    """Adds parts, tokens, families and params to a table of names. Run it on distinct names.

    The features come out of a generator (one row a name), so no later step repeats the expression.
    """
    each = names.withColumn("_f", F.explode(F.array(features(F.col(column)))))
    return each.select(*names.columns, "_f.parts", "_f.tokens", "_f.families", "_f.params")


def compatible(planted: dict[str, Column], reported: dict[str, Column]) -> Column:
    """Whether a reported name is credible for a planted one; both as columns tokens, families, params. Not symmetric."""
    some = lambda c: F.size(c) > 0
    shared = F.array_intersect(planted["tokens"], reported["tokens"])
    both = some(planted["families"]) & some(reported["families"])
    kin = F.when(both, F.arrays_overlap(planted["families"], reported["families"])).otherwise(
        some(shared) & (~some(planted["families"]) | some(F.array_except(shared, strings(tables.QUALIFIERS))))
    )
    alike = some(planted["families"]) & (F.array_sort(planted["families"]) == F.array_sort(reported["families"]))
    clash = alike & some(planted["params"]) & some(reported["params"]) & ~F.arrays_overlap(planted["params"], reported["params"])
    return some(planted["tokens"]) & some(reported["tokens"]) & kin & ~clash


def compatible_pairs(planted: DataFrame, reported: DataFrame) -> DataFrame:
    """algorithm, name: the compatible pairs of two tables of names (columns algorithm, name).

    Compatible names share a token, so the pairs come from an equi-join on tokens, not from a cross join.
    """
    p = name_features(planted.select("algorithm").distinct(), "algorithm")
    r = name_features(reported.select("name").distinct(), "name")
    left = p.select("algorithm", F.struct("tokens", "families", "params").alias("p"), F.explode("tokens").alias("token"))
    right = r.select("name", F.struct("tokens", "families", "params").alias("r"), F.explode("tokens").alias("token"))
    parts = lambda s: {k: F.col(f"{s}.{k}") for k in ("tokens", "families", "params")}
    return left.join(right, "token").filter(compatible(parts("p"), parts("r"))).select("algorithm", "name").distinct()
