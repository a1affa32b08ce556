"""Query registry of the engine's own operators: each with the DuckDB SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.functions import names as naming
from plumbline.functions import paths, text
from plumbline.operators import governance, rollups, score, shred, truth
from plumbline.plans import documents
from plumbline.plans.frames import PLANTED, REPORTED, Frames, quoted
from plumbline.plans.oracle import COMPAT, EVIDENCE, FALSE_POSITIVES, FRAMES, POOLS, RESOLVE, SCORED, VERDICTS, features, over
from plumbline.sources import reports

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    def keep(f: Callable[[Frames], DataFrame]):
        _QUERIES[f.__name__] = lambda spark, sf_dir: f(Frames(spark, sf_dir))
        if sql:
            _ORACLE[f.__name__] = sql
        return f

    return keep


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _QUERIES["detection_by_tool_language"](spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_ORACLE)


def _ratio(a: str, b: str) -> str:
    return f"CASE WHEN {b} = 0 THEN CAST(0 AS DOUBLE) ELSE CAST(round_even(CAST({a} AS DOUBLE) / CAST({b} AS DOUBLE), 4) AS DOUBLE) END"


# --- verdicts and rollups ---


@query(over(f"SELECT tool, CASE WHEN grouping(language) = 1 THEN 'all' ELSE language END AS language, count(*) FILTER (WHERE detected) AS detected, count(*) AS total, {_ratio('count(*) FILTER (WHERE detected)', 'count(*)')} AS rate FROM verdict GROUP BY GROUPING SETS ((tool, language), (tool))", *SCORED))
def detection_by_tool_language(t):
    return rollups.by_language(t.verdicts())


@query(over("SELECT tool, " + ", ".join(f"count(*) FILTER (WHERE detected AND layer = {i}) AS layer_{i}" for i in range(1, 7)) + " FROM verdict GROUP BY tool", *SCORED))
def detection_by_layer_pivot(t):
    return rollups.by_layer(t.verdicts())


@query(over("SELECT language, tool, " + ", ".join(f"count(*) FILTER (WHERE detected AND layer = {i}) AS layer_{i}" for i in range(1, 7)) + " FROM verdict GROUP BY language, tool", *SCORED))
def detection_by_language_tool_layer(t):
    return rollups.by_layer(t.verdicts(), ("language", "tool"))


@query(over("SELECT source, id, detected, located, file_only, name_only FROM verdict", *SCORED))
def verdict_flags(t):
    return t.verdicts().select("source", "id", "detected", "located", "file_only", "name_only")


@query(over("SELECT source, id, matched_component, by_dependency FROM verdict WHERE matched_component IS NOT NULL", *SCORED))
def first_match_components(t):
    return t.verdicts().filter("matched_component is not null").select("source", "id", "matched_component", "by_dependency")


@query(over("SELECT source, string_agg(layer || ':' || d || '/' || n, ' ' ORDER BY layer) AS by_layer FROM (SELECT source, layer, count(*) FILTER (WHERE detected) AS d, count(*) AS n FROM verdict GROUP BY 1, 2) GROUP BY source", *SCORED))
def by_layer_text(t):
    return rollups.layer_text(t.verdicts())


PRECISION = f"""SELECT e.source, coalesce(m, 0) AS matched_components, crypto_components, {_ratio('coalesce(m, 0)', 'crypto_components')} AS precision_value, coalesce(k, 0) AS credited_claims, distinct_claims, {_ratio('coalesce(k, 0)', 'distinct_claims')} AS claim_precision
FROM evidence e LEFT JOIN (SELECT source, count(DISTINCT matched_component) AS m FROM verdict WHERE matched_component IS NOT NULL AND NOT by_dependency GROUP BY 1) USING (source)
LEFT JOIN (SELECT source, count(DISTINCT idx || '|' || file) AS k FROM hit WHERE ok AND NOT is_dependency GROUP BY 1) USING (source)"""


@query(over(PRECISION, *SCORED, EVIDENCE))
def precision_by_source(t):
    t.kept |= {"claims", "hits"}
    ev = score.evidence(t.inputs(), t.assets(), t.claims()).select("source", "crypto_components", "distinct_claims")
    m = score.matched_components(t.hits()).groupBy("source").agg(F.count(F.lit(1)).alias("matched_components"))
    k = score.credited_claims(t.hits()).groupBy("source").agg(F.count(F.lit(1)).alias("credited_claims"))
    df = ev.join(m, "source", "left").join(k, "source", "left").fillna(0, ["matched_components", "credited_claims"])
    return df.select("source", "matched_components", "crypto_components", score.ratio(F.col("matched_components"), F.col("crypto_components")).alias("precision_value"), "credited_claims", "distinct_claims", score.ratio(F.col("credited_claims"), F.col("distinct_claims")).alias("claim_precision"))


@query(over("SELECT * FROM evidence", FRAMES, RESOLVE, EVIDENCE))
def evidence_quality(t):
    return score.evidence(t.inputs(), t.assets(), t.claims())


@query(over("SELECT tool, count(*) AS total, " + ", ".join(f"count(*) FILTER (WHERE {f}) AS {f}" for f in ("located", "file_only", "name_only")) + ", " + ", ".join(f"{_ratio(f'count(*) FILTER (WHERE {f})', 'count(*)')} AS {f}_rate" for f in ("located", "file_only", "name_only")) + " FROM verdict GROUP BY tool", *SCORED))
def weaker_rules(t):
    return rollups.weaker_rules(t.verdicts())


def _classes(t):
    t.kept |= {"claims"}
    matched = score.matched_components(t.hits())
    return score.false_positive_classes(t.inputs(), t.plants(), t.accepted(), t.assets(), t.claims(), matched, t.credible(), t.allowances())


@query(over("SELECT source, idx AS component, verdict FROM classes", *SCORED, FALSE_POSITIVES))
def false_positive_cascade(t):
    return _classes(t).select("source", F.col("index").alias("component"), "verdict")


@query(over("SELECT source, count(*) FILTER (WHERE verdict = 'phantom_algorithm') AS phantom_algorithm, count(*) FILTER (WHERE verdict = 'phantom_location') AS phantom_location, count(*) FILTER (WHERE verdict = 'unmatched') AS unmatched_reports, count(*) FILTER (WHERE verdict LIKE 'phantom%') AS false_positives FROM classes GROUP BY source", *SCORED, FALSE_POSITIVES))
def false_positive_counts(t):
    v = F.col("verdict")
    return _classes(t).groupBy("source").agg(F.count_if(v == "phantom_algorithm").alias("phantom_algorithm"), F.count_if(v == "phantom_location").alias("phantom_location"), F.count_if(v == "unmatched").alias("unmatched_reports"), F.count_if(v.startswith("phantom")).alias("false_positives"))


@query(over("SELECT tool, layer, count(*) FILTER (WHERE NOT detected) AS misses FROM verdict GROUP BY tool, layer", *SCORED))
def miss_report_rows(t):
    return rollups.misses(t.verdicts())


_SIGNATURES = "algorithm IN ('ECDSA-P256', 'Ed25519', 'RSA-2048', 'RS256', 'Falcon-512', 'Falcon-1024', 'ML-DSA', 'ML-DSA-65', 'SLH-DSA', 'LMS', 'XMSS')"
_PROJECTS = "project IN ('p0', 'p2', 'p4')"
_CELLS = {"all": "true", "assets": _SIGNATURES, "projects": _PROJECTS, "both": f"{_SIGNATURES} AND {_PROJECTS}"}


@query(over("SELECT tool, " + ", ".join(f"count(*) FILTER (WHERE ({c}) AND detected) AS {n}_detected, count(*) FILTER (WHERE {c}) AS {n}_total" for n, c in _CELLS.items()) + " FROM verdict GROUP BY tool", *SCORED))
def cuts_filtered_aggregates(t):
    return rollups.cuts(t.verdicts(), _SIGNATURES, _PROJECTS)


@query(over("SELECT source, id, CASE WHEN project <> 'p5' THEN file END AS file, CASE WHEN project <> 'p5' THEN line END AS line, detected FROM verdict", *SCORED))
def holdout_suppressed_view(t):
    return rollups.suppressed(t.verdicts(), "project = 'p5'").select("source", "id", "file", "line", "detected")


@query("SELECT a.project, b.tool FROM (SELECT DISTINCT 'n' || c_nationkey AS project FROM customer) a, (SELECT DISTINCT o_orderpriority AS tool FROM orders) b WHERE NOT EXISTS (SELECT 1 FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderstatus = 'P' AND c_acctbal < 0 AND 'n' || c_nationkey = a.project AND o_orderpriority = b.tool)")
def unscored_pairs(t):
    customers = t.table("customer").selectExpr("c_custkey", "concat('n', c_nationkey) AS project", "c_acctbal")
    orders = t.table("orders")
    scored = orders.filter("o_orderstatus = 'P'").join(customers.filter("c_acctbal < 0"), orders.o_custkey == customers.c_custkey).select("project", F.col("o_orderpriority").alias("tool"))
    return rollups.unscored(customers, orders.select(F.col("o_orderpriority").alias("tool")), scored)


@query("SELECT p_brand AS brand, layer FROM (SELECT DISTINCT p_brand FROM part), (SELECT CAST(unnest(range(1, 7)) AS INTEGER) AS layer) EXCEPT SELECT p_brand, CAST(1 + p_size % 6 AS INTEGER) FROM part WHERE p_retailprice > 1500")
def coverage_missing_layers(t):
    parts = t.table("part").selectExpr("p_brand AS brand", "CAST(CASE WHEN p_retailprice > 1500 THEN 1 + p_size % 6 ELSE 0 END AS int) AS layer")
    return rollups.missing_layers(parts, ("brand",)).distinct()


# --- names, paths, lines ---

_NAMES = POOLS + " UNION SELECT DISTINCT p_type FROM part UNION SELECT DISTINCT p_name FROM part"


def _names(t):
    pool = t.spark.sql(f"SELECT explode(array({quoted(PLANTED + REPORTED + ('CSPRNG', 'GCM', 'MD5', 'DES', 'SSLv3', 'TLS'))})) AS name")
    return naming.name_features(pool.unionByName(t.table("part").select(F.col("p_type").alias("name"))).unionByName(t.table("part").select(F.col("p_name").alias("name"))).distinct())


@query(over("SELECT name, token FROM tok", features(_NAMES)))
def normalize_name_tokens(t):
    return _names(t).select("name", F.explode("tokens").alias("token"))


@query(over("SELECT name, unnest(families) AS family FROM feat", features(_NAMES)))
def name_families(t):
    return _names(t).select("name", F.explode("families").alias("family"))


@query(over("SELECT name, unnest(params) AS param FROM feat", features(_NAMES)))
def name_parameters(t):
    return _names(t).select("name", F.explode("params").alias("param"))


@query(over("SELECT algorithm, name FROM compat", features(POOLS), COMPAT))
def algorithms_compatible_pairs(t):
    pool = t.spark.sql(f"SELECT explode(array({quoted(PLANTED + REPORTED + ('CSPRNG', 'GCM', 'MD5', 'DES', 'SSLv3', 'TLS'))})) AS name").distinct()
    return naming.compatible_pairs(pool.withColumnRenamed("name", "algorithm"), pool)


@query(over("SELECT DISTINCT file, path FROM cleaned", FRAMES, RESOLVE))
def normalize_paths(t):
    return t.raw_claims().select("file").filter("file is not null").distinct().select("file", paths.normalize_path(F.col("file")).alias("path"))


@query(over("SELECT project, file, resolved FROM resolved_paths", FRAMES, RESOLVE))
def resolve_suffix(t):
    return paths.resolve_paths(t.raw_claims(), t.files())


@query(over("SELECT x.project, x.id, count(*) FILTER (WHERE abs(c.line - x.line) <= 2) AS near, count(*) AS same_file FROM claims c JOIN accepted x ON x.project = c.project AND x.file = c.resolved GROUP BY 1, 2", FRAMES, RESOLVE))
def line_band_join(t):
    spots = t.accepted().withColumnRenamed("line", "spot").withColumnRenamed("file", "resolved")
    near = paths.location_matches(F.col("resolved"), F.col("spot"), F.col("resolved"), F.col("line"), 2)
    return t.claims().join(spots, ["project", "resolved"]).groupBy("project", "id").agg(F.count_if(near).alias("near"), F.count(F.lit(1)).alias("same_file"))


@query("SELECT s_name AS candidate, n_name AS project FROM (SELECT s_name, 'acme_' || n_name AS c FROM supplier JOIN nation ON s_nationkey = n_nationkey), nation WHERE c LIKE '%\\_' || n_name ESCAPE '\\'".replace("\\\\", "\\"))
def project_suffix_match(t):
    s, n = t.table("supplier"), t.table("nation")
    each = s.join(n, s.s_nationkey == n.n_nationkey).select("s_name", F.concat(F.lit("acme_"), "n_name").alias("candidate"))
    return paths.match_project(each, n.select(F.col("n_name").alias("project"))).filter("project is not null").select(F.col("s_name").alias("candidate"), "project")


@query("SELECT event_type, CAST(json_extract(props, '$.k') AS BIGINT) AS line, count(*) AS n FROM events WHERE CAST(json_extract(props, '$.k') AS BIGINT) > 0 GROUP BY 1, 2")
def coerce_line(t):
    v = F.try_variant_get(F.try_parse_json("props"), "$.k", "variant")
    return t.table("events").select("event_type", shred.coerce_line(v).alias("line")).filter("line is not null").groupBy("event_type", "line").agg(F.count(F.lit(1)).alias("n"))


@query("""WITH n AS (SELECT *, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) AS p FROM nation), w AS (SELECT r_name AS name, r_regionkey AS a, NULL AS b FROM region UNION ALL SELECT n_name, n_regionkey, p FROM n)
SELECT name, row_number() OVER (ORDER BY a DESC, b DESC NULLS FIRST) - 1 AS component FROM w""")
def nested_component_index(t):
    nations = t.table("nation").groupBy("n_regionkey").agg(F.array_sort(F.collect_list(F.struct("n_nationkey", "n_name"))).alias("n"))
    part = lambda name, *more: F.struct(F.lit("cryptographic-asset").alias("type"), name.alias("name"), *more)
    inner = F.transform("n", lambda x: part(x["n_name"])).alias("components")
    regions = t.table("region").join(nations, F.col("r_regionkey") == F.col("n_regionkey")).select("r_regionkey", part(F.col("r_name"), inner).alias("c"))
    raw = regions.agg(F.to_json(F.struct(F.transform(F.array_sort(F.collect_list(F.struct("r_regionkey", "c"))), lambda x: x["c"]).alias("components"))).alias("raw"))
    nodes = shred.components(shred.parse(raw.withColumn("source", F.lit("one"))))
    return nodes.select(F.try_variant_get("node", "$.name", "string").alias("name"), F.col("index").cast("long").alias("component"))


# --- documents: parsed, walked, shredded and scored ---

query(documents.PARSE_ERRORS)(documents.document_parse_errors)
query(documents.COMPONENTS)(documents.shredded_components)
query(documents.ASSETS)(documents.shredded_assets)
query(documents.CLAIMS)(documents.shredded_claims)
query(documents.SCHEMA_ERRORS)(documents.schema_errors)
query(documents.SAMPLES)(documents.sample_components)
query(over(documents.results_sql(_ratio), documents.spoken(FRAMES), RESOLVE, features(POOLS), COMPAT, VERDICTS, EVIDENCE, FALSE_POSITIVES))(documents.documents_scored)

_VALID = "CASE WHEN i.tool <> '5-LOW' THEN i.project <> 'p3' END"


@query(over(f"""SELECT tool, count(*) AS documents, CAST(sum(detected) AS BIGINT) AS detected, CAST(sum(credited_claims) AS BIGINT) AS credited_claims, CAST(sum(false_positives) AS BIGINT) AS false_positives, CAST(sum(total_occurrences) AS BIGINT) AS total_occurrences,
  {_ratio('sum(detected)', 'sum(total)')} AS detection_rate, {_ratio('sum(matched_components)', 'sum(crypto_components)')} AS component_precision, {_ratio('sum(credited_claims)', 'sum(distinct_claims)')} AS claim_precision,
  CASE WHEN sum(crypto_components) = 0 THEN 0.0 ELSE round_even(sum(total_occurrences) / sum(crypto_components), 3) END AS occurrences_per_component, CASE WHEN count(valid) = 0 THEN 'not run' ELSE CAST(count(*) FILTER (WHERE valid) AS VARCHAR) || ' of ' || count(valid) END AS schema_valid
FROM (SELECT r.*, phantom_algorithm + phantom_location AS false_positives, i.tool, {_VALID} AS valid FROM ({documents.results_sql(_ratio)}) r JOIN inputs i USING (source)) GROUP BY tool""", *SCORED, EVIDENCE, FALSE_POSITIVES))
def summary_by_tool(t):
    """Ratios of sums, occurrences a component and schema validity, which is not run for one tool."""
    t.kept |= {"claims", "hits"}
    valid = F.when(F.col("tool") != "5-LOW", F.col("project") != "p3")
    results = score.results(t.inputs().withColumn("parse_error", F.lit(None).cast("string")), t.verdicts(), t.hits(), score.evidence(t.inputs(), t.assets(), t.claims()), _classes(t)).withColumn("schema_valid", valid)
    per = rollups.per_tool(results)
    told = F.when(F.col("validated") == 0, F.col("schema_valid")).otherwise(F.concat(F.col("valid").cast("string"), F.lit(" of "), F.col("validated").cast("string")))
    return per.select("tool", "documents", "detected", "credited_claims", "false_positives", "total_occurrences", "detection_rate", F.col("precision").alias("component_precision"), "claim_precision", "occurrences_per_component", told.alias("schema_valid"))


@query(over(f"SELECT language, tool, CAST(layer AS VARCHAR) AS layer, count(*) FILTER (WHERE detected) AS detected, count(*) AS total, {_ratio('count(*) FILTER (WHERE detected)', 'count(*)')} AS rate FROM verdict GROUP BY 1, 2, 3", *SCORED))
def layer_rates_by_language(t):
    return rollups.layer_rates(t.verdicts(), ("language", "tool")).select("language", "tool", F.explode("by_layer").alias("layer", "v")).select("language", "tool", "layer", "v.*")


# --- text rules ---


@query("SELECT doc_id, count(*) AS lines, count(*) FILTER (WHERE fresh) AS runs, count(*) FILTER (WHERE fresh AND kind) AS pair_runs FROM (SELECT doc_id, kind, coalesce(lag(kind) OVER (PARTITION BY doc_id ORDER BY pos) <> kind, true) AS fresh FROM (SELECT doc_id, pos, line LIKE '%|%' AS kind FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS pos FROM documents))) GROUP BY doc_id")
def config_islands(t):
    lines = t.table("documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "line")).withColumn("kind", F.contains("line", F.lit("|")))
    runs = text.islands(lines, ["doc_id"], "pos", "kind").groupBy("doc_id", "island").agg(F.count(F.lit(1)).alias("n"), F.bool_or("kind").alias("kind"))
    return runs.groupBy("doc_id").agg(F.sum("n").alias("lines"), F.count(F.lit(1)).alias("runs"), F.count_if("kind").alias("pair_runs"))


_LINE = "CASE p_partkey % 6 WHEN 0 THEN 'call(); // @PS id-' || p_partkey || ' | ' || p_type || ' | ' || (p_partkey % 8) || ' | algorithm' WHEN 1 THEN 'x = 1; // @PS + id-' || (p_partkey - 1) WHEN 2 THEN 'int y; /* @PS b' || p_partkey || '|RSA|3|protocol|a note */' WHEN 3 THEN 'z // @PS only|three|2' WHEN 4 THEN 'plain // text' ELSE 'w // @PS c' || p_partkey || '|AES|x|algorithm' END"


@query(f"""WITH l AS (SELECT p_partkey AS line, {_LINE} AS text FROM part), b AS (SELECT line, trim(regexp_extract(text, '(?://|/\\*)\\s*@PS\\s+(.*?)\\s*(?:\\*/\\s*)?$', 1)) AS body FROM l WHERE contains(text, '@PS')),
f AS (SELECT line, body, list_transform(string_split(body, '|'), lambda x: trim(x)) AS p, starts_with(body, '+') AS alias FROM b)
SELECT CAST(line AS BIGINT) AS line, CASE WHEN alias THEN trim(substr(body, 2)) END AS target, CASE WHEN NOT alias THEN p[1] END AS id, CASE WHEN NOT alias THEN TRY_CAST(p[3] AS INTEGER) END AS layer, CASE WHEN alias THEN NULL WHEN len(p) NOT IN (4, 5) THEN 'needs 4 or 5 fields' WHEN TRY_CAST(p[3] AS INTEGER) IS NULL THEN 'layer is no number' WHEN TRY_CAST(p[3] AS INTEGER) NOT BETWEEN 1 AND 6 THEN 'unknown layer' END AS error FROM f""".replace("\\\\", "\\"))
def annotation_extract(t):
    lines = t.table("part").selectExpr("'src/a.c' AS path", "p_partkey AS line", f"{_LINE.replace('||', '||')} AS text")
    return text.parse_annotations(lines).select(F.col("line").cast("long").alias("line"), "target", "id", "layer", "error")


def _whole_word(inner: str, old: str, new: str) -> str:
    """ASCII word boundaries without look-around: twice, as neighbours share a boundary."""
    for _ in range(2):
        inner = rf"regexp_replace({inner}, '(^|[^A-Za-z0-9_]){old}($|[^A-Za-z0-9_])', '\1{new}\2', 'g')"
    return inner


@query(f"SELECT doc_id, sha256({_whole_word(_whole_word('text', 'tion', 'ACTION'), 'zq', 'ZQ')}) AS digest FROM documents")
def word_boundary_rename(t):
    return t.table("documents").select("doc_id", F.sha2(text.rename_words(F.col("text"), {"tion": "ACTION", "zq": "ZQ"}), 256).alias("digest"))


@query("SELECT p_partkey AS part, regexp_replace(split_part(image, '@', 1), ':[^/:]*$', '') AS repository FROM (SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'localhost:5000/' || p_brand WHEN 1 THEN p_brand || ':1.2' WHEN 2 THEN 'reg:80/' || p_brand || ':v3@sha256:ab' ELSE p_brand END AS image FROM part)")
def image_repositories(t):
    image = F.expr("CASE p_partkey % 4 WHEN 0 THEN concat('localhost:5000/', p_brand) WHEN 1 THEN concat(p_brand, ':1.2') WHEN 2 THEN concat('reg:80/', p_brand, ':v3@sha256:ab') ELSE p_brand END")
    return t.table("part").select(F.col("p_partkey").alias("part"), text.image_repository(image).alias("repository"))


@query(r"SELECT p_partkey AS part, regexp_replace(chr(27) || '[1;32m' || p_name || chr(27) || '[0m ' || p_size, chr(27) || '\[[0-9;]*[A-Za-z]', '', 'g') AS plain FROM part")
def ansi_strip(t):
    return t.table("part").select(F.col("p_partkey").alias("part"), text.strip_ansi(F.expr("concat(char(27), '[1;32m', p_name, char(27), '[0m ', p_size)")).alias("plain"))


def _scrubbed(x: str) -> str:
    """RE2 has no look-behind: the character before a path is captured and put back."""
    return rf"CASE WHEN starts_with({x}, '/') THEN '<external>/' || list_last(string_split(regexp_replace({x}, '/+$', ''), '/')) ELSE regexp_replace({x}, '(^|[^A-Za-z0-9_:/])/(?:[A-Za-z0-9_.+-]+/)+([A-Za-z0-9_.+-]+)', '\1<external>/\2', 'g') END"


@query(f"SELECT page_id, {_scrubbed('url')} AS url, {_scrubbed("'tool @ /build/root/' || page_id || '/bin'")} AS label, {_scrubbed("'/home/u' || page_id || '/bin/'")} AS whole FROM pages")
def path_scrub(t):
    return t.table("pages").select("page_id", text.scrub_paths("url").alias("url"), text.scrub_paths(F.concat(F.lit("tool @ /build/root/"), F.col("page_id").cast("string"), F.lit("/bin"))).alias("label"), text.scrub_paths(F.concat(F.lit("/home/u"), F.col("page_id").cast("string"), F.lit("/bin/"))).alias("whole"))


@query("SELECT url, regexp_extract(split_part(url, '?', 1), '(\\.[^./]+)$', 1) AS format FROM (SELECT DISTINCT url FROM pages)".replace("\\\\", "\\"))
def file_formats(t):
    return t.table("pages").select("url").distinct().select("url", paths.file_format(F.substring_index("url", "?", 1)).alias("format"))


@query("SELECT p_partkey AS part, (p_partkey % 5) = 0 OR (p_partkey % 7) = 0 AS kept FROM part")
def cwe_rule_filter(t):
    rules = t.table("part").selectExpr("p_partkey AS part", "concat('CWE-', CASE WHEN p_partkey % 5 = 0 THEN '327' ELSE '79' END, ': x; CWE-', CASE WHEN p_partkey % 7 = 0 THEN '295' ELSE '20' END) AS cwe")
    return rules.select("part", reports.names_cwe("cwe", ["327", "295", "326"]).alias("kept"))


# --- tables held against each other ---


@query("SELECT CAST(n_nationkey AS VARCHAR) AS name, sha256(n_nationkey || chr(31) || n_name || chr(31) || n_regionkey) AS sha256 FROM nation")
def digest_rows(t):
    return governance.row_digests(t.table("nation"), "n_nationkey")


@query("""WITH r AS (SELECT CAST(n_nationkey AS VARCHAR) AS name, sha256(n_name) AS d FROM nation WHERE n_nationkey <> 3), p AS (SELECT CAST(n_nationkey AS VARCHAR) AS name, sha256(CASE WHEN n_nationkey % 5 = 1 THEN n_name || '!' ELSE n_name END) AS d FROM nation WHERE n_nationkey <> 8)
SELECT coalesce(r.name, p.name) AS name, CASE WHEN p.name IS NULL THEN 'MISSING' WHEN r.name IS NULL THEN 'extra' WHEN r.d = p.d THEN 'ok' ELSE 'MISMATCH' END AS status FROM r FULL JOIN p ON r.name = p.name""")
def archive_verify(t):
    n = t.table("nation")
    recorded = n.filter("n_nationkey <> 3").select(F.col("n_nationkey").cast("string").alias("name"), F.sha2("n_name", 256).alias("sha256"))
    present = n.filter("n_nationkey <> 8").select(F.col("n_nationkey").cast("string").alias("name"), F.sha2(F.expr("CASE WHEN n_nationkey % 5 = 1 THEN concat(n_name, '!') ELSE n_name END"), 256).alias("sha256"))
    return governance.verify(recorded, present)


@query("SELECT 'd' || doc_id AS path, CASE WHEN doc_id % 7 = 0 THEN 'missing' WHEN doc_id % 5 = 0 THEN 'different' ELSE 'ok' END AS status FROM documents WHERE doc_id % 3 <> 0")
def generated_against_shipped(t):
    """Every third document is shipped but not generated, every seventh generated but not shipped, every fifth other than shipped."""
    files = t.table("documents").select("doc_id", F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("path"), F.col("text").alias("content"))
    shipped = files.filter("doc_id % 7 <> 0").withColumn("content", F.when(F.col("doc_id") % 5 == 0, F.concat("content", F.lit("."))).otherwise(F.col("content")))
    return governance.generated_and_shipped(files.filter("doc_id % 3 <> 0"), shipped)


@query("SELECT p_partkey AS part, CASE p_partkey % 4 WHEN 0 THEN 'sha256:2' WHEN 1 THEN 'sha256:1' WHEN 2 THEN 'sha256:1' END AS digest FROM part")
def image_digests(t):
    image = F.expr("concat('host:80/', p_brand, CASE p_partkey % 4 WHEN 0 THEN '@sha256:2' WHEN 1 THEN ':v1' WHEN 2 THEN '@sha256:9' ELSE '-other' END)")
    own = F.concat(F.lit("host:80/"), F.col("p_brand"))
    digests = F.array(F.concat(own, F.lit("x@sha256:0")), own, F.concat(own, F.lit("@sha256:1")), F.concat(own, F.lit("@sha256:2")))
    return t.table("part").select(F.col("p_partkey").alias("part"), governance.image_digest(image, digests).alias("digest"))


_LINKS = "(VALUES ('k0', 'benchmark'), ('k1', 'password'), ('k2', 'no such word anywhere'), ('k3', 'the')) h(algorithm, hint)"


@query(f"""WITH p AS (SELECT n_nationkey AS id, 'k' || (n_nationkey % 4) AS algorithm, 'd' || (n_nationkey + 1) AS file FROM nation), low AS (SELECT 'd' || doc_id AS path, lower(text) AS text FROM documents),
held AS (SELECT DISTINCT p.id, l.path, l.text FROM p JOIN {_LINKS} USING (algorithm) JOIN low l ON contains(l.text, h.hint)),
words AS (SELECT DISTINCT p.id, unnest(regexp_extract_all(lower(substr(text, 1, 60)), '[a-z_][a-z0-9_]{{3,}}')) AS symbol FROM p JOIN documents ON 'd' || doc_id = p.file)
SELECT p.id, EXISTS (SELECT 1 FROM held h WHERE h.id = p.id) AS held, EXISTS (SELECT 1 FROM held h JOIN words w ON w.id = h.id AND contains(h.text, w.symbol) WHERE h.id = p.id) AS linked FROM p""")
def symbol_links(t):
    """Nations are plants whose lines are the beginnings of documents; the documents are the files."""
    plants = t.table("nation").selectExpr("n_nationkey AS id", "concat('k', n_nationkey % 4) AS algorithm")
    files = t.table("documents").selectExpr("concat('d', doc_id) AS path", "text")
    places = t.table("nation").selectExpr("n_nationkey AS id", "concat('d', n_nationkey + 1) AS file", "1 AS line")
    hints = t.spark.createDataFrame([("k0", "benchmark"), ("k1", "password"), ("k2", "no such word anywhere"), ("k3", "the")], "algorithm string, hint string")
    return truth.linked(plants, places, files.selectExpr("path", "1 AS line", "substr(text, 1, 60) AS text"), files, hints)


@query("SELECT l_orderkey, l_partkey, count(*) AS n FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1")
def duplicate_ids(t):
    return governance.duplicates(t.table("lineitem"), ["l_orderkey", "l_partkey"])


@query("SELECT 'f' || l_partkey AS path FROM lineitem EXCEPT ALL SELECT 'f' || l_partkey FROM lineitem WHERE l_linenumber % 3 > 0")
def written_into_tree(t):
    """Paths stand several times on both sides; those that the first has more often are left, as often as that."""
    path = F.concat(F.lit("f"), F.col("l_partkey").cast("string")).alias("path")
    return governance.written_into(t.table("lineitem").select(path), t.table("lineitem").filter("l_linenumber % 3 > 0").select(path))


@query("SELECT user_id AS run, bool_or(NOT (event_id % 9 > 0)) AS dirty FROM events GROUP BY user_id")
def dirty_runs(t):
    return governance.dirty(t.table("events").selectExpr("user_id AS run", "CASE WHEN event_id % 9 > 0 THEN concat('runs/r', event_id, '/x') ELSE concat('src/', event_id) END AS path"))


@query("SELECT status, count(*) AS n, count(*) FILTER (WHERE status = 'ok') AS succeeded FROM (SELECT CASE WHEN event_id % 13 = 0 THEN 'timeout' WHEN event_id % 11 = 0 THEN 'error' WHEN user_id % 4 > 1 THEN 'failed' WHEN event_id % 7 = 0 THEN 'empty' WHEN event_type = 'click' THEN 'invalid-json' ELSE 'ok' END AS status FROM events) GROUP BY status")
def invocation_statuses(t):
    log = t.table("events").selectExpr("event_id % 13 = 0 AS timed_out", "CASE WHEN event_id % 11 <> 0 THEN cast(user_id % 4 AS int) END AS exit_code", "array(0, 1) AS accepted", "event_id % 7 AS bytes", "event_type <> 'click' AS is_json")
    return governance.invocation_status(log).groupBy("status").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("status") == "ok").alias("succeeded"))


@query(over("SELECT n.name, substr(sha256(n.name), 1, 16) AS ref, count(DISTINCT c.resolved || '|' || coalesce(CAST(c.line AS VARCHAR), '?')) FILTER (WHERE c.source IS NOT NULL) AS places FROM named n JOIN claims c ON c.source = n.source AND c.idx = n.idx WHERE c.resolved IS NOT NULL GROUP BY 1, 2", FRAMES, RESOLVE))
def component_writer(t):
    each = score.named(t.assets()).join(t.claims().filter("resolved is not null"), ["source", "index"]).select("name", F.col("resolved").alias("file"), "line")
    return governance.cbom_components(each).select("name", "ref", F.size("places").cast("long").alias("places"))


@query("SELECT source, list_sort(list_transform(m, lambda x: x)) AS errors FROM (SELECT source, CASE WHEN len(a) > 12 THEN list_append(a[1:12], '... more errors') ELSE a END AS m FROM (SELECT source, list('e' || doc_id ORDER BY doc_id) AS a FROM documents WHERE n_chars < 700 GROUP BY source))")
def validity_errors(t):
    errors = t.table("documents").filter("n_chars < 700").selectExpr("source", "doc_id AS place", "concat('e', doc_id) AS message")
    return rollups.per_source_errors(errors).select("source", F.array_sort("errors").alias("errors"))


# --- natural equivalents on documents ---


@query(f"SELECT d.source, d.lang, count(*) FILTER (WHERE l.toxic = 1) AS total, count(*) FILTER (WHERE l.toxic = 1 AND found) AS detected, {_ratio('count(*) FILTER (WHERE l.toxic = 1 AND found)', 'count(*) FILTER (WHERE l.toxic = 1)')} AS rate FROM (SELECT *, contains(lower(text), 'idiot') OR contains(lower(text), 'moron') AS found FROM documents) d JOIN labels l USING (doc_id) GROUP BY 1, 2")
def truth_vs_prediction_recall(t):
    low = F.lower("text")
    found = F.contains(low, F.lit("idiot")) | F.contains(low, F.lit("moron"))
    both = t.table("documents").select("doc_id", "source", "lang", found.alias("found")).join(t.table("labels").select("doc_id", "toxic"), "doc_id")
    toxic = F.col("toxic") == 1
    return both.groupBy("source", "lang").agg(F.count_if(toxic).alias("total"), F.count_if(toxic & F.col("found")).alias("detected")).withColumn("rate", score.ratio(F.col("detected"), F.col("total")))


@query("SELECT doc_id, item_id FROM documents d JOIN benchmark b ON contains(d.text, b.text)")
def planted_passage_hits(t):
    """Candidates share five words from within the passage; the passage itself is then sought in the text."""
    words = lambda c: F.filter(F.split(c, r"\s+"), lambda w: w != "")
    items = t.table("benchmark").select("item_id", F.col("text").alias("passage"), words("text").alias("w"))
    keyed = items.filter("size(w) >= 7").select("item_id", "passage", F.array_join(F.slice("w", 2, 5), " ").alias("key"))
    docs = t.table("documents").select("doc_id", "text")
    grams = docs.select("doc_id", words("text").alias("w")).select("doc_id", F.explode(F.array_distinct(F.transform("w", lambda x, i: F.array_join(F.slice("w", i + 1, 5), " ")))).alias("key"))
    near = grams.join(keyed.select("item_id", "key"), "key").select("doc_id", "item_id").distinct()
    short = docs.join(items.filter("size(w) < 7").select("item_id", "passage"), F.expr("instr(text, passage) > 0")).select("doc_id", "item_id")
    found = near.join(items.select("item_id", "passage"), "item_id").join(docs, "doc_id").filter(F.expr("instr(text, passage) > 0")).select("doc_id", "item_id")
    return found.unionByName(short)


@query("SELECT source, count(DISTINCT text) AS distinct_texts, count(*) AS texts FROM documents GROUP BY source")
def distinct_claims_dedup(t):
    return t.table("documents").select("source", F.sha2("text", 256).alias("d")).groupBy("source").agg(F.count_distinct("d").alias("distinct_texts"), F.count(F.lit(1)).alias("texts"))
