"""DuckDB SQL of the same frames and rules, written relationally rather than with the engine's expressions."""

from __future__ import annotations

from plumbline.functions import tables
from plumbline.plans.frames import PLANTED, REPORTED, quoted


def _values(rows) -> str:
    return ", ".join("(" + ", ".join("NULL" if v is None else "'" + v.replace("'", "''") + "'" for v in r) + ")" for r in rows)


FRAMES = rf"""
plants AS (SELECT 'p' || (p_partkey % 6) AS project, p_partkey AS id, 'src/f' || (p_partkey // 8) || '.c' AS file, p_size AS line,
  list_value({quoted(PLANTED)})[1 + p_partkey % {len(PLANTED)}] AS algorithm, CAST(1 + (p_partkey // 6) % 6 AS INTEGER) AS layer FROM part),
accepted AS (SELECT project, id, file, line FROM plants UNION ALL
  SELECT 'p' || (p_partkey % 6), p_partkey, 'src/f' || ((p_partkey + 8) // 8) || '.c', p_size + 5 FROM part WHERE p_partkey % 10 = 0),
inputs AS (SELECT DISTINCT 'p' || (o_custkey % 6) || '__' || o_orderpriority AS source, 'p' || (o_custkey % 6) AS project, 'l' || ((o_custkey % 6) % 4) AS language, o_orderpriority AS tool FROM orders),
assets AS (SELECT 'p' || (o_custkey % 6) || '__' || o_orderpriority AS source, o_orderkey AS idx, list_value({quoted(REPORTED)}) AS pool, o_orderstatus = 'P' AS is_dependency FROM orders),
named AS (SELECT DISTINCT source, idx, is_dependency, pool[1 + idx % {len(REPORTED)}] AS name FROM assets
  UNION SELECT DISTINCT source, idx, is_dependency, pool[1 + (idx // {len(REPORTED)}) % {len(REPORTED)}] FROM assets WHERE idx % 3 = 0),
raw_claims AS (SELECT 'p' || (o_custkey % 6) || '__' || o_orderpriority AS source, 'p' || (o_custkey % 6) AS project, o_orderkey AS idx,
  CASE l_linenumber % 7 WHEN 0 THEN NULL WHEN 1 THEN '/tmp/x/src/f' || (l_partkey // 8) || '.c' WHEN 2 THEN './src/f' || (l_partkey // 8) || '.c' WHEN 3 THEN 'src\f' || (l_partkey // 8) || '.c' WHEN 4 THEN ' f' || (l_partkey // 8) || '.c ' ELSE 'src/f' || (l_partkey // 8) || '.c' END AS file,
  CASE WHEN l_linenumber % 5 = 0 THEN NULL ELSE l_linenumber * 7 END AS line, CASE WHEN l_linenumber % 2 = 0 THEN 'properties' ELSE 'evidence.occurrences' END AS shape
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
files AS (SELECT DISTINCT project, file AS path FROM accepted)
"""

RESOLVE = r"""
cleaned AS (SELECT DISTINCT project, file, ltrim(regexp_replace(replace(trim(file, ' ' || chr(9) || chr(10)), '\', '/'), '^(\./)+', ''), '/') AS path FROM raw_claims WHERE file IS NOT NULL),
tails AS (SELECT project, path, array_to_string(string_split(path, '/')[i:], '/') AS suffix FROM files, range(1, 12) r(i) WHERE i <= len(string_split(path, '/'))),
single AS (SELECT project, suffix, min(path) AS path FROM tails GROUP BY 1, 2 HAVING count(*) = 1),
found AS (SELECT c.project, c.file, arg_min(s.path, i) AS path FROM cleaned c, range(1, 12) r(i) JOIN single s ON s.project = c.project AND s.suffix = array_to_string(string_split(c.path, '/')[i:], '/')
  WHERE i <= len(string_split(c.path, '/')) GROUP BY 1, 2),
resolved_paths AS (SELECT c.project, c.file, coalesce(f.path, d.path) AS resolved FROM cleaned c LEFT JOIN files f ON f.project = c.project AND f.path = c.path LEFT JOIN found d ON d.project = c.project AND d.file = c.file),
claims AS (SELECT c.*, r.resolved FROM raw_claims c LEFT JOIN resolved_paths r ON r.project = c.project AND r.file = c.file)
"""


def features(source: str) -> str:
    """CTEs tok(name, token) and feat(name, tokens, families, params) of the names that `source` selects."""
    stop, whole = quoted(tables.STOPWORDS), quoted(tables.WHOLE_ONLY)
    return rf"""
nm AS ({source}),
markers(marker, family) AS (VALUES {_values(tables.MARKERS.items())}),
aliases(k, t) AS (VALUES {_values(tables.ALIASES.items())}),
cut AS (SELECT name, list_filter(string_split_regex(split_part(upper(trim(name)), '@', 1), '[^A-Z0-9]+'), lambda x: x <> '') AS parts FROM nm),
squashed AS (SELECT name, parts, array_to_string(parts, '') AS s, list_transform(range(len(parts)), lambda i: length(array_to_string(parts[1:i], ''))) AS starts FROM cut),
shown AS (SELECT DISTINCT name, family AS token FROM squashed, markers, range(1, 200) p(i) WHERE i <= length(s) AND substr(s, i, length(marker)) = marker
  AND (list_contains(starts, i - 1) OR (i > 1 AND regexp_matches(substr(s, i - 1, 1), '[0-9]'))) AND NOT (marker = 'DSA' AND regexp_matches(substr(s, 1, i - 1), '(ML|SLH|FN)$'))
  AND NOT (regexp_matches(marker, '[0-9]$') AND regexp_matches(substr(s, i + length(marker), 1), '[0-9]'))),
part_rows AS (SELECT name, unnest(parts) AS part, unnest(range(1, len(parts) + 1)) AS pos FROM squashed),
aliased AS (SELECT name, pos, part, coalesce(t, part) AS tok, lag(part) OVER (PARTITION BY name ORDER BY pos) AS prev FROM part_rows LEFT JOIN aliases ON k = part),
telling AS (SELECT name, tok FROM aliased WHERE part NOT IN ({stop}) AND NOT regexp_full_match(part, '[0-9]+')),
own AS (SELECT name, tok FROM aliased x WHERE part NOT IN ({stop}) AND tok NOT IN ({stop}) AND NOT (part = 'DSA' AND coalesce(prev, '') IN ({quoted(tables.DSA_PREFIXES)}))
  AND NOT (tok IN ({whole}) AND EXISTS (SELECT 1 FROM telling t WHERE t.name = x.name AND t.tok <> x.tok AND t.tok NOT IN ({quoted(tables.QUALIFIERS)})))),
stems AS (SELECT name, coalesce(t, regexp_extract(tok, '^([A-Z]+)', 1)) AS token FROM own LEFT JOIN aliases ON k = regexp_extract(tok, '^([A-Z]+)', 1) WHERE regexp_full_match(tok, '[A-Z]+[0-9]+')),
most AS (SELECT * FROM shown UNION SELECT * FROM own UNION SELECT * FROM stems WHERE token NOT IN ({stop}) UNION SELECT name, regexp_extract(tok, '([0-9]+)$', 1) FROM own WHERE regexp_full_match(tok, '[A-Z]+[0-9]+')),
tok AS (SELECT name, token FROM most UNION SELECT name, 'ECDSA' FROM most WHERE token IN ({quoted(tables.CURVES)})),
sizes AS (SELECT DISTINCT name, unnest(regexp_extract_all(s, '[0-9]+')) AS size FROM squashed),
feat AS (SELECT n.name, (SELECT coalesce(list(token ORDER BY token), []) FROM tok t WHERE t.name = n.name) AS tokens, (SELECT coalesce(list(token ORDER BY token), []) FROM tok t WHERE t.name = n.name AND token IN ({quoted(tables.FAMILIES)})) AS families,
  (SELECT coalesce(list(size ORDER BY size), []) FROM sizes z WHERE z.name = n.name AND size IN ({quoted(tables.SIZES)})) AS params FROM (SELECT DISTINCT name FROM nm) n)
"""


POOLS = f"SELECT unnest([{quoted(PLANTED)}]) AS name UNION SELECT unnest([{quoted(REPORTED)}]) UNION SELECT unnest(['CSPRNG', 'GCM', 'MD5', 'DES', 'SSLv3', 'TLS'])"

COMPAT = f"""
compat AS (SELECT p.name AS algorithm, r.name AS name FROM feat p, feat r WHERE len(p.tokens) > 0 AND len(r.tokens) > 0
  AND CASE WHEN len(p.families) > 0 AND len(r.families) > 0 THEN len(list_intersect(p.families, r.families)) > 0
      ELSE len(list_intersect(p.tokens, r.tokens)) > 0 AND (len(p.families) = 0 OR len(list_filter(list_intersect(p.tokens, r.tokens), lambda x: x NOT IN ({quoted(tables.QUALIFIERS)}))) > 0) END
  AND NOT (len(p.families) > 0 AND p.families = r.families AND len(p.params) > 0 AND len(r.params) > 0 AND len(list_intersect(p.params, r.params)) = 0))
"""

VERDICTS = """
credible AS (SELECT DISTINCT source, idx, is_dependency, algorithm FROM named JOIN compat USING (name) WHERE algorithm IN (SELECT algorithm FROM plants)),
hit AS (SELECT c.source, p.id, c.idx, a.is_dependency, c.resolved AS file, bool_or(coalesce(abs(c.line - x.line) <= 2, false)) AS located,
    bool_or(EXISTS (SELECT 1 FROM credible k WHERE k.source = c.source AND k.idx = c.idx AND k.algorithm = p.algorithm)) AS ok
  FROM claims c JOIN assets a ON a.source = c.source AND a.idx = c.idx JOIN accepted x ON x.project = c.project AND x.file = c.resolved JOIN plants p ON p.project = x.project AND p.id = x.id
  WHERE NOT a.is_dependency OR p.layer = 5 GROUP BY 1, 2, 3, 4, 5),
verdict AS (SELECT i.source, i.project, i.language, i.tool, p.id, p.file, p.line, p.algorithm, p.layer, coalesce(h.detected, false) AS detected, coalesce(h.located, false) AS located, h.source IS NOT NULL AS file_only,
    EXISTS (SELECT 1 FROM credible k WHERE k.source = i.source AND k.algorithm = p.algorithm AND (NOT k.is_dependency OR p.layer = 5)) AS name_only, h.first_idx AS matched_component, h.first_dep AS by_dependency
  FROM inputs i JOIN plants p USING (project) LEFT JOIN (SELECT source, id, bool_or(ok) AS detected, bool_or(located) AS located, min(idx) FILTER (WHERE ok) AS first_idx, arg_min(is_dependency, idx) FILTER (WHERE ok) AS first_dep FROM hit GROUP BY 1, 2) h ON h.source = i.source AND h.id = p.id)
"""

EVIDENCE = """
per_asset AS (SELECT a.source, a.idx, count(c.source) AS n, count(c.file) AS filed, count(*) FILTER (WHERE c.file IS NOT NULL AND c.line IS NOT NULL) AS lined, count(*) FILTER (WHERE c.shape = 'evidence.occurrences') AS spec,
    count(*) FILTER (WHERE c.file IS NOT NULL AND c.resolved IS NOT NULL) AS found, count(*) FILTER (WHERE c.file IS NOT NULL AND c.resolved IS NULL) AS lost,
    count(DISTINCT coalesce(c.resolved, '?') || '|' || coalesce(CAST(c.line AS VARCHAR), '?')) FILTER (WHERE c.source IS NOT NULL) AS claims
  FROM assets a LEFT JOIN claims c ON c.source = a.source AND c.idx = a.idx WHERE NOT a.is_dependency GROUP BY 1, 2),
evidence AS (SELECT i.source, count(p.idx) AS crypto_components, count(*) FILTER (WHERE filed > 0) AS with_location, count(*) FILTER (WHERE lined > 0) AS with_line, count(*) FILTER (WHERE spec > 0) AS using_spec_evidence,
    count(*) FILTER (WHERE spec = 0 AND n > 0) AS using_properties_only, CAST(coalesce(sum(n), 0) AS BIGINT) AS total_occurrences, CAST(coalesce(sum(claims), 0) AS BIGINT) AS distinct_claims,
    CAST(coalesce(sum(found), 0) AS BIGINT) AS resolvable_locations, CAST(coalesce(sum(lost), 0) AS BIGINT) AS unresolvable_locations FROM inputs i LEFT JOIN per_asset p USING (source) GROUP BY 1)
"""

FALSE_POSITIVES = """
allowances(algorithm, a_project, a_file) AS (VALUES ('CSPRNG', NULL, NULL), ('GCM', NULL, NULL), ('MD5', 'p1', 'src/f3.c'), ('DES', 'p2', NULL), ('SSLv3', 'p0', 'src/f5.c'), ('TLS', NULL, NULL)),
matched AS (SELECT DISTINCT source, matched_component AS idx FROM verdict WHERE matched_component IS NOT NULL AND NOT by_dependency),
placed AS (SELECT c.*, EXISTS (SELECT 1 FROM accepted x WHERE x.project = c.project AND x.file = c.resolved) AS planted FROM claims c),
by_claims AS (SELECT source, idx, count(file) > 0 AS has_location, count(resolved) > 0 AS some_resolved, bool_or(planted) AS on_plant FROM placed GROUP BY 1, 2),
classes AS (SELECT a.source, a.idx, CASE
    WHEN EXISTS (SELECT 1 FROM named n JOIN feat f USING (name) WHERE n.source = a.source AND n.idx = a.idx AND len(f.families) > 0)
     AND NOT EXISTS (SELECT 1 FROM credible k JOIN (SELECT DISTINCT project, algorithm FROM plants) q ON q.algorithm = k.algorithm WHERE k.source = a.source AND k.idx = a.idx AND q.project = i.project)
     AND NOT EXISTS (SELECT 1 FROM named n JOIN compat m USING (name) JOIN allowances l ON l.algorithm = m.algorithm WHERE n.source = a.source AND n.idx = a.idx AND (a_project IS NULL OR a_project = i.project)
       AND (a_file IS NULL OR NOT coalesce(b.has_location, false) OR EXISTS (SELECT 1 FROM claims c WHERE c.source = a.source AND c.idx = a.idx AND c.resolved = a_file))) THEN 'phantom_algorithm'
    WHEN coalesce(b.has_location, false) AND NOT coalesce(b.some_resolved, false) AND NOT coalesce(b.on_plant, false) THEN 'phantom_location' WHEN NOT coalesce(b.on_plant, false) THEN 'unmatched' ELSE 'near' END AS verdict
  FROM assets a JOIN inputs i USING (source) LEFT JOIN by_claims b ON b.source = a.source AND b.idx = a.idx WHERE NOT a.is_dependency AND NOT EXISTS (SELECT 1 FROM matched m WHERE m.source = a.source AND m.idx = a.idx))
"""


def over(select: str, *parts: str) -> str:
    return "WITH " + ",".join(p.strip() for p in parts) + "\n" + select


SCORED = (FRAMES, RESOLVE, features(POOLS), COMPAT, VERDICTS)
