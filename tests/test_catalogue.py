"""The query catalogue against its SQL, on the smallest tables."""

import duckdb
import pytest
from plumbline.plans import catalogue

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
FAST = [
    "algorithms_compatible_pairs", "normalize_name_tokens", "name_families", "name_parameters", "resolve_suffix", "normalize_paths", "evidence_quality", "line_band_join", "unscored_pairs", "coverage_missing_layers", "project_suffix_match",
    "coerce_line", "nested_component_index", "config_islands", "annotation_extract", "word_boundary_rename", "image_repositories", "ansi_strip", "file_formats", "cwe_rule_filter", "digest_rows", "archive_verify",
    "duplicate_ids", "written_into_tree", "dirty_runs", "invocation_statuses", "component_writer", "validity_errors", "truth_vs_prediction_recall", "planted_passage_hits", "distinct_claims_dedup", "verdict_flags", "false_positive_cascade",
    "path_scrub", "generated_against_shipped", "image_digests", "symbol_links", "document_parse_errors", "shredded_components", "shredded_assets", "shredded_claims",
]


def plain(rows):
    def value(v):
        if isinstance(v, float):
            return round(v, 6)
        return tuple(map(value, v)) if isinstance(v, (list, tuple)) else v

    return sorted((tuple(map(value, r)) for r in rows), key=repr)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", FAST)
def test_query(spark, duck, name):
    df = catalogue.queries()[name](spark, SF)
    columns = sorted(df.columns)
    want = duck.sql(catalogue.oracle_sql()[name])
    assert sorted(want.columns) == columns
    picked = ", ".join(f'"{c}"' for c in columns)
    assert plain(df.select(*columns).collect()) == plain(duck.sql(f"SELECT {picked} FROM ({catalogue.oracle_sql()[name]})").fetchall())


def test_registry():
    assert set(catalogue.oracle_sql()) == set(catalogue.queries())
