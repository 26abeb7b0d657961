"""Queries against their SQL in another engine, on the smallest tables."""

import decimal

import duckdb
import pytest

from tessera import catalogue

FOLDER = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
#: A share of the catalogue, one or more of each area; the driver compares all.
CHOSEN = [
    "exposure_span_having", "covariate_prevalence_topn", "outcome_post_index", "censoring_tar_obs", "rest_comparator", "era_collapse", "cohort_overlap", "codeset_closure", "retired_forwarding", "rollup_redundant", "lca", "k_hop_descendants",
    "rule_absence", "group_nested", "attrition_levels", "exit_custom_era", "cohort_collapsed_eras", "compiled_from_json", "weight_trim_p99", "smd_weighted", "km_curve", "logrank", "vector_topk", "rrf", "set_pairing", "evidence_states", "user_sessions",
    "document_criteria", "document_covered_ranges", "document_ranges_joined", "synonym_expansion", "synonym_graph_reached", "expanded_clinical", "two_stage_search", "concordance_index",
    "lint_contradicted", "lint_covered_ranges", "repair_restated_absences", "repair_split_bands", "lint_unsatisfiable", "repair_alternative_bands", "inherited_bounds", "bound_agreement", "audit_reconciled",
]


def plain(v):
    return round(float(v), 5) if isinstance(v, (float, decimal.Decimal)) else v


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", CHOSEN)
def test_query_equals_its_sql(spark, duck, name):
    df = catalogue.QUERIES[name](spark, FOLDER)
    columns = sorted(df.columns)
    got = sorted(([plain(r[c]) for c in columns] for r in df.collect()), key=repr)
    result = duck.execute(catalogue.ORACLE_SQL[name])
    names = [d[0] for d in result.description]
    assert sorted(names) == columns
    at = [names.index(c) for c in columns]
    assert got == sorted(([plain(r[i]) for i in at] for r in result.fetchall()), key=repr)


def test_every_sql_belongs_to_a_query():
    assert set(catalogue.ORACLE_SQL) <= set(catalogue.QUERIES) and len(catalogue.QUERIES) >= 90


def test_flagship(spark):
    import __spark_entry__

    out = __spark_entry__.entry(spark)
    assert out.columns == ["person_id", "index_date", "time", "event"] and out.count() > 0
