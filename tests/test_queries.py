"""Queries against their SQL twins on the smallest data, one or two of each kind."""

import duckdb
import pytest

import __spark_entry__ as entry
from tallyloom.plans.views import BASE
from tools.check import compare

FOLDER = "/root/testdata/sf0.001"
SAMPLE = [
    "k02_period_matrix", "k03_career_kpi", "k17_goal_summary", "k33_population_overlaps", "p01_canonical_participants", "p12_director_state",
    "flt02_audited_escape", "flt08_career_scope", "flt26_safe_paths", "jn03_production_authors", "jn15_project_evidence", "jn17_counterpart_options",
    "w03_version_promotion", "w04_pair_reconciliation", "w12_partial_matches", "src07_import_goals", "src12_intake_dedupe", "src17_purge_batch",
    "set02_scope_rollup", "set09_verify_snapshot", "au02_chain_check", "au05_table_digest", "t01_line_table", "t03_sections", "t09_project_rows",
    "t15_product_records", "t19_title_quality", "id10_cluster_resolution", "id14_canonical_resolution", "id19_evidence_components", "ov01_effective_overlay",
    "ov09_version_fold", "ov11_reversals", "st02_version_promotion", "st03_decision_fold",
]


@pytest.fixture(scope="module")
def con():
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for name in BASE:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{FOLDER}/{name}.parquet'")
    return con


@pytest.mark.parametrize("name", SAMPLE)
def test_matches_sql(spark, con, name):
    result = entry.queries()[name](spark, FOLDER).toArrow()
    assert compare(con, result, entry.oracle_sql()[name]).startswith("ok")


def test_register_is_consistent():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry(spark):
    assert entry.entry(spark).count() > 0
