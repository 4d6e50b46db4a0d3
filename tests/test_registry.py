"""A quick slice of the registered queries against their SQL at the smallest scale; the rest runs in oracle_check."""

import pytest

import __spark_entry__ as entry
from tests.oracle_check import compare, connect
from vigitab.plans.load import REGISTRY

PATH = "/root/testdata/sf0.001"
QUICK = [
    "signals_exposed_pairs", "latest_cases", "term_cascade", "history_redirect", "agent_and_name_keys", "parsed_dates", "unique_title_match",
    "valid_denominator", "missingness", "exact_quartiles", "crosstab", "metrics", "grouped_folds", "calibration_bins", "coefficient_stability",
    "grain_audit", "boundary_scan", "matrix_scan", "fingerprint_verified",
]


@pytest.fixture(scope="module")
def con():
    return connect(PATH)


@pytest.mark.parametrize("name", QUICK)
def test_query_equals_sql(spark, con, name):
    err, rows = compare(REGISTRY[name], spark, PATH, con)
    assert err in (None, "no rows"), err  # both engines may agree on an empty result at this scale


def test_contract(spark):
    assert set(entry.oracle_sql()) <= set(entry.queries())
    df = entry.entry(spark)
    assert {"entity", "event", "horizon", "ror", "ic025"} <= set(df.columns)


def test_filter_and_columns_reach_the_scan(spark):
    plan = REGISTRY["filtered_scan"].run(spark, PATH)._jdf.queryExecution().toString()
    assert "PushedFilters: [IsNotNull(l_returnflag)" in plan
    assert "ReadSchema: struct<l_orderkey:bigint,l_quantity:double,l_returnflag:string>" in plan


@pytest.mark.parametrize("name", ["signals_exposed_pairs", "second_db_cells", "metrics", "exact_quartiles"])
def test_no_nested_loop_joins(spark, name):
    plan = REGISTRY[name].run(spark, PATH)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "CartesianProduct" not in plan
