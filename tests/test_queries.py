"""Every registered relational query against its DuckDB twin, and the shape of plans."""

import pytest

import __spark_entry__ as entry
from compare import differences, duckdb_views
from riskloom.queries.models import QUERIES as MODELS
from riskloom.queries.oracles import ORACLES
from riskloom.queries.relational import QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return duckdb_views(SF)


def test_all_relational_queries_have_a_twin():
    checked = {name for name in MODELS if name.endswith("_checked")}
    assert set(QUERIES) | checked == set(ORACLES) <= set(entry.oracle_sql()) and set(QUERIES) <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_its_twin(spark, con, name):
    assert differences(QUERIES[name](spark, SF), con, entry.oracle_sql()[name]) == []


@pytest.mark.parametrize("name", sorted(name for name in MODELS if name.endswith("_checked")))
def test_models_hold_what_sql_can_say(spark, name):
    folder = "/root/testdata/sf0.01"  # the smallest tables are too few rows to learn from
    assert differences(MODELS[name](spark, folder), duckdb_views(folder), entry.oracle_sql()[name]) == []


def test_entry(spark):
    assert entry.entry(spark).count() > 0


@pytest.mark.parametrize("name", ["lexical_features", "domain_features", "clean_urls", "char_tfidf", "confusion_matrix"])
def test_plans_have_no_cross_joins(spark, name):
    plan = QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_features_read_one_column_and_shuffle_nothing(spark):
    plan = QUERIES["lexical_features"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "ReadSchema: struct<page_id:bigint,url:string>" in plan
