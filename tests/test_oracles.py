import duckdb
import pytest

import __spark_entry__ as entry
from tools.compare import expected, rows_of

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "pages", "benchmark", "labels", "conversations")
QUERIES = entry.plans.QUERIES
ORACLE = entry.plans.ORACLE


@pytest.fixture(scope="module")
def con(data):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{data}/{t}.parquet')")
    return con


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_equals_its_oracle(spark, con, data, name):
    assert rows_of(QUERIES[name](spark, data)) == expected(con, ORACLE[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE)))
def test_query_without_oracle_has_rows(spark, data, name):
    assert QUERIES[name](spark, data).count() > 0


def test_entry(spark):
    got = entry.entry(spark)
    assert got.columns == ["id", "total_score", "source_type", "title"] and got.count() > 0


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["join_dep_out", "join_dep_in", "gx_relations", "join_containment", "join_target_symbol", "join_component_by_name", "dq_scope"])
def test_joins_have_equi_keys(spark, data, name):
    text = plan(QUERIES[name](spark, data))
    assert "NestedLoop" not in text and "Cartesian" not in text


def test_group_top_k_is_cut_before_the_shuffle(spark, data):
    assert "WindowGroupLimit" in plan(QUERIES["gx_topn"](spark, data)) or "TakeOrderedAndProject" in plan(QUERIES["gx_topn"](spark, data))


def test_filters_and_columns_reach_the_scan(spark, data):
    text = plan(QUERIES["flt_enum"](spark, data))
    assert "EqualTo(event_type,error)" in text
    assert "ReadSchema: struct<event_id:bigint,event_type:string>" in text


@pytest.mark.parametrize("name", ["sea_order_page", "ten_users_page", "kq_nodes", "job_claim_next"])
def test_pages_are_top_k(spark, data, name):
    assert "TakeOrderedAndProject" in plan(QUERIES[name](spark, data))
