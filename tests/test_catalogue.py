"""Every query against DuckDB on the smallest tables, as the driver compares them."""

import os

import duckdb
import pytest
from narravane.functions.dialect import operator, steps
from narravane.plans import catalogue

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
TYPES = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN"}


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        path = f"{SF}/{t}.parquet"
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{path}{'/*.parquet' if os.path.isdir(path) else ''}'")
    return con


@pytest.mark.parametrize("name", sorted(catalogue.ORACLE_SQL))
def test_equals_duckdb(spark, duck, name):
    got = catalogue.QUERIES[name](spark, SF)
    want = duck.sql(catalogue.ORACLE_SQL[name])
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    kinds = dict(zip(want.columns, map(str, want.types), strict=True))
    assert {f.name: TYPES[f.dataType.simpleString()] for f in got.schema} == kinds
    order = [want.columns.index(c) for c in columns]
    rows = sorted(repr(tuple(r[i] for i in order)) for r in want.fetchall())
    assert sorted(repr(tuple(r[c] for c in columns)) for r in got.collect()) == rows


@pytest.mark.parametrize("name", sorted(catalogue.MODELS))
def test_models_give_rows(spark, name):
    assert catalogue.QUERIES[name](spark, SF).count() > 0


@pytest.mark.parametrize("name", ["actor_hits", "actor_pairs", "text_coordination", "snapshot"])
def test_shared_inputs_in_a_fresh_session(spark, name):
    assert catalogue.QUERIES[name](spark.newSession(), SF).count() > 0


def test_operators_leave_the_views_of_the_session_alone(spark):
    spark.range(3).createOrReplaceTempView("a")
    out = operator("b")(lambda d: "WITH a AS (SELECT id + 1 AS id FROM b WHERE ')' <> ''), c AS (SELECT * FROM a JOIN b USING (id)) SELECT count(*) AS n FROM c")(spark.range(5))
    assert out.first().n == 4 and spark.table("a").count() == 3
    assert not spark.catalog.tableExists("b") and not spark.catalog.tableExists("c")
    spark.catalog.dropTempView("a")


def test_steps_of_a_text():
    assert steps("SELECT 1") == ([], "SELECT 1")
    assert steps(" WITH a AS (SELECT '(' AS x), b AS (SELECT f(1)) SELECT (2)") == ([("a", "SELECT '(' AS x"), ("b", "SELECT f(1)")], "SELECT (2)")


@pytest.mark.parametrize("name", ["phrase_pmi", "first_labels"])
def test_phrases_are_counted_once(spark, name):
    """The counts are written; else each part of the plan that reads them explodes and shuffles all phrases again."""
    assert "Generate" not in catalogue.QUERIES[name](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
