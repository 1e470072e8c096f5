"""Every registered query against its DuckDB answer on the smallest tables."""

import os

import duckdb
import pytest

import __spark_entry__ as entry

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings "
    "pages benchmark labels conversations"
).split()
DUCK_TYPES = {"INTEGER": "int", "BIGINT": "bigint", "VARCHAR": "string", "DOUBLE": "double", "BOOLEAN": "boolean"}

pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF_DIR}/{name}.parquet'")
    yield con
    con.close()


def _sorted(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(row[i] for i in order) for row in rows), key=repr)


@pytest.mark.parametrize("name", sorted(entry.queries()))
def test_query(spark, duck, name):
    df = entry.queries()[name](spark, SF_DIR)
    rows = [tuple(r) for r in df.collect()]
    sql = entry.oracle_sql().get(name)
    if sql is None:
        assert rows
        return
    answer = duck.execute(sql)
    types = {d[0]: DUCK_TYPES.get(str(d[1]), str(d[1])) for d in answer.description}
    assert dict(df.dtypes) == types
    assert _sorted(df.columns, rows) == _sorted([d[0] for d in answer.description], answer.fetchall())


def test_every_expected_answer_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_every_rule_fires(spark):
    """The catalogue's query compares no rule that finds nothing."""
    assert all(r.hits > 0 for r in entry.queries()["rule_catalogue_hits"](spark, SF_DIR).collect())


def test_entry(spark):
    assert entry.entry(spark).count() > 0
