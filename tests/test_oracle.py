"""Every registered query beside its SQL on the smallest tables."""

import pytest
from conftest import FOLDER

import __spark_entry__ as entry
from tools.check import compare, oracle

QUERIES, SQL = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    return oracle(FOLDER)


def test_every_query_has_sql():
    apart = set(entry.llm.QUERIES) | {"pipeline"} if entry.llm else set()
    assert sorted(set(QUERIES) - apart) == sorted(set(SQL) - apart)


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows(spark, duck, name):
    frame = QUERIES[name](spark, FOLDER)
    got = [tuple(r) for r in frame.collect()]
    result = duck.execute(SQL[name])
    columns = [c[0] for c in result.description]
    assert compare(frame.columns, got, columns, result.fetchall()) == ""


def test_flagship(spark):
    frame = entry.entry(spark)
    assert frame.columns[:3] == ["server_id", "datname", "queryid"]
    assert frame.count() > 0
