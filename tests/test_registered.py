"""Every registered query against its SQL check, or for rows where SQL has none."""

import pytest

import __spark_entry__ as contract
from checking import compare, connect

SCALES = ["/root/testdata/sf0.001", "/root/testdata/sf0.01"]
QUERIES = contract.queries()
CHECKS = contract.oracle_sql()


@pytest.fixture(scope="module", params=SCALES)
def tables(request):
    return request.param, connect(request.param)


@pytest.mark.parametrize("name", sorted(CHECKS))
def test_same_rows_as_sql(spark, tables, name):
    sf_dir, connection = tables
    assert compare(spark, connection, QUERIES[name], CHECKS[name], sf_dir) == []


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(CHECKS)))
def test_rows_without_sql(spark, name):
    frame = QUERIES[name](spark, SCALES[0])
    rows = frame.collect()
    assert rows
    assert len(set(frame.columns)) == len(frame.columns)


def test_checks_name_registered_queries():
    assert set(CHECKS) <= set(QUERIES)


def test_entry_has_one_residual_per_test_entity(spark):
    rows = contract.entry(spark).collect()
    assert rows and len({r["entity"] for r in rows}) == len(rows)
    for r in rows:
        assert r["LR_Res"] == pytest.approx(r["LR_prediction"] - r["revenue"])
        assert r["LR_MAPE"] == pytest.approx(r["LR_Res"] / r["revenue"])
