"""Every registered query against its SQL oracle at the smallest scale."""

import pytest
from oracle import differs, duck

from ondula.plans import load

SF = "/root/testdata/sf0.001"
NAMES = sorted(load())


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, con, name):
    q = load()[name]
    df = q.run(spark, SF)
    rows = [tuple(r) for r in df.collect()]
    if q.sql is None:
        assert rows
        return
    cur = con.execute(q.oracle())
    names = [d[0] for d in cur.description]
    assert differs(rows, df.columns, cur.fetchall(), names) is None


def test_contract():
    import __spark_entry__ as e
    assert set(e.oracle_sql()) <= set(e.queries())
    assert set(load()) <= set(e.queries())
