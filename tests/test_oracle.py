"""Every registered query against its DuckDB twin (the correctness gate of
the driver, run here on the smallest scale factor)."""

import pytest

import __spark_entry__ as E
from check_oracle import digest, duck
from conftest import SF_SMALL

# queries without SQL have brute-force tests of their own
NAMES = sorted(E.oracle_sql())


@pytest.fixture(scope="module")
def con():
    return duck(SF_SMALL)


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_oracle(spark, con, name):
    df = E.queries()[name](spark, SF_SMALL)
    cols, rows = df.columns, [tuple(r) for r in df.collect()]
    sql = E.oracle_sql()[name]
    cur = con.execute(sql)
    dcols, drows = [d[0] for d in cur.description], cur.fetchall()
    assert sorted(cols) == sorted(dcols)
    assert len(rows) == len(drows)
    assert digest(cols, rows)[0] == digest(dcols, drows)[0]


def test_entry_runs(spark):
    df = E.entry(spark)
    assert df.count() > 0
    assert "total_on_hand_kg" in df.columns
