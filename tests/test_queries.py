"""Every core query gives the rows of its SQL; those without SQL run."""

import pytest

from furrow.plans.catalog import ORACLE, QUERIES
from tests.comparing import DATA, database, rows_of, sql_rows


@pytest.fixture(scope="module")
def con():
    return database()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    cols, rows = rows_of(QUERIES[name](spark, DATA))
    if name in ORACLE:
        assert (cols, rows) == sql_rows(con, ORACLE[name])
    else:
        assert rows
