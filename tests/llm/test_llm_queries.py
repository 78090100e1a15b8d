import pytest

from furrow.llm.oracle import ORACLE
from furrow.llm.queries import QUERIES
from tests.comparing import DATA, database, rows_of, sql_rows


@pytest.fixture(scope="module")
def con():
    return database()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    cols, rows = rows_of(QUERIES[name](spark, DATA))
    if name in ORACLE:
        assert (cols, rows) == sql_rows(con, ORACLE[name])
    elif not name.endswith("_found"):
        assert rows
