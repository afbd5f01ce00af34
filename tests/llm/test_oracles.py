"""The operations that SQL can express give what their SQL gives."""

import pytest

from lodeseam.llm.queries import ORACLE_SQL, QUERIES

from .. import oracle

pytestmark = pytest.mark.skipif(not oracle.DATA.exists(), reason="no test tables")


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_its_sql(spark, name):
    oracle.compare(spark, QUERIES[name], ORACLE_SQL[name])
