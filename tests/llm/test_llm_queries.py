"""The training-data queries that SQL can express against their SQL."""

import os

import pytest
from sqlcheck import SF_DIR, same_rows

from arborql.llm.queries import ORACLE_SQL, QUERIES

pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no tables")


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query(spark, name):
    same_rows(spark, QUERIES[name], ORACLE_SQL[name])
