"""Every query over the reference's operators against its SQL."""

import os

import pytest
from sqlcheck import SF_DIR, same_rows

from arborql.plans.catalogue import ORACLE_SQL, QUERIES

pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no tables")


def test_every_query_has_sql():
    assert sorted(QUERIES) == sorted(ORACLE_SQL)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, name):
    same_rows(spark, QUERIES[name], ORACLE_SQL[name])
