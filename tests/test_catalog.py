import os

import pytest

from chartloom.plans import catalog, columns, more, retrieval, structure  # noqa: F401
from tests.compare import same, tables

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no driver tables")


@pytest.fixture(scope="module")
def con():
    return tables(DATA)


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, con, name):
    df = catalog.QUERIES[name](spark, DATA)
    if name in catalog.SQL:
        same(df, con, catalog.SQL[name])
    else:
        assert df.count() > 0
