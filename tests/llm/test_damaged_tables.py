"""Every text query survives damaged and empty tables."""

import os

import pytest

from inkweave.llm import queries
from tests import damaged

pytestmark = pytest.mark.skipif(not os.path.isdir(damaged.SOURCE), reason="no test tables")


@pytest.mark.parametrize("kind", ["damaged", "empty"])
def test_text_queries(spark, tmp_path, kind):
    d = damaged.make(spark, tmp_path, kind)
    for name, query in queries.queries().items():
        n = query(spark, d).count()
        assert (n == 0) == (kind == "empty"), name
        spark.catalog.clearCache()
