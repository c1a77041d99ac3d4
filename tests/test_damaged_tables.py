"""Every core query survives damaged and empty tables."""

import os

import pytest

from inkweave.plans import registry
from tests import damaged

pytestmark = pytest.mark.skipif(not os.path.isdir(damaged.SOURCE), reason="no test tables")


@pytest.mark.parametrize("kind", ["damaged", "empty"])
def test_core_queries(spark, tmp_path, kind):
    d = damaged.make(spark, tmp_path, kind)
    for name, query in registry.queries().items():
        n = query(spark, d).count()
        assert kind == "damaged" or n == 0, name
        spark.catalog.clearCache()
