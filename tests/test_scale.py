"""Every panel query on the largest of the small tables: none may overflow or fail there."""

import pytest

from tessera.plans import catalog


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_runs(spark, name):
    catalog.QUERIES[name](spark, "/root/testdata/sf0.1").write.format("noop").mode("overwrite").save()
