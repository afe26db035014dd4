"""Every query of the base library against its SQL, over whole tables."""

import __spark_entry__
import pytest
from oracle import expected, same

from profilion.plans import catalog, cores, domain, streams  # noqa: F401


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_query_equals_sql(spark, sf_dir, name):
    same(catalog.QUERIES[name](spark, sf_dir).toPandas(), expected(catalog.ORACLES[name], sf_dir))


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(catalog.QUERIES) <= set(__spark_entry__.queries())
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
