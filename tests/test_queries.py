"""Every registered query of the document operators runs; those with SQL give DuckDB's rows."""

import pytest

from docloom.plans import registry

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, same, name):
    df = registry.QUERIES[name](spark, FOLDER)
    if name in registry.ORACLES:
        same(df, registry.ORACLES[name], FOLDER)
    else:
        assert df.count() > 0


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == 200
    assert set(registry.ORACLES) <= set(__spark_entry__.queries())
