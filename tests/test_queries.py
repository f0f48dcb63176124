"""Every query outside the text package: against its SQL, or that it runs."""

import pytest

from tests.compare import same
from tidewright.plans import lake_queries, pipeline_queries, sql_queries, stream_queries

REGISTRIES = [pipeline_queries.R, stream_queries.R, lake_queries.R, sql_queries.R]
NAMES = [(r, n) for r in REGISTRIES for n in r.queries]


@pytest.mark.parametrize("registry,name", NAMES, ids=[n for _, n in NAMES])
def test_query(spark, data, duck, registry, name):
    df = registry.queries[name](spark, data)
    if name in registry.sql:
        same(df, duck, registry.sql[name])
    else:
        assert df.count() >= 0


def test_entry_has_every_query(spark):
    import __spark_entry__ as e

    for r in REGISTRIES:
        assert set(r.queries) <= set(e.queries())
        assert set(r.sql) <= set(e.oracle_sql())
    assert len(e.entry(spark).columns) == 5
