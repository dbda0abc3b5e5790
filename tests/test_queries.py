"""Every registered query of the library's own against SQL on the smallest tables."""

import pytest
from compare import compare

from tallyspark import oracle, queries

SF = "/root/testdata/sf0.001"


def test_every_sql_has_its_query():
    assert set(oracle.SQL) <= set(queries.QUERIES)


@pytest.mark.parametrize("name", sorted(oracle.SQL))
def test_same_rows_as_sql(spark, name):
    assert compare(spark, SF, queries.QUERIES[name], oracle.SQL[name]) in ("", "no rows")


def test_stream_rules_agree_with_batch(spark):
    rows = {r.category: r.rate for r in queries.stream_parity(spark, SF).collect()}
    assert rows["ALL"] == 1.0
