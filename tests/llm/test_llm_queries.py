"""The llm queries over whole small tables."""

import sys

import pytest

queries = pytest.importorskip("factloom.llm.queries")
sys.path.insert(0, __file__.rsplit("/", 2)[0])
from compare import same  # noqa: E402


@pytest.mark.parametrize("name", list(queries.QUERIES))
def test_query(spark, data, name):
    df = queries.QUERIES[name](spark, data)
    if name in queries.SQL:
        assert same(df, queries.SQL[name], data)
    else:
        rows = df.collect()
        assert len(rows) == len({str(r) for r in rows})
