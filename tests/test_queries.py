"""Every core query with SQL, over whole (small) tables."""

import pytest
from compare import same

from factloom.plans import epistemic, history, language, maintenance, pipeline, problems, retrieval, streams

SETS = [problems, retrieval, history, epistemic, maintenance, pipeline, language, streams]
NAMED = [(m, k) for m in SETS for k in m.QUERIES]


@pytest.mark.parametrize("module,name", NAMED, ids=[k for _, k in NAMED])
def test_query(spark, data, module, name):
    df = module.QUERIES[name](spark, data)
    if name in module.SQL:
        same(df, module.SQL[name], data)
    else:
        assert df.columns and df.limit(1).collect()


def test_every_sql_has_a_query():
    for m in SETS:
        assert set(m.SQL) <= set(m.QUERIES)
