import pytest

import __spark_entry__ as entry
from sparkgrams.plans.oracles import ORACLES
from sparkgrams.plans.queries import QUERIES


def test_every_core_query_has_an_oracle():
    assert set(QUERIES) == set(ORACLES)
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_flagship(spark, sf_dir):
    rows = [(r.text, round(r.similarity, 6)) for r in entry.entry(spark).collect()]
    assert rows == [
        ("red widget", 0.816327), ("red bolt", 0.555556), ("old widget", 0.50173), ("cold widget", 0.478395), ("red rod", 0.462222),
        ("red gear", 0.4375), ("red ring", 0.4375), ("red anvil", 0.415225), ("red gizmo", 0.415225), ("red plate", 0.415225),
    ]


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_against_sql(spark, sf_dir, duck, same_rows, name):
    same_rows(QUERIES[name](spark, sf_dir).toPandas(), duck.execute(ORACLES[name]).df())
