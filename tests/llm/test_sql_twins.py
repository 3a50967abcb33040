import pytest

from rungwise.llm import registry


@pytest.mark.parametrize("name", sorted(set(registry.oracle_sql()) - {"op9_exact_dedup"}))
def test_sql_twin(spark, sf, duck, same, name):
    same(registry.queries()[name](spark, sf).toPandas(), duck.execute(registry.oracle_sql()[name]).df())


def test_all_ten_are_registered():
    assert sorted(int(n[2:].split("_")[0]) for n in registry.queries()) == list(range(1, 11))
