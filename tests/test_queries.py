import pytest

from coverspark.plans import registry


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_query_equals_its_sql(name, same_rows):
    same_rows(registry.QUERIES[name], registry.ORACLES[name])


def test_entry_points(spark, sf_dir):
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert set(registry.QUERIES) <= set(entry.queries())
    assert entry.queries()["transition_counts"](spark, sf_dir).count() > 0
