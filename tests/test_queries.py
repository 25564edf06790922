"""Each query of the registry against its SQL."""

import pytest

from taxeval.plans.registry import registered

FOUND = registered()


@pytest.mark.parametrize("name", sorted(FOUND))
def test_query(name, same_rows):
    query, sql = FOUND[name]
    assert sql, "every query of the registry has SQL"
    same_rows(query, sql)


def test_entry(spark):
    import __spark_entry__ as e

    assert set(FOUND) <= set(e.queries())
    assert e.entry(spark).count() == 4
