"""Every registered query with an oracle matches DuckDB on the small driver tables."""

import pytest

from tagstream.plans import catalog  # noqa: F401
from tagstream.plans.compare import compare, duck
from tagstream.plans.registry import ORACLE, QUERIES

from conftest import SMALL

_con = None


def _duck():
    global _con
    if _con is None:
        _con = duck(SMALL)
    return _con


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_matches_oracle(spark, name):
    ok, msg = compare(QUERIES[name](spark, SMALL), _duck(), ORACLE[name])
    assert ok, msg


def test_every_query_has_a_docstring_or_oracle():
    for n, fn in QUERIES.items():
        assert n in ORACLE or fn.__doc__, n


def test_entry_contract(spark):
    import __spark_entry__ as E

    df = E.entry(spark)
    assert df.count() > 0
    assert set(E.oracle_sql()) <= set(E.queries())
