"""Every registered query against its SQL."""

import pytest

from atelier.plans import files, more, registry  # noqa: F401

from .compare import database, rows_of_spark, rows_of_sql


@pytest.fixture(scope="module")
def db(folder):
    return database(folder)


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_query_equals_its_sql(spark, folder, db, name):
    names, rows = rows_of_spark(registry.QUERIES[name](spark, folder))
    want_names, want = rows_of_sql(db, registry.ORACLES[name])
    assert names == want_names
    assert [tuple(map(str, r)) for r in rows] == [tuple(map(str, r)) for r in want]


@pytest.mark.parametrize("name", ["pack_containment", "pack_findings"])
def test_all_packs_are_compared(spark, folder, name):
    folder = folder.replace("sf0.001", "sf0.01")
    names, rows = rows_of_spark(registry.QUERIES[name](spark, folder))
    ends = [names.index(n) for n in (("a", "b") if name == "pack_containment" else ("candidate", "container"))]
    assert any(all(r[i] % 1_000_000 >= 40 for i in ends) for r in rows)
    assert rows == rows_of_sql(database(folder), registry.ORACLES[name])[1]


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
