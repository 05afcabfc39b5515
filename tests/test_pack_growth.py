"""Packs that share a few contents by chance: what queries on packs shuffle grows with what packs hold, not with the pairs that meet."""

import os
import random

import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from atelier.plans import more, registry  # noqa: F401  more registers as well

from .compare import database, rows_of_spark, rows_of_sql
from .test_duplicates import rows_shuffled


@pytest.fixture(scope="module")
def many_packs(folder, tmp_path_factory):
    """The small tables with a line item table of 1,200 packs of 100 of 3,000 contents: any two share some three."""
    at, rng = tmp_path_factory.mktemp("packs"), random.Random(3)
    for name in os.listdir(folder):
        if name != "lineitem.parquet":
            os.symlink(f"{folder}/{name}", at / name)
    held = [(p, c) for p in range(1200) for c in rng.sample(range(3000), 100)]
    pq.write_table(pa.table({"l_suppkey": [p for p, _ in held], "l_partkey": [c for _, c in held]}), at / "lineitem.parquet")
    return str(at)


@pytest.mark.parametrize("name", ["pack_containment", "dup_report"])
def test_pairs_that_meet_by_chance_are_not_shuffled(spark, many_packs, name):
    before = rows_shuffled(spark)
    found = rows_of_spark(registry.QUERIES[name](spark, many_packs))
    held = 120_000 * (1 + 3 / 4 + 1 / 3)
    assert rows_shuffled(spark) - before < 5 * held
    assert found == rows_of_sql(database(many_packs), registry.ORACLES[name])
