"""Add columns that numpy computes from texts, an Arrow batch at a time."""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ._words import SLICE, batches

#: Bytes of the batches that go to Python, whatever the length of texts (the default bounds their rows only).
BATCH = "spark.sql.execution.arrow.maxBytesPerBatch", 2 << 20


def bounded(table: DataFrame) -> DataFrame:
    """The same table, whose session sends Python batches of bounded size unless it says otherwise."""
    conf, (key, most) = table.sparkSession.conf, BATCH
    if conf.get(key, None) is None:
        conf.set(key, str(most))
    return table


#: From a batch to the new columns, in the order of their schema.
Step = Callable[[pa.RecordBatch], list]


def add(docs: DataFrame, text: str, new: T.StructType, start: Callable[[], Step], keep: list[str] | None = None, most: int = SLICE, reads: list[str] | None = None) -> DataFrame:
    """``docs`` with the columns of ``new``. ``start`` runs once a task and returns the step
    for each slice of about ``most`` bytes of text. Of ``keep`` (all columns unless given),
    columns that ``new`` names are replaced. ``reads`` are further columns that the step looks at."""
    kept = list(dict.fromkeys(c for c in (docs.columns if keep is None else keep) if c not in new.names))
    taken = list(dict.fromkeys([*kept, text, *(reads or [])]))
    schema = T.StructType([*(docs.schema[c] for c in kept), *new])
    types = to_arrow_schema(new).types

    def run(parts):
        step = start()
        for part in parts:
            for piece in batches(part, text, most):
                made = [x if isinstance(x, pa.Array) else pa.array(x, t) for x, t in zip(step(piece), types)]
                yield pa.RecordBatch.from_arrays([*(piece.column(c) for c in kept), *made], names=[*kept, *new.names])

    return bounded(docs).select(*(docs[f"`{c}`"] for c in taken)).mapInArrow(run, schema)
