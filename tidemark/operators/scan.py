"""Rules whose next state needs the last one, run as one pass over sorted partitions.

Rows are dealt by their key (best: a key and a run of it that starts from nothing), sorted within the partition and read batch
by batch. Only the key's state is held, so a long run costs time in its task but no memory, and nothing is gathered in a row."""

from __future__ import annotations

from collections.abc import Callable, Iterable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType


def scan(rows: DataFrame, by: list[str], order: list[str], step: Callable, out: str, finish: Callable | None = None) -> DataFrame:
    """What ``step(state, row)`` yields for the rows of each key in order.

    step takes the state (None before a key's first row) and the row as a dict, and returns (new state, rows put out);
    ``finish(state)`` returns the rows put out after the last one. Rows put out are tuples of the columns ``out`` (DDL)."""
    schema = StructType.fromDDL(out)
    fields = to_arrow_schema(schema)

    def run(batches):
        key, state, done = None, None, []

        def flush() -> Iterable[pa.RecordBatch]:
            if done:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*done), fields)], schema=fields)
                done.clear()

        for batch in batches:
            for row in batch.to_pylist():
                now = tuple(row[c] for c in by)
                if now != key:
                    if key is not None and finish:
                        done.extend(finish(state))
                    key, state = now, None
                state, put = step(state, row)
                done.extend(put)
            yield from flush()
        if key is not None and finish:
            done.extend(finish(state))
        yield from flush()

    return rows.repartition(*by).sortWithinPartitions(*by, *order).mapInArrow(run, schema)
