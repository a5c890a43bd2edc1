"""Groups of rows streamed through a Python function, many small ones in one task."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def by_group(df: DataFrame, keys: list[str], run: Callable[[tuple, pa.Table], Iterator[pa.RecordBatch]], schema: str, partitions: int | None = None) -> DataFrame:
    """Call ``run(key, rows)`` for each group; the groups of a task are sorted, and only one is held at a time."""
    dealt = df.repartition(partitions, *map(F.col, keys)) if partitions else df.repartition(*map(F.col, keys))
    n = len(keys)
    dealt = dealt.select(*keys, *[c for c in df.columns if c not in keys]).sortWithinPartitions(*keys)

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        key = None
        for batch in batches:
            columns = [batch.column(i).to_pylist() for i in range(n)]
            rows = list(zip(*columns, strict=True))
            start = 0
            for i, k in enumerate(rows):
                if k != key:
                    if key is not None:
                        held.append(batch.slice(start, i - start))
                        yield from run(key, pa.Table.from_batches(held))
                    held, start, key = [], i, k
            held.append(batch.slice(start))
        if key is not None:
            yield from run(key, pa.Table.from_batches(held))

    return dealt.mapInArrow(stream, schema)
