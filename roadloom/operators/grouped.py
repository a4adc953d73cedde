"""Groups of rows for numpy kernels: many whole groups in one Arrow batch, not one frame a group.

Rows are dealt by their keys to a fixed number of partitions, which adaptive execution leaves as they
are, and sorted inside them. A group that goes on over several batches is held until it ends.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: From the rows of whole groups, and where each group begins, to rows of the result, in one batch or several.
Kernel = Callable[[pa.RecordBatch, np.ndarray], pa.RecordBatch | Iterable[pa.RecordBatch]]


def changes(batch: pa.RecordBatch, keys: int) -> np.ndarray:
    """Rows, but the first, whose key differs from the row before."""
    new = np.zeros(max(batch.num_rows - 1, 0), bool)
    for k in range(keys):
        code = pc.dictionary_encode(batch.column(k), null_encoding="encode").indices.to_numpy()
        new |= code[1:] != code[:-1]
    return np.flatnonzero(new) + 1


def spans(starts: np.ndarray, rows: int) -> list[tuple[int, int]]:
    """First and last row, the latter not included, of each group."""
    return list(zip(starts.tolist(), [*starts[1:].tolist(), rows], strict=True))


def _joined(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
    if len(parts) == 1:
        return parts[0]
    return pa.RecordBatch.from_arrays([pa.concat_arrays([p.column(i) for p in parts]) for i in range(parts[0].num_columns)], names=parts[0].schema.names)


def map_groups(df: DataFrame, keys: list[str], order: list[str], columns: list[str], schema: str, kernel: Kernel) -> DataFrame:
    """The kernel's rows for all groups of df. It gets keys and columns, sorted by order within a group."""
    n = max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    names = list(dict.fromkeys([*keys, *columns]))
    inside = list(dict.fromkeys([*names, *order]))
    dealt = df.select(*(F.col(f"`{c}`") for c in inside)).repartition(n, *keys).sortWithinPartitions(*keys, *order).select(*names)

    def batches_of(out):
        return [out] if isinstance(out, pa.RecordBatch) else out

    def run(batches):
        held: list[pa.RecordBatch] = []  # of the group that may go on, and whole ones before it
        begins: list[np.ndarray] = []
        rows, last = 0, None

        for b in batches:
            if not b.num_rows:
                continue
            key = [b.column(k)[0].as_py() for k in range(len(keys))]
            starts = changes(b, len(keys))
            if key != last:
                starts = np.append(0, starts)
            last = [b.column(k)[b.num_rows - 1].as_py() for k in range(len(keys))]
            if len(starts) and (rows or starts[-1]):
                cut = int(starts[-1])
                begins.append(rows + starts[:-1])
                yield from batches_of(kernel(_joined([*held, b.slice(0, cut)] if cut else held), np.concatenate(begins)))
                held, begins, rows = [b.slice(cut)], [np.zeros(1, np.int64)], b.num_rows - cut
            else:
                held.append(b)
                begins.append(rows + starts)
                rows += b.num_rows
        if held:
            yield from batches_of(kernel(_joined(held), np.concatenate(begins)))

    return dealt.mapInArrow(run, schema)
