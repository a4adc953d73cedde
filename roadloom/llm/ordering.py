"""Positions and running sums in a global order, without one task that sees all rows.

Rows are dealt by ranges of their order and sorted inside them. What lies before a range is one small
row a partition, and only those go to the driver. The frames given must be repeatable (read from
files or checkpointed), as dealing by ranges reads them twice.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from roadloom.llm.common import cut
from roadloom.llm.textbytes import released

_WRAP = 1 << 64


def _ranges(df: DataFrame) -> int:
    return max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def placed(df: DataFrame, order: list[Column], name: str = "place") -> DataFrame:
    """df with each row's position (0, 1, ...) in the order. Rows that tie stand in any order."""
    spark = df.sparkSession
    at = F.monotonically_increasing_id()  # the partition in the upper bits, the row in the 33 lower ones
    ordered = cut(df.repartitionByRange(_ranges(df), *order).sortWithinPartitions(*order).withColumn("__at", at))
    part = F.shiftrightunsigned("__at", 33)
    counts = sorted((r[0], r[1]) for r in ordered.groupBy(part).count().collect())
    before, base = 0, []
    for p, n in counts:
        base.append((p, before))
        before += n
    small = spark.createDataFrame(base or [(0, 0)], "__part bigint, __before bigint")  # a row a partition
    row = F.col("__at").bitwiseAND(F.lit((1 << 33) - 1))
    return ordered.withColumn("__part", part).join(F.broadcast(small), "__part").withColumn(name, F.col("__before") + row).drop("__at", "__part", "__before")


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base % _WRAP, np.uint64)
    out[:1] = 1
    return np.cumprod(out, dtype=np.uint64)


def prefix_scan(df: DataFrame, key: str, order: list[Column], values: list[str], base: int = 1, nth: str = "nth") -> DataFrame:
    """Adds nth, a row's position within its key, and for each value v the sums v_before and v_upto.

    v_upto of the row at position i is the sum of v * base ** position over the positions 0 to i, modulo
    2 ** 64; v_before leaves the row itself out. With base 1 they are plain running sums. key: a bigint
    column without nulls, by which the order begins. A key of any size is spread over partitions: each is
    scanned alone, and what the partitions before it hold of its first key is added as
    ``carried + base ** rows_before * local``.
    """
    spark = df.sparkSession
    columns = [c for c in df.columns]
    k, vs = columns.index(key), [columns.index(v) for v in values]
    kinds = dict(df.dtypes)
    made = [x for v in values for x in (f"{v}_before", f"{v}_upto")]
    schema = ", ".join([*(f"`{c}` {kinds[c]}" for c in columns), f"{nth} bigint", *(f"`{x}` bigint" for x in made), "__part int"])

    def local(batches):
        part = TaskContext.get().partitionId()
        last, rows, sums = None, 0, [0] * len(vs)
        for b in batches:
            if not b.num_rows:
                continue
            keys = b.column(k).to_numpy()
            start = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
            run = np.repeat(np.arange(len(start)), np.diff(np.append(start, len(keys))))
            at = np.arange(len(keys)) - start[run]
            power = _powers(base, int(at.max()) + 1)[at]
            open_run = run == 0 if last == keys[0] else np.zeros(len(keys), bool)
            lift = np.uint64(pow(base, rows, _WRAP))
            out = []
            for j, v in enumerate(vs):
                x = b.column(v).to_numpy().view(np.uint64) * power
                total = np.cumsum(x, dtype=np.uint64)
                upto = total - (total - x)[start][run]
                both = [upto - x, upto]
                for y in both:
                    y[open_run] = np.uint64(sums[j]) + lift * y[open_run]
                out += both
            at = at + np.where(open_run, rows, 0)
            last, rows, sums = keys[-1], int(at[-1]) + 1, [int(y[-1]) for y in out[1::2]]
            cols = [*b.columns, pa.array(at), *(pa.array(y.view(np.int64)) for y in out), pa.array(np.full(len(keys), part, np.int32))]
            yield pa.RecordBatch.from_arrays(cols, names=[*columns, nth, *made, "__part"])

    scanned = cut(df.repartitionByRange(_ranges(df), *order).sortWithinPartitions(*order).mapInArrow(released(local), schema))
    ends = scanned.groupBy("__part").agg(F.min(key).alias("first"), F.max(key).alias("last"), F.max_by(F.struct(nth, *(f"`{x}`" for x in made[1::2])), F.struct(key, nth)).alias("end"))
    carried, open_key, rows, sums = {}, None, 0, [0] * len(vs)
    for r in sorted(ends.collect(), key=lambda r: r["__part"]):  # a row a partition
        n, *upto = r["end"]
        here = r["first"] == open_key
        if here:
            carried[r["__part"]] = (open_key, rows, list(sums))
        if here and r["last"] == open_key:
            lift = pow(base, rows, _WRAP)
            rows, sums = rows + n + 1, [(s + lift * u) % _WRAP for s, u in zip(sums, upto, strict=True)]
        else:
            open_key, rows, sums = r["last"], n + 1, [u % _WRAP for u in upto]
    if not carried:
        return scanned.drop("__part")
    shared = spark.sparkContext.broadcast(carried)
    first = len(columns)

    def carry(batches):
        for b in batches:
            cols = b.columns
            known = shared.value.get(cols[-1][0].as_py()) if b.num_rows else None
            if known is not None:
                open_key, rows, sums = known
                here = cols[k].to_numpy() == open_key
                at = cols[first].to_numpy() + np.where(here, rows, 0)
                lift = np.uint64(pow(base, rows, _WRAP))
                cols[first] = pa.array(at)
                for j in range(2 * len(vs)):
                    y = cols[first + 1 + j].to_numpy().view(np.uint64).copy()
                    y[here] = np.uint64(sums[j // 2]) + lift * y[here]
                    cols[first + 1 + j] = pa.array(y.view(np.int64))
            yield pa.RecordBatch.from_arrays(cols, names=b.schema.names)

    # a checkpointed frame keeps its partitions; a batch holds rows of one of them
    return scanned.mapInArrow(carry, schema).drop("__part")
