"""Documents packed into as few sequences as can be: a configuration program over the length histogram.

Documents become token ids with an end id. One that is longer than a sequence is cut, the rest before
its full pieces; shorter ones stay whole. What is then decided is how often to use each configuration, a
multiset of lengths that fit together in a sequence, and that depends on the histogram of lengths alone,
which has at most one entry per token of a sequence, however many documents there are.

The covering program (least number of configurations that hold all pieces) is solved by multiplicative
weights: a length's price falls exponentially with the share of its pieces that is covered, and the
dearest configurations at these prices are found by the knapsack's dynamic program. Rounding takes the
whole parts, then once more each configuration whose pieces are still there, and places what remains by
best fit, longest first, in the open sequences and new ones; that too works on counts by length.

Pieces are dealt to their places by position in the order of their length, over ranges; no task sees all
pieces of a length. The table of places has a few entries for each configuration.

Defined results: null and empty texts are one piece, the end id; repeated rows are packed each; a null
doc_id comes last among its length; other columns may have any name; an empty table has no piece.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from roadloom.llm.common import cut, small_batches, table
from roadloom.llm.ordering import placed
from roadloom.llm.textbytes import released
from roadloom.llm.token_files import _encode_batches, default_tokenizer

CAPACITY, END_ID = 1024, 2
#: How sharply a covered length loses its price; the share of a length's pieces that a round covers; how far below the
#: dearest configuration one may be to be used; the share of the tokens that is left to rounding; the most rounds.
ETA, STEP, SLACK, REST, ROUNDS = 0.5, 0.05, 0.3, 0.1, 200


def pieces(docs: DataFrame, capacity: int = CAPACITY, end_id: int = END_ID, path: str | None = None, ids: bool = False) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32) of each piece, and its ids as 32-bit numbers if asked for."""
    kind = dict(docs.dtypes)["doc_id"]
    step = _encode_batches(path or default_tokenizer(), end_id)
    schema = f"doc_id {kind}, piece int, start bigint, length bigint, ids_crc32 bigint" + ", ids binary" * ids

    def run(batches):
        for doc_id, flat, first in step(batches):
            n = np.diff(first)
            count = -(-n // capacity)
            row = np.repeat(np.arange(len(n)), count)
            piece = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
            head = n - (count - 1) * capacity
            start = np.where(piece == 0, 0, head[row] + (piece - 1) * capacity)
            length = np.where(piece == 0, head[row], capacity)
            raw = memoryview(np.ascontiguousarray(flat, "<u4")).cast("B")
            at = first[row] + start
            parts = [raw[4 * a : 4 * z] for a, z in zip(at.tolist(), (at + length).tolist(), strict=True)]
            cols = [doc_id.take(pa.array(row)), pa.array(piece.astype(np.int32)), pa.array(start), pa.array(length), pa.array([zlib.crc32(p) for p in parts], pa.int64())]
            if ids:
                cols.append(pa.array([bytes(p) for p in parts], pa.binary()))
            yield pa.RecordBatch.from_arrays(cols, names=[x.split()[0] for x in schema.split(", ")])

    small_batches(docs.sparkSession)
    return docs.select("doc_id", "text").mapInArrow(released(run), schema)


def knapsack(lengths: np.ndarray, prices: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """By room: the most that lengths put there are worth, and the one to put there first (-1: leave a token free). lengths ascend."""
    best, choice = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    fitting = np.searchsorted(lengths, np.arange(capacity + 1), "right")
    for room in range(1, capacity + 1):
        best[room] = best[room - 1]
        if k := fitting[room]:
            worth = best[room - lengths[:k]] + prices[:k]
            j = int(worth.argmax())
            if worth[j] > best[room] + 1e-15:
                best[room], choice[room] = worth[j], j
    return best, choice


def solve(lengths: np.ndarray, counts: np.ndarray, capacity: int) -> dict[tuple[int, ...], float]:
    """Configurations (places in ``lengths``) and how often to use each, in fractions, by multiplicative weights.

    A round prices lengths by what is left of them. One dynamic program over the lengths up to half a
    sequence completes every longer length, so that it prices a configuration for each; those worth
    nearly the most are used until a length has given STEP of its pieces in this round. No length is covered more than once.
    """
    left, total, found = counts.astype(float), float(lengths @ counts), {}
    for _ in range(ROUNDS):
        if left @ lengths < REST * total:
            break
        prices = np.where(left > 1e-9, lengths / capacity * np.exp(ETA * (left / counts - 1)), 0.0)
        small, big = (np.flatnonzero(x & (left > 1e-9)) for x in (lengths <= capacity // 2, lengths > capacity // 2))
        best, choice = knapsack(lengths[small], prices[small], capacity)
        leads = [(float(best[capacity]), capacity, [])]
        leads += [(float(best[capacity - lengths[i]] + prices[i]), capacity - int(lengths[i]), [i]) for i in big.tolist()]
        least = (1 - SLACK) * max(worth for worth, _, _ in leads)
        open_now, moved = np.minimum(left, STEP * counts), False
        for worth, room, config in sorted(leads, key=lambda x: -x[0]):
            if worth < least:
                break
            while room > 0:
                if (j := int(choice[room])) < 0:
                    room -= 1
                else:
                    config.append(int(small[j]))
                    room -= int(lengths[small[j]])
            used, taken = np.unique(np.array(config, np.int64), return_counts=True)
            often = float((open_now[used] / taken).min()) if len(used) else 0.0
            if often > 1e-9:
                open_now[used] -= often * taken
                left[used] -= often * taken
                key = tuple(sorted(config))
                found[key] = found.get(key, 0.0) + often
                moved = True
        if not moved:
            break
    return found


def rounded(lengths: np.ndarray, counts: np.ndarray, capacity: int, fractions: dict[tuple[int, ...], float]) -> list[tuple[tuple[int, ...], int]]:
    """Whole configurations that together hold each piece once."""
    left, plan = counts.copy(), []
    parts = [(config, *np.unique(np.array(config, np.int64), return_counts=True), int(often + 1e-9), often) for config, often in fractions.items()]
    for _, used, taken, n, _ in parts:
        left[used] -= n * taken
    for config, used, taken, n, often in sorted(parts, key=lambda p: (p[3] - p[4], p[0])):
        if often - n > 1e-9 and (left[used] >= taken).all():
            left[used] -= taken
            n += 1
        if n:
            plan.append((config, n))
    # best fit on counts, longest first: (room, configuration) of open sequences and how many there are
    rooms: dict[int, list[tuple[tuple[int, ...], int]]] = {}
    for config, n in plan:
        rooms.setdefault(capacity - int(lengths[list(config)].sum()), []).append((config, n))
    for i in range(len(lengths) - 1, -1, -1):
        size = int(lengths[i])
        while left[i]:
            fits = min((r for r, have in rooms.items() if r >= size and have), default=None)
            if fits is None:
                fits, config, n = capacity, (), -(-int(left[i]) // (capacity // size))
            else:
                config, n = rooms[fits].pop()
            each = fits // size  # the sequence just used has the least room, so it goes on
            full = min(n, int(left[i]) // each)
            some = int(left[i]) - full * each if full < n else 0
            left[i] -= full * each + some
            for often, more in ((full, each), (1 if some else 0, some), (n - full - (1 if some else 0), 0)):
                if often:
                    rooms.setdefault(fits - more * size, []).append((config + (i,) * more, often))
    return [x for room in sorted(rooms) for x in rooms[room]]


def plan_sequences(lengths: np.ndarray, counts: np.ndarray, capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """(configuration, how often) for pieces of ascending ``lengths``; configurations are places in ``lengths``."""
    return rounded(lengths, counts, capacity, solve(lengths, counts, capacity)) if len(lengths) else []


def slots(lengths: np.ndarray, counts: np.ndarray, plan: list[tuple[tuple[int, ...], int]]) -> np.ndarray:
    """Columns (up to, per sequence, first sequence, first offset, length): which places the pieces take, in the order of their length."""
    rows, sequence = [], 0
    for config, n in plan:
        used, taken = np.unique(np.array(config, np.int64), return_counts=True)
        offset = 0
        for i, k in zip(used.tolist(), taken.tolist(), strict=True):
            rows.append((i, n * k, k, sequence, offset, int(lengths[i])))
            offset += k * int(lengths[i])
        sequence += n
    out = np.array(rows, np.int64).reshape(-1, 6)
    out = out[np.argsort(out[:, 0], kind="stable")]
    out[:, 1] = np.cumsum(out[:, 1])
    return out[:, 1:]


def packed(parts: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """parts (doc_id, piece, length, ...) with sequence_id and offset."""
    spark = parts.sparkSession
    parts = cut(parts.withColumn("__row", F.monotonically_increasing_id()))
    hist = sorted((r[0], r[1]) for r in parts.groupBy("length").count().collect())  # at most ``capacity`` rows
    lengths, counts = (np.array([h[k] for h in hist], np.int64) for k in (0, 1))
    table_ = slots(lengths, counts, plan_sequences(lengths, counts, capacity))
    shared = spark.sparkContext.broadcast(table_)
    ordered = placed(parts, [F.col("length"), F.col("doc_id").asc_nulls_last(), F.col("piece"), F.col("__row")], "__place").drop("__row")
    kinds, names = dict(ordered.dtypes), [c for c in ordered.columns if c != "__place"]
    schema = ", ".join([*(f"`{c}` {kinds[c]}" for c in names), "sequence_id bigint", "offset bigint"])

    def run(batches):
        upto, each, first, offset, size = shared.value.T
        for b in batches:
            place = b.column(len(names)).to_numpy()
            e = np.searchsorted(upto, place, "right")
            nth = place - np.append(0, upto)[e]
            made = [first[e] + nth // each[e], offset[e] + nth % each[e] * size[e]]
            yield pa.RecordBatch.from_arrays([*b.columns[: len(names)], *map(pa.array, made)], names=[*names, "sequence_id", "offset"])

    return ordered.select(*names, "__place").mapInArrow(run, schema)


def pack(docs: DataFrame, capacity: int = CAPACITY, end_id: int = END_ID, path: str | None = None, ids: bool = False) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset) of each piece of docs, with ids if asked for."""
    return packed(pieces(docs, capacity, end_id, path, ids), capacity)


def sequences(parts: DataFrame) -> DataFrame:
    """(sequence_id, length, ids) of ``pack(..., ids=True)``: the ids of each sequence, little-endian 32-bit numbers; a group is one sequence."""
    own = parts.groupBy("sequence_id").agg(F.sum("length").alias("length"), F.sort_array(F.collect_list(F.struct("offset", "ids"))).alias("parts"))
    return own.select("sequence_id", "length", F.aggregate("parts", F.lit(b""), lambda a, p: F.concat(a, p["ids"])).alias("ids"))


def least_sequences(lengths: np.ndarray, counts: np.ndarray, capacity: int) -> int:
    """No packing takes fewer: all tokens, or pieces over half a sequence and what can't stand beside them."""
    best = -(-int(lengths @ counts) // capacity)
    for k in [0, *lengths[lengths <= capacity // 2].tolist()]:
        big, mid = lengths > capacity - k, (lengths > capacity // 2) & (lengths <= capacity - k)
        low = (lengths <= capacity // 2) & (lengths >= k)
        free = counts[mid].sum() * capacity - lengths[mid] @ counts[mid]
        best = max(best, int(counts[big].sum() + counts[mid].sum() + max(0, -(-int(lengths[low] @ counts[low] - free) // capacity))))
    return best


def op13_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents").select("doc_id", "text"))
