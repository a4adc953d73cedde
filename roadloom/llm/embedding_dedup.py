"""Embedding near-duplicates: sign hashes of random hyperplanes in several tables, exact cosine, components.

Equal vectors are reduced to one class with a count first, so a group of copies costs one vector.
The number of classes sets the bits of a bucket (so that about BUCKET classes share one) and the
number of tables (so that a pair at the cosine bound meets in one with probability RECALL).

Each class goes to one bucket in each table as (table, bucket, class, sketch), where the sketch is 256
further sign bits; no vector travels yet. The classes of a bucket are cut into blocks along a range
partitioning (a very full bucket spreads over many tasks), blocks of one bucket are joined, and classes
are marked that have a partner with a sketch near enough: the bound lies four deviations
beyond what the cosine bound makes likely. Only marked classes get their vectors, in the buckets they
are marked in, and meet there again in blocks. A pair is verified by its cosine in double precision and
counted in the first table where it meets, so per-vector link counts need no list of pairs; tasks
return counts and spanning links only.

Defined results: vectors that are null, empty or zero, or hold nulls or non-finite numbers, link
with nothing and keep their own id as component; copies link with each other; vectors of different
lengths never link; repeated ids each give a row; columns but vec_id and embedding are not read.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from roadloom.llm.common import cut, small_batches
from roadloom.llm.components import connected_components
from roadloom.llm.simhash import Forest, spanning
from roadloom.llm.textbytes import released

COSINE = 0.9
#: Classes expected in a bucket, and the probability that a pair at the bound meets in some table.
BUCKET, RECALL = 256, 0.999
#: Bits of the sketch, and deviations of slack that its test leaves a pair at the bound.
SKETCH_BITS, SLACK = 256, 4
BLOCK = 256


def design(n: int, cosine: float = COSINE) -> tuple[int, int]:
    """(tables, bits) for n classes. Two vectors agree in a sign with probability 1 - angle / pi."""
    bits = min(30, max(4, math.ceil(math.log2(max(n, 1) / BUCKET))))
    together = (1 - math.acos(cosine) / math.pi) ** bits
    return math.ceil(math.log(1 - RECALL) / math.log(1 - together)), bits


def sketch_bound(cosine: float = COSINE) -> int:
    """Differing sketch bits that a pair at the bound has at most, but for a chance of about 1e-4."""
    apart = math.acos(cosine) / math.pi
    return int(SKETCH_BITS * apart + SLACK * math.sqrt(SKETCH_BITS * apart * (1 - apart)))


def _rows_of(column: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    off = column.offsets.to_numpy().astype(np.int64)
    flat = column.values.to_numpy(zero_copy_only=False)
    return flat, off


def _planes(dim: int, tables: int, bits: int) -> np.ndarray:
    """Hyperplanes of the tables, and behind them those of the sketch."""
    return np.random.default_rng(1_000_003 * dim + 10).standard_normal((dim, SKETCH_BITS + tables * bits))


def _sides(v: np.ndarray, planes: np.ndarray) -> np.ndarray:
    return (v / np.abs(v).max(axis=1, keepdims=True)) @ planes > 0


def _scaled(v: np.ndarray) -> np.ndarray:
    """Vectors times powers of two that bring their largest component to 0.5 and more: squares neither overflow nor vanish."""
    _, power = np.frexp(np.abs(v).max(axis=1))
    half = -power // 2  # in two steps, as one may be beyond the largest power
    return np.ldexp(np.ldexp(v, half[:, None]), (-power - half)[:, None])


def _signatures(v: np.ndarray, planes: np.ndarray, tables: int, bits: int) -> np.ndarray:
    side = _sides(v, planes[:, SKETCH_BITS:]).reshape(len(v), tables, bits)
    return (side @ (1 << np.arange(bits))).astype(np.int32)


def bucket_rows(classes: DataFrame, tables: int, bits: int) -> DataFrame:
    """One row per class and table: dim, tab, bucket, node, sketch."""
    names = ["dim", "tab", "bucket", "node", "sketch"]

    def run(batches):
        planes = {}
        for b in batches:
            node = b.column(0).to_numpy()
            flat, off = _rows_of(b.column(1))
            size = np.diff(off)
            for dim in np.unique(size).tolist():
                rows = np.flatnonzero(size == dim)
                for part in np.array_split(rows, -(-len(rows) // 2000)):
                    v = np.stack([flat[off[i] : off[i + 1]] for i in part.tolist()]).astype(np.float64)
                    if dim not in planes:
                        planes[dim] = _planes(dim, tables, bits)
                    sig = _signatures(v, planes[dim], tables, bits)
                    packed = np.packbits(_sides(v, planes[dim][:, :SKETCH_BITS]), axis=1)
                    sketch = pa.array([x.tobytes() for x in packed], pa.binary())
                    for t in range(tables):
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(part), dim, np.int32)), pa.array(np.full(len(part), t, np.int32)), pa.array(sig[:, t]), pa.array(node[part]), sketch], names=names)

    return classes.select("node", "embedding").mapInArrow(released(run), "dim int, tab int, bucket int, node bigint, sketch binary")


def bucket_blocks(rows: DataFrame, payload: str) -> DataFrame:
    """Blocks (dim, tab, bucket, first, nodes, payload) of BLOCK members of a bucket at most; payload is joined bytes."""
    parts = max(1, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    ordered = rows.select("dim", "tab", "bucket", "node", payload).repartitionByRange(parts, "dim", "tab", "bucket", "node").sortWithinPartitions("dim", "tab", "bucket", "node")
    names = ["dim", "tab", "bucket", "first", "nodes", "payload"]

    def flush(key, node, held):
        one = [[key[0]], [key[1]], [key[2]], [node[0]], [np.array(node, np.int64).tobytes()], [b"".join(held)]]
        kinds = [pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.binary(), pa.binary()]
        return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(one, kinds, strict=True)], names=names)

    def run(batches):
        key, nodes, held = None, [], []
        for b in batches:
            for dim, tab, bucket, node, data in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if (dim, tab, bucket) != key or len(nodes) >= BLOCK:
                    if nodes:
                        yield flush(key, nodes, held)
                    key, nodes, held = (dim, tab, bucket), [], []
                nodes.append(node)
                held.append(data)
        if nodes:
            yield flush(key, nodes, held)

    return ordered.mapInArrow(released(run), "dim int, tab int, bucket int, first bigint, nodes binary, payload binary")


def block_pairs(blocks: DataFrame) -> DataFrame:
    """Pairs of blocks of one bucket, each once, and each block with itself."""
    one, two = (blocks.select(*(F.col(c).alias(f"{c}_{k}") for c in blocks.columns)) for k in "ab")
    same = (F.col("dim_a") == F.col("dim_b")) & (F.col("tab_a") == F.col("tab_b")) & (F.col("bucket_a") == F.col("bucket_b")) & (F.col("first_a") <= F.col("first_b"))
    return one.join(two, same).select("dim_a", "tab_a", "bucket_a", "nodes_a", "payload_a", "nodes_b", "payload_b")


def marked(blocks: DataFrame, bound: int) -> DataFrame:
    """(dim, tab, bucket, node) of the classes that have another with a near sketch in their bucket."""
    names = ["dim", "tab", "bucket", "node"]

    def run(batches):
        for b in batches:
            for r in range(b.num_rows):
                n1, n2 = (np.frombuffer(b.column(i)[r].as_buffer(), np.int64) for i in (3, 5))
                s1, s2 = (np.frombuffer(b.column(i)[r].as_buffer(), np.uint64).reshape(-1, SKETCH_BITS // 64) for i in (4, 6))
                near = sum(np.bitwise_count(s1[:, None, w] ^ s2[None, :, w]) for w in range(SKETCH_BITS // 64)) <= bound
                if n1[0] == n2[0]:
                    np.fill_diagonal(near, False)
                found = np.unique(np.concatenate([n1[near.any(axis=1)], n2[near.any(axis=0)]]))
                if len(found):
                    key = [pa.array(np.full(len(found), b.column(i)[r].as_py(), np.int32)) for i in range(3)]
                    yield pa.RecordBatch.from_arrays([*key, pa.array(found)], names=names)

    return block_pairs(blocks).mapInArrow(released(run), "dim int, tab int, bucket int, node bigint").distinct()


def verified(blocks: DataFrame, tables: int, bits: int, cosine: float) -> DataFrame:
    """Rows (a, b, n): with b, a spanning link; without, n vectors linked to a. Payload of blocks: copies and vector."""

    def run(batches):
        seen, count, planes = Forest(), {}, {}
        for b in batches:
            links = []
            for r in range(b.num_rows):
                dim, tab = b.column(0)[r].as_py(), b.column(1)[r].as_py()
                n1, n2 = (np.frombuffer(b.column(i)[r].as_buffer(), np.int64) for i in (3, 5))
                both = [np.frombuffer(b.column(i)[r].as_buffer(), np.float64).reshape(-1, dim + 1) for i in (4, 6)]
                (c1, v1), (c2, v2) = ((x[:, 0], _scaled(x[:, 1:])) for x in both)
                cos = (v1 @ v2.T) / (np.sqrt((v1 * v1).sum(axis=1))[:, None] * np.sqrt((v2 * v2).sum(axis=1))[None])
                link = cos >= cosine
                if n1[0] == n2[0]:
                    link = np.triu(link, 1)
                i, j = np.nonzero(link)
                if tab and len(i):
                    if dim not in planes:
                        planes[dim] = _planes(dim, tables, bits)
                    s1, s2 = (_signatures(v, planes[dim], tables, bits)[:, :tab] for v in (v1, v2))
                    first_time = ~(s1[i] == s2[j]).any(axis=1)
                    link[i[~first_time], j[~first_time]] = False
                    i, j = i[first_time], j[first_time]
                if not len(i):
                    continue
                for nodes, w in ((n1, np.bincount(i, c2[j], len(n1))), (n2, np.bincount(j, c1[i], len(n2)))):
                    for at in np.flatnonzero(w).tolist():
                        node = int(nodes[at])
                        count[node] = count.get(node, 0) + int(w[at])
                ids, label = np.concatenate([n1, n2]), spanning(link)
                for at in np.flatnonzero(label != np.arange(len(label))).tolist():
                    u, v = int(ids[at]), int(ids[label[at]])
                    if u != v and seen.join(u, v):
                        links.append((u, v))
            if links:
                yield _links(links)
            if len(count) > 100_000:
                yield _counts(count)
                count = {}
        if count:
            yield _counts(count)

    return block_pairs(blocks).mapInArrow(released(run), "a bigint, b bigint, n bigint")


def with_vectors(rows: DataFrame, classes: DataFrame) -> DataFrame:
    """rows with the bytes of their class's number of copies and vector, all as doubles."""

    def run(batches):
        for b in batches:
            flat, off = _rows_of(b.column(2))
            copies = b.column(1).to_numpy().astype(np.float64)
            held = [copies[i].tobytes() + flat[off[i] : off[i + 1]].astype(np.float64).tobytes() for i in range(b.num_rows)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(held, pa.binary())], names=["node", "held"])

    wanted = classes.join(rows.select("node").distinct(), "node", "left_semi")
    return rows.join(wanted.select("node", "copies", "embedding").mapInArrow(released(run), "node bigint, held binary"), "node")


def _links(links):
    a, b = zip(*links, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array([0] * len(a), pa.int64())], names=["a", "b", "n"])


def _counts(count):
    return pa.RecordBatch.from_arrays([pa.array(list(count), pa.int64()), pa.nulls(len(count), pa.int64()), pa.array(list(count.values()), pa.int64())], names=["a", "b", "n"])


def near_duplicates(vectors: DataFrame, cosine: float = COSINE, tables: int | None = None, bits: int | None = None) -> DataFrame:
    """(vec_id, n_links, component_id) per row of vectors (vec_id, embedding); tables and bits by ``design``."""
    small_batches(vectors.sparkSession)
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    usable = F.coalesce((F.size("embedding") > 0) & finite & F.exists("embedding", lambda x: x != 0), F.lit(False))
    rows = vectors.select("vec_id", "embedding", usable.alias("usable"))
    good = rows.where("usable")
    classes = cut(good.groupBy("embedding").agg(F.min("vec_id").alias("least"), F.count("*").alias("copies")).select(F.monotonically_increasing_id().alias("node"), "least", "copies", "embedding"))
    if tables is None or bits is None:
        tables, bits = design(classes.count(), cosine)
    near = cut(marked(cut(bucket_blocks(bucket_rows(classes, tables, bits), "sketch")), sketch_bound(cosine)))
    found = cut(verified(cut(bucket_blocks(with_vectors(near, classes), "held")), tables, bits, cosine))
    n = cut(found.where("b is null").groupBy(F.col("a").alias("node")).agg(F.sum("n").alias("n")))
    roots = connected_components(found.where("b is not null").select("a", "b"))
    of = classes.select("node", "least", "copies", F.xxhash64("embedding").alias("key"), F.col("embedding").alias("same"))
    of = of.join(n, "node", "left").join(roots, "node", "left")
    of = cut(of.select("key", "same", "least", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("root", "node").alias("root")))
    best = cut(of.groupBy("root").agg(F.min("least").alias("component_id")))
    of = cut(of.join(best, "root").select("key", "same", "n_links", "component_id"))
    joined = good.select("vec_id", "embedding", F.xxhash64("embedding").alias("key")).join(of, "key").where("embedding = same").select("vec_id", "n_links", "component_id")
    return joined.unionByName(rows.where("not usable").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id")))


def op10_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")
    return near_duplicates(vectors).select("vec_id", "n_links", "component_id", F.col("vec_id").eqNullSafe(F.col("component_id")).alias("kept"))


ORACLE_SQL = """
WITH RECURSIVE v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
link AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND list_cosine_similarity(a.e, b.e) >= 0.9),
reach AS (SELECT vec_id AS a, vec_id AS b FROM v UNION SELECT r.a, l.b FROM reach r JOIN link l ON r.b = l.a),
comp AS (SELECT a, min(b) AS component_id FROM reach GROUP BY a),
n AS (SELECT a, count(*) AS n FROM link GROUP BY a)
SELECT vec_id, CAST(coalesce(n, 0) AS BIGINT) AS n_links, component_id, vec_id = component_id AS kept
FROM v JOIN comp ON comp.a = vec_id LEFT JOIN n ON n.a = vec_id
"""
