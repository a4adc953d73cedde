"""SimHash near-duplicates through a Gray-order hierarchical index.

Fingerprints that occur more than once are first reduced to one. Two fingerprints within ``bound``
differing bits agree in some of the pigeonhole masks, so the upper nodes of the index are shared
masked bit patterns (mask, value). Below a mask, fingerprints are sorted by the Gray rank of their
other bits over the whole cluster (a range partitioning, so a frequent pattern spreads over many
tasks) and consecutive ones form nodes, and inside them twigs, that keep the bits all members share.
Nodes of one upper node are joined with each other. On the way down the differences add up: a pair of
nodes counts the differing bits among those that both share, a pair of their twigs adds what differs in
the bits that only the twigs share, and members add the rest. A pair is pruned with all below it as
soon as its sum exceeds the bound. Tasks return spanning links, not all pairs.

Defined results: null, empty and white-space texts have fingerprint zero, linked like any other;
a text of fewer than four words is one shingle; repeated rows share their fingerprint; a null doc_id
takes part but is never a component's smallest id unless all are null.
"""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from roadloom.llm.common import BROADCAST_ROWS, cut, map_texts, named, numbered, text_key
from roadloom.llm.components import connected_components
from roadloom.llm.textbytes import LOWER, NOT_SPACE, find_words, released, row_sums

BOUND = 4
SHINGLE = 4
SEED = 42
#: Members of a node and of a twig in it.
LEAF, TWIG = 128, 16
#: Expected fingerprints under an upper node; more blocks are used where there would be more.
GROUP = 4096
_LANES = np.ascontiguousarray(np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1)).view(np.uint64)[:, 0]


def fingerprints_of(data: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Signed 64-bit fingerprints of a block of texts."""
    keep = NOT_SPACE[data]
    edge = np.zeros(len(data), bool)
    edge[off[:-1][off[:-1] < len(data)]] = True
    after = np.zeros(len(data), bool)
    after[1:] = keep[:-1]
    after[edge] = False
    keep |= after  # one white-space byte after each word stays, as a blank
    text = LOWER[data[keep]]
    text[~NOT_SPACE[text]] = 32
    off = np.concatenate([[0], np.cumsum(keep)])[off]
    w = find_words(text, off, NOT_SPACE)
    first = w.first
    count = np.diff(first)
    head = np.arange(len(w.start))
    tail = head + SHINGLE - 1
    stop = first[1:][w.row]
    short = count[w.row] < SHINGLE
    ok = (tail < stop) | (short & (head == first[:-1][w.row]))
    tail = np.minimum(tail, stop - 1)
    s, e = w.start[ok], w.end[tail[ok]]
    raw, hash_of = text.tobytes(), xxhash.xxh64_digest
    digest = np.frombuffer(b"".join([hash_of(raw[a:b], SEED) for a, b in zip(s.tolist(), e.tolist(), strict=True)]), np.uint8).reshape(-1, 8)
    row = w.row[ok]
    begin = np.searchsorted(row, np.arange(len(off)))
    # bits are counted in byte lanes over at most 255 shingles, then added up
    pieces = np.unique(np.concatenate([begin[:-1], *(np.arange(a, b, 255) for a, b in zip(begin[:-1], begin[1:], strict=True) if b - a > 255)]))
    pieces = pieces[pieces < len(row)]
    if not len(pieces):
        return np.zeros(len(off) - 1, np.int64)
    lanes = np.add.reduceat(_LANES[digest], pieces, axis=0)
    counts = row_sums(lanes.view(np.uint8).reshape(len(pieces), 64).astype(np.int64), np.searchsorted(pieces, begin))
    bits = counts * 2 > np.diff(begin)[:, None]
    return np.packbits(bits, axis=1).view(">u8")[:, 0].astype(np.uint64).view(np.int64)


def fingerprints(docs: DataFrame, keep: list[str]) -> DataFrame:
    return map_texts(docs, keep, "fp bigint", lambda: lambda data, off: [fingerprints_of(data, off)])


def masks(blocks: int, bound: int = BOUND) -> list[int]:
    """Bit masks of which two fingerprints within ``bound`` agree in one at least: blocks taken blocks - bound at a time."""
    edges = [round(64 * i / blocks) for i in range(blocks + 1)]
    parts = [((1 << (edges[i + 1] - edges[i])) - 1) << (64 - edges[i + 1]) for i in range(blocks)]
    return [sum(c) for c in itertools.combinations(parts, blocks - bound)]


def blocks_for(n: int, bound: int = BOUND) -> int:
    """The fewest blocks whose masks leave about GROUP fingerprints in a group; every choice is exact."""
    for blocks in range(bound + 1, bound + 5):
        if n / 2 ** (64 * (blocks - bound) / blocks) <= GROUP:
            break
    return blocks


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def gray_rank(x: Column) -> Column:
    """Position of a bit pattern in Gray order (exclusive or of all higher bits)."""
    for by in (1, 2, 4, 8, 16, 32):
        x = x.bitwiseXOR(F.shiftrightunsigned(x, by))
    return x


def index_nodes(fps: DataFrame, blocks: int, bound: int = BOUND) -> DataFrame:
    """Leaf nodes (mask, value, first, same, pattern, members) of distinct fingerprints ``fp``."""
    per = [F.struct(F.lit(i).alias("mask"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("value"), gray_rank(F.col("fp").bitwiseAND(F.lit(_signed(~m & (2**64 - 1))))).alias("rank")) for i, m in enumerate(masks(blocks, bound))]
    each = fps.select("fp", F.explode(F.array(*per)).alias("x")).select("x.mask", "x.value", "x.rank", "fp")
    parts = max(1, int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    ordered = each.repartitionByRange(parts, "mask", "value", "rank").sortWithinPartitions("mask", "value", "rank")

    def cut_runs(batches):
        left = None  # rows of an unfinished node
        for b in itertools.chain(batches, [None]):
            if b is None:
                if left is None:
                    return
                mask, value, fp = left
                done = len(fp)
            else:
                now = [b.column(0).to_numpy(), b.column(1).to_numpy(), b.column(3).to_numpy().view(np.uint64)]
                mask, value, fp = now if left is None else [np.concatenate(x) for x in zip(left, now, strict=True)]
                done = None
            if not len(fp):
                continue
            new = np.ones(len(fp), bool)
            new[1:] = (mask[1:] != mask[:-1]) | (value[1:] != value[:-1])
            run = np.flatnonzero(new)
            place = np.arange(len(fp)) - run[np.cumsum(new) - 1]
            at = np.flatnonzero(place % LEAF == 0)
            if done is None:  # the last node may go on in the next batch
                left, cut_at = [x[at[-1] :].copy() for x in (mask, value, fp)], int(at[-1])
                mask, value, fp, at = mask[:cut_at], value[:cut_at], fp[:cut_at], at[:-1]
                if not len(at):
                    continue
            ones, any_ = np.bitwise_and.reduceat(fp, at), np.bitwise_or.reduceat(fp, at)
            ends = np.append(at[1:], len(fp))
            members = pa.array([fp[a:b].tobytes() for a, b in zip(at.tolist(), ends.tolist(), strict=True)], pa.binary())
            yield pa.RecordBatch.from_arrays(
                [pa.array(mask[at].astype(np.int32)), pa.array(value[at]), pa.array(fp[at].view(np.int64)), pa.array((ones | ~any_).view(np.int64)), pa.array(ones.view(np.int64)), members],
                names=["mask", "value", "first", "same", "pattern", "members"],
            )

    return ordered.mapInArrow(released(cut_runs), "mask int, value bigint, first bigint, same bigint, pattern bigint, members binary")


def spanning(link: np.ndarray) -> np.ndarray:
    """Labels (least index) of the components of a bipartite match matrix; rows come before columns."""
    na, nb = link.shape
    big = na + nb
    a, b = np.arange(na), np.arange(na, big)
    while True:
        b2 = np.minimum(b, np.where(link, a[:, None], big).min(axis=0))
        a2 = np.minimum(a, np.where(link, b2[None], big).min(axis=1))
        if (a2 == a).all() and (b2 == b).all():
            return np.concatenate([a, b])
        a, b = a2, b2


def shared_bits(members: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of the runs of members that begin at ``at``: which bits all of a run share, and their values."""
    ones, some = np.bitwise_and.reduceat(members, at), np.bitwise_or.reduceat(members, at)
    return ones | ~some, ones


def descend(a: np.ndarray, b: np.ndarray, bound: int) -> np.ndarray:
    """Which members of two nodes differ in at most ``bound`` bits, found by adding up differences from node to member."""
    top = np.zeros(1, np.int64)
    (same_a, bits_a), (same_b, bits_b) = shared_bits(a, top), shared_bits(b, top)
    known = same_a & same_b
    apart = np.bitwise_count((bits_a ^ bits_b) & known).astype(np.int16)[0]
    out = np.zeros((-(-len(a) // TWIG), TWIG, -(-len(b) // TWIG), TWIG), bool)
    if apart <= bound:
        (sa, va), (sb, vb) = (shared_bits(x, np.arange(0, len(x), TWIG)) for x in (a, b))
        more = sa[:, None] & sb[None] & ~known
        added = apart + np.bitwise_count((va[:, None] ^ vb[None]) & more)
        i, j = np.nonzero(added <= bound)
        rest = ~(known | more[i, j])
        x, y = (np.resize(v, n * TWIG).reshape(n, TWIG) for v, n in ((a, out.shape[0]), (b, out.shape[2])))
        for lo in range(0, len(i), 64):  # bounds the memory of a step
            part = slice(lo, lo + 64)
            apart_of = added[i[part], j[part], None, None] + np.bitwise_count((x[i[part], :, None] ^ y[j[part], None]) & rest[part, None, None])
            out[i[part], :, j[part]] = apart_of <= bound
    return out.reshape(out.shape[0] * TWIG, -1)[: len(a), : len(b)]


class Forest:
    """Union-find over what one task has seen; says which links join two trees."""

    def __init__(self):
        self.up: dict[int, int] = {}

    def root(self, x: int) -> int:
        up = self.up
        r = x
        while (p := up.get(r, r)) != r:
            r = p
        while (p := up.get(x, x)) != r:
            up[x] = r
            x = p
        return r

    def join(self, x: int, y: int) -> bool:
        a, b = self.root(x), self.root(y)
        if a == b:
            return False
        self.up[max(a, b)] = min(a, b)
        return True


def near_links(fps: DataFrame, bound: int = BOUND, blocks: int | None = None) -> DataFrame:
    """Spanning links (a, b) of the distinct fingerprints ``fp`` that differ in ``bound`` bits at most."""
    blocks = blocks or blocks_for(fps.count(), bound)
    nodes = cut(index_nodes(fps, blocks, bound))
    one, two = (nodes.select(*(F.col(c).alias(f"{c}_{k}") for c in nodes.columns)) for k in "ab")
    apart = F.bit_count(F.col("pattern_a").bitwiseXOR(F.col("pattern_b")).bitwiseAND(F.col("same_a")).bitwiseAND(F.col("same_b")))
    pairs = one.join(two, (F.col("mask_a") == F.col("mask_b")) & (F.col("value_a") == F.col("value_b")) & (F.col("first_a") <= F.col("first_b")) & (apart <= bound))
    pairs = pairs.select("members_a", "members_b").where((F.length("members_a") > 8) | (F.col("members_a") != F.col("members_b")))

    def compare(batches):
        seen = Forest()
        for b in batches:
            out = []
            for x, y in zip(b.column(0), b.column(1), strict=True):
                p, q = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                link = descend(p, q, bound)
                if len(p) == len(q) and p[0] == q[0]:
                    np.fill_diagonal(link, False)
                if not link.any():
                    continue
                ids = np.concatenate([p, q]).view(np.int64)
                label = spanning(link)
                for i in np.flatnonzero(label != np.arange(len(label))).tolist():
                    u, v = int(ids[i]), int(ids[label[i]])
                    if u != v and seen.join(u, v):
                        out.append((u, v))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array([u for u, _ in out], pa.int64()), pa.array([v for _, v in out], pa.int64())], names=["a", "b"])

    return pairs.mapInArrow(released(compare), "a bigint, b bigint")


def _grouped(marked: DataFrame, name: str, least: Column, bound: int) -> DataFrame:
    """marked with the column ``name``: the least value of ``least`` among the rows reachable over links."""
    kinds = cut(marked.groupBy("fp").agg(least.alias("least")))
    roots = connected_components(near_links(kinds.select("fp"), bound))
    of = kinds.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    of = cut(of)
    best = cut(of.groupBy("root").agg(F.min("least").alias(name)))
    classes = cut(of.join(best, "root").select("fp", name))
    return marked.join(classes, "fp")


def near_duplicates(docs: DataFrame, bound: int = BOUND) -> DataFrame:
    """(doc_id, fp, component_id): the smallest doc_id reachable over links, per row of docs."""
    marked = cut(fingerprints(docs, ["doc_id"]))
    return _grouped(marked, "component_id", F.min("doc_id"), bound).select("doc_id", "fp", "component_id")


def keep_one(docs: DataFrame, bound: int = BOUND) -> DataFrame:
    """docs with one row of each near-duplicate group: the one with the smallest doc_id, then text key.

    A row is known by its id and 128 bits of SHA-256 over its text, as ids may be null or repeated;
    null ids come last. Only keys are grouped. Texts move in two cases: rows that are repeated as they
    are (to keep one of each), and all rows once if more than BROADCAST_ROWS keys go.
    """
    plain, names = numbered(docs)
    plain = plain.withColumn("__key", text_key())
    marked = cut(fingerprints(plain, ["doc_id", "__key"]))
    row = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), F.col("__key").alias("key"))
    groups = cut(_grouped(marked, "__least", F.min(row), bound).groupBy(F.col("doc_id").alias("__id"), F.col("__key").alias("__own")).agg(F.first((F.col("doc_id").eqNullSafe(F.col("__least.id"))) & (F.col("__key") == F.col("__least.key"))).alias("__stays"), F.count("*").alias("__n")))
    gone, repeated = groups.where("not __stays").select("__id", "__own"), groups.where("__stays and __n > 1").select("__id", "__own")
    most = groups.agg(F.count_if(~F.col("__stays")), F.count_if(F.col("__stays") & (F.col("__n") > 1))).first()
    gone, repeated = (F.broadcast(x) if n <= BROADCAST_ROWS else x for x, n in zip((gone, repeated), most, strict=True))
    same = F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("__key") == F.col("__own"))
    kept = plain.join(gone, same, "left_anti")
    once = kept.join(repeated, same, "left_semi").dropDuplicates(["doc_id", "__key"])
    return named(kept.join(repeated, same, "left_anti").unionByName(once), names, docs)


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return near_duplicates(docs).select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
