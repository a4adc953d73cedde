"""The trie of conversation prefixes: which conversations begin with the same turns, and what sharing them saves.

A conversation is a sequence of turns (role, text). A polynomial fingerprint of each prefix comes from
numpy scans over the turns in conversation order; equal depth and fingerprint make a candidate node. A
turn is known by a 64-bit hash, which the polynomial uses, and by SHA-256 over role and text, so no text
is shuffled. The smallest conversation of a candidate represents it: the members' turns are compared
with its turn by the SHA-256 at each depth, and where one differs, the member goes on in a node of its
own, marked by the turns in which it left its representatives.

Sums over subtrees need no walk. Each node is owned by its smallest conversation, whose nodes form a
chain; a subtree holds all nodes owned by its members but those that its own owner has above it. So
a subtree's sum is a sum over members, less a running sum along the owner's chain, whatever the depth.

Conversations of any length and nodes with any number of members are spread over tasks: positions and
fingerprints by scans over ranges, counts by partial aggregates, joins by key with the skew split of
adaptive execution. Only the digest over a node's ending conversations is sequential by its
definition; it streams over pieces of bounded size.

Defined results: a null conv_id belongs to no conversation and is left out; a null role or text is
empty; turns are in the order of their number, null first, and those with one number in the order of
xxhash64(role, text); repeated rows are turns of their own; an empty table has no node.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from roadloom.llm.common import cut, small_batches, table
from roadloom.llm.importance import CRC_SQL, crc_sql
from roadloom.llm.ordering import prefix_scan
from roadloom.llm.textbytes import released

#: Odd multiplier of the polynomial, modulo 2 ** 64.
BASE = 0x9E3779B97F4A7C15
#: Of the contract: family size, and one more than the most turns taken from the family's head.
FAMILY, HEADS = 5, 9
_NODE = ["depth", "fp", "path"]


def turns_of(conversations: DataFrame) -> DataFrame:
    """(conv_id, nth, v, digest, size): the turns by position, their hash, SHA-256 and UTF-8 bytes."""
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in ("role", "text"))
    known = conversations.where(F.col("conv_id").isNotNull()).select(F.col("conv_id").cast("long").alias("conv_id"), "turn", role.alias("role"), text.alias("text"))
    whole = F.concat(F.octet_length("role").cast("string"), F.lit(":"), "role", "text")
    turns = known.select("conv_id", "turn", F.xxhash64("role", "text").alias("v"), F.unhex(F.sha2(whole, 256)).alias("digest"), F.octet_length("text").cast("long").alias("size"))
    return prefix_scan(turns, "conv_id", [F.col("conv_id"), F.col("turn").asc_nulls_first(), F.col("v")], []).drop("turn")


def sequences(turns: DataFrame) -> DataFrame:
    """The conversations as they are, as ``trie`` takes them; each has a root row of depth 0."""
    n = cut(turns.groupBy("conv_id").agg(F.count("*").alias("length")))
    each = turns.join(n, "conv_id").select("conv_id", (F.col("nth") + 1).alias("depth"), "v", "digest", "size", (F.col("nth") + 1 == F.col("length")).alias("last"))
    return each.unionByName(_roots(n))


def _roots(lengths: DataFrame) -> DataFrame:
    zero = F.lit(0).cast("long")
    return lengths.select("conv_id", zero.alias("depth"), zero.alias("v"), F.lit(b"").alias("digest"), zero.alias("size"), (F.col("length") == 0).alias("last"))


def rebuilt(turns: DataFrame, family: int = FAMILY, heads: int = HEADS) -> DataFrame:
    """Conversations that begin with turns of their family's head: sequences of
    the first h turns of conversation c - c % family and then c's own turns after its first h, where
    h = crc32(c) % heads. The head is looked up in a bounded part of each family's turns."""
    convs = turns.groupBy("conv_id").agg(F.count("*").alias("n")).withColumn("h", F.crc32(F.col("conv_id").cast("string")) % heads).withColumn("head", F.col("conv_id") - F.col("conv_id") % family)
    convs = cut(convs)
    sizes = convs.where(F.col("conv_id") % family == 0).select(F.col("conv_id").alias("head"), F.col("n").alias("head_n"))
    convs = convs.join(sizes, "head", "left").withColumn("k", F.least("h", F.coalesce("head_n", F.lit(0))))
    convs = cut(convs.select("conv_id", "head", "h", "k", (F.col("k") + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("length")))
    first = turns.where((F.col("conv_id") % family == 0) & (F.col("nth") < heads - 1)).withColumnRenamed("conv_id", "head")
    taken = convs.select("conv_id", "head", "k", "length").join(first, "head").where("nth < k").select("conv_id", (F.col("nth") + 1).alias("depth"), "v", "digest", "size", "length")
    own = turns.join(convs.select("conv_id", "h", "k", "length"), "conv_id").where("nth >= h")
    own = own.select("conv_id", (F.col("nth") - F.col("h") + F.col("k") + 1).alias("depth"), "v", "digest", "size", "length")
    each = taken.unionByName(own).withColumn("last", F.col("depth") == F.col("length")).drop("length")
    return each.unionByName(_roots(convs))


def fingerprinted(seqs: DataFrame, bits: int = 64) -> DataFrame:
    """Adds fp and parent_fp, the fingerprints of the prefix to a turn and to the one before."""
    scanned = prefix_scan(cut(seqs), "conv_id", [F.col("conv_id"), F.col("depth")], ["v"], BASE, "__nth")
    low = F.lit(-1 if bits == 64 else (1 << bits) - 1).cast("long")
    out = scanned.withColumn("fp", F.col("v_upto").bitwiseAND(low)).withColumn("parent_fp", F.col("v_before").bitwiseAND(low))
    return cut(out.drop("__nth", "v", "v_upto", "v_before"))


def verified(marked: DataFrame) -> DataFrame:
    """Adds path and parent_path: empty where all turns equal those of the representatives, else what tells them apart.

    A turn that differs from its representative's moves the prefix, and all that follow it in the
    conversation, to a node of its own.
    """
    groups = marked.groupBy("depth", "fp").agg(F.min("digest").alias("one"), F.max("digest").alias("two"), F.min_by("digest", "conv_id").alias("told"))
    mixed = cut(groups.where("one <> two").select("depth", "fp", "told"))
    plain = marked.withColumn("path", F.lit("")).withColumn("parent_path", F.lit(""))
    if mixed.isEmpty():
        return plain
    away = cut(marked.join(mixed, ["depth", "fp"]).where("digest <> told").select("conv_id", F.col("depth").alias("at"), "digest"))
    steps = lambda c: F.sort_array(F.collect_list(F.when(c, F.struct("at", "digest"))))
    name = lambda c: F.when(F.size(c) > 0, F.sha2(F.to_json(c), 256)).otherwise(F.lit(""))
    moved = marked.select("conv_id", "depth").join(away, "conv_id").where("at <= depth").groupBy("conv_id", "depth").agg(steps(F.col("at") <= F.col("depth")).alias("p"), steps(F.col("at") < F.col("depth")).alias("q"))
    moved = moved.select("conv_id", "depth", name(F.col("p")).alias("path"), name(F.col("q")).alias("parent_path"))
    known = F.coalesce
    return cut(marked.join(moved, ["conv_id", "depth"], "left").withColumn("path", known("path", F.lit(""))).withColumn("parent_path", known("parent_path", F.lit(""))))


def ends_digests(members: DataFrame) -> DataFrame:
    """(depth, fp, path, ends_sha256) of the nodes at which conversations end.

    Ids are sorted over ranges and joined into pieces; a node's pieces are hashed one after the other.
    """
    ends = members.where("last").select(*_NODE, "conv_id")
    parts = max(1, int(ends.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    order = [*_NODE, "conv_id"]
    schema = "depth bigint, fp bigint, path string, first bigint, ids string"

    def pieces(batches):
        for b in batches:
            if not b.num_rows:
                continue
            depth, fp, conv = (b.column(i).to_numpy() for i in (0, 1, 3))
            path = b.column(2).to_numpy(zero_copy_only=False)
            start = np.flatnonzero(np.append(True, (depth[1:] != depth[:-1]) | (fp[1:] != fp[:-1]) | (path[1:] != path[:-1])))
            ids, stop = list(map(str, conv.tolist())), np.append(start[1:], len(conv))
            joined = [",".join(ids[a:z]) for a, z in zip(start.tolist(), stop.tolist(), strict=True)]
            at = pa.array(start)
            yield pa.RecordBatch.from_arrays([b.column(0).take(at), b.column(1).take(at), b.column(2).take(at), b.column(3).take(at), pa.array(joined, pa.string())], names=[x.split()[0] for x in schema.split(", ")])

    cut_up = ends.repartitionByRange(parts, *order).sortWithinPartitions(*order).mapInArrow(released(pieces), schema)
    dealt = cut_up.repartition(parts, *_NODE).sortWithinPartitions(*_NODE, "first")

    def digests(batches):
        key, h = None, None
        done: list[tuple] = []
        for b in batches:
            for *node, ids in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), b.column(4).to_pylist(), strict=True):
                if node != key:
                    if key is not None:
                        done.append((*key, h.hexdigest()))
                    key, h = node, hashlib.sha256(ids.encode())
                else:
                    h.update(b"," + ids.encode())
            if len(done) > 5000:
                yield _rows(done)
                done = []
        if key is not None:
            yield _rows([*done, (*key, h.hexdigest())])

    return dealt.mapInArrow(released(digests), "depth bigint, fp bigint, path string, ends_sha256 string")


def _rows(done: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*done, strict=True), kinds, strict=True)], names=[*_NODE, "ends_sha256"])


def trie(seqs: DataFrame, bits: int = 64) -> DataFrame:
    """One row per node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, n_ends, ends_sha256.

    seqs: (conv_id, depth, v, digest, size, last), a row for each prefix and a root row of depth 0 per conversation.
    """
    small_batches(seqs.sparkSession)
    members = verified(fingerprinted(seqs, bits))
    nodes = members.groupBy(*_NODE).agg(
        F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"), F.count_if("last").alias("n_ends"),
        F.max("size").alias("size"), F.min("parent_fp").alias("parent_fp"), F.min("parent_path").alias("parent_path"),
    )
    leaf = (F.col("n_ends") == F.col("n_convs")).cast("long")
    nodes = cut(nodes.withColumn("saved", (F.col("n_convs") - 1) * F.col("size")).withColumn("leaf", leaf).drop("size"))
    # what is owned by each member, less what the owner has above the node
    owned = nodes.groupBy("conv_id").agg(F.sum("saved").alias("all_saved"), F.sum("leaf").alias("all_leaves"))
    below = members.select("conv_id", *_NODE).join(owned, "conv_id").groupBy(*_NODE).agg(F.sum("all_saved").alias("all_saved"), F.sum("all_leaves").alias("all_leaves"))
    chains = prefix_scan(nodes, "conv_id", [F.col("conv_id"), F.col("depth")], ["saved", "leaf"], 1, "__nth")
    up = {"depth": F.col("depth") - 1, "fp": F.col("parent_fp"), "path": F.col("parent_path")}
    children = nodes.where("depth > 0").groupBy(*(x.alias(c) for c, x in up.items())).agg(F.count("*").alias("n_children"))
    parents = nodes.select(F.col("depth").alias("__d"), F.col("fp").alias("__f"), F.col("path").alias("__p"), F.col("conv_id").alias("parent_conv_id"))
    above = (F.col("depth") - 1 == F.col("__d")) & (F.col("parent_fp") == F.col("__f")) & (F.col("parent_path") == F.col("__p"))
    out = chains.join(below, _NODE).join(children, _NODE, "left").join(ends_digests(members), _NODE, "left").join(parents, above, "left")
    return out.select(
        "conv_id", "depth", "parent_conv_id", "n_convs", F.coalesce("n_children", F.lit(0)).cast("long").alias("n_children"),
        (F.col("all_leaves") - F.col("leaf_before")).alias("n_leaves"), (F.col("all_saved") - F.col("saved_before")).alias("saved_tokens"),
        "n_ends", F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"),
    )


def node_texts(nodes: DataFrame, conversations: DataFrame) -> DataFrame:
    """nodes of plain conversations (``trie(sequences(turns_of(...)))``) with role and text of their last turn; null at the root.

    Texts are looked up once, at their owners; turns are numbered as in ``turns_of``.
    """
    role, text = (F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("role", "text"))
    turns = conversations.where(F.col("conv_id").isNotNull()).select(F.col("conv_id").cast("long").alias("conv_id"), "turn", role, text).withColumn("v", F.xxhash64("role", "text"))
    order = [F.col("conv_id"), F.col("turn").asc_nulls_first(), F.col("v")]
    at = prefix_scan(turns, "conv_id", order, []).select("conv_id", (F.col("nth") + 1).alias("depth"), "role", "text")
    return nodes.join(at, ["conv_id", "depth"], "left")


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    talks = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    out = trie(rebuilt(turns_of(talks)))
    return out.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


ORACLE_SQL = f"""
WITH {CRC_SQL},
turns AS (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST) - 1 AS nth, {{'r': coalesce(role, ''), 't': coalesce(text, '')}} AS x
  FROM conversations WHERE conv_id IS NOT NULL),
own AS (SELECT conv_id, list(x ORDER BY nth) AS xs FROM turns GROUP BY conv_id),
kept AS (SELECT conv_id, xs, ({crc_sql('conv_id::VARCHAR')} % 9)::BIGINT AS h FROM own, crc_table),
rebuilt AS (
  SELECT k.conv_id, list_concat(coalesce(b.xs[:k.h], []), k.xs[k.h + 1:]) AS xs
  FROM kept k LEFT JOIN own b ON b.conv_id = k.conv_id - k.conv_id % 5),
prefixes AS (SELECT conv_id, d AS depth, len(xs) AS n, sha256(xs[:d]::VARCHAR || d) AS p, sha256(xs[:d - 1]::VARCHAR || (d - 1)) AS q, xs[d].t AS last_text FROM rebuilt, unnest(range(0, len(xs) + 1)) AS r(d)),
nodes AS (
  SELECT depth, p, any_value(q) AS q, min(conv_id) AS conv_id, count(*) AS n_convs, coalesce(any_value(strlen(last_text)), 0) * (count(*) - 1) * (depth > 0)::INT AS saved,
    string_agg(CASE WHEN n = depth THEN conv_id::VARCHAR END, ',' ORDER BY conv_id) AS ends
  FROM prefixes GROUP BY depth, p),
kids AS (SELECT depth - 1 AS depth, q AS p, count(*) AS n_children FROM nodes WHERE depth > 0 GROUP BY 1, 2),
full_nodes AS (SELECT n.*, coalesce(n_children, 0) AS n_children FROM nodes n LEFT JOIN kids k ON k.depth = n.depth AND k.p = n.p),
above AS (
  SELECT DISTINCT a.depth, a.p, b.depth AS under_depth, b.p AS under FROM prefixes a JOIN prefixes b ON b.conv_id = a.conv_id AND b.depth >= a.depth),
subtrees AS (
  SELECT a.depth, a.p, sum((f.n_children = 0)::INT) AS n_leaves, sum(f.saved) AS saved_tokens
  FROM above a JOIN full_nodes f ON f.depth = a.under_depth AND f.p = a.under GROUP BY 1, 2)
SELECT f.conv_id, f.depth, u.conv_id AS parent_conv_id, f.n_convs, f.n_children::BIGINT AS n_children, s.n_leaves::BIGINT AS n_leaves, s.saved_tokens::BIGINT AS saved_tokens,
  sha256(coalesce(f.ends, '')) AS ends_sha256
FROM full_nodes f JOIN subtrees s ON s.depth = f.depth AND s.p = f.p LEFT JOIN full_nodes u ON f.depth > 0 AND u.depth = f.depth - 1 AND u.p = f.q
"""
