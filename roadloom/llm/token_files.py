"""Token ids in files of separately compressed documents that share one dictionary.

Format, a folder of two Parquet tables written and read by Spark:
  dictionary  one row: the zstandard dictionary, its SHA-256, id width in bytes
  packs       rows of about PACK bytes, documents in ascending doc_id order: shard, pack number, the
              first and last doc_id, the frames of its documents joined together, and as the offset
              index arrays of doc_ids, frame offsets (n + 1), id counts and starts in the shard; every
              row names the dictionary hash that its frames need
A short document is read by the pack that holds its doc_id (min/max statistics prune the others) and
one slice of the payload; no other document is decompressed.

The tokenizer works on whole texts. Pieces between single blanks are looked up in a table that keeps
the ids of pieces seen before; a blank between two characters that aren't white space always begins
a new pre-token, so the ids are those of the whole text. Other texts, and those that hold the string
of an added token, are encoded as they are.

Defined results: null and empty texts have the end id only; a null doc_id sorts first; repeated ids
keep one entry each, side by side; strings of special tokens in a text become those tokens, as the
tokenizers library has it by default; columns but doc_id and text are not read.
"""

from __future__ import annotations

import hashlib
import itertools
import os
import re

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from roadloom.llm.common import discard, scratch, small_batches, unit_hash
from roadloom.llm.textbytes import blocks, find_words, hash_words, released, text_buffer

END_ID = 0
PACK = 1 << 20
#: Bytes of frames in a shard, the number of shards from which on they grow, and how large they get.
SHARD, MANY, LARGE_SHARD = 32 << 20, 10_000, 1 << 30
DICTIONARY_BYTES = 64 << 10
#: Documents whose ids the dictionary is trained on, and the longest of them in characters.
FIT_ROWS, FIT_CHARS = 1500, 8000
#: Pieces in a generation of the table of ids that a worker keeps.
MEMO = 350_000
LEVEL = 3
#: Bytes of text that are encoded at a time.
BLOCK = 2 << 20
_ODD = re.compile(r"\s[ ]|[ ]\s")
_NOT_BLANK = np.ones(256, bool)
_NOT_BLANK[32] = False
_WHITE = np.zeros(256, bool)
_WHITE[[9, 10, 11, 12, 13, 28, 29, 30, 31, 32]] = True
#: First two bytes of the white-space characters beyond ASCII.
_WIDE_WHITE = np.array([0xC285, 0xC2A0, 0xE19A, 0xE280, 0xE281, 0xE380], np.uint16)
_workers: dict[str, PieceEncoder] = {}


def odd_rows(data: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Rows in which a blank stands beside other white space or at the end, so that it doesn't just begin a piece."""
    n = len(off) - 1
    odd = np.zeros(n, bool)
    if not len(data):
        return odd
    full = np.flatnonzero(off[1:] > off[:-1])
    odd[full] = data[off[1:][full] - 1] == 32
    white, blank = _WHITE[data], data == 32
    at = np.flatnonzero((white[:-1] & blank[1:]) | (blank[:-1] & white[1:]))
    odd[np.searchsorted(off, at, "right") - 1] = True
    pair = (data[:-1].astype(np.uint16) << 8) | data[1:]
    rows = np.unique(np.searchsorted(off, np.flatnonzero((data[:-1] >= 0xC2) & np.isin(pair, _WIDE_WHITE)), "right") - 1)
    for r in rows[~odd[rows]].tolist():
        odd[r] = _ODD.search(data[off[r] : off[r + 1]].tobytes().decode()) is not None
    return odd


class IdTable:
    """Ids of pieces by two 64-bit hashes: sorted arrays in two generations of bounded size.

    When the young generation is full it becomes the old one, and the one before that goes.
    """

    def __init__(self, size: int):
        self.size = size
        self.young, self.old = self._empty(), self._empty()

    @staticmethod
    def _empty() -> tuple:
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint32)

    def find(self, h: np.ndarray, check: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For each pair of hashes (h ascending): begin and number of its ids, -1 where unknown; and the ids."""
        begin, count = np.full(len(h), -1, np.int64), np.zeros(len(h), np.int64)
        shift = 0
        for keys, checks, at, n, ids in (self.young, self.old):
            if len(keys):
                pos = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
                hit = (keys[pos] == h) & (checks[pos] == check) & (begin < 0)
                begin[hit], count[hit] = at[pos[hit]] + shift, n[pos[hit]]
            shift += len(ids)
        return begin, count, np.concatenate([self.young[4], self.old[4]])

    def add(self, h: np.ndarray, check: np.ndarray, count: np.ndarray, ids: np.ndarray) -> None:
        """New pairs of hashes (h ascending) with their ids one after the other."""
        if len(self.young[0]) > self.size:
            self.old, self.young = self.young, self._empty()
        keys, checks, at, n, have = self.young
        begin = len(have) + np.cumsum(count) - count
        order = np.argsort(np.concatenate([keys, h]), kind="stable")
        joined = [np.concatenate(x)[order] for x in ((keys, h), (checks, check), (at, begin), (n, count))]
        self.young = (*joined, np.concatenate([have, ids]))


class PieceEncoder:
    """Ids of texts as little-endian 32-bit numbers.

    With a byte-level tokenizer without a normalizer, the new pieces of a block are encoded as short
    texts of some pieces with blanks between them; as a piece holds no blank, the ids that begin with
    one tell the pieces apart. Any other tokenizer encodes whole texts.
    """

    def __init__(self, path: str):
        # a task has one core; the library's threads would each keep caches that outlive the tokenizer
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer, pre_tokenizers

        self.tok = Tokenizer.from_file(path)
        self.added = [t.content.encode() for t in self.tok.get_added_tokens_decoder().values()]
        self.parts = self.tok.normalizer is None and isinstance(self.tok.pre_tokenizer, pre_tokenizers.ByteLevel) and not self.tok.pre_tokenizer.add_prefix_space and not any(b" " in a for a in self.added)
        self.forget()
        self.opens = np.zeros(self.tok.get_vocab_size(), bool)
        if self.parts:
            blank = self.tok.pre_tokenizer.pre_tokenize_str(" ")[0][0]
            self.opens[[i for t, i in self.tok.get_vocab().items() if t.startswith(blank)]] = True

    def forget(self) -> None:
        """Drops the table of pieces. The tokenizer stays: the library keeps memory of each one that is dropped."""
        self.table = IdTable(MEMO)

    def _ids(self, text: str) -> np.ndarray:
        return np.array(self.tok.encode(text, add_special_tokens=False).ids, np.uint32)

    def _learn(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of pieces, each with the blank before it, one after the other; and how many each has."""
        all_ids, counts = [], []
        for lo in range(0, len(pieces), 64 * 256):
            part = pieces[lo : lo + 64 * 256]
            # short texts of some pieces each: the tokenizer is slower on long ones
            texts = [" " + b" ".join(part[k : k + 64]).decode() for k in range(0, len(part), 64)]
            ids = np.array(list(itertools.chain.from_iterable(e.ids for e in self.tok.encode_batch_fast(texts, add_special_tokens=False))), np.uint32)
            at = np.flatnonzero(self.opens[ids])
            if len(at) == len(part) and not any(_ODD.search(t) for t in texts):
                count = np.diff(np.append(at, len(ids)))
            else:  # pieces that begin or end with white space, or a tokenizer that parts texts in another way
                each = [self._ids(" " + p.decode()) for p in part]
                ids, count = np.concatenate(each), np.array([len(x) for x in each])
            all_ids.append(ids)
            counts.append(count)
        return np.concatenate(all_ids), np.concatenate(counts)

    def encode_block(self, data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of a block of texts one after the other, and where each text's ids begin (n + 1 values).

        Each different piece of the block is looked up once, by two 64-bit hashes of its bytes.
        """
        n = len(off) - 1
        if not self.parts or not len(data):
            each = [self._ids(data[a:b].tobytes().decode()) for a, b in zip(off[:-1].tolist(), off[1:].tolist(), strict=True)]
            return np.concatenate([np.zeros(0, np.uint32), *each]), np.cumsum([0, *(len(x) for x in each)])
        w = find_words(data, off, _NOT_BLANK)
        h, check = hash_words(data, w.start, w.end), hash_words(data, w.start, w.end, 1)
        kind, rep, inv = np.unique(h, return_index=True, return_inverse=True)
        odd = odd_rows(data, off)
        odd[w.row[check != check[rep][inv]]] = True  # two pieces with one hash: their texts are encoded whole
        begin, count, flat = self.table.find(kind, check[rep])
        new = np.flatnonzero(begin < 0)
        raw = data.tobytes()
        for added in self.added:
            at = raw.find(added)
            while at >= 0:
                odd[np.searchsorted(off, at, "right") - 1] = True
                at = raw.find(added, at + 1)
        if len(new):
            at = rep[new]
            ids, sizes = self._learn([raw[a:b] for a, b in zip(w.start[at].tolist(), w.end[at].tolist(), strict=True)])
            begin[new], count[new] = len(flat) + np.cumsum(sizes) - sizes, sizes
            flat = np.concatenate([flat, ids])
            self.table.add(kind[new], check[at], sizes, ids)
        lead = np.flatnonzero(w.start == off[w.row])  # a text's first word, with no blank before it
        heads = [self._ids(raw[a:b].decode()) for a, b in zip(w.start[lead].tolist(), w.end[lead].tolist(), strict=True)]
        sizes = np.array([len(x) for x in heads], np.int64)
        inv[lead] = len(begin) + np.arange(len(lead))
        begin, count = np.concatenate([begin, len(flat) + np.cumsum(sizes) - sizes]), np.concatenate([count, sizes])
        flat = np.concatenate([flat, *heads])
        each = np.where(odd[w.row], 0, count[inv])
        total = np.concatenate([[0], np.cumsum(each)])
        out = flat[np.repeat(begin[inv] - total[:-1], each) + np.arange(total[-1])]
        first = total[w.first]
        if odd.any():
            pieces = [self._ids(raw[off[r] : off[r + 1]].decode()) if odd[r] else out[first[r] : first[r + 1]] for r in range(n)]
            out, first = np.concatenate(pieces), np.cumsum([0, *(len(x) for x in pieces)])
        return out, first

    def encode(self, texts: list[str]) -> list[bytes]:
        data, off = text_buffer(pa.array(texts, pa.string()))
        ids, first = self.encode_block(data, off)
        return [ids[a:b].astype("<u4").tobytes() for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True)]


def _worker(path: str) -> PieceEncoder:
    if path not in _workers:
        _workers[path] = PieceEncoder(path)
    return _workers[path]


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _encode_batches(path: str, end_id: int, keep: bool = True):
    """Batches (doc_id, text) into (doc_ids, ids of a block with end ids, where each document's begin).

    keep: the worker holds its table of pieces for the next task, and larger blocks are encoded at a time.
    """

    def run(batches):
        enc = _worker(path)
        try:
            for b in batches:
                data, off = text_buffer(b.column(1))
                for lo, hi in blocks(off, BLOCK if keep else BLOCK // 2):
                    ids, first = enc.encode_block(data[off[lo] : off[hi]], off[lo : hi + 1] - off[lo])
                    yield b.column(0).slice(lo, hi - lo), np.insert(ids, first[1:], end_id), first + np.arange(len(first))
        finally:
            if not keep:
                enc.forget()

    return run


def train_dictionary(docs: DataFrame, path: str, width: int, end_id: int = END_ID, rows: int = FIT_ROWS, keep: bool = True) -> bytes:
    """A zstandard dictionary from the serialized ids of a bounded sample of shorter documents."""
    total = docs.select("doc_id").count()
    part = docs.where(F.length("text") <= FIT_CHARS).where(unit_hash(F.col("doc_id"), F.col("text"), F.lit(11)) < rows / max(total, 1))
    step = _encode_batches(path, end_id, keep)

    def run(batches):
        for _, ids, first in step(batches):
            yield pa.RecordBatch.from_arrays([pa.array(_serialized(ids, first, width), pa.binary())], names=["ids"])

    samples = [r for r in part.select("doc_id", "text").mapInArrow(released(run), "ids binary").limit(2 * rows).toArrow().column("ids").to_pylist()]
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples).as_bytes()
    except zstandard.ZstdError:  # too little to learn from: raw content serves as the dictionary
        return b"".join(samples)[-DICTIONARY_BYTES:].ljust(8, b"\0")


def _serialized(ids: np.ndarray, first: np.ndarray, width: int) -> list[bytes]:
    flat = ids.astype("<u4" if width == 4 else "<u2")
    return [flat[a:b].tobytes() for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True)]


def _wide(ids: bytes, width: int) -> bytes:
    return ids if width == 4 else np.frombuffer(ids, "<u2").astype("<u4").tobytes()


_PACKS = "shard int, pack int, first_id bigint, last_id bigint, dictionary_sha256 string, payload binary, doc_ids array<bigint>, offsets array<bigint>, counts array<bigint>, starts array<bigint>"


def write(docs: DataFrame, folder: str, path: str | None = None, end_id: int = END_ID, keep: bool = True) -> str:
    """Writes the ids of docs (doc_id, text) in ascending doc_id order; returns the folder.

    keep: Python workers hold their table of pieces between tasks and encode larger blocks, which saves time and costs memory.
    """
    spark = docs.sparkSession
    path = path or default_tokenizer()
    small_batches(spark)
    from tokenizers import Tokenizer

    width = 2 if max(Tokenizer.from_file(path).get_vocab_size(), end_id + 1) <= 1 << 16 else 4
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    words = train_dictionary(docs, path, width, end_id, keep=keep)
    sha = hashlib.sha256(words).hexdigest()
    spark.createDataFrame([(bytearray(words), sha, width)], "content binary, sha256 string, width int").coalesce(1).write.parquet(f"{folder}/dictionary")
    shared = spark.sparkContext.broadcast(words)
    step = _encode_batches(path, end_id, keep)

    def compress(batches):
        z = zstandard.ZstdCompressor(level=LEVEL, dict_data=zstandard.ZstdCompressionDict(shared.value), write_content_size=True)
        for doc_id, ids, first in step(batches):
            frames = pa.array([z.compress(x) for x in _serialized(ids, first, width)], pa.binary())
            yield pa.RecordBatch.from_arrays([doc_id, pa.array(np.diff(first)), frames], names=["doc_id", "n", "frame"])

    # frames are written once, so that the range partitioning below samples them and doesn't encode again
    stage = scratch(spark, "frames")
    docs.mapInArrow(released(compress), "doc_id bigint, n bigint, frame binary").write.option("compression", "none").parquet(stage)
    frames = spark.read.parquet(stage)
    size = frames.agg(F.sum(F.length("frame"))).first()[0] or 0
    parts = max(min(MANY, size // SHARD + 1), size // LARGE_SHARD, spark.sparkContext.defaultParallelism)
    ordered = frames.repartitionByRange(parts, F.col("doc_id").asc_nulls_first(), "n", F.xxhash64("frame")).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "n", F.xxhash64("frame"))
    ordered = ordered.withColumn("shard", F.spark_partition_id())

    def pack(batches):
        number, start = 0, 0
        ids, counts, starts, blobs, held, shard = [], [], [], [], 0, 0

        def flush():
            known = [x for x in ids if x is not None]
            offsets = np.concatenate([[0], np.cumsum([len(x) for x in blobs])]).tolist()
            row = [shard, number, min(known, default=None), max(known, default=None), sha, b"".join(blobs), ids, offsets, counts, starts]
            kinds = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.string(), pa.binary(), *[pa.list_(pa.int64())] * 4]
            return pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip(row, kinds, strict=True)], names=[x.split()[0] for x in _PACKS.split(", ")])

        for b in batches:
            for doc_id, n, frame, s in zip(*(c.to_pylist() for c in b.columns), strict=True):
                shard = s
                ids.append(doc_id)
                counts.append(n)
                starts.append(start)
                blobs.append(frame)
                start += n
                held += len(frame)
                if held >= PACK:
                    yield flush()
                    number += 1
                    ids, counts, starts, blobs, held = [], [], [], [], 0
        if ids:
            yield flush()

    ordered.mapInArrow(released(pack), _PACKS).write.option("compression", "none").parquet(f"{folder}/packs")
    discard(spark, stage)
    return folder


def read(spark: SparkSession, folder: str, doc_ids: list[int] | None = None) -> DataFrame:
    """(doc_id, start, ids): all documents, or those of a bounded list, from the files.

    start counts the ids of all documents before it, over the whole of the files.
    """
    rows = spark.read.parquet(f"{folder}/dictionary").collect()
    words, sha, width = bytes(rows[0]["content"]), rows[0]["sha256"], rows[0]["width"]
    if hashlib.sha256(words).hexdigest() != sha:
        raise ValueError("the dictionary does not match its hash")
    packs = spark.read.parquet(f"{folder}/packs")
    # one total per shard: as many numbers as there were write tasks
    totals = {r[0]: r[1] for r in packs.groupBy("shard").agg(F.sum(F.aggregate("counts", F.lit(0).cast("long"), lambda a, x: a + x))).collect()}
    before, base = 0, {}
    for shard in sorted(totals):
        base[shard] = before
        before += totals[shard]
    wanted = None
    if doc_ids is not None:
        wanted = set(doc_ids)
        packs = packs.where(" or ".join(f"(first_id <= {int(x)} and last_id >= {int(x)})" for x in wanted) or "false")
    shared = spark.sparkContext.broadcast((words, base))

    def run(batches):
        content, begin = shared.value
        z = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(content))
        for b in batches:
            cols = {n: b.column(i) for i, n in enumerate(b.schema.names)}
            for r in range(b.num_rows):
                if cols["dictionary_sha256"][r].as_py() != sha:
                    raise ValueError("a pack needs another dictionary")
                payload = cols["payload"][r].as_buffer()
                ids, off, starts = (cols[c][r].as_py() for c in ("doc_ids", "offsets", "starts"))
                first = begin[cols["shard"][r].as_py()]
                pick = [k for k in range(len(ids)) if wanted is None or ids[k] in wanted]
                for lo in range(0, len(pick), 200):
                    part = pick[lo : lo + 200]
                    out = [_wide(z.decompress(memoryview(payload)[off[k] : off[k + 1]]), width) for k in part]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([ids[k] for k in part], pa.int64()), pa.array([first + starts[k] for k in part], pa.int64()), pa.array(out, pa.binary())], names=["doc_id", "start", "ids"]
                    )

    cols = ["shard", "dictionary_sha256", "payload", "doc_ids", "offsets", "starts"]
    return packs.select(*cols).mapInArrow(released(run), "doc_id bigint, start bigint, ids binary")


def summary(spark: SparkSession, folder: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32), read back from the files."""
    return read(spark, folder).select("doc_id", "start", (F.length("ids") / 4).cast("long").alias("n_tokens"), F.crc32("ids").alias("ids_crc32"))


def encode_and_read(docs: DataFrame, keep: bool = True) -> DataFrame:
    spark = docs.sparkSession
    return summary(spark, write(docs.select("doc_id", "text"), scratch(spark, "token-files"), keep=keep))


def op9_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_and_read(spark.read.parquet(f"{sf_dir}/documents.parquet"))
