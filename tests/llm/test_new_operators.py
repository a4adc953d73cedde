"""Importance resampling, prefix trie and packing against plain versions on small and odd tables."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from roadloom.llm import importance, packing, prefix_trie
from roadloom.llm.ordering import placed, prefix_scan
from roadloom.llm.textbytes import text_buffer

DOCS = "doc_id long, text string, n_words long, score string"
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


# ---- global order ----------------------------------------------------------------------------------


def test_placed_numbers_all_rows(spark):
    rows = [(i * 7919 % 500 if i % 3 else None, i % 5) for i in range(500)]
    got = placed(spark.createDataFrame(rows, "a int, b int").repartition(6), [F.col("a").asc_nulls_last(), F.col("b")]).collect()
    assert sorted(r.place for r in got) == list(range(500))
    key = lambda r: (r.a is None, r.a or 0, r.b)
    assert [key(r) for r in sorted(got, key=lambda r: r.place)] == sorted(map(key, got))
    assert placed(spark.createDataFrame([], "a int"), [F.col("a")]).count() == 0


@pytest.mark.parametrize("base", [1, 3, prefix_trie.BASE])
def test_prefix_scan_spans_partitions(spark, base):
    rng = random.Random(5)
    sizes = {1: 900, 2: 1, 3: 40, 7: 3}  # key 1 fills several ranges
    rows = [(k, i, rng.randrange(1 << 40)) for k, n in sizes.items() for i in range(n)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "k long, i long, v long").repartition(5)
    got = {(r.k, r.i): r for r in prefix_scan(df, "k", [F.col("k"), F.col("i")], ["v"], base).collect()}
    assert len(got) == len(rows)
    value = {(k, i): v for k, i, v in rows}
    for k, n in sizes.items():
        total = 0
        for i in range(n):
            r = got[k, i]
            assert r.nth == i and r.v_before % 2**64 == total
            total = (total + value[k, i] * pow(base, i, 2**64)) % 2**64
            assert r.v_upto % 2**64 == total


# ---- 11 --------------------------------------------------------------------------------------------


@pytest.mark.parametrize("longest", [1, 2, 3, 5])
def test_suffix_array_runs_are_the_ngrams(longest):
    texts = ["b a b a b a", "", "a b a b", "a", "É b a É b a", "A-b. B_A b"] * 3 + [" ".join(random.Random(3).choices("abc", k=200))]
    data, off = text_buffer(pa.array(texts))
    found, first = importance.feature_buckets(data, off, longest, 977)
    for n in range(1, longest + 1):
        want = []
        for t in texts:
            w = words(t)
            want += [zlib.crc32(" ".join(w[i : i + n]).encode()) % 977 if i + n <= len(w) else -1 for i in range(len(w))]
        assert found[n - 1].tolist() == want
    assert first.tolist() == np.cumsum([0, *(len(words(t)) for t in texts)]).tolist()


def plain_draw(docs, target, longest, buckets, percent, least, seed=2024):
    def grams(t):
        w = words(t)
        return [zlib.crc32(" ".join(w[i : i + n]).encode()) % buckets for n in range(1, longest + 1) for i in range(len(w) - n + 1)]

    s, t = (Counter(b for x in texts for b in grams(x)) for texts in ([x for _, x in docs], target))
    s_all, t_all = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (s_all + buckets) / ((s[b] + 1) * (t_all + buckets))))
    out = []
    for i, x in docs:
        g = grams(x)
        weight = sum(map(gain, g)) // len(g) if g else 0
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append([i, len(g), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, len(words(x))])
    able = sorted((r for r in out if r[5] >= least), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    for k, r in enumerate(able[: percent * len(able) // 100]):
        r[4] = k + 1
    return [tuple(r[:5]) for r in out]


def odd_documents():
    rng = random.Random(11)
    vocabulary = [f"w{i}" for i in range(60)] + ["Été", "über", "x1"]
    texts = [" ".join(rng.choices(vocabulary, k=rng.randrange(0, 60))) for _ in range(150)]
    texts += ["", None, "...", " \n\t", "word " * 30_000, texts[3], texts[3]]
    docs = list(enumerate(texts))
    return docs + [(3, texts[3]), (None, texts[5]), (None, None), (7, texts[9])]


@pytest.mark.parametrize(("longest", "buckets", "percent", "least"), [(1, 10_000, 10, 20), (2, 50, 37, 5), (3, 1000, 100, 0)])
def test_draw_equals_a_plain_version(spark, longest, buckets, percent, least):
    docs = odd_documents()
    target = ["w1 w2 w3 w1 w2", None, "", "Über w7"]
    df = spark.createDataFrame([(i, t, 5, "own") for i, t in docs], DOCS).repartition(7)
    goal = spark.createDataFrame([(t,) for t in target], "text string")
    got = importance.draw(df, goal, longest, buckets, percent, least)
    rows = [(r.doc_id, r.n_features, r.weight, r.score, r["rank"]) for r in got.collect()]
    key = lambda r: tuple((x is None, x or 0) for x in r)
    want = plain_draw(docs, target, longest, buckets, percent, least)
    assert sorted(rows, key=key) == sorted(want, key=key)


def test_resample_returns_whole_rows(spark):
    docs = odd_documents()
    df = spark.createDataFrame([(i, t, 5, "own") for i, t in docs], DOCS)
    goal = spark.createDataFrame([("w1 w2 w3",)], "text string")
    want = {r.doc_id for r in importance.draw(df, goal).where("rank is not null").collect()}
    got = importance.resample(df, goal).collect()
    assert {r.doc_id for r in got} == want and {(r.n_words, r.score) for r in got} == {(5, "own")}
    assert {(r.doc_id, r.text) for r in got} <= set(docs)
    assert importance.resample(df, goal, least_words=10**6).count() == 0


def test_draw_from_empty_tables(spark):
    none, goal = spark.createDataFrame([], DOCS), spark.createDataFrame([], "text string")
    assert importance.draw(none, goal).count() == 0
    one = importance.draw(spark.createDataFrame([(1, "a b", 0, "")], DOCS), goal, percent=100, least_words=1).collect()
    assert [(r.doc_id, r["rank"]) for r in one] == [(1, 1)]


# ---- 12 --------------------------------------------------------------------------------------------

TALKS = "conv_id long, turn long, role string, text string, v string, depth int"


def plain_trie(sequences):
    members = defaultdict(list)
    for c, turns in sequences.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    out = []
    for node, convs in members.items():
        below = [m for m in members if m[: len(node)] == node]
        kids = [m for m in members if len(m) == len(node) + 1 and m[:-1] == node]
        leaves = [m for m in below if not any(k[:-1] == m for k in members if k)]
        saved = sum((len(members[m]) - 1) * len(m[-1][1].encode()) for m in below if m)
        ends = ",".join(str(c) for c in sorted(convs) if len(sequences[c]) == len(node))
        parent = min(members[node[:-1]]) if node else None
        out.append((min(convs), len(node), parent, len(convs), len(kids), len(leaves), saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def talks(spark, seed=4, n=60):
    """Rows, and conversations in the order of their turns."""
    rng = random.Random(seed)
    lines = [("user", "hi"), ("user", "é"), (None, "hi"), ("user", None), ("", ""), ("assistant", "long " * 50)]
    rows, convs = [], {}
    for c in [*range(-7, n), 1000]:
        if c in (10, 20):
            continue  # families without a head
        own = rng.choices(lines[:3] if c % 2 else lines, k=rng.randrange(1, 12) if c != 5 else 150)
        convs[c] = [(r or "", t or "") for r, t in own]
        rows += [(c, i if i else None, r, t, "own", 9) for i, (r, t) in enumerate(own)]
    rows += [(None, 0, "user", "nobody's", "own", 9)]
    rng.shuffle(rows)
    return spark.createDataFrame(rows, TALKS).repartition(5), convs


def as_rows(df):
    names = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    return sorted((tuple(r[c] for c in names) for r in df.collect()), key=str)


@pytest.mark.parametrize("bits", [64, 5, 1])
def test_trie_equals_a_plain_version(spark, bits):
    df, convs = talks(spark)
    assert as_rows(prefix_trie.trie(prefix_trie.sequences(prefix_trie.turns_of(df)), bits)) == plain_trie(convs)


def test_rebuilt_conversations(spark):
    df, convs = talks(spark, seed=8)
    rebuilt = {}
    for c, own in convs.items():
        h = zlib.crc32(str(c).encode()) % 9
        head = c - (abs(c) % 5) * (1 if c > 0 else -1)
        rebuilt[c] = convs.get(head, [])[:h] + own[h:]
    assert as_rows(prefix_trie.trie(prefix_trie.rebuilt(prefix_trie.turns_of(df)))) == plain_trie(rebuilt)


def test_turns_that_tie_and_repeat(spark):
    df = spark.createDataFrame([(1, 0, "a", "x"), (1, 0, "a", "x"), (1, 0, "b", "y"), (2, 0, "b", "y"), (2, 0, "a", "x"), (2, 0, "a", "x")], "conv_id long, turn long, role string, text string")
    out = prefix_trie.trie(prefix_trie.sequences(prefix_trie.turns_of(df))).collect()
    assert sorted((r.depth, r.n_convs) for r in out) == [(0, 2), (1, 2), (2, 2), (3, 2)]
    none = spark.createDataFrame([], TALKS)
    assert prefix_trie.trie(prefix_trie.rebuilt(prefix_trie.turns_of(none))).count() == 0


def test_node_texts(spark):
    df, convs = talks(spark, seed=2, n=20)
    nodes = prefix_trie.node_texts(prefix_trie.trie(prefix_trie.sequences(prefix_trie.turns_of(df))), df)
    for r in nodes.collect():
        assert (r.role, r.text) == (convs[r.conv_id][r.depth - 1] if r.depth else (None, None))


# ---- 13 --------------------------------------------------------------------------------------------


def test_knapsack_is_exact():
    rng = random.Random(2)
    for _ in range(20):
        lengths = np.array(sorted(rng.sample(range(1, 40), 6)))
        prices = np.array([rng.random() for _ in lengths])
        best, choice = packing.knapsack(lengths, prices, 60)
        plain = [0.0] * 61
        for room in range(1, 61):
            plain[room] = max([plain[room - 1], *(plain[room - n] + p for n, p in zip(lengths.tolist(), prices.tolist(), strict=True) if n <= room)])
        assert np.allclose(best, plain)
        room, worth = 60, 0.0
        while room > 0:
            j = int(choice[room])
            worth, room = (worth, room - 1) if j < 0 else (worth + prices[j], room - int(lengths[j]))
        assert abs(worth - best[60]) < 1e-9


@pytest.mark.parametrize("kind", ["uniform", "large", "thirds", "small", "one", "many"])
def test_plans_hold_all_pieces_and_are_near_the_bound(kind):
    rng = np.random.default_rng(7)
    drawn = {
        "uniform": rng.integers(1, 1025, 5000), "large": rng.integers(513, 1025, 3000), "thirds": np.repeat([342, 341, 400, 283], [300, 700, 200, 200]),
        "small": rng.integers(1, 60, 20_000), "one": np.array([1024]), "many": np.repeat(np.arange(1, 1025), 1000),
    }[kind]
    lengths, counts = np.unique(drawn, return_counts=True)
    plan = packing.plan_sequences(lengths, counts, 1024)
    have = np.zeros(len(lengths), int)
    for config, n in plan:
        assert n > 0 and lengths[list(config)].sum() <= 1024
        np.add.at(have, list(config), n)
    assert (have == counts).all()
    least = packing.least_sequences(lengths, counts, 1024)
    used = sum(n for _, n in plan)
    assert least <= used <= least * 1.01 + 3
    if kind == "thirds":  # longest first spoils these: 500 sequences
        assert used < 0.96 * sum(n for _, n in packing.rounded(lengths, counts, 1024, {}))
    assert len(plan) < 20_000 and len(packing.slots(lengths, counts, plan)) < 60_000


def test_least_sequences_is_a_lower_bound():
    lengths, counts = np.array([300, 600]), np.array([2, 3])
    assert packing.least_sequences(lengths, counts, 1024) == 3 and packing.least_sequences(lengths, counts, 600) == 4


def test_packing_documents(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    texts = [t for _, t in odd_documents()] + ["a b c " * 900] * 3 + [""] * 200
    df = spark.createDataFrame([(None if i == 40 else i, t, 0, "own") for i, t in enumerate(texts)], DOCS).repartition(6)
    got = packing.pack(df, ids=True)
    rows = got.collect()
    places = defaultdict(list)
    parts = defaultdict(list)
    for r in rows:
        places[r.sequence_id].append((r.offset, r.length))
        parts[r.doc_id].append((r.piece, r.start, r.length, bytes(r.ids)))
        assert zlib.crc32(r.ids) == r.ids_crc32 and len(r.ids) == 4 * r.length
    for have in places.values():
        end = 0
        for offset, length in sorted(have):
            assert offset == end
            end += length
        assert end <= 1024
    for i, t in enumerate(texts):
        own = sorted(parts[None if i == 40 else i])
        ids = [*tok.encode(t or "", add_special_tokens=False).ids, 2]
        assert np.frombuffer(b"".join(p[3] for p in own), "<u4").tolist() == ids
        assert [p[0] for p in own] == list(range(len(own))) and all(p[2] == 1024 for p in own[1:])
        assert [p[1] for p in own] == np.cumsum([0, *(p[2] for p in own[:-1])]).tolist()
        assert len(own) == max(1, -(-len(ids) // 1024))
    total = sum(r.length for r in rows)
    assert len(places) <= -(-total // 1024) * 1.01 + 2
    whole = {r.sequence_id: r for r in packing.sequences(got).collect()}
    assert all(len(whole[s].ids) == 4 * sum(n for _, n in p) == 4 * whole[s].length for s, p in places.items())
    assert packing.pack(spark.createDataFrame([], DOCS)).count() == 0
