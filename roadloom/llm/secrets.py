"""Secret spans: three base patterns, and a conditional random field that adds what they miss.

White-space tokens get the tags outside, begin and inside. Features are the token's shape (counts
of letters, digits and other characters by class, length class), its changes between letters and
digits, the hashed neighbouring words, their shapes, and a class of the whole file (how much of it
is punctuation and digits). The field is fitted on silver tags from the base patterns over a
bounded sample and decoded by Viterbi; a line is a sequence. Each tagged line is also shown with
other names and values of other alphabets and lengths in the place of its secret, tagged alike, so
that the field learns the look and the place of a secret and not the base patterns. Decoded tokens
that touch no base span are added as spans of the kind ``crf``; base spans always stay.

Defined results: null and empty texts have no span; without a base match in the sample nothing is
added; repeated rows get equal results; offsets are code points, ends are exclusive.
"""

from __future__ import annotations

import hashlib
import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from roadloom.llm.common import FIT_TEXT_BYTES, map_texts, text_parts, unit_hash
from roadloom.llm.crf import Chain, fit as fit_chain, viterbi
from roadloom.llm.ngram_lr import word_forms
from roadloom.llm.textbytes import ALNUM, LOWER, NOT_SPACE, Words, bucket, code_points, find_words, hash_words, mix

ASSIGN = re.compile(rb"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
KINDS = ("assign", "access", "hex", "crf")
MIN_ASSIGN, MIN_ACCESS, MIN_HEX = 6, 20, 24
KEYWORDS = (b"password", b"passwd", b"secret", b"token", b"apikey", b"api_key")
_HEX = np.zeros(256, bool)
_HEX[48:58] = _HEX[97:103] = True

BITS = 16
#: Rows of the corpus that are searched for silver tags, and rows kept of those: half with a hint, half without.
FIT_SEARCH, FIT_ROWS = 40_000, 1000
#: Names, what parts them from the value, and alphabets of the other forms shown of a tagged line, and how many of them.
NAMES = ("credential", "auth", "key", "pwd", "signature", "client_key", "access", "login", "bearer", "private_key")
PARTED = (' = "', ': "', '="', ":'", ": ", "=", ' => "', " := ")
ALPHABETS = ("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", "0123456789ABCDEF", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789_-")
FORMS, FORM_LINES = 6, 200
#: Epochs of the fit, and tokens after which it parts a line of its sample (decoding never does).
FIT_EPOCHS, FIT_LINE = 30, 200
#: Shorter values are not added.
MIN_ADDED = 8


def base_spans(data: np.ndarray, off: np.ndarray) -> list[tuple[int, int, int, int]]:
    """(row, byte start, byte end, kind), ordered by row, start and kind; bytes count from the block's start."""
    found = []
    low = LOWER[data].tobytes()
    raw = data.tobytes()
    rows = set()
    for k in KEYWORDS:
        i = low.find(k)
        while i >= 0:
            rows.add(int(np.searchsorted(off, i, "right")) - 1)
            i = low.find(k, i + 1)
    for r in rows:
        for m in ASSIGN.finditer(raw, int(off[r]), int(off[r + 1])):
            if len(m[1]) >= MIN_ASSIGN:
                found.append((r, m.start(), m.end(), 0))
    rows = set()
    i = raw.find(b"AKIA")
    while i >= 0:
        rows.add(int(np.searchsorted(off, i, "right")) - 1)
        i = raw.find(b"AKIA", i + 1)
    for r in rows:
        for m in ACCESS.finditer(raw, int(off[r]), int(off[r + 1])):
            if m.end() - m.start() >= MIN_ACCESS:
                found.append((r, m.start(), m.end(), 1))
    w = find_words(data, off, _HEX)
    for i in np.flatnonzero(w.end - w.start >= MIN_HEX).tolist():
        found.append((int(w.row[i]), int(w.start[i]), int(w.end[i]), 2))
    return sorted(found, key=lambda x: (x[0], x[1], x[3]))


def tokens(data: np.ndarray, off: np.ndarray) -> tuple[Words, np.ndarray]:
    """White-space tokens, and the first token of each line."""
    w = find_words(data, off, NOT_SPACE)
    new = np.ones(len(w.start), bool)
    if len(new):
        stops = np.concatenate([[0], np.cumsum(data == 10)])
        new[1:] = (stops[w.start[1:]] > stops[w.end[:-1]]) | (w.row[1:] != w.row[:-1])
    return w, np.append(np.flatnonzero(new), len(new))


def fields(data: np.ndarray, off: np.ndarray, w: Words, line: np.ndarray) -> list[np.ndarray]:
    low = LOWER[data]
    word = hash_words(low, w.start, w.end)
    form = word_forms(data, w.start, w.end)
    digit = (data >= 48) & (data <= 57)
    alpha = ALNUM[data] & ~digit
    swap = np.zeros(len(data) + 1, np.int64)
    if len(data) > 1:
        swap[2:] = np.cumsum((digit[1:] & alpha[:-1]) | (alpha[1:] & digit[:-1]))
    size = w.end - w.start
    changes = swap[w.end] - swap[np.minimum(w.start + 1, w.end)]
    mixed = np.minimum(changes, 12) * 8 + np.searchsorted([4, 8, 12, 18, 24, 34, 44], size)
    # the file: share of characters that are neither letters nor spaces, in classes
    marks = np.concatenate([[0], np.cumsum(~alpha & NOT_SPACE[data])])
    share = (marks[off[1:]] - marks[off[:-1]]) / np.maximum(np.diff(off), 1)
    file = np.searchsorted([0.02, 0.05, 0.1, 0.2], share)[w.row].astype(np.uint64)

    def shift(x, by, fill):
        out = np.full_like(x, fill)
        if by > 0:
            out[by:] = x[:-by]
            for k in range(by):
                out[np.minimum(line[:-1] + k, len(x) - 1)] = fill
        else:
            out[:by] = x[-by:]
            out[line[1:] - 1] = fill
        return out

    p1, p2, n1 = shift(word, 1, 1), shift(word, 2, 2), shift(word, -1, 3)
    keys = [form, mix(mixed.astype(np.uint64), 1), mix(p1, 2), mix(p1 ^ mix(p2, 9), 3), mix(n1, 4), mix(shift(form, 1, 997), 5), mix(shift(form, -1, 998), 6), mix(form * np.uint64(8) + file, 7)]
    return [bucket(k, BITS, i) for i, k in enumerate(keys)]


@dataclass
class SecretModel:
    chain: Chain | None


def silver_tags(w: Words, spans: list[tuple[int, int, int, int]]) -> np.ndarray:
    """0 outside, 1 begin, 2 inside: tokens that a base span touches."""
    tag = np.zeros(len(w.start), np.int64)
    for _, s, e, _k in spans:
        a, b = np.searchsorted(w.end, s, "right"), np.searchsorted(w.start, e, "left")
        if b > a:
            fresh = tag[a] == 0
            tag[a:b] = np.maximum(tag[a:b], 2)
            if fresh:
                tag[a] = 1
    return tag


def other_forms(data: np.ndarray, spans: list[tuple[int, int, int, int]]) -> tuple[np.ndarray, np.ndarray, list[tuple[int, int, int, int]]]:
    """Lines with a base span, the secret in them written in other ways: their bytes, offsets and spans."""
    rng = np.random.default_rng(3)
    raw, lines, out, at = data.tobytes(), [], [], 0
    step = max(1, len(spans) // FORM_LINES)
    for _, s, e, kind in spans[::step]:
        lo, hi = raw.rfind(b"\n", 0, s) + 1, raw.find(b"\n", e)
        lo, hi = max(lo, s - 200), min(len(raw) if hi < 0 else hi, e + 200)
        found = ASSIGN.match(raw, s, e) if kind == 0 else None
        value = found.start(1) if found else s
        for form in range(FORMS):
            letters = ALPHABETS[int(rng.integers(len(ALPHABETS)))]
            secret = "".join(letters[i] for i in rng.integers(0, len(letters), int(rng.integers(16, 45)))).encode()
            head, after = raw[s:value], raw[e:hi]
            if found and form:
                parted = PARTED[int(rng.integers(len(PARTED)))]
                head = (NAMES[int(rng.integers(len(NAMES)))] + parted).encode()
                after = after[after[:1] in (b'"', b"'") :]
                if parted[-1] in "\"'":
                    after = parted[-1].encode() + after
            before, after = (x.decode("utf-8", "ignore").encode() for x in (raw[lo:s], after))
            line = before + head + secret + after
            out.append((len(lines), at + len(before), at + len(before) + len(head) + len(secret), kind))
            lines.append(line)
            at += len(line)
    return np.frombuffer(b"".join(lines), np.uint8), np.cumsum([0, *map(len, lines)]), out


def fit(docs: DataFrame, search: int = FIT_SEARCH, rows: int = FIT_ROWS) -> SecretModel:
    """Fits on a bounded sample: of about ``search`` rows about ``rows``, chosen by hash from all of them.

    Half of it are rows that a hint of a base match marks, half are others; more of one where the other has fewer.
    """
    total = docs.select("doc_id").count()
    key = F.xxhash64("doc_id", "text")
    hint = F.col("text").rlike(r"(?i:password|passwd|secret|token|api_?key)|AKIA[A-Z0-9]{16}|[0-9a-f]{24}")
    part = docs.where(F.octet_length("text") <= FIT_TEXT_BYTES).where(unit_hash(key, F.lit(3)) < search / max(total, 1)).select(key.alias("key"), "text", hint.alias("hint"))
    counts = {r[0]: r[1] for r in part.groupBy("hint").count().collect()}
    marked, others = counts.get(True, 0), counts.get(False, 0)
    share = F.when(F.col("hint"), F.lit(max(rows / 2, rows - others) / max(marked, 1))).otherwise(F.lit(max(rows / 2, rows - marked) / max(others, 1)))
    got = part.where(unit_hash(F.col("key"), F.lit(5)) < share).select("key", "text").limit(2 * rows).toArrow().sort_by([("key", "ascending")])
    data, off = text_parts(got.column("text"))
    w, line = tokens(data, off)
    spans = base_spans(data, off) if len(w.start) else []
    tag = silver_tags(w, spans)
    if not (tag > 0).any():
        return SecretModel(None)
    index = fields(data, off, w, line)
    more, more_off, more_spans = other_forms(data, spans)
    more_w, more_line = tokens(more, more_off)
    index = [np.concatenate(x) for x in zip(index, fields(more, more_off, more_w, more_line), strict=True)]
    tag = np.concatenate([tag, silver_tags(more_w, more_spans)])
    first = np.concatenate([line, len(w.start) + more_line[1:]])
    first = np.unique(np.concatenate([first, *(np.arange(a, b, FIT_LINE) for a, b in zip(first[:-1], first[1:], strict=True) if b - a > FIT_LINE)]))
    return SecretModel(fit_chain(index, tag, first, BITS, 3, epochs=FIT_EPOCHS))


def added_spans(model: SecretModel, data: np.ndarray, off: np.ndarray, base: list[tuple[int, int, int, int]]) -> list[tuple[int, int, int, int]]:
    """Viterbi spans without the tokens that touch a base span; quotes and brackets around them go, and short ones.

    A decoded run is cut at base spans, and what is left of it on either side is a span of its own.
    """
    w, line = tokens(data, off)
    if model.chain is None or not len(w.start):
        return []
    tag = viterbi(model.chain, model.chain.scores(fields(data, off, w, line)), line)
    hot = np.flatnonzero((tag > 0) & (silver_tags(w, base) == 0))
    opens = np.zeros(len(tag), bool)
    opens[line[:-1]] = True
    out, i = [], 0
    while i < len(hot):
        j = i + 1
        while j < len(hot) and hot[j] == hot[j - 1] + 1 and tag[hot[j]] == 2 and not opens[hot[j]]:
            j += 1
        s, e = int(w.start[hot[i]]), int(w.end[hot[j - 1]])
        piece = data[s:e].tobytes()
        s += len(piece) - len(piece.lstrip(b"\"'([{<"))
        e -= len(piece) - len(piece.rstrip(b"\"')]}>,;."))
        if e - s >= MIN_ADDED:
            out.append((int(w.row[hot[i]]), s, e, 3))
        i = j
    return out


_EMPTY = hashlib.sha256(b"").hexdigest()


def scan(docs: DataFrame, model: SecretModel, keep: list[str]) -> DataFrame:
    """Adds n_assign, n_access, n_hex, base_sha256, spans and n_added."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        m = shared.value

        def fn(data, off):
            n = len(off) - 1
            base = base_spans(data, off)
            more = added_spans(m, data, off, base)
            counts = np.zeros((4, n), np.int64)
            digest, text = [_EMPTY] * n, [""] * n
            if base or more:
                cp = code_points(data)
                of: dict[int, list] = {}
                for r, s, e, k in base + more:
                    counts[k, r] += 1
                    of.setdefault(r, []).append((int(cp[s] - cp[off[r]]), k, int(cp[e] - cp[off[r]])))
                for r, items in of.items():
                    items.sort()
                    said = [f"{KINDS[k]}:{s}:{e}" for s, k, e in items]
                    text[r] = ",".join(said)
                    digest[r] = hashlib.sha256(",".join(x for x, (_, k, _e) in zip(said, items, strict=True) if k < 3).encode()).hexdigest()
            return counts[0], counts[1], counts[2], pa.array(digest, pa.string()), pa.array(text, pa.string()), counts[3]

        return fn

    return map_texts(docs, keep, "n_assign bigint, n_access bigint, n_hex bigint, base_sha256 string, spans string, n_added bigint", make)


def op3_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return scan(docs, fit(docs), ["doc_id"])
