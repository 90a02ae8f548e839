"""Secret scans: fixed patterns, and a linear-chain conditional random field that finds what they miss.

The field tags a line's tokens as secret begin, inside or outside. It learns
from what the patterns find in a bounded sample, by features that don't
depend on the patterns' own limits: shape, neighbouring words, and what kind
of file it is. Lines whose best tag sequence is provably all outside aren't
decoded.
"""

from __future__ import annotations

import hashlib
import math
import re
import string
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lattica.llm.common import id_hash

KINDS = ("assign", "access", "hex", "crf")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS, HEX = re.compile(r"AKIA[A-Z0-9]+"), re.compile(r"[0-9a-f]+")
TOKEN, TOKEN_OR_LINE = re.compile(r"\w+|[^\w\s]"), re.compile(r"\w+|[^\w\s]|\n")
#: A text without any of these has no match of the first pattern.
WORDS_OF_ASSIGN = ("passw", "secret", "token", "apikey", "api_key")
IS_HEX = bytes(104 if c in b"0123456789abcdef" else 32 for c in range(256))
B, I, O = range(3)
RUNS, KINDS_OF = re.compile(r"(.)\1+"), str.maketrans({**{c: "x" for c in string.ascii_lowercase}, **{c: "X" for c in string.ascii_uppercase}, **{c: "0" for c in string.digits}})
BITS, FILES, CACHE = 18, 8, 300_000
#: Lines with a secret count so many times in training.
FOUND_TIMES = 6
#: Features of a neighbour that isn't looked at.
BLIND = (1 << BITS) - 1


def base_spans(text: str) -> list[tuple[int, int, int, int]]:
    """(start, kind, end, start of the secret itself) of the patterns' matches, by start, then kind."""
    # plain substring tests spare most texts the slower patterns
    low, out = text.lower(), []
    if any(w in low for w in WORDS_OF_ASSIGN):
        out += [(m.start(), 0, m.end(), m.start(2)) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end(), m.start()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    if b"h" * 24 in text.encode("utf-8", "surrogatepass").translate(IS_HEX):
        out += [(m.start(), 2, m.end(), m.start()) for m in HEX.finditer(text) if m.end() - m.start() >= 24]
    return sorted(out)


def shown(spans: list) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b, *_ in spans)


def code(name: str) -> int:
    return crc32(name.encode("utf-8", "surrogatepass")) % BLIND


def kinds_of(token: str) -> str:
    """A token's kinds of characters, runs of one kind once: 0 digit, X and x ASCII letters, a other letters."""
    return RUNS.sub(r"\1", token.translate(KINDS_OF) if token.isascii() else "".join(KINDS_OF.get(ord(c)) or ("a" if c.isalpha() else "0" if c.isdigit() else c) for c in token))


_OWN: dict = {}


def traits(token: str) -> tuple[tuple, tuple]:
    """Hashed features of a token for its own place, and for its neighbours' places."""
    low, n = token.lower(), min(len(token), 40)
    plain = token.isalpha()
    # most tokens are words whose shape needs no pattern
    kinds = ("x" if token == low else "Xx" if n > 1 and token[1:] == low[1:] else kinds_of(token)) if plain and token.isascii() else kinds_of(token)
    if plain or n < 6:
        entropy, mixed = -1, False  # words and short tokens are told apart by shape and length alone
    else:
        entropy = int(-2 * sum(c / len(token) * math.log2(c / len(token)) for c in Counter(token).values()))
        mixed = "0" in kinds and any(c in kinds for c in "xXa")
    key = (kinds, n, entropy, mixed, not token.strip("0123456789abcdef"))
    found = _OWN.get(key)
    if found is None:
        if len(_OWN) > CACHE:
            _OWN.clear()
        own = tuple(map(code, (f"s{kinds[:8]}", f"l{n // 4}", f"e{entropy}", f"m{mixed}{min(n, 24) // 8}", f"c{min(len(kinds), 12)}", f"x{key[4]}{min(n, 24) // 8}")))
        found = _OWN[key] = own, code(f"s{kinds[:4]}")
    return found[0], (code("w" + low) if n <= 16 and not mixed else code("long"), found[1])


def file_kind(text: str) -> int:
    return (text.count("=") > 3) + 2 * ("{" in text) + 4 * (text.count("\n") > 20)


@dataclass
class Crf:
    own: np.ndarray  # features x tags
    before: np.ndarray
    before2: np.ndarray
    after: np.ndarray
    file: np.ndarray
    step: np.ndarray  # tags x tags
    start: np.ndarray


def emissions(m: Crf, own: np.ndarray, near: np.ndarray, kind: int) -> np.ndarray:
    e = m.own[own].sum(1) + m.file[kind]
    e[1:] += m.before[near[:-1]].sum(1)
    e[2:] += m.before2[near[:-2]].sum(1)
    e[:-1] += m.after[near[1:]].sum(1)
    return e


def learn(m: Crf, line: tuple, rate: float) -> None:
    """One step up the gradient of a line's log likelihood: observed less expected features, by scaled forward and backward values."""
    own, near, kind, y = line
    e = emissions(m, own, near, kind)
    n = len(e)
    p, step, start = np.exp(e - e.max(1, keepdims=True)), np.exp(m.step), np.exp(m.start)
    a, b, now = np.empty((n, 3)), np.ones((n, 3)), start * p[0]
    for t in range(n):
        if t:
            now = (now @ step) * p[t]
        now = now / now.sum()
        a[t] = now
    ahead, now = np.empty((n, 3)), np.ones(3)
    for t in range(n - 1, 0, -1):
        ahead[t] = p[t] * now
        now = step @ ahead[t]
        now = now / now.sum()
        b[t - 1] = now
    both = a * b
    g = -both / both.sum(1, keepdims=True)
    g[np.arange(n), y] += 1
    g *= rate
    if n > 1:
        pair = a[:-1, :, None] * step * ahead[1:, None, :]
        moved = -(pair / pair.sum((1, 2), keepdims=True)).sum(0)
        np.add.at(moved, (y[:-1], y[1:]), 1)
        m.step += rate * moved
        m.step[O, I] = -20.0  # inside follows begin or inside alone
    m.start += g[0]
    m.start[I] = -20.0
    m.file[kind] += g.sum(0)
    for table, at, grad in ((m.own, own, g), (m.before, near[:-1], g[1:]), (m.before2, near[:-2], g[2:]), (m.after, near[1:], g[:-1])):
        np.add.at(table, at.ravel(), np.repeat(grad, at.shape[1], 0))


def sampled(docs: DataFrame, most_texts: int) -> list[str]:
    """About most_texts texts at most, those of the lowest id hashes; rows beyond the hash bound never leave their task."""
    n = docs.where("text is not null").count()
    h = id_hash(F.col("doc_id"), 40)
    some = docs.where("text is not null").where(h < int(min(1.0, most_texts / max(n, 1)) * (1 << 40)) + (n <= most_texts)).select(h.alias("h"), "text")
    return [r["text"] for r in sorted(some.toLocalIterator(), key=lambda r: (r["h"], r["text"]))][: 2 * most_texts]


def train(docs: DataFrame, most_texts: int = 2000, passes: int = 3, plain_lines: int = 1000, blind: float = 0.5) -> Crf:
    """Learns from pieces of lines (200 tokens at most) with a match, and plain_lines without one, of about most_texts texts of the lowest id hashes.

    In a part `blind` of the lines the words around a token count for
    nothing, so that a secret's own shape is learned as well as its setting.
    """
    texts = sampled(docs, most_texts)
    size = 1 << BITS
    m = Crf(*(np.zeros((size, 3)) for _ in range(4)), np.zeros((FILES, 3)), np.zeros((3, 3)), np.array([0.0, -20.0, 0.0]))
    m.step[O, I] = -20.0
    lines, plain, seen = [], [], {}
    for text in texts:
        spans, kind, at = [(s, e) for _, _, e, s in base_spans(text)], file_kind(text), 0
        for line in text.split("\n"):
            inside = [(s - at, e - at) for s, e in spans if at <= s < at + len(line)]
            at += len(line) + 1
            if not inside and len(plain) >= plain_lines:
                continue
            whole = list(TOKEN.finditer(line))
            for cut in range(0, len(whole), 200):
                toks = whole[cut : cut + 200]
                y = np.full(len(toks), O)
                for s, e in inside:
                    hit = [i for i, t in enumerate(toks) if t.start() < e and t.end() > s]
                    if hit:
                        y[hit[0]], y[hit[1:]] = B, I
                for t in toks:
                    if t[0] not in seen:
                        seen[t[0]] = traits(t[0])
                own, near = (np.array(x) for x in zip(*(seen[t[0]] for t in toks)))
                if (y != O).any():
                    lines.append((own, near, kind, y))
                elif len(plain) < plain_lines:
                    plain.append((own, near, kind, y))
    lines += plain if lines else []
    order = np.random.default_rng(0)
    often = np.repeat(np.arange(len(lines)), [FOUND_TIMES if (y != O).any() else 1 for *_, y in lines])
    for p in range(passes):
        for i in order.permutation(often):
            own, near, kind, y = lines[i]
            if order.random() < blind:
                near = np.full_like(near, BLIND)
            learn(m, (own, near, kind, y), 0.2 / (1 + p))
    for table in (m.before, m.before2, m.after):
        table[BLIND] = 0.0
    if not lines:
        m.file[:, O] = 100.0
    return m


class Tagger:
    """Decodes texts; a token's scores are kept by token, at most CACHE of them."""

    def __init__(self, m: Crf):
        self.m, self.ids, self.n = m, {}, 0
        self.scores = np.zeros((CACHE, 4, 3))
        # the most that a run of tokens inside can gain over staying outside, by its way in, on and out
        s = m.step
        self.enter = float(max(s[O, B] - s[O, O], s[B, B] - s[O, O], s[I, B] - s[O, O], s[B, I] - s[O, O], s[I, I] - s[O, O]))
        self.leave = float(max(s[B, O], s[I, O]) - s[O, O])
        self.begin = float(m.start[B] - m.start[O])

    def admit(self, tokens: list[str]) -> None:
        """Scores of the tokens that aren't known yet, all at once."""
        new = [t for t in dict.fromkeys(tokens) if t not in self.ids]
        if self.n + len(new) > len(self.scores):
            self.ids, self.n, new = {}, 0, list(dict.fromkeys(tokens))
            if len(new) > len(self.scores):
                self.scores = np.zeros((2 * len(new), 4, 3))
        if not new:
            return
        own, near = (np.array(x) for x in zip(*map(traits, new)))
        m, at = self.m, slice(self.n, self.n + len(new))
        for i, (table, f) in enumerate(((m.own, own), (m.before, near), (m.before2, near), (m.after, near))):
            self.scores[at, i] = table[f].sum(1)
        self.ids.update(zip(new, range(self.n, self.n + len(new))))
        self.n += len(new)

    def spans(self, text: str) -> list[tuple[int, int]]:
        """All lines are scored at once; only those whose best tags may not all be outside are decoded."""
        tokens = TOKEN_OR_LINE.findall(text)
        self.admit(tokens)
        ids = np.fromiter(map(self.ids.__getitem__, tokens), np.int64, len(tokens))
        ends = ids == self.ids.get("\n", -1)
        line, ids = np.cumsum(ends)[~ends], ids[~ends]
        if not len(ids):
            return []
        s = self.scores[ids]
        e = s[:, 0] + self.m.file[file_kind(text)]
        one, two = (line[1:] == line[:-1])[:, None], (line[2:] == line[:-2])[:, None]
        e[1:] += s[:-1, 1] * one
        e[2:] += s[:-2, 2] * two
        e[:-1] += s[1:, 3] * one
        # tags other than outside can win only if some token gains more than it loses: each brings its score, its way in and its part of the way out
        gain = np.maximum(e[:, B], e[:, I]) - e[:, O] + max(0.0, self.leave) + self.enter
        gain[np.concatenate(([True], ~one[:, 0]))] += max(0.0, self.begin - self.enter)
        open_ = np.unique(line[gain > 0])
        if not len(open_):
            return []
        out, lines = [], text.split("\n")
        at = np.concatenate(([0], np.cumsum([len(x) + 1 for x in lines])))
        for k in open_.tolist():
            lo, hi = np.searchsorted(line, (k, k + 1))
            tags = self.best(e[lo:hi])
            if (tags != O).any():
                where = [(t.start(), t.end()) for t in TOKEN.finditer(lines[k])]
                for i in np.flatnonzero(tags == B).tolist():
                    j = i
                    while j + 1 < len(tags) and tags[j + 1] == I:
                        j += 1
                    out.append((int(at[k]) + where[i][0], int(at[k]) + where[j][1]))
        return out

    def best(self, e: np.ndarray) -> np.ndarray:
        back, v, (p, q, r) = [], (self.m.start + e[0]).tolist(), self.m.step.T.tolist()
        for now in e[1:].tolist():
            row, choice = [], []
            for into, x in zip((p, q, r), now):
                c = (v[0] + into[0], v[1] + into[1], v[2] + into[2])
                k = O if c[2] >= c[0] and c[2] >= c[1] else (B if c[0] >= c[1] else I)
                row.append(c[k] + x)
                choice.append(k)
            v = row
            back.append(choice)
        tags = np.empty(len(e), int)
        k = int(np.argmax(v))
        for t in range(len(e) - 1, -1, -1):
            tags[t] = k
            if t:
                k = back[t - 1][k]
        return tags


_TAGGERS: dict = {}


def tagger_of(m: Crf) -> Tagger:
    """One tagger a worker process, so that its cache outlives a task."""
    key = hash((m.own.tobytes(), m.step.tobytes()))
    if key not in _TAGGERS:
        _TAGGERS.clear()
        _TAGGERS[key] = Tagger(m)
    return _TAGGERS[key]


def scan(docs: DataFrame, model: Crf) -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_crf) for every row of docs.

    Offsets are code points, ends exclusive; base spans are whole matches. A
    span of the field that touches a base span isn't added. A null or empty
    text has no spans. Other columns are ignored; an empty table gives none.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # four tables of 2^18 features
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tagger = tagger_of(shared.value)
        for b in batches:
            rows = []
            for text in b.column("text").to_pylist():
                base = base_spans(text or "")
                added = [(a, 3, z, a) for a, z in tagger.spans(text or "") if not any(a < e and z > s for s, _, e, _ in base)]
                n = Counter(k for _, k, *_ in base)
                rows.append((n[0], n[1], n[2], hashlib.sha256(shown(base).encode()).hexdigest(), shown(sorted(base + added)), len(added)))
            cols = list(zip(*rows)) if rows else [()] * 6
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *(pa.array(c, t) for c, t in zip(cols, kinds))], names=["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_crf"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_crf long")


def op3_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row of documents with its spans; see train and scan."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return scan(docs, train(docs))
