"""Sequence likelihoods under a hidden Markov model with states trained by Baum-Welch.

Symbols are the `most_words` most frequent words, one symbol for all other
words, and the end of a text. A word behind the shared symbol also pays its
smoothed share of that symbol's mass, so the score is the exact probability of
the text. Expected counts are summed across partitions; the forward recursion
is scaled and runs over many texts side by side.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lattica.llm.common import Scratch, doc_words, held_out, id_hash, small_join
from lattica.llm.jaccard import pieces

#: Sequences and symbols that are worked on at once; a symbol costs a double a state.
LANES, TOKENS = 4096, 1 << 20
#: Symbols whose emissions and backward values are held at once, and positions from one scaling to the next.
SPAN, EVERY = 1 << 15, 16
#: Symbols in order of position, and where the positions begin: position t of all lanes that reach it, the longest first.
Grid = tuple[np.ndarray, np.ndarray]
#: Words behind the shared symbol whose counts every task holds; counts of all others come by a join.
NEAR_WORDS = 1 << 16
#: Texts whose words a task takes apart at once.
TEXTS = 1000


@dataclass
class Hmm:
    start: np.ndarray  # states
    step: np.ndarray  # states x states
    emit: np.ndarray  # symbols x states


def lanes(seqs: list[np.ndarray]) -> Iterator[tuple[np.ndarray, Grid]]:
    """Sequences of similar length side by side, in groups of at most LANES and, but for a longer one alone, TOKENS symbols: (indices, grid)."""
    sizes = np.array([len(s) for s in seqs], np.int64)
    order = np.argsort(-sizes, kind="stable")
    ends = np.cumsum(sizes[order])
    at = 0
    while at < len(order):
        within = int(np.searchsorted(ends, TOKENS + (ends[at - 1] if at else 0), "right"))
        idx = order[at : max(at + 1, min(at + LANES, within))]
        width = len(idx) - np.searchsorted(sizes[idx][::-1], np.arange(sizes[idx[0]]), "right")
        bounds = np.concatenate(([0], np.cumsum(width)))
        flat = np.empty(bounds[-1], np.int32)
        for j, i in enumerate(idx):
            flat[bounds[: sizes[i]] + j] = seqs[i]
        yield idx, (flat, bounds)
        at += len(idx)


def spans(bounds: list[int]) -> list[tuple[int, int]]:
    """Runs of positions, first and past the last, of about SPAN symbols."""
    cuts = np.unique(np.searchsorted(bounds, np.arange(0, bounds[-1], SPAN))).tolist() + [len(bounds) - 1]
    return [(a, b) for a, b in zip(cuts[:-1], cuts[1:]) if a < b]


def forward(m: Hmm, grid: Grid) -> tuple[np.ndarray, np.ndarray, list[np.ndarray], np.ndarray, np.ndarray]:
    """Forward values by symbol of the grid, scaled at every EVERY-th position; by lane its last symbol and natural log likelihood.

    In between are emissions over the largest of their symbol, and one over
    the scale of each scaled position. With them a lane's sum shrinks, from one
    position to the next, at most by its least step, so EVERY of them stay far
    above the least double.
    """
    flat, bounds = grid[0], grid[1].tolist()
    top, ones = m.emit.max(1), np.ones(len(m.start))
    emit, alpha = m.emit / top[:, None], np.empty((len(flat), len(m.start)))
    inverse, logs = [], np.zeros(bounds[1])
    for first, past in spans(bounds):
        em = np.take(emit, flat[bounds[first] : bounds[past]], 0)
        for t in range(first, past):
            lo, hi = bounds[t], bounds[t + 1]
            now, at = alpha[lo:hi], lo - bounds[first]
            if t == 0:
                now[:] = m.start
            else:
                np.dot(alpha[bounds[t - 1] : bounds[t - 1] + hi - lo], m.step, out=now)  # lanes go by length
            now *= em[at : at + hi - lo]
            if t % EVERY == 0:
                scale = now @ ones
                logs[: hi - lo] += np.log(scale)
                inverse.append(np.reciprocal(scale))
                now *= inverse[-1][:, None]
    lane = np.arange(bounds[1])
    last = grid[1][np.searchsorted(-np.diff(grid[1]), -lane) - 1] + lane
    logs += np.log(alpha[last] @ ones)
    return alpha, emit, inverse, last, logs + np.bincount(np.arange(len(flat)) - np.repeat(grid[1][:-1], np.diff(grid[1])), np.log(top)[flat])


def likelihoods(m: Hmm, grid: Grid) -> np.ndarray:
    """Natural log likelihood per lane."""
    return forward(m, grid)[4]


def expected(m: Hmm, grid: Grid, counts: list) -> float:
    """Adds a grid's expected starts, steps and emissions to counts; returns its log likelihood."""
    flat, bounds = grid[0], grid[1].tolist()
    alpha, emit, inverse, last, logs = forward(m, grid)
    start, step, emissions = counts
    width, whole = np.diff(grid[1]), 1 / alpha[last].sum(1)
    moves, symbols, back = np.zeros_like(m.step), np.zeros(emissions.shape[::-1]), np.ascontiguousarray(m.step.T)
    ahead = alpha[:0]
    for first, past in reversed(spans(bounds)):
        lo, hi = bounds[first], bounds[past]
        em = np.take(emit, flat[lo:hi], 0)
        beta = np.empty_like(em)
        ends = (last >= lo) & (last < hi)
        beta[last[ends] - lo] = whole[ends, None]
        for t in range(past - 1, first - 1, -1):
            a, b = bounds[t] - lo, bounds[t + 1] - lo
            np.dot(ahead, back, out=beta[a : a + len(ahead)])  # the other lanes end here
            ahead = em[a:b]
            if t % EVERY == 0:
                ahead *= inverse[t // EVERY][:, None]
            ahead *= beta[a:b]
        t = max(first, 1)  # a step leads to each symbol but a lane's first
        before = np.arange(bounds[t], hi) - np.repeat(width[t - 1 : past - 1], width[t:past])
        moves += np.take(alpha, before, 0).T @ em[bounds[t] - lo :]
        which = flat[lo:hi].astype(np.intp)
        for z in range(len(m.start)):
            seen = alpha[lo:hi, z] * beta[:, z]
            symbols[z] += np.bincount(which, seen, len(emissions))
            if first == 0:
                start[z] += seen[: bounds[1]].sum()
    step += m.step * moves
    emissions += symbols.T
    return float(logs.sum())


def maximised(counts: list, share: np.ndarray, weight: float = 10.0) -> Hmm:
    """Parameters from expected counts, smoothed towards the symbols' overall shares."""
    start, step, emit = counts
    emit = emit + weight * share[:, None]
    return Hmm((start + 0.1) / (start + 0.1).sum(), (step + 0.1) / (step + 0.1).sum(1, keepdims=True), emit / emit.sum(0))


def symbols_of(words: list[bytes], table: dict, rare: int, end: int) -> np.ndarray:
    out = [table.get(w, rare) for w in words]
    out.append(end)
    return np.array(out, np.int32)


def words_of(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """What doc_words gives for each text, in a row, and the text of each word; without a Python object per word."""
    lists = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts, "")))
    found = lists.flatten()
    full = pc.greater(pc.binary_length(found), 0)  # blanks at the ends leave empty ones
    return found.filter(full).cast(pa.binary()), pc.list_parent_indices(lists).filter(full).to_numpy()


def counted(found: pa.Array, text: np.ndarray, rows: int) -> pa.ListArray:
    """One list of (w, n) per text: its different words and how often each occurs in it."""
    kinds = found.dictionary_encode()
    keys, n = np.unique(text * (len(kinds.dictionary) or 1) + kinds.indices.to_numpy(), return_counts=True)
    text, kind = np.divmod(keys, len(kinds.dictionary) or 1)
    ends = np.searchsorted(text, np.arange(rows + 1))
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays([kinds.dictionary.take(pa.array(kind)), pa.array(n, pa.int64())], names=["w", "n"]))


def zeros(n_symbols: int, states: int) -> list:
    return [np.zeros(states), np.zeros((states, states)), np.zeros((n_symbols, states))]


def sequences(symbols: np.ndarray, text: np.ndarray, rows: int, end: int) -> pa.Array:
    """Each text's symbols and the end as 32-bit integers."""
    n = np.bincount(text, minlength=rows) + 1
    ends = np.concatenate(([0], np.cumsum(n)))
    flat = np.full(ends[-1], end, np.int32)
    flat[np.arange(len(symbols)) + text] = symbols  # each earlier text has one end
    return pa.Array.from_buffers(pa.binary(), rows, [None, pa.py_buffer((4 * ends).astype(np.int32)), pa.py_buffer(flat)])


def trained(seqs: DataFrame, model: Hmm, share: np.ndarray, still: float) -> tuple[Hmm, list[float]]:
    """Baum-Welch over all sequences until a round lifts their log likelihood by at most `still` of it.

    Also gives the natural log likelihood that each round started from. With
    the smoothing, a round never lowers the smoothed likelihood, so the rounds
    end without a cap.
    """
    sc, states, size = seqs.sparkSession.sparkContext, len(model.start), len(share)
    seen: list[float] = []
    names = [f"x{z}" for z in range(states)]
    while True:
        shared = sc.broadcast(model)

        def e_step(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            m, c, ll = shared.value, zeros(size, states), 0.0
            for b in batches:
                for _, grid in lanes([np.frombuffer(s, np.int32) for s in b.column("s").to_pylist()]):
                    ll += expected(m, grid, c)
            x = np.vstack((*c, np.full(states, ll)))
            at = np.flatnonzero(x.any(1))
            yield pa.RecordBatch.from_arrays([pa.array(at), *(pa.array(x[at, z]) for z in range(states))], names=["i", *names])

        found = seqs.mapInArrow(e_step, ", ".join(["i long", *(f"{x} double" for x in names)])).groupBy("i").agg(*(F.sum(x).alias(x) for x in names)).toArrow()
        x = np.zeros((1 + states + size + 1, states))
        x[found.column("i").to_numpy()] = np.column_stack([found.column(z).to_numpy() for z in names])
        shared.destroy()
        model = maximised([x[0], x[1 : states + 1], x[states + 1 : -1]], share)
        seen.append(float(x[-1, 0]))
        if len(seen) > 1 and seen[-1] - seen[-2] <= still * abs(seen[-2]):
            return model, seen


def word_counts(texts: DataFrame) -> DataFrame:
    """(word, c) over all texts, counted per batch before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = pc.value_counts(pa.chunked_array([words_of(x.column("text"))[0] for x in pieces([b], TEXTS)], pa.binary()))
            yield pa.RecordBatch.from_arrays(found.flatten(), names=["word", "c"])

    return texts.select("text").mapInArrow(run, "word binary, c long").groupBy("word").agg(F.sum("c").alias("c"))


def near_words(counts: DataFrame, table: dict) -> dict:
    """Counts of the most frequent words beyond table: all with at least some count, NEAR_WORDS with table at most."""
    least, held = None, 0
    for r in counts.groupBy(F.least("c", F.lit(1 << 16)).alias("c")).agg(F.count("*").alias("n")).orderBy(F.desc("c")).collect():  # at most 2^16 counts
        held += r["n"]
        if held > NEAR_WORDS + len(table):
            break
        least = r["c"]
    found = counts.where(F.col("c") >= least).collect() if least else []
    return {w: c for w, c in ((bytes(r["word"]), r["c"]) for r in found) if w not in table}


def hmm_scores(docs: DataFrame, states: int = 6, most_words: int = 8192, sample_texts: int = 1500, sample_rounds: int = 10, still: float = 1e-5, add: float = 0.1, fold: int = 10) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) for every row of docs.

    Rows whose crc32(doc_id as text) mod fold is 0 are held out; all others
    train. A first guess of the states comes from sample_rounds rounds on at
    most sample_texts training texts; then rounds run over all training texts
    until one lifts their log likelihood by at most `still` of it. A null text is empty: its only token is the end. A null id counts as the empty
    text. Without training texts both scores follow add-0.1 smoothing with no
    counts. Other columns are ignored; an empty table gives none.
    """
    spark, scratch = docs.sparkSession, Scratch(docs.sparkSession, "hmm")
    sc = spark.sparkContext
    fold0 = held_out(F.col("doc_id"), fold) == 0
    rows = docs.select("doc_id", "text", fold0.alias("held_out"))
    train = rows.where(~F.col("held_out"))
    counts = scratch.save(word_counts(train))
    n_texts = train.count()
    sums = counts.agg(F.sum("c"), F.count("*")).first()
    total, kinds = (sums[0] or 0) + n_texts, sums[1] + (n_texts > 0)
    top = counts.orderBy(F.desc("c"), "word").limit(most_words).collect()
    table = {bytes(r["word"]): i for i, r in enumerate(top)}
    rare, end, size = len(table), len(table) + 1, len(table) + 2
    top_c = np.array([r["c"] for r in top] + [max(0, total - n_texts - sum(r["c"] for r in top)), n_texts], float)
    rare_kinds, rare_mass = max(0, sums[1] - len(top)), top_c[rare]
    share = (top_c + add) / (top_c + add).sum()
    seed = np.random.default_rng(0)
    h = id_hash(F.col("doc_id"), 40)  # texts beyond the bound never leave their task
    first = train.where(h < int(min(1.0, sample_texts / max(n_texts, 1)) * (1 << 40)) + (n_texts <= sample_texts)).select(h.alias("h"), "text").collect()
    first.sort(key=lambda r: (r["h"], r["text"] or ""))
    seqs = [symbols_of(doc_words(r["text"]), table, rare, end) for r in first]
    model = Hmm(np.full(states, 1 / states), np.full((states, states), 0.05 / states) + 0.95 * np.eye(states), share[:, None] * seed.uniform(0.5, 1.5, (size, states)))
    model = Hmm(model.start, model.step, model.emit / model.emit.sum(0))
    for _ in range(sample_rounds if seqs else 0):
        c = zeros(size, states)
        for _, grid in lanes(seqs):
            expected(model, grid, c)
        model = maximised(c, share)
    base_den = total + add * (kinds + 1)
    base_log, rare_den = np.log10((top_c + add) / base_den), rare_mass + add * (rare_kinds + 1)
    near = near_words(counts, table)
    near_c = np.array(list(near.values()), float) + add
    wide = sc.broadcast(pa.array([*table, *near], pa.binary()))  # most_words + NEAR_WORDS words
    wide_base = np.concatenate((base_log[:rare], np.log10(near_c / base_den), [0]))  # the last for all other words
    wide_inside = np.concatenate((np.zeros(rare), np.log10(near_c / rare_den), [0]))

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches, TEXTS):
            found, text = words_of(b.column("text"))
            code = pc.fill_null(pc.index_in(found, value_set=wide.value), -1).to_numpy()
            other, sums = code < 0, lambda x, text=text, n=b.num_rows: np.bincount(text, x, n).astype(float)  # whole numbers without words
            known = np.bincount(text[~other], minlength=b.num_rows) + (n_texts > 0)
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), b.column("held_out"), sequences(np.where(other | (code >= rare), rare, code), text, b.num_rows, end), pa.array(known), pa.array(base_log[end] + sums(wide_base[code])), pa.array(sums(wide_inside[code])), counted(found.filter(pa.array(other)), text[other], b.num_rows)],
                names=["doc_id", "held_out", "s", "known", "base", "inside", "others"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    done = rows.mapInArrow(coded, f"doc_id {kind}, held_out boolean, s binary, known long, base double, inside double, others array<struct<w:binary,n:long>>")
    done = scratch.save(done.withColumn("rid", F.monotonically_increasing_id()))  # nothing after it splits words again
    if seqs:
        model, _ = trained(done.where(~F.col("held_out")).select("s"), model, share, still)
    shared = sc.broadcast(model)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            seqs, ll = [np.frombuffer(s, np.int32) for s in b.column("s").to_pylist()], b.column("inside").to_numpy().copy()
            for idx, grid in lanes(seqs):
                ll[idx] += likelihoods(shared.value, grid) / np.log(10)
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in plain), pa.array([len(s) for s in seqs], pa.int64()), pa.array(ll)], names=[*plain, "n_tokens", "ll"])

    plain = ["rid", "doc_id", "held_out", "known", "base"]
    scored = done.select(*plain, "inside", "s").mapInArrow(score, f"rid long, doc_id {kind}, held_out boolean, known long, base double, n_tokens long, ll double")
    # words behind the shared symbol: none is frequent, so no key of this join is hot
    o = done.select("rid", F.explode("others").alias("o")).select("rid", F.col("o.w").alias("word"), F.col("o.n").alias("n"))
    o = small_join(o, counts, ["word"], "left").withColumn("c", F.coalesce("c", F.lit(0)))
    inside = F.log10((F.col("c") + add) / rare_den)
    o = o.groupBy("rid").agg(F.sum(F.when(F.col("c") > 0, F.col("n")).otherwise(0)).alias("k"), F.sum(F.col("n") * F.log10((F.col("c") + add) / base_den)).alias("b"), F.sum(F.col("n") * inside).alias("s"))
    more = lambda c: F.coalesce(F.col(c), F.lit(0))
    return scored.join(o, "rid", "left").select("doc_id", "held_out", "n_tokens", (F.col("known") + more("k")).cast("long").alias("n_known"), F.lit(total).cast("long").alias("train_tokens"), (F.col("base") + more("b")).alias("base_score"), (F.col("ll") + more("s")).alias("score"))


def op2_hmm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of every row of documents; see hmm_scores."""
    return hmm_scores(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
