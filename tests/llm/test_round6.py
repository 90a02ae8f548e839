"""What a round of op2's training costs, and that it still is exact."""

import tracemalloc

import numpy as np
import pyarrow as pa
import pytest

from lattica.llm import hmm
from lattica.llm.common import doc_words


def summed(x, axis):
    top = x.max(axis, keepdims=True)
    return (top + np.log(np.exp(x - top).sum(axis, keepdims=True))).squeeze(axis)


def by_logs(m, seq):
    """Log likelihood and expected counts of one sequence, position by position in logarithms."""
    step, em = np.log(m.step), np.log(m.emit)[seq]
    alpha, beta = [np.log(m.start) + em[0]], [np.zeros(len(m.start))]
    for e in em[1:]:
        alpha.append(summed(alpha[-1][:, None] + step, 0) + e)
    for e in em[:0:-1]:
        beta.insert(0, summed(step + e + beta[0], 1))
    ll, counts = summed(alpha[-1], 0), hmm.zeros(*m.emit.shape)
    for t, s in enumerate(seq):
        counts[2][s] += np.exp(alpha[t] + beta[t] - ll)
        if t:
            counts[1] += np.exp(alpha[t - 1][:, None] + step + em[t] + beta[t] - ll)
    counts[0] += np.exp(alpha[0] + beta[0] - ll)
    return ll, counts


@pytest.mark.parametrize("least", [0.1, 1e-12])
def test_expected_counts_equal_those_by_logarithms(monkeypatch, least):
    monkeypatch.setattr(hmm, "SPAN", 40)
    r = np.random.default_rng(3)
    emit = np.where(np.arange(12)[:, None] % 3 == np.arange(3), 1.0, least) * r.uniform(0.5, 1.5, (12, 3))
    step = np.eye(3) + least  # symbols of another state at each position: nearly every step is a rare one
    m = hmm.Hmm(np.full(3, 1 / 3), step / step.sum(1, keepdims=True), emit / emit.sum(0))
    seqs = [r.integers(0, 12, n).astype(np.int32) for n in (1, 1, 2, 15, 16, 17, 33, 90, 90, 260)] + [np.arange(200, dtype=np.int32) % 12]
    got, want, ll = hmm.zeros(12, 3), hmm.zeros(12, 3), 0.0
    for idx, grid in hmm.lanes(seqs):
        ll += hmm.expected(m, grid, got)
        assert np.allclose(hmm.likelihoods(m, grid), [by_logs(m, seqs[i])[0] for i in idx], rtol=1e-9)
    for s in seqs:
        x, c = by_logs(m, s)
        ll -= x
        for a, b in zip(want, c):
            a += b
    assert abs(ll) < 1e-6 and all(np.allclose(a, b, rtol=1e-6, atol=1e-9) for a, b in zip(got, want))


def test_a_symbol_costs_a_double_a_state(monkeypatch):
    monkeypatch.setattr(hmm, "TOKENS", 1 << 19)
    r = np.random.default_rng(7)
    seqs = [r.integers(0, 22, 1000).astype(np.int32) for _ in range(500)]
    guess = r.uniform(0.5, 1.5, (22, 6))
    model, counts = hmm.Hmm(np.full(6, 1 / 6), np.full((6, 6), 1 / 6), guess / guess.sum(0)), hmm.zeros(22, 6)
    ((_, grid),) = hmm.lanes(seqs)
    tracemalloc.start()
    hmm.expected(model, grid, counts)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert counts[2].sum() == pytest.approx(500_000) and peak < 45_000_000  # a double a state is 24 MB


def test_words_are_split_to_count_and_to_code_only(spark, monkeypatch):
    texts = [f"Alpha beta{i % 7} gamma{i} alpha" for i in range(60)] + [None, ""]
    saved, save = [], hmm.Scratch.save
    monkeypatch.setattr(hmm.Scratch, "save", lambda self, df: saved.append(df._jdf.queryExecution().optimizedPlan().toString()) or save(self, df))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    scores = hmm.hmm_scores(docs, states=2, most_words=5, sample_rounds=1, still=1.0)
    assert sum("text" in plan for plan in saved) == 2, saved
    assert scores.count() == len(texts)


def test_texts_without_words(spark):
    docs = spark.createDataFrame([(i, None if i % 2 else " ") for i in range(20)], "doc_id long, text string")
    got = hmm.hmm_scores(docs, sample_rounds=1, still=1.0).collect()
    assert len(got) == 20 and all((r.n_tokens, r.n_known) == (1, 1) and r.score == pytest.approx(r.base_score, abs=0.01) for r in got)


def test_words_by_arrow_equal_doc_words():
    texts = ["".join(f"x{chr(i)}" for i in range(128)), None, "", " \t\n", "  Ünder ÄB\x85c d E \x1cf  ", "one", "a a B a"]
    for batch in (pa.array(texts), pa.array(["left out", *texts])[1:], pa.array([], pa.string())):
        found, text = hmm.words_of(batch)
        want = [(i, w) for i, t in enumerate(batch.to_pylist()) for w in doc_words(t)]
        assert list(zip(text.tolist(), found.to_pylist())) == want
        lists = hmm.counted(found, text, len(batch)).to_pylist()
        assert [sum(x["n"] for x in row) for row in lists] == [len(doc_words(t)) for t in batch.to_pylist()]
        assert [{x["w"] for x in row} for row in lists] == [set(doc_words(t)) for t in batch.to_pylist()]
        coded = hmm.sequences(np.arange(len(found)), text, len(batch), -1).to_pylist()
        assert [np.frombuffer(s, np.int32).tolist() for s in coded] == [[j for j, (k, _) in enumerate(want) if k == i] + [-1] for i in range(len(batch))]
