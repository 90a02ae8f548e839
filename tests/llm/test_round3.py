"""What near-duplicate operators send and save."""

import random

import numpy as np

from lattica.llm import common, jaccard, pivots


def saved_by(monkeypatch):
    """The tables saved from now on, with the plans that made them."""
    found, save = [], common.Scratch.save

    def kept(self, df):
        found.append((df.columns, df._jdf.queryExecution().optimizedPlan().toString(), out := save(self, df)))
        return out

    monkeypatch.setattr(common.Scratch, "save", kept)
    monkeypatch.setattr(common.Scratch, "drop", lambda self, *tables: None)
    return found


def test_pivots_compare_gives_a_link_once(spark, monkeypatch):
    r = np.random.default_rng(7)
    base = r.normal(size=(40, 16))
    x = np.concatenate([base, *(base[:8] + r.normal(0, s, (8, 16)) for s in (0.03, 0.1, 0.2, 0.3))])
    unit = pivots.unit(x)
    near = (unit @ unit.T >= 0.9) & ~np.eye(len(x), dtype=bool)
    saved = saved_by(monkeypatch)
    got = {y.vec_id: y.n_links for y in pivots.near_vectors(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>"), depth=20).collect()}
    assert got == dict(enumerate(near.sum(1).tolist())) and near.sum() > 60
    plan, links = next((p, t) for c, p, t in saved if c == ["a", "b"])
    assert plan.startswith("MapInArrow")  # and no distinct of what each common key repeats
    assert links.count() == links.distinct().count() == near.sum() // 2


def test_jaccard_verifies_a_round_in_one_statement(spark, monkeypatch):
    r = random.Random(8)
    base = [[f"w{r.randrange(200)}" for _ in range(r.randint(30, 60))] for _ in range(12)]
    rows = []
    for i in range(70):
        w = list(base[i % 12])
        for _ in range(r.randrange(4)):
            w[r.randrange(len(w))] = f"e{r.randrange(999)}"
        rows.append((i, " ".join(w)))
    sets = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in (t.split() for _, t in rows)]
    low = list(range(70))
    for b in range(70):
        for a in range(b):
            if 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                p, q = sorted((low[a], low[b]))
                low = [p if v == q else v for v in low]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for most in (jaccard.BROADCAST_ROWS, 0):  # pairs that may be broadcast, and pairs that may not
        monkeypatch.setattr(jaccard, "BROADCAST_ROWS", most)
        with monkeypatch.context() as m:
            saved = saved_by(m)
            got = {x.doc_id: x.component_id for x in jaccard.jaccard_classes(docs).collect()}
        assert got == dict(enumerate(low))
        assert sum(c == ["a", "b"] for c, _, _ in saved) <= 2 * (jaccard.HUB_ROUNDS + 1) and not any(c == ["a", "b", "i"] for c, _, _ in saved)


def test_jaccard_tries_a_pair_of_chance_once(spark, monkeypatch):
    r = random.Random(9)
    rows = []
    for i in range(0, 80, 2):  # two texts share a passage, and now and then a text has a near copy
        passage = [f"p{i}x{k}" for k in range(14)]
        rows += [(i + j, " ".join([f"w{i + j}x{k}" for k in range(r.randint(40, 50))] + passage)) for j in (0, 1)]
    rows += [(100 + i, rows[i][1] + " end") for i in range(0, 80, 9)]
    monkeypatch.setattr(jaccard, "shared_marks", lambda sets, scratch: np.zeros(1 << (jaccard.MAP_BITS - 3), np.uint8))  # as if the two stood in different runs
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for most in (jaccard.BROADCAST_ROWS, 0):
        monkeypatch.setattr(jaccard, "BROADCAST_ROWS", most)
        with monkeypatch.context() as m:
            saved = saved_by(m)
            got = {x.doc_id: x.component_id for x in jaccard.jaccard_classes(docs).collect()}
        assert got == {i: i - 100 if i >= 100 else i for i, _ in rows}
        lists = [t for c, _, t in saved if "hubs" in c]
        pairs = [t.count() for c, _, t in saved if c == ["a", "b"]]
        assert lists[0].count() > 0 and all(t.count() == 0 for t in lists[1:])  # all of their rows were hubs
        assert pairs == [9, 9, 0, 0]  # those that sketches allow, and the links; then no list is left
