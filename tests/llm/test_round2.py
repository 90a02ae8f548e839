"""Held-out quality, edge cases and planted cases of the training-data operators and the pipeline."""

import random

import pytest

from lattica.llm import charlm, common, decontaminate, jaccard, langid, mixing, render, secrets, sharding, toxicity

DOCS = "doc_id long, text string, lang string, source string"


def prose(r, vocab, n):
    return " ".join(r.choice(vocab) for _ in range(n))


def test_toxicity_finds_held_out_toxic_texts(spark):
    r = random.Random(1)
    vocab = ["".join(r.choice("abcdeinorst") for _ in range(r.randint(2, 7))) for _ in range(300)]
    rows = [(i, prose(r, vocab, r.randint(20, 120)) + (" vile rotten scumbag" if i % 4 == 0 else "")) for i in range(400)]
    docs = spark.createDataFrame(rows + [(900, None), (901, "")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i, _ in rows], "doc_id long, toxic int")
    model = toxicity.trained_on(docs, labels)
    assert model.slope > 0  # more likely under the toxic model counts as more toxic
    got = {x.doc_id: x for x in toxicity.score_rows(docs, model).collect()}
    assert len(got) == 402 and all(0 <= x.score <= 1 for x in got.values()) and got[900].score == got[901].score
    wrong = sum(got[i].predicted != int(i % 4 == 0) for i, _ in rows)
    assert wrong <= 8


def test_toxicity_without_labels_scores_zero(spark):
    docs = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    model = toxicity.trained_on(docs, spark.createDataFrame([], "doc_id long, toxic int"))
    assert [x.score for x in toxicity.score_rows(docs, model).collect()] == [0.0]


def test_languages_by_script_and_letters(spark):
    r = random.Random(2)
    kinds = {"ja": "のはをにがたでてとし日本", "ko": "가나다라마바사아자차카하", "zh": "的一是不了人我在有他这中", "en": "etaoinshrdlu"}
    rows = [(i, "".join(r.choice(a) if r.random() < 0.8 else " " for _ in range(80)), lang) for i, (lang, a) in enumerate(list(kinds.items()) * 40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, label string")
    got = {x.doc_id: x.lang_pred for x in langid.identify(docs, langid.train(docs)).collect()}
    assert sum(got[i] == lang for i, _, lang in rows) >= 0.98 * len(rows)


@pytest.mark.parametrize("rows", [[], [(1, "text", None), (2, None, None)]])
def test_languages_without_labels_are_und(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string, label string")
    assert {x.lang_pred for x in langid.identify(docs, langid.train(docs)).collect()} <= {"und"}


def test_short_items_and_repeats_leak(spark):
    docs = [(1, "say alpha beta gamma delta now", "", ""), (1, "alpha beta gamma delta", "", ""), (2, "alpha beta gamma", "", ""), (3, "", "", ""), (None, "x alpha BETA gamma delta", "", "")]
    found = decontaminate.leaks(spark.createDataFrame(docs, DOCS), spark.createDataFrame([(7, "alpha beta gamma delta"), (7, "alpha beta gamma delta"), (8, None)], "item_id long, text string")).collect()
    assert sorted((x.doc_id or 0, x.item_id, x.start) for x in found) == [(0, 7, 1), (1, 7, 0), (1, 7, 1)]


def test_leaks_against_brute_force(spark):
    r = random.Random(5)
    items = [(i, [f"v{r.randrange(400)}" for _ in range(r.choice([12, 25, 40]))]) for i in range(12)]
    docs = []
    for i in range(60):
        w = list(r.choice(items)[1])
        for _ in range(r.randrange(5)):
            w[r.randrange(len(w))] = f"e{r.randrange(99)}"
        docs.append((i, [f"n{r.randrange(900)}" for _ in range(r.randrange(30))] + w + ["z"] * 3))
    grams = lambda w: [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    want = set()
    for d, w in docs:
        for i, x in items:
            a, b = grams(w), grams(x)
            for s in range(len(a) - len(b) + 1):
                same = sum(min(b.count(g), a[s : s + len(b)].count(g)) for g in set(b))
                if 100 * same >= 75 * (2 * len(b) - same):
                    want.add((d, i))
    found = decontaminate.leaks(spark.createDataFrame([(d, " ".join(w), "", "") for d, w in docs], DOCS), spark.createDataFrame([(i, " ".join(x)) for i, x in items], "item_id long, text string"))
    assert {(x.doc_id, x.item_id) for x in found.collect()} == want


@pytest.mark.parametrize(
    "html, text",
    [
        ("<table><tbody><div>lost?</div><tr><td>z", "lost?\nz"),
        ("<table><tr>stray<td>z</table>", "stray\nz"),
        ("<div style='visibility:hidden'>no<b style='visibility:visible'>yes</b></div>", "yes"),
        ("<table><tr><td rowspan=2>A<td>b<tr><td>c</table>", "A  b\n   c"),
        ("<table><tr><form><td>a</td></form></tr></table>", "a"),
        ("<table><tbody><td>a<td>b", "a  b"),
        ("<head><title>t</title>shown<p>x", "shown\n\nx"),
        ("<table><tr><td colspan=" + "9" * 5000 + ">w", "w"),
        ("<ol start=" + "7" * 5000 + "><li>q", "777777777. q"),
    ],
)
def test_rendering_keeps_visible_text(html, text):
    assert render.render(html) == text


def test_rendering_survives_deep_pages(spark):
    assert "deep" in render.render("<table><tr><td>" * 400 + "deep") and render.render("<div>" * 20_000 + "x") == "x"
    pages = spark.createDataFrame([(None, "<p>a"), (1, None)], "page_id long, html string").selectExpr("*", "1 as text")
    assert {(x.page_id, x.text) for x in render.extract_text(pages).collect()} == {(None, "a"), (1, "")}
    assert render.extract_text(pages.limit(0)).count() == 0


def test_equal_texts_share_a_shard_and_slots_have_no_gaps(spark):
    r = random.Random(3)
    texts = [prose(r, ["a", "bb", "ccc"], r.randint(1, 40)) for _ in range(60)]
    docs = spark.createDataFrame([(i % 50, r.choice(texts), None, f"s{i % 7}") for i in range(600)] + [(None, None, None, None)], DOCS)
    rows = sharding.kd_shards(docs).collect()
    shards, slots = {}, {}
    for x in rows:
        shards.setdefault((x.text_crc32, x.size), set()).add(x.shard)
        slots.setdefault(x.shard, []).append(x.slot)
    assert len(rows) == 601 and all(len(s) == 1 for s in shards.values()) and all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_secrets_keep_base_spans_in_null_empty_and_long_texts(spark):
    text = "note\n" * 3000 + 'api_key = "Zx81kQp9Lm2"\n' + "0123456789abcdef" * 2
    docs = spark.createDataFrame([(1, None), (2, ""), (3, text), (3, text)], "doc_id long, text string").selectExpr("*", "'x' as spans")
    rows = secrets.scan(docs, secrets.train(docs)).collect()
    assert sorted((x.doc_id, x.n_assign, x.n_hex) for x in rows) == [(1, 0, 0), (2, 0, 0), (3, 1, 1), (3, 1, 1)]
    empty = docs.limit(0)
    assert secrets.scan(empty, secrets.train(empty)).count() == 0


def test_lines_that_stay_outside_are_told_without_decoding():
    r = random.Random(4)
    m = secrets.Crf(*(secrets.np.zeros((1 << secrets.BITS, 3)) for _ in range(4)), secrets.np.zeros((secrets.FILES, 3)), secrets.np.zeros((3, 3)), secrets.np.array([0.0, -20.0, 0.0]))
    rng = secrets.np.random.default_rng(1)
    for x in (m.own, m.before, m.after, m.before2):
        x += rng.normal(0, 0.4, x.shape)
    m.step += rng.normal(0, 0.5, (3, 3))
    m.step[secrets.O, secrets.I] = -20.0
    m.own[:, secrets.O] += 0.8
    tagger = secrets.Tagger(m)
    for _ in range(200):
        line = " ".join(r.choice(["ab", "C9d", "x", "=", "77"]) for _ in range(r.randint(1, 6)))
        own, near = (secrets.np.array(x) for x in zip(*(secrets.traits(t) for t in secrets.TOKEN.findall(line))))
        tags = tagger.best(secrets.emissions(m, own, near, secrets.file_kind(line)))
        assert bool(tagger.spans(line)) == bool((tags == secrets.B).any())


def test_components_that_do_not_settle_are_an_error(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(50)], "a long, b long")
    with pytest.raises(RuntimeError):
        common.components(spark, edges, common.Scratch(spark, "t"), most_rounds=1)


def test_jaccard_of_a_loose_group_and_repeated_ids(spark):
    r = random.Random(6)
    base = [f"w{i}" for i in range(60)]
    rows = []
    for i in range(80):
        w = list(base)
        for _ in range(r.randrange(4)):
            w[r.randrange(60)] = f"e{r.randrange(1000)}"
        rows.append((i // 2, " ".join(w)))
    sets = [set(tuple(t.split()[i : i + 5]) for i in range(56)) for _, t in rows]
    root = list(range(80))
    for a in range(80):
        for b in range(a):
            if 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                x, y = root[a], root[b]
                root = [min(x, y) if v in (x, y) else v for v in root]
    low = {c: min(rows[i][0] for i in range(80) if root[i] == c) for c in set(root)}
    got = sorted((x.doc_id, x.component_id) for x in jaccard.jaccard_classes(spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as c")).collect())
    assert got == sorted((rows[i][0], low[root[i]]) for i in range(80))


def test_mix_with_ties_and_clashing_columns(spark):
    docs = spark.createDataFrame([(1, "a b", "s"), (1, "a b", "s"), (2, None, None), (3, "c", "")], "doc_id long, text string, source string").selectExpr("*", "9 as size", "9 as h", "9 as key")
    rows = mixing.mix(docs).collect()
    assert len(rows) == 4 and {x.h for x in rows} == {9} and {x.size for x in rows} == {2, 0, 1}


def test_pipeline_stages_by_row(spark, tmp_path):
    pipeline = pytest.importorskip("corpus_pipeline")
    words = [f"w{i}" for i in range(30)]
    a, b = " ".join(words), " ".join(reversed(words))
    docs = spark.createDataFrame([(1, a, "x", "s", 1), (5, a, "x", "s", 2), (5, b, "x", "s", 3), (None, a, "x", "s", 4), (6, None, "x", None, 5), (7, "", "x", "s", 6)], DOCS + ", key int").selectExpr("*", "key as row", "key as copies")
    path = f"file://{tmp_path}/docs"
    docs.coalesce(1).write.parquet(path)
    docs = spark.read.parquet(path)
    spark.createDataFrame([(0, b + " more")], "item_id long, text string").write.parquet(f"file://{tmp_path}/benchmark.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"file://{tmp_path}/labels.parquet")
    kept = {name: sorted(x.key for x in stage(spark, docs, f"file://{tmp_path}").collect()) for name, stage in pipeline.STAGES[:3]}
    assert kept == {"toxicity": [1, 2, 3, 4, 5, 6], "ngram_jaccard": [1, 3, 5, 6], "decontaminate": [1, 2, 4, 5, 6]}
    mixed = pipeline.STAGES[3][1](spark, docs, "")
    assert mixed.columns == docs.columns and {5, 6} <= {x.key for x in mixed.collect()}
    assert pipeline.STAGES[4][1](spark, docs, "").count() == 6
    for _, stage in pipeline.STAGES:
        assert stage(spark, docs.limit(0), f"file://{tmp_path}").count() == 0


def test_alphabet_keeps_scripts_apart():
    ids = charlm.alphabet_of(["abc"])
    assert ids[ord("の")] != ids[ord("가")] and ids[ord("a")] < charlm.OTHER and ids[ord("!")] == charlm.SPACE


def test_few_links_take_few_statements_and_many_the_rounds(spark, monkeypatch):
    r = random.Random(11)
    links = [(r.randrange(300), r.randrange(300)) for _ in range(200)] + [(i, i + 1) for i in range(1000, 1100)] + [(-7, 5)]
    want = {x: x for p in links for x in p}
    for _ in range(120):
        for a, b in links:
            want[a] = want[b] = min(want[a], want[b])
    scratch = common.Scratch(spark, "few")
    table = scratch.save(spark.createDataFrame(links, "a long, b long"))
    before = scratch.n
    got = common.components_of_few(spark, table, scratch)
    assert scratch.n == before  # the rounds would save a table each
    assert {x.id: x.component for x in got.collect()} == want
    monkeypatch.setattr(common, "DRIVER_LINKS", 10)
    far = {x.id: x.component for x in common.components_of_few(spark, table, scratch).collect()}
    assert scratch.n > before and all(far.get(x, x) == want[x] for x in want)
