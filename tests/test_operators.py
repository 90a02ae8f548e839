"""Operators that SQL can't express, edge cases, and readers and writers."""

import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from lattica import models
from lattica.functions import text as x
from lattica.operators import context, graph, index, relational, vector
from lattica.sources import readers, tables


def vectors(spark, n=120, d=8, seed=1):
    r = np.random.default_rng(seed)
    return spark.createDataFrame([(i, [float(v) for v in r.normal(size=d)]) for i in range(n)], "id long, embedding array<double>")


def two_cliques(spark):
    rows = [(b + i, b + j, 1) for b in (0, 10) for i in range(6) for j in range(i)] + [(0, 10, 1)]
    return spark.createDataFrame(rows, "src long, dst long, weight long")


def test_knn_leaves_out_null_queries_and_rows(spark):
    base = vectors(spark, 20).union(spark.createDataFrame([(99, None)], "id long, embedding array<double>"))
    found = vector.knn(base, base.withColumnRenamed("id", "qid"), 3).collect()
    assert len(found) == 60 and all(r.qid != 99 and r.id != 99 for r in found)


def test_knn_runs_block_by_block(spark, monkeypatch):
    base = vectors(spark, 40)
    q = base.withColumnRenamed("id", "qid")
    want = {tuple(r) for r in vector.knn(base, q, 4).select("qid", "id", "rank").collect()}
    monkeypatch.setattr(vector, "BLOCK", 7)
    assert {tuple(r) for r in vector.knn(base, q, 4).select("qid", "id", "rank").collect()} == want


@pytest.mark.parametrize("metric", sorted(set(vector.DISTANCES) - {"jensenshannon", "nan_euclidean"}))
def test_search_and_column_distance_agree(spark, metric):
    base = vectors(spark, 15).withColumn("embedding", F.transform("embedding", lambda v: F.abs(v)))
    found = vector.knn(base, base.where("id = 3").withColumnRenamed("id", "qid"), 15, metric)
    pairs = vector.pair_distances(base, found.select(F.col("qid").alias("a"), F.col("id").alias("b")), metric)
    assert all(abs(r.score - r.s2) < 1e-9 for r in found.join(pairs.withColumnRenamed("score", "s2"), (F.col("qid") == F.col("a")) & (F.col("id") == F.col("b"))).collect())


def test_indexes_find_most_neighbours(spark):
    base = vectors(spark, 300)
    q = base.where("id < 10").withColumnRenamed("id", "qid")
    truth = vector.knn(base, q, 5)
    for name, least in (("IVF8,R6", 0.7), ("PQ4,R8", 0.6), ("LSH", 0.3), ("L2norm,RR,Flat", 0.4), ("Flat", 1.0)):
        recall = vector.recall_at_k(index.factory(name)(base, q, 5), truth).agg(F.avg("recall")).first()[0]
        assert recall >= least, (name, recall)


def test_leiden_communities_are_connected_and_cover_all_nodes(spark):
    rows = graph.leiden(two_cliques(spark), 4).collect()
    top = {r.node: r.community for r in rows if r.level == 0}
    assert len(top) == 12 and {top[i] for i in range(6)} == {0} and {top[10 + i] for i in range(6)} == {10}


def test_scan_finds_cliques(spark):
    got = {r.node: r.cluster for r in graph.scan_clusters(two_cliques(spark), 0.7, 3).collect()}
    assert {got[i] for i in range(1, 6)} == {got[0]} and got[11] == got[15] != got[1]


def test_pagerank_sums_to_one_and_settles(spark):
    ranks = graph.pagerank(two_cliques(spark)).collect()
    assert abs(sum(r.rank for r in ranks) - 1) < 1e-6
    seeded = {r.node: r.rank for r in graph.pagerank(two_cliques(spark), spark.createDataFrame([(3,)], "node long")).collect()}
    assert max(seeded, key=seeded.get) == 3


def test_first_overflow_stays_closed_with_negative_costs(spark):
    rows = spark.createDataFrame([("g", i, c) for i, c in enumerate([5, 9, -8, 1])], "g string, i int, c int")
    assert [r.i for r in context.first_overflow(rows, "g", [F.asc("i")], "c", 10).collect()] == [0]


def test_bleu_and_rouge(spark):
    r = spark.range(1).select(x.bleu(F.lit("the cat sat"), F.lit("the cat sat")).alias("b"), x.rouge_l(F.lit("a b c d"), F.lit("a c d e")).alias("r"), x.rouge_l(F.lit(""), F.lit("a")).alias("z")).first()
    assert r.b == 1.0 and abs(r.r - 0.75) < 1e-9 and r.z == 0.0


def test_token_scores(spark):
    rows = spark.createDataFrame([(1, "the cat cat", "a cat sat"), (2, None, "x")], "k int, p string, a string")
    got = {r.k: r for r in x.token_scores(rows, "k", "p", "a").collect()}
    assert got[1].f1 == 0.5 and got[2].f1 == 0.0


def test_storage_cache_and_emitters(spark, tmp_path):
    df = spark.createDataFrame([(1, "a", [1]), (2, "b", [2])], "id int, text string, l array<int>")
    for memory in (False, True):
        s = tables.Storage(spark, f"file://{tmp_path}/s", memory).child("c")
        s.set("t", df)
        assert s.has("t") and s.get("t").count() == 2 and s.find("^t$") == ["t"] and s.get("u") is None
        cache = tables.Cache(s)
        known, new = cache.split(df, "text")
        assert (known.count(), new.count()) == (0, 2)
        cache.add(new.withColumn("value", F.lit("x")))
        assert [d.count() for d in cache.split(df, "text")] == [2, 0]
        s.delete("t")
        assert not s.has("t")
        s.clear()
        assert s.find(".") == []
    tables.emit(df, f"file://{tmp_path}", "out", ("parquet", "csv", "json"))
    assert spark.read.json(f"file://{tmp_path}/out.json").count() == 2 and spark.read.csv(f"file://{tmp_path}/out.csv", header=True).first().l
    tables.snapshot_rows(df, f"file://{tmp_path}", "rows", "text", "id")
    assert tables.graphml(df.select(F.col("id").alias("node")), df.select(F.col("id").alias("src"), F.col("id").alias("dst"))).count() == 4


def test_readers(spark, tmp_path):
    for name, body in (("a_1.txt", "hello"), ("b_2.txt", "world")):
        (tmp_path / "t").mkdir(exist_ok=True)
        (tmp_path / "t" / name).write_text(body)
    docs = readers.load_input(spark, f"file://{tmp_path}/t", "text", pattern=r"([ab])_(\d)\.txt$", groups=("kind", "year")).collect()
    assert {(d.title, d.text, d.kind, d.year) for d in docs} == {("a_1.txt", "hello", "a", "1"), ("b_2.txt", "world", "b", "2")} and len({d.id for d in docs}) == 2
    (tmp_path / "c.csv").write_text("body,at\nhi,2024-01-02 03:04:05\n")
    row = readers.read_csv(spark, f"file://{tmp_path}/c.csv", text="body", timestamp="at").first()
    assert (row.text, row.year, row.second) == ("hi", 2024, 5) and len(row.id) == 32
    v = np.arange(6, dtype="<f4").reshape(2, 3)
    (tmp_path / "v.fvecs").write_bytes(b"".join(np.int32(3).tobytes() + r.tobytes() for r in v))
    assert [r.embedding for r in readers.read_vectors(spark, f"file://{tmp_path}/v.fvecs").orderBy("id").collect()] == v.tolist()
    spark.createDataFrame([("e1", "A"), ("e2", "B")], "id string, title string").write.parquet(f"file://{tmp_path}/e")
    spark.createDataFrame([("A", "B"), ("A", "C")], "source string, target string").write.parquet(f"file://{tmp_path}/r")
    _, rel = readers.read_graph(spark, f"file://{tmp_path}/e", f"file://{tmp_path}/r")
    assert {(r.source, r.head_id, r.tail_id) for r in rel.collect()} == {("A", "e1", "e2"), ("A", "e1", None)}


def test_long_texts_are_embedded_at_length_one(spark):
    docs = spark.createDataFrame([(1, "a b c d e f"), (2, None)], "id int, text string")
    rows = models.embed_long_texts(docs, "id", "text", models.hash_embedder(8), 2).collect()
    assert len(rows) == 1 and abs(sum(v * v for v in rows[0].embedding) - 1) < 1e-9


def test_levels_and_selection(spark):
    alloc = relational.allocate_levels(spark.createDataFrame([(0, 1.0), (1, 1.0), (2, 1.0)], "level int, weight double"), 5).collect()
    assert sum(r.k for r in alloc) == 5
    with pytest.raises(ValueError):
        context.split_budget(100, 0.7, 0.5)
    assert context.split_budget(12000, 0.1, 0.5) == {"community": 1200, "text": 6000, "local": 4800}


def folded(costs, budget, most=None):
    """Batches one row after another, as the SQL has it."""
    batch, n, spent, out = 0, 0, 0.0, []
    for c in costs:
        c = float("nan") if c is None else float(c)
        over = n > 0 and ((most is not None and n + 1 > most) or spent + c > budget)
        batch, n, spent = (batch + 1, 1, c) if over else (batch, n + 1, spent + c)
        out.append(batch)
    return out


@pytest.mark.parametrize("most", [None, 3])
def test_batches_of_ranges_are_those_of_one_fold(spark, most):
    r = np.random.default_rng(5)
    kinds = {"a": r.integers(0, 9, 400), "b": np.where(r.random(300) < 0.7, 0, r.integers(0, 60, 300)), "c": [3, None, 4, 50, 2, 1, 9, 9], "d": [0, 40, 0, 0, 25], "e": r.integers(-5, 9, 60), None: [20, 20, 3]}
    rows = [(g, i, None if c is None else int(c)) for g, costs in kinds.items() for i, c in enumerate(costs)]
    df = spark.createDataFrame(rows, "g string, i int, c int")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "23")
    try:
        found = context.next_fit(df, "g", ["i"], "c", 20) if most is None else context.embedding_batches(df, "g", "i", "c", most, 20)
        got = {(x.g, x.i): x.batch for x in found.collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert got == {(g, i): b for g, costs in kinds.items() for i, b in enumerate(folded(costs, 20, most))}


def test_a_large_group_is_packed_in_time(spark):
    df = spark.range(150_000).select(F.lit("g").alias("g"), "id", (F.col("id") % 7).alias("c"))
    start = time.monotonic()
    batches = context.next_fit(df, "g", ["id"], "c", 20).agg(F.max("batch")).first()[0]
    assert batches == folded((i % 7 for i in range(150_000)), 20)[-1] and time.monotonic() - start < 40


@pytest.fixture
def small_ranges(spark):
    """Exchanges are merged by size, so that narrow and wide ones of the same rows are cut at other places."""
    how = {"spark.sql.adaptive.advisoryPartitionSizeInBytes": "64k", "spark.sql.adaptive.coalescePartitions.parallelismFirst": "false", "spark.sql.adaptive.coalescePartitions.minPartitionSize": "64k", "spark.sql.shuffle.partitions": "16"}
    was = {k: spark.conf.get(k) for k in how}
    for k, v in how.items():
        spark.conf.set(k, v)
    yield
    for k, v in was.items():
        spark.conf.set(k, v)


def test_index_numbers_wide_rows_in_order(spark, small_ranges):
    df = spark.range(4000).select(F.pmod(F.xxhash64("id"), F.lit(1000)).alias("n"), "id", F.array_join(F.transform(F.sequence(F.lit(1), F.lit(40)), lambda i: F.md5((i + F.col("id")).cast("string"))), "").alias("text"))
    got = [(r.n, r.id) for r in relational.gen_index(df, [F.col("n"), F.col("id")], "at").orderBy("at").collect()]
    assert len(got) == 4000 and got == sorted(got)
    assert {r["at"] for r in relational.gen_index(df, [F.col("n"), F.col("id")], "at").select("at").collect()} == set(range(1, 4001))


def test_quantiles_are_exact_over_ranges(spark, small_ranges):
    v = np.random.default_rng(3).normal(size=5001).round(2).tolist()
    df = spark.createDataFrame([(x,) for x in [*v, None, None]], "v double")
    got = relational.quantiles(df, "v", [0.0, 0.3, 0.5, 0.777, 1.0])
    assert "percentile" not in got._jdf.queryExecution().executedPlan().toString()  # it gathers all values in one task
    assert np.allclose(list(got.first()), np.quantile(v, [0.0, 0.3, 0.5, 0.777, 1.0]), atol=1e-12)
    assert list(relational.quantiles(df.where("v is null"), "v", [0.5]).first()) == [None]


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("metric", ["l2", "cosine", "ip", "l1"])
def test_blocks_of_queries_meet_ties_zeros_and_nans_in_one_plan(spark, monkeypatch, metric):
    r = np.random.default_rng(2)
    x = r.normal(size=(150, 6)).round(1)
    x[40:90], x[7], x[11] = x[3], 0.0, np.nan
    base = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, embedding array<float>")
    x = x.astype(np.float32).astype(float)
    monkeypatch.setattr(vector, "BLOCK", 40)
    monkeypatch.setattr(vector, "TILE", (16, 32))
    found = vector.knn(base, base.withColumnRenamed("id", "qid"), 9, metric)
    assert "Union" not in plan(found)
    down = metric in vector.SIMILARITIES
    for q, rows in enumerate(np.array_split(np.array([r.id for r in found.orderBy("qid", "rank").collect()]), 150)):
        with np.errstate(invalid="ignore"):
            s = ((x - x[q]) ** 2).sum(1) if metric == "l2" else np.abs(x - x[q]).sum(1) if metric == "l1" else (x * x[q]).sum(1)
            s = s / (np.sqrt((x * x).sum(1)) * np.sqrt((x[q] * x[q]).sum())) if metric == "cosine" else s
        assert rows.tolist() == np.lexsort((np.arange(150), np.where(np.isnan(s), np.inf, -s if down else s)))[:9].tolist(), q


def test_a_task_sends_no_more_than_the_cap(spark):
    base = vectors(spark, 300)
    found = vector._around(base, base.withColumnRenamed("id", "qid"), 1e6, "l2", 21)
    assert found.count() <= 21 * base.rdd.getNumPartitions()
    q = base.withColumnRenamed("id", "qid")
    every = sorted(r.score for r in vector.within_radius(base, q, 30.0).collect())
    got = sorted(r.score for r in vector.within_radius_capped(base, q, 30.0, 310).collect())
    assert len(got) == 310 and got == every[:310]
    assert vector.within_radius_capped(base, q, 30.0, 20).count() == 0 and vector.within_radius_capped(base, q, 1e-9, 300).count() == 300


def test_hamming_sends_k_rows_a_query_and_task(spark):
    codes = spark.range(500).select("id", F.xxhash64("id").alias("code"))
    found = vector.hamming_knn(codes, codes.where("id < 20").withColumnRenamed("id", "qid"), 4)
    assert "NestedLoopJoin" not in plan(found) and "CartesianProduct" not in plan(found)
    code = {r.id: r.code for r in codes.collect()}
    want = {(q, i, d, n + 1) for q in range(20) for n, (d, i) in enumerate(sorted((((code[q] ^ code[i]) & (2**64 - 1)).bit_count(), i) for i in code)[:4])}
    assert {(r.qid, r.id, r.distance, r["rank"]) for r in found.collect()} == want


def test_index_searches_send_no_pairs(spark):
    base = vectors(spark, 300)
    q = base.where("id < 10").withColumnRenamed("id", "qid")
    x = np.array([r.embedding for r in base.orderBy("id").collect()])
    planes = np.random.default_rng(1).normal(size=(4, 8, 8))
    keys = (np.einsum("tbd,nd->ntb", planes, x) > 0).tolist()
    found = index.lsh_search(base, q, 5)
    assert "Join" not in plan(found)  # pairs of a bucket were joined before they were scored
    s = (x @ x.T) / np.linalg.norm(x, axis=1) / np.linalg.norm(x, axis=1)[:, None]
    for i in range(10):
        near = [j for j in range(300) if any(a == b for a, b in zip(keys[i], keys[j]))]
        assert [r.id for r in found.where(F.col("qid") == i).orderBy("rank").collect()] == sorted(near, key=lambda j: (-s[i, j], j))[:5]
    cells = spark.createDataFrame([(i, x[i * 40].tolist()) for i in range(7)], "centroid int, embedding array<double>")
    d = ((x[:, None] - x[None, :280:40]) ** 2).sum(2)
    got = index.ivf_search(base, cells, q, 5, nprobe=2)
    for i in range(10):
        near = [j for j in range(300) if d[j].argmin() in d[i].argsort()[:2]]
        assert [r.id for r in got.where(F.col("qid") == i).orderBy("rank").collect()] == sorted(near, key=lambda j: (((x[i] - x[j]) ** 2).sum(), j))[:5]
    books = index.pq_train(base, 4)
    assert plan(index.pq_search(base, books, q, 5, 3)).count("MapInPandas") == 0


def test_kmeans_moves_centres_without_a_row_per_component(spark, monkeypatch):
    base, seen = vectors(spark, 200, d=4), []
    keep = index.saved
    monkeypatch.setattr(index, "saved", lambda df: seen.append(plan(df)) or keep(df))
    got = {r.centroid: r.embedding for r in index.kmeans(base, 3, rounds=2).collect()}
    assert len(got) == 3 and not any("posexplode" in p for p in seen)
    x = np.array([r.embedding for r in base.orderBy("id").collect()])
    first = sorted(r.id for r in relational.sample_rows(base, 3, "id", 1234).collect())
    c = x[first]
    for _ in range(2):
        of = ((x[:, None] - c[None]) ** 2).sum(2).argmin(1)
        c = np.stack([x[of == j].mean(0) for j in range(3)])
    assert np.allclose([got[j] for j in range(3)], c)
