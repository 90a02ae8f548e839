"""Vector searches, codes and clusterings."""

from __future__ import annotations

from pyspark.sql import functions as F

from lattica import models
from lattica.operators import metrics, vector as v
from lattica.queries.registry import query

_V = "v AS (SELECT vec_id AS id, label AS level, embedding::DOUBLE[] AS x FROM embeddings WHERE embedding IS NOT NULL), q AS (SELECT * FROM v WHERE id % 50 = 0)"


def base(t):
    return t("embeddings").select(F.col("vec_id").alias("id"), F.col("label").alias("level"), "embedding")


def asked(t):
    return base(t).where("id % 50 = 0").select(F.col("id").alias("qid"), "embedding")


def _zip(f: str) -> str:
    return f"list_sum(list_transform(list_zip(q.x, b.x), lambda z: {f}))"


SCORES = {
    "l1": (_zip("abs(z[1] - z[2])"), ""),
    "linf": ("list_max(list_transform(list_zip(q.x, b.x), lambda z: abs(z[1] - z[2])))", ""),
    "lp": (_zip("abs(z[1] - z[2]) ** 3"), ""),
    "canberra": (_zip("CASE WHEN z[1] = 0 AND z[2] = 0 THEN 0 ELSE abs(z[1] - z[2]) / (abs(z[1]) + abs(z[2])) END"), ""),
    "braycurtis": (f"{_zip('abs(z[1] - z[2])')} / {_zip('abs(z[1] + z[2])')}", ""),
    "abs_ip": (_zip("abs(z[1] * z[2])"), ""),
}


def _top(score: str, order: str, k: int = 10, where: str = "true") -> str:
    return f"WITH {_V}, s AS (SELECT q.id AS qid, b.id, {score} AS score FROM q JOIN v b ON {where}), r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score {order}, id)::INT AS rank FROM s) SELECT qid, id, rank, round(score, 4) AS score FROM r WHERE rank <= {k}"


def _shown(df):
    return df.withColumn("score", F.round("score", 4))


def _register(metric: str, score: str, order: str) -> None:
    @query(f"knn_{metric}", _top(score, order))
    def _(t):
        return _shown(v.knn(base(t), asked(t), 10, metric)).select("qid", "id", "rank", "score")


for _metric, (_score, _order) in SCORES.items():
    _register(_metric, _score, _order)


def _positive(df, column="embedding"):
    return df.withColumn(column, F.transform(column, lambda x: F.abs(x.cast("double")) + 0.01))


_POS = "v AS (SELECT vec_id AS id, list_transform(embedding, lambda y: abs(y::DOUBLE) + 0.01) AS x FROM embeddings), q AS (SELECT * FROM v WHERE id % 50 = 0)"


@query("knn_jaccard_minmax", _top(f"{_zip('least(z[1], z[2])')} / {_zip('greatest(z[1], z[2])')}", "DESC").replace(_V, _POS))
def _(t):
    return _shown(v.knn(_positive(base(t)), _positive(asked(t)), 10, "jaccard")).select("qid", "id", "rank", "score")


@query("knn_jensenshannon", _top("0.5 * " + _zip("-z[1] * ln((z[1] + z[2]) / 2 / z[1]) - z[2] * ln((z[1] + z[2]) / 2 / z[2])"), "").replace(_V, _POS))
def _(t):
    return _shown(v.knn(_positive(base(t)), _positive(asked(t)), 10, "jensenshannon")).select("qid", "id", "rank", "score")


@query("level_knn_merge", f"WITH {_V}, s AS (SELECT q.id AS qid, b.level, b.id, list_distance(q.x, b.x) ** 2 AS score FROM q JOIN v b ON true), r AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY qid, level ORDER BY score, id) <= 5) SELECT qid, level, id, round(score, 4) AS score, row_number() OVER (PARTITION BY qid ORDER BY score, level, id)::INT AS place FROM r QUALIFY place <= 15")
def _(t):
    return _shown(v.merge_levels(v.level_knn(base(t), asked(t), 5), 15)).select("qid", "level", "id", "score", "place")


@query("range_search_l2", f"WITH {_V} SELECT q.id AS qid, b.id, round(list_distance(q.x, b.x) ** 2, 4) AS score FROM q JOIN v b ON list_distance(q.x, b.x) ** 2 < 1.5")
def _(t):
    return _shown(v.within_radius(base(t), asked(t), 1.5))


@query("range_search_ip", f"WITH {_V} SELECT q.id AS qid, b.id, round(list_inner_product(q.x, b.x), 4) AS score FROM q JOIN v b ON list_inner_product(q.x, b.x) > 0.25")
def _(t):
    return _shown(v.within_radius(base(t), asked(t), 0.25, "ip"))


@query("range_search_capped", f"WITH {_V}, s AS (SELECT q.id AS qid, b.id, list_distance(q.x, b.x) ** 2 AS score FROM q JOIN v b ON list_distance(q.x, b.x) ** 2 < 2.5), c AS (SELECT score FROM s ORDER BY score LIMIT 101) SELECT qid, id, round(score, 4) AS score FROM s WHERE (SELECT count(*) FROM c) <= 100 OR score < (SELECT max(score) FROM c)")
def _(t):
    return _shown(v.within_radius_capped(base(t), asked(t), 2.5, 100))


@query("knn_selector_filter", _top("list_distance(q.x, b.x) ** 2", "", 5, "b.id % 3 = 1 AND b.id < 400"))
def _(t):
    return _shown(v.knn_selected(base(t), asked(t), 5, lambda c: (c % 3 == 1) & (c < 400))).select("qid", "id", "rank", "score")


@query("knn_id_subset", _top("list_cosine_similarity(q.x, b.x)", "DESC", 5, "b.id IN (SELECT doc_id FROM labels)"))
def _(t):
    return _shown(v.knn_subset(base(t), t("labels").select(F.col("doc_id").alias("id")), asked(t), 5, "cosine")).select("qid", "id", "rank", "score")


@query("pairwise_distances", f"WITH {_V} SELECT a.id AS a, b.id AS b, round(list_distance(a.x, b.x) ** 2, 4) AS score FROM v a JOIN v b ON b.id = a.id + 1")
def _(t):
    return _shown(v.pair_distances(base(t), base(t).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))))


@query("vector_norms", f"WITH {_V} SELECT id, round(sqrt(list_inner_product(x, x)), 5) AS norm, round(x[1] / sqrt(list_inner_product(x, x)), 5) AS first FROM v")
def _(t):
    return base(t).select("id", F.round(v.norm(F.col("embedding")), 5).alias("norm"), F.round(v.normalised(F.col("embedding"))[0], 5).alias("first"))


_C = "u AS (SELECT level, unnest(x) AS y, unnest(range(64)) AS i FROM v), w AS (SELECT level, i, avg(y) AS y FROM u GROUP BY ALL), c AS (SELECT level AS centroid, list(y ORDER BY i) AS x FROM w GROUP BY level)"


@query("nearest_centroid_assign", f"WITH {_V}, {_C} SELECT id, centroid, round(list_distance(v.x, c.x) ** 2, 5) AS score FROM v JOIN c ON true QUALIFY row_number() OVER (PARTITION BY id ORDER BY list_distance(v.x, c.x) ** 2, centroid) = 1")
def _(t):
    b = base(t)
    return v.assign(b, v.centroids(b, "level")).withColumn("score", F.round("score", 5))


@query("centroid_similarity", f"WITH {_V}, {_C} SELECT level AS cluster, count(*) AS n, round(avg(list_cosine_similarity(v.x, c.x)), 6) AS similarity FROM v JOIN c ON v.level = c.centroid GROUP BY level")
def _(t):
    return metrics.centroid_similarity(base(t).withColumnRenamed("level", "cluster")).withColumn("similarity", F.round("similarity", 6))


@query("nearest_to_mean", f"WITH {_V}, u AS (SELECT unnest(x) AS y, unnest(range(64)) AS i FROM v), m AS (SELECT list(y ORDER BY i) AS m FROM (SELECT i, avg(y) AS y FROM u GROUP BY i)) SELECT id, round(list_distance(x, m) ** 2, 5) AS score FROM v, m ORDER BY list_distance(x, m) ** 2, id LIMIT 12")
def _(t):
    return v.nearest_to_mean(base(t), 12).withColumn("score", F.round("score", 5))


@query("weighted_mean_vectors", f"WITH {_V}, u AS (SELECT level, id + 1 AS w, unnest(x) AS y, unnest(range(64)) AS i FROM v), w AS (SELECT level, i, sum(w * y) / sum(w) AS y FROM u GROUP BY ALL), c AS (SELECT level, list(y ORDER BY i) AS x FROM w GROUP BY level) SELECT level, round(x[1] / sqrt(list_inner_product(x, x)), 6) AS first FROM c")
def _(t):
    m = v.weighted_mean(base(t).withColumn("w", F.col("id") + 1).select("level", "w", "embedding"), "level", "w")
    return m.select("level", F.round(F.col("embedding")[0], 6).alias("first"))


@query("similarity_include_exclude", f"WITH {_V}, s AS (SELECT q.id AS qid, b.id, list_cosine_similarity(q.x, b.x) AS s FROM q JOIN v b ON true), r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY s DESC, id)::INT AS rank FROM s) SELECT qid, id, rank FROM r WHERE rank <= 10 AND id NOT IN (0, 1, 7, 8) UNION ALL SELECT id, 7, -2 FROM q UNION ALL SELECT id, 8, -1 FROM q")
def _(t):
    return v.search_by_similarity(base(t), asked(t), 5, [7, 8], [0, 1])


_BITS = "c AS (SELECT id, list_sum(list_transform(range(1, 64), lambda i: CASE WHEN x[i] > 0 THEN (1::HUGEINT << (i - 1)) ELSE 0::HUGEINT END))::BIGINT AS code FROM v)"


def _codes(t):
    from lattica.functions.text import sign_bits

    return base(t).where("embedding is not null").select("id", sign_bits(F.col("embedding")).alias("code"))


@query("hamming_topk", f"WITH {_V}, {_BITS} SELECT q.id AS qid, b.id, bit_count(xor(q.code, b.code))::INT AS distance, row_number() OVER (PARTITION BY q.id ORDER BY bit_count(xor(q.code, b.code)), b.id)::INT AS rank FROM c q JOIN c b ON q.id % 50 = 0 QUALIFY rank <= 10")
def _(t):
    c = _codes(t)
    return v.hamming_knn(c, c.where("id % 50 = 0").withColumnRenamed("id", "qid"), 10)


@query("hamming_range", f"WITH {_V}, {_BITS} SELECT q.id AS qid, b.id, bit_count(xor(q.code, b.code))::INT AS distance FROM c q JOIN c b ON q.id % 50 = 0 AND bit_count(xor(q.code, b.code)) <= 18")
def _(t):
    c = _codes(t)
    return v.hamming_within(c, c.where("id % 50 = 0").withColumnRenamed("id", "qid"), 18)


@query("hamming_counts", f"WITH {_V}, {_BITS} SELECT q.id AS qid, count(*) AS n FROM c q JOIN c b ON q.id % 50 = 0 AND bit_count(xor(q.code, b.code)) <= 25 GROUP BY 1")
def _(t):
    c = _codes(t)
    return v.hamming_count(c, c.where("id % 50 = 0").withColumnRenamed("id", "qid"), 25)


@query("index_merge_remove", "SELECT 1000 + vec_id AS id, label AS level FROM embeddings WHERE vec_id % 2 = 0 AND vec_id NOT IN (SELECT doc_id FROM labels) UNION ALL SELECT vec_id, label FROM embeddings WHERE vec_id % 2 = 1 AND vec_id NOT IN (SELECT doc_id FROM labels)")
def _(t):
    b, gone = base(t), t("labels").select(F.col("doc_id").alias("id"))
    kept = v.without_ids(b, gone).select("id", "level")
    even, odd = kept.where("id % 2 = 0"), kept.where("id % 2 = 1")
    return v.merged(v.with_ids(even, even.select("id", (F.col("id") + 1000).alias("external"))), odd).select("id", "level")


@query("reconstruct_vectors", "SELECT doc_id AS id, label AS level FROM labels LEFT JOIN embeddings ON vec_id = doc_id")
def _(t):
    return v.reconstruct(base(t), t("labels").select(F.col("doc_id").alias("id"))).select("id", "level")


@query("scalar_quantised", f"WITH {_V}, u AS (SELECT id, unnest(x) AS y, unnest(range(64)) AS i FROM v), b AS (SELECT i, min(y) AS lo, max(y) AS hi FROM u GROUP BY i), k AS (SELECT id, i, CASE WHEN hi > lo THEN floor((y - lo) / (hi - lo) * 255 + 0.5) ELSE 0 END::INT AS c FROM u JOIN b USING (i)) SELECT id, list(c ORDER BY i) AS codes FROM k GROUP BY id")
def _(t):
    return v.scalar_encode(base(t))


@query("recall_per_query", f"WITH {_V}, s AS (SELECT q.id AS qid, b.id, row_number() OVER (PARTITION BY q.id ORDER BY list_distance(q.x, b.x), b.id) AS r1, row_number() OVER (PARTITION BY q.id ORDER BY list_inner_product(q.x, b.x) DESC, b.id) AS r2 FROM q JOIN v b ON true) SELECT qid, count(*) FILTER (WHERE r2 <= 10) / 10.0::DOUBLE AS recall FROM s WHERE r1 <= 10 GROUP BY qid")
def _(t):
    return v.recall_at_k(v.knn(base(t), asked(t), 10, "ip"), v.knn(base(t), asked(t), 10))


@query("result_agreement", f"WITH {_V}, s AS (SELECT q.id AS qid, b.id, row_number() OVER (PARTITION BY q.id ORDER BY list_distance(q.x, b.x), b.id) AS r1, row_number() OVER (PARTITION BY q.id ORDER BY list_inner_product(q.x, b.x) DESC, b.id) AS r2 FROM q JOIN v b ON true) SELECT count(*) FILTER (WHERE r1 <= 10 AND r2 <= 10) / count(*) FILTER (WHERE r1 <= 10)::DOUBLE AS agreement FROM s")
def _(t):
    return v.result_agreement(v.knn(base(t), asked(t), 10), v.knn(base(t), asked(t), 10, "ip"))


@query("range_precision_recall", f"WITH {_V}, s AS (SELECT list_distance(q.x, b.x) ** 2 < 1.7 AS f, list_inner_product(q.x, b.x) > 0.2 AS t FROM q JOIN v b ON true) SELECT count(*) FILTER (WHERE f AND t) / count(*) FILTER (WHERE f)::DOUBLE AS precision, count(*) FILTER (WHERE f AND t) / count(*) FILTER (WHERE t)::DOUBLE AS recall FROM s")
def _(t):
    return v.range_precision_recall(v.within_radius(base(t), asked(t), 1.7), v.within_radius(base(t), asked(t), 0.2, "ip"))


@query("cluster_validity", f"""WITH {_V}, {_C}, n AS (SELECT level, count(*) AS n FROM v GROUP BY 1), g AS (SELECT list(y ORDER BY i) AS m FROM (SELECT i, avg(y) AS y FROM u GROUP BY i)),
d AS (SELECT level, sum(list_distance(v.x, c.x) ** 2) AS w, avg(list_distance(v.x, c.x)) AS s FROM v JOIN c ON level = centroid GROUP BY level),
f AS (SELECT c.*, n, w, s, n * list_distance(c.x, m) ** 2 AS b FROM c JOIN n ON c.centroid = n.level JOIN d ON c.centroid = d.level, g),
k AS (SELECT a.centroid, max((a.s + z.s) / list_distance(a.x, z.x)) AS r FROM f a JOIN f z ON a.centroid <> z.centroid GROUP BY 1)
SELECT sum(n)::BIGINT AS n, count(*) AS clusters, round((sum(b) / (count(*) - 1)) / (sum(w) / (sum(n) - count(*))), 5) AS calinski_harabasz, (SELECT round(avg(r), 5) FROM k) AS davies_bouldin FROM f""")
def _(t):
    s = metrics.cluster_scores(base(t).withColumnRenamed("level", "cluster"))
    return s.withColumns({c: F.round(c, 5) for c in ("calinski_harabasz", "davies_bouldin")})


@query("silhouette_score", f"WITH {_V}, {_C}, d AS (SELECT id, level = centroid AS own, list_distance(v.x, c.x) AS d FROM v JOIN c ON true), p AS (SELECT id, min(d) FILTER (WHERE own) AS a, min(d) FILTER (WHERE NOT own) AS b FROM d GROUP BY id) SELECT round(avg((b - a) / greatest(a, b)), 6) AS silhouette FROM p")
def _(t):
    return metrics.simplified_silhouette(base(t).withColumnRenamed("level", "cluster")).select(F.round("silhouette", 6).alias("silhouette"))


@query("hash_embeddings")
def _(t):
    e = models.embed_items(t("part").withColumn("name", F.col("p_name")), ["name", "p_type"], models.hash_embedder(16))
    return e.select("p_partkey", F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x).alias("tokens"))


@query("kmeans_ivf")
def _(t):
    from lattica.operators.index import ivf_search, kmeans

    b = base(t)
    return ivf_search(b, kmeans(b, 8, rounds=4), asked(t), 10, nprobe=3)


@query("pq_refine")
def _(t):
    from lattica.operators.index import pq_search, pq_train

    b = base(t)
    return pq_search(b, pq_train(b, 8, 16), asked(t), 10, refine=4)


@query("pca_vectors")
def _(t):
    from lattica.operators.index import pca

    return pca(base(t), 4)


@query("lsh_candidates")
def _(t):
    from lattica.operators.index import lsh_search

    return lsh_search(base(t), asked(t), 10, bits=6, tables=8)
