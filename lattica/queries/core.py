"""Queries of the graph-retrieval operators, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lattica.operators.context import reduce_context
from lattica.operators.graph import canonical_edges, combined_degree, degrees
from lattica.operators.vector import knn


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    # parts are numbered below 0, so that they don't meet suppliers
    return canonical_edges(table(spark, sf_dir, "lineitem").select("l_suppkey", (-F.col("l_partkey")).alias("part")), "l_suppkey", "part")


def _knn(metric: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        base = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "embedding")
        return knn(base, base.where("id % 50 = 0").withColumnRenamed("id", "qid"), 10, metric).select("qid", "id", "rank", F.round("score", 4).alias("score"))

    return run


def antijoin_unlabelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", "lang", "source").join(table(spark, sf_dir, "labels").select("doc_id"), "doc_id", "left_anti")


def timestamp_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = {p: getattr(F, p)("ts").cast("int") for p in ("year", "month", "hour", "minute", "second")}
    return table(spark, sf_dir, "events").select("event_id", *(c.alias(p) for p, c in parts.items()), F.dayofmonth("ts").cast("int").alias("day"))


def reduce_context_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", "source", "n_chars", "lang"), "doc_id")
    return reduce_context(rows, "source", "lang", "quality", "doc_id", 20_000, "n_chars").select("source", "doc_id", "quality", "n_chars", "spent")


QUERIES = {
    "graph_edges_canonical": _edges,
    "node_degree": lambda spark, sf_dir: degrees(_edges(spark, sf_dir)),
    "combined_degree_rank": lambda spark, sf_dir: combined_degree(_edges(spark, sf_dir)).select("src", "dst", "rank"),
    "knn_l2_topk": _knn("l2"),
    "knn_cosine_topk": _knn("cosine"),
    "knn_ip_topk": _knn("ip"),
    "antijoin_unlabelled": antijoin_unlabelled,
    "timestamp_parts": timestamp_parts,
    "reduce_context_budget": reduce_context_budget,
}

_EDGES = "SELECT least(l_suppkey, -l_partkey) AS src, greatest(l_suppkey, -l_partkey) AS dst, count(*) AS weight FROM lineitem WHERE l_suppkey <> -l_partkey GROUP BY ALL"
_DEGREES = f"e AS ({_EDGES}), d AS (SELECT node, count(*) AS degree, sum(weight)::BIGINT AS strength FROM (SELECT src AS node, weight FROM e UNION ALL SELECT dst, weight FROM e) GROUP BY node)"


def _knn_sql(score: str, order: str) -> str:
    return f"""WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS x FROM embeddings WHERE embedding IS NOT NULL),
s AS (SELECT q.vec_id AS qid, b.vec_id AS id, {score} AS score FROM v q JOIN v b ON q.vec_id % 50 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score {order}, id)::INT AS rank FROM s)
SELECT qid, id, rank, round(score, 4) AS score FROM r WHERE rank <= 10"""


ORACLES = {
    "graph_edges_canonical": _EDGES,
    "node_degree": f"WITH {_DEGREES} SELECT node, degree, strength FROM d",
    "combined_degree_rank": f"WITH {_DEGREES} SELECT src, dst, a.degree + b.degree AS rank FROM e JOIN d a ON src = a.node JOIN d b ON dst = b.node",
    "knn_l2_topk": _knn_sql("list_distance(q.x, b.x) ** 2", ""),
    "knn_cosine_topk": _knn_sql("list_cosine_similarity(q.x, b.x)", "DESC"),
    "knn_ip_topk": _knn_sql("list_inner_product(q.x, b.x)", "DESC"),
    "antijoin_unlabelled": "SELECT doc_id, lang, source FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)",
    "timestamp_parts": "SELECT event_id, year(ts)::INT AS year, month(ts)::INT AS month, day(ts)::INT AS day, hour(ts)::INT AS hour, minute(ts)::INT AS minute, second(ts)::INT AS second FROM events",
    "reduce_context_budget": "SELECT * FROM (SELECT source, doc_id, quality, n_chars, sum(n_chars) OVER (PARTITION BY source ORDER BY quality DESC, doc_id ROWS UNBOUNDED PRECEDING)::BIGINT AS spent FROM labels JOIN documents USING (doc_id) WHERE quality > 0 AND lang IS NOT NULL) WHERE spent <= 20000",
}
