"""Quality of clusterings and of retrieval."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lattica.functions.text import normalise_answer
from lattica.operators.vector import centroids, distance


def cluster_scores(points: DataFrame) -> DataFrame:
    """(n, clusters, calinski_harabasz, davies_bouldin) of (id, embedding, cluster), from sums and centroids alone."""
    usable = points.where("embedding is not null and cluster is not null")
    c = centroids(usable, "cluster").toDF("cluster", "c", "n")
    whole = centroids(usable.withColumn("__all", F.lit(0)), "__all").select(F.col("embedding").alias("m"))
    own = usable.join(F.broadcast(c), "cluster").withColumn("d", distance("embedding", "c"))
    spread = own.groupBy("cluster").agg(F.sum("d").alias("within"), F.avg(F.sqrt("d")).alias("s"))
    parts = c.join(spread, "cluster").crossJoin(F.broadcast(whole)).withColumn("between", F.col("n") * distance("c", "m"))
    sums = parts.agg(F.sum("n").alias("n"), F.count("*").alias("clusters"), F.sum("between").alias("b"), F.sum("within").alias("w"))
    # clusters are few: every one is compared with every other
    a, b = parts.select(F.col("cluster").alias("x"), F.col("c").alias("cx"), F.col("s").alias("sx")), parts.select(F.col("cluster").alias("y"), F.col("c").alias("cy"), F.col("s").alias("sy"))
    worst = a.join(F.broadcast(b), F.col("x") != F.col("y")).groupBy("x").agg(F.max((F.col("sx") + F.col("sy")) / F.sqrt(distance("cx", "cy"))).alias("r"))
    ratio = (F.col("b") / (F.col("clusters") - 1)) / (F.col("w") / (F.col("n") - F.col("clusters")))
    return sums.crossJoin(worst.agg(F.avg("r").alias("davies_bouldin"))).select("n", "clusters", ratio.alias("calinski_harabasz"), "davies_bouldin")


def simplified_silhouette(points: DataFrame) -> DataFrame:
    """(silhouette) with distances to centroids in place of all pairs: mean of (b - a) / max(a, b)."""
    usable = points.where("embedding is not null and cluster is not null")
    c = F.broadcast(centroids(usable, "cluster").select(F.col("centroid").alias("o"), F.col("embedding").alias("c")))
    d = usable.select("id", "cluster", "embedding").crossJoin(c).select("id", (F.col("o") == F.col("cluster")).alias("own"), F.sqrt(distance("embedding", "c")).alias("d"))
    ab = d.groupBy("id").agg(F.min(F.when(F.col("own"), F.col("d"))).alias("a"), F.min(F.when(~F.col("own"), F.col("d"))).alias("b"))
    return ab.agg(F.avg((F.col("b") - F.col("a")) / F.greatest("a", "b")).alias("silhouette"))


def centroid_similarity(points: DataFrame) -> DataFrame:
    """(cluster, n, similarity): mean cosine of members to their centroid."""
    c = F.broadcast(centroids(points, "cluster").select(F.col("centroid").alias("cluster"), F.col("embedding").alias("c")))
    return points.where("embedding is not null").join(c, "cluster").groupBy("cluster").agg(F.count("*").alias("n"), F.avg(distance("embedding", "c", "cosine")).alias("similarity"))


def edge_entropy(edges: DataFrame, members: DataFrame) -> DataFrame:
    """(community, edges, entropy): entropy of the community's share of all edges within communities."""
    a, b = (members.select(F.col("node").alias(x), F.col("community").alias(f"{x}_c")) for x in ("src", "dst"))
    inner = edges.join(a, "src").join(b, "dst").where("src_c = dst_c").groupBy(F.col("src_c").alias("community")).agg(F.count("*").alias("edges"))
    total = F.broadcast(inner.agg(F.sum("edges").alias("t")))
    p = F.col("edges") / F.col("t")
    return inner.crossJoin(total).select("community", "edges", (-p * F.log(p)).alias("entropy"))


def answer_coverage(text: Column, answers: Column) -> Column:
    """Whether a normalised answer stands in the normalised text."""
    t = normalise_answer(text)
    return F.exists(answers, lambda a: t.contains(normalise_answer(a)))


def sweep(parameters: list[dict], run, score) -> list[tuple[dict, float]]:
    """Runs an operator for each of a few parameter sets; (parameters, score), best first."""
    return sorted(((p, float(score(run(**p)).first()[0])) for p in parameters), key=lambda x: -x[1])
