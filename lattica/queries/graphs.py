"""Graph operators over a supplier-part graph and a graph of near vectors."""

from __future__ import annotations

from pyspark.sql import functions as F

from lattica.operators import graph as g
from lattica.operators import metrics
from lattica.queries.registry import query

# suppliers meet parts of a few orders; parts are numbered below 0
_E = "e AS MATERIALIZED (SELECT least(l_suppkey, -l_partkey) AS src, greatest(l_suppkey, -l_partkey) AS dst, count(*) AS weight FROM lineitem WHERE l_partkey <= 120 GROUP BY ALL), b AS MATERIALIZED (SELECT src AS node, dst AS other, weight FROM e UNION ALL SELECT dst, src, weight FROM e)"


def edges(t):
    li = t("lineitem").where("l_partkey <= 120").select("l_suppkey", (-F.col("l_partkey")).alias("part"))
    return g.canonical_edges(li, "l_suppkey", "part")


@query("last_edge_attributes", "SELECT least(l_suppkey, -l_partkey) AS src, greatest(l_suppkey, -l_partkey) AS dst, l_quantity FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_suppkey, l_partkey ORDER BY l_orderkey DESC, l_linenumber DESC) = 1")
def _(t):
    li = t("lineitem").select(F.col("l_suppkey").alias("src"), (-F.col("l_partkey")).alias("dst"), "l_quantity", "l_orderkey", "l_linenumber")
    return g.last_edges(li, "src", "dst", [F.col("l_orderkey"), F.col("l_linenumber")]).select("src", "dst", "l_quantity")


@query("edge_rank_with_nodes", f"WITH {_E}, d AS (SELECT node, count(*) AS degree FROM b WHERE node < 0 GROUP BY node) SELECT src, dst, coalesce(x.degree, 0) + coalesce(y.degree, 0) AS rank FROM e LEFT JOIN d x ON src = x.node LEFT JOIN d y ON dst = y.node")
def _(t):
    e = edges(t)
    return g.combined_degree(e, g.degrees(e).where("node < 0").select("node", "degree")).select("src", "dst", "rank")


@query("mean_degree", f"WITH {_E} SELECT floor(avg(n))::BIGINT AS degree FROM (SELECT node, count(*) AS n FROM b GROUP BY node)")
def _(t):
    return g.mean_degree(edges(t))


@query("merge_graph_nodes", "SELECT p_brand AS title, arg_max(p_name, p_partkey) AS name, arg_min(p_type, p_partkey) AS kind, array_to_string(list_sort(list(DISTINCT p_size::VARCHAR)), ',') AS sizes, sum(p_size)::BIGINT AS total, round(avg(p_retailprice), 4) AS price, max(p_partkey) AS most FROM part GROUP BY p_brand")
def _(t):
    p = t("part").select(F.col("p_brand").alias("title"), F.col("p_name").alias("name"), F.col("p_type").alias("kind"), F.col("p_size").alias("sizes"), F.col("p_size").alias("total"), F.col("p_retailprice").alias("price"), F.col("p_partkey").alias("most"), "p_partkey")
    how = {"name": "replace", "kind": "skip", "sizes": "concat", "total": "sum", "price": "average", "most": "max"}
    return g.merge_graphs(p, p.select(F.col("title").alias("src"), F.col("title").alias("dst"), "p_partkey"), "p_partkey", how, {})[0].withColumn("price", F.round("price", 4))


@query("merge_graph_edges", "SELECT least(l_suppkey, l_partkey) AS src, greatest(l_suppkey, l_partkey) AS dst, sum(l_quantity) AS weight, max(l_orderkey) AS last, min(l_orderkey) AS first FROM lineitem GROUP BY ALL")
def _(t):
    li = t("lineitem").select(F.col("l_suppkey").alias("src"), F.col("l_partkey").alias("dst"), F.col("l_quantity").alias("weight"), F.col("l_orderkey").alias("last"), F.col("l_orderkey").alias("first"))
    return g.merge_graphs(li.select(F.col("src").alias("title")), li, "last", {}, {"weight": "sum", "last": "max", "first": "min"})[1]


@query("graph_unpacked", f"WITH {_E} SELECT node, 0.0::DOUBLE AS x, 0.0::DOUBLE AS y FROM (SELECT DISTINCT node FROM b)")
def _(t):
    e = edges(t)
    return g.zero_layout(g.unpack(g.nodes_of(e), e, "nodes"))


def chosen(t):
    return t("part").where("p_partkey % 4 = 0").select((-F.col("p_partkey")).alias("node")).union(t("supplier").where("s_suppkey % 3 = 0").select("s_suppkey"))


_IN = "n AS (SELECT -p_partkey AS node FROM part WHERE p_partkey % 4 = 0 UNION SELECT s_suppkey FROM supplier WHERE s_suppkey % 3 = 0)"


@query("in_network_edges", f"WITH {_E}, {_IN} SELECT src, dst, weight FROM e WHERE src IN (FROM n) AND dst IN (FROM n)")
def _(t):
    return g.in_network(edges(t), chosen(t))


_OUT = f"{_E}, {_IN}, o AS (SELECT src, dst, weight, CASE WHEN src IN (FROM n) THEN src ELSE dst END AS inside, CASE WHEN src IN (FROM n) THEN dst ELSE src END AS outside FROM e WHERE (src IN (FROM n)) <> (dst IN (FROM n))), l AS (SELECT outside, count(DISTINCT inside) AS links FROM o GROUP BY 1)"


@query("out_network_links", f"WITH {_OUT} SELECT * FROM l")
def _(t):
    return g.out_network_links(edges(t), chosen(t))


@query("out_network_budget", f"WITH {_OUT} SELECT src, dst, links, weight FROM o JOIN l USING (outside) ORDER BY links DESC, weight DESC, src, dst LIMIT 2 * (SELECT count(*) FROM n)")
def _(t):
    return g.out_network_budget(edges(t), chosen(t), 2).select("src", "dst", "links", "weight")


_COMM = "c AS (SELECT node, CASE WHEN node < 0 THEN -node % 7 ELSE node % 5 END AS community FROM (SELECT DISTINCT node FROM b))"


def communities(t):
    n = g.nodes_of(edges(t))
    return n.withColumn("community", F.when(F.col("node") < 0, -F.col("node") % 7).otherwise(F.col("node") % 5))


@query("contract_communities", f"WITH {_E}, {_COMM} SELECT least(x.community, y.community) AS src, greatest(x.community, y.community) AS dst, count(*) AS weight FROM e JOIN c x ON src = x.node JOIN c y ON dst = y.node WHERE x.community <> y.community GROUP BY 1, 2")
def _(t):
    return g.contract(edges(t), communities(t))


@query("community_member_union", f"WITH {_E}, {_COMM} SELECT community // 3 AS community, list_sort(list(DISTINCT node)) AS members FROM c GROUP BY 1")
def _(t):
    m = communities(t)
    return g.union_members(m.select(F.floor(F.col("community") / 3).alias("parent"), F.col("community").alias("child")).distinct(), m)


@query("clustering_entropy", f"WITH {_E}, {_COMM}, i AS (SELECT x.community, count(*) AS edges FROM e JOIN c x ON src = x.node JOIN c y ON dst = y.node AND x.community = y.community GROUP BY 1) SELECT community, edges, round(-edges / sum(edges) OVER () * ln(edges / sum(edges) OVER ()), 6) AS entropy FROM i")
def _(t):
    return metrics.edge_entropy(edges(t), communities(t)).withColumn("entropy", F.round("entropy", 6))


@query("scan_similarity", f"WITH {_E}, d AS (SELECT node, count(*) AS d FROM b GROUP BY node) SELECT src, dst, round((2 + (SELECT count(*) FROM b x JOIN b y ON x.other = y.other WHERE x.node = src AND y.node = dst)) / sqrt((p.d + 1.0) * (q.d + 1.0)), 6) AS similarity FROM e JOIN d p ON src = p.node JOIN d q ON dst = q.node")
def _(t):
    return g.scan_similarity(edges(t)).withColumn("similarity", F.round("similarity", 6))


@query("scan_weighted_similarity", f"WITH {_E}, f AS (SELECT node, other, weight::DOUBLE AS w FROM b UNION ALL SELECT DISTINCT node, node, 1.0 FROM b), s AS (SELECT node, sum(w) AS t FROM f GROUP BY node), l AS (SELECT src, dst, sum(least(x.w, y.w)) AS low FROM e JOIN f x ON src = x.node JOIN f y ON dst = y.node AND x.other = y.other GROUP BY 1, 2) SELECT e.src, e.dst, round(coalesce(low, 0) / (p.t + q.t - coalesce(low, 0)), 6) AS similarity FROM e LEFT JOIN l USING (src, dst) JOIN s p ON e.src = p.node JOIN s q ON e.dst = q.node")
def _(t):
    return g.scan_weighted(edges(t)).withColumn("similarity", F.round("similarity", 6))


def _near(t):
    """A graph of vectors: two are joined if their ids differ by 1 or 7 and labels agree in parity."""
    v = t("embeddings").select(F.col("vec_id").alias("src"), "label")
    pairs = v.withColumn("dst", F.explode(F.array(F.col("src") + 1, F.col("src") + 7)))
    return pairs.join(t("embeddings").select(F.col("vec_id").alias("dst"), F.col("label").alias("l2")), "dst").where("label % 2 = l2 % 2").select("src", "dst", F.lit(1).cast("long").alias("weight"))


_NEAR = "e AS MATERIALIZED (SELECT a.vec_id AS src, z.vec_id AS dst, 1 AS weight FROM embeddings a JOIN embeddings z ON z.vec_id - a.vec_id IN (1, 7) AND a.label % 2 = z.label % 2), b AS MATERIALIZED (SELECT src AS node, dst AS other, weight FROM e UNION ALL SELECT dst, src, weight FROM e)"


@query("graph_components", f"WITH RECURSIVE {_NEAR}, r AS (SELECT DISTINCT node, node AS low FROM b UNION SELECT b.other, r.low FROM r JOIN b USING (node) WHERE r.low < b.other) SELECT node, min(low) AS component FROM r GROUP BY node")
def _(t):
    return g.components(_near(t))


@query("largest_component", f"WITH RECURSIVE {_NEAR}, r AS (SELECT DISTINCT node, node AS low FROM b UNION SELECT b.other, r.low FROM r JOIN b USING (node) WHERE r.low < b.other), c AS (SELECT node, min(low) AS c FROM r GROUP BY node), m AS (SELECT c FROM c GROUP BY c ORDER BY count(*) DESC, c LIMIT 1) SELECT src, dst, weight FROM e WHERE src IN (SELECT node FROM c WHERE c = (SELECT c FROM m))")
def _(t):
    return g.largest_component(_near(t))


def _rounds(n: int, seeded: bool) -> str:
    p = "p AS (SELECT node, sum(weight) AS o, CASE WHEN node % 40 = 0 THEN 1.0 / sum(CASE WHEN node % 40 = 0 THEN 1 ELSE 0 END) OVER () ELSE 0 END AS p FROM b GROUP BY node)" if seeded else "p AS (SELECT node, sum(weight) AS o, 1.0 / count(*) OVER () AS p FROM b GROUP BY node)"
    steps = [p, "r0 AS (SELECT node, 1.0 / count(*) OVER () AS rank FROM p)"]
    for i in range(n):
        steps.append(f"s{i} AS (SELECT other AS node, sum(rank * weight / o) AS x FROM b JOIN p USING (node) JOIN r{i} USING (node) GROUP BY other), r{i + 1} AS MATERIALIZED (SELECT p.node, 0.85::DOUBLE * coalesce(x, 0) + 0.15::DOUBLE * p AS rank FROM p LEFT JOIN s{i} USING (node))")
    return f"WITH {_NEAR}, " + ", ".join(steps).replace("1.0 /", "1.0::DOUBLE /") + f" SELECT node, round(rank, 9) AS rank FROM r{n}"


@query("pagerank_fixed_iters", _rounds(6, False))
def _(t):
    return g.pagerank(_near(t), rounds=6, tolerance=0).withColumn("rank", F.round("rank", 9))


@query("personalised_pagerank", _rounds(6, True))
def _(t):
    e = _near(t)
    return g.pagerank(e, g.nodes_of(e).where("node % 40 = 0"), rounds=6, tolerance=0).withColumn("rank", F.round("rank", 9))


_W = "v AS (SELECT vec_id AS id, embedding::DOUBLE[] AS x FROM embeddings)"


@query("augment_graph_edges", f"""WITH {_NEAR}, {_W}, o AS MATERIALIZED (SELECT src, dst, list_cosine_similarity(a.x, z.x) AS w FROM e JOIN v a ON src = a.id JOIN v z ON dst = z.id),
t AS (SELECT quantile_cont(w, 0.7) AS wx, (SELECT floor(avg(n))::INT FROM (SELECT count(*) AS n FROM b GROUP BY node)) AS m FROM o),
k AS (SELECT q.id AS node, z.id AS other, list_cosine_similarity(q.x, z.x) AS w, row_number() OVER (PARTITION BY q.id ORDER BY list_distance(q.x, z.x) ** 2, z.id) AS r FROM v q JOIN v z ON true),
f AS (SELECT node, other, w FROM k, t WHERE r <= (1.5 * m)::INT + 1 - (CASE WHEN (1.5 * m) <> floor(1.5 * m) THEN 1 ELSE 0 END) AND node <> other AND w > wx AND (node, other) NOT IN (SELECT (node, other) FROM b)),
h AS (SELECT * FROM f, t QUALIFY row_number() OVER (PARTITION BY node ORDER BY w DESC, other) <= m)
SELECT src, dst, round(w, 6) AS weight FROM o UNION ALL SELECT least(node, other), greatest(node, other), round(max(w), 6) FROM h GROUP BY 1, 2""")
def _(t):
    nodes = t("embeddings").select(F.col("vec_id").alias("id"), "embedding")
    return g.augment(_near(t), nodes, 0.7).withColumn("weight", F.round("weight", 6))


@query("leiden_communities")
def _(t):
    return g.leiden(_near(t), 15)


@query("scan_clusters")
def _(t):
    return g.scan_clusters(_near(t), 0.6, 2)


@query("content_graph")
def _(t):
    return g.content_graph(_near(t), t("embeddings").select(F.col("vec_id").alias("id"), "embedding"))


@query("label_communities")
def _(t):
    return g.label_propagation(_near(t), 4)


@query("spectral_clusters")
def _(t):
    return g.spectral(_near(t), 4, 10)


@query("graph_walks")
def _(t):
    return g.random_walks(_near(t), 2, 6)


@query("graph_hierarchy")
def _(t):
    nodes = t("embeddings").select(F.col("vec_id").alias("id"), "embedding")
    return g.build_hierarchy(g.in_network(_near(t), nodes.select(F.col("id").alias("node"))), nodes, max_level=2)
