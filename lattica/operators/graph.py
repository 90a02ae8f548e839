"""Graphs as edge tables: undirected edges are stored once, in order of their ends."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lattica.operators.relational import last_wins, quantiles
from lattica.operators.vector import distance, knn
from lattica.sources.tables import saved


def canonical_edges(pairs: DataFrame, src: str, dst: str) -> DataFrame:
    """(src, dst, weight): one row per undirected edge, weight the number of pairs; loops and null ends are left out."""
    ends = pairs.select(F.least(src, dst).alias("src"), F.greatest(src, dst).alias("dst"), (F.col(src) != F.col(dst)).alias("proper"))
    return ends.where("proper").groupBy("src", "dst").agg(F.count("*").alias("weight"))


def last_edges(pairs: DataFrame, src: str, dst: str, order: list[Column]) -> DataFrame:
    """Undirected edges with the attributes of their last pair in a stated order."""
    both = pairs.withColumns({src: F.least(src, dst), dst: F.greatest(src, dst)}).where(F.col(src) != F.col(dst))
    return last_wins(both.withColumn("__key", F.struct(src, dst)), "__key", order).drop("__key")


def nodes_of(edges: DataFrame) -> DataFrame:
    return edges.select(F.explode(F.array("src", "dst")).alias("node")).distinct()


def both_ways(edges: DataFrame, *more: str) -> DataFrame:
    """(node, other): every edge seen from both ends, in one pass."""
    ends = F.array(F.struct(F.col("src").alias("node"), F.col("dst").alias("other")), F.struct(F.col("dst").alias("node"), F.col("src").alias("other")))
    return edges.select(F.explode(ends).alias("e"), *more).select("e.node", "e.other", *more)


def degrees(edges: DataFrame) -> DataFrame:
    """(node, degree, strength) of canonical edges; each edge counts at both ends."""
    ends = edges.select(F.explode(F.array("src", "dst")).alias("node"), "weight")
    return ends.groupBy("node").agg(F.count("*").alias("degree"), F.sum("weight").alias("strength"))


def combined_degree(edges: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """Edges with the sum of their ends' degrees as rank; with nodes (node, degree), theirs, and an unknown node counts 0."""
    d = degrees(edges) if nodes is None else nodes
    left, right = (d.select(F.col("node").alias(end), F.col("degree").alias(f"{end}_degree")) for end in ("src", "dst"))
    out = edges.join(left, "src", "left").join(right, "dst", "left")
    return out.withColumn("rank", F.coalesce("src_degree", F.lit(0)) + F.coalesce("dst_degree", F.lit(0)))


def mean_degree(edges: DataFrame) -> DataFrame:
    """(degree): the whole part of the mean degree of nodes with an edge."""
    return degrees(edges).agg(F.floor(F.avg("degree")).alias("degree"))


def merge_graphs(nodes: DataFrame, edges: DataFrame, order: str, node_ops: dict[str, str], edge_ops: dict[str, str]) -> tuple[DataFrame, DataFrame]:
    """Unites the graphs of many chunks: nodes by title, edges by their ends.

    Operations by attribute: replace (last), skip (first), concat (distinct,
    sorted, joined by commas), sum, average, max, min, multiply.
    """
    ops = {
        "replace": lambda c: F.max_by(c, order), "skip": lambda c: F.min_by(c, order), "concat": lambda c: F.array_join(F.sort_array(F.collect_set(F.col(c).cast("string"))), ","),
        "sum": F.sum, "average": F.avg, "max": F.max, "min": F.min, "multiply": F.product,
    }
    merged = lambda df, keys, how: df.groupBy(*keys).agg(*(ops[op](c).alias(c) for c, op in how.items())) if how else df.select(*keys).distinct()
    ends = edges.withColumns({"src": F.least("src", "dst"), "dst": F.greatest("src", "dst")})
    return merged(nodes, ["title"], node_ops), merged(ends, ["src", "dst"], edge_ops)


def unpack(nodes: DataFrame, edges: DataFrame, what: str) -> DataFrame:
    """The node or the edge rows of a graph."""
    return nodes if what == "nodes" else edges


def zero_layout(nodes: DataFrame) -> DataFrame:
    """All nodes at the origin."""
    return nodes.select("node", F.lit(0.0).alias("x"), F.lit(0.0).alias("y"))


def in_network(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges with both ends among nodes."""
    a, b = (nodes.select(F.col("node").alias(x)).distinct() for x in ("src", "dst"))
    return edges.join(a, "src", "left_semi").join(b, "dst", "left_semi").select(*edges.columns)


def out_network(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges with exactly one end among nodes, with that end as `inside` and the other as `outside`."""
    seen = nodes.select("node").distinct().withColumn("in", F.lit(True))
    a, b = (seen.withColumnsRenamed({"node": x, "in": f"in_{x}"}) for x in ("src", "dst"))
    both = edges.join(a, "src", "left").join(b, "dst", "left").where(F.col("in_src").isNull() != F.col("in_dst").isNull())
    inside = F.when(F.col("in_src").isNotNull(), F.col("src")).otherwise(F.col("dst"))
    outside = F.when(F.col("in_src").isNotNull(), F.col("dst")).otherwise(F.col("src"))
    return both.select(*edges.columns, inside.alias("inside"), outside.alias("outside"))


def out_network_links(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(outside, links): how many selected nodes each node outside touches."""
    return out_network(edges, nodes).groupBy("outside").agg(F.countDistinct("inside").alias("links"))


def out_network_budget(edges: DataFrame, nodes: DataFrame, top_k: int, rank: str = "weight") -> DataFrame:
    """Edges out of the selected nodes by (links of the outer end, rank), top_k for each selected node in all."""
    out = out_network(edges, nodes).join(out_network_links(edges, nodes), "outside")
    k = top_k * nodes.select("node").distinct().count()
    return out.orderBy(F.desc("links"), F.desc(rank), "src", "dst").limit(k)


def contract(edges: DataFrame, members: DataFrame) -> DataFrame:
    """(src, dst, weight) between communities of (node, community): edges within one go, the others are counted."""
    a, b = (members.select(F.col("node").alias(x), F.col("community").alias(f"{x}_c")) for x in ("src", "dst"))
    return canonical_edges(edges.select("src", "dst").join(a, "src").join(b, "dst"), "src_c", "dst_c")


def union_members(parents: DataFrame, members: DataFrame) -> DataFrame:
    """(community, members): the distinct members of all children of a parent (parent, child)."""
    return parents.join(members.select(F.col("community").alias("child"), "node"), "child").groupBy(F.col("parent").alias("community")).agg(F.sort_array(F.collect_set("node")).alias("members"))


def augment(edges: DataFrame, nodes: DataFrame, percent: float = 0.7, search_k: float = 1.5, scale: float = 1.0) -> DataFrame:
    """(src, dst, weight): the edges with their cosine, and new ones between near nodes (id, embedding).

    Cosines of the edges give the threshold (a percentile); the whole mean
    degree times scale gives each node's budget of new edges (without edges,
    half the root of the number of nodes). Of the nearest by L2, those without
    an edge and with a cosine above the threshold are taken. All nodes are
    compared with the graph as it was.
    """
    vec = lambda end: nodes.select(F.col("id").alias(end), F.col("embedding").alias(f"{end}_e"))
    old = saved(edges.select("src", "dst").join(vec("src"), "src").join(vec("dst"), "dst").select("src", "dst", distance("src_e", "dst_e", "cosine").alias("weight")))
    if not old.isEmpty():
        budget, wx = int(int(mean_degree(old).first()["degree"]) * scale), quantiles(old, "weight", [percent]).first()[0]
    else:
        budget, wx = int(nodes.count() ** 0.5 / 2), -1.0
    near = knn(nodes, nodes.withColumnRenamed("id", "qid"), int(search_k * budget) + 1, "l2").where("qid <> id").select(F.col("qid").alias("node"), F.col("id").alias("other"))
    free = near.join(both_ways(old), ["node", "other"], "left_anti")
    a, b = nodes.select(F.col("id").alias("node"), F.col("embedding").alias("ea")), nodes.select(F.col("id").alias("other"), F.col("embedding").alias("eb"))
    scored = free.join(a, "node").join(b, "other").select("node", "other", distance("ea", "eb", "cosine").alias("weight")).where(F.col("weight") > wx)
    best = scored.withColumn("r", F.row_number().over(Window.partitionBy("node").orderBy(F.desc("weight"), "other"))).where(F.col("r") <= budget)
    new = best.groupBy(F.least("node", "other").alias("src"), F.greatest("node", "other").alias("dst")).agg(F.max("weight").alias("weight"))
    return old.unionByName(new)


def components(edges: DataFrame, most_rounds: int = 100) -> DataFrame:
    """(node, component): the smallest node reachable, by alternating large and small stars on saved tables."""
    links, seen = saved(edges.select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).where("a < b").distinct()), None
    for _ in range(most_rounds):
        both = links.union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.where("b > a").join(low, "a").select(F.col("m").alias("a"), "b").where("a < b").distinct()
        low = large.groupBy("b").agg(F.min("a").alias("m"))
        pairs = F.array(F.struct(F.col("m").alias("a"), F.col("a").alias("b")), F.struct(F.col("m").alias("a"), F.col("b").alias("b")))
        links = saved(large.join(low, "b").select(F.explode(pairs).alias("e")).select("e.*").where("a < b").distinct())
        state = links.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == seen:
            break
        seen = state
    else:
        raise RuntimeError(f"components still change after {most_rounds} rounds")
    return links.select(F.col("b").alias("node"), F.col("a").alias("component")).union(links.select(F.col("a").alias("node"), F.col("a").alias("component")).distinct())


def largest_component(edges: DataFrame) -> DataFrame:
    """The edges of the component with most nodes; of equal ones, that of the smallest node."""
    of = components(edges)
    top = of.groupBy("component").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "component").limit(1).select("component")
    mine = of.join(F.broadcast(top), "component").select(F.col("node").alias("src"))
    return edges.join(mine, "src", "left_semi").select(*edges.columns)


def pagerank(edges: DataFrame, seeds: DataFrame | None = None, damping: float = 0.85, rounds: int = 100, tolerance: float = 1e-6) -> DataFrame:
    """(node, rank) on undirected edges with restarts at the seeds (all nodes if none are given), until the ranks move by less than nodes x tolerance.

    Restarts are uniform over the seeds among the nodes. Rounds are saved
    tables; only one sum a round reaches the driver.
    """
    arcs = saved(both_ways(edges, "weight"))
    out = arcs.groupBy("node").agg(F.sum("weight").alias("out"))
    start = out.select("node", "out", F.lit(1.0).alias("s")) if seeds is None else out.join(seeds.select("node").distinct().withColumn("s", F.lit(1.0)), "node", "left")
    total = start.agg(F.sum("s").alias("t"), F.count("*").alias("n")).first()
    if not total["t"]:
        return start.select("node", F.lit(0.0).alias("rank"))
    base = saved(start.select("node", "out", (F.coalesce("s", F.lit(0.0)) / total["t"]).alias("p")))
    ranks = base.select("node", F.lit(1.0 / total["n"]).alias("rank"))
    for _ in range(rounds):
        sent = arcs.join(base.select("node", "out"), "node").join(ranks, "node").groupBy(F.col("other").alias("node")).agg(F.sum(F.col("rank") * F.col("weight") / F.col("out")).alias("in"))
        new = saved(base.join(sent, "node", "left").select("node", (damping * F.coalesce("in", F.lit(0.0)) + (1 - damping) * F.col("p")).alias("rank")))
        if tolerance > 0 and new.join(ranks.withColumnRenamed("rank", "old"), "node").agg(F.sum(F.abs(F.col("rank") - F.col("old")))).first()[0] < total["n"] * tolerance:
            return new
        ranks = new
    return ranks


def scan_similarity(edges: DataFrame) -> DataFrame:
    """(src, dst, similarity): (common neighbours + 2) over the root of both degrees + 1, for every edge."""
    arcs = both_ways(edges)
    d = arcs.groupBy("node").agg(F.count("*").alias("d"))
    paths = edges.select("src", "dst").join(arcs.withColumnsRenamed({"node": "src", "other": "via"}), "src").join(arcs.withColumnsRenamed({"node": "dst", "other": "via"}), ["dst", "via"])
    common = paths.groupBy("src", "dst").agg(F.count("*").alias("common"))
    both = edges.select("src", "dst").join(common, ["src", "dst"], "left").join(d.withColumnsRenamed({"node": "src", "d": "ds"}), "src").join(d.withColumnsRenamed({"node": "dst", "d": "dd"}), "dst")
    return both.select("src", "dst", ((F.coalesce("common", F.lit(0)) + 2) / F.sqrt((F.col("ds") + 1.0) * (F.col("dd") + 1.0))).alias("similarity"))


def scan_weighted(edges: DataFrame) -> DataFrame:
    """(src, dst, similarity): weighted Jaccard of the ends' neighbours, each end among its own with weight 1."""
    arcs = both_ways(edges, "weight").select("node", "other", F.col("weight").cast("double").alias("weight"))
    own = nodes_of(edges).select("node", F.col("node").alias("other"), F.lit(1.0).alias("weight"))
    full = arcs.unionByName(own)
    total = full.groupBy("node").agg(F.sum("weight").alias("t"))
    a, b = full.toDF("src", "via", "wa"), full.toDF("dst", "via", "wb")
    low = edges.select("src", "dst").join(a, "src").join(b, ["dst", "via"]).groupBy("src", "dst").agg(F.sum(F.least("wa", "wb")).alias("low"))
    ends = edges.select("src", "dst").join(low, ["src", "dst"], "left").join(total.toDF("src", "ts"), "src").join(total.toDF("dst", "td"), "dst")
    low = F.coalesce("low", F.lit(0.0))
    return ends.select("src", "dst", (low / (F.col("ts") + F.col("td") - low)).alias("similarity"))


def scan_clusters(edges: DataFrame, epsilon: float = 0.6, mu: int = 2, weighted: bool = False) -> DataFrame:
    """(node, cluster): the smallest core of a node's cluster, -2 for hubs between clusters, -3 for outliers; node ids are not negative.

    A core has at least mu similar neighbours; clusters are the components of
    similar cores; a border node joins the cluster of its smallest similar core.
    """
    near = saved((scan_weighted if weighted else scan_similarity)(edges).where(F.col("similarity") >= epsilon).select("src", "dst"))
    arcs = both_ways(near)
    cores = saved(arcs.groupBy("node").agg(F.count("*").alias("n")).where(F.col("n") >= mu).select("node"))
    inner = in_network(near, cores)
    label = cores.join(components(inner), "node", "left").select("node", F.coalesce("component", "node").alias("cluster"))
    border = arcs.join(cores.select(F.col("node").alias("other")), "other", "left_semi").join(cores, "node", "left_anti").groupBy("node").agg(F.min("other").alias("other"))
    border = border.join(label.toDF("other", "cluster"), "other").select("node", "cluster")
    members = saved(label.unionByName(border))
    rest = nodes_of(edges).join(members, "node", "left_anti")
    around = both_ways(edges).join(rest, "node", "left_semi").join(members.toDF("other", "cluster"), "other").groupBy("node").agg(F.countDistinct("cluster").alias("k"))
    return members.unionByName(rest.join(around, "node", "left").select("node", F.when(F.col("k") >= 2, -2).otherwise(-3).cast("long").alias("cluster")))


def content_graph(edges: DataFrame, nodes: DataFrame, k: int = 5, alpha: float = 0.5, part: float = 0.5) -> DataFrame:
    """(src, dst, weight): edges and k content neighbours a node, weighted by blended similarity, the best of each node kept.

    Content similarity is cosine, topology the Jaccard of neighbours; both are
    brought to 0 to 1 over all candidates. A node keeps part of its
    neighbours, one at least.
    """
    near = knn(nodes, nodes.withColumnRenamed("id", "qid"), k + 1, "cosine").where("qid <> id")
    pairs = edges.select("src", "dst").unionByName(near.select(F.least("qid", "id").alias("src"), F.greatest("qid", "id").alias("dst"))).distinct()
    vec = lambda end: nodes.select(F.col("id").alias(end), F.col("embedding").alias(f"{end}_e"))
    arcs = both_ways(edges)
    d = arcs.groupBy("node").agg(F.count("*").alias("d"))
    common = pairs.join(arcs.toDF("src", "via"), "src").join(arcs.toDF("dst", "via"), ["dst", "via"]).groupBy("src", "dst").agg(F.count("*").alias("i"))
    s = pairs.join(common, ["src", "dst"], "left").join(d.toDF("src", "ds"), "src", "left").join(d.toDF("dst", "dd"), "dst", "left").join(vec("src"), "src").join(vec("dst"), "dst")
    i, both = F.coalesce("i", F.lit(0)), F.coalesce("ds", F.lit(0)) + F.coalesce("dd", F.lit(0))
    s = saved(s.select("src", "dst", F.coalesce(F.try_divide(i, both - i), F.lit(0.0)).alias("t"), F.coalesce(distance("src_e", "dst_e", "cosine"), F.lit(0.0)).alias("c")))
    ends = F.broadcast(s.agg(*(f(x).alias(f"{f.__name__}_{x}") for x in "tc" for f in (F.min, F.max))))
    flat = lambda x: F.coalesce(F.try_divide(F.col(x) - F.col(f"min_{x}"), F.col(f"max_{x}") - F.col(f"min_{x}")), F.lit(0.0))
    blend = s.crossJoin(ends).select("src", "dst", (alpha * flat("t") + (1 - alpha) * flat("c")).alias("weight"))
    seen = both_ways(blend, "weight")
    w = Window.partitionBy("node")
    kept = seen.withColumn("n", F.count("*").over(w)).withColumn("r", F.row_number().over(w.orderBy(F.desc("weight"), "other"))).where(F.col("r") <= F.greatest(F.lit(1), F.ceil(F.col("n") * part)))
    return kept.groupBy(F.least("node", "other").alias("src"), F.greatest("node", "other").alias("dst")).agg(F.max("weight").alias("weight"))


# ---------------------------------------------------------------- clustering


def _moved(n: int, a: np.ndarray, b: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Labels by modularity: nodes move in order to the neighbouring community with the largest gain, then communities become nodes."""
    label = np.arange(n)
    while True:
        adj: list[dict] = [{} for _ in range(n)]
        loops, total = np.zeros(n), 0.0
        for x, y, z in zip(a.tolist(), b.tolist(), w.tolist()):
            total += z
            if x == y:
                loops[x] += z
            else:
                adj[x][y] = adj[x].get(y, 0.0) + z
                adj[y][x] = adj[y].get(x, 0.0) + z
        k = (np.array([sum(d.values()) for d in adj]) + 2 * loops).tolist()
        near_of = [list(d.items()) for d in adj]
        comm, mass, moved = list(range(n)), k[:], False
        for _ in range(50):
            changed = False
            for v in range(n):
                mine, near = comm[v], {}
                for u, z in near_of[v]:
                    c = comm[u]
                    near[c] = near.get(c, 0.0) + z
                mass[mine] -= k[v]
                best, top = mine, None
                for c, z in near.items():  # of equal gains, the smallest community's
                    gain = z - mass[c] * k[v] / (2 * total)
                    if top is None or gain > top or (gain == top and c < best):
                        best, top = c, gain
                if top is None or top <= near.get(mine, 0.0) - mass[mine] * k[v] / (2 * total) + 1e-12:
                    best = mine
                mass[best] += k[v]
                if best != mine:
                    comm[v], changed, moved = best, True, True
            if not changed:
                break
        if not moved:
            return label
        names, comm = np.unique(comm, return_inverse=True)
        label, n = comm[label], len(names)
        a, b = comm[a], comm[b]


def _connected(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    low = np.arange(n)
    while True:
        new = low.copy()
        np.minimum.at(new, a, low[b])
        np.minimum.at(new, b, low[a])
        new = new[new]
        if (new == low).all():
            return low
        low = new


def leiden(edges: DataFrame, max_size: int = 15, most_edges: int = 2_000_000) -> DataFrame:
    """(node, level, community) of a hierarchy: each community is connected, and those of more than max_size nodes are split on the next level.

    A community is named by its smallest node. Components of up to most_edges
    edges are clustered side by side, one per group; in a larger one, edges
    between rounds of label propagation's communities are set aside first.
    """
    of = components(edges)
    sizes = edges.join(of.toDF("src", "component"), "src").groupBy("component").agg(F.count("*").alias("n"))
    big = sizes.where(F.col("n") > most_edges).select("component")
    if not big.isEmpty():
        label = label_propagation(edges, 5).toDF("node", "part")
        ends = edges.join(label.toDF("src", "pa"), "src").join(label.toDF("dst", "pb"), "dst")
        edges = saved(ends.where("pa = pb").select(*edges.columns))
        of = components(edges)

    def split(f: pd.DataFrame) -> pd.DataFrame:
        names, flat = np.unique(f[["src", "dst"]].to_numpy(), return_inverse=True)
        ends, w, out = flat.reshape(-1, 2), f["weight"].to_numpy(float), []
        todo = [(0, np.arange(len(names)), np.arange(len(ends)))]
        at = np.empty(len(names), np.int64)  # a part's own places are set before they are read
        while todo:
            level, members, mine = todo.pop()
            at[members] = np.arange(len(members))
            a, b = at[ends[mine, 0]], at[ends[mine, 1]]
            label = _moved(len(members), a, b, w[mine])
            same = label[a] == label[b]
            label = _connected(len(members), a[same], b[same])
            groups, flat = np.unique(label, return_inverse=True)
            order, cuts = np.argsort(flat, kind="stable"), np.cumsum(np.bincount(flat))[:-1]
            both = np.flatnonzero(label[a] == label[b])
            of = flat[a[both]]
            links = np.split(both[np.argsort(of, kind="stable")], np.cumsum(np.bincount(of, minlength=len(groups)))[:-1])
            for inside, link in zip(np.split(members[order], cuts), links):
                name = names[inside.min()]
                out += [(v, level, name) for v in names[inside].tolist()]
                if len(inside) > max_size and len(groups) > 1:
                    todo.append((level + 1, inside, mine[link]))
        return pd.DataFrame(out, columns=["node", "level", "community"])

    return edges.select("src", "dst", F.col("weight").cast("double").alias("weight")).join(of.toDF("src", "component"), "src").groupBy("component").applyInPandas(split, "node long, level int, community long")


def label_propagation(edges: DataFrame, rounds: int = 5) -> DataFrame:
    """(node, label): every round a node takes the heaviest label around it; of equal ones, the smallest."""
    arcs, labels = saved(both_ways(edges, "weight")), None
    for _ in range(rounds):
        seen = arcs.withColumn("label", F.col("other")) if labels is None else arcs.join(labels.toDF("other", "label"), "other")
        votes = seen.groupBy("node", "label").agg(F.sum("weight").alias("w"))
        labels = saved(votes.groupBy("node").agg(F.min(F.struct((-F.col("w")).alias("w"), "label")).alias("b")).select("node", "b.label"))
    return labels


def spectral(edges: DataFrame, k: int, iterations: int = 20) -> DataFrame:
    """(node, cluster) by power iteration on the normalised affinities."""
    from pyspark.ml.clustering import PowerIterationClustering

    found = PowerIterationClustering(k=k, maxIter=iterations, srcCol="src", dstCol="dst", weightCol="weight").assignClusters(edges.select("src", "dst", F.col("weight").cast("double").alias("weight")))
    return found.select(F.col("id").alias("node"), F.col("cluster").cast("long").alias("cluster"))


def random_walks(edges: DataFrame, walks: int = 10, length: int = 40, seed: int = 1) -> DataFrame:
    """(walk, node, path): walks from every node; each step goes to the neighbour with the least seeded hash."""
    arcs = saved(both_ways(edges))
    at = nodes_of(edges).crossJoin(F.broadcast(edges.sparkSession.range(walks).toDF("walk"))).select("walk", "node", F.col("node").alias("end"), F.array("node").alias("path"))
    for step in range(length - 1):
        near = at.join(arcs.toDF("end", "next"), "end").groupBy("walk", "node").agg(F.min(F.struct(F.xxhash64("walk", "node", "next", F.lit(seed), F.lit(step)).alias("h"), "next", "path")).alias("b"))
        at = near.select("walk", "node", F.col("b.next").alias("end"), F.concat("b.path", F.array("b.next")).alias("path"))
        if step % 10 == 9:
            at = saved(at)
    return at.select("walk", "node", "path")


def node_vectors(walks: DataFrame, size: int = 64, window: int = 2, iterations: int = 3, seed: int = 1) -> DataFrame:
    """(node, embedding) by skip-grams over walks."""
    from pyspark.ml.feature import Word2Vec
    from pyspark.ml.functions import vector_to_array

    model = Word2Vec(vectorSize=size, minCount=1, windowSize=window, maxIter=iterations, seed=seed, inputCol="words", outputCol="v").fit(walks.select(F.transform("path", lambda x: x.cast("string")).alias("words")))
    return model.getVectors().select(F.col("word").cast("long").alias("node"), vector_to_array("vector").alias("embedding"))


def build_hierarchy(edges: DataFrame, nodes: DataFrame, max_level: int = 4, min_clusters: int = 5, max_size: int = 15, **how) -> DataFrame:
    """(level, node, community) bottom up: augment, cluster, contract, until fewer than min_clusters remain.

    Nodes of a level above the first are the communities below; their vectors
    are means of their members'.
    """
    from lattica.operators.vector import centroids

    out = None
    for level in range(1, max_level + 1):
        grown = saved(augment(edges, nodes, **how))
        tree = leiden(grown.withColumn("weight", F.greatest("weight", F.lit(1e-6))), max_size)
        last = tree.groupBy("node").agg(F.max_by("community", "level").alias("community"))
        members = saved(nodes.select(F.col("id").alias("node")).join(last, "node", "left").select("node", F.coalesce("community", "node").alias("community")))
        rows = members.select(F.lit(level).alias("level"), "node", "community")
        out = rows if out is None else out.unionByName(rows)
        clusters = members.select("community").distinct().count()
        if clusters < min_clusters or clusters == members.count():
            break
        edges = saved(contract(grown, members))
        nodes = saved(centroids(nodes.join(members.withColumnRenamed("node", "id"), "id"), "community").select(F.col("centroid").alias("id"), "embedding"))
    return out
