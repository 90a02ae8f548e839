"""Column verbs, joins, aggregation, order and sets."""

from __future__ import annotations

from pyspark.sql import functions as F

from lattica.operators import relational as r
from lattica.queries.registry import query


@query("column_verbs", "SELECT o_orderkey AS id, o_totalprice AS price, o_totalprice AS price_copy, 'order' AS kind, o_orderkey::VARCHAR AS id_text, split(o_orderpriority, '-') AS priority FROM orders WHERE o_orderpriority IS NOT NULL AND length(o_orderpriority) > 0 AND o_orderstatus = 'F'")
def _(t):
    o = r.filter_value(r.filter_value(t("orders"), "o_orderpriority", "is not empty"), "o_orderstatus", "equals", "F")
    o = r.rename(r.select_columns(o, ["o_orderkey", "o_totalprice", "o_orderpriority", "o_orderdate"]), {"o_orderkey": "id", "o_totalprice": "price"})
    o = r.convert(r.fill(r.copy(r.drop(o, ["o_orderdate"]), "price", "price_copy"), "kind", "order"), "id", "id_text", "string")
    return r.drop(r.convert(o, "o_orderpriority", "priority", "array", "-"), ["o_orderpriority"])


@query("filter_column_pairs", "SELECT l_orderkey, l_linenumber, l_suppkey FROM lineitem WHERE l_quantity = l_linenumber")
def _(t):
    li = t("lineitem").withColumn("n", F.col("l_linenumber").cast("double"))
    return r.filter_columns(li, "l_quantity", "n").select("l_orderkey", "l_linenumber", "l_suppkey")


@query("merge_columns", "SELECT c_custkey, concat_ws('|', c_name, c_mktsegment) AS label, '{\"c_nationkey\":' || c_nationkey || ',\"c_mktsegment\":\"' || c_mktsegment || '\"}' AS packed FROM customer")
def _(t):
    c = t("customer").select("c_custkey", "c_name", "c_mktsegment", "c_nationkey")
    packed = r.merge_json(c.select("c_custkey", "c_nationkey", "c_mktsegment"), ["c_nationkey", "c_mktsegment"], "packed")
    return r.join_verb(r.merge_concat(c, ["c_name", "c_mktsegment"], "label", "|").drop("c_nationkey"), packed, "c_custkey", "c_custkey")


@query("zip_unzip", "SELECT n_nationkey, n_name AS a, n_regionkey AS b, n_name AS k, n_regionkey::VARCHAR AS v FROM nation")
def _(t):
    n = r.zip_columns(t("nation"), ["n_name", "n_regionkey"], "z")
    n = r.unzip(n, "z", ["a", "b"]).withColumns({"ks": F.array("n_name"), "vs": F.array(F.col("n_regionkey").cast("string"))})
    return r.zip_dict(n, "ks", "vs", "m").select("n_nationkey", "a", "b", F.map_keys("m")[0].alias("k"), F.map_values("m")[0].alias("v"))


@query("spread_json", "SELECT event_id, (props->>'$.k')::BIGINT AS k FROM events")
def _(t):
    return r.spread_json(t("events"), "props", "k long", ["event_id"])


@query("unroll_parts", "SELECT p_partkey, unnest(split(p_type, ' ')) AS word FROM part")
def _(t):
    return r.unroll(t("part").select("p_partkey", F.split("p_type", " ").alias("word")), "word")


@query("md5_ids", "SELECT doc_id, md5(coalesce(source, '') || coalesce(text, '')) AS id, row_number() OVER (ORDER BY n_chars, doc_id) AS n FROM documents")
def _(t):
    d = r.gen_id(t("documents"), ["source", "text"]).select("doc_id", "id", "n_chars")
    return r.gen_index(d, [F.col("n_chars"), F.col("doc_id")], "n").select("doc_id", "id", "n")


@query("stable_uuids", r"SELECT n_nationkey, substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-' || substr(h, 13, 4) || '-' || substr(h, 17, 4) || '-' || substr(h, 21, 12) AS id, true AS ok FROM (SELECT n_nationkey, md5(n_nationkey || chr(31) || n_name) AS h FROM nation)")
def _(t):
    return r.stable_uuid(t("nation"), ["n_nationkey", "n_name"]).select("n_nationkey", "id", r.is_uuid(F.col("id")).alias("ok"))


@query("level_filter_lookup", "SELECT vec_id, label FROM embeddings WHERE label <= 3")
def _(t):
    return r.up_to_level(t("embeddings"), 3, "label").select("vec_id", "label")


@query("entity_lookup", "SELECT n_nationkey, n_name FROM nation WHERE replace(n_name, '-', '') = replace('NATION_1', '-', '')")
def _(t):
    return r.lookup(t("nation"), "n_name", "NATION_1", dashes=False).select("n_nationkey", "n_name")


@query("clean_frame", "SELECT c_custkey, upper(c_name) AS c_name, upper(c_mktsegment) AS c_mktsegment, c_acctbal FROM customer")
def _(t):
    return r.clean_strings(t("customer").select("c_custkey", "c_name", "c_mktsegment", "c_acctbal"), F.upper)


@query("assign_levels", """WITH c AS (SELECT 'c' || n_nationkey AS id, n_regionkey AS level FROM nation),
b AS (SELECT id, level + CASE WHEN (SELECT min(level) FROM c) = 0 THEN 1 ELSE 0 END AS level, 0 AS kind FROM c UNION ALL SELECT 's' || s_suppkey, 0, 1 FROM supplier)
SELECT id, level, row_number() OVER (ORDER BY kind, level DESC, id) - 1 AS index_id FROM b""")
def _(t):
    c = t("nation").select(F.concat(F.lit("c"), F.col("n_nationkey")).alias("id"), F.col("n_regionkey").alias("level"))
    return r.assign_levels(c, t("supplier").select(F.concat(F.lit("s"), F.col("s_suppkey")).alias("id")))


@query("id_selectors", "SELECT vec_id FROM embeddings WHERE ((vec_id >= 10 AND vec_id < 200) AND NOT vec_id IN (11, 12)) <> (vec_id < 24 AND (CASE WHEN vec_id < 8 THEN (5 >> vec_id) & 1 WHEN vec_id < 16 THEN (255 >> (vec_id - 8)) & 1 ELSE 0 END) = 1) OR vec_id IN (300, 301)")
def _(t):
    ids = r.id_or(r.id_xor(r.id_and(r.id_range(10, 200), r.id_not(r.id_array([11, 12]))), r.id_bitmap(bytes([5, 255, 0]))), r.id_array([300, 301]))
    return t("embeddings").where(ids(F.col("vec_id"))).select("vec_id")


@query("join_inner_suffixes", "SELECT s.s_suppkey, s.s_nationkey, s.name AS name_1, n.name AS name_2 FROM (SELECT s_suppkey, s_nationkey, s_name AS name FROM supplier) s JOIN (SELECT n_nationkey, n_name AS name FROM nation) n ON s_nationkey = n_nationkey")
def _(t):
    s = t("supplier").select("s_suppkey", "s_nationkey", F.col("s_name").alias("name"))
    return r.join_verb(s, t("nation").select("n_nationkey", F.col("n_name").alias("name")), "s_nationkey", "n_nationkey").drop("n_nationkey")


@query("join_left_chain", "SELECT doc_id, d.lang, l.quality, b.text AS item FROM documents d LEFT JOIN labels l USING (doc_id) LEFT JOIN benchmark b ON d.doc_id = b.item_id")
def _(t):
    d = r.join_verb(t("documents").select("doc_id", "lang"), t("labels").select("doc_id", "quality"), "doc_id", "doc_id", "left")
    return r.join_verb(d, t("benchmark").select("item_id", F.col("text").alias("item")), "doc_id", "item_id", "left").drop("item_id")


@query("doc_join_right_outer", "SELECT d.doc_id, l.quality, l.toxic FROM labels l RIGHT JOIN documents d ON l.doc_id = d.doc_id")
def _(t):
    return r.join_verb(t("labels"), t("documents").select("doc_id"), "doc_id", "doc_id", "right").select("doc_id", "quality", "toxic")


_EDGES = "e AS (SELECT DISTINCT s_suppkey AS src, 100000 + s_nationkey AS dst, s_acctbal AS w FROM supplier)"


def supplier_edges(t):
    return t("supplier").select(F.col("s_suppkey").alias("src"), (100000 + F.col("s_nationkey")).alias("dst"), F.col("s_acctbal").alias("w"))


@query("edges_within_nodes", f"WITH {_EDGES} SELECT src, dst, w FROM e WHERE src IN (SELECT s_suppkey FROM supplier WHERE s_acctbal > 0) AND dst IN (SELECT 100000 + n_nationkey FROM nation WHERE n_regionkey < 3)")
def _(t):
    n = t("supplier").where("s_acctbal > 0").select(F.col("s_suppkey").alias("node"))
    return r.edges_within(supplier_edges(t), n.union(t("nation").where("n_regionkey < 3").select((100000 + F.col("n_nationkey")).cast("long"))))


@query("community_details", f"WITH {_EDGES}, x AS (SELECT src AS node, 'edge' AS kind, src::VARCHAR AS a, dst::VARCHAR AS b FROM e UNION ALL SELECT dst, 'edge', src::VARCHAR, dst::VARCHAR FROM e UNION ALL SELECT s_suppkey, 'claim', s_name, NULL FROM supplier) SELECT node, count(*) AS n, min(kind || ':' || a) AS first, max(kind || ':' || a) AS last FROM x GROUP BY node")
def _(t):
    claims = t("supplier").select(F.col("s_suppkey").alias("node"), F.col("s_name").alias("a"), F.lit(None).cast("string").alias("b"))
    d = r.details_by_end(supplier_edges(t), claims)
    c = r.collect_details(d, "node", "kind", ["a", "b"])
    label = F.transform("details", lambda x: F.concat(x.kind, F.lit(":"), x.a))
    return c.select("node", F.size("details").cast("long").alias("n"), F.array_min(label).alias("first"), F.array_max(label).alias("last"))


_MEMBERS = """m AS (SELECT 0 AS level, n_regionkey AS community, s_suppkey AS member FROM supplier JOIN nation ON s_nationkey = n_nationkey
UNION SELECT 1, s_nationkey, s_suppkey FROM supplier UNION SELECT 2, s_nationkey * 2 + (s_acctbal > 0)::INT, s_suppkey FROM supplier)"""


def memberships(t):
    s = t("supplier")
    a = s.join(t("nation"), F.col("s_nationkey") == F.col("n_nationkey")).select(F.lit(0).alias("level"), F.col("n_regionkey").alias("community"), F.col("s_suppkey").alias("member"))
    b = s.select(F.lit(1).alias("level"), F.col("s_nationkey").alias("community"), F.col("s_suppkey").alias("member"))
    c = s.select(F.lit(2).alias("level"), (F.col("s_nationkey") * 2 + (F.col("s_acctbal") > 0).cast("int")).alias("community"), F.col("s_suppkey").alias("member"))
    return r.union_rows(a, b, c)


@query("community_hierarchy", f"WITH {_MEMBERS} SELECT p.community AS parent, c.community AS child, c.level, c.size FROM (SELECT level, community, count(*) AS size, list(member) AS l FROM m GROUP BY ALL) c JOIN (SELECT level, community, list(member) AS l FROM m GROUP BY ALL) p ON p.level + 1 = c.level AND list_has_all(p.l, c.l)")
def _(t):
    return r.contained_sets(memberships(t))


@query("overlapping_communities", "SELECT 0 AS level, l_suppkey AS member, count(DISTINCT l_linenumber) AS communities FROM lineitem GROUP BY l_suppkey HAVING count(DISTINCT l_linenumber) > 1")
def _(t):
    return r.overlapping_members(t("lineitem").select(F.lit(0).alias("level"), F.col("l_suppkey").alias("member"), F.col("l_linenumber").alias("community")))


@query("title_id_map", "SELECT c_custkey, m.id FROM customer LEFT JOIN (SELECT n_regionkey, max(n_nationkey) AS id FROM nation GROUP BY 1) m ON c_nationkey = n_regionkey")
def _(t):
    last = r.last_wins(t("nation"), "n_regionkey", [F.col("n_nationkey")])
    return r.map_ids(t("customer").select("c_custkey", "c_nationkey"), "c_nationkey", last, "n_regionkey", "n_nationkey", "id").select("c_custkey", "id")


@query("unit_relationship_counts", "SELECT l_orderkey AS unit, count(*) FILTER (WHERE l_suppkey = 7 OR l_partkey = 7) AS relationships FROM lineitem GROUP BY 1")
def _(t):
    li = t("lineitem").select("*", F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("edge"))
    return r.touching_counts(li.select(F.col("l_orderkey").alias("unit"), "edge"), li.select("edge", F.col("l_suppkey").alias("src"), F.col("l_partkey").alias("dst")), 7)


@query("claims_of_entities", "SELECT c_custkey, o_orderkey FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderstatus = 'F'")
def _(t):
    return r.join_verb(t("customer").select("c_custkey"), t("orders").where("o_orderstatus = 'F'").select("o_custkey", "o_orderkey"), "c_custkey", "o_custkey").drop("o_custkey")


@query("aggregate_override_ops", """SELECT o_custkey, min(o_orderstatus) AS any_status, list_sort(list(o_orderkey)) AS keys, list_sort(list(DISTINCT o_orderpriority)) AS priorities,
array_to_string(list_sort(list(o_orderkey::VARCHAR)), ';') AS joined, round(sum(o_totalprice), 2) AS total, max(o_totalprice) AS most, count(o_orderkey) AS n FROM orders GROUP BY o_custkey""")
def _(t):
    ops = [("any", "o_orderstatus", "any_status"), ("array_agg", "o_orderkey", "keys"), ("array_agg_distinct", "o_orderpriority", "priorities"), ("string_concat", "o_orderkey", "joined", ";"), ("sum", "o_totalprice", "total"), ("max", "o_totalprice", "most"), ("count", "o_orderkey", "n")]
    return r.aggregate(t("orders"), ops, ["o_custkey"]).withColumn("total", F.round("total", 2))


@query("dedupe_first", "SELECT o_custkey, o_orderkey, o_totalprice FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) = 1")
def _(t):
    return r.dedupe(t("orders"), ["o_custkey"], [F.col("o_orderdate"), F.col("o_orderkey")]).select("o_custkey", "o_orderkey", "o_totalprice")


@query("top_community_per_title", "SELECT l_partkey AS title, max(l_suppkey) AS community FROM lineitem GROUP BY 1")
def _(t):
    return r.top_communities(t("lineitem").select(F.col("l_partkey").alias("title"), F.col("l_suppkey").alias("community")))


@query("cluster_id_lists", "SELECT l_suppkey, list_sort(list(DISTINCT l_partkey)) AS parts, list_sort(list(DISTINCT l_linenumber)) AS lines FROM lineitem GROUP BY 1")
def _(t):
    return r.distinct_lists(t("lineitem").select("l_suppkey", F.array("l_partkey").alias("parts"), F.array("l_linenumber").alias("lines")), "l_suppkey", ["parts", "lines"])


@query("community_weight_norm", "WITH c AS (SELECT source, count(DISTINCT doc_id) AS weight FROM documents GROUP BY source) SELECT source, weight, weight / (SELECT max(weight) FROM c)::DOUBLE AS share FROM c")
def _(t):
    return r.community_weights(t("documents"), "source", "doc_id")


@query("community_matches", "SELECT l_suppkey AS community, count(*) AS matches, s_acctbal AS rank FROM lineitem JOIN supplier ON l_suppkey = s_suppkey WHERE l_orderkey % 10 = 0 GROUP BY ALL ORDER BY matches DESC, rank DESC, community LIMIT 5")
def _(t):
    e = t("lineitem").where("l_orderkey % 10 = 0").select(F.array("l_suppkey").alias("communities"))
    return r.community_matches(e, t("supplier").select(F.col("s_suppkey").alias("community"), F.col("s_acctbal").alias("rank")), 5)


@query("level_counts", f"WITH {_MEMBERS} SELECT level, count(DISTINCT community) AS communities FROM m GROUP BY level")
def _(t):
    return r.level_counts(memberships(t))


@query("unique_descriptions", "SELECT p_type, min(p_partkey) AS first, row_number() OVER (ORDER BY min(p_partkey), p_type) - 1 AS index FROM part GROUP BY p_type")
def _(t):
    return r.unique_in_order(t("part"), "p_type", "p_partkey")


@query("k_per_level_alloc", """WITH w AS (SELECT label AS level, sum(vec_id) AS weight FROM embeddings GROUP BY 1),
s AS (SELECT level, weight, round_even(weight / (sum(weight) OVER ())::DOUBLE * 20, 0)::INT AS k FROM w),
d AS (SELECT *, 20 - sum(k) OVER () AS rest, row_number() OVER (ORDER BY level) - 1 AS r, count(*) OVER () AS n FROM s)
SELECT level, weight::BIGINT AS weight, (k + sign(rest) * (abs(rest) // n + CASE WHEN r < abs(rest) % n THEN 1 ELSE 0 END))::INT AS k FROM d""")
def _(t):
    return r.allocate_levels(t("embeddings").groupBy(F.col("label").alias("level")).agg(F.sum("vec_id").alias("weight")), 20)


@query("imbalance_factor", "WITH c AS (SELECT l_suppkey, count(*) AS n FROM lineitem GROUP BY 1) SELECT count(*) AS groups, sum(n)::BIGINT AS rows, round(count(*) * sum(n * n) / (sum(n) * sum(n))::DOUBLE, 9) AS factor FROM c")
def _(t):
    return r.imbalance(t("lineitem"), "l_suppkey").withColumn("factor", F.round("factor", 9))


@query("usage_and_means", "SELECT role, sum(length(text))::BIGINT AS chars, count(*) AS calls FROM conversations GROUP BY role")
def _(t):
    return r.token_usage(t("conversations").select("role", F.length("text").alias("chars")), ["role"], ["chars"])


@query("mean_metrics", "SELECT round(avg(quality) * 100, 6) AS quality, round(avg(toxic) * 100, 6) AS toxic FROM labels")
def _(t):
    return r.mean_percent(t("labels"), ["quality", "toxic"]).select(F.round("quality", 6).alias("quality"), F.round("toxic", 6).alias("toxic"))


@query("sort_limit", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25")
def _(t):
    return r.top_rows(t("orders").select("o_orderkey", "o_totalprice"), [F.desc("o_totalprice"), F.asc("o_orderkey")], 25)


@query("top_k_per_group", "SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey)::INT AS rank FROM orders QUALIFY rank <= 2")
def _(t):
    return r.top_per_group(t("orders").select("o_custkey", "o_orderkey", "o_totalprice"), ["o_custkey"], [F.desc("o_totalprice"), F.asc("o_orderkey")], 2).drop("o_totalprice")


@query("weight_percentiles", "SELECT quantile_cont(o_totalprice, 0.5) AS q0, quantile_cont(o_totalprice, 0.7) AS q1, quantile_cont(o_totalprice, 0.95) AS q2 FROM orders")
def _(t):
    return r.quantiles(t("orders"), "o_totalprice", [0.5, 0.7, 0.95])


@query("union_all_rows", "SELECT n_nationkey AS id, n_name AS name, NULL::BIGINT AS rank FROM nation UNION ALL SELECT r_regionkey, r_name, r_regionkey FROM region")
def _(t):
    return r.union_rows(t("nation").select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("name")), t("region").select(F.col("r_regionkey").alias("id"), F.col("r_name").alias("name"), F.col("r_regionkey").cast("long").alias("rank")))


@query("concat_side_by_side", "SELECT n_name, r_name FROM (SELECT n_name, row_number() OVER (ORDER BY n_nationkey) AS i FROM nation) FULL JOIN (SELECT r_name, row_number() OVER (ORDER BY r_regionkey) AS i FROM region) USING (i)")
def _(t):
    return r.concat_columns(t("nation"), t("region"), [F.col("n_nationkey")], [F.col("r_regionkey")]).select("n_name", "r_name")


@query("id_set_operations", "SELECT doc_id, 'only' AS part FROM (SELECT doc_id FROM documents EXCEPT SELECT doc_id FROM labels) UNION ALL SELECT doc_id, 'both' FROM (SELECT doc_id FROM documents INTERSECT SELECT doc_id FROM labels)")
def _(t):
    return r.id_difference(t("documents"), t("labels"), "doc_id").withColumn("part", F.lit("only")).union(r.id_intersection(t("documents"), t("labels"), "doc_id").withColumn("part", F.lit("both")))


@query("distinct_pairs", "SELECT DISTINCT lang, source FROM documents")
def _(t):
    return t("documents").select("lang", "source").distinct()


@query("sample_by_hash", "SELECT doc_id, lang FROM documents ORDER BY md5('42:' || doc_id), doc_id LIMIT 30")
def _(t):
    return r.select_chunks(t("documents").select("doc_id", "lang"), "random", 30, "doc_id")


@query("seeded_shuffle", "SELECT doc_id, row_number() OVER (ORDER BY md5('86:' || doc_id), doc_id) AS place FROM documents")
def _(t):
    return r.shuffle_rows(t("documents").select("doc_id"), "doc_id")
