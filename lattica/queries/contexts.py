"""Token-budget context assembly."""

from __future__ import annotations

from pyspark.sql import functions as F

from lattica.operators import context as c
from lattica.queries.registry import query
from lattica.queries.texts import _TOKENS


@query("table_context", f"""WITH r AS (SELECT n_regionkey, s_suppkey, s_name || '|' || s_nationkey AS line FROM supplier JOIN nation ON s_nationkey = n_nationkey),
s AS (SELECT *, 1 + sum(len({_TOKENS.format('line')})) OVER (PARTITION BY n_regionkey ORDER BY s_suppkey) AS spent FROM r) SELECT n_regionkey, line, spent::BIGINT AS spent FROM s WHERE spent <= 12""")
def _(t):
    r = t("supplier").join(t("nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    return c.table_context(r, "n_regionkey", [F.asc("s_suppkey")], ["s_name", "s_nationkey"], 12).select("n_regionkey", "line", "spent")


_FIT = """WITH RECURSIVE o AS (SELECT {g} AS g, {k} AS k, {c} AS c, row_number() OVER (PARTITION BY {g} ORDER BY {k}) AS i FROM {t}),
f AS (SELECT g, k, c, i, {b} AS batch, c AS spent FROM o WHERE i = 1 UNION ALL SELECT o.g, o.k, o.c, o.i, CASE WHEN spent + o.c > {m} THEN batch + 1 ELSE batch END, CASE WHEN spent + o.c > {m} THEN o.c ELSE spent + o.c END FROM f JOIN o ON o.g = f.g AND o.i = f.i + 1)"""


@query("next_fit_batches", _FIT.format(g="source", k="doc_id", c="n_chars", t="documents", m=9000, b=0) + " SELECT g AS source, k AS doc_id, batch FROM f")
def _(t):
    return c.next_fit(t("documents").select("source", "doc_id", "n_chars"), "source", ["doc_id"], "n_chars", 9000).select("source", "doc_id", "batch")


@query("community_batches", _FIT.format(g="source", k="doc_id", c="n_chars", t="documents", m=20000, b=0) + " SELECT g AS source, k AS doc_id, batch, row_number() OVER (PARTITION BY g, batch ORDER BY c DESC, k DESC, k)::INT AS position FROM f")
def _(t):
    d = t("documents").select("source", "doc_id", "n_chars", F.col("n_chars").alias("weight"), F.col("doc_id").alias("rank"))
    return c.community_batches(d, "source", "doc_id", "n_chars", 20000).select("source", "doc_id", "batch", "position")


@query("relation_chunks", _FIT.format(g="l_returnflag", k="(-l_partkey, l_suppkey, l_orderkey, l_linenumber)", c="l_linenumber", t="lineitem WHERE l_orderkey <= 400", m=30, b=0) + " SELECT g AS flag, k[3]::BIGINT AS l_orderkey, k[4]::INT AS l_linenumber, batch FROM f")
def _(t):
    li = t("lineitem").where("l_orderkey <= 400").select(F.col("l_returnflag").alias("flag"), "l_orderkey", "l_linenumber", F.col("l_partkey").alias("degree_sum"), F.struct("l_suppkey", "l_orderkey", "l_linenumber").alias("key"))
    return c.relation_chunks(li, "flag", "key", "l_linenumber", 30).select("flag", "l_orderkey", "l_linenumber", "batch")


@query("prompt_chunks", _FIT.format(g="lang", k="doc_id", c="least(length(text), 5000)", t="documents WHERE text IS NOT NULL", m=5000, b=0) + " SELECT g AS lang, k AS doc_id, c AS n, batch FROM f")
def _(t):
    d = t("documents").where("text is not null").select("lang", "doc_id", "text")
    return c.prompt_chunks(d, "lang", "doc_id", "text", 5000).select("lang", "doc_id", F.length("text").cast("long").alias("n"), "batch")


@query("local_edge_context", "SELECT src, dst, spent::BIGINT AS spent FROM (SELECT s_nationkey AS g, s_suppkey AS src, s_nationkey AS dst, sum(3) OVER (PARTITION BY s_nationkey ORDER BY s_acctbal DESC, s_suppkey) AS spent FROM supplier) WHERE spent <= 9")
def _(t):
    e = t("supplier").select("s_nationkey", F.col("s_suppkey").alias("src"), F.col("s_nationkey").alias("dst"), F.col("s_acctbal").alias("degree"), F.lit(3).alias("cost"))
    return c.local_context(e, "s_nationkey", "cost", 9).select("src", "dst", "spent")


@query("mixed_context", """WITH p AS (SELECT n_regionkey AS g, n_nationkey AS child, 100 + n_nationkey AS whole, 10 AS short FROM nation),
w AS (SELECT *, sum(whole - short) OVER o AS s, sum(whole) OVER (PARTITION BY g) AS a, sum(short) OVER o AS hs, sum(short) OVER (PARTITION BY g) AS th FROM p WINDOW o AS (PARTITION BY g ORDER BY whole DESC, child ROWS UNBOUNDED PRECEDING))
SELECT g, child, a - (s - (whole - short)) > 300 AS report FROM w WHERE th <= 300 OR hs <= 300""")
def _(t):
    p = t("nation").select(F.col("n_regionkey").alias("g"), F.col("n_nationkey").alias("child"), (100 + F.col("n_nationkey")).alias("full"), F.lit(10).alias("short"))
    return c.mixed_context(p, "g", 300)


@query("level_contexts", "SELECT 1 AS level, r_regionkey AS community, CASE WHEN r_regionkey * 100 <= 150 THEN 'local' WHEN r_regionkey < 3 THEN 'mixed' ELSE 'trimmed' END AS state FROM region")
def _(t):
    r = t("region").select(F.lit(1).alias("level"), F.col("r_regionkey").alias("community"), (F.col("r_regionkey") * 100).alias("tokens"))
    return c.level_contexts(r, t("nation").where("n_regionkey < 3").select(F.col("n_regionkey").alias("parent")), 150)


@query("conversation_qa_turns", f"""WITH n AS (SELECT *, sum((role = 'user')::INT) OVER (PARTITION BY conv_id ORDER BY turn)::BIGINT AS qa FROM conversations),
p AS (SELECT conv_id, qa, max(text) FILTER (WHERE role = 'user') AS question, coalesce(string_agg(coalesce(text, ''), chr(10) ORDER BY turn) FILTER (WHERE role <> 'user' OR role IS NULL), '') AS answer FROM n WHERE qa > 0 GROUP BY ALL),
r AS (SELECT *, len({_TOKENS.format('question')}) + len({_TOKENS.format('answer')}) AS tokens FROM p QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY qa DESC) <= 5),
s AS (SELECT *, sum(tokens) OVER (PARTITION BY conv_id ORDER BY qa DESC) AS spent FROM r)
SELECT conv_id, qa, question, answer, tokens::BIGINT AS tokens, spent::BIGINT AS spent FROM s WHERE spent <= 400""")
def _(t):
    return c.conversation_turns(t("conversations"), "conv_id", "turn", "role", "text", 400).withColumn("tokens", F.col("tokens").cast("long"))


@query("candidates_in_context", "SELECT doc_id, lang, coalesce(doc_id IN (SELECT doc_id FROM labels WHERE quality = 1), false) AS in_context FROM documents")
def _(t):
    return c.with_flag(t("documents").select("doc_id", "lang"), t("labels").where("quality = 1"), "doc_id")


@query("few_shot_examples", "SELECT item_id, length(text) AS n FROM benchmark QUALIFY sum(length(text)) OVER (ORDER BY item_id) <= 800 OR row_number() OVER (ORDER BY item_id) <= 2")
def _(t):
    return c.examples_within(t("benchmark").select("item_id", F.length("text").cast("long").alias("n")), "item_id", "n", 800, 2).select("item_id", "n")


@query("embedding_batches", """WITH RECURSIVE o AS (SELECT source AS g, doc_id AS k, n_chars AS c, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS i FROM documents),
f AS (SELECT g, k, i, 0 AS batch, 1 AS n, c AS spent FROM o WHERE i = 1 UNION ALL SELECT o.g, o.k, o.i, CASE WHEN n + 1 > 16 OR spent + o.c > 8191 THEN batch + 1 ELSE batch END, CASE WHEN n + 1 > 16 OR spent + o.c > 8191 THEN 1 ELSE n + 1 END, CASE WHEN n + 1 > 16 OR spent + o.c > 8191 THEN o.c ELSE spent + o.c END FROM f JOIN o ON o.g = f.g AND o.i = f.i + 1)
SELECT g AS source, k AS doc_id, batch FROM f""")
def _(t):
    return c.embedding_batches(t("documents").select("source", "doc_id", "n_chars"), "source", "doc_id", "n_chars").select("source", "doc_id", "batch")


@query("level_prompts", "SELECT n_regionkey, count(*) AS communities, arg_min(n_name, md5('42:' || n_nationkey)) AS sample FROM nation GROUP BY 1")
def _(t):
    return c.level_prompts(t("nation"), "n_regionkey", "n_name", "n_nationkey")
