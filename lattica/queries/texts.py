"""Text functions and answer metrics."""

from __future__ import annotations

from pyspark.sql import functions as F

from lattica import models
from lattica.functions import text as x
from lattica.queries.registry import query

_TOKENS = r"list_filter(string_split(trim(regexp_replace(coalesce({0}, ''), '[ \t\n\x0B\f\r]+', ' ', 'g')), ' '), lambda w: w <> '')"
_PLAIN = r"regexp_replace(lower({0}), '[!-/:-@\[-`{{-~]', '', 'g')"
_NORM = "array_to_string(list_filter(" + _TOKENS.replace("{0}", _PLAIN) + ", lambda w: w NOT IN ('a', 'an', 'the')), ' ')"


@query("token_counts", f"SELECT doc_id, len({_TOKENS.format('text')})::INT AS n FROM documents")
def _(t):
    return t("documents").select("doc_id", x.token_count(F.col("text")).alias("n"))


@query("text_units_by_doc", f"""WITH w AS (SELECT doc_id, {_TOKENS.format('text')} AS w FROM documents),
c AS (SELECT doc_id, w, unnest(range(0, (len(w) - 1) // 110 + 1)) AS p FROM w WHERE len(w) > 0)
SELECT doc_id, p::INT AS position, array_to_string(w[p * 110 + 1:p * 110 + 120], ' ') AS chunk, least(120, len(w) - p * 110)::INT AS n_tokens, md5(array_to_string(w[p * 110 + 1:p * 110 + 120], ' ')) AS id FROM c""")
def _(t):
    return x.chunk_documents(t("documents"), "doc_id", "text", 120, 10)


@query("sentence_chunks", r"SELECT doc_id, list_filter(string_split(regexp_replace(text, '([.!?])[ \t\n\x0B\f\r]+', '\1' || chr(1), 'g'), chr(1)), lambda s: s <> '') AS s FROM documents WHERE text IS NOT NULL")
def _(t):
    return t("documents").where("text is not null").select("doc_id", x.sentences(F.col("text")).alias("s"))


@query("text_split", "SELECT c_custkey, string_split(c_name, '#') AS parts, CASE WHEN c_mktsegment = '' THEN [] ELSE string_split(c_mktsegment, 'I') END AS other FROM customer")
def _(t):
    return t("customer").select("c_custkey", x.split_text(F.col("c_name"), "#").alias("parts"), x.split_text(F.col("c_mktsegment"), "I").alias("other"))


@query("text_replace", r"SELECT doc_id, replace(replace(text, 'th', '*'), '.', ' !') AS a, regexp_replace(text, '[aeiou]+', '_', 'g') AS b FROM documents")
def _(t):
    return t("documents").select("doc_id", x.replace_all(F.col("text"), [("th", "*"), (".", " !")]).alias("a"), x.replace_all(F.col("text"), [("[aeiou]+", "_")], regex=True).alias("b"))


@query("clean_text", r"SELECT page_id, regexp_replace(replace(replace(replace(replace(replace(trim(url || ' &lt;b&gt; &amp;lt;'), '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&#39;', chr(39)), '&amp;', '&'), '[\x00-\x1F\x7F-\x9F]', '', 'g') AS a, trim(regexp_replace(regexp_replace(url, '[^\x20-\x7E]', ' ', 'g'), ' +', ' ', 'g')) AS b FROM pages".replace('\\"', '"'))
def _(t):
    return t("pages").select("page_id", x.clean_str(F.concat("url", F.lit(" &lt;b&gt; &amp;lt;"))).alias("a"), x.clean_unicode(F.col("url")).alias("b"))


@query("json_repair", "SELECT event_id, (props->>'$.k')::BIGINT AS k FROM events")
def _(t):
    broken = F.concat(F.lit("```json\n"), F.replace(F.col("props"), F.lit("}"), F.lit(", }")), F.lit("\n```"))
    return t("events").select("event_id", x.parse_json(broken, "k long")["k"].alias("k"))


def _answers(t):
    s = F.concat(F.lit('("entity"<|>'), "s_name", F.lit('<|>SUPPLIER<|>"from nation"<|>)##("relationship"<|>'), "s_name", F.lit("<|>nation "), F.col("s_nationkey").cast("string"), F.lit("<|>lives in<|>"), (F.col("s_suppkey") % 5).cast("string"), F.lit(")##"))
    return t("supplier").select("s_suppkey", s.alias("answer"))


@query("extraction_records", "SELECT s_suppkey, upper(s_name) AS source, upper('nation ' || s_nationkey) AS target, 'lives in' AS description, (s_suppkey % 5)::DOUBLE AS weight FROM supplier")
def _(t):
    return x.extracted_graph(_answers(t), "s_suppkey", "answer")[1]


@query("extracted_entities", "SELECT s_suppkey, upper(s_name) AS title, 'SUPPLIER' AS type, 'from nation' AS description FROM supplier")
def _(t):
    return x.extracted_graph(_answers(t), "s_suppkey", "answer")[0]


@query("claim_tuples", "SELECT c_custkey, c_name AS subject_id, 'NONE' AS object_id, c_mktsegment AS type, 'TRUE' AS status, NULL::VARCHAR AS start_date, NULL::VARCHAR AS end_date, NULL::VARCHAR AS description, NULL::VARCHAR AS source_text, NULL::VARCHAR AS doc_id FROM customer")
def _(t):
    c = t("customer").select("c_custkey", F.concat(F.lit("("), "c_name", F.lit("<|>NONE<|>"), "c_mktsegment", F.lit("<|>TRUE)")).alias("answer"))
    return x.claims(c, "c_custkey", "answer")


@query("direct_answers", "SELECT n_nationkey, n_name AS answer FROM nation")
def _(t):
    return t("nation").select("n_nationkey", x.direct_answer(F.concat(F.lit("I think so.\nAnswer: \""), "n_name", F.lit('".\nBye'))).alias("answer"))


@query("report_validation", "SELECT r_regionkey, CASE r_regionkey WHEN 0 THEN 'strict' WHEN 1 THEN 'weak' ELSE 'default' END AS state, CASE WHEN r_regionkey < 2 THEN r_name ELSE '' END AS title, CASE WHEN r_regionkey = 0 THEN 7.5 ELSE -1.0 END::DOUBLE AS rating, CASE r_regionkey WHEN 0 THEN '# ' || r_name || chr(10) || chr(10) || 's' || chr(10) || chr(10) || '## f' || chr(10) || chr(10) || 'e' WHEN 1 THEN '# ' || r_name || chr(10) || chr(10) || chr(10) || chr(10) ELSE '# ' || chr(10) || chr(10) || chr(10) || chr(10) END AS body FROM region")
def _(t):
    full = F.concat(F.lit('{"title": "'), "r_name", F.lit('", "summary": "s", "findings": [{"summary": "f", "explanation": "e"}], "rating": 7.5}'))
    weak = F.concat(F.lit('{"title": "'), "r_name", F.lit('"}'))
    answer = F.when(F.col("r_regionkey") == 0, full).when(F.col("r_regionkey") == 1, weak).otherwise("no json")
    r = t("region").select("r_regionkey", x.report_of(answer).alias("r"))
    return r.select("r_regionkey", "r.state", "r.title", "r.rating", x.report_text(F.col("r")).alias("body"))


@query("level_ratings", "SELECT n_nationkey, CASE WHEN n_nationkey > 3 THEN [(n_nationkey + n_regionkey) / 2.0, n_nationkey::DOUBLE, n_regionkey::DOUBLE] END AS r FROM nation")
def _(t):
    answer = F.when(F.col("n_nationkey") > 3, F.concat_ws(" and ", F.col("n_nationkey").cast("string"), F.col("n_regionkey").cast("string"))).otherwise("none")
    return t("nation").select("n_nationkey", x.level_ratings(answer, 2).alias("r"))


@query("map_points", "SELECT n_nationkey, n_name AS description, n_regionkey AS score FROM nation")
def _(t):
    answer = F.concat(F.lit('{"points": [{"description": "'), "n_name", F.lit('", "score": '), F.col("n_regionkey").cast("string"), F.lit('}, {"description": "x"}]}'))
    return t("nation").select("n_nationkey", F.explode(x.map_points(answer)).alias("p")).select("n_nationkey", "p.*")


@query("prompts_and_ranks", "SELECT n_nationkey, 'Tell of ' || n_name || ' in ' || n_regionkey || '.' AS prompt, CASE WHEN n_regionkey > 2 THEN n_regionkey::DOUBLE ELSE -1.0 END AS rank FROM nation")
def _(t):
    rank = x.rank_of(F.when(F.col("n_regionkey") > 2, F.col("n_regionkey").cast("string")).otherwise("high"))
    return t("nation").select("n_nationkey", x.prompt("Tell of {a} in {b}.", a=F.col("n_name"), b=F.col("n_regionkey")).alias("prompt"), rank.alias("rank"))


@query("rows_as_text", "SELECT n_regionkey, 'n_nationkey,n_name' || chr(10) || string_agg(n_nationkey || ',' || n_name, chr(10) ORDER BY n_nationkey) AS text FROM nation GROUP BY 1")
def _(t):
    return x.rows_to_text(t("nation").withColumn("name_embedding", F.lit(1)), "n_regionkey", "n_nationkey", ["n_nationkey", "n_name", "name_embedding"])


@query("timestamp_text_parts", "SELECT event_id, year(ts)::INT AS year, month(ts)::INT AS month, day(ts)::INT AS dayofmonth, hour(ts)::INT AS hour, minute(ts)::INT AS minute, second(ts)::INT AS second FROM events")
def _(t):
    parts = x.timestamp_parts(F.date_format("ts", "yyyy-MM-dd HH:mm:ss"))
    return t("events").select("event_id", *(c.alias(n) for n, c in parts.items()))


@query("typed_cells", "SELECT try_cast(p_name AS INT) AS p_name, p_size::DOUBLE AS p_size, p_partkey::VARCHAR AS p_partkey FROM part")
def _(t):
    return x.typed(t("part"), {"p_name": "int", "p_size": "double", "p_partkey": "string"}, required=False)


_QA = f"q AS (SELECT l.doc_id, d.text AS p, b.text AS a FROM labels l JOIN documents d USING (doc_id) JOIN benchmark b ON l.doc_id % 40 = b.item_id), n AS (SELECT doc_id, {_NORM.format('p')} AS p, {_NORM.format('a')} AS a, p AS p0, a AS a0 FROM q)"


def _qa(t):
    d = t("labels").select("doc_id").join(t("documents").select("doc_id", F.col("text").alias("p")), "doc_id")
    return d.join(t("benchmark").select((F.col("item_id")).alias("i"), F.col("text").alias("a")), F.col("doc_id") % 40 == F.col("i"))


@query("qa_hit_f1_em", f"""WITH {_QA}, s AS (SELECT doc_id, p, a, {_TOKENS.format('p')} AS tp, {_TOKENS.format('a')} AS ta FROM n),
k AS (SELECT doc_id, w, sum(p) AS p, sum(a) AS a FROM (SELECT doc_id, unnest(tp) AS w, 1 AS p, 0 AS a FROM s UNION ALL SELECT doc_id, unnest(ta), 0, 1 FROM s) GROUP BY ALL),
o AS (SELECT s.*, coalesce((SELECT sum(least(k.p, k.a)) FROM k WHERE k.doc_id = s.doc_id), 0) AS same FROM s)
SELECT doc_id, contains(p, a)::INT AS hit, (p = a)::INT AS em, round(coalesce(CASE WHEN same > 0 THEN 2 * (same / len(tp)::DOUBLE) * (same / len(ta)::DOUBLE) / (same / len(tp)::DOUBLE + same / len(ta)::DOUBLE) END, 0), 9) AS f1 FROM o""")
def _(t):
    p, a = F.col("p"), F.col("a")
    f1 = x.token_scores(_qa(t), "doc_id", "p", "a").select("doc_id", F.round("f1", 9).alias("f1"))
    return _qa(t).select("doc_id", x.hit(p, F.array(a)).alias("hit"), x.exact_match(p, a).alias("em")).join(f1, "doc_id")


@query("answer_sets", "SELECT n_nationkey, CASE WHEN n_regionkey < 2 THEN 1.0 ELSE 0.0 END AS recall, CASE WHEN n_regionkey < 2 THEN 0.5 ELSE 0.0 END AS precision, (n_regionkey < 2)::INT AS word FROM nation")
def _(t):
    p = F.array(F.concat(F.lit("The "), "n_name"), F.lit("other"))
    a = F.array(F.when(F.col("n_regionkey") < 2, F.col("n_name")).otherwise("none"))
    s = x.set_scores(p, a)
    return t("nation").select("n_nationkey", s["recall"].alias("recall"), s["precision"].alias("precision"), x.graph_answer(F.array_join(p, " "), a[0]).alias("word"))


@query("bleu_rouge")
def _(t):
    b = t("benchmark").select("item_id", F.col("text").alias("a"), F.concat(F.substring("text", 1, 60), F.lit(" end")).alias("p"))
    return b.select("item_id", F.round(x.bleu(F.col("p"), F.col("a"), 1), 6).alias("bleu1"), F.round(x.bleu(F.col("p"), F.col("a"), 4, True), 6).alias("bleu4"), F.round(x.best_over(F.array("a", "p"), lambda r: x.rouge_l(F.col("p"), r)), 6).alias("rouge"))


@query("question_lines", "SELECT n_nationkey, ['Who is ' || n_name || '?', 'Why?'] AS q FROM nation")
def _(t):
    return t("nation").select("n_nationkey", x.numbered_questions(F.concat(F.lit("User 1\nQuestion 1: Who is "), "n_name", F.lit("?\n- Question 2:  Why?\n"))).alias("q"))


@query("entity_cooccurrence", "WITH n AS (SELECT DISTINCT doc_id, unnest(regexp_extract_all(text, '[A-Z][a-z]{11,}')) AS n FROM documents) SELECT a.n AS src, b.n AS dst, count(*) AS weight FROM n a JOIN n b ON a.doc_id = b.doc_id AND a.n < b.n GROUP BY ALL")
def _(t):
    return models.cooccurring_entities(t("documents"), "doc_id", "text", "[A-Z][a-z]{11,}")


@query("summaries", "SELECT n_regionkey, CASE WHEN count(DISTINCT n_name) = 1 THEN any_value(n_name) ELSE array_to_string(list_sort(list(DISTINCT n_name))[1:3], ' ') END AS description FROM nation GROUP BY 1")
def _(t):
    return models.summarise_descriptions(t("nation"), "n_regionkey", "n_name", models.echo_generator(3))


@query("answers_with_status", "SELECT n_nationkey, CASE WHEN n_regionkey = 0 THEN NULL ELSE n_name END AS answer, CASE WHEN n_regionkey = 0 THEN 'empty' ELSE 'ok' END AS status FROM nation")
def _(t):
    return models.ask(t("nation").withColumn("q", F.when(F.col("n_regionkey") > 0, F.col("n_name"))), "q", lambda c: c).select("n_nationkey", "answer", "status")


@query("judge_wins", "SELECT criterion, winner, count(*) AS n FROM (SELECT 'diversity' AS criterion, o_orderstatus AS winner FROM orders UNION ALL SELECT 'directness', o_orderpriority FROM orders) GROUP BY ALL")
def _(t):
    return models.judge(t("orders").select(F.col("o_orderstatus").alias("diversity"), F.col("o_orderpriority").alias("directness")), ("diversity", "directness"))
