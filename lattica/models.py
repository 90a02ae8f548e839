"""Interfaces of models, with deterministic stand-ins that need no network.

An embedder maps a text column to a vector column, a generator a prompt column
to a text column. Both are plain functions over Columns, so a real model comes
in as a pandas UDF.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lattica.functions.text import parse_json, token_chunks, token_count, tokens
from lattica.operators.vector import weighted_mean

Embedder = Callable[[Column], Column]
Generator = Callable[[Column], Column]


def hash_embedder(size: int = 64) -> Embedder:
    """Counts of hashed tokens as floats: equal texts have equal vectors, shared tokens bring texts nearer."""

    def embed(text: Column) -> Column:
        places = F.transform(tokens(F.lower(text)), lambda w: F.pmod(F.xxhash64(w), F.lit(size)).cast("int"))
        zero = F.array_repeat(F.lit(0.0), size)
        return F.aggregate(places, zero, lambda s, p: F.transform(s, lambda x, i: F.when(i == p, x + 1.0).otherwise(x)))

    return embed


def echo_generator(limit: int = 40) -> Generator:
    """The first tokens of a prompt."""
    return lambda prompt: F.array_join(F.slice(tokens(prompt), 1, limit), " ")


def embed_texts(df: DataFrame, text: str, embedder: Embedder, to: str = "embedding") -> DataFrame:
    return df.withColumn(to, embedder(F.coalesce(F.col(text), F.lit(""))))


def embed_items(df: DataFrame, columns: list[str], embedder: Embedder) -> DataFrame:
    """Vectors of `name description`-like texts built from several columns."""
    return df.withColumn("embedding", embedder(F.concat_ws(" ", *columns)))


def embed_long_texts(df: DataFrame, key: str, text: str, embedder: Embedder, size: int = 512) -> DataFrame:
    """(key, embedding): chunks are embedded and averaged by their tokens, at length 1; texts without tokens have no row."""
    parts = df.select(key, F.explode(token_chunks(tokens(F.col(text)), size, 0)).alias("c")).select(key, "c.n_tokens", embedder(F.col("c.chunk")).alias("embedding"))
    return weighted_mean(parts, key, "n_tokens")


def cooccurring_entities(docs: DataFrame, key: str, text: str, pattern: str = r"\b[A-Z][a-z]{3,}\b") -> DataFrame:
    """(src, dst, weight): names that stand in one document, by the number of documents; names are what the pattern finds.

    All pairs of a document's names arise, so the pattern must find few a document.
    """
    names = docs.select(key, F.array_sort(F.array_distinct(F.regexp_extract_all(text, F.lit(f"({pattern})"), 1))).alias("n")).where("size(n) > 1")
    pairs = names.select(F.posexplode("n").alias("i", "src"), "n").select("src", F.explode(F.slice("n", F.col("i") + 2, F.size("n"))).alias("dst"))
    return pairs.groupBy("src", "dst").agg(F.count("*").alias("weight"))


def summarise_descriptions(df: DataFrame, key: str, description: str, generator: Generator, budget: int = 500) -> DataFrame:
    """(key, description): none gives "", one itself, several a summary of the sorted ones within the budget."""
    listed = df.groupBy(key).agg(F.sort_array(F.collect_set(description)).alias("l"))
    joined = F.array_join(F.slice(tokens(F.array_join("l", " ")), 1, budget), " ")
    return listed.select(key, F.when(F.size("l") == 0, "").when(F.size("l") == 1, F.get("l", 0)).otherwise(generator(joined)).alias("description"))


def ask(df: DataFrame, prompt: str, generator: Generator, schema: str | None = None) -> DataFrame:
    """Adds answer, status (ok, empty or unreadable) and, with a schema, parsed; a failed call is a status, not a lost row."""
    out = df.withColumn("answer", generator(F.col(prompt)))
    if schema:
        out = out.withColumn("parsed", parse_json(F.col("answer"), schema))
    empty = F.col("answer").isNull() | (F.col("answer") == "")
    return out.withColumn("status", F.when(empty, "empty").when(F.col("parsed").isNull(), "unreadable").otherwise("ok") if schema else F.when(empty, "empty").otherwise("ok"))


def community_reports(contexts: DataFrame, generator: Generator) -> DataFrame:
    """(community, report, tokens) from (community, context)."""
    return contexts.select("community", generator(F.col("context")).alias("report")).withColumn("tokens", token_count(F.col("report")))


def judge(pairs: DataFrame, criteria: tuple[str, ...] = ("comprehensiveness", "diversity", "empowerment", "directness")) -> DataFrame:
    """(criterion, winner, n) from pairs with a winner per criterion."""
    each = pairs.select(F.explode(F.array(*(F.struct(F.lit(c).alias("criterion"), F.col(c).alias("winner")) for c in criteria))).alias("e"))
    return each.select("e.*").groupBy("criterion", "winner").agg(F.count("*").alias("n"))
