"""Benchmark decontamination by SimHash of item-sized windows (DataFrame functions only).

A text's windows of the items' sizes are fingerprinted with 64 bits, wherever
at least half of a window's shingles occur in some item of that size: windows
with fewer can't be similar. Fingerprints of windows and items of one size
meet in Hamming blocks, one more than the radius, which finds every pair
within the radius; the exact weighted similarity decides. Which item a window
belongs to is found by its fingerprint alone. Equal texts are handled once.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lattica.llm.common import Scratch, ascii_lower, small_join, words

#: Two 32-bit counters in a long, its sign bit unused.
FIELDS = 0x0000000100000001


def shingles(text: Column, k: int) -> Column:
    """Hashes of all k-word shingles in order, repeats kept; none below k words."""
    # bound to a lambda's variable, the words are split once and not once a shingle
    each = lambda w: F.when(F.size(w) >= k, F.transform(F.sequence(F.lit(1), F.size(w) - (k - 1)), lambda i: F.xxhash64(F.slice(w, i, k)))).otherwise(F.array().cast("array<long>"))
    return F.element_at(F.transform(F.array(words(ascii_lower(text))), each), 1)


def fingerprint(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """keys and fp: the majority of each hash bit over the rows of a key, of which there may be 2^31."""
    sums = [F.sum(F.shiftrightunsigned(value, j).bitwiseAND(F.lit(FIELDS))).alias(f"s{j}") for j in range(32)]
    bit = lambda j, f: F.when(2 * F.shiftrightunsigned(f"s{j}", 32 * f).bitwiseAND(F.lit(0xFFFFFFFF)) > F.col("m"), F.shiftleft(F.lit(1).cast("long"), j + 32 * f)).otherwise(F.lit(0).cast("long"))
    fp = reduce(lambda a, b: a.bitwiseOR(b), [bit(j, f) for j in range(32) for f in range(2)])
    return rows.groupBy(*keys).agg(F.count("*").alias("m"), *sums).select(*keys, fp.alias("fp"))


def blocks(fp: Column, radius: int) -> Column:
    """The parts of a fingerprint: two within the radius agree in at least one of them."""
    cuts = [64 * i // (radius + 1) for i in range(radius + 2)]
    return F.array(*(F.shiftrightunsigned(fp, a).bitwiseAND(F.lit((1 << (b - a)) - 1)) for a, b in zip(cuts, cuts[1:])))


def leaking_texts(docs: DataFrame, items: DataFrame, k: int = 5, percent: int = 75, radius: int = 20) -> DataFrame:
    """(key, item_id, start, similarity): the best window of every distinct text that leaks an item.

    key is the md5 of the text (null: of the empty text), start the window's
    first word from 0, similarity the sum of the smaller over the sum of the
    larger shingle counts, at least percent/100. Of equal windows the first
    counts. An item of fewer than k words is one shingle of all its words; one
    without words never leaks. Repeated items give one row each. A pair at the
    threshold differs in about 11 of 64 bits, by three deviations more at
    `radius`; beyond it a window is not seen. Empty tables give an empty result.
    """
    scratch = Scratch(docs.sparkSession, "decontamination")
    size = F.least(F.lit(k), F.size(words(F.col("text"))))
    wide = items.select("item_id", "text", size.alias("k")).where("k > 0")
    short = [r["k"] for r in wide.select("k").distinct().where(F.col("k") < k).collect()]  # at most k - 1 sizes
    sized = reduce(lambda a, b: a.union(b), [wide.where(F.col("k") == n).select("item_id", F.lit(n).alias("k"), shingles(F.col("text"), n).alias("sh")) for n in (k, *short)])
    item = scratch.save(sized.distinct().select(F.xxhash64("item_id", "sh").alias("it"), "item_id", "k", F.size("sh").alias("len"), "sh"))
    parts = item.select("it", "k", "len", F.explode("sh").alias("h"))
    counts = scratch.save(parts.groupBy("it", "k", "len", "h").agg(F.count("*").alias("n_item")))
    text = F.coalesce(F.col("text"), F.lit(""))
    source = docs.select(F.md5(text.cast("binary")).alias("key"), "text")
    spread = reduce(lambda a, b: a.union(b), [source.select("key", F.lit(n).alias("k"), F.posexplode(shingles(F.col("text"), n)).alias("pos", "h")) for n in (k, *short)])
    hits = small_join(spread, counts.select("h", "k", "len").distinct(), ["h", "k"], most=1_000_000)
    hits = hits.groupBy("key", "k", "len").agg(F.sort_array(F.collect_set("pos")).alias("ps"))
    half = F.ceil(F.col("len") / 2).cast("int")
    # a window that starts elsewhere can be moved to the next shared shingle without losing overlap
    starts = F.filter("ps", lambda s, i: F.coalesce(F.get("ps", i + half - 1) < s + F.col("len"), F.lit(False)))
    wanted = scratch.save(hits.select("key", "k", "len", starts.alias("starts")).where("size(starts) > 0"))
    # few texts are wanted: only they are shuffled, as long as their keys can be broadcast
    bodies = small_join(source, wanted.select("key").distinct(), ["key"], "left_semi").dropDuplicates(["key"])
    bodies = scratch.save(reduce(lambda a, b: a.union(b), [bodies.select("key", F.lit(n).alias("k"), shingles(F.col("text"), n).alias("sh")) for n in (k, *short)]))
    windows = wanted.join(bodies, ["key", "k"]).select("key", "k", "len", "sh", F.explode("starts").alias("start"))
    windows = scratch.save(windows.select("key", "k", "len", "start", F.slice("sh", F.col("start") + 1, F.col("len")).alias("win")))
    ids, kind = ["key", "k", "len", "start"], ["k", "len"]
    seen = fingerprint(windows.select(*ids, F.explode("win").alias("h")), ids, "h").select(*ids, "fp", F.posexplode(blocks(F.col("fp"), radius)).alias("block", "value"))
    known = fingerprint(parts, ["it", *kind], "h").select("it", *kind, F.col("fp").alias("item_fp"), F.posexplode(blocks(F.col("fp"), radius)).alias("block", "value"))
    met = small_join(seen, known, [*kind, "block", "value"]).where(F.bit_count(F.col("fp").bitwiseXOR(F.col("item_fp"))) <= radius).select(*ids, "it").distinct()
    near = windows.join(met, ids).select(*ids, "it", F.size("win").alias("m"), F.explode("win").alias("h")).groupBy(*ids, "it", "m", "h").agg(F.count("*").alias("n"))
    both = small_join(near, counts.select("it", "h", "n_item"), ["it", "h"], most=1_000_000).groupBy(*ids, "it", "m").agg(F.sum(F.least("n", "n_item")).alias("same"))
    both = both.withColumn("similarity", F.col("same") / (F.col("m") + F.col("len") - F.col("same"))).where(100 * F.col("same") >= percent * (F.col("m") + F.col("len") - F.col("same")))
    best = both.groupBy("key", "it").agg(F.max(F.struct("similarity", (-F.col("start")).alias("back"))).alias("b"))
    return small_join(best, item.select("it", "item_id"), ["it"]).select("key", "item_id", (-F.col("b.back")).cast("long").alias("start"), "b.similarity")


def text_key(text: Column) -> Column:
    """The key of a text in leaking_texts."""
    return F.md5(F.coalesce(text, F.lit("")).cast("binary"))


def leaks(docs: DataFrame, items: DataFrame, **how) -> DataFrame:
    """(doc_id, item_id, start, similarity) for every row of docs and item that it leaks; see leaking_texts."""
    key = text_key(F.col("text"))
    return docs.select("doc_id", key.alias("key")).join(leaking_texts(docs, items, **how), "key").drop("key")


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, item_id, start, similarity) of documents that leak a benchmark item; see leaking_texts."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text"))
