"""Mixing sources to target weights, by hash-threshold histograms (DataFrame functions only).

A document's hash is the first 48 bits of the md5 of its id. Per source, word
counts are summed by the top bits of the hash; the bucket in which the budget
runs out is the only one that is cut finer, 12 bits at a time. What lies below
the final threshold is taken once more than what lies above it. Nothing is
sorted, and no list of documents is ever built: a pass shuffles at most 4096
sums per source and task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lattica.llm.common import Scratch, id_hash, n_words, null_safe_key, small_join

HASH_BITS, STEP_BITS = 48, 12


def targets(sizes: DataFrame, weights: tuple[int, ...], most: int) -> DataFrame:
    """Adds `target` to (source, source_size): weights by code point order, null last, capped at most times the size.

    One row per distinct source goes through one window; sources are a
    dimension, so this doesn't grow with the documents. A source's share is
    capped if, with all sources of a lower cap per weight capped, it is above.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    rank = (F.row_number().over(order) - 1) % len(weights)
    weighed = sizes.withColumn("w", F.element_at(F.array(*map(F.lit, weights)), (rank + 1).cast("int")))
    weighed = weighed.withColumn("cap", (F.col("source_size") * most).cast("double"))
    before = Window.orderBy(F.col("cap") / F.col("w"), F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy()
    left = F.sum("source_size").over(whole) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))
    share = F.sum("w").over(whole) - F.coalesce(F.sum("w").over(before), F.lit(0))
    ruled = weighed.withColumn("level", left / share).withColumn("capped", F.col("level") > F.col("cap") / F.col("w"))
    left = F.sum("source_size").over(whole) - F.coalesce(F.sum(F.when(F.col("capped"), F.col("cap"))).over(whole), F.lit(0.0))
    share = F.sum(F.when(~F.col("capped"), F.col("w"))).over(whole)
    return ruled.withColumn("target", F.when(F.col("capped"), F.col("cap")).otherwise(F.col("w") * (left / share))).select("source", "source_size", "target")


def thresholds(spark: SparkSession, slim: DataFrame, scratch: Scratch, weights: tuple[int, ...], most: int) -> DataFrame:
    """One row per source: its key, source_size, target, whole copies, and the hash below which a document counts once more."""
    sizes = slim.groupBy("key").agg(F.first("source").alias("source"), F.sum("size").alias("source_size"))
    aims = targets(sizes, weights, most).withColumn("key", null_safe_key(F.col("source")))
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(1)
    aims = aims.withColumn("whole", whole.cast("long"))
    aims = aims.withColumn("rest", F.when(F.col("source_size") > 0, F.col("target") - F.col("whole") * F.col("source_size")).otherwise(0.0))
    state = scratch.save(aims.withColumns({"low": F.lit(0).cast("long"), "taken": F.lit(0).cast("long")}))
    for shift in range(HASH_BITS - STEP_BITS, -1, -STEP_BITS):
        # only documents of the bucket that holds the threshold so far
        inside = small_join(slim.select("key", "h", "size"), state.select("key", "low"), ["key"])
        if shift < HASH_BITS - STEP_BITS:
            inside = inside.where(F.shiftright("h", shift + STEP_BITS) == F.shiftright("low", shift + STEP_BITS))
        sums = inside.groupBy("key", F.shiftright("h", shift).alias("bucket")).agg(F.sum("size").alias("n"))
        running = Window.partitionBy("key").orderBy("bucket")
        sums = sums.withColumn("upto", F.sum("n").over(running))
        sums = small_join(sums, state, ["key"])
        # the first bucket that would pass the budget; past the last one, the one after all
        over = F.col("taken") + F.col("upto") > F.col("rest")
        cut = sums.where(over).groupBy("key").agg(F.min(F.struct("bucket", "upto", "n")).alias("c"))
        found = state.join(cut, "key", "left")
        below = F.col("taken") + F.col("c.upto") - F.col("c.n")
        at = F.shiftleft(F.col("c.bucket"), shift)
        if shift == 0:  # one hash value is left: taken if that ends nearer to the budget
            at = at + F.when(F.col("rest") - below > F.col("c.n") / 2, 1).otherwise(0)
        none = F.lit(1 << HASH_BITS)  # the whole source fits: only when rounding leaves the budget at its size
        new = scratch.save(found.select("key", "source", "source_size", "target", "whole", "rest", F.coalesce(at, none).alias("low"), F.coalesce(below, F.col("taken")).alias("taken")))
        scratch.drop(state)
        state = new
    return state.select("key", "source_size", "target", "whole", F.col("low").alias("threshold"))


def mix(docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), most: int = 3) -> DataFrame:
    """All documents with size, source_size, target, copies and taken (size times copies).

    Sources share the total number of words by weight; no target is above
    `most` times its source's words, and the excess goes to the others by
    weight. A null or empty text has size 0; a source without any words keeps
    each document once and takes 0 words. A null source is a source of its
    own. Rows with one id (or with a null id, which counts as the empty text)
    have one hash and are taken alike. The same rows give the same mix in any
    order and partitioning. Columns of docs that have one of the five names
    are replaced; other columns stay. An empty table gives an empty result.
    """
    spark, scratch = docs.sparkSession, Scratch(docs.sparkSession, "mixing")
    mine = {"__key": null_safe_key(F.col("source")), "__h": id_hash(F.col("doc_id"), HASH_BITS), "__size": n_words(F.col("text"))}
    slim = scratch.save(docs.select(F.col("source"), *(c.alias(n.strip("_")) for n, c in mine.items())))
    cuts = thresholds(spark, slim, scratch, weights, most).select(F.col("key").alias("__key"), F.col("source_size").alias("__source_size"), F.col("target").alias("__target"), "whole", "threshold")
    out = small_join(docs.withColumns(mine), cuts.withColumnsRenamed({"whole": "__whole", "threshold": "__threshold"}), ["__key"])
    copies = F.col("__whole") + F.when(F.col("__h") < F.col("__threshold"), 1).otherwise(0)
    kept = [c for c in docs.columns if c not in ("size", "source_size", "target", "copies", "taken")]
    out = out.select(*kept, F.col("__size").alias("size"), F.col("__source_size").alias("source_size"), F.col("__target").alias("target"), copies.cast("long").alias("copies"), (F.col("__size") * copies).cast("long").alias("taken"))
    scratch.drop(slim)
    return out


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source")
    return mix(docs).select("doc_id", "size", "source_size", "target", "taken", "source", "copies")


OP1_SQL = r"""
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 12))::BIGINT AS h
  FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, [5, 2, 1][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT] AS w, (3 * source_size)::DOUBLE AS cap FROM s),
l AS (SELECT *, (sum(source_size) OVER ())::DOUBLE AS total, sum(w) OVER () AS ws,
        coalesce(sum(cap) OVER b, 0) AS cap_before, coalesce(sum(w) OVER b, 0) AS w_before
      FROM w WINDOW b AS (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
r AS (SELECT *, (total - cap_before) / (ws - w_before)::DOUBLE > cap / w AS capped FROM l),
t AS (SELECT source, source_size, CASE WHEN capped THEN cap ELSE w *
        ((total - coalesce(sum(cap) FILTER (WHERE capped) OVER (), 0)) / (sum(w) FILTER (WHERE NOT capped) OVER ())::DOUBLE) END AS target FROM r),
k AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 1 END AS whole FROM t),
q AS (SELECT *, CASE WHEN source_size > 0 THEN target - whole * source_size ELSE 0 END AS rest FROM k),
g AS (SELECT source, h, sum(size) AS n FROM d GROUP BY source, h),
c AS (SELECT source, h, n, sum(n) OVER (PARTITION BY source ORDER BY h) AS upto FROM g),
m AS (SELECT c.source, c.h, CASE WHEN upto <= rest OR (upto - n <= rest AND rest - (upto - n) > n / 2.0) THEN 1 ELSE 0 END AS more
      FROM c JOIN q ON c.source IS NOT DISTINCT FROM q.source)
SELECT d.doc_id, d.size, q.source_size, q.target, (d.size * (q.whole + m.more))::BIGINT AS taken, d.source, (q.whole + m.more)::BIGINT AS copies
FROM d JOIN q ON d.source IS NOT DISTINCT FROM q.source JOIN m ON d.source IS NOT DISTINCT FROM m.source AND d.h = m.h
"""
