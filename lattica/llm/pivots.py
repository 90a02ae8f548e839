"""Embedding near-dedup by a pivot-permutation index.

A vector is described by its nearest reference points in order, as many as
pairs at the threshold need with these reference points; vectors with two of
them in common meet in an inverted list of that pair of pivots, and are
verified there by cosine in double precision. Long lists are cut into blocks
that are compared pairwise, so no task holds a whole one. Equal vectors are
one class with a count.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain, combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lattica.llm.common import Scratch, components

BLOCK = 1024
#: The part of pairs exactly at the threshold that must share pivots.
FOUND = 0.999


def unit(rows: list) -> np.ndarray:
    x = np.array(rows, np.float64)
    x /= np.abs(x).max(1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def pivots_of(vectors: DataFrame, n_pivots: int, sample: int = 20_000) -> np.ndarray:
    """Reference points from a bounded sample of distinct vectors: those of the lowest hashes."""
    rows = vectors.select("e").orderBy(F.xxhash64("e"), F.col("e")).limit(min(sample, n_pivots)).collect()
    return unit([r["e"] for r in rows])


def apart(points: np.ndarray, least: float) -> np.ndarray:
    """Points of which none is near an earlier one: those inside one group of near copies would be ordered by noise."""
    free, out = np.ones(len(points), bool), []
    for i in range(len(points)):
        if free[i]:
            out.append(i)
            free &= points @ points[i] < least
    return points[out]


def depth_for(points: np.ndarray, x: np.ndarray, least: float, shared: int, depth: int) -> int:
    """The depth, `depth` at least, at which FOUND of the pairs at a cosine of exactly `least` have `shared` pivots in common; each x is paired with a point in a random direction from it."""
    side = np.random.default_rng(0).normal(size=x.shape)
    side -= (side * x).sum(1, keepdims=True) * x
    y = least * x + np.sqrt(1 - least**2) * side / np.maximum(np.linalg.norm(side, axis=1, keepdims=True), 1e-300)
    need = []
    for i in range(0, len(x), 256):
        ranks = [np.argsort(np.argsort(-(v[i : i + 256] @ points.T), axis=1, kind="stable"), axis=1) for v in (x, y)]
        need.append(np.sort(np.maximum(*ranks), axis=1)[:, min(shared, len(points)) - 1] + 1)
    return max(min(depth, len(points)), int(np.quantile(np.concatenate(need), FOUND, method="higher")))


def near_vectors(vectors: DataFrame, least: float = 0.9, shared: int = 2, depth: int = 6, n_pivots: int | None = None) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row of (vec_id, embedding).

    Links are pairs with a cosine of at least `least` that have `shared` of
    their nearest pivots in common: the `depth` nearest, or more if depth_for
    asks for them. Null and zero vectors, and those
    with null or non-finite components, have no link. Vectors of different
    lengths are compared only with their like. Equal vectors are linked.
    n_pivots follows the number of vectors from 64 to 2048. Rows that repeat
    an id are rows of their own, a null id stays null. Other columns are
    ignored; an empty table gives none.
    """
    spark, scratch = vectors.sparkSession, Scratch(vectors.sparkSession, "pivots")
    e = F.transform("embedding", lambda x: x.cast("double") + F.lit(0.0))
    ok = F.col("embedding").isNotNull() & (F.size("embedding") > 0) & F.forall(F.coalesce("embedding", F.array()), lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(F.coalesce("embedding", F.array()), lambda x: x != 0)
    rows = scratch.save(vectors.select("vec_id", F.when(F.coalesce(ok, F.lit(False)), e).alias("e")).withColumn("c", F.when(F.col("e").isNotNull(), F.xxhash64(F.size("e"), "e"))))
    sized = rows.where("c is not null").groupBy("c").agg(F.count("*").alias("m"), F.first("e").alias("e"))
    classes = scratch.save(sized.withColumn("d", F.size("e")))
    links = None
    for r in classes.groupBy("d").count().collect():
        some = classes.where(F.col("d") == r["d"])
        new = scratch.save(_links(spark, scratch, some, least, shared, depth, n_pivots or int(np.clip(r["count"] // 32, 64, 2048))))
        links = new if links is None else links.union(new)
    if links is None:
        return rows.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    sizes = classes.select("c", "m")
    both = links.select(F.col("a").alias("c"), F.col("b").alias("o")).union(links.select(F.col("b").alias("c"), F.col("a").alias("o")))
    degree = both.join(sizes.withColumnsRenamed({"c": "o", "m": "mo"}), "o").groupBy("c").agg(F.sum("mo").alias("others"))
    labels = components(spark, links, scratch).withColumnRenamed("id", "c")
    facts = scratch.save(sizes.join(degree, "c", "left").join(labels, "c", "left").select("c", (F.col("m") - 1 + F.coalesce("others", F.lit(0))).alias("n"), F.coalesce("component", "c").alias("comp")))
    out = rows.select("vec_id", "c").join(facts, "c", "left")
    low = out.where("comp is not null").groupBy("comp").agg(F.min("vec_id").alias("low"))
    out = out.join(low, "comp", "left").select("vec_id", F.coalesce("n", F.lit(0)).cast("long").alias("n_links"), F.when(F.col("comp").isNull(), F.col("vec_id")).otherwise(F.col("low")).alias("component_id"))
    return out.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def _links(spark: SparkSession, scratch: Scratch, classes: DataFrame, least: float, shared: int, depth: int, n_pivots: int) -> DataFrame:
    points = spark.sparkContext.broadcast(apart(pivots_of(classes, n_pivots), least))  # n_pivots vectors
    tried = classes.select("e").orderBy(F.xxhash64("c", F.lit(1)), F.col("c")).limit(4000).collect()
    depth = depth_for(points.value, unit([r["e"] for r in tried]), least, shared, depth)
    width = min(shared, depth)
    keys = list(combinations(range(depth), width))

    def describe(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            if not len(f):
                continue
            near = np.sort(np.argsort(-(unit(f["e"].tolist()) @ points.value.T), axis=1, kind="stable")[:, :depth], axis=1)
            code = near.astype(np.int64)
            found = np.stack([sum(code[:, i] << (12 * j) for j, i in enumerate(k)) for k in keys], 1)
            yield pd.DataFrame({"c": f["c"], "near": [row.tobytes() for row in near.astype(np.int16)], "keys": list(found)})

    described = scratch.save(classes.select("c", "e").mapInPandas(describe, "c long, near binary, keys array<long>"))
    listed = described.select("c", F.explode("keys").alias("key"))
    sizes = listed.groupBy("key").agg(F.count("*").alias("size")).where("size > 1").withColumn("blocks", F.ceil(F.col("size") / BLOCK).cast("int"))
    placed = listed.join(sizes, "key").withColumn("block", F.pmod(F.xxhash64("c", F.lit(7)), F.col("blocks")).cast("int"))
    # every pair of blocks is a group: a row goes to as many groups as there are blocks
    cells = placed.select("c", "key", "block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("o")).select("c", "key", "block", F.least("block", "o").alias("i"), F.greatest("block", "o").alias("j"))
    cells = cells.join(classes.select("c", "e").join(described.select("c", "near"), "c"), "c")

    def first_key(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The least key that two descriptions share: pairs are linked in its list alone."""
        common = np.zeros(a.shape, bool)
        for i in range(b.shape[1]):
            common |= a == b[:, i : i + 1]
        rank = np.cumsum(common, 1)
        common &= rank <= width
        return np.where(common, a.astype(np.int64) << (12 * (rank - 1) * common), 0).sum(1)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None  # the last group of a batch can go on in the next one
        for b in chain(batches, [None]):
            if b is not None and not b.num_rows:
                continue
            t = pa.Table.from_batches([b]) if rest is None and b is not None else rest if b is None else pa.concat_tables([rest, pa.Table.from_batches([b])])
            if t is None:
                return
            k = np.stack([t.column(n).to_numpy() for n in ("key", "i", "j")], 1)
            ends = [0, *(np.flatnonzero((k[1:] != k[:-1]).any(1)) + 1).tolist(), len(k)]
            if b is not None:
                rest = t.slice(ends.pop(-2) if len(ends) > 2 else 0)
                ends[-1] = len(k) - len(rest)
                if not ends[-1]:
                    continue
            c, block = t.column("c").to_numpy(), t.column("block").to_numpy()
            e = t.column("e").combine_chunks().flatten().to_numpy(zero_copy_only=False)
            x = unit(e.reshape(len(k), -1)[: ends[-1]])
            near = np.frombuffer(b"".join(t.column("near").to_pylist()), np.int16).reshape(len(k), -1)
            found = []
            for lo, hi in zip(ends, ends[1:]):
                if hi - lo < 2:
                    continue
                part = x[lo:hi]
                p, q = np.nonzero(np.triu(part @ part.T >= least, 1))
                p, q = p + lo, q + lo
                if k[lo, 1] != k[lo, 2]:
                    cross = block[p] != block[q]
                    p, q = p[cross], q[cross]
                for at in range(0, len(p), 1 << 16):
                    y, z = p[at : at + (1 << 16)], q[at : at + (1 << 16)]
                    here = first_key(near[y], near[z]) == k[lo, 0]
                    found.append((c[y[here]], c[z[here]]))
            if found:
                p, q = (np.concatenate(z) for z in zip(*found))
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(p, q)), pa.array(np.maximum(p, q))], names=["a", "b"])

    keyed = cells.select("key", "i", "j", "c", "block", "e", "near").repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")
    return keyed.mapInArrow(compare, "a long, b long")


def op8_pivots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding"))
