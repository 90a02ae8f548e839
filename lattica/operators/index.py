"""Vector indexes as tables: k-means cells, product codes, random hyperplanes, transforms, and a factory language."""

from __future__ import annotations

import re
from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lattica.operators.relational import hash_order
from lattica.operators.vector import _matrix, _scores, assign, centroids, distance, knn, normalised
from lattica.sources.tables import saved


def kmeans(base: DataFrame, k: int, rounds: int = 25, seed: int = 1234, weight: str | None = None) -> DataFrame:
    """(centroid, embedding) of k cells: seeded hash order picks the first centres, then means until nothing moves or rounds are over.

    k centres go with the tasks; each sends its sums by centre and component.
    """
    rows = base.where("embedding is not null").select("id", "embedding", (F.col(weight).cast("double") if weight else F.lit(1.0)).alias("w"))
    first = rows.orderBy(hash_order("id", seed), "id").limit(k)
    centres = saved(first.select((F.row_number().over(Window.orderBy("id")) - 1).alias("centroid"), F.transform("embedding", lambda x: x.cast("double")).alias("embedding")))  # k rows
    for _ in range(rounds):
        few = centres.orderBy("centroid").toPandas()
        names, c = few["centroid"].to_numpy(), np.array(few["embedding"].tolist(), np.float64)

        def sums(frames, names=names, c=c):
            total, weights = np.zeros(c.shape), np.zeros(len(c))
            for f in frames:
                for lo in range(0, len(f), 2048):
                    part = f.slice(lo, 2048)
                    x, w = _matrix(part.column("embedding")).astype(np.float64), part.column("w").to_numpy(zero_copy_only=False)
                    s = _scores(c, x, "l2", 3.0)
                    of = np.where(np.isnan(s), np.inf, s).argmin(0)
                    for j in np.unique(of):
                        total[j] += (w[of == j, None] * x[of == j]).sum(0)
                        weights[j] += w[of == j].sum()
            at = np.repeat(np.flatnonzero(weights), c.shape[1])
            p = np.tile(np.arange(c.shape[1]), len(at) // max(1, c.shape[1]))
            yield pa.RecordBatch.from_arrays([pa.array(names[at], pa.int32()), pa.array(p, pa.int32()), pa.array(total[at, p]), pa.array(weights[at])], ["centroid", "p", "x", "w"])

        if not len(few):
            return centres
        parts = rows.where("size(embedding) > 0").select("embedding", "w").mapInArrow(sums, "centroid int, p int, x double, w double")
        means = parts.groupBy("centroid", "p").agg((F.sum("x") / F.sum("w")).alias("x"))
        new = means.groupBy("centroid").agg(F.transform(F.sort_array(F.collect_list(F.struct("p", "x"))), lambda s: s.x).alias("embedding"))
        new = saved(new.unionByName(centres.join(new, "centroid", "left_anti")))  # an empty cell keeps its centre
        moved = new.join(centres.withColumnRenamed("embedding", "o"), "centroid").agg(F.max(distance("embedding", "o"))).first()[0]
        centres = new
        if (moved or 0.0) < 1e-9:
            break
    return centres


def two_level_kmeans(base: DataFrame, k1: int, k2: int, **how) -> DataFrame:
    """(centroid, embedding): k2 cells inside each of k1."""
    outer = kmeans(base, k1, **how)
    of = saved(base.join(assign(base, outer).select("id", "centroid"), "id"))
    out = None
    for c in range(k1):
        inner = kmeans(of.where(F.col("centroid") == c), k2, **how).withColumn("centroid", F.col("centroid") + c * k2)
        out = inner if out is None else out.unionByName(inner)
    return out


def ivf_cells(base: DataFrame, centres: DataFrame) -> DataFrame:
    """base with the cell each row lies in; write it partitioned by cell so that a search reads its cells only."""
    return base.join(assign(base, centres).select("id", F.col("centroid").alias("cell")), "id")


def ivf_search(base: DataFrame, centres: DataFrame, queries: DataFrame, k: int, nprobe: int = 1) -> DataFrame:
    """(qid, id, score, rank) by L2 among the nprobe nearest cells of each query."""
    cells = base if "cell" in base.columns else ivf_cells(base, centres)
    probes = knn(centres.select(F.col("centroid").cast("long").alias("id"), "embedding"), queries, nprobe).select("qid", F.col("id").alias("cell"))
    asked = queries.join(probes.groupBy("qid").agg(F.sort_array(F.collect_list(F.col("cell").cast("long"))).alias("keys")), "qid")
    return knn(cells.select("id", "embedding", F.array(F.col("cell").cast("long")).alias("keys")), asked.select("qid", "embedding", "keys"), k)


def pq_train(base: DataFrame, parts: int, codes: int = 16, rounds: int = 5, sample: int = 10_000) -> np.ndarray:
    """Codebooks (parts, codes, width) of a product quantiser, fitted on at most `sample` rows by seeded hash order."""
    rows = base.where("embedding is not null").orderBy(hash_order("id", 1), "id").limit(sample).select("embedding").toPandas()
    x = np.array(rows["embedding"].tolist(), np.float64)
    books = []
    for part in np.split(x, parts, axis=1):
        c = part[:: max(1, len(part) // codes)][:codes].copy()
        for _ in range(rounds):
            of = ((part[:, None] - c[None]) ** 2).sum(2).argmin(1)
            for j in range(len(c)):
                if (of == j).any():
                    c[j] = part[of == j].mean(0)
        books.append(c)
    return np.stack(books)


def pq_encode(base: DataFrame, books: np.ndarray) -> DataFrame:
    """(id, codes): the nearest codeword of every part; the books (parts x codes x width numbers) go with the task."""
    shared = base.sparkSession.sparkContext.broadcast(books)

    def run(frames):
        b = shared.value
        for f in frames:
            if len(f):
                x = np.stack(np.split(np.array(f["embedding"].tolist(), np.float64), len(b), axis=1))
                codes = np.stack([((p[:, None] - c[None]) ** 2).sum(2).argmin(1) for p, c in zip(x, b)], 1)
                yield pd.DataFrame({"id": f["id"], "codes": list(codes.astype(np.int32))})

    return base.where("embedding is not null").select("id", "embedding").mapInPandas(run, "id long, codes array<int>")


def pq_search(base: DataFrame, books: np.ndarray, queries: DataFrame, k: int, refine: int = 1) -> DataFrame:
    """(qid, id, score, rank): k * refine nearest by summed table distances of codes, ranked again by exact L2."""
    shared = base.sparkSession.sparkContext.broadcast(books)

    def decoded(frames):
        b = shared.value
        for f in frames:
            for lo in range(0, len(f), 2048):
                part = f.slice(lo, 2048)
                x = np.split(_matrix(part.column("embedding")).astype(np.float64), len(b), axis=1)
                flat = np.concatenate([c[((p[:, None] - c[None]) ** 2).sum(2).argmin(1)] for p, c in zip(x, b)], 1)
                yield pa.RecordBatch.from_arrays([part.column("id"), pa.ListArray.from_arrays(np.arange(len(part) + 1, dtype=np.int32) * flat.shape[1], flat.ravel())], ["id", "embedding"])

    coded = base.where("embedding is not null and size(embedding) > 0").select("id", "embedding").mapInArrow(decoded, "id long, embedding array<double>")
    first = knn(coded, queries, k * refine).select("qid", "id")
    exact = first.join(base.select("id", "embedding"), "id").join(queries.select("qid", F.col("embedding").alias("q")), "qid").select("qid", "id", distance("embedding", "q").alias("score"))
    return exact.withColumn("rank", F.row_number().over(Window.partitionBy("qid").orderBy("score", "id"))).where(F.col("rank") <= k)


def lsh_search(base: DataFrame, queries: DataFrame, k: int, bits: int = 8, tables: int = 4, seed: int = 1) -> DataFrame:
    """(qid, id, score, rank) by cosine among rows that share a table's sign pattern with the query."""
    d = base.where("embedding is not null").select(F.size("embedding").alias("d")).first()
    if d is None:
        return knn(base, queries, k, "cosine")
    planes = np.random.default_rng(seed).normal(size=(tables, bits, d["d"]))

    def keyed(df: DataFrame, name: str) -> DataFrame:
        def run(frames):
            for f in frames:
                for lo in range(0, len(f), 2048):
                    part = f.slice(lo, 2048)
                    s = np.einsum("tbd,nd->ntb", planes, _matrix(part.column("embedding")).astype(np.float64)) > 0
                    codes = (s * (1 << np.arange(bits))).sum(2) + (np.arange(tables) << bits)
                    yield pa.RecordBatch.from_arrays([part.column(name), part.column("embedding"), pa.ListArray.from_arrays(np.arange(len(part) + 1, dtype=np.int32) * tables, codes.astype(np.int64).ravel())], [name, "embedding", "keys"])

        rows = df.where("embedding is not null and size(embedding) > 0").select(F.col(name).cast("long").alias(name), "embedding")
        return rows.mapInArrow(run, f"{name} long, embedding {df.schema['embedding'].dataType.simpleString()}, keys array<long>")

    return knn(keyed(base, "id"), keyed(queries, "qid"), k, "cosine")


def diverse(candidates: DataFrame, most: int) -> DataFrame:
    """(qid, id, rank) of (qid, id, score, embedding): nearest first, one is kept only if no kept one is nearer to it than the query, at most `most` a query.

    A query's candidates are few (a search's k), and one group is one query.
    """

    def prune(f: pd.DataFrame) -> pd.DataFrame:
        f = f.sort_values(["score", "id"])
        x, s, kept = np.array(f["embedding"].tolist(), np.float64), f["score"].to_numpy(), []
        for i in range(len(f)):
            if len(kept) < most and all(((x[i] - x[j]) ** 2).sum() >= s[i] for j in kept):
                kept.append(i)
        out = f.iloc[kept][["qid", "id"]].copy()
        out["rank"] = np.arange(1, len(out) + 1)
        return out

    return candidates.groupBy("qid").applyInPandas(prune, "qid long, id long, rank int")


def pca(base: DataFrame, k: int) -> DataFrame:
    """(id, embedding) on the first k principal axes, signs set so that an axis' largest weight is positive."""
    parts = base.where("embedding is not null")
    d = parts.select(F.size("embedding").alias("d")).first()
    if d is None:
        return base.select("id", "embedding").limit(0)
    d = d["d"]

    def sums(frames):
        n, s, c = 0, np.zeros(d), np.zeros((d, d))
        for f in frames:
            if len(f):
                x = np.array(f["embedding"].tolist(), np.float64)
                n, s, c = n + len(x), s + x.sum(0), c + x.T @ x
        yield pd.DataFrame({"i": np.arange(d * d + d + 1), "v": np.concatenate(([n], s, c.ravel()))})

    flat = np.zeros(d * d + d + 1)
    for r in parts.select("embedding").mapInPandas(sums, "i int, v double").groupBy("i").agg(F.sum("v").alias("v")).toLocalIterator():  # d x d sums
        flat[r["i"]] = r["v"]
    mean = flat[1 : d + 1] / flat[0]
    _, axes = np.linalg.eigh(flat[d + 1 :].reshape(d, d) / flat[0] - np.outer(mean, mean))
    axes = axes[:, ::-1][:, :k]
    axes = axes * np.sign(axes[np.abs(axes).argmax(0), np.arange(axes.shape[1])])
    return transformed(base, axes.T, mean)


def transformed(base: DataFrame, matrix: np.ndarray, mean: np.ndarray | None = None) -> DataFrame:
    """(id, embedding): a linear map of the (centred) vectors."""
    shift = np.zeros(matrix.shape[1]) if mean is None else mean

    def run(frames):
        for f in frames:
            if len(f):
                yield pd.DataFrame({"id": f["id"], "embedding": list((np.array(f["embedding"].tolist(), np.float64) - shift) @ matrix.T)})

    return base.where("embedding is not null").select("id", "embedding").mapInPandas(run, "id long, embedding array<double>")


def random_rotation(base: DataFrame, seed: int = 1) -> DataFrame:
    """(id, embedding) turned by a seeded orthonormal matrix."""
    d = base.where("embedding is not null").select(F.size("embedding").alias("d")).first()
    if d is None:
        return base.select("id", "embedding").limit(0)
    q, _ = np.linalg.qr(np.random.default_rng(seed).normal(size=(d["d"], d["d"])))
    return transformed(base, q)


def centred(base: DataFrame) -> DataFrame:
    m = F.broadcast(centroids(base.withColumn("__all", F.lit(0)), "__all").select(F.col("embedding").alias("m")))
    return base.where("embedding is not null").crossJoin(m).select("id", F.zip_with("embedding", "m", lambda x, y: x.cast("double") - y).alias("embedding"))


def factory(description: str) -> Callable[[DataFrame, DataFrame, int], DataFrame]:
    """A search (base, queries, k) from a description: comma-separated parts out of L2norm, PCAn, RR, Flat, IVFn, PQm, LSH, and Rn at the end for refining by n times k."""
    parts = description.split(",")

    def search(base: DataFrame, queries: DataFrame, k: int) -> DataFrame:
        q = queries.withColumnRenamed("qid", "id")
        refine = next((int(p[1:]) for p in parts if re.fullmatch(r"R\d+", p)), 1)
        for p in parts:
            change = None
            if p == "L2norm":
                change = lambda df: df.select("id", normalised(F.col("embedding")).alias("embedding"))
            elif p == "RR":
                change = random_rotation
            elif m := re.fullmatch(r"PCA(\d+)", p):
                both = pca(base.select("id", "embedding", F.lit(0).alias("side")).unionByName(q.select((-F.col("id") - 1).alias("id"), "embedding", F.lit(1).alias("side"))), int(m[1]))
                base, q = both.where("id >= 0"), both.where("id < 0").withColumn("id", -F.col("id") - 1)
            elif m := re.fullmatch(r"IVF(\d+)", p):
                return ivf_search(base, kmeans(base, int(m[1])), q.withColumnRenamed("id", "qid"), k, nprobe=refine)
            elif m := re.fullmatch(r"PQ(\d+)", p):
                return pq_search(base, pq_train(base, int(m[1])), q.withColumnRenamed("id", "qid"), k, refine)
            elif p == "LSH":
                return lsh_search(base, q.withColumnRenamed("id", "qid"), k)
            elif not re.fullmatch(r"Flat|R\d+", p):
                raise ValueError(f"unknown part of an index description: {p}")
            if change:
                base, q = change(base), change(q)
        return knn(base, q.withColumnRenamed("id", "qid"), k)

    return search
