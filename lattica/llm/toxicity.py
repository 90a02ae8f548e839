"""Toxicity by class-conditional Kneser-Ney models with shared backoff counts.

A passage's toxic and ordinary log likelihoods, divided by its length, are
compared; a text is as toxic as its most toxic passage of PASSAGE words. That
difference is the only evidence; offset and slope of a logistic curve bring it
to 0 to 1, fitted on folds that the models haven't seen. Characters are
modelled within words, so that spellings never seen still share what they have
in common; counts below the longest n-gram are shared by both classes.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lattica.llm.charlm import SPACE, CharModel, blocks_of, fit, score_positions
from lattica.llm.common import held_out, pieces
from lattica.llm.sampling import labelled_sample

#: Words of a passage.
PASSAGE = 3
#: Characters scored at once: some 60 bytes each lie in a worker meanwhile.
BLOCK = 1 << 18


@dataclass
class ToxicModel:
    chars: CharModel | None
    slope: float
    offset: float
    prior: float


def differences(model: CharModel, texts: list) -> np.ndarray:
    """Per text: the largest length-normalised log likelihood difference of its passages; a text of fewer words is one passage. Without words, 0."""
    out = np.zeros(len(texts))
    for idx, parts in blocks_of(texts, model.alphabet, BLOCK):
        full = [(i, p) for i, p in zip(idx, parts) if len(p) > 1]
        if not full:
            continue
        ids = np.concatenate([p for _, p in full])
        logp = score_positions(model, ids)
        diff = np.concatenate(([0.0], (logp[:, 1] - logp[:, 0]).astype(np.float64)))
        heads = np.flatnonzero(ids == SPACE)
        diff[heads] = 0
        upto = np.concatenate(([0.0], np.cumsum(np.add.reduceat(diff, heads))))
        at = np.append(heads, len(ids))
        ends = np.searchsorted(heads, np.cumsum([len(p) for _, p in full]))
        first = 0
        for (i, _), stop in zip(full, ends):
            k = min(PASSAGE, stop - first)
            a, b = slice(first, stop - k + 1), slice(first + k, stop + 1)
            out[i] = ((upto[b] - upto[a]) / (at[b] - at[a])).max()
            first = stop
    return out


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, steps: int = 40) -> np.ndarray:
    x = np.column_stack((x, np.ones(len(x))))
    w = np.zeros(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (p - y) + ridge * np.append(w[:-1], 0)
        hess = (x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w))
        w -= np.linalg.solve(hess, grad)
    return w


def train(rows: DataFrame, labels: DataFrame, order: int = 7, most_chars: int = 5_000_000) -> ToxicModel:
    """Fits on at most about most_chars characters of either label of (doc_id, text) and (doc_id, label); four of ten folds calibrate.

    Without two labels, every score is the share of label 1 (0.0 if no label is known).
    """
    sample = labelled_sample(rows, most_chars, 2, labels)
    sizes = {c: len(sample.get(c, [])) for c in (0, 1)}
    prior = sizes[1] / max(1, sum(sizes.values()))
    held = [(c, t) for c in (0, 1) for f, t in sample.get(c, []) if f <= 3]
    texts = {c: [t for f, t in sample.get(c, []) if f > 3] for c in (0, 1)}
    if not (texts[0] and texts[1] and len({c for c, _ in held}) == 2):
        return ToxicModel(None, 0.0, 0.0, prior)
    chars = fit(texts, order, shared=True)
    x, y = differences(chars, [t for _, t in held]), np.array([c for c, _ in held], float)
    mean, scale = x.mean(), x.std() + 1e-9
    w = logistic(((x - mean) / scale)[:, None], y)
    return ToxicModel(chars, float(w[0] / scale), float(w[1] - w[0] * mean / scale), prior)


def scored(batches: Iterator[pa.RecordBatch], model: ToxicModel, inside: str | None = None) -> Iterator[pa.RecordBatch]:
    """The batches, a few rows at a time, with `score` and `predicted`; see score_rows."""
    for b in pieces(batches):
        if model.chars is None:
            p = np.full(b.num_rows, model.prior)
        else:
            text = b.column("text") if inside is None else pc.struct_field(b.column(inside), "text")
            p = 1 / (1 + np.exp(-np.clip(differences(model.chars, text.to_pylist()) * model.slope + model.offset, -30, 30)))
        yield pa.RecordBatch.from_arrays([*b.columns, pa.array(p), pa.array((p >= 0.5).astype(np.int32))], names=[*b.schema.names, "score", "predicted"])


def score_rows(docs: DataFrame, model: ToxicModel, inside: str | None = None) -> DataFrame:
    """Every row and column of docs with `score` (0 to 1) and `predicted` (score >= 0.5).

    A null or empty text is scored as one without any evidence. Columns of
    docs of these two names are replaced. An empty table gives none. inside:
    the struct column that has the text, which so is sent once.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded by train's most_chars
    docs = docs.drop("score", "predicted")

    from pyspark.sql.types import DoubleType, IntegerType, StructType

    schema = StructType([*docs.schema.fields]).add("score", DoubleType()).add("predicted", IntegerType())
    return docs.mapInArrow(lambda batches: scored(batches, shared.value, inside), schema)


def trained_on(docs: DataFrame, labels: DataFrame) -> ToxicModel:
    """The model of the labelled rows outside the held-out fifth."""
    mine = labels.where(held_out(F.col("doc_id"), 5) != 0).groupBy("doc_id").agg(F.max("toxic").alias("label"))
    return train(docs.where(held_out(F.col("doc_id"), 5) != 0).select("doc_id", "text"), mine)


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row of documents; see train and score_rows."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    model = trained_on(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return score_rows(docs, model).select("doc_id", (held_out(F.col("doc_id"), 5) == 0).alias("held_out"), "score", "predicted")
