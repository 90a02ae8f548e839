"""Language ID by interpolated Kneser-Ney character models, one per language, with calibrated rejection."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lattica.llm.charlm import CharModel, blocks_of, fit, score_positions
from lattica.llm.common import held_out
from lattica.llm.sampling import labelled_sample


@dataclass
class LanguageModel:
    chars: CharModel
    sharpness: float  # of the posterior, per character's nat
    most_entropy: float  # texts above it are rejected


def entropies(model: CharModel, texts: list) -> tuple[np.ndarray, np.ndarray]:
    """Nats per character by class, and the characters scored; texts without letters or digits have 0 of them."""
    out, n = np.zeros((len(texts), len(model.classes))), np.zeros(len(texts), np.int64)
    for idx, parts in blocks_of(texts, model.alphabet):
        full = [(i, p) for i, p in zip(idx, parts) if len(p) > 1]
        if not full:
            continue
        # the first space of the block isn't scored, so positions shift by one
        logp = np.concatenate((np.zeros((1, len(model.classes))), score_positions(model, np.concatenate([p for _, p in full]))))
        starts = np.cumsum([0] + [len(p) for _, p in full[:-1]])
        logp[starts] = 0
        rows = [i for i, _ in full]
        n[rows] = [len(p) - 1 for _, p in full]
        out[rows] = -np.add.reduceat(logp, starts, axis=0) / n[rows][:, None]
    return out, n


def posterior(entropy: np.ndarray, n: np.ndarray, sharpness: float) -> np.ndarray:
    z = -sharpness * entropy * np.minimum(n, 200)[:, None]
    z -= z.max(1, keepdims=True)
    e = np.exp(z)
    return e / e.sum(1, keepdims=True)


def train(rows: DataFrame, order: int = 5, most_chars: int = 1_500_000, reject: float = 0.995) -> LanguageModel:
    """Fits on at most about most_chars characters a language of (doc_id, label, text); two of ten folds calibrate.

    Sharpness is the one of a grid with the lowest log loss on the calibration
    folds; the entropy above which a text is rejected is their `reject`
    quantile.
    """
    sample = labelled_sample(rows, most_chars)
    sample = {c: t for c, t in sample.items() if t}
    chars = fit({c: [x for f, x in t if f > 1] or [x for _, x in t] for c, t in sample.items()}, order, shared=False)
    texts = [(i, x) for i, c in enumerate(chars.classes) for f, x in sample[c] if f <= 1]
    best, limit = 1.0, float("inf")
    if texts:
        e, n = entropies(chars, [x for _, x in texts])
        y, some = np.array([i for i, _ in texts]), n > 0
        if some.any():
            loss = {s: -np.log(posterior(e[some], n[some], s)[np.arange(some.sum()), y[some]] + 1e-9).mean() for s in (0.05, 0.1, 0.2, 0.5, 1.0)}
            best, limit = min(loss, key=loss.get), float(np.quantile(e[some].min(1), reject))
    return LanguageModel(chars, best, limit)


def identify(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """(doc_id, lang_pred, score, entropy, rejected) for every row of docs.

    A null text or one without a letter is `und` with score 0 and rejected;
    so is everything when no language was learned. Ties go to the first
    language by name. A rejected text keeps its nearest language in
    lang_pred. Other columns of docs are ignored; an empty table gives none.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded by train's most_chars

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for b in batches:
            texts = [t if ok else None for t, ok in zip(b.column("text").to_pylist(), b.column("letters").to_pylist())]
            e, n = entropies(m.chars, texts) if m.chars.classes else (None, np.zeros(len(texts)))
            some = n > 0
            pred, score, low = np.full(len(texts), "und", object), np.zeros(len(texts)), np.full(len(texts), np.nan)
            if some.any():
                p = posterior(e[some], n[some], m.sharpness)
                best = np.argmin(e[some], axis=1)
                pred[some] = np.array(m.chars.classes, object)[best]
                score[some], low[some] = p[np.arange(len(best)), best], e[some].min(1)
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), pa.array(pred, pa.string()), pa.array(score), pa.array(low, mask=np.isnan(low)), pa.array(~some | (low > m.most_entropy))],
                names=["doc_id", "lang_pred", "score", "entropy", "rejected"],
            )

    rows = docs.select("doc_id", "text", F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)).alias("letters"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, lang_pred string, score double, entropy double, rejected boolean")


def op9_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row of documents with its language, score and held_out; see identify."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    fold = held_out(F.col("doc_id"), 4)
    model = train(docs.where(fold != 2).select("doc_id", F.col("lang").alias("label"), "text"))
    return identify(docs, model).withColumn("held_out", fold == 2)
