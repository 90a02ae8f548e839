"""Bounded samples of labelled rows for fitting, drawn by id hash."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattica.llm.common import id_hash, small_join


def labelled_sample(rows: DataFrame, most_chars: int, most_classes: int = 65_536, labels: DataFrame | None = None) -> dict:
    """Whole texts by label: {label: [(fold 0 to 9, text)]}.

    rows has (doc_id, label, text), or (doc_id, text) with (doc_id, label) in
    labels. Per label, documents come by id hash until about most_chars
    characters are expected; a label with fewer gives all its texts. The
    driver holds at most most_classes labels; more are an error. Null
    labels and texts are left out. Labels meet lengths first; texts are only
    joined with the picked ids, whose number the characters bound.
    """
    h = id_hash(F.col("doc_id"), 40)
    slim = rows.where("text is not null").select("doc_id", F.length("text").alias("n"), *(["label"] if labels is None else []))
    slim = (slim if labels is None else slim.join(labels, "doc_id")).where("label is not null")
    sums = slim.groupBy("label").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "label").limit(most_classes + 1).collect()
    if len(sums) > most_classes:
        raise ValueError(f"more than {most_classes} labels")
    picked = F.lit(False)
    for r in sums:
        part = min(1.0, most_chars / max(1, r["n"]))
        picked = picked | ((F.col("label") == F.lit(r["label"])) & (h < int(part * (1 << 40)) + (part == 1.0)))
    found: dict = {r["label"]: [] for r in sums}
    if labels is None:
        texts = rows.where("text is not null").where(picked)
    else:
        texts = small_join(rows.where("text is not null"), slim.where(picked).select("doc_id", "label"), ["doc_id"])
    for r in texts.select("label", "text", F.conv(F.substring(F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 20, 3), 16, 10).cast("int").alias("f")).toLocalIterator():
        found[r["label"]].append((r["f"] % 10, r["text"]))
    for texts in found.values():
        texts.sort()
    return found
