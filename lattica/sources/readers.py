"""Readers of documents, corpora, graphs and vector files."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lattica.functions.text import clean_unicode
from lattica.operators.relational import clean_strings, last_wins, map_ids


def load_input(spark: SparkSession, path: str, kind: str, **how) -> DataFrame:
    """Documents from text, csv or json files."""
    return {"text": read_text, "csv": read_csv, "json": read_corpus}[kind](spark, path, **how)


def read_text(spark: SparkSession, path: str, pattern: str | None = None, groups: tuple[str, ...] = ()) -> DataFrame:
    """(id, title, text, groups): one row per file; pattern picks paths, its groups become columns; the id is the md5 of all columns. Missing files are skipped."""
    files = spark.read.option("ignoreMissingFiles", True).text(path, wholetext=True, recursiveFileLookup=True).select(F.input_file_name().alias("__path"), F.col("value").alias("text"))
    if pattern:
        files = files.where(F.col("__path").rlike(pattern))
    named = {g: F.regexp_extract("__path", pattern, i + 1) for i, g in enumerate(groups)}
    rows = files.withColumns({"title": F.element_at(F.split("__path", "/"), -1), **named}).drop("__path")
    return rows.select(F.md5(F.concat_ws("", "text", "title", *groups)).alias("id"), "title", "text", *groups)


def read_csv(spark: SparkSession, path: str, encoding: str = "ISO-8859-1", text: str | None = None, title: str | None = None, source: str | None = None, timestamp: str | None = None, timestamp_format: str | None = None) -> DataFrame:
    """Rows of csv files with text, title and source columns named so, parts of the timestamp, and an md5 id where none is there."""
    rows = spark.read.csv(path, header=True, encoding=encoding, multiLine=True, escape='"')
    own = rows.columns
    rows = rows.withColumns({to: F.col(c) for to, c in (("text", text), ("title", title), ("source", source)) if c and c != to})
    if timestamp:
        at = F.try_to_timestamp(timestamp, F.lit(timestamp_format)) if timestamp_format else F.try_to_timestamp(timestamp)
        rows = rows.withColumns({p: getattr(F, p)(at) for p in ("year", "month", "dayofmonth", "hour", "minute", "second")})
    return rows if "id" in own else rows.withColumn("id", F.md5(F.concat_ws("", *own)))


def read_corpus(spark: SparkSession, path: str) -> DataFrame:
    """(title, context) of JSON lines."""
    return spark.read.schema("title string, context string").json(path)


def read_questions(spark: SparkSession, path: str) -> DataFrame:
    """Questions of JSON lines."""
    return spark.read.schema("id string, question string, options string, answer string, answer_idx string").json(path)


def read_graph(spark: SparkSession, entities: str, relationships: str, form: str = "parquet") -> tuple[DataFrame, DataFrame]:
    """Cleaned entities and relationships; head_id and tail_id are looked up by title where absent, the last of repeated titles wins."""
    e, r = (clean_strings(spark.read.options(header=True).format(form).load(p), clean_unicode) for p in (entities, relationships))
    if not {"head_id", "tail_id"} <= set(r.columns):
        ids = last_wins(e.select("title", "id"), "title", [F.col("id")])
        for end, to in (("source", "head_id"), ("target", "tail_id")):
            r = map_ids(r, end, ids, "title", "id", to)
    return e, r


def read_vectors(spark: SparkSession, path: str, kind: str = "fvecs") -> DataFrame:
    """(id, embedding) of fvecs, ivecs or bvecs files: a length, then so many components. Each file is read by one task."""
    width, dtype = {"fvecs": (4, "<f4"), "ivecs": (4, "<i4"), "bvecs": (1, "u1")}[kind]

    def run(frames):
        for f in frames:
            for raw in f["content"]:
                if not raw:
                    continue
                d = int(np.frombuffer(raw[:4], "<i4")[0])
                rows = np.frombuffer(raw, np.uint8).reshape(-1, 4 + width * d)
                v = np.ascontiguousarray(rows[:, 4:]).view(dtype).astype(np.float32)
                yield pd.DataFrame({"id": np.arange(len(v)), "embedding": list(v)})

    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(run, "id long, embedding array<float>")


def write_index(communities: DataFrame, entities: DataFrame, relationships: DataFrame, root: str) -> None:
    """An index as parquet tables; vectors lie by level, so that a search reads the levels it asks for."""
    communities.write.mode("overwrite").partitionBy("level").parquet(f"{root}/communities")
    entities.write.mode("overwrite").parquet(f"{root}/entities")
    relationships.write.mode("overwrite").parquet(f"{root}/relationships")


def read_index(spark: SparkSession, root: str) -> dict[str, DataFrame]:
    return {name: spark.read.parquet(f"{root}/{name}") for name in ("communities", "entities", "relationships")}
