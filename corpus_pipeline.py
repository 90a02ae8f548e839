"""The corpus pipeline: toxicity, near duplicates, decontamination, mixing, sharding.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, written as
Parquet and read again as the next one's docs. A stage carries a document's
columns in one struct, so no name of its own can meet one of theirs. Nulls,
empty tables, repeated ids and extra columns are as the operators state.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lattica.llm.common import Scratch, small_join
from lattica.llm.decontaminate import leaking_texts, text_key
from lattica.llm.jaccard import jaccard_members
from lattica.llm.mixing import mix
from lattica.llm.sharding import kd_shards
from lattica.llm.toxicity import score_rows, trained_on

#: SQL can't express the fitted model of the first stage.
ORACLE_SQL = None


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the model calls toxic go; null and empty texts are scored as texts without evidence."""
    model = trained_on(docs.select("doc_id", "text"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return score_rows(docs.select(F.struct("*").alias("row")), model, "row").where("predicted = 0").select("row.*")


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group one row stays, that of the smallest id (a null id only if no other is there); rows without words all stay.

    Rows are told apart by their place in docs, which is a table that gives
    the same rows in the same order whenever it is read.
    """
    placed = docs.withColumn("__place", F.monotonically_increasing_id())
    key = F.struct(F.col("doc_id").isNull().alias("unnamed"), F.col("doc_id"), F.col("__place"))
    classes = jaccard_members(placed.select(key.alias("key"), "text"), "key")
    gone = classes.where("n_shingles > 0 and doc_id <> component_id").select(F.col("doc_id.__place").alias("__place"))
    return placed.join(gone, "__place", "left_anti").drop("__place")


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a passage of a benchmark item go."""
    found = leaking_texts(docs.select("text"), spark.read.parquet(f"{sf_dir}/benchmark.parquet")).select("key").distinct()
    found = Scratch(spark, "leaks").save(found)  # counted and joined, but found once
    return small_join(docs.select(F.struct("*").alias("row"), text_key(F.col("text")).alias("key")), found, ["key"], "left_anti").select("row.*")


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A document stays as often as the mix takes it, and once if it has no words to take."""
    mixed = mix(docs.select(F.struct("*").alias("row"), "doc_id", "text", "source"))
    times = F.when(F.col("size") == 0, 1).otherwise(F.col("copies")).cast("int")
    return mixed.select("row", times.alias("times")).where("times > 0").select("row", F.explode(F.sequence(F.lit(1), F.col("times")))).select("row.*")


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, size, text_crc32, shard, slot)."""
    return kd_shards(docs.select("doc_id", "text", "source", "lang"))


STAGES = [("toxicity", drop_toxic), ("ngram_jaccard", drop_near_copies), ("decontaminate", drop_leaks), ("mixing", mix_sources), ("sharding", shard)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents."""
    scratch = Scratch(spark, "pipeline")
    docs, last = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = scratch.save(docs)
            if last is not None:
                scratch.drop(last)
            last = docs
    return docs
