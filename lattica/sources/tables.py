"""Tables in the shared folder, and a store of artefacts by name."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir; where that is unset, one in the warehouse."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    return at.rstrip("/") if at else spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/lattica-scratch"


def saved(df: DataFrame) -> DataFrame:
    """Writes a table and reads it again: lineage is cut, and lost executors lose nothing."""
    path = f"{shared_dir(df.sparkSession)}/core-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class Storage:
    """Tables by name under a folder: set, get, has, delete, clear, child and find; `memory` keeps views instead of files."""

    def __init__(self, spark: SparkSession, root: str, memory: bool = False):
        self.spark, self.root, self.memory = spark, root.rstrip("/"), memory
        self._views: dict[str, DataFrame] = {}

    def _fs(self, path: str):
        p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return p, p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def set(self, name: str, df: DataFrame, form: str = "parquet") -> None:
        if self.memory:
            self._views[name] = df
        else:
            df.write.mode("overwrite").format(form).save(f"{self.root}/{name}")

    def get(self, name: str, form: str = "parquet") -> DataFrame | None:
        """The table, or None if there is none of this name."""
        if self.memory:
            return self._views.get(name)
        return self.spark.read.format(form).load(f"{self.root}/{name}") if self.has(name) else None

    def has(self, name: str) -> bool:
        if self.memory:
            return name in self._views
        p, fs = self._fs(f"{self.root}/{name}")
        return fs.exists(p)

    def delete(self, name: str) -> None:
        self._views.pop(name, None)
        if not self.memory:
            p, fs = self._fs(f"{self.root}/{name}")
            fs.delete(p, True)

    def clear(self) -> None:
        self._views.clear()
        if not self.memory:
            p, fs = self._fs(self.root)
            fs.delete(p, True)

    def child(self, name: str) -> Storage:
        return Storage(self.spark, f"{self.root}/{name}", self.memory)

    def find(self, pattern: str) -> list[str]:
        """Names under the folder that a regular expression matches, sorted."""
        import re

        if self.memory:
            return sorted(n for n in self._views if re.search(pattern, n))
        p, fs = self._fs(self.root)
        if not fs.exists(p):
            return []
        return sorted(s.getPath().getName() for s in fs.listStatus(p) if re.search(pattern, s.getPath().getName()))


def emit(df: DataFrame, root: str, name: str, forms: tuple[str, ...] = ("parquet",)) -> None:
    """Writes a result under its name as parquet, csv (nested columns as JSON) or json lines."""
    for form in forms:
        out = df
        if form == "csv":
            nested = [c for c, kind in df.dtypes if kind.startswith(("array", "map", "struct"))]
            out = df.withColumns({c: F.to_json(c) for c in nested})
        out.write.mode("overwrite").options(header=True).format(form).save(f"{root}/{name}.{form}")


def snapshot_rows(df: DataFrame, root: str, name: str, text: str, key: str) -> None:
    """One folder of text files per key, named by it."""
    df.select(F.col(key).alias("key"), F.col(text).cast("string").alias("value")).write.mode("overwrite").partitionBy("key").text(f"{root}/{name}")


def graphml(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(part, id, line): the lines of a GraphML file, nodes before edges; sort by part and id to write one."""
    esc = lambda c: F.replace(F.replace(F.replace(F.col(c).cast("string"), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit('"'), F.lit("&quot;"))
    n = nodes.select(F.lit(1).alias("part"), F.col("node").cast("string").alias("id"), F.concat(F.lit('<node id="'), esc("node"), F.lit('"/>')).alias("line"))
    e = edges.select(F.lit(2).alias("part"), F.concat_ws("|", "src", "dst").alias("id"), F.concat(F.lit('<edge source="'), esc("src"), F.lit('" target="'), esc("dst"), F.lit('"/>')).alias("line"))
    return n.unionByName(e)


class Cache:
    """Answers by key: a table (key, value) that keeps what a model has been asked already."""

    def __init__(self, storage: Storage, name: str = "cache"):
        self.storage, self.name = storage, name

    def split(self, asked: DataFrame, text: str) -> tuple[DataFrame, DataFrame]:
        """asked with key and value where known, and the rows still to be asked."""
        keyed = asked.withColumn("key", F.md5(F.coalesce(F.col(text), F.lit(""))))
        known = self.storage.get(self.name)
        if known is None:
            return keyed.withColumn("value", F.lit(None).cast("string")).limit(0), keyed
        return keyed.join(known, "key"), keyed.join(known.select("key"), "key", "left_anti")

    def add(self, answers: DataFrame) -> None:
        new, known = answers.select("key", "value").dropDuplicates(["key"]), self.storage.get(self.name)
        both = new if known is None else known.unionByName(new.join(known.select("key"), "key", "left_anti"))
        self.storage.set(self.name, saved(both))
