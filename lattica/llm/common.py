"""What the training-data operators share: tokens, hashes, tables in the shared folder, checked broadcasts, components.

Words are maximal runs of characters other than space and U+0009 to U+000D;
only A-Z are lower-cased. Both rules are plain ASCII, so they hold alike in
Java, in Python and in DuckDB.
"""

from __future__ import annotations

import string
import uuid
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructField, StructType

#: Rows of a table that may be broadcast; larger ones are joined by a shuffle.
BROADCAST_ROWS = 100_000
BLANKS = "\t\n\x0b\x0c\r"


# ---------------------------------------------------------------- expressions


def ascii_lower(text: Column) -> Column:
    return F.translate(text, string.ascii_uppercase, string.ascii_lowercase)


def words(text: Column) -> Column:
    """The words of a text as an array; null gives an empty array."""
    spaced = F.translate(F.coalesce(text, F.lit("")), BLANKS, " " * len(BLANKS))
    return F.array_remove(F.split(spaced, " "), "")


def n_words(text: Column) -> Column:
    return F.size(words(text)).cast("long")


def id_hash(value: Column, bits: int = 48) -> Column:
    """The first bits of the md5 of a value's text; null counts as the empty text."""
    text = F.coalesce(value.cast("string"), F.lit(""))
    return F.conv(F.substring(F.md5(text), 1, bits // 4), 16, 10).cast("long")


def null_safe_key(value: Column) -> Column:
    """A text key that tells null from every text."""
    return F.when(value.isNull(), F.lit("")).otherwise(F.concat(F.lit("="), value.cast("string")))


def held_out(doc_id: Column, modulus: int) -> Column:
    """crc32 of the id's text modulo modulus; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % modulus


# ---------------------------------------------------------------- shared tables


def shared_dir(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir; where that is unset, one in the warehouse, which all executors share as well."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    return at.rstrip("/") if at else spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/lattica-scratch"


#: Spark deletes the shuffle files of a statement as soon as it ends.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


class Scratch:
    """Parquet tables in the shared folder: they cut lineage and outlive lost executors.

    A table's shuffle files go when it is written: nothing reads them again.
    Neither does anything read what the driver made to plan and follow its
    statement, which is released then.
    """

    def __init__(self, spark: SparkSession, name: str, batch_rows: int | None = None):
        """batch_rows bounds the rows of an Arrow batch while a table is written, and so what lies outside the heap."""
        self.spark, self.root, self.n = spark, f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}", 0
        self.settings = {CLEANUP: "true"} | ({} if batch_rows is None else {BATCH: str(batch_rows)})

    def save(self, df: DataFrame) -> DataFrame:
        self.n += 1
        path = f"{self.root}/{self.n}"
        before = {k: self.spark.conf.get(k, None) for k in self.settings}
        for k, v in self.settings.items():
            self.spark.conf.set(k, v)
        try:
            df.write.option("compression", "zstd").parquet(path)
        finally:
            for k, v in before.items():
                self.spark.conf.unset(k) if v is None else self.spark.conf.set(k, v)
        out = self.spark.read.schema(df.schema).parquet(path)
        out.lattica_path = path
        release(self.spark)
        return out

    def drop(self, *tables: DataFrame) -> None:
        """Deletes tables that are no longer read, and lets the driver forget their plans."""
        jvm, conf = self.spark.sparkContext._jvm, self.spark.sparkContext._jsc.hadoopConfiguration()
        for df in tables:
            path = jvm.org.apache.hadoop.fs.Path(df.lattica_path)
            path.getFileSystem(conf).delete(path, True)
        release(self.spark)


def release(spark: SparkSession) -> None:
    """Broadcasts and the shuffle files of statements that save nothing stay until the driver collects their plans; what Arrow and the JVM have freed goes back to the system."""
    import gc

    from py4j.protocol import Py4JError

    gc.collect()
    pa.default_memory_pool().release_unused()
    gateway, jvm = spark.sparkContext._gateway, spark.sparkContext._jvm
    jvm.System.gc()
    try:  # outside the heap malloc keeps what compilers and ended threads have freed
        call = gateway.new_array(jvm.Object, 4)
        call[0], call[1] = jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand"), "systemTrimNativeHeap"
        invoke = next(m for m in jvm.java.lang.Class.forName("javax.management.MBeanServer").getMethods() if m.getName() == "invoke")
        invoke.invoke(jvm.java.lang.management.ManagementFactory.getPlatformMBeanServer(), call)
    except Py4JError:  # Java before 17.0.9, or another system
        pass


def local_table(spark: SparkSession, rows: Sequence[tuple], schema: StructType) -> DataFrame:
    """A few rows as part of the plan itself: unlike createDataFrame of Python rows, they take no job to read."""
    columns = list(zip(*rows)) or [()] * len(schema)
    return spark.createDataFrame(pa.table([pa.array(c, to_arrow_type(f.dataType)) for c, f in zip(columns, schema)], schema.names), schema)


# ---------------------------------------------------------------- joins


def small_join(big: DataFrame, small: DataFrame, on: Sequence[str], how: str = "inner", most: int = BROADCAST_ROWS) -> DataFrame:
    """Broadcasts small if a count shows it to be within the bound; otherwise Spark shuffles both and splits skewed keys."""
    within = small.limit(most + 1).count() <= most
    return big.join(F.broadcast(small) if within else small, list(on), how)


# ---------------------------------------------------------------- components


#: Links, of two whole numbers each, that the driver takes.
DRIVER_LINKS = 1 << 17


def joined(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All ids of links (a, b), and the smallest id reachable from each."""
    ids, ends = np.unique(np.concatenate((a, b)), return_inverse=True)
    root = list(range(len(ids)))

    def top(x: int) -> int:
        while root[x] != x:
            root[x] = x = root[root[x]]
        return x

    for x, y in zip(ends[: len(a)].tolist(), ends[len(a) :].tolist()):
        x, y = top(x), top(y)
        root[max(x, y)] = min(x, y)
    return ids, ids[np.array([top(x) for x in range(len(ids))], np.int64)]


def components(spark: SparkSession, edges: DataFrame, scratch: Scratch, most_rounds: int = 100) -> DataFrame:
    """Connected components of (a, b) links: rows (id, component), component the smallest id reachable.

    Alternates large-star and small-star steps, each an aggregation and a join
    on slim rows, until the links stand still; a round's links are a table in
    the shared folder. Only counts and sums reach the driver. Ids without a
    link have no row. Rounds grow with the logarithm of the longest path;
    links that still change after most_rounds are an error.
    """
    links = edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a < b").distinct()
    links, seen = scratch.save(links), None
    for _ in range(most_rounds):
        # large star: every larger neighbour of u is linked to u's smallest neighbour
        both = links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("m").alias("a"), "b").where("a < b").distinct()
        # small star: every smaller neighbour of u, and u, is linked to the smallest of them
        least = large.groupBy("b").agg(F.min("a").alias("m"))
        small = large.join(least, "b").select(F.explode(F.array(F.struct(F.col("m").alias("a"), F.col("a").alias("b")), F.struct(F.col("m").alias("a"), F.col("b").alias("b")))).alias("e")).select("e.a", "e.b").where("a < b").distinct()
        now = scratch.save(small)
        state = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        scratch.drop(links)
        links = now
        if state == seen:
            break
        seen = state
    else:
        raise RuntimeError(f"components still change after {most_rounds} rounds")
    roots = links.select(F.col("b").alias("id"), F.col("a").alias("component"))
    return roots.union(links.select(F.col("a").alias("id"), F.col("a").alias("component")).distinct())


def components_of_few(spark: SparkSession, links: DataFrame, scratch: Scratch) -> DataFrame:
    """components of (a, b) links of whole numbers in a table; the driver itself joins DRIVER_LINKS or fewer, as the statements of the rounds cost it more memory than they do."""
    if links.count() > DRIVER_LINKS:
        return components(spark, links, scratch)
    found = links.select("a", "b").toArrow()
    ids, root = joined(found.column("a").to_numpy(), found.column("b").to_numpy())
    return spark.createDataFrame(pa.table({"id": ids, "component": root}), StructType([StructField(x, links.schema["a"].dataType) for x in ("id", "component")]))


# ---------------------------------------------------------------- tokens in Python


def doc_words(text: str | None) -> list[bytes]:
    """The lower-cased words of a text as UTF-8; bytes methods split and lower by ASCII alone."""
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit integers."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(tokens: list[bytes]) -> np.ndarray:
    from xxhash import xxh3_64_intdigest

    return np.fromiter(map(xxh3_64_intdigest, tokens), dtype=np.uint64, count=len(tokens))


def shingle_hashes(h: np.ndarray, k: int = 5) -> np.ndarray:
    """Hashes of all k-word shingles in order; with fewer words, of the whole sequence; without words, none."""
    n = len(h)
    if n == 0:
        return np.empty(0, np.uint64)
    k = min(k, n)
    out = np.full(n - k + 1, np.uint64(k), np.uint64)
    for i in range(k):
        out = mix64(out * np.uint64(0x9E3779B97F4A7C15) + h[i : n - k + 1 + i])
    return out


def pieces(batches: Iterator[pa.RecordBatch], rows: int = 500) -> Iterator[pa.RecordBatch]:
    """Batches of a few rows, so that a worker holds little at a time."""
    for b in batches:
        for i in range(0, b.num_rows, rows):
            yield b.slice(i, rows)


def rows_of(batches: Iterator, columns: Sequence[str]) -> Iterator[tuple]:
    """Arrow batches as tuples of Python values, a batch at a time."""
    for batch in batches:
        yield tuple(batch.column(c).to_pylist() for c in columns)
