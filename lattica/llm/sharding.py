"""Sharding by a k-d tree over document metadata, cut at distributed weighted medians.

Every node of the tree is cut along its widest dimension at the point that
splits its bytes in proportion to the shards on either side. The point is found
by histograms that refine only the bucket holding it, so no row is sorted.
Equal texts are one point of the tree, at the least metadata of their rows.
Points with one value of the dimension are told apart by the text's crc32; only
where one text alone is too heavy, its rows are told apart by a hash of the id.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from lattica.llm.common import Scratch, id_hash, local_table, release, small_join

VALUE_BITS, CRC_BITS, ID_BITS = 30, 32, 48
#: Rows of a run of slots; runs are numbered side by side.
RUN_ROWS = 4096
#: A node that is being cut, and how: dim, and what holds the cut so far, up to goal bytes; in the end the cut itself.
GOING = StructType().add("node", "integer").add("dim", "integer").add("key_low", "long").add("id_low", "long").add("goal", "double")
CUTS = StructType().add("node", "integer").add("dim", "integer").add("key_cut", "long").add("id_cut", "long").add("left_parts", "integer")


def default_dimensions() -> dict[str, Column]:
    """Numbers drawn from a document's metadata: length, source, language. Null is the least value."""
    code = lambda c: F.when(F.col(c).isNotNull(), F.crc32(F.col(c).cast("string").cast("binary")) + 1)
    return {"length": F.log2(F.octet_length(F.coalesce(F.col("text"), F.lit(""))) + F.lit(1.0)), "source": code("source"), "lang": code("lang")}


def kd_shards(docs: DataFrame, n_shards: int = 8, dimensions: Mapping[str, Column] | None = None, tolerance: float = 2e-4) -> DataFrame:
    """(doc_id, size, text_crc32, shard, slot) for every row of docs, shards of near equal bytes.

    The target of a leaf is a shard's share of all bytes (UTF-8 length plus 1;
    a null text counts as empty). A cut is refined until the bucket that holds
    it weighs at most `tolerance` of the target, or is one text of at most the
    target, or one id of a heavier text.
    Rows that agree in everything go to one side; groups are equal texts, known
    by size and crc32, and stay whole but for one that alone outweighs a cut. Slots number a shard's rows
    from 0 by a hash of id and text, id and text crc32; rows that agree in all of these are
    interchangeable. Null metadata is the least value of its dimension; a
    dimension with one value is never cut before another one. An empty table
    gives an empty result. Other columns of docs are ignored.
    """
    spark, scratch = docs.sparkSession, Scratch(docs.sparkSession, "sharding")
    dims = dict(default_dimensions() if dimensions is None else dimensions)
    body = F.coalesce(F.col("text"), F.lit(""))
    raw = {f"v{i}": c.cast("double") for i, c in enumerate(dims.values())}
    slim = docs.select(F.col("doc_id"), (F.octet_length(body) + F.lit(1)).cast("long").alias("size"), F.crc32(body.cast("binary")).alias("crc"), id_hash(F.col("doc_id"), ID_BITS).alias("idh"), *(c.alias(n) for n, c in raw.items()))
    slim = scratch.save(slim)
    ends = slim.agg(*(f(n).alias(f"{f.__name__}_{n}") for n in raw for f in (F.min, F.max)), F.sum("size").alias("total")).first()
    target = (ends["total"] or 0) / n_shards
    steps = float((1 << VALUE_BITS) - 2)
    scaled = []
    for n in raw:
        low, wide = ends[f"min_{n}"] or 0.0, (ends[f"max_{n}"] or 0.0) - (ends[f"min_{n}"] or 0.0)
        at = F.floor((F.col(n) - low) / (wide or 1.0) * steps).cast("long") + 1
        scaled.append(F.coalesce(at, F.lit(0).cast("long")).alias(n))
    # rows of texts that occur once need no lookup: only repeated ones get their group's point
    rows = slim.select("doc_id", "size", "crc", "idh", *scaled)
    groups = rows.groupBy("size", "crc").agg(F.count("*").alias("__m"), *(F.min(n).alias(f"g_{n}") for n in raw)).where("__m > 1").drop("__m")
    rows = small_join(rows, groups, ["size", "crc"], "left")
    tree = scratch.save(rows.select("doc_id", "size", "crc", "idh", *(F.coalesce(f"g_{n}", n).alias(n) for n in raw), F.lit(0).alias("node")))
    scratch.drop(slim)
    parts = {0: n_shards}  # node, named by its first shard: shards below it
    while any(m > 1 for m in parts.values()):
        cuts = median_cuts(spark, tree, list(raw), parts, tolerance * target, target)
        new = scratch.save(tree.join(F.broadcast(cuts), "node", "left").withColumn("node", right_side(list(raw))).select(*tree.columns))
        scratch.drop(tree)
        tree = new
        parts = {k: v for node, m in parts.items() for k, v in ([(node, m)] if m == 1 else [(node, m // 2), (node + m // 2, m - m // 2)])}
    return with_slots(tree.select("doc_id", "size", F.col("crc").alias("text_crc32"), F.col("node").alias("shard"), "idh"))


def chosen(names: list[str]) -> Column:
    """The value of a row in its node's dimension, with the crc32 below it."""
    value = F.element_at(F.array(*names), F.col("dim") + 1)
    return F.shiftleft(value, CRC_BITS).bitwiseOR(F.col("crc"))


def right_side(names: list[str]) -> Column:
    key = chosen(names)
    right = (key > F.col("key_cut")) | ((key == F.col("key_cut")) & (F.col("idh") >= F.col("id_cut")))
    return F.when(F.col("dim").isNotNull() & right, F.col("node") + F.col("left_parts")).otherwise(F.col("node")).cast("int")


def median_cuts(spark: SparkSession, tree: DataFrame, names: list[str], parts: dict[int, int], fine: float, heavy: float) -> DataFrame:
    """One row per node to be cut: dim, key_cut and id_cut (the first key on the right), left_parts. The driver holds a row per shard at most."""
    open_nodes = [n for n, m in parts.items() if m > 1]
    wide = tree.where(F.col("node").isin(open_nodes)).groupBy("node").agg(F.sum("size").alias("total"), *((F.max(n) - F.min(n)).alias(n) for n in names)).collect()
    state = {}
    for r in wide:
        widths = [r[n] for n in names]
        m = parts[r["node"]]
        state[r["node"]] = {"dim": widths.index(max(widths)), "want": r["total"] * (m // 2) / m, "below": 0, "key_low": 0, "id_low": 0, "done": False}
    passes = [("key", s) for s in (47, 32, 16, 0)] + [("id", s) for s in (32, 16, 0)]
    for what, shift in passes:
        going = [(n, s["dim"], s["key_low"], s["id_low"], float(s["want"] - s["below"])) for n, s in state.items() if not s["done"]]
        if not going:
            break
        nodes = F.broadcast(local_table(spark, going, GOING))
        rows = tree.join(nodes, "node").withColumn("key", chosen(names))
        if what == "key":
            above = {47: 62, 32: 47, 16: 32, 0: 16}[shift]
            rows = rows.where(F.shiftright("key", above) == F.shiftright("key_low", above)).withColumn("bucket", F.shiftright("key", shift))
        else:
            above = {32: 48, 16: 32, 0: 16}[shift]
            rows = rows.where((F.col("key") == F.col("key_low")) & (F.shiftright("idh", above) == F.shiftright("id_low", above))).withColumn("bucket", F.shiftright("idh", shift))
        sums = rows.groupBy("node", "goal", "bucket").agg(F.sum("size").alias("n"))
        sums = sums.withColumn("upto", F.sum("n").over(Window.partitionBy("node").orderBy("bucket")))
        cut = sums.where(F.col("upto") >= F.col("goal")).groupBy("node").agg(F.min(F.struct("bucket", "upto", "n")).alias("c"))
        for r in cut.collect():
            s, (bucket, upto, n) = state[r["node"]], r["c"]
            goal = s["want"] - s["below"]
            s["below"] += upto - n
            s[f"{what}_low"] = bucket << shift
            # one text is cut by its rows' ids only if it weighs more than a shard
            if n <= fine or (what, shift) == ("id", 0) or ((what, shift) == ("key", 0) and n <= heavy):
                s["done"] = True
                if goal - (upto - n) > n / 2:  # the whole bucket goes left
                    s[f"{what}_low"] = (bucket + 1) << shift
        release(spark)
    cuts = [(n, s["dim"], s["key_low"], s["id_low"], parts[n] // 2) for n, s in state.items()]
    return local_table(spark, cuts, CUTS)


def with_slots(rows: DataFrame) -> DataFrame:
    """Numbers each shard's rows from 0 without gaps: runs of about RUN_ROWS rows by id hash, an offset per run, a rank within it.

    The number of runs follows the number of rows, so that a run stays as
    large at any size; the join with the offsets reuses the runs' partitioning.
    Rows of one id differ in size and crc32, which take part in the run's hash;
    only rows that agree in all of these share a run however many they are.
    """
    runs = max(1, rows.count() // (RUN_ROWS * 2))
    bits = max(0, (runs - 1).bit_length())
    rows = rows.withColumn("idh", F.shiftrightunsigned(F.xxhash64("idh", "text_crc32", "size"), 64 - ID_BITS))
    rows = rows.withColumn("run", F.shiftright("idh", ID_BITS - bits) if bits else F.lit(0).cast("long"))
    sizes = rows.groupBy("shard", "run").agg(F.count("*").alias("n"))
    before = Window.partitionBy("shard").orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("shard", "run", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    rank = F.row_number().over(Window.partitionBy("shard", "run").orderBy("idh", F.col("doc_id").asc_nulls_first(), "text_crc32", "size")) - 1
    return rows.withColumn("rank", rank).join(offsets, ["shard", "run"]).withColumn("slot", (F.col("before") + F.col("rank")).cast("long")).select("doc_id", "size", "text_crc32", "shard", "slot")


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row of documents in shards 0 to 7 under the law of bytes; see kd_shards."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source", "lang")
    return kd_shards(docs).withColumns({"law": F.lit("bytes"), "grown_shard": F.lit(None).cast("int")}).select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")
