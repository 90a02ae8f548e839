"""What the driver holds of the pipeline's statements."""

import gc

import corpus_pipeline
from lattica.llm.common import Scratch
from lattica.llm.sharding import median_cuts


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_saving_a_table_releases_what_the_driver_left(spark):
    jvm, scratch = spark.sparkContext._jvm, Scratch(spark, "release")
    for _ in range(2):  # later statements load no more classes, which may start a collection
        scratch.save(spark.range(3).toDF("a"))
    left = jvm.java.util.ArrayList()
    ref = jvm.java.lang.ref.WeakReference(left)
    jvm.System.gc()  # it outlives a collection, so only a full one takes it
    del left
    gc.collect()
    saved = scratch.save(spark.range(3).toDF("a"))
    assert ref.get() is None
    assert sorted(r.a for r in saved.collect()) == [0, 1, 2]


def test_cuts_are_part_of_the_plan(spark):
    tree = spark.createDataFrame([(0, 10, i, i, 1 + i) for i in range(8)], "node int, size long, crc long, idh long, v0 long")
    cuts = median_cuts(spark, tree, ["v0"], {0: 2}, 1.0, 40.0)
    assert "LocalRelation" in plan(cuts) and "RDD" not in plan(cuts), plan(cuts)
    (cut,) = cuts.collect()
    assert (cut.node, cut.dim, cut.left_parts) == (0, 0, 1)
    assert sum(((1 + i) << 32 | i) < cut.key_cut for i in range(8)) == 4
    assert median_cuts(spark, tree.where("size < 0"), ["v0"], {0: 2}, 1.0, 40.0).collect() == []


def test_leaks_are_found_once(spark, tmp_path):
    passage = " ".join(f"w{i}" for i in range(30))
    docs = spark.createDataFrame([(1, passage), (2, f"so {passage} there"), (3, "another text of no matter at all"), (4, None)], "doc_id long, text string")
    spark.createDataFrame([(7, passage)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    kept = corpus_pipeline.drop_leaks(spark, docs, str(tmp_path))
    assert "bit_count" not in plan(kept) and "benchmark" not in plan(kept), plan(kept)
    assert sorted(r.doc_id for r in kept.collect()) == [3, 4]
