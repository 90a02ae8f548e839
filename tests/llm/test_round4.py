"""What the operators hold and send in the pipeline."""

import pyarrow as pa

import corpus_pipeline
from lattica.llm import toxicity


def test_toxicity_sends_a_text_once_and_few_rows_at_a_time(spark, tmp_path):
    rows = [(i, f"word{i} " * (1 + i % 7) + ("vile rotten scumbag" if i % 4 == 0 else ""), f"c{i}") for i in range(400)] + [(900, None, None), (901, "", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score string")  # a column of the corpus keeps its name
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i, _, _ in rows[:400]], "doc_id long, toxic int")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    kept = corpus_pipeline.drop_toxic(spark, docs, str(tmp_path))
    plan = kept._jdf.queryExecution().optimizedPlan().toString().split("\n")
    sent = plan[1 + next(i for i, x in enumerate(plan) if "MapInArrow" in x)]
    assert sent.count("text") == 2 and sent.count("struct") == 1, sent  # as a name and a value within the row, not beside it
    model = toxicity.trained_on(docs.select("doc_id", "text"), labels)
    want = {x.doc_id for x in toxicity.score_rows(docs.select("doc_id", "text"), model).collect() if x.predicted == 0}
    got = kept.collect()
    assert {x.doc_id for x in got} == want and {900, 901} <= want and 250 < len(got) < 350 and kept.columns == docs.columns
    batch = pa.RecordBatch.from_pydict({"doc_id": list(range(1200)), "text": [rows[i % 402][1] for i in range(1200)]})
    out = list(toxicity.scored(iter([batch]), model))
    assert max(b.num_rows for b in out) <= 500 and [i for b in out for i in b.column("doc_id").to_pylist()] == list(range(1200))
