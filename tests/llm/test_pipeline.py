"""Each stage keeps the columns and acts on its whole input."""

from __future__ import annotations

import corpus_pipeline

from .conftest import prose


def test_stages(spark, docs, texts, tmp_path):
    labels = [(i, 1, 0) for i in range(20, 60, 2)] + [(12, 0, 0), (13, 0, 0)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, texts[9]), (2, None)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    df = docs
    stages = dict(corpus_pipeline.STAGES)
    assert len(stages) == 5
    near = stages["SimHash near-dedup"](spark, df, str(tmp_path))
    assert near.columns == df.columns and {r["doc_id"] for r in near.collect()} == set(texts) - {1, 2, 6, 7}
    good = stages["quality classifier"](spark, df, str(tmp_path))
    assert good.schema.simpleString() == df.schema.simpleString() and 0 < good.count() <= df.count()
    cut = stages["suffix-array dedup"](spark, df, str(tmp_path))
    assert cut.columns == df.columns
    rows = {r["doc_id"]: r for r in cut.collect()}
    assert rows[6]["text"] == "" and rows[5]["text"] == texts[5] and rows[0]["text"] is None and rows[6]["n_chars"] == 0 and rows[5]["row"] == "r"
    clean = stages["benchmark decontamination"](spark, df, str(tmp_path))
    assert clean.columns == df.columns and {r["doc_id"] for r in clean.collect()} == set(texts) - {8, 9, 10, *(i for i in (16, 17) if len(texts[i].split()) >= 10)}
    packed = stages["best-fit packing"](spark, df, str(tmp_path))
    assert packed.select("doc_id").distinct().count() == len(texts)


def test_run_on_small_and_empty_tables(spark, docs, tmp_path):
    docs.filter("doc_id < 30").write.parquet(f"{tmp_path}/a/documents.parquet")
    docs.filter("false").write.parquet(f"{tmp_path}/b/documents.parquet")
    for d in ("a", "b"):
        spark.createDataFrame([(20, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/{d}/labels.parquet")
        spark.createDataFrame([(1, prose(1, 20))], "item_id long, text string").write.parquet(f"{tmp_path}/{d}/benchmark.parquet")
    assert corpus_pipeline.run(spark, f"{tmp_path}/a").count() > 0
    assert corpus_pipeline.run(spark, f"{tmp_path}/b").count() == 0
