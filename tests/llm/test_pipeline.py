"""The pipeline's stages on their own input, and all of them."""

import corpus_pipeline
from loomgraph.llm import linededup, neardup, packing, quality

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    good = corpus_pipeline.keep_quality(spark, docs, SF)
    assert good.columns == columns
    model = quality.fit(docs, quality.known_labels(spark, SF))
    want = {r.doc_id for r in quality.scored(docs, model).collect() if r.quality_score >= quality.THRESHOLD}
    assert {r.doc_id for r in good.collect()} == want
    lines = corpus_pipeline.drop_lines(spark, docs, SF)
    kept = {r.doc_id: r.text for r in linededup.dedup_lines(docs).collect()}
    assert lines.columns == columns and {r.doc_id: r.text for r in lines.collect()} == kept
    assert all(r.n_chars == len(r.text) for r in lines.collect())
    near = corpus_pipeline.drop_near_duplicates(spark, docs, SF)
    alone = {r.doc_id for r in neardup.near_duplicates(docs, 80).where("kept").collect()}
    assert near.columns == columns and {r.doc_id for r in near.collect()} == alone
    mixed = corpus_pipeline.mix_sources(spark, docs, SF)
    assert mixed.columns == columns and mixed.groupBy("doc_id").count().agg({"count": "max"}).first()[0] == 2


def test_run(spark):
    rows = corpus_pipeline.run(spark, SF).collect()
    assert rows and {"doc_id", "sequence_id", "offset", "length"} <= set(rows[0].asDict())
    ends = [r.offset + r.length for r in rows]
    assert max(ends) <= packing.CAPACITY
    assert len(corpus_pipeline.STAGES) == 5
