"""The pipeline, stage by stage, against what each operator says of its own input."""

import corpus_pipeline
from lodestone.llm import bpe, decontam, neardup, pii, quality


def test_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    labels, bench = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("labels", "benchmark"))
    ids = lambda df: {r["doc_id"] for r in df.select("doc_id").collect()}
    kept = corpus_pipeline.keep_quality(spark, docs, sf)
    assert ids(kept) == {r["doc_id"] for r in quality.classify(docs, labels).collect() if r["predicted"]}
    one = corpus_pipeline.drop_near_duplicates(spark, kept, sf)
    assert ids(one) == {r["doc_id"] for r in neardup.near_duplicates(kept, 5).collect() if r["kept"]}
    clean = corpus_pipeline.drop_benchmark(spark, one, sf)
    assert ids(clean) == ids(one) - ids(decontam.find(one, bench))
    masked = corpus_pipeline.mask_personal_data(spark, clean, sf)
    assert masked.columns == docs.columns and ids(masked) == ids(clean)
    assert not any(r["n_email"] for r in pii.find(masked).collect())
    want = sorted(map(tuple, bpe.digests(masked).collect()))
    assert sorted(map(tuple, corpus_pipeline.run(spark, sf).collect())) == want and len(want) > 50
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "near_duplicates", "decontamination", "pii", "bpe"]
