import corpus_pipeline
from textloom.llm.bpe_codec import codec


def test_stages_keep_the_columns_and_the_clean_documents(spark, tmp_path):
    src = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{src}/documents.parquet")
    n = docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = corpus_pipeline.cut(stage(spark, docs, src), name)
        assert out.columns == ["doc_id", "text", "lang", "source", "n_chars"] and 0 < out.count() <= docs.count()
        docs = out
    assert docs.count() > 0.5 * n
    rows = corpus_pipeline.STAGES[-1][1](spark, docs, src).collect()
    want = sum(len(codec(corpus_pipeline.WORD_BPE).encode(r["text"])) + 1 for r in docs.collect())
    assert sum(r["length"] for r in rows) == want
