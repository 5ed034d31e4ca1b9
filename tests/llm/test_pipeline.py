"""The pipeline's stages on odd rows; test_near_copies holds the whole pipeline to brute force."""

import corpus_pipeline
from textloom.llm import scratch


def test_stages_keep_columns_and_survive_odd_rows(spark, small):
    text = " ".join(f"word{i}" for i in range(200))
    rows = [(1, text, "en", "src0", 5), (2, text, "en", None, None), (None, text + " x", None, "src1", 1), (3, None, "en", "src1", 1), (4, "", None, None, None), (5, "the and of", "de", "src2", 3), (5, "the and of", "de", "src2", 3), (6, "long the of and " * 60_000, "en", "src1", 3)]
    df = spark.createDataFrame([(*r, 9) for r in rows], "doc_id bigint, text string, lang string, source string, n_chars bigint, shard int")
    for docs in (df, df.limit(0)):
        for name, stage in corpus_pipeline.STAGES:
            docs = scratch.materialize(stage(spark, docs, small), name)
            if name != "shard":
                assert docs.columns == list(corpus_pipeline.COLUMNS)
