"""Rows without id are documents of their own in the pipeline's stages."""

import corpus_pipeline as pipeline

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def test_null_ids(spark):
    one, two, three = (" ".join(f"{w}{i}" for i in range(30)) for w in "abc")
    texts = [(None, one), (None, two), (None, two), (None, three), (5, three), (6, "numbered words of its own that nobody else has"), (None, ""), (None, "")]
    df = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in texts], DOCS)
    got = sorted((str(r.doc_id), r.text) for r in pipeline.near_duplicates(spark, df, "").collect())
    assert got == sorted([("None", one), ("None", two), ("5", three), ("6", texts[5][1]), ("None", ""), ("None", "")])
    lines = [(None, f"shared line\n{one}"), (None, f"{two}\nshared line"), (7, f"shared line\n{three}")]
    df = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in lines], DOCS)
    out = [r.text for r in pipeline.line_dedup_stage(spark, df, "").collect()]
    assert len(out) == 3 and sum("shared line" in t for t in out) == 1 and all(any(x in t for t in out) for x in (one, two, three))
