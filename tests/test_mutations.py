"""Every file is damaged, not some of them."""

import hashlib

from tickframe.functions import pcm
from tickframe.plans import registry, scans  # noqa: F401  registers the query


def test_every_file_is_damaged(spark, tmp_path):
    texts = {1: "one file of text", 7: "", 50: "another äöü file", 101: "x" * 3000}
    spark.createDataFrame(list(texts.items()), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {(r.doc_id, r.mutation): r.md5 for r in registry.QUERIES["f15_mutations"](spark, str(tmp_path)).collect()}
    assert got == {(d, i): hashlib.md5(pcm.mutate(t.encode(), i)).hexdigest() for d, t in texts.items() for i in range(20)}
