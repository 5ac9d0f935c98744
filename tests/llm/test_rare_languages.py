"""Quality rules of languages with too few words for a reference."""

import random

from tickframe.llm import quality


def test_rare_language_is_judged_by_base_rules(spark):
    r = random.Random(2)
    words = ["".join(r.choice("αβγδεζηθ") for _ in range(5)) for _ in range(400)]
    rare = " ".join(r.choice(words) for _ in range(120))
    rows = [(i, " ".join(f"w{(i * 7 + k * 13) % 300}" for k in range(1300)), "en") for i in range(200)]
    rows += [(1000, rare, "el"), (1001, "πολύ " * 80, "el")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert [lang for lang, _, _ in quality.references(df)] == ["en"]
    got = {x.doc_id: x for x in quality.judge_documents(df).filter("doc_id >= 1000").collect()}
    assert got[1000].kept and got[1000].class_distance is None and not got[1001].kept
    kept = {x.doc_id for x in quality.keep_good(df).collect()}
    assert 1000 in kept and 1001 not in kept and quality.keep_good(df).columns == df.columns
