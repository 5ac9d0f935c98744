"""Language identification of more languages than SAMPLE_ROWS / SAMPLE."""

import random

from tickframe.llm import language


def test_every_language_is_learned(spark):
    r = random.Random(5)
    langs = {f"l{i:02}": [chr(0x4E00 + 40 * i + k) for k in range(30)] for i in range(language.SAMPLE_ROWS // language.SAMPLE + 4)}
    rows = []
    for i, (lang, letters) in enumerate(langs.items()):
        rows += [(len(rows) + k, "".join(r.choice(letters) for _ in range(300)), lang) for k in range(30 + i)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language.fit(df)
    assert model.langs == sorted(langs)
    assert language.predict(df, model, reject=False, keep=("lang",)).filter("lang_pred <> lang").count() == 0
