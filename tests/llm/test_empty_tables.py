"""Empty tables, repeated rows and clashing column names, for every operator that takes documents."""

import public_tokenizers as P
from pyspark.sql import functions as F

from tickframe.llm import byte_bpe, language, line_dedup, media, mixing, near_dups, quality, token_counts

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
BYTES, PIECES = P.path("byte_bpe_multi_50k.tiktoken"), P.path("piece_bpe_32k.model")
CLASHES = ("node", "key", "near", "unit", "same", "registers", "check", "own", "payload", "held_out", "is_held_out", "lang_pred", "class_distance", "n_tokens", "media", "times", "removed", "first")


def operators(df):
    model = language.fit(df)
    return {
        "tokens": token_counts.within_limit(token_counts.count_tokens(df, PIECES), 4096),
        "media": media.digests(media.media_columns(df)),
        "language": language.predict(df, model, reject=False),
        "quality": quality.judge_documents(df),
        "good": quality.keep_good(df),
        "lines": line_dedup.report(df),
        "lines left": line_dedup.dedup(df),
        "classes": near_dups.classes(df),
        "bytes": byte_bpe.round_trip(df, BYTES, P.PATTERN),
        "mix": mixing.report(df, (5, 2, 1), 3),
    }


def test_empty_tables_give_empty_results(spark):
    for name, out in operators(spark.createDataFrame([], SCHEMA)).items():
        assert out.collect() == [], name


def test_repeated_rows_and_clashing_names(spark):
    text = "the same words in every row of this table, and a few more to make it long enough " * 5
    df = spark.createDataFrame([(i // 2, text, "en", "s", len(text)) for i in range(6)], SCHEMA)
    for name in CLASHES:
        df = df.withColumn(name, F.lit("x"))
    for name, out in operators(df).items():
        rows = out.collect()
        assert len(rows) == {"good": 0, "lines left": 2}.get(name, 6), name
        if name in ("tokens", "media", "language", "quality", "bytes"):
            assert len({tuple(v for k, v in r.asDict().items() if k != "doc_id") for r in rows}) == 1, name
        if name == "classes":
            assert {(r.component_id, r.kept) for r in rows} == {(0, True), (0, False)}
