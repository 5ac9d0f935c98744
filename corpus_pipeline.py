"""The corpus pipeline: quality rules, line dedup, near-duplicate removal, mixing, encoding.

Each stage takes all that the one before kept.  All but the last return the columns of documents, further ones
included, whatever their names; a stage that shortens texts sets n_chars to the new length.  Every stage takes an
empty table and returns one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickframe.llm import byte_bpe, line_dedup, mixing, near_dups, quality
from tickframe.llm.queries import BYTE_RANKS, MOST, WEIGHTS, tokenizer
from tickframe.llm.runtime import fresh, keep, settle, text_or_empty

#: Shared share of five-word shingles, in percent, from which documents are near duplicates.
SIMILAR = 80


def _by_id(docs: DataFrame, ids: DataFrame, how: str) -> DataFrame:
    """Documents whose id is (left_semi) or isn't (left_anti) among ``ids`` (doc_id)."""
    (key,) = fresh(docs, "other_doc_id")
    return docs.join(ids.select(F.col("doc_id").alias(key)).distinct(), docs["doc_id"] == F.col(key), how)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents that pass the rules; repeated rows are judged each.  Null and empty texts have too few words and go."""
    return quality.keep_good(docs)


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps of each class of near-equal lines the first, by document id and place; documents left without words go.

    Rows that share an id are one document, rows without id only if their texts are equal."""
    return line_dedup.dedup(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the smallest id of each class.  Rows that share an id are one document, whatever their texts: of
    those one stays, the one with the smallest hash.  Documents without words are linked with nothing and stay.

    Rows without id are linked through equal sets only: of those with equal sets one stays, if no row with an id has that set."""
    found = keep(near_dups.classes(docs, percent=SIMILAR))
    if not found.filter("doc_id IS NULL").isEmpty():
        numbered = docs.filter("doc_id IS NOT NULL")
        return _one_of_each(numbered, found.filter("doc_id IS NOT NULL")).unionByName(_without_id(docs.filter("doc_id IS NULL"), numbered))
    return _one_of_each(docs, found)


def _without_id(lone: DataFrame, numbered: DataFrame) -> DataFrame:
    """Rows without id, one of each set that no numbered row has; all of those without words."""
    key, text = fresh(lone, "set_key", "set_text")
    own = near_dups.with_set(lone.withColumn(text, text_or_empty(lone)), text, key)
    others = near_dups.with_set(numbered.select(text_or_empty(numbered).alias(text)), text, key).select(F.col(key).alias("other_set")).filter("other_set IS NOT NULL").distinct()
    first = own.filter(F.col(key).isNotNull()).join(others, F.col(key) == F.col("other_set"), "left_anti").dropDuplicates([key])
    return first.unionByName(own.filter(F.col(key).isNull())).drop(key, text)


def _one_of_each(docs: DataFrame, found: DataFrame) -> DataFrame:
    # those that go are the fewer, so that they may be broadcast; all rows of an id have one verdict
    kept = _by_id(docs, found.filter("NOT kept"), "left_anti")
    again = keep(found.groupBy("doc_id").agg(F.count("*").alias("n")).filter("n > 1").select("doc_id"))
    if again.isEmpty():
        return kept
    # rows that share an id are rare: only they are compared with each other
    (key, least) = fresh(docs, "row_key", "least_key")
    twice = _by_id(kept, again, "left_semi").withColumn(key, F.xxhash64(F.to_json(F.struct(*docs.columns))))
    first = twice.groupBy("doc_id").agg(F.min(key).alias(least)).select(F.col("doc_id").alias(fresh(docs, "first_doc_id")[0]), least)
    one = twice.join(first, (F.col("doc_id") == F.col(first.columns[0])) & (F.col(key) == F.col(least))).dropDuplicates(["doc_id"]).select(*docs.columns)
    return _by_id(kept, again, "left_anti").unionByName(one)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes documents, some repeatedly, so that sources come near their target weights; a null source is one of its own."""
    return mixing.mix(docs, WEIGHTS, MOST)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Encodes each text and decodes it again; a row for each document taken.  Null and empty texts have no ids."""
    import public_tokenizers

    return byte_bpe.round_trip(docs, tokenizer(BYTE_RANKS), public_tokenizers.PATTERN)


STAGES = [
    ("quality rules", quality_rules),
    ("line dedup", line_dedup_stage),
    ("near duplicates", near_duplicates),
    ("mix sources", mix_sources),
    ("encode", encode),
]

#: Most stages can't be expressed in SQL; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents.  Between stages the rows are written to the shared folder, since each
    stage reads its input several times."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = settle(docs)
    return docs
