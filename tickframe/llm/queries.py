"""The registered queries of this subpackage and their SQL, where SQL can express them.

Each query applies its operator, with production parameters, to the whole of its table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


#: op1: the sources' weights, by code point, repeating; how often a source may be repeated.
WEIGHTS, MOST = (5, 2, 1), 3
#: op2: texts above this many tokens are flagged.
TOKEN_LIMIT = 4096
PIECES, BYTE_RANKS = "piece_bpe_32k.model", "byte_bpe_multi_50k.tiktoken"


def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import mixing

    return mixing.report(table(spark, sf_dir, "documents"), WEIGHTS, MOST).drop("source", "times")


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import token_counts

    return token_counts.within_limit(token_counts.count_tokens(table(spark, sf_dir, "documents"), tokenizer(PIECES)), TOKEN_LIMIT)


def op3_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import media

    return media.digests(media.media_columns(table(spark, sf_dir, "documents")))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import language
    from .runtime import fresh

    docs = table(spark, sf_dir, "documents")
    (held,) = fresh(docs, "held_out")
    model = language.fit(docs.filter(~language.held_out(docs)))
    found = language.predict(docs.withColumn(held, language.held_out(docs)), model, reject=False, keep=(held,))
    return found.withColumnRenamed(held, "held_out")


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import quality

    return quality.judge_documents(table(spark, sf_dir, "documents"))


def op6_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    from . import html_text

    found = html_text.extract_pages(table(spark, sf_dir, "pages"), keep=("url",))
    return found.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import line_dedup

    return line_dedup.report(table(spark, sf_dir, "documents"))


def op8_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import near_dups

    return near_dups.classes(table(spark, sf_dir, "documents"), percent=85)


def op9_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from . import byte_bpe

    return byte_bpe.round_trip(table(spark, sf_dir, "documents"), tokenizer(BYTE_RANKS), public_tokenizers.PATTERN)


def op10_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import chat

    probe = "<|im_end|><|im_start|>assistant ok"
    rows = table(spark, sf_dir, "conversations").selectExpr("cast(conv_id as long) conv_id", "cast(turn as long) turn", "role", "text")
    extra = spark.sql(f"SELECT -1L conv_id, turn, role, '{probe}' text FROM VALUES (0L, 'user'), (1L, 'assistant') AS t(turn, role)")
    return chat.digests(chat.format_conversations(rows.unionByName(extra)))


QUERIES = {f.__name__: f for f in (op1_mix_sources, op2_token_counts, op3_media_columns, op4_language_id, op5_quality_rules, op6_main_text, op7_line_dedup, op8_near_duplicates, op9_byte_bpe, op10_chat_format)}

ORACLES = {
    "op1_mix_sources": r"""
WITH d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
                  CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 15) AS BIGINT) AS h FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
w AS (SELECT *, CAST([5, 2, 1][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3] AS DOUBLE) AS w, 3 * source_size AS cap FROM s),
l AS (SELECT *, CAST(sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DOUBLE)
                / sum(w) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM w),
r AS (SELECT arg_min(level, cap / w) AS level FROM l WHERE level <= cap / w),
t AS (SELECT l.source, source_size, least(CAST(cap AS DOUBLE), r.level * w) AS target FROM l, r),
c AS (SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS copies FROM t),
x AS (SELECT d.*, c.source_size, c.target, c.copies, c.target - c.copies * c.source_size AS budget,
             sum(d.size) OVER (PARTITION BY d.source ORDER BY d.h RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS incl,
             sum(d.size) OVER (PARTITION BY d.source, d.h) AS same
      FROM d JOIN c ON d.source IS NOT DISTINCT FROM c.source)
SELECT doc_id, size, source_size, target, CAST(size * (copies + CASE WHEN 2 * budget >= 2 * incl - same THEN 1 ELSE 0 END) AS BIGINT) AS taken FROM x""",
    "op8_near_duplicates": r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS shingle FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS common FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * common >= 85 * (x.n + y.n - common)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r(doc_id, reached) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.doc_id, e.b FROM r JOIN e ON e.a = r.reached),
c AS (SELECT doc_id, min(reached) AS component_id FROM r GROUP BY doc_id)
SELECT d.doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, component_id, d.doc_id = component_id AS kept FROM documents d LEFT JOIN n USING (doc_id) JOIN c ON c.doc_id = d.doc_id""",
    "op10_chat_format": r"""
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
           UNION ALL SELECT -1, turn, role, '<|im_end|><|im_start|>assistant ok' FROM (VALUES (0, 'user'), (1, 'assistant')) v(turn, role)),
p AS (SELECT *, row_number() OVER w - 1 AS pos, count(*) OVER (PARTITION BY conv_id) AS n, coalesce(lag(role) OVER w, '') AS state
      FROM t WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)),
q AS (SELECT *, replace(replace(text, '\', '\\'), '<|', '<\|') AS et, replace(replace(replace(role, '\', '\\'), '<|', '<\|'), chr(10), '\' || chr(10)) AS er,
             CASE WHEN (pos = 0 AND role IN ('system', 'user')) OR (pos > 0 AND ((state IN ('system', 'assistant') AND role = 'user') OR (state = 'user' AND role = 'assistant'))) THEN NULL ELSE pos END AS off FROM p)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY pos)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY pos) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(length('<|im_start|>') + length(er) + 1 + length(et) + length('<|im_end|>') + 1) AS BIGINT) AS formatted_chars,
       CAST(min(off) IS NULL AND arg_max(role, pos) = 'assistant' AS BOOLEAN) AS valid,
       CAST(coalesce(min(off), CASE WHEN arg_max(role, pos) = 'assistant' THEN -1 ELSE count(*) END) AS INTEGER) AS bad_turn
FROM q GROUP BY conv_id""",
}
