"""All stages in a row against brute force, the mix against its SQL and the encoding against its library."""

import base64
import hashlib
import random

import corpus_pipeline as pipeline
import duckdb
import public_tokenizers as P
import tiktoken
from test_corpus import WORDS, brute_classes, copies, edit_distance, near_texts

from tickframe.llm import line_dedup, quality, queries

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def brute_lines(rows):
    """Places removed, by document: equal lines of any length, near ones from NEAR_CHARS characters on."""
    places = {}
    for i, text in sorted(rows):
        for pos, line in enumerate(text.split("\n")):
            if line.strip(line_dedup.SPACES):
                places.setdefault(line.strip(line_dedup.SPACES), []).append((i, pos))
    lines, parent = list(places), {x: x for x in places}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    long = sorted((x for x in lines if len(x) >= line_dedup.NEAR_CHARS), key=len)
    for k, a in enumerate(long):
        for b in long[k + 1 :]:
            if len(b) - len(a) > line_dedup.EDITS:
                break
            if sum(abs(a.count(c) - b.count(c)) for c in set(a + b)) <= 2 * line_dedup.EDITS and edit_distance(a, b) <= line_dedup.EDITS:
                parent[find(a)] = find(b)
    groups = {}
    for x in lines:
        groups.setdefault(find(x), []).extend(places[x])
    gone = {}
    for found in groups.values():
        for i, pos in sorted(found)[1:]:
            gone.setdefault(i, []).append(pos)
    return gone


def test_the_whole_pipeline(spark, tmp_path):
    r = random.Random(12)
    prose = [x.text for x in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").orderBy("doc_id").collect()]
    texts = prose + copies(2)[:40] + [f"{a}\n{b}" for a, b in zip(prose[:30], near_texts(30))] + [None, "", "too short"]
    rows = [(3 * i, t, "en", r.choice(["a", "b", "c", None]), len(t or "")) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, DOCS).write.parquet(str(tmp_path / "documents.parquet"))
    got = sorted((x.doc_id, x.n_tokens, x.decoded_sha256) for x in pipeline.run(spark, str(tmp_path)).collect())

    verdicts = {x.doc_id: x.kept for x in quality.judge_documents(spark.read.parquet(str(tmp_path / "documents.parquet"))).collect()}
    left = {i: (t, s) for i, t, _, s, _ in rows if verdicts[i]}
    gone = brute_lines([(i, t) for i, (t, _) in left.items()])
    left = {i: ("\n".join(x for p, x in enumerate(t.split("\n")) if p not in gone.get(i, ())), s) for i, (t, s) in left.items()}
    left = {i: x for i, x in left.items() if i not in gone or WORDS.search(x[0])}
    ids = sorted(left)
    roots, _ = brute_classes([left[i][0] for i in ids], pipeline.SIMILAR)
    left = {i: left[i] for k, i in enumerate(ids) if roots[k] == k}
    con = duckdb.connect()
    con.sql("CREATE TABLE documents (doc_id BIGINT, text VARCHAR, source VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?, ?)", [(i, t, s) for i, (t, s) in left.items()])
    times = {i: taken // size if size else 0 for i, size, taken in con.sql(f"SELECT doc_id, size, taken FROM ({queries.ORACLES['op1_mix_sources']})").fetchall()}
    path = P.path("byte_bpe_multi_50k.tiktoken")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    lib = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = []
    for i, (t, _) in left.items():
        want += [(i, len(lib.encode_ordinary(t)), hashlib.sha256(t.encode()).hexdigest())] * times[i]
    assert got == sorted(want) and len({i for i, _, _ in got}) > 50


def test_repeated_ids_leave_the_same_row_each_time(spark):
    texts = [" ".join(f"{w}{i}" for i in range(30)) for w in "abc"]
    rows = [(1, texts[0], "en", "s", 1), (1, texts[1], "en", "s", 2), (1, texts[1], "en", "s", 2), (2, texts[2], "en", "s", 3), (2, texts[2], "en", "s", 3)]
    one, two = (sorted((x.doc_id, x.text) for x in pipeline.near_duplicates(spark, spark.createDataFrame(part, DOCS), "").collect()) for part in (rows, rows[::-1]))
    assert one == two and [i for i, _ in one] == [1, 2]
