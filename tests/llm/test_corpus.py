"""Corpus operators against brute force, libraries and round trips, with the edges each defines."""

import base64
import collections
import hashlib
import random
import re
import zlib

import duckdb
import numpy as np
import public_tokenizers as P
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tickframe.llm import byte_bpe, chat, html_text, language, line_dedup, links, media, mixing, near_dups, quality, queries, token_counts
from tickframe.llm.runtime import WORD

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = re.compile(WORD)
LONG = "lorem ipsum dolor sit amet consectetur " * 3000


def docs_of(spark, texts, extra=False):
    rows = [(i, t, "en", f"s{i % 3}" if i % 7 else None, len(t or "")) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, DOCS)
    if extra:  # columns with the names operators use inside
        for c in ("node", "key", "label", "size", "hash", "n_tokens", "kept", "quality_text", "line_removed", "mix_hash", "_at", "pos"):
            df = df.withColumn(c, F.lit("x"))
    return df


EDGES = [None, "", " ", "\n\n", "a", "a b c", "word " * 60, "é\x00\t日本語 𝔘", LONG, "x" * 5000, "<s> <|endoftext|> ▁", "tie", "tie", "tie"]


def by_id(df, key="doc_id"):
    return {r[key]: r for r in df.collect()}


# --- tokens -------------------------------------------------------------------------------------------------------


def random_texts(n, seed=3):
    r = random.Random(seed)
    kinds = [
        lambda: "".join(chr(r.choice([r.randrange(1, 128), r.randrange(0xA0, 0x2FF), r.randrange(0x4E00, 0x9000)])) for _ in range(r.randrange(60))),
        lambda: "".join(r.choice(" \n\t \x1c\x85ab.▁<|s>½²") for _ in range(r.randrange(60))),
        lambda: r.choice("a -.=0ab") * r.randrange(300),
        lambda: "".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(r.randrange(400))),
        lambda: " ".join(r.choice(["the", "ing,", "<s>", "</s>", "<|endoftext|>", "日本", "Ünß.", "don't", "x=1;", "3.14"]) for _ in range(r.randrange(40))),
    ]
    return [r.choice(kinds)() for _ in range(n)]


def test_piece_counts_equal_the_library():
    import sentencepiece

    path = P.path("piece_bpe_32k.model")
    lib, own = sentencepiece.SentencePieceProcessor(model_file=path), token_counts.counter(path)
    for t in random_texts(3000) + [t for t in EDGES if t]:
        assert own.count(t) == len(lib.encode(t)), t[:80]


def test_byte_bpe_equals_the_library():
    import tiktoken

    path = P.path("byte_bpe_multi_50k.tiktoken")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    lib, own = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={}), byte_bpe.codec(path, P.PATTERN)
    for t in random_texts(3000) + [t for t in EDGES if t]:
        ids = own.encode(t)
        assert ids == lib.encode_ordinary(t), t[:80]
        assert own.decode(ids) == t.encode()


def test_joining_is_associative():
    own = byte_bpe.codec(P.path("byte_bpe_multi_50k.tiktoken"), P.PATTERN)
    r = random.Random(1)
    for _ in range(300):
        data = bytes(r.choice(b"aabcething ") for _ in range(r.randrange(3, 90)))
        i, j = sorted(r.sample(range(len(data) + 1), 2))
        a, b, c = own.tree(data[:i]), own.tree(data[i:j]), own.tree(data[j:])
        assert own.join(own.join(a, b), c) == own.join(a, own.join(b, c)) == own._direct(data)


def test_token_queries_edges(spark):
    df = docs_of(spark, EDGES, extra=True)
    counts = by_id(token_counts.within_limit(token_counts.count_tokens(df, P.path("piece_bpe_32k.model")), 4096))
    assert counts[0].n_tokens == counts[1].n_tokens == 0 and counts[8].over_limit and not counts[4].over_limit
    trip = by_id(byte_bpe.round_trip(df, P.path("byte_bpe_multi_50k.tiktoken"), P.PATTERN))
    for i, t in enumerate(EDGES):
        assert trip[i].decoded_sha256 == hashlib.sha256((t or "").encode()).hexdigest()
    ids = byte_bpe.encode(df, P.path("byte_bpe_multi_50k.tiktoken"), P.PATTERN)
    back = by_id(byte_bpe.decode(ids, P.path("byte_bpe_multi_50k.tiktoken"), P.PATTERN))
    assert all(bytes(back[i].data) == (t or "").encode() for i, t in enumerate(EDGES))


# --- media --------------------------------------------------------------------------------------------------------


def test_media(spark):
    got = by_id(media.digests(media.media_columns(docs_of(spark, EDGES, extra=True))))
    for i, t in enumerate(EDGES):
        data = (t or "").encode()
        padded = data + bytes(-len(data) % 64) if data else bytes(64)
        r = got[i]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(data), len(padded), hashlib.sha256(padded).hexdigest(), zlib.crc32(padded[-64:]))
        wav = media.to_wav(padded)
        assert r.media_bytes == len(wav) and r.media_sha256 == hashlib.sha256(wav).hexdigest()
    assert got[11].feature == got[12].feature != got[8].feature
    assert got[0].n_pairs == 0 and got[8].n_pairs > 100


def test_fingerprint_finds_tones():
    t = np.arange(8000) / 8000
    wave = lambda hz: (128 + 100 * np.sin(2 * np.pi * hz * t)).astype(np.uint8).tobytes()
    _, codes = media.fingerprint(wave(1000))
    assert collections.Counter(codes >> 16).most_common(1)[0][0] == 32  # 1000 Hz of 8000 in 256 samples
    times, same = media.fingerprint(wave(1000))
    assert (codes == same).all() and (np.diff(times) >= 0).all()


# --- language -----------------------------------------------------------------------------------------------------


def test_language_held_out_accuracy(spark, sf_dir):
    out = queries.op4_language_id(spark, "/root/testdata/sf0.01")
    truth = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang")
    rows = out.join(truth, "doc_id").collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    tried = [r for r in rows if r.held_out]
    assert sum(r.lang_pred == r.lang for r in tried) >= 0.97 * len(tried)
    assert all(0 <= r.score <= 1 for r in rows)


def test_language_edges(spark, sf_dir):
    train = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = language.fit(train)
    got = by_id(language.predict(docs_of(spark, EDGES, extra=True), model, reject=False))
    assert got[0].lang_pred == got[1].lang_pred == "und" and got[0].score == 0
    assert by_id(language.predict(docs_of(spark, ["1234 !!"]), model))[0].lang_pred == "und"
    odd = by_id(language.predict(docs_of(spark, ["日本語の文章です。" * 20]), model))
    assert odd[0].rejected and odd[0].lang_pred == "und"
    assert language.fit(docs_of(spark, []).filter("false")) is None
    assert by_id(language.predict(docs_of(spark, ["some words"]), None))[0].lang_pred == "und"


# --- quality ------------------------------------------------------------------------------------------------------


def brute_quality(text):
    text = text or ""
    words = WORDS.findall(text)
    windows = collections.Counter(zip(words, words[1:], words[2:]))
    marked = {j for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for j in (i, i + 1, i + 2)}
    lines = [x for x in text.split("\n") if WORDS.search(x)]
    n = len(words)
    return n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(marked), n < 50 or 100 * len(marked) > 50 * n


def test_quality_measures(spark, sf_dir):
    texts = EDGES + [r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()] + ["a b c a b c d", "l\nl\n \nl", "\x85 \xa0 x\x1cy"]
    df = docs_of(spark, texts, extra=True)
    got = by_id(quality.judge_documents(df))
    for i, t in enumerate(texts):
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == brute_quality(t), repr(t)[:60]
        assert not (r.base_failed and r.kept)
    kept = quality.keep_good(df)
    assert kept.columns == df.columns and {r.doc_id for r in kept.collect()} == {i for i in got if got[i].kept}


def test_quality_tells_labelled_junk(spark):
    d = "/root/testdata/sf0.01"
    rows = queries.op5_quality_rules(spark, d).join(spark.read.parquet(f"{d}/labels.parquet"), "doc_id").collect()
    good = [r for r in rows if r.quality == 1 and not r.base_failed]
    bad = [r for r in rows if r.quality == 0 and not r.base_failed]
    assert sum(r.kept for r in good) >= 0.98 * len(good)
    assert sum(r.kept for r in bad) <= 0.2 * len(bad)


def test_js_distance():
    p, q = np.array([0.5, 0.5, 0.0]), np.array([[0.5, 0.5, 0.0], [0.0, 0.0, 1.0]])
    assert np.allclose(quality.js_distance(p, q), [0, 1])
    assert quality.references.__doc__ and quality.measure.__doc__


def test_quality_empty_table(spark):
    assert quality.judge_documents(docs_of(spark, []).filter("false")).count() == 0


# --- html ---------------------------------------------------------------------------------------------------------


def test_main_text_of_pages(spark, sf_dir):
    import html

    pages = by_id(spark.read.parquet(f"{sf_dir}/pages.parquet"), "page_id")
    for r in queries.op6_main_text(spark, sf_dir).collect():
        article = re.search(r"<article>(.*?)(</article>|$)", pages[r.page_id].html, re.S)[1]
        blocks = (" ".join(html.unescape(re.sub(r"<!--.*?-->|<[^>]*>", " ", b)).split()) for b in re.split(r"</?(?:p|h1)[^>]*>", article))
        assert r.text == "\n".join(b for b in blocks if b) and r.n_chars == len(r.text) and r.url == pages[r.page_id].url


@pytest.mark.parametrize(
    "page, text",
    [
        ("", ""),
        ("just words & more", "just words & more"),
        ("<p>a &amp; b<p>c\n  d&nbsp;e", "a & b\nc d e"),
        ("<nav>menu</nav><article><h1>T</h1><p>Body <b>bold</b> text.<br>On.</p><p>Of.</p></article><footer>f</footer>", "T\nBody bold text. On.\nOf."),
        ("<body><div class=sidebar>s</div><div id=content><p>one</p><p>two</p><form><input>z</form></div><div class='comments'><p>c</p></div></body>", "one\ntwo"),
        ("<article><p>x</p><script>var a='</p><p>no';</script><style>p{}</style><!-- <p>no</p> --><aside>no</aside><p>y</p><div class='cookie-notice'>no</div></article>", "x\ny"),
        ("<article><header><h1>Head</h1></header><ul><li>a<li>b</ul><table><tr><td>c<td>d</table>", "Head\na\nb\nc\nd"),
        ("</p></div>stray<b>", "stray"),
    ],
)
def test_main_text(page, text):
    assert html_text.extract(page) == text


def test_pages_edges(spark):
    df = spark.createDataFrame([(1, "u", None), (2, None, ""), (3, "u", "<p>" + "long " * 50000)], "page_id long, url string, html string").withColumn("text", F.lit("clash"))
    got = by_id(html_text.extract_pages(df, keep=("url",)), "page_id")
    assert got[1].text == got[2].text == "" and len(got[3].text) == 249_999 and got[2].url is None


# --- lines --------------------------------------------------------------------------------------------------------


def edit_distance(a, b):
    p = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        q = [i]
        for j, y in enumerate(b, 1):
            q.append(min(p[j] + 1, q[-1] + 1, p[j - 1] + (x != y)))
        p = q
    return p[-1]


def mutate(r, s, k):
    s = list(s)
    for _ in range(k):
        i, kind = r.randrange(len(s) + 1), r.randrange(3)
        if kind == 0 or i == len(s):
            s.insert(i, r.choice("abc"))
        elif kind == 1:
            s[i] = r.choice("abc")
        else:
            del s[i]
    return "".join(s)


def test_edit_distance_and_segments():
    r = random.Random(1)
    for _ in range(5000):
        e = r.randrange(0, 4)
        a = "".join(r.choice("abc") for _ in range(r.randrange(4, 20)))
        b = mutate(r, a, r.randrange(5))
        assert line_dedup.within(a, b, e) == (edit_distance(a, b) <= e)
        if len(b) > e and edit_distance(a, b) <= e:
            low, high = sorted((a, b), key=len)
            own = {(len(low), i, low[s : s + z]) for i, (s, z) in enumerate(line_dedup.segments(len(low), e))}
            assert own & {(o, i, high[x:y]) for o, i, x, y in line_dedup.probes(len(high), e)}


def brute_lines(rows):
    """Places removed, by document: classes by all pairs of distinct lines."""
    seen = {}
    for d, text in sorted(rows):
        for p, line in enumerate((text or "").split("\n")):
            line = line.strip(line_dedup.SPACES)
            if len(line) >= line_dedup.MIN_CHARS:
                seen.setdefault(line, []).append((d, p))
    lines, parent = list(seen), {x: x for x in seen}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(lines):
        for b in lines[:i]:
            if abs(len(a) - len(b)) <= line_dedup.EDITS and line_dedup.within(a, b, line_dedup.EDITS):
                parent[find(a)] = find(b)
    first, gone = {}, collections.defaultdict(list)
    for x in lines:
        first[find(x)] = min(first.get(find(x), (10**9, 0)), min(seen[x]))
    for x in lines:
        for o in seen[x]:
            if o != first[find(x)]:
                gone[o[0]].append(o[1])
    return {d: sorted(v) for d, v in gone.items()}


def near_texts(n=60):
    r = random.Random(4)
    base = ["".join(r.choice("abc de") for _ in range(60)) for _ in range(6)]
    chain = [base[0]]
    for _ in range(12):  # a chain whose ends aren't near each other
        chain.append(mutate(r, chain[-1], 2))
    pool = base + chain + [mutate(r, b, k) for b in base for k in (1, 2, 3)]
    return ["\n".join(r.choice([*pool, "short", "", f"own line {i} of document number {i * 7919} with text"]) for _ in range(5)) for i in range(n)]


def test_line_dedup_equals_brute_force(spark):
    texts = EDGES + near_texts()
    df = docs_of(spark, texts, extra=True)
    got = by_id(line_dedup.report(df))
    want = brute_lines(list(enumerate(texts)))
    assert {i: list(r.removed_lines) for i, r in got.items() if r.removed_lines} == want
    for i, t in enumerate(texts):
        left = "\n".join(x for p, x in enumerate(t.split("\n")) if p not in want.get(i, [])) if t is not None else ""
        assert got[i].text_sha256 == hashlib.sha256(left.encode()).hexdigest()
    out = by_id(line_dedup.dedup(df))
    assert set(out) == {i for i in got if got[i].kept} and line_dedup.dedup(df).columns == df.columns
    assert out[8].text == LONG and all(out[i].text == texts[i] for i in out if i not in want)


def test_line_dedup_large_group(spark):
    """One line in all documents, and many lines one edit from it."""
    line = "the very same line of text that stands everywhere in here"
    texts = [f"{line[:i % 50]}x{line[i % 50:]}\n{line}\nown words {hashlib.md5(str(i).encode()).hexdigest()} and nothing else" for i in range(300)]
    got = by_id(line_dedup.report(docs_of(spark, texts)))
    assert sum(len(r.removed_lines) for r in got.values()) == 599
    assert line_dedup.report(docs_of(spark, []).filter("false")).count() == 0


# --- near duplicates ----------------------------------------------------------------------------------------------


def shingle_set(text):
    words = WORDS.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def brute_classes(texts, percent):
    sets = [shingle_set(t) for t in texts]
    parent = list(range(len(texts)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            common = len(a & sets[j])
            if a and sets[j] and 100 * common >= percent * len(a | sets[j]):
                x, y = find(i), find(j)
                parent[max(x, y)] = min(x, y)
    return [find(i) for i in range(len(texts))], [len(s) for s in sets]


def copies(seed=9):
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(5))
    out = []
    for _ in range(6):
        base = [word() for _ in range(200)]
        chain = base
        for k in range(25):
            one = list(base)
            for _ in range(r.randrange(0, 8)):
                one[r.randrange(len(one))] = word()
            out.append(" ".join(one))
            chain = list(chain)
            chain[r.randrange(len(chain))] = word()
            out.append(" ".join(chain).upper())
    return out


@pytest.mark.parametrize("percent", [85, 80])
def test_near_duplicates_equal_brute_force(spark, percent):
    texts = EDGES + copies() + ["same text of more than five words here"] * 20
    df = docs_of(spark, texts, extra=True)
    roots, sizes = brute_classes(texts, percent)
    got = by_id(near_dups.classes(df, percent))
    for i in range(len(texts)):
        assert (got[i].n_shingles, got[i].component_id, got[i].kept) == (sizes[i], roots[i], roots[i] == i), i


def test_dense_buckets_in_blocks(spark, monkeypatch):
    """Large unsettled buckets, cut into several blocks, for documents and for lines."""
    monkeypatch.setattr(links, "PAIRWISE", 2)
    monkeypatch.setattr(links, "BLOCK_MEMBERS", 4)
    monkeypatch.setattr(links, "ROUNDS", 1)
    texts = copies(5)[:150]
    roots, _ = brute_classes(texts, 85)
    got = by_id(near_dups.classes(docs_of(spark, texts), 85))
    assert [got[i].component_id for i in range(len(texts))] == roots
    texts = near_texts(40)
    got = by_id(line_dedup.report(docs_of(spark, texts)))
    assert {i: list(r.removed_lines) for i, r in got.items() if r.removed_lines} == brute_lines(list(enumerate(texts)))


def test_products_find_similar_sets(monkeypatch):
    monkeypatch.setattr(near_dups, "COLUMNS", 64)
    r = np.random.default_rng(0)
    base = r.integers(0, 2**63, 300, dtype=np.uint64)

    def one():
        kept = r.random(300) > r.random() * 0.3
        return np.unique(np.concatenate([base[kept], r.integers(0, 2**63, int((~kept).sum()), dtype=np.uint64)]))

    a, b = [one() for _ in range(40)], [one() for _ in range(50)]

    def like(x, y):
        common = len(np.intersect1d(x, y))
        return 100 * common >= 85 * (len(x) + len(y) - common)

    find = near_dups.similar(85)
    assert sorted(find(a, b)) == [(i, j) for i in range(40) for j in range(50) if like(a[i], b[j])]
    assert sorted(find(a, None)) == [(i, j) for i in range(40) for j in range(i + 1, 40) if like(a[i], a[j])]


def test_near_duplicates_ids(spark):
    rows = [(None, "alpha beta gamma delta epsilon zeta"), (5, "alpha beta gamma delta epsilon zeta"), (3, None), (3, None), (None, "x"), (7, "one two three four five six"), (7, "one two three four five six")]
    got = sorted((r.doc_id or -1, r.component_id if r.component_id is not None else -1) for r in near_dups.classes(spark.createDataFrame(rows, "doc_id long, text string"), 85).collect())
    assert got == [(-1, -1), (-1, 5), (3, 3), (3, 3), (5, 5), (7, 7), (7, 7)]
    assert near_dups.classes(docs_of(spark, []).filter("false"), 85).count() == 0


def test_sketches_merge_and_estimate():
    r = np.random.default_rng(1)
    x = r.integers(0, 2**63, 3000, dtype=np.uint64)
    a, b = np.unique(x[:2000]), np.unique(x[500:2500])
    assert near_dups.merge_sketches(near_dups.sketch(a), near_dups.sketch(b)) == near_dups.sketch(np.unique(np.concatenate([a, b])))
    guess = near_dups.estimate(*(np.frombuffer(near_dups.sketch(s), np.uint8)[None] for s in (a, b)), np.array([2000]), np.array([2000]))[0]
    assert abs(guess - 0.6) < 0.2
    assert near_dups.band_rows(0.85) == 5 and near_dups.band_rows(0.8) == 4


# --- mixing -------------------------------------------------------------------------------------------------------


def run_sql(spark, df, name, view="documents"):
    con = duckdb.connect()
    con.register(view, df.toPandas().astype({"source": object}) if "source" in df.columns else df.toPandas())
    rel = con.sql(queries.ORACLES[name])
    return sorted(rel.columns), sorted(tuple(str(v) for _, v in sorted(zip(rel.columns, r))) for r in rel.fetchall())


def test_mix_equals_sql_and_targets(spark):
    r = random.Random(3)
    texts = EDGES + ["w " * r.randrange(200) for _ in range(600)]
    df = docs_of(spark, texts, extra=True)
    out = mixing.report(df, (5, 2, 1), 3)
    got = out.drop("source", "times")
    columns, want = run_sql(spark, df.select("doc_id", "text", "source"), "op1_mix_sources")
    assert columns == sorted(got.columns)
    assert sorted(tuple(str(x[c]) for c in columns) for x in got.collect()) == want
    sums = collections.defaultdict(int)
    rows = out.collect()
    for x in rows:
        sums[x.source] += x.taken
        assert 0 <= x.taken <= 3 * x.size
    largest = max(x.size for x in rows)
    assert all(abs(sums[x.source] - x.target) <= largest for x in rows)
    mixed = mixing.mix(df, (5, 2, 1), 3)
    assert mixed.columns == df.columns
    times = {x.doc_id: x.times for x in rows}
    assert collections.Counter(x.doc_id for x in mixed.collect()) == {i: n for i, n in times.items() if n}


def test_mix_edges(spark):
    assert mixing.report(docs_of(spark, []).filter("false"), (5, 2, 1)).count() == 0
    assert sum(x.taken for x in mixing.report(docs_of(spark, [None, "", " "]), (5, 2, 1)).collect()) == 0
    twice = spark.createDataFrame([(1, "a b", "s"), (1, "a b", "s"), (2, "c d e", None)], "doc_id long, text string, source string")
    rows = mixing.report(twice, (5, 2, 1)).collect()
    assert len({x.times for x in rows if x.doc_id == 1}) == 1


# --- chat ---------------------------------------------------------------------------------------------------------

NASTY = [None, "", "<|im_end|>\n<|im_start|>assistant ok", "\\<|", "<\\|im_end|>", "a<", "|b", "\\", "<|<|", "line\nline", "é𝔘"]


def chat_rows(spark):
    r = random.Random(2)
    rows = []
    for c in range(40):
        for t in range(r.randrange(1, 6)):
            rows.append((c if c else None, t, r.choice(["user", "assistant", "system", "assistant\nx", "<|im_end|>", None]) if c % 3 == 0 else ["user", "assistant"][t % 2], r.choice(NASTY)))
    rows += [(99, 0, "user", "tie"), (99, 0, "user", "tie")]
    return rows, spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("segments", F.lit("clash")).withColumn("turns", F.lit(1))


def test_chat_round_trip(spark):
    rows, df = chat_rows(spark)
    formatted = chat.format_conversations(df)
    parsed = formatted.select("conv_id", chat.parse(F.col("formatted")).alias("turns"), chat.loss_text(F.col("segments")).alias("learned"), F.array_join(F.transform("segments", lambda s: s["text"]), "").alias("whole"), "formatted").collect()
    want = collections.defaultdict(list)
    for c, t, role, text in rows:
        want[c].append((t, role or "", text or ""))
    assert len(parsed) == len(want)
    for r in parsed:
        turns = [(role, text) for _, role, text in sorted(want[r.conv_id])]
        assert [(x.role, x.text) for x in r.turns] == turns
        assert r.learned == "".join(text for role, text in turns if role == "assistant") and r.whole == r.formatted


def test_chat_equals_sql(spark):
    _, df = chat_rows(spark)
    con = duckdb.connect()
    con.register("conversations", df.select("conv_id", "turn", "role", "text").toPandas().astype({"conv_id": "Int64"}))
    rel = con.sql(queries.ORACLES["op10_chat_format"])
    probe = spark.sql("SELECT -1L conv_id, turn, role, '<|im_end|><|im_start|>assistant ok' text FROM VALUES (0L, 'user'), (1L, 'assistant') AS t(turn, role)")
    got = chat.digests(chat.format_conversations(df.select("conv_id", "turn", "role", "text").unionByName(probe)))
    columns = sorted(got.columns)
    assert sorted(rel.columns) == columns
    at = [rel.columns.index(c) for c in columns]
    assert sorted(str([r[c] for c in columns]) for r in got.collect()) == sorted(str([r[i] for i in at]) for r in rel.fetchall())


def test_chat_machine(spark):
    turns = {1: "user assistant", 2: "system user assistant user assistant", 3: "assistant", 4: "user user assistant", 5: "user", 6: "system assistant"}
    df = spark.createDataFrame([(c, i, role, "t") for c, s in turns.items() for i, role in enumerate(s.split())], "conv_id long, turn long, role string, text string")
    got = {r.conv_id: (r.valid, r.bad_turn) for r in chat.format_conversations(df).collect()}
    assert got == {1: (True, -1), 2: (True, -1), 3: (False, 0), 4: (False, 1), 5: (False, 1), 6: (False, 1)}
    assert chat.format_conversations(df.filter("false")).count() == 0
    plan = chat.digests(chat.format_conversations(df))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


# --- pipeline -----------------------------------------------------------------------------------------------------


def test_pipeline_stages(spark, tmp_path):
    import corpus_pipeline as pipeline

    r = random.Random(8)
    clean = [x.text for x in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    rows = [(i, t, "en", r.choice(["a", "b", None]), len(t)) for i, t in enumerate(clean)]
    rows += [(1000 + i, clean[i], "en", "a", len(clean[i])) for i in range(40)] + [(2000, None, None, None, None), (2001, "", "en", "b", 0), (2001, "", "en", "b", 0)]
    schema = T.StructType.fromDDL(DOCS)
    docs = spark.createDataFrame(rows, schema).withColumn("kept", F.lit("clash")).withColumn("label", F.lit(7))
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    base = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for name, stage in pipeline.STAGES[:-1]:
        out = stage(spark, base, str(tmp_path))
        assert out.columns == base.columns, name
        out.write.parquet(str(tmp_path / name))
        base = spark.read.parquet(str(tmp_path / name))
        assert base.count() > 0
    last = pipeline.STAGES[-1][1](spark, base, str(tmp_path))
    assert last.count() == base.count()
    empty = docs.filter("false")
    for _, stage in pipeline.STAGES:
        assert stage(spark, empty, str(tmp_path)).count() == 0


def test_pipeline_verdicts(spark):
    """Each stage's decision against brute force on one table."""
    import corpus_pipeline as pipeline

    texts = near_texts(30) + copies(3)[:60]
    df = docs_of(spark, texts)
    want = brute_lines(list(enumerate(texts)))
    out = by_id(pipeline.line_dedup_stage(spark, df, ""))
    for i, row in out.items():
        assert row.text == "\n".join(x for p, x in enumerate(texts[i].split("\n")) if p not in want.get(i, []))
        assert row.n_chars == len(row.text)
    roots, _ = brute_classes(texts, 80)
    assert {r.doc_id for r in pipeline.near_duplicates(spark, df, "").collect()} == {i for i, x in enumerate(roots) if i == x}
