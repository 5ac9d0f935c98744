"""Values that SQL can't express against plain reimplementations: fingerprints, centroids, distances, sketches."""

import cmath
import collections
import math
import random
import re

import numpy as np

from tickframe.llm import language, media, near_dups, quality
from tickframe.llm.runtime import WORD

# --- media --------------------------------------------------------------------------------------------------------


def plain_fingerprint(data):
    size, hop = 256, 128
    frames = []
    start = 0
    while True:
        frames.append(list(data[start : start + size]))
        if start + size >= len(data):
            break
        start += hop
    peaks = []
    for frame in frames:
        mean = sum(frame) / len(frame)
        x = [(v - mean) * (0.5 - 0.5 * math.cos(2 * math.pi * i / (size - 1))) for i, v in enumerate(frame)]
        spectrum = [abs(sum(v * cmath.exp(-2j * math.pi * k * i / size) for i, v in enumerate(x))) for k in range(size // 2 + 1)]
        tops = [(-spectrum[k], k) for k in range(1, size // 2) if spectrum[k] > spectrum[k - 1] and spectrum[k] >= spectrum[k + 1] and spectrum[k] > 1e-3]
        peaks.append([k for _, k in sorted(tops)[:2]])
    out = []
    for i, own in enumerate(peaks):
        if len(own) == 2:
            out.append((i, own[0] << 16 | own[1] << 8))
        for ahead in (1, 2, 3):
            if own and i + ahead < len(peaks) and peaks[i + ahead]:
                out.append((i, own[0] << 16 | peaks[i + ahead][0] << 8 | ahead))
    return out


def test_fingerprints_equal_a_plain_transform(monkeypatch):
    r = random.Random(8)
    for size in (64, 256, 320, 384, 1344):
        data = bytes(r.randrange(256) for _ in range(size))
        for block in (1, 3, 2048):  # frames don't depend on where blocks begin
            monkeypatch.setattr(media, "BLOCK", block)
            times, codes = media.fingerprint(data)
            assert list(zip(times.tolist(), codes.tolist())) == plain_fingerprint(data)
    assert media.fingerprint(bytes(64))[0].size == 0


# --- language -----------------------------------------------------------------------------------------------------


def grams(text):
    """Trigrams of bytes by the cell each falls into."""
    letters = re.sub(r"[\W\d_]+", " ", text.lower())
    data = f" {letters} ".encode()
    return collections.Counter(((data[i] << 16 | data[i + 1] << 8 | data[i + 2]) * 2654435761 % 2**32) >> 20 for i in range(len(data) - 2))


def words_of(r, letters, n):
    return " ".join("".join(r.choice(letters) for _ in range(r.randrange(2, 7))) for _ in range(n))


def test_languages_by_plain_cosines():
    r = random.Random(4)
    alphabets = {"aa": "abcdef", "bb": "defghi", "cc": "ghijka"}
    rows = [(lang, words_of(r, letters, 60)) for lang, letters in alphabets.items() for _ in range(25)]
    table = np.array([language.counts(text) for _, text in rows], dtype=np.float32)
    model = language.Model([lang for lang, _ in rows], table)
    counted = [grams(text) for _, text in rows]
    idf = {c: math.log((1 + len(rows)) / (1 + sum(c in g for g in counted))) + 1 for c in range(language.DIM)}

    def vector(text):
        v = {c: (1 + math.log(n)) * idf[c] for c, n in grams(text).items()}
        length = math.sqrt(sum(x * x for x in v.values()))
        return {c: x / length for c, x in v.items()}

    assert len(model.centres) == language.CENTROIDS * 3 and np.allclose(np.linalg.norm(model.centres, axis=1), 1, atol=1e-5)
    for lang in alphabets:
        own = [vector(text) for name, text in rows if name == lang]
        centres = model.centres[[model.langs[i] == lang for i in model.owner]]
        cosines = [[sum(x * centre[c] for c, x in v.items()) for centre in centres] for v in own]
        near = [max(range(len(centres)), key=c.__getitem__) for c in cosines]
        for k, centre in enumerate(centres):  # each centroid is the direction of its texts' mean
            mine = [v for v, n in zip(own, near) if n == k]
            if mine:
                mean = np.array([sum(v.get(c, 0) for v in mine) for c in range(language.DIM)])
                assert np.allclose(centre, mean / np.linalg.norm(mean), atol=1e-4)
        radius = 1 - np.quantile([max(c) for c in cosines], 1 - language.WITHIN) + language.SLACK
        assert abs(model.radius[model.langs.index(lang)] - radius) < 1e-4
    for lang, letters in [*alphabets.items(), ("none", "xyz")]:
        text = words_of(r, letters, 40)
        v = vector(text)
        scores = [(sum(x * centre[c] for c, x in v.items()), model.langs[i]) for centre, i in zip(model.centres, model.owner)]
        best, found = max(scores)
        got = model.predict(text)
        assert got[0] == found and abs(got[1] - best) < 1e-4 and got[2] == (1 - best > model.radius[model.langs.index(found)])
        assert got[2] if lang == "none" else got[0] == lang


def test_rows_without_id_are_learned_from(spark):
    r = random.Random(1)
    rows = [(None if lang == "aa" else i, words_of(r, letters, 40), lang) for i in range(60) for lang, letters in (("aa", "abcdef"), ("bb", "uvwxyz"))]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    one, two = language.fit(df), language.fit(df.orderBy("text"))
    assert one.langs == ["aa", "bb"] and (one.centres == two.centres).all()


def test_sample_is_bounded_and_shared(spark, monkeypatch):
    monkeypatch.setattr(language, "SAMPLE", 10)
    monkeypatch.setattr(language, "SAMPLE_ROWS", 30)
    monkeypatch.setattr(language, "LEAST", 4)
    r = random.Random(2)
    rows = [(i, words_of(r, letters, 20), lang) for lang, letters in (("aa", "abcdef"), ("bb", "uvwxyz")) for i in range(400)] + [(9, "some same words", "cc")] * 500
    seen = []
    monkeypatch.setattr(language, "Model", lambda langs, table: seen.extend(langs))
    language.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert len(seen) <= 30 and {"aa", "bb"} <= set(seen)


# --- quality ------------------------------------------------------------------------------------------------------


def js(p, q):
    total = 0.0
    for k in set(p) | set(q):
        a, b = p.get(k, 0.0), q.get(k, 0.0)
        m = (a + b) / 2
        total += (a * math.log2(a / m) if a else 0) / 2 + (b * math.log2(b / m) if b else 0) / 2
    return math.sqrt(max(0.0, total))


def noise(shares, n):
    """Mean divergence of Poisson counts around n * share, by plain sums."""
    total = 0.0
    for share in shares:
        rate = n * share
        if rate > 250:
            total += 1 / (8 * math.log(2))
        elif rate:
            for c in range(int(rate + 12 * math.sqrt(rate) + 20)):
                chance = math.exp(c * math.log(rate) - rate - math.lgamma(c + 1))
                total += chance * ((c * math.log2(2 * c / (c + rate)) if c else 0) + rate * math.log2(2 * rate / (c + rate))) / 2
    return total / n


def test_sampling_noise_is_that_of_samples():
    r = np.random.default_rng(1)
    for size in (20, 300):
        shares = r.dirichlet(np.ones(size))
        for n in (60, 1000):
            drawn = r.multinomial(n, shares, 2000) / n
            mean = (quality.js_distance(drawn, shares) ** 2).mean()
            assert abs(quality.sampling_noise(shares, n) - mean) < 0.06 * mean
            assert abs(quality.sampling_noise(shares, n) - noise(shares, n)) < 0.01 * mean


def test_flat_vocabulary_is_kept(spark):
    """Many equally common words: what is far from their shares is the sample, not the text."""
    r = random.Random(2)
    words = [words_of(r, "abcdefghij", 1) + str(i) for i in range(300)]
    rows = [(i, " ".join(r.choice(words) for _ in range(200)), "xx") for i in range(300)]
    got = quality.judge_documents(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()
    assert sum(x.kept for x in got) >= 297


def kind(c):
    import unicodedata

    k = unicodedata.category(c)
    if c == "\n":
        return "line end"
    if c.isspace():
        return "space"
    if k in ("Ll", "Lu"):
        return k
    if c in ".,;:?":
        return "stop"
    if c in "'\"()-" or k in ("Pi", "Pf", "Pd"):
        return "quote"
    return {"L": "letter", "M": "letter", "N": "digit", "C": "control"}.get(k[0], "symbol")


def shares(counter):
    total = sum(counter.values())
    return {k: n / total for k, n in counter.items()}


def test_quality_distances_equal_plain_ones(spark):
    r = random.Random(6)
    vocabulary = {"en": ["the", "of", "And", "to"] * 30 + [words_of(r, "abcdefgh", 1) for _ in range(300)], None: ["der", "und", "Zu"] * 40 + [words_of(r, "ijklmnop", 1) for _ in range(300)]}
    rows = []
    for i in range(120):
        lang = (None, "en")[i % 2]
        text = " ".join(r.choice(vocabulary[lang]) for _ in range(r.randrange(40, 400))) + r.choice([".", "!\n", " 123", "", " ###%%% " * 60])
        rows.append((i, text, lang))
    rows += [(200, "@@ 11 " * 90, "en"), (201, None, "en"), (202, "", None)]
    refs = {}
    for lang in ("en", None):
        texts = [t or "" for _, t, own in rows if own == lang]
        words = collections.Counter(w for t in texts for w in re.findall(WORD, t.lower()))
        total = sum(words.values())
        common = {w: n / total for w, n in words.items() if n >= total / 400}
        refs[lang] = (shares(collections.Counter(kind(c) for t in texts for c in t)), {**common, None: 1 - sum(common.values())})
    got = {x.doc_id: x for x in quality.judge_documents(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    judged = 0
    for i, text, _ in rows:
        text = text or ""
        words = re.findall(WORD, text)
        if len(words) < 50:
            assert got[i].class_distance is None and got[i].base_failed and not got[i].kept
            continue
        mine = collections.Counter(re.findall(WORD, text.lower()))
        pairs = []
        for shape, common in refs.values():
            seen = {w: mine[w] / len(words) for w in common if w is not None}
            far = js({**seen, None: 1 - sum(seen.values())}, common)
            pairs.append((js(shares(collections.Counter(map(kind, text))), shape), far, math.sqrt(max(0, far**2 - noise(common.values(), len(words))))))
        near, far, excess = min(pairs, key=lambda x: max(x[:2]))
        assert abs(got[i].class_distance - near) < 1e-9 and abs(got[i].word_distance - far) < 1e-9
        assert got[i].kept == (not got[i].base_failed and near <= quality.CLASS_LIMIT and excess <= quality.WORD_LIMIT)
        judged += got[i].kept != (not got[i].base_failed)
    assert judged > 5  # some are rejected by distance alone


# --- near duplicates ----------------------------------------------------------------------------------------------


def test_small_sets_share_no_band_by_chance():
    r = np.random.default_rng(3)
    rows = near_dups.band_rows(0.85)
    drawn = [near_dups.sketch(r.integers(0, 2**63, 1, dtype=np.uint64)) for _ in range(20_000)]
    bands = [collections.Counter(s[i * rows : (i + 1) * rows] for s in drawn) for i in range(near_dups.REGISTERS // rows)]
    assert max(max(b.values()) for b in bands) <= 2 and not any(bytes(rows) in b for b in bands)
    assert max(near_dups.sketch(r.integers(0, 2**63, 200_000, dtype=np.uint64))) < near_dups.TOP


def test_rows_that_share_an_id_are_one_document(spark):
    a, b, c = ("alpha beta gamma delta epsilon", "one two three four five six", "red green blue white black grey")
    rows = [(5, a), (5, b), (3, a), (8, b), (9, c), (9, c), (7, c), (None, b)]
    got = sorted((r.doc_id or 0, r.component_id) for r in near_dups.classes(spark.createDataFrame(rows, "doc_id long, text string"), 85).collect())
    assert got == [(0, 3), (3, 3), (5, 3), (5, 3), (7, 7), (8, 3), (9, 7), (9, 7)]
