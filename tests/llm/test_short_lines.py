"""Line dedup of short lines: equal ones of any length, near ones from NEAR_CHARS on."""

import random

from tickframe.llm import line_dedup

from test_corpus import by_id, docs_of, edit_distance, mutate


def brute(texts):
    """Places removed, by document: all pairs of distinct lines by the full edit distance."""
    seen = {}
    for d, text in enumerate(texts):
        for p, line in enumerate(text.split("\n")):
            if line.strip():
                seen.setdefault(line.strip(), []).append((d, p))
    lines, parent = list(seen), {x: x for x in seen}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(lines):
        for b in lines[:i]:
            if min(len(a), len(b)) >= line_dedup.NEAR_CHARS and edit_distance(a, b) <= line_dedup.EDITS:
                parent[find(a)] = find(b)
    groups, gone = {}, {}
    for x in lines:
        groups.setdefault(find(x), []).extend(seen[x])
    for places in groups.values():
        for d, p in sorted(places)[1:]:
            gone.setdefault(d, []).append(p)
    return {d: sorted(v) for d, v in gone.items()}


def test_short_lines_equal_brute_force(spark):
    r = random.Random(6)
    pool = ["".join(r.choice("abc de") for _ in range(n)).strip() or "x" for n in range(1, 45)]
    pool += [mutate(r, x, k) for x in pool for k in (1, 2, 3)]
    pool += ["All rights reserved.", "Released under the MIT License.", " Les. ", "To.", "Of.", "", "  "]
    texts = ["\n".join(r.choice(pool) for _ in range(6)) for _ in range(80)]
    got = by_id(line_dedup.report(docs_of(spark, texts)))
    assert {i: list(x.removed_lines) for i, x in got.items() if x.removed_lines} == brute(texts)


def test_shared_notice_is_removed(spark):
    texts = [f"All rights reserved.\nown words of the document number {i * 7919} and its text\n\nTo." for i in range(3)]
    got = by_id(line_dedup.report(docs_of(spark, texts)))
    assert [list(got[i].removed_lines) for i in range(3)] == [[], [0, 3], [0, 3]]
