"""Repeated substrings against brute force, and the sorter on its own."""
import hashlib
import random

import numpy as np
import pytest

from mirrorline.llm import substrings


def brute(rows, length):
    texts = [(t or "").encode() for _, t in rows]
    seen = {}
    for b in texts:
        for p in range(len(b) - length + 1):
            seen[b[p: p + length]] = seen.get(b[p: p + length], 0) + 1
    out = []
    for (i, _), b in zip(rows, texts):
        gone = np.zeros(len(b), bool)
        for p in range(len(b) - length + 1):
            if seen[b[p: p + length]] > 1:
                gone[p: p + length] = True
        spans = int((gone & ~np.concatenate(([False], gone[:-1]))).sum()) if len(b) else 0
        out.append((i, len(b), int(gone.sum()), spans, hashlib.sha256(np.frombuffer(b, np.uint8)[~gone].tobytes()).hexdigest()))
    return sorted(out, key=str)


def corpus(seed, n=30):
    rnd = random.Random(seed)
    words = ["".join(rnd.choices("abcdé", k=rnd.randint(1, 6))) for _ in range(60)]
    passages = [" ".join(rnd.choices(words, k=rnd.randint(40, 90))) for _ in range(6)]
    line = " ".join(rnd.choices(words, k=30))
    rows = []
    for i in range(n):
        text = " ".join(rnd.choices(words, k=rnd.randint(0, 120)))
        for _ in range(rnd.randint(0, 3)):
            text += rnd.choice(passages)[rnd.randint(0, 60):] + " ".join(rnd.choices(words, k=rnd.randint(0, 30)))
        rows.append((i, text + line * (rnd.random() < .5)))
        if rnd.random() < .3 and text:
            rows.append((i + 1000, text[: len(text) // 2] + "Z" + text[len(text) // 2:]))
    return rows + [(None, None), (None, ""), (5000, "ab" * 500), rows[3], (None, rows[4][1]), (None, rows[4][1])]


@pytest.mark.parametrize("length, hot", [(60, 1000), (200, 2)])
def test_matches_brute_force(spark, monkeypatch, length, hot):
    monkeypatch.setattr(substrings, "HOT", hot)
    rows = corpus(length + hot)
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    got = sorted((tuple(r) for r in substrings.remove_repeats(docs, length=length, with_text=False).collect()), key=str)
    assert got == brute(rows, length)


def test_chunks_of_a_long_text_do_not_matter(monkeypatch):
    from mirrorline.llm.common import SpanHash
    rnd = random.Random(2)
    data = np.frombuffer(bytes(rnd.choices(b"abcd", k=5000)), np.uint8)
    ends = np.array([0, 100, 2500, 2500, 5000])
    whole = substrings.Anchors(data, ends, SpanHash(), 200)
    windows = {(r, p): h for r, a, b, h in zip(whole.row, whole.p0, whole.p1, whole.hash) for p in range(a, b + 1)}
    monkeypatch.setattr(substrings, "CHUNK", 700)
    cut = substrings.Anchors(data, ends, SpanHash(), 200)
    again = {(r, p): h for r, a, b, h in zip(cut.row, cut.p0, cut.p1, cut.hash) for p in range(a, b + 1)}
    assert windows == again and len(windows) == (2400 - 199) + (2500 - 199)


def test_deep_shallow_sorts():
    rnd = random.Random(3)
    base = bytes(rnd.choices(b"ab", k=150))
    texts = [base[: rnd.randint(60, 150)] + bytes(rnd.choices(b"abc", k=rnd.randint(0, 30))) for _ in range(80)] + [b"", b"\0", b"\0\0", base, base]
    group = np.sort(np.random.default_rng(1).integers(0, 4, len(texts)))
    order = substrings.deep_shallow(texts, group)
    assert [(group[i], texts[i]) for i in order] == sorted((g, t) for g, t in zip(group, texts))


def test_odd_rows(odd, empty):
    rows = [(r["doc_id"], r["text"]) for r in odd.collect()]
    got = sorted((tuple(r) for r in substrings.remove_repeats(odd, with_text=False).collect()), key=str)
    assert got == brute(rows, 200)
    assert substrings.remove_repeats(empty).count() == 0
