import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from mirrorline.llm import divergence as D


def brute(rows, min_docs, top):
    """rows of (lang, source, text)."""
    rows = [tuple(x or "" for x in r) for r in rows]
    counts, df = defaultdict(Counter), defaultdict(Counter)
    for lang, source, text in rows:
        own = Counter(re.findall("[^\x00-\x40\x5b-\x60\x7b-\x7f]+", re.sub("[A-Z]", lambda m: m[0].lower(), text)))
        counts[lang, source].update(own)
        df[lang].update(own.keys())
    out = set()
    for lang in {r[0] for r in rows}:
        kept = [t for t, n in df[lang].items() if n >= min_docs]
        groups = sorted({r[1] for r in rows if r[0] == lang})

        def shares(own, kept=kept):
            whole = sum(own[t] for t in kept) + 5 * len(kept)
            return {t: 1 + 10**9 * (own[t] + 5) // whole for t in kept}
        p = {g: shares(counts[lang, g]) for g in groups}
        q = shares(sum((counts[lang, g] for g in groups), Counter()))
        for g in groups:
            pairs = sorted((-sum(abs(p[g][t] - p[o][t]) for t in kept), o.encode(), o) for o in groups if o != g)
            out |= {(lang, g, "pair", o, -v, i + 1) for i, (v, _, o) in enumerate(pairs)}
            terms = sorted((q[t] - p[g][t], t.encode(), t) for t in kept if counts[lang, g][t] and p[g][t] > q[t])
            out |= {(lang, g, "term", t, -v, i + 1) for i, (v, _, t) in enumerate(terms[:top])}
    return out


ROWS = [("en", f"s{i % 7}", " ".join(f"W{(i * k) % 23}x{chr(97 + (i * k) % 23)} Ünder{chr(97 + k % 5)}" for k in range(i % 11))) for i in range(120)] + [
    ("de", "s1", "eins zwei"), ("de", None, "eins zwei drei"), (None, None, None), ("fr", "only", "un deux " * 5), ("fr", "only", "un deux")]


@pytest.mark.parametrize("block,tile", [(1 << 16, 16), (5, 2), (3, 1)])
def test_matches_plain_sums_in_any_blocks_and_tiles(spark, block, tile):
    docs = spark.createDataFrame([(*r, "x") for r in ROWS], "lang string, source string, text string, n string").repartition(3)
    got = {tuple(r) for r in D.audit(docs, min_docs=2, top_terms=4, block_terms=block, tile_groups=tile).collect()}
    assert got == brute(ROWS, 2, 4)


def test_odd_and_empty_tables(spark, odd, empty):
    rows = [(None, r["source"], r["text"]) for r in odd.collect()]
    docs = spark.createDataFrame(rows, "lang string, source string, text string")
    assert {tuple(r) for r in D.audit(docs, min_docs=1).collect()} == brute(rows, 1, 50)
    assert D.audit(docs.limit(0)).count() == 0


@given(st.integers(1, 80), st.data())
@settings(max_examples=150, deadline=None)
def test_gallop_finds_what_both_have(ids, data):
    a, b = (np.array(sorted(data.draw(st.sets(st.integers(0, ids - 1)))), np.int64) for _ in range(2))
    if len(a) > len(b):
        a, b = b, a
    at_a, at_b = D.gallop(a, b, ids)
    assert a[at_a].tolist() == b[at_b].tolist() == sorted(set(a.tolist()) & set(b.tolist()))


def test_shares_of_counts_beyond_a_long_product():
    n = np.array([0, 7, 10**13], np.int64)
    assert D._shares(n, 10**14).tolist() == [1 + 10**9 * (int(k) + 5) // 10**14 for k in n]
