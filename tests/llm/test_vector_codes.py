import hashlib
import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from mirrorline.llm import vector_codes as V


def brute(rows, parts, entries, rounds):
    """rows of (vec_id, vector, label), all of one length -> (vec_id, label, code, error), digest."""
    kept = [(i, [math.floor(1024 * x) for x in v], y) for i, v, y in rows
            if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    size = len(kept[0][1]) // parts
    cut = [[v[p * size:(p + 1) * size] for p in range(parts)] for _, v, _ in kept]
    books = [[c[p] for c in cut[:entries]] for p in range(parts)]

    def nearest(part, book):
        return min((sum((a - b) ** 2 for a, b in zip(part, e, strict=True)), i) for i, e in enumerate(book))
    for _ in range(rounds):
        for p in range(parts):
            held = {}
            for c in cut:
                held.setdefault(nearest(c[p], books[p])[1], []).append(c[p])
            books[p] = [[sum(col) // len(held[i]) for col in zip(*held[i], strict=True)] if i in held else e for i, e in enumerate(books[p])]
    out = []
    for (i, _, y), c in zip(kept, cut, strict=True):
        best = [nearest(c[p], books[p]) for p in range(parts)]
        out.append((i, y, "".join(f"{e:02x}" for _, e in best), sum(d for d, _ in best)))
    return out, hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()


def _table(spark, rows):
    return spark.createDataFrame([(*r, "x") for r in rows], "vec_id bigint, embedding array<double>, label int, code string").repartition(3)


def _rows(seed, n=90, dim=20):
    rng = np.random.default_rng(seed)
    return [(int(i), [round(float(x), 2) for x in rng.normal(size=dim)], int(rng.integers(3)) if i % 5 else None) for i in range(n)]


@pytest.mark.parametrize("entries,big", [(7, 0), (256, 0), (7, 3.0e14)])
def test_matches_plain_distances(spark, entries, big):
    rows = _rows(1) + [(3, [0.5] * 20, 1), (3, [0.25] * 20, 1), (200, [0.5] * 20, 2), (201, [0.5] * 20, 2), (None, [0.0] * 20, None),
                       (300, None, 1), (301, [None] + [0.0] * 19, 1), (302, [float("nan")] * 20, 1), (303, [float("-inf")] + [1.0] * 19, 1)]
    odd = [(400, [], 1), (401, [1.0] * 4, 1)]
    if big:
        rows.append((500, [big] * 20, 9))
    got = V.compress(_table(spark, rows + odd), entries=entries).collect()
    want, digest = brute(rows, 4, entries, 4)
    fits = lambda e: e if e < 2**63 else None
    assert sorted((tuple(r[:4]) for r in got), key=str) == sorted(((i, y, c, fits(e)) for i, y, c, e in want), key=str)
    sums = {}
    for _, y, _, e in want:
        sums[y] = sums.get(y, 0) + e
    if not big:
        assert all(r["label_error"] == sums[r["label"]] for r in got)
    assert {r["codebooks_sha256"] for r in got} == {digest}


def test_no_vector_no_rows(spark):
    rows = [(1, None, 1), (2, [float("nan")], 1), (3, [], 2)]
    assert V.compress(_table(spark, rows)).count() == 0
    assert V.compress(_table(spark, rows).limit(0)).columns == V.compress(_table(spark, rows)).columns


@given(st.integers(1, 9), st.sampled_from([1, 2, 5, 40]), st.integers(0, 2**31), st.sampled_from([2, 50, 2**20, 2**40]))
@settings(max_examples=120, deadline=None)
def test_elimination_keeps_the_nearest_and_ties(length, entries, seed, size):
    rng = np.random.default_rng(seed)
    parts, book = rng.integers(-size, size, (30, length)), rng.integers(-size, size, (entries, length))
    code, error = V.nearest(parts, book)
    for p, c, e in zip(parts.tolist(), code, error, strict=True):
        assert (int(e), int(c)) == min((sum((a - b) ** 2 for a, b in zip(p, x, strict=True)), i) for i, x in enumerate(book.tolist()))


def test_sequency_order_counts_sign_changes():
    h = V.walsh(np.eye(16, dtype=np.int64)).T  # rows: basis functions
    assert [int((r[1:] != r[:-1]).sum()) for r in h] == list(range(16))
