"""Fingerprints and groups against brute force."""
import random
import re

import numpy as np
import xxhash

from mirrorline.llm import components, simhash


def fingerprint(text, shingle=3):
    text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    if not words:
        return 0
    own = [" ".join(words[i: i + shingle]) for i in range(len(words) - shingle + 1)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in own]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(own))


def groups(fps, radius=3):
    root = list(range(len(fps)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i
    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= radius:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(fps))]


def corpus(n=120):
    rnd = random.Random(4)
    words = ["".join(rnd.choices("abcdeé", k=rnd.randint(1, 6))) for _ in range(400)]
    texts = [" ".join(rnd.choices(words, k=rnd.randint(1, 400))) for _ in range(n)]
    for i in range(0, n, 3):
        own = texts[i].split(" ")
        for _ in range(rnd.randint(0, 3)):
            own[rnd.randrange(len(own))] = rnd.choice(words)
        texts.append("\t".join(own).upper() if i % 2 else "  ".join(own))
    return texts + ["", None, " \n", texts[0], texts[0]]


def test_groups_match_brute_force(spark):
    texts = corpus()
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(3)
    got = {r["doc_id"]: (r["fp"] % (1 << 64), r["component_id"]) for r in simhash.near_duplicates(docs).collect()}
    fps = [fingerprint(t) for t in texts]
    assert [got[i][0] for i in range(len(texts))] == fps
    assert [got[i][1] for i in range(len(texts))] == groups(fps)


def test_hot_deals_are_cut_without_losing_links(spark, monkeypatch):
    monkeypatch.setattr(simhash, "DEAL_ROWS", 7)
    rnd = random.Random(1)
    fps = {0}
    while len(fps) < 150:  # a chain: everything within reach, many in one deal
        fps.add(rnd.choice(sorted(fps)) ^ (1 << rnd.randrange(40)))
    fps |= {rnd.getrandbits(64) for _ in range(50)}
    signed = [(f - (1 << 64) if f >> 63 else f,) for f in fps]
    links = simhash.links(spark.createDataFrame(signed, "fp bigint"))
    label = {r["node"] % (1 << 64): r["label"] for r in components.components(links).collect()}
    own = sorted(fps)
    expected = groups(own)
    by_root, by_label = {}, {}
    for f, g in zip(own, expected):
        by_root.setdefault(g, set()).add(f)
        by_label.setdefault(label.get(f, ("alone", f)), set()).add(f)
    assert sorted(map(sorted, by_root.values())) == sorted(map(sorted, by_label.values()))
    assert links.count() <= 10 * len(own)  # forests, not all pairs


def test_long_chain_of_links(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 101)], "a bigint, b bigint")
    got = {r["node"]: r["label"] for r in components.components(links).collect()}
    assert got == {**{i: 0 for i in range(61)}, 100: 100, 101: 100}


def test_lane_counts_over_255_shingles():
    text = " ".join(f"w{i}" for i in range(3000)) + " same" * 700
    from mirrorline.llm.common import text_bytes
    import pyarrow as pa
    got = simhash.fingerprint_rows(*text_bytes(pa.array([text, None, "a b"])))
    assert got.tolist() == [fingerprint(text), 0, fingerprint("a b")]
    assert got.dtype == np.uint64


def test_odd_rows_and_one_of_each(odd, empty):
    got = {(r["doc_id"], r["fp"], r["component_id"]) for r in simhash.near_duplicates(odd).collect()}
    assert len(simhash.near_duplicates(odd).collect()) == odd.count()
    assert (5, next(f for i, f, _ in got if i == 4), 4) in got
    assert (None, 0, 1) in got  # no words: zero, grouped with the empty text of id 1
    kept = simhash.one_of_each(odd)
    assert kept.columns == odd.columns
    ids = sorted((r["doc_id"] for r in kept.collect()), key=lambda x: (x is None, x))
    assert ids == [1, 2, 3, 4, 6]
    assert simhash.near_duplicates(empty).count() == 0 and simhash.one_of_each(empty).count() == 0


def test_tiles_of_groups_of_every_size():
    """One path for all groups: tiles hold several small groups or a part of a large
    one, and tile pairs out of reach are skipped."""
    rnd = np.random.default_rng(4)
    sizes = [1, 2, 3, 9, 700, 1, 64, 65, 300, 2]
    group = np.repeat(np.arange(len(sizes)), sizes)
    part = np.where(group == 8, rnd.integers(0, 2, len(group)), 0)
    base = rnd.integers(0, 1 << 63, len(sizes), dtype=np.uint64)
    spread = np.zeros(len(group), np.uint64)
    for bit in rnd.integers(0, 64, (len(group), 12)).T:
        spread |= np.uint64(1) << bit.astype(np.uint64)
    fp = base[group] ^ np.where(rnd.random(len(group)) < .5, spread, spread & np.uint64(7))
    order = np.lexsort((np.bitwise_count(fp), group))
    met = [(len(a), skipped) for a, _, skipped in simhash.tile_pairs(group[order], np.bitwise_count(fp[order]).astype(int), 3)]
    assert sum(s for _, s in met) > 0
    a, b = simhash._forest(group, part, fp, 3)
    assert len(a) < len(fp)

    def classes(pairs, rows):
        root = {r: r for r in rows}

        def top(r):
            while root[r] != r:
                r = root[r]
            return r
        for x, y in pairs:
            root[max(top(x), top(y))] = min(top(x), top(y))
        return {r: top(r) for r in rows}
    rows = {(int(f)) for f in fp}
    brute = [(int(fp[i]), int(fp[j])) for i in range(len(fp)) for j in range(i) if group[i] == group[j] and (group[i] != 8 or part[i] != part[j])
             and int(fp[i] ^ fp[j]).bit_count() <= 3]
    assert classes(zip(a.tolist(), b.tolist()), rows) == classes(brute, rows)
