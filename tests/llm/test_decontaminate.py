"""The FM-index and the operator against plain search."""
import random

import numpy as np
from pyspark.sql import functions as F

from mirrorline.llm import decontaminate as D


def test_index_finds_and_locates_everything():
    rnd = random.Random(5)
    symbols = [0]
    for _ in range(12):
        symbols += rnd.choices([1, 2, 3, 4, 5], k=rnd.randint(1, 60)) + [0]
    symbols = np.array(symbols)
    index = D.FMIndex(symbols, 3)
    phrases = [tuple(rnd.choices([1, 2, 3, 4, 5], k=rnd.randint(1, 5))) for _ in range(60)]
    grid = np.zeros((len(phrases), 5), np.int64)
    for k, p in enumerate(phrases):
        grid[k, 5 - len(p):] = p
    low, high = index.search(grid)
    own = symbols.tolist()
    for k, p in enumerate(phrases):
        expected = [i for i in range(len(own)) if tuple(own[i: i + len(p)]) == p]
        assert sorted(index.locate(np.arange(low[k], high[k])).tolist()) == expected


def brute(text, items, size=10):
    import re
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    own = words(text)
    hit, named = set(), set()
    for i, t in items:
        w = words(t)
        for p in range(max(1, len(w) - size + 1) if w else 0):
            win = w[p: p + size]
            for a in range(len(own) - len(win) + 1):
                if own[a: a + len(win)] == win:
                    hit |= set(range(a, a + len(win)))
                    named |= set() if i is None else {str(i)}
    return len(own), len(hit), sorted(named)


def _case():
    rnd = random.Random(6)
    words = ["a", "B", "ça", "d9", "éé", "fin", "Go"]
    items = [(i, " ".join(rnd.choices(words, k=rnd.choice([3, 9, 10, 14, 25])))) for i in range(12)] + [(50, ""), (51, "?!"), (None, "a b"), (52, None)]
    docs = []
    for i in range(40):
        text = " ".join(rnd.choices(words, k=rnd.randint(0, 60)))
        if i % 3 == 0:
            text += ", " + items[rnd.randrange(12)][1].upper() + ". " + " ".join(rnd.choices(words, k=5))
        docs.append((i, text))
    return docs, items


def test_matches_plain_search_in_one_or_many_blocks(spark, monkeypatch):
    docs, items = _case()
    d = spark.createDataFrame(docs, "doc_id bigint, text string").repartition(2)
    b = spark.createDataFrame(items, "item_id bigint, text string")
    for block in (1 << 20, 100):
        monkeypatch.setattr(D, "BLOCK_BYTES", block)
        for r in D.find_passages(d, b).collect():
            n = sum(s["last_word"] - s["first_word"] + 1 for s in r["spans"])
            assert (r["n_words"], n, r["items"]) == brute(r["text"], items), r["text"]


def _found(spark, texts, items):
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    b = spark.createDataFrame(items, "item_id bigint, text string")
    return [(r["n_words"], sum(s["last_word"] - s["first_word"] + 1 for s in r["spans"]), r["items"])
            for r in D.find_passages(d, b).orderBy("doc_id").collect()]


def test_short_items_in_tables_of_one_document(spark):
    nine = "one two three four five six seven eight nine"
    for text, item in (("alpha", "alpha"), ("see alpha beta gamma now", "alpha beta gamma"), (nine, nine), (f"x {nine} y", nine), ("", "alpha")):
        assert _found(spark, [text], [(1, item)]) == [brute(text, [(1, item)])], text


def test_words_of_equal_hashes_are_told_apart(spark):
    """Polynomial hashes modulo 2**64 give the Thue-Morse word of 1,024 letters and
    its complement one value, whatever the base."""
    morse = "".join("ab"[k.bit_count() % 2] for k in range(1024))
    other = morse.translate(str.maketrans("ab", "ba"))
    hasher = D.SpanHash()
    *_, hashes = D._words(*D.text_bytes(D.pa.array([f"{morse} {other}"])), hasher)
    assert hashes[0] == hashes[1]
    texts = [morse, other, f"{other} {morse} {other}", f"{morse} c"]
    for items in ([(1, morse)], [(1, other)], [(1, morse), (2, other)], [(1, f"{morse} {other}"), (2, f"{other} c")]):
        assert _found(spark, texts, items) == [brute(t, items) for t in texts]


def test_blocks_of_a_pass_are_written_before_the_next(spark, monkeypatch):
    docs, items = _case()
    items = [*items, (None, docs[0][1] + " a B a B")]
    monkeypatch.setattr(D, "BLOCK_BYTES", 40)
    monkeypatch.setattr(D, "BLOCKS_PER_PASS", 5)
    assert _found(spark, [t for _, t in docs], items) == [brute(t, items) for _, t in docs]


def test_cut_spans_leaves_the_rest(spark):
    passage = "one two three four five six seven eight nine ten eleven"
    text = f"Vorher ñ, {passage.title()}! Nachher."
    d = spark.createDataFrame([(1, text), (2, "clean"), (3, None)], "doc_id bigint, text string")
    b = spark.createDataFrame([(7, passage)], "item_id bigint, text string")
    got = {r["doc_id"]: r["text"] for r in D.cut_spans(D.find_passages(d, b)).collect()}
    assert got == {1: "Vorher ñ, ! Nachher.", 2: "clean", 3: None}


def test_odd_rows(spark, odd, empty):
    b = spark.createDataFrame([(7, "same text here"), (8, "word " * 12)], "item_id bigint, text string")
    got = D.find_passages(odd, b)
    assert got.columns == ["doc_id", "text", "source", "score", "n_words", "spans", "items"]
    rows = {(r["doc_id"], r["text"]): r for r in got.collect()}
    assert rows[(3, "word " * 30000)]["spans"][0]["last_word"] == 29999
    assert rows[(4, "Same text here, twice over.")]["items"] == ["7"] and rows[(None, None)]["n_words"] == 0
    assert got.count() == odd.count()
    assert D.find_passages(empty, b).count() == 0
    none = D.find_passages(odd, b.limit(0))
    assert none.where(F.size("spans") > 0).count() == 0 and none.count() == odd.count()
