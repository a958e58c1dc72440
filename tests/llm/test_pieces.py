"""Ids against the tokenizer's own library, and round trips."""
import random

import pytest
import sentencepiece

from mirrorline.llm import pieces


@pytest.fixture(scope="module")
def model():
    return sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)


@pytest.fixture(scope="module")
def encoder():
    return pieces.Encoder(pieces.Vocabulary())


TEXTS = ["", " ", "  ", "a", "   a  b   ", "▁▁ x", " " * 40 + "foo" + " " * 17, "日本語テキスト 𝔘𝔫𝔦 ẞ\0 \t\n\nab", "x" * 300,
         "aaaaaaa bbbb  hello world, the quick!! https://x.y/z?q=1", "é" * 20 + "👍🏽" * 3, "a" * 5000, "def f(x):\n        return  x**2  # ok\n\t\t\t\t\n"]


def test_same_ids_as_the_library(model, encoder):
    rnd = random.Random(11)
    names = [model.id_to_piece(i).replace("▁", " ") for i in range(259, model.get_piece_size())]
    texts = TEXTS + ["".join(rnd.choices(names, k=rnd.randint(1, 80))) for _ in range(400)]
    texts += ["".join(rnd.choices("abcdeinrst ▁ é🎉", k=rnd.randint(1, 300))) for _ in range(300)]
    ids, offsets = encoder.encode(texts)
    for k, text in enumerate(texts):
        assert ids[offsets[k]: offsets[k + 1]].tolist() == model.encode(text), text[:60]
    decoded = pieces.decode(encoder.v, ids, offsets)
    assert decoded == [t.replace("▁", " ") for t in texts]


def test_long_texts_without_spaces(model, encoder):
    """The same ids as the library, in time that grows with the text."""
    import time
    rnd = random.Random(5)
    names = [model.id_to_piece(i).replace("▁", "") for i in range(259, model.get_piece_size())]
    texts = ["".join(rnd.choices("abcdeinrst", k=200_000)), "".join(rnd.choices(names, k=30_000)), "a" * 100_001,
             "".join(chr(rnd.randrange(0x4E00, 0x9FA0)) for _ in range(100_000)), "x" * (pieces.LONG - 1), "x" * pieces.LONG, "x" * (pieces.LONG + 1), "é🎉" * 3000]
    for text in [*texts, " ".join(texts[:2])]:
        began = time.perf_counter()
        ids, _ = encoder.encode([text, "short one", ""])
        took = time.perf_counter() - began
        assert ids.tolist() == model.encode(text) + model.encode("short one"), text[:40]
        assert took < 2 + len(text) / 100_000, (took, text[:40])


def test_pairs_by_merging(encoder):
    """The pair rule against merging the characters."""
    v = encoder.v
    import numpy as np
    rnd = np.random.default_rng(3)
    model = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)
    rank = {model.id_to_piece(int(i)): -model.get_score(int(i)) for i in v.ids}
    a, b = rnd.choice(v.ids[:3000], 1500), rnd.choice(v.ids[:3000], 1500)
    ok = v.neighbours(a, b)
    for x, y, o in zip(a, b, ok):
        x, y = model.id_to_piece(int(x)), model.id_to_piece(int(y))
        assert (pieces._bpe(x + y, rank)[0] == [x, y]) == o, (x, y)


def test_documents_and_odd_rows(spark, odd, empty, model):
    out = pieces.encode_documents(odd.withColumn("ids", odd["doc_id"]))
    rows = out.collect()
    assert len(rows) == odd.count() and all(r["round_trip"] and r["n_pieces"] == len(r["ids"]) for r in rows)
    assert all(r["ids"] == model.encode(r["text"] or "") for r in rows)
    back = {(r["doc_id"], r["text"]) for r in pieces.decode_documents(out).collect()}
    assert back == {(r["doc_id"], r["text"] or "") for r in rows}
    assert pieces.encode_documents(empty).count() == 0
