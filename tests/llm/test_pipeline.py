"""The pipeline over sf0.001 against a plain version of every stage."""
import re

import pytest
import sentencepiece
from pyspark.sql import functions as F

import corpus_pipeline as P
from mirrorline.llm import pieces, secrets, toxicity
from mirrorline.llm.common import table, text_bytes, SpanHash
from mirrorline.llm.sample import remainder

from .test_simhash import fingerprint, groups

SF = "/root/testdata/sf0.001"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def cut_plain(text, items):
    """Text without the words of any 10-word window of an item (and what lies between them)."""
    words = [(m.start(), m.end(), m[0]) for m in re.finditer(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))]
    own = [w for _, _, w in words]
    hit = set()
    for win in items:
        n = len(win)
        for a in range(len(own) - n + 1):
            if own[a] == win[0] and own[a: a + n] == win:
                hit |= set(range(a, a + n))
    out, last = "", 0
    for k in sorted(hit):
        if k - 1 not in hit:
            out += text[last: words[k][0]]
        last = words[k][1]
    return out + text[last:]


def redact_plain(text):
    runs = []
    for a, _, b in secrets.find_in_text(text)[1]:
        if runs and runs[-1][1] >= a:
            runs[-1][1] = max(b, runs[-1][1])
        else:
            runs.append([a, b])
    out, last = "", 0
    for a, b in runs:
        out, last = out + text[last:a] + "[secret]", b
    return out + text[last:]


def test_every_stage(spark, tmp_path):
    import pyarrow as pa
    docs = table(spark, SF, "documents")
    before = {r["doc_id"]: r for r in docs.collect()}
    frames = []
    for k, (_, stage) in enumerate(P.STAGES):
        stage(spark, docs, SF).write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
        frames.append({r["doc_id"]: r for r in docs.collect()})
        if k < len(P.STAGES) - 1:
            assert docs.columns == COLUMNS
    model = toxicity.fit(table(spark, SF, "documents"), table(spark, SF, "labels"), remainder(F.col("doc_id"), 5) != 0)
    plain = {i for i, r in before.items() if model.score(*text_bytes(pa.array([r["text"]])), SpanHash())[0][0] < 0.5}
    assert set(frames[0]) == plain

    ids = sorted(frames[0])
    root = groups([fingerprint(frames[0][i]["text"]) for i in ids])
    assert set(frames[1]) == {ids[g] for g in root} and all(frames[1][i] == before[i] for i in frames[1])

    windows = set()
    for r in table(spark, SF, "benchmark").collect():
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), r["text"]))
        windows |= {tuple(w[p: p + 10]) for p in range(max(1, len(w) - 9))}
    windows = [list(w) for w in windows if w]
    assert set(frames[2]) == set(frames[1])
    for i, r in frames[2].items():
        assert r["text"] == cut_plain(before[i]["text"], windows)
        assert r["n_chars"] == (len(r["text"]) if r["text"] != before[i]["text"] else before[i]["n_chars"])
    for i, r in frames[3].items():
        assert r["text"] == redact_plain(frames[2][i]["text"])
    library = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)
    assert set(frames[4]) == set(frames[1])
    for i, r in frames[4].items():
        assert r["ids"] == library.encode(frames[3][i]["text"]) and r["round_trip"]
    run = {r["doc_id"]: r["ids"] for r in P.run(spark, SF).collect()}
    assert run == {i: r["ids"] for i, r in frames[4].items()}


@pytest.mark.parametrize("k", range(len(P.STAGES)))
def test_stages_take_odd_and_empty_tables(spark, odd, empty, k):
    docs = odd.withColumn("n_chars", F.length("text").cast("bigint"))
    out = P.STAGES[k][1](spark, docs, SF)
    kept = out.count()
    assert kept == docs.count() if k != 1 else kept == 5
    assert out.columns == docs.columns or k == len(P.STAGES) - 1
    assert P.STAGES[k][1](spark, empty, SF).count() == 0
