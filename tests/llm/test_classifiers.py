"""Held-out accuracy of the two fitted classifiers, the chain against
enumeration, and what they do without labels."""
import itertools
import random

import numpy as np
import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from mirrorline.llm import quality_model, sample, toxicity
from mirrorline.llm.common import table

SF = "/root/testdata/sf0.1"


def test_marginals_match_enumeration():
    rng = np.random.default_rng(2)
    lengths = np.array([1, 4, 2, 6])
    emission, move = rng.normal(0, 2, lengths.sum()), np.exp(rng.normal(0, 1, (2, 2)))
    first = np.cumsum(lengths) - lengths
    left, right = toxicity.marginals(emission, first, lengths, move)
    got = left * right / (1 + left * right)
    for a, n in zip(first, lengths):
        total, one = 0.0, np.zeros(n)
        for tags in itertools.product((0, 1), repeat=n):
            weight = np.prod([np.exp(emission[a + i]) if t else 1.0 for i, t in enumerate(tags)])
            weight *= np.prod([move[x, y] for x, y in zip(tags, tags[1:])])
            total += weight
            one += weight * np.array(tags)
        assert np.allclose(got[a: a + n], one / total)


def test_toxicity_on_held_out_rows(spark):
    got = toxicity.op3_toxicity(spark, SF).join(table(spark, SF, "labels"), "doc_id").where("held_out").collect()
    # Most texts labelled both junk and toxic were overwritten by junk that holds no toxic word;
    # over all rows labelled toxic 91 of 97 are found, so those are counted apart.
    assert sum(r["predicted"] for r in got if r["toxic"] == 1) >= 0.93 * sum(r["toxic"] for r in got)
    toxic = [r for r in got if r["toxic"] == 1 and r["quality"] == 1]
    clean = [r for r in got if r["toxic"] == 0]
    assert len(toxic) > 30 and sum(r["predicted"] for r in toxic) >= 0.98 * len(toxic)
    assert sum(r["predicted"] for r in clean) <= 0.01 * len(clean)
    assert sum(bool(r["toxic_spans"]) for r in toxic) >= 0.9 * len(toxic)


def test_quality_on_held_out_rows(spark):
    got = quality_model.op2_quality_classifier(spark, SF).join(table(spark, SF, "labels"), "doc_id").where("held_out").collect()
    assert sum(r["predicted"] == r["quality"] for r in got) >= 0.98 * len(got)
    assert all(0 <= r["score"] <= 1 for r in got)


def test_word_table_is_the_same_however_the_rows_are_dealt(spark):
    docs = table(spark, "/root/testdata/sf0.001", "documents")
    a = quality_model.word_table(docs.coalesce(1))
    b = quality_model.word_table(docs.repartition(7))
    assert np.allclose(a.vectors, b.vectors, atol=1e-5)


def test_words_of_documents_stay_in_their_document():
    import pyarrow as pa
    from mirrorline.llm.common import SpanHash, text_bytes
    words = lambda t: quality_model.words_of(*text_bytes(pa.array(t)), SpanHash())
    row, _, h = words(["ab cd!!", None, "cd", "CD Cd"])
    assert row.tolist() == [0, 0, 0, 2, 3, 3] and h[1] == h[3] and len(set(h.tolist())) == 5


def test_sample_keeps_its_bounds_and_follows_the_ids(spark):
    docs, labels = table(spark, SF, "documents"), table(spark, SF, "labels")
    texts, y = sample.labelled_sample(docs, labels, "quality", F.lit(True), rows_per_class=100, max_bytes=1 << 30)
    assert 60 < sum(y) < 150 and 60 < len(y) - sum(y) < 150
    again = sample.labelled_sample(docs.repartition(5), labels, "quality", F.lit(True), rows_per_class=100, max_bytes=1 << 30)
    assert (texts, y) == again
    small, _ = sample.labelled_sample(docs, labels, "quality", F.lit(True), rows_per_class=100, max_bytes=100_000)
    assert 0 < sum(len(t.encode()) for t in small) < 300_000


@pytest.mark.parametrize("run", ["toxicity", "quality"])
def test_without_labels_and_odd_rows(spark, odd, empty, run):
    labels = spark.createDataFrame([(None, None, None), (1, None, None)], "doc_id bigint, quality int, toxic int")
    if run == "toxicity":
        model = toxicity.fit(odd, labels, F.lit(True))
        out, none = toxicity.tag(odd, model), toxicity.tag(empty, model)
        extra = ["score", "toxic_spans"]
    else:
        model = quality_model.fit(odd, labels, F.lit(True))
        out, none = quality_model.score(odd, model), quality_model.score(empty, model)
        extra = ["score"]
        quality_model.fit(empty, labels, F.lit(True))
    assert out.columns == ["doc_id", "text", "source", "n_words", *extra]
    assert {r["score"] for r in out.collect()} == {0.0} and out.count() == odd.count() and none.count() == 0


def test_fitted_toxicity_on_odd_rows(odd):
    rnd = random.Random(9)
    words = ["quiet", "text", "house", "river", "green", "stone", "paper", "light"]
    toxic = [" ".join([*rnd.choices(words, k=4), "moron", *rnd.choices(words, k=4)]) for _ in range(60)]
    clean = [" ".join(rnd.choices(words, k=9)) for _ in range(60)]
    model = toxicity.Model(toxic + clean, [1] * 60 + [0] * 60)
    rows = toxicity.tag(odd, model).collect()
    assert all(0 <= r["score"] < 0.5 and not r["toxic_spans"] for r in rows)
    spoken = odd.limit(1).withColumn("text", F.lit("é A Moron, said the river."))
    assert [(r["score"] >= 0.5, r["toxic_spans"]) for r in toxicity.tag(spoken, model).collect()] == [(True, [Row(start=4, end=9)])]


def test_toxicity_without_a_lifting_word_falls_back_to_the_share():
    model = toxicity.Model(["a b c"] * 30 + ["a b c"] * 10, [0] * 30 + [1] * 10)
    assert not model.fitted and model.prior == 0.25


def test_calibration_does_not_move_with_the_share_sampled():
    rnd = np.random.default_rng(4)
    y = np.array([0] * 4000 + [1] * 400)
    x = np.concatenate((rnd.normal(-2, 2, 4000), rnd.normal(2, 2, 400)))[:, None]
    part = np.arange(len(y)) % 10 == 0
    part |= y == 1  # as a sample that holds all of one class and a tenth of the other
    model = toxicity.Model([], [])
    model._calibrate(x, y, np.ones(len(y)))
    full = model.calibration
    model._calibrate(x[part], y[part], np.where(y[part] == 0, 10.0, 1.0))
    assert np.abs(model.calibration - full).max() < 0.5
    model._calibrate(x[part], y[part], np.ones(part.sum()))
    assert abs(model.calibration[1] - full[1]) > 1.5  # what the weights are for
    assert toxicity.Model(["a", "b"], [0, 1], [9.0, 1.0]).prior == pytest.approx(0.1)


def test_sample_weights_stand_for_the_classes(spark):
    docs = spark.range(1200).selectExpr("id doc_id", "repeat('word ', 20) text")
    labels = docs.selectExpr("doc_id", "int(doc_id % 12 = 0) toxic")
    for bounds, whole in (((4000, 1 << 20), True), ((100, 1 << 20), False), ((4000, 12000), False)):
        _, y, w = sample.weighted_sample(docs, labels, "toxic", F.lit(True), *bounds)
        assert (len(y) == 1200 and set(w) == {1.0}) == whole
        of = [sum(v for v, c in zip(w, y, strict=True) if c == k) for k in (0, 1)]
        assert 0.7 * 1100 < of[0] < 1.3 * 1100 and 0.7 * 100 < of[1] < 1.3 * 100


def test_unfitted_toxicity_drops_nothing(spark, tmp_path):
    import corpus_pipeline
    docs = spark.range(30).selectExpr("id doc_id", "concat('text ', id) text")
    docs.selectExpr("doc_id", "1 toxic").write.parquet(str(tmp_path / "labels.parquet"))
    assert corpus_pipeline.drop_toxic(spark, docs, str(tmp_path)).count() == 30
