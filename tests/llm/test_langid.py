import math
import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from fieldglass.llm import langid
from fieldglass.llm.common import slices
from fieldglass.llm.queries import QUERIES

SF = "/root/testdata/sf0.01"
DDL = "doc_id long, text string, lang string, source string, score double, feature int"


def fold(i):
    return zlib.crc32(str(i).encode()) % 3


@pytest.fixture(scope="module")
def predicted(spark):
    docs = {r.doc_id: r for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    return docs, QUERIES["op13_language_id"](spark, SF).collect()


def test_held_out_accuracy(predicted):
    docs, rows = predicted
    assert len(rows) == len(docs) and all(r.held_out == (fold(r.doc_id) == 1) and 0 <= r.score <= 1 for r in rows)
    held = [(r.lang_pred == docs[r.doc_id].lang, r.score) for r in rows if r.held_out and r.lang_pred != "und" and docs[r.doc_id].lang]
    right = sum(x for x, _ in held) / len(held)
    assert len(held) > 200 and right > 0.97
    # Calibrated: what scores promise is about what is right.
    assert abs(sum(s for _, s in held) / len(held) - right) < 0.05


def test_no_letter_no_language(predicted):
    docs, rows = predicted
    for r in rows:
        text = docs[r.doc_id].text
        assert (r.lang_pred == "und") == (text is None or not any(c.isalpha() for c in text))


def toy(n, seed=0):
    rng = random.Random(seed)
    words = {"aa": ["tion", "the", "ing"], "bb": ["schön", "über", "ein"]}
    return [(i, " ".join(rng.choice(words[("aa", "bb")[i % 2]]) for _ in range(rng.randint(2, 30))), ("aa", "bb")[i % 2]) for i in range(n)]


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", 0.5, 1) for r in rows], DDL)


def test_frequencies_equal_a_plain_count(spark):
    texts = [t for _, t, _ in toy(40)] + ["a", "é é", "x" * 700]
    counts, n = langid.document_frequencies(spark.createDataFrame([(t,) for t in texts], "text string").repartition(3))
    want = Counter(f for t in texts for f in langid.features_of(t)[0].tolist())
    assert n == len(texts) and {i: int(c) for i, c in enumerate(counts) if c} == dict(want)


def test_scores_equal_a_sum_over_features(monkeypatch):
    """Texts of any length, in blocks of any size, score as the sum of their features' shares by weight."""
    rng = np.random.default_rng(1)
    model = langid.Model(["a", "b", "c"], rng.normal(size=(langid.SIZE, 3)).astype(np.float32), rng.normal(size=3), 1.7)
    texts = ["", "a", "Ab", "ünïcode 12", "tion the ing" * 50, "x", "\U0001f600 é" * 9, "end"]
    want = np.stack([(langid.features_of(t)[1].astype(float) @ model.weights[langid.features_of(t)[0]].astype(float) + model.bias) / 1.7 for t in texts])
    for block in (1, 2, 3, 7, 64, 1 << 18):
        monkeypatch.setattr(langid, "BLOCK", block)
        assert np.allclose(langid.scores(texts, model), langid.softmax(want), atol=1e-5)


def test_weights_are_sparse_and_follow_the_leader():
    """One feature, one step: the closed form of the update."""
    w = langid.ftrl([(np.array([5, langid.SIZE]), np.array([2.0, 1.0]))], np.array([0]), 2, alpha=0.5, beta=1.0, l1=0.25, l2=0.1, epochs=1)
    g = 2.0 * np.array([-0.5, 0.5])
    assert np.allclose(w[5], -(g - np.sign(g) * 0.25) / ((1 + np.abs(g)) / 0.5 + 0.1))
    assert np.count_nonzero(w) == 4
    assert not langid.ftrl([(np.array([5]), np.array([2.0]))], np.array([0]), 2, l1=9.0, epochs=1).any()


def test_temperature_cools_what_is_too_sure():
    y = np.array([0] * 80 + [1] * 20)
    logits = np.tile([8.0, 0.0], (100, 1))
    p = langid.softmax(logits / langid.fit_temperature(logits, y))[0, 0]
    assert math.isclose(p, 0.8, abs_tol=0.01)


def test_labels_are_no_inputs_and_held_out_rows_are_not_learned(spark):
    rows = toy(90)
    base = sorted((r.doc_id, r.lang_pred, r.score) for r in langid.op13(frame(spark, rows)).collect())
    changed = [(i, t, ("zz" if fold(i) == 1 else x)) for i, t, x in rows]
    assert base == sorted((r.doc_id, r.lang_pred, r.score) for r in langid.op13(frame(spark, changed).repartition(5)).collect())
    assert all(p == x for (_, p, _), (_, _, x) in zip(base, sorted(rows), strict=True))


def test_defined_cases(spark):
    rows = toy(60) + [(100, None, "aa"), (101, "", "aa"), (102, "12 + 3!", "bb"), (None, "the tion", "aa"), (None, None, None), (103, "the tion", None), (104, "über " * 60_000, "bb"), (1, *toy(60)[1][1:]), (1, *toy(60)[1][1:])]
    got = langid.op13(frame(spark, rows)).collect()
    assert len(got) == len(rows)
    of = {r.doc_id: r for r in got if r.doc_id is not None}
    assert all(of[i].lang_pred == "und" and of[i].score == 0 for i in (100, 101, 102))
    assert of[103].lang_pred == "aa" and of[104].lang_pred == "bb"
    assert sorted((r.lang_pred, r.held_out) for r in got if r.doc_id is None) == [("aa", False), ("und", False)]
    assert len({(r.lang_pred, r.score) for r in got if r.doc_id == 1}) == 1
    assert langid.op13(frame(spark, rows).limit(0)).collect() == []
    unlabelled = langid.op13(frame(spark, [(i, t, None) for i, t, _ in rows])).collect()
    assert {(r.lang_pred, r.score) for r in unlabelled} == {("und", 0.0)}
    single = langid.op13(frame(spark, [(i, t, "aa") for i, t, _ in toy(30)])).collect()
    assert {(r.lang_pred, r.score) for r in single} == {("aa", 1.0)}


def test_sample_is_bounded_and_even(spark):
    rows = [(i, f"text {i % 700}", "aa") for i in range(3000)] + [(i, f"other {i}", "bb") for i in range(40)]
    got = Counter(r.lang for r in langid.sample(frame(spark, rows), 100, 1).collect())
    assert got == {"aa": 50, "bb": 40}


def test_slices_keep_every_row():
    batch = pa.RecordBatch.from_arrays([pa.array([None, "a" * 50, "", "b" * 7, "c"])], names=["t"])
    for rows, size in ((1, 1), (2, 8), (9, 60), (1000, 1 << 20)):
        parts = list(slices([batch, batch.slice(0, 0)], 0, rows, size))
        assert pa.Table.from_batches(parts).column(0).to_pylist() == batch.column(0).to_pylist() and all(p.num_rows <= rows for p in parts)
