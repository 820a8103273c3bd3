import zlib

import numpy as np
from pyspark.sql import functions as F

from fieldglass.llm import compression

SF = "/root/testdata/sf0.01"


def test_held_out_accuracy(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    out = compression.op9(docs, labels).toPandas()
    assert len(out) == docs.count() and out.score.between(0, 1).all()
    assert (out.held_out == [zlib.crc32(str(i).encode()) % 5 == 0 for i in out.doc_id]).all()
    assert (out.predicted == (out.score >= 0.3)).all()
    held = out[out.held_out].merge(labels.toPandas(), on="doc_id")
    good, bad = held[held.quality == 1], held[held.quality == 0]
    assert good.predicted.mean() > 0.97 and bad.predicted.mean() < 0.35
    auc = np.mean([[g > b for b in bad.score] for g in good.score])
    assert auc > 0.95


def test_labels_of_held_out_rows_do_not_matter(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet").limit(400), spark.read.parquet(f"{SF}/labels.parquet")
    turned = labels.withColumn("quality", F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, 1 - F.col("quality")).otherwise(F.col("quality")))
    assert compression.learn(docs, labels) == compression.learn(docs, turned)


def test_edge_cases(spark):
    docs = spark.createDataFrame([(1, None, "a"), (2, "", "b"), (None, "x", "c"), (3, "y " * 500000, "d"), (3, "y " * 500000, "d")], "doc_id long, text string, score string")
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    rows = compression.op9(docs, none).collect()
    assert len(rows) == 5 and {r.score for r in rows} == {0.5}
    one = spark.createDataFrame([(2, 1, 0), (3, 1, 0)], "doc_id long, quality int, toxic int")
    assert all(0.5 < r.score < 1 for r in compression.op9(docs, one).collect())
    assert compression.op9(docs.limit(0), none).count() == 0


def test_scores_equal_a_plain_computation(spark):
    """Each text compressed by itself under both dictionaries, its features and score by hand."""
    import zstandard

    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    model = compression.learn(docs, labels)
    rows = [(r.doc_id, (r.text or "").encode()) for r in docs.collect()] + [(-1, b""), (-2, b"x"), (-3, "é \U0001f600".encode() * 9000)]
    sizes = lambda raw: zstandard.ZstdCompressor(level=compression.LEVEL, dict_data=zstandard.ZstdCompressionDict(raw), write_content_size=False, write_checksum=False, write_dict_id=False)
    good, bad = sizes(model.good), sizes(model.bad)
    want = {}
    for i, t in rows:
        n, g, b = max(len(t), 1), len(good.compress(t)), len(bad.compress(t))
        rate = min(min(g, b) / n, 1.5)
        x = (1.0, 10 * (b - g) / max(g + b, 1), 5 * (b - g) / n, rate, rate**2, np.log(n) / 10)
        want[i] = 1 / (1 + np.exp(-np.clip(np.dot(x, model.weights), -30, 30)))
    got = compression.score(spark.createDataFrame([(i, t.decode()) for i, t in rows], "doc_id long, text string").repartition(3), model).collect()
    assert len(got) == len(rows) and all(abs(r.score - want[r.doc_id]) < 1e-9 for r in got)


def test_calibration_finds_the_least_loss():
    """No small change of the weights lowers the loss, on data that the plain step overshoots on too."""
    rng = np.random.default_rng(2)
    x = np.concatenate([np.ones((200, 1)), rng.normal(size=(200, 2)) * [1, 60]], 1)
    y = (x[:, 2] + rng.normal(size=200) > 0).astype(float)
    loss = lambda w: -np.log(np.where(y == 1, compression.sigmoid(x @ w), 1 - compression.sigmoid(x @ w)) + 1e-12).sum() + 0.005 * (w @ w)
    w = compression.calibrate(x, y)
    assert all(loss(w + d) >= loss(w) - 1e-6 for d in rng.normal(size=(200, 3)) * [0.05, 0.05, 0.001])


def test_the_sample_is_bounded_in_bytes(spark):
    docs = spark.createDataFrame([(i, f"word{i} " * 500) for i in range(80)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(80)], "doc_id long, quality int, toxic int")
    small = compression.learn(docs, labels, total_bytes=40_000)
    assert len(small.good) + len(small.bad) <= 40_000
    assert compression.learn(docs, labels, total_bytes=0) == compression.Model(b"", b"", (0.0, 0.0, 0.0, 0.0, 0.0, 0.0))
