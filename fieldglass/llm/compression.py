"""Quality by compression: how much better a text compresses with a dictionary of good texts than with one of bad texts.

Dictionaries and calibration come from a bounded sample of labelled rows; scoring reads every whole text once, in Arrow
batches. The score is a logistic calibration of the normalised difference of the two compressed sizes, together with the
compression rate itself, which tells repetitive texts apart whatever their words.

Defined cases: null and empty texts get the calibrated score of their (zero) features; a null id is scored and counts as
not held out; repeated rows and ties give equal scores; with labels of one class only, every score is that class's
smoothed share; extra columns are left alone. labels, lang, source and doc_id are never inputs of a score.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fieldglass.llm.common import bounded_batches, fold_remainder, id_and_text

LEVEL = 3
SCORED = pa.schema([("doc_id", pa.int64()), ("score", pa.float64())])
SIZED = pa.schema([("doc_id", pa.int64()), ("plain", pa.int64()), ("good", pa.int64()), ("bad", pa.int64())])


@dataclass
class Model:
    good: bytes
    bad: bytes
    weights: tuple[float, ...]


def features(plain: np.ndarray, good: np.ndarray, bad: np.ndarray) -> np.ndarray:
    """Constant, normalised difference (good texts above 0), compression rate and its square, and log length."""
    size = np.maximum(plain, 1).astype(float)
    rate = np.minimum(np.minimum(good, bad) / size, 1.5)
    return np.stack([np.ones(len(size)), 10 * (bad - good) / np.maximum(good + bad, 1), 5 * (bad - good) / size, rate, rate**2, np.log(size) / 10], 1)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def sizes_by(good: bytes, bad: bytes):
    """A function from texts to their compressed sizes under both dictionaries."""
    import zstandard

    packers = []
    for raw in (good, bad):
        d = zstandard.ZstdCompressionDict(raw, dict_type=zstandard.DICT_TYPE_RAWCONTENT if raw[:4] != b"\x37\xa4\x30\xec" else zstandard.DICT_TYPE_AUTO)
        if raw:
            d.precompute_compress(level=LEVEL)
        packers.append(zstandard.ZstdCompressor(level=LEVEL, dict_data=d if raw else None, write_content_size=False, write_checksum=False, write_dict_id=False))

    def sizes(texts: list[bytes]) -> tuple[np.ndarray, ...]:
        return (np.fromiter(map(len, texts), np.int64, len(texts)), *(np.fromiter((len(c.compress(t)) for t in texts), np.int64, len(texts)) for c in packers))

    return sizes


def dictionary(texts: list[bytes], size: int) -> bytes:
    """A trained dictionary, or the texts themselves where there are too few to train one."""
    import zstandard

    texts = [t for t in texts if t]
    try:
        return zstandard.train_dictionary(min(size, max(1024, sum(map(len, texts)) // 4)), texts, level=LEVEL).as_bytes()
    except zstandard.ZstdError:
        return b"".join(texts)[-size:]


def calibrate(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2, rounds: int = 50) -> np.ndarray:
    """Logistic weights by Newton's method; a step is halved until the penalised loss falls, so it can't overshoot."""

    def loss(w: np.ndarray) -> float:
        p = np.clip(sigmoid(x @ w), 1e-12, 1 - 1e-12)
        return float(-(y * np.log(p) + (1 - y) * np.log(1 - p)).sum() + ridge * (w @ w) / 2)

    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = sigmoid(x @ w)
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w)), x.T @ (y - p) - ridge * w)
        now, size = loss(w), 1.0
        while loss(w + size * step) > now + 1e-9 and size > 1e-6:
            size /= 2
        step = size * step
        w = w + step
        if np.abs(step).max() < 1e-8:
            break
    return w


def learn(docs: DataFrame, labels: DataFrame, per_class: int = 1500, max_bytes: int = 65536, dictionary_bytes: int = 110 << 10, total_bytes: int = 64 << 20) -> Model:
    """Dictionaries from one half of the sample, calibration on the other.

    per_class bounds the labelled rows of each class for either half: those with the smallest hash of their id. Only texts
    of max_bytes or less are sampled, and of these, in the order of the hash, as many as total_bytes hold: that much comes to
    the driver at most. Rows with crc32(doc_id) mod 5 = 0 are held out.
    """
    train = labels.where((fold_remainder(F.col("doc_id")) != 0) & F.col("quality").isin(0, 1)).groupBy("doc_id").agg(F.min("quality").alias("quality"))
    half = F.pmod(F.xxhash64("doc_id", F.lit(21)), F.lit(2))
    order = (F.xxhash64("doc_id", F.lit(22)), F.col("doc_id"))
    parts = [train.where((F.col("quality") == q) & (half == h)).orderBy(*order).limit(per_class).withColumn("half", F.lit(h)) for q in (0, 1) for h in (0, 1)]
    picked = parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])
    # A bounded sample: at most 4 * per_class rows of max_bytes, total_bytes in all. Sizes are summed up before texts are read.
    sampled = id_and_text(docs).join(F.broadcast(picked), "doc_id").where(F.length("text") <= max_bytes)
    sizes = sampled.groupBy("doc_id").agg(F.max(F.length("text")).alias("size"))
    before = F.sum("size").over(Window.orderBy(*order))  # over the sample's rows alone
    fits = sizes.withColumn("upto", before).where(F.col("upto") <= total_bytes).select("doc_id")
    rows = sampled.join(F.broadcast(fits), "doc_id").groupBy("doc_id").agg(F.min(F.struct("text", "quality", "half")).alias("x")).select("doc_id", "x.*").collect()
    rows.sort(key=lambda r: (r["doc_id"], bytes(r["text"])))
    of = lambda q, h: [bytes(r["text"]) for r in rows if (r["quality"], r["half"]) == (q, h)]
    good, bad = (dictionary(of(q, 0), dictionary_bytes) for q in (1, 0))
    held = [r for r in rows if r["half"] == 1] or rows
    y = np.array([r["quality"] for r in held], float)
    x = features(*sizes_by(good, bad)([bytes(r["text"]) for r in held])) if held else np.zeros((0, 6))
    if len(set(y)) < 2:
        share = (y.sum() + 1) / (len(y) + 2)
        return Model(good, bad, (float(np.log(share / (1 - share))), *[0.0] * 5))
    return Model(good, bad, tuple(calibrate(x, y)))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id and score, one row for each row of docs."""
    bounded_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sizes, weights = sizes_by(model.good, model.bad), np.array(model.weights)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sigmoid(features(*sizes(texts)) @ weights))], schema=SCORED)

    return id_and_text(docs).mapInArrow(run, "doc_id long, score double")


def op9(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    scored = score(docs, learn(docs, labels))
    return scored.select("doc_id", (F.coalesce(fold_remainder(F.col("doc_id")), F.lit(1)) == 0).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
