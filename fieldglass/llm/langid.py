"""Language identification: sparse multinomial logistic regression on TF-IDF of character n-grams.

Grams of one to three characters of the lower-case text, letters and what stands between them, are hashed to 2 ** 16
features. A feature's value is its share of the text's grams times the logarithm of how rare it is among documents, which is
counted over all documents that may be learned from. Follow-the-regularised-leader with L1 and L2 penalties learns from a
bounded sample, so most weights are exactly 0; another part of the sample sets the temperature that makes scores
probabilities. Prediction reads every whole text once, in stretches of bounded size.

Learned from: rows with a text, a non-null lang and crc32(doc_id as text) mod 3 other than 1. lang, source and doc_id are never
inputs of a prediction.

Defined cases: a text that is null or has no letter is `und` with score 0, and so is every text where no language can be
learned; a null doc_id is neither held out nor learned from; equal texts of one language are one example; of equally likely
languages that with the least name is predicted; with one language all scores are 1; repeated rows give equal rows; an empty
table gives no rows; extra columns are left alone.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldglass.llm.common import fold_remainder, slices

BITS = 16
SIZE = 1 << BITS
ORDERS = 3
#: Values are shares of a text's grams, so small; this brings them near 1.
SCALE = 100.0
#: Positions that one step of scoring holds, whatever a text's length.
BLOCK = 1 << 18
UNKNOWN = "und"
_SCORED = pa.schema([("doc_id", pa.int64()), ("lang_pred", pa.string()), ("score", pa.float64())])

#: Code points below 128 that aren't letters are one: a space.
_FOLD = np.array([c if chr(c).isalpha() else 32 for c in range(128)], np.uint32)


def characters(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The folded code points of all texts, each between two spaces, and where each begins and the last ends."""
    lower = [f" {t.lower()} " for t in texts]
    ends = np.concatenate([[0], np.cumsum([len(t) for t in lower])]).astype(np.int64)
    code = np.frombuffer("".join(lower).encode("utf-32-le", "replace"), np.uint32)
    return np.where(code < 128, _FOLD[np.minimum(code, 127)], code), ends


def gram_features(code: np.ndarray) -> Iterator[np.ndarray]:
    """For each order, the feature of the gram that begins at each place (order - 1 fewer than code has)."""
    h = code * np.uint32(0x9E3779B1) + np.uint32(0x7F4A7C15)
    for order in range(1, ORDERS + 1):
        if order > 1:
            h = (h[:-1] ^ (h[:-1] >> np.uint32(15))) * np.uint32(0x85EBCA77) + code[order - 1 :] * np.uint32(0xC2B2AE3D)
        x = (h ^ (h >> np.uint32(13))) * np.uint32(0x27D4EB2F)
        yield x >> np.uint32(32 - BITS)


def gram_total(length: np.ndarray) -> np.ndarray:
    """How many grams texts of so many characters have."""
    return sum(np.maximum(length - k, 0) for k in range(ORDERS))


def features_of(text: str) -> tuple[np.ndarray, np.ndarray]:
    """The features of a text and their shares of its grams."""
    code, ends = characters([text])
    found, counts = np.unique(np.concatenate(list(gram_features(code))), return_counts=True)
    return found.astype(np.int32), (counts / gram_total(ends[1:])[0]).astype(np.float32)


@dataclass
class Model:
    languages: list[str]
    #: A row for each feature and a column for each language; a feature's rarity is a factor of its weights.
    weights: np.ndarray
    bias: np.ndarray
    temperature: float


def document_frequencies(docs: DataFrame) -> tuple[np.ndarray, int]:
    """Of how many documents (with `text`) each feature is one, and how many documents there are. Counts meet by feature, SIZE rows at most reach the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, seen, n = np.zeros(SIZE, np.int64), np.zeros(SIZE, bool), 0
        for batch in slices(batches, 0):
            code, ends = characters(batch.column(0).to_pylist())
            orders = list(gram_features(code))
            for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True):
                for k, feature in enumerate(orders):
                    seen[feature[a : max(a, b - k)]] = True
                found = np.flatnonzero(seen)
                total[found] += 1
                seen[found] = False
            n += batch.num_rows
        found = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(found, -1)), pa.array(np.append(total[found], n))], names=["feature", "n"])

    counts = docs.select("text").mapInArrow(run, "feature long, n long").groupBy("feature").agg(F.sum("n").alias("n")).collect()
    out, n = np.zeros(SIZE, np.int64), 0
    for r in counts:
        if r["feature"] < 0:
            n = r["n"]
        else:
            out[r["feature"]] = r["n"]
    return out, n


def sample(learnable: DataFrame, rows: int, seed: int) -> DataFrame:
    """lang and text of `rows` distinct examples at most, as many of each language as there are, those with the least hashes.

    A language's share of rows is thinned by hash before it is ordered, so no language is ordered whole.
    """
    keyed = learnable.select("lang", "text", F.xxhash64("text", F.lit(seed)).alias("key"))
    groups = keyed.groupBy("lang", "key").agg(F.count(F.lit(1)).alias("n"))
    sizes = groups.groupBy("lang").agg(F.count(F.lit(1)).alias("distinct"))
    sizes = sizes.orderBy(F.desc("distinct"), "lang").limit(rows).collect()  # rows languages at most
    if not sizes:
        return keyed.limit(0).select("lang", "text", "key")
    each = max(1, rows // len(sizes))
    spark = learnable.sparkSession
    kept = spark.createDataFrame([(r["lang"], float(min(1.0, 2.0 * each / r["distinct"] + 64 / r["distinct"]))) for r in sizes], "lang string, part double")
    thinned = groups.join(F.broadcast(kept), "lang").where(F.shiftrightunsigned("key", 11) < F.col("part") * float(1 << 53))
    picked = thinned.withColumn("place", F.row_number().over(Window.partitionBy("lang").orderBy("key"))).where(F.col("place") <= each).select("lang", "key")
    return keyed.join(F.broadcast(picked), ["lang", "key"]).groupBy("lang", "key").agg(F.min("text").alias("text"))


def ftrl(examples: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, classes: int, alpha: float = 0.3, beta: float = 1.0, l1: float = 0.3, l2: float = 0.1, epochs: int = 4, seed: int = 0) -> np.ndarray:
    """Weights (SIZE + 1 by classes, the last row the bias) by follow-the-regularised-leader, an example a step.

    z holds the sum of gradients less what the proximal terms take back, n that of their squares. A weight is 0 while its z
    is within l1; beyond, l2 and the root of n hold it back. The bias has no penalty.
    """
    z, n = np.zeros((SIZE + 1, classes)), np.zeros((SIZE + 1, classes))
    low = np.full((SIZE + 1, 1), l1)
    low[SIZE] = 0.0

    def weights(at: np.ndarray) -> np.ndarray:
        zi, ni, li = z[at], n[at], low[at]
        return np.where(np.abs(zi) <= li, 0.0, (np.sign(zi) * li - zi) / ((beta + np.sqrt(ni)) / alpha + l2))

    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        for i in rng.permutation(len(examples)):
            at, x = examples[i]
            w = weights(at)
            p = softmax((x @ w)[None])[0]
            p[y[i]] -= 1.0
            g = x[:, None] * p[None]
            more = n[at] + g * g
            z[at] += g - (np.sqrt(more) - np.sqrt(n[at])) / alpha * w
            n[at] = more
    return weights(np.arange(SIZE + 1))


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def fit_temperature(logits: np.ndarray, y: np.ndarray) -> float:
    """The temperature with the least log loss, by golden section over its logarithm; the loss has one minimum in 1 / T."""
    if not len(y):
        return 1.0
    loss = lambda t: -np.log(np.maximum(softmax(logits / np.exp(t))[np.arange(len(y)), y], 1e-12)).mean()
    a, b, r = np.log(0.05), np.log(20.0), (5**0.5 - 1) / 2
    for _ in range(60):
        c, d = b - r * (b - a), a + r * (b - a)
        a, b = (a, d) if loss(c) <= loss(d) else (c, b)
    return float(np.exp((a + b) / 2))


def learn(docs: DataFrame, sample_rows: int = 3000, seed: int = 13) -> Model | None:
    """The model, or none where there is nothing to learn from.

    sample_rows bounds the examples for weights and temperature together, shared out evenly among languages (where there are
    more languages than that, the most frequent are learned). An example comes to the driver as its features, SIZE at most.
    """
    known = F.coalesce(fold_remainder(F.col("doc_id"), 3), F.lit(1)) != 1
    learnable = docs.where(known & F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}")).select(F.col("lang").cast("string").alias("lang"), "text")
    frequency, n = document_frequencies(learnable)
    if not n:
        return None
    rarity = np.where(frequency > 0, np.log((1.0 + n) / (1.0 + frequency)) + 1.0, 0.0) * SCALE

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 2):
            found = [features_of(t) for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([f.tobytes() for f, _ in found]), pa.array([x.tobytes() for _, x in found])], names=["lang", "key", "features", "shares"])

    rows = sample(learnable, sample_rows, seed).select("lang", "key", "text").mapInArrow(run, "lang string, key long, features binary, shares binary").collect()
    rows.sort(key=lambda r: (r["lang"], r["key"]))
    languages = sorted({r["lang"] for r in rows})
    y = np.array([languages.index(r["lang"]) for r in rows])
    examples = []
    for r in rows:
        at = np.frombuffer(r["features"], np.int32)
        examples.append((np.append(at, SIZE), np.append(np.frombuffer(r["shares"], np.float32) * rarity[at], 1.0)))
    if len(languages) == 1:
        return Model(languages, np.zeros((SIZE, 1), np.float32), np.zeros(1), 1.0)
    last = np.array([r["key"] % 5 == 0 for r in rows])
    fit = np.flatnonzero(~last) if len(set(y[~last])) == len(languages) else np.arange(len(rows))
    weights = ftrl([examples[i] for i in fit], y[fit], len(languages), seed=seed)
    held = np.flatnonzero(last)
    logits = np.stack([x @ weights[at] for at, x in (examples[i] for i in held)]) if len(held) else np.zeros((0, len(languages)))
    return Model(languages, (weights[:SIZE] * rarity[:, None]).astype(np.float32), weights[SIZE], fit_temperature(logits, y[held]))


def scores(texts: list[str], model: Model) -> np.ndarray:
    """The probability of each language, a row for each text."""
    code, ends = characters(texts)
    out = np.zeros((len(texts), len(model.languages)))
    for a in range(0, len(code), BLOCK):
        # A block reads on into the next one, so grams across its end are counted once.
        for k, feature in enumerate(gram_features(code[a : a + BLOCK + ORDERS - 1])):
            feature = feature[: min(BLOCK, max(0, len(code) - k - a))]
            if not len(feature):
                continue
            value = model.weights[feature]
            place = np.arange(a, a + len(feature))
            first = np.searchsorted(ends, a, side="right") - 1
            cuts = ends[first + 1 : np.searchsorted(ends, a + len(feature))] - a
            starts = np.concatenate([[0], cuts]).astype(np.int64)
            owner = first + np.arange(len(starts))
            if k:  # grams that reach into the next text
                value = np.where((ends[owner[np.searchsorted(starts, place - a, side="right") - 1] + 1] - place > k)[:, None], value, np.float32(0))
            np.add.at(out, owner, np.add.reduceat(value.astype(np.float64), starts, axis=0))
    logits = out / gram_total(np.diff(ends))[:, None] + model.bias
    return softmax(logits / model.temperature)


def predict(docs: DataFrame, model: Model | None) -> DataFrame:
    """doc_id, lang_pred and score, one row for each row of docs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1):
            given = batch.column(1).to_pylist()
            at = [i for i, t in enumerate(given) if t is not None]
            named, score = [UNKNOWN] * len(given), np.zeros(len(given))
            if at and model is not None:
                p = scores([given[i] for i in at], model)
                best = p.argmax(1)
                score[at] = p[np.arange(len(p)), best]
                for i, k in zip(at, best.tolist(), strict=True):
                    named[i] = model.languages[k]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(named, pa.string()), pa.array(score)], schema=_SCORED)

    has_letter: Column = F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.when(has_letter, F.col("text")).alias("text")).mapInArrow(run, "doc_id long, lang_pred string, score double")


def op13(docs: DataFrame) -> DataFrame:
    out = predict(docs, learn(docs))
    return out.select("doc_id", (F.coalesce(fold_remainder(F.col("doc_id"), 3), F.lit(0)) == 1).alias("held_out"), "lang_pred", "score")
