import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from fieldglass.llm import recompress, repeats

SF = "/root/testdata/sf0.01"


def brute(rows, width=35):
    split = [(i, (t or "").encode().split()) for i, t in rows]
    starts = Counter(tuple(w[k : k + width]) for _, w in split for k in range(len(w) - width + 1))
    out = []
    for i, w in split:
        gone = np.zeros(len(w), bool)
        for k in range(len(w) - width + 1):
            if starts[tuple(w[k : k + width])] > 1:
                gone[k : k + width] = True
        kept = b" ".join(x for x, g in zip(w, gone, strict=True) if not g)
        out.append((i, len(w), int(gone.sum()), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def rows_of(df):
    return sorted(((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in df.collect()), key=str)


def test_documents_match_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = rows_of(repeats.op7(docs))
    assert got == brute([(r.doc_id, r.text) for r in docs.collect()])
    assert sum(r[2] > 0 for r in got) > 50 and any(0 < r[2] < r[1] for r in got)


@pytest.mark.parametrize("seed", [1, 2])
def test_random_texts_with_runs_and_periods(spark, seed):
    rng = random.Random(seed)
    passage = [f"p{k}" for k in range(80)]
    rows = []
    for i in range(60):
        w = []
        for _ in range(rng.randrange(1, 8)):
            kind = rng.randrange(5)
            n = rng.randrange(1, 90)
            if kind == 0:
                w += [f"q{rng.randrange(3)}"] * n
            elif kind == 1:
                w += (["x", "y", "z"][: rng.randrange(1, 4)] * n)[:n]
            elif kind == 2:
                k = rng.randrange(60)
                w += passage[k : k + rng.randrange(20, 60)]
            else:
                w += [f"w{rng.randrange(400)}" for _ in range(n)]
        rows.append((i, " ".join(w)))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert rows_of(repeats.op7(docs)) == brute(rows)


def test_edge_cases(spark):
    long = " ".join(f"a{k}" for k in range(50))
    rows = [(1, None), (2, ""), (3, "few words"), (3, "few words"), (4, long), (4, long), (None, long + " tail"), (5, "w " * 40000), (6, " ".join(f"a{k}" for k in range(34))), (None, "x\ty\x0bz " * 5)]
    docs = spark.createDataFrame([(*r, 1, 2) for r in rows], "doc_id long, text string, n_words int, spans int")
    assert rows_of(repeats.op7(docs)) == brute(rows)
    texts = {(r.doc_id, r.n_words): r.kept for r in repeats.without_repeats(docs, texts=True).collect()}
    assert texts[None, 51] == "tail" and texts[4, 50] == "" and texts[3, 2] is None
    assert repeats.op7(docs.limit(0)).count() == 0


def test_names_depend_only_on_the_stretch_they_tell():
    rng = np.random.default_rng(5)
    for _ in range(300):
        size = int(rng.integers(1, 4))
        common = rng.integers(0, 3, int(rng.integers(5, 40))).astype(np.uint64)
        found = []
        for _ in range(2):
            before, after = (rng.integers(0, 3, int(rng.integers(0, 20))).astype(np.uint64) for _ in range(2))
            words = np.concatenate([before, common, after])
            name, lo, hi = recompress.symbols(words, np.zeros(len(words), np.int64), size)
            inside = (lo >= len(before)) & (hi <= len(before) + len(common))
            found.append(set(zip((lo[inside] - len(before)).tolist(), (hi[inside] - len(before)).tolist(), name[inside].tolist(), strict=True)))
        assert found[0] == found[1]
