import random
import re
from collections import defaultdict

import numpy as np
import pytest

from fieldglass.llm import components, near

SF = "/root/testdata/sf0.01"


def set_of(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return frozenset()
    k = min(5, len(words))
    return frozenset(tuple(words[i : i + k]) for i in range(len(words) - k + 1))


def brute(rows):
    by = defaultdict(list)
    for i, t in rows:
        by[set_of(t)].append(i)
    parent = {i: i for i, _ in rows if i is not None}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    def tie(a, b):
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)

    own = defaultdict(list)
    for s, ids in by.items():
        ids = [i for i in ids if i is not None]
        if s and ids:
            own[min(ids)].append(s)
            for i in ids:
                tie(i, min(ids))
    columns = defaultdict(list)
    flat = [(i, s) for i, sets in own.items() for s in sets]
    seen = set()
    for k, (_, s) in enumerate(flat):
        for x in s:
            columns[x].append(k)
    for ks in columns.values():
        for a in ks:
            for b in ks:
                if a < b and (a, b) not in seen:
                    seen.add((a, b))
                    (i, s), (j, t) = flat[a], flat[b]
                    if min(len(s), len(t)) >= 0.75 * max(len(s), len(t)) and 100 * len(s & t) >= 75 * len(s | t):
                        tie(i, j)
    out = []
    for i, t in rows:
        s = set_of(t)
        ids = [x for x in by[s] if x is not None]
        out.append((i, len(s), (find(min(ids)) if ids else None) if s else i))
    return sorted(out, key=str)


def rows_of(df):
    return sorted(((r.doc_id, r.n_shingles, r.component_id) for r in df.collect()), key=str)


def test_documents_match_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = rows_of(near.op4(docs))
    assert got == brute([(r.doc_id, r.text) for r in docs.collect()])
    assert sum(i != c for i, _, c in got) > 20


def test_threshold_chains_and_crowds(spark):
    rng = random.Random(4)
    rows, n = [], 0
    for size in (5, 6, 7, 12, 40, 120):
        base = [f"w{rng.randrange(10**6)}" for _ in range(size)]
        for _ in range(12):
            rows.append((n, " ".join(base)))
            n += 1
            base = list(base)
            for _ in range(rng.choice((1, 1, 2, 3))):
                base[rng.randrange(len(base))] = f"x{n}"
    shared = [f"common{k}" for k in range(60)]
    for k in range(60):  # documents that share a passage and are linked only if little is their own
        rows.append((n, " ".join(shared + [f"own{n}x{j}" for j in range(4 + k % 20)])))
        n += 1
    base = [f"v{k}" for k in range(200)]
    for k in range(80):
        rows.append((n, " ".join(base[:k] + [f"edit{k}"] + base[k + 1 :])))
        n += 1
    rng.shuffle(rows)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert rows_of(near.op4(docs)) == brute(rows)


def test_edge_cases(spark):
    rows = [(1, None), (2, ""), (3, " \n"), (4, "One"), (5, "ONE"), (6, "É a"), (7, "é a"), (None, "one"), (None, "nobody else has this"), (8, "a b c d e f"), (8, "a b c d e f"), (9, "w " * 200000 + "end"), (10, "w " * 100000 + "end")]
    docs = spark.createDataFrame([(*r, 1, "k") for r in rows], "doc_id long, text string, n int, component string")
    assert rows_of(near.op4(docs)) == brute(rows)
    kept = near.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted((str(r.doc_id) for r in kept.collect())) == sorted(["1", "10", "2", "3", "4", "6", "7", "8", "9", "None", "None"]) or {r.doc_id for r in kept.collect()} == {i for i, _, c in brute(rows) if i is None or i == c}
    assert near.op4(docs.limit(0)).count() == 0 and near.keep_one(docs.limit(0)).count() == 0


@pytest.mark.parametrize("shape", ["path", "star", "random"])
def test_components(spark, shape):
    rng = random.Random(1)
    edges = {"path": [(i, i + 1) for i in range(200)], "star": [(150, i) for i in range(150)], "random": [(rng.randrange(300), rng.randrange(300)) for _ in range(200)]}[shape]
    parent = list(range(301))

    def find(x):
        return x if parent[x] == x else find(parent[x])

    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    got = {r.node: r.component for r in components.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {x: find(x) for e in edges for x in e if find(x) != x}


def test_window_hash_is_of_the_words_in_order():
    x = np.arange(50, dtype=np.uint64)
    for k in (1, 2, 3, 5, 35):
        h = near.window_hash(x, k)
        assert len(h) == 51 - k and len(set(h)) == len(h)
        assert (near.window_hash(x[7:], k) == h[7:]).all()
    assert near.window_hash(np.array([1, 2], np.uint64), 2) != near.window_hash(np.array([2, 1], np.uint64), 2)


def test_keep_one_with_null_and_repeated_ids(spark):
    words = [f"w{k}" for k in range(60)]
    a, near_a, b, c = " ".join(words), " ".join(words[:-1]), " ".join(f"x{k}" for k in range(60)), " ".join(f"y{k}" for k in range(60))
    rows = [(3, a), (5, near_a), (5, b), (None, a), (None, c), (None, c), (7, b), (9, None), (10, ""), (11, "z"), (11, "z")]
    docs = spark.createDataFrame([(*r, "en", k) for k, r in enumerate(rows)], "doc_id long, text string, component_id string, n long")
    got = near.keep_one(docs)
    assert got.columns == docs.columns
    want = {(3, a), (5, b), (None, c), (9, None), (10, ""), (11, "z")}
    kept = got.collect()
    assert {(r.doc_id, r.text) for r in kept} == want and len(kept) == len(want)
    assert sorted(map(str, near.keep_one(docs.repartition(5)).collect())) == sorted(map(str, kept))
    assert near.keep_one(docs.limit(0)).count() == 0
