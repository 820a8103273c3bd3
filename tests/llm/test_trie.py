import hashlib
import random
import zlib

import numpy as np
import pytest

from fieldglass.llm import trie

DDL = "conv_id long, turn long, role string, text string, depth string, ids int"


def brute(rows):
    """Every prefix of every rebuilt conversation, in dicts."""
    own = {}
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            key = hashlib.sha256(f"{len(role)}:{role}{text}".encode()).hexdigest()
            own.setdefault(c, []).append(((turn is not None, turn or 0), key, (role, text)))
    own = {c: [x[2] for x in sorted(t, key=lambda x: x[:2])] for c, t in own.items()}
    whole = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        base = c - (abs(c) % 100) * (1 if c >= 0 else -1)
        whole[c] = tuple(own.get(base, [])[:h] + turns[h:])
    nodes = {}
    for c, s in whole.items():
        for d in range(len(s) + 1):
            nodes.setdefault(s[:d], []).append(c)
    out = set()
    for path, members in nodes.items():
        below = [p for p in nodes if p[: len(path)] == path]
        children = [p for p in below if len(p) == len(path) + 1]
        leaves = sum(not any(q[: len(p)] == p and len(q) == len(p) + 1 for q in below) for p in below)
        saved = sum((len(nodes[p]) - 1) * len(p[-1][1]) for p in below if p)
        ends = ",".join(str(c) for c in sorted(members) if whole[c] == path)
        out.add((min(members), len(path), min(nodes[path[:-1]]) if path else None, len(members), len(children), leaves, saved, hashlib.sha256(ends.encode()).hexdigest()))
    return out


def result(df):
    rows = [tuple(r[c] for c in trie.COLUMNS) for r in df.select(*trie.COLUMNS).collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


def made(spark, rows):
    return spark.createDataFrame([(*r, "x", 1) for r in rows], DDL)


def random_rows(seed, convs, texts, most):
    rng = random.Random(seed)
    ids = rng.sample(range(-250, 900), convs)
    return [(c, t, rng.choice(["user", "assistant", None]), rng.choice(texts)) for c in ids for t in range(rng.randint(1, most))]


@pytest.mark.parametrize("seed,texts,most", [(1, ["a", "bb", "ccc"], 7), (2, ["x"], 9), (3, [f"t{i}" for i in range(40)], 4)])
def test_brute_force(spark, seed, texts, most):
    rows = random_rows(seed, 60, texts, most)
    assert result(trie.op11(made(spark, rows))) == brute(rows)


def test_many_shards(spark):
    """Shards of three sequences, and of few ids: nodes that many shards share are merged."""
    rows = random_rows(4, 70, ["a", "b", "\U0001f600é"], 8)
    sequences = trie.distinct_sequences(trie.rebuilt(trie.numbered_turns(made(spark, rows))))
    want = brute(rows)
    assert result(trie.trie(sequences, shard_sequences=3)) == want
    assert result(trie.trie(sequences, shard_ids=9)) == want
    assert result(trie.trie(sequences, shard_sequences=1)) == want


def test_copies_of_one_conversation(spark):
    """Ids in several stretches of 4096 are digested in order."""
    rows = [(c, t, "user", f"turn {t}") for c in (*range(3), *range(4095, 4098), 9000, 20000, -5, -7000) for t in range(6)]
    assert result(trie.op11(made(spark, rows))) == brute(rows)


def test_defined_cases(spark):
    rows = [(1, 0, None, None), (1, 0, None, None), (1, None, "user", "first"), (2, 3, "user", ""), (2, 3, "", "user"), (2, 3, "a", "tie"), (None, 1, "user", "lost"), (300, 1, "user", "z" * 100_000), (301, None, None, None), (307, 5, "user", "only"), (9_223_372_036_854_775_807, 1, "u", "x")]
    assert result(trie.op11(made(spark, rows))) == brute(rows)
    assert result(trie.op11(made(spark, rows).limit(0))) == set()
    only_root = [(c, 0, "user", "x") for c in range(101, 140) if zlib.crc32(str(c).encode()) % 6 > 0]
    assert {r[1] for r in result(trie.op11(made(spark, only_root)))} == {0}


def test_tree_is_balanced():
    """Among siblings the search tree is as deep as the logarithm of their number."""
    n = 1000
    tree = trie.Tree(np.arange(n, dtype=np.int64), np.arange(n), np.ones(n, np.int64))
    depth, deepest, todo = 0, 0, [(tree.inner[0], 1)]
    while todo:
        k, depth = todo.pop()
        if k >= 0:
            deepest = max(deepest, depth)
            todo += [(tree.less[k], depth + 1), (tree.greater[k], depth + 1)]
    assert deepest <= 10 and [tree.lo[k] for k in tree.walk()[1:]] == list(range(n))
