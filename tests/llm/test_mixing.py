import random
import re
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from fieldglass.llm import mixing

SF = "/root/testdata/sf0.01"


def pour(budget, children):
    """children: name -> (weight, capacity). Fill, and share out again until nothing is left."""
    out = dict.fromkeys(children, 0.0)
    open_ = {k for k, (w, c) in children.items() if w > 0 and c > 0}
    while budget > 1e-9 and open_:
        total = sum(children[k][0] for k in open_)
        gave = 0.0
        for k in list(open_):
            give = min(budget * children[k][0] / total, children[k][1] - out[k])
            out[k] += give
            gave += give
            if children[k][1] - out[k] < 1e-9:
                open_.discard(k)
        budget -= gave
    return out


def brute_budgets(leaves, weights, total, epochs):
    w = lambda level, k: weights.get(level, {}).get(k, 1.0)
    cap = {k: (t * epochs if all(w(x, y) > 0 for x, y in zip(mixing.LEVELS, k)) else 0.0) for k, t in leaves.items()}
    out = {(): min(total, sum(cap.values()))}
    for k in range(1, 4):
        below = {}
        for p, budget in out.items():
            names = {x[:k] for x in leaves if x[: k - 1] == p}
            below |= pour(budget, {n: (w(mixing.LEVELS[k - 1], n[-1]), sum(c for x, c in cap.items() if x[:k] == n)) for n in names})
        out = below
    return out


@pytest.mark.parametrize("seed", range(5))
def test_budgets_match_repeated_pouring(spark, seed):
    rng = random.Random(seed)
    leaves = {tuple(rng.choice("abc") for _ in range(3)): rng.randint(0, 50) for _ in range(12)}
    weights = {k: rng.randint(0, 4) for k in "ab"}
    total = rng.randint(1, 2 * sum(leaves.values()) + 1)
    tree = spark.createDataFrame([(*k, t) for k, t in leaves.items()], "domain string, lang string, source string, tokens long")
    got = {(r.domain, r.lang, r.source): r.budget for r in mixing.budgets(tree, {"domain": weights, "source": weights}, total, 2).collect()}
    for k, want in brute_budgets(leaves, {"domain": weights, "source": weights}, total, 2).items():
        assert got[k] == pytest.approx(want, abs=1.01)


def test_documents_fill_their_budgets(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    light = {r.doc_id: r for r in mixing.tokens_of(docs).collect()}
    for r in docs.collect():
        assert light[r.doc_id].tokens == len(re.findall(r"[^\x20\x09-\x0D]+", r.text))
    out = mixing.op3(docs).collect()
    leaves, got, seen = defaultdict(int), defaultdict(int), defaultdict(set)
    for r in light.values():
        leaves[r.domain, r.lang, r.source] += r.tokens
    for r in out:
        got[r.domain, r.lang, r.source] += r.taken
        assert r.epoch not in seen[r.doc_id]
        seen[r.doc_id].add(r.epoch)
    total = 0.8 * sum(leaves.values())
    want = brute_budgets(leaves, mixing.WEIGHTS, total, 4)
    for k, v in want.items():
        assert got[k] == pytest.approx(v, abs=1.01)
    assert sum(got.values()) == pytest.approx(total, abs=len(leaves) + 1)
    partial = [r for r in out if r.taken < r.tokens]
    assert len({(r.domain, r.lang, r.source) for r in partial}) == len(partial)
    assert out and sorted(map(str, mixing.op3(docs.repartition(3)).collect())) == sorted(map(str, out))
    assert sorted(map(str, mixing.op3(docs, seed=8).collect())) != sorted(map(str, out))


def test_prefix_is_the_same_for_any_bucket_size(spark):
    light = spark.range(500).select(F.col("id").alias("doc_id"), *(F.lit("a").alias(x) for x in mixing.LEVELS), (F.col("id") % 7).alias("tokens"))
    ones = [sorted(map(str, mixing.mix(light, {}, 333, bucket_rows=b).collect())) for b in (1, 10, 10**6)]
    assert ones[0] == ones[1] == ones[2]


def test_edge_cases(spark):
    rows = [(1, None, None, None), (2, "a b", "en", "src1"), (2, "a b", "en", "src1"), (None, "c", "xx", "src999999999"), (4, "w " * 30000, "de", "other"), (5, "", "en", "src2")]
    docs = spark.createDataFrame([(*r, 1, 1) for r in rows], "doc_id long, text string, lang string, source string, tokens int, epoch int")
    assert sum(r.taken for r in mixing.op3(docs, total=1.0).collect()) == 30005
    whole = mixing.mixed_documents(docs, total=1.0)
    assert whole.columns == docs.columns and {r.doc_id for r in whole.collect()} >= {2, None, 4}
    assert mixing.op3(docs.limit(0)).count() == 0 and mixing.mixed_documents(docs.limit(0)).count() == 0


def test_budget_holds_for_null_and_repeated_ids(spark):
    from pyspark.sql import functions as F

    rows = spark.range(200).select(F.when(F.col("id") % 2 == 0, None).otherwise(F.col("id") % 4).alias("doc_id"), F.concat(F.lit("w " * 49), F.when(F.col("id") < 100, F.lit("same")).otherwise(F.col("id").cast("string"))).alias("text"), F.lit("en").alias("lang"), F.lit("src1").alias("source"))
    docs = rows.withColumn("n_chars", F.length("text").cast("long"))
    got = mixing.mixed_documents(docs, total=1000, max_epochs=1).collect()
    assert len(got) == 20 and all(r.text.startswith("w ") for r in got)
    assert len(mixing.mixed_documents(docs, total=1.0, max_epochs=1).collect()) == 200
    assert sorted(map(str, mixing.mixed_documents(docs, total=25_000, max_epochs=4).collect())) == sorted(map(str, mixing.mixed_documents(docs.repartition(5), total=25_000, max_epochs=4).collect()))


def test_null_levels_are_a_group(spark):
    light = spark.createDataFrame([(1, None, "en", "a", 5), (2, "d", None, "b", 5), (3, "d", "en", None, 5)], "doc_id long, domain string, lang string, source string, tokens long")
    assert {r.doc_id for r in mixing.mix(light, {}, 15).collect()} == {1, 2, 3}
