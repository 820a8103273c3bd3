import re

import pytest
from pyspark.sql import functions as F

from fieldglass.llm import rules

SF = "/root/testdata/sf0.001"


def brute(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = {}
    for i in range(len(words) - 4):
        windows.setdefault(tuple(words[i : i + 5]), []).append(i)
    covered = {j for at in windows.values() if len(at) > 1 for i in at for j in range(i, i + 5)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered))


@pytest.fixture(scope="module")
def judged(spark):
    return rules.op8(spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")).toPandas().set_index("doc_id")


def test_base_counts_match_brute_force(spark, judged):
    for r in spark.read.parquet(f"{SF}/documents.parquet").collect():
        want = brute(r.text)
        got = judged.loc[r.doc_id]
        assert tuple(got[list(rules.BASE)]) == want
        assert got.base_failed == (want[0] < 10 or 100 * want[4] > 20 * want[0])
        assert not (got.base_failed and got.kept)


def test_verdict_follows_labels(spark, judged):
    labels = spark.read.parquet(f"{SF}/labels.parquet").toPandas().set_index("doc_id").join(judged)
    assert labels[labels.quality == 1].kept.mean() > 0.9
    assert labels[labels.quality == 0].kept.mean() < 0.3


def test_edge_cases(spark):
    rows = [(1, None), (2, ""), (3, " \n\t"), (4, "a b c d e a b c d e a b"), (5, "x\n\nx\nx " * 3), (None, "one two"), (7, "w " * 30000), (7, "w " * 30000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("stats_rule", F.lit("mine")).withColumn("n_words", F.lit(1))
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    out = rules.op8(docs, labels)
    got = sorted((tuple(r[c] for c in ("doc_id", *rules.BASE)) for r in out.collect()), key=str)
    assert got == sorted(((i, *brute(t)) for i, t in rows), key=str)
    assert rules.keep_good(docs, labels).columns == docs.columns
    assert rules.op8(docs.limit(0), labels).count() == 0


def test_learned_list_is_ordered_and_pruned(spark):
    docs = spark.createDataFrame([(i, ("word%d " % i + "#### " * (i % 2)) + " ".join(f"t{i}x{k}" for k in range(20))) for i in range(300)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1 - i % 2, 0) for i in range(300)], "doc_id long, quality int, toxic int")
    found = rules.learn(docs, labels)
    assert len(found.rules) == 1 and len(found.rules[0]) == 1
    kept = {r.doc_id for r in rules.keep_good(docs, labels).collect()}
    assert kept == {i for i in range(300) if i % 2 == 0}


def test_verdict_on_labels_that_learning_never_saw(spark):
    from fieldglass.llm.common import fold_remainder

    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    held = fold_remainder(F.col("doc_id")) == 0
    found = rules.judge(docs, rules.learn(docs, labels.where(~held))).select("doc_id", "stats_kept").join(labels.where(held), "doc_id").toPandas()
    assert len(found) > 20
    assert found[found.quality == 1].stats_kept.mean() > 0.9
    assert found[found.quality == 0].stats_kept.mean() < 0.3
