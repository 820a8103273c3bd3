import corpus_pipeline
from fieldglass.llm import lines, near, rules

SF = "/root/testdata/sf0.001"


def test_stages_keep_columns_and_take_effect(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, seen = docs.columns, [docs.count()]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        before = docs
        stage(spark, docs, SF).write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        assert docs.columns == columns
        seen.append(docs.count())
        if k == 0:
            kept = {r.doc_id for r in rules.op8(before, spark.read.parquet(f"{SF}/labels.parquet")).collect() if r.kept}
            assert {r.doc_id for r in docs.collect()} == kept
        if k == 1:
            gone = {r.doc_id for r in before.collect()} - {r.doc_id for r in docs.collect()}
            lost = {r.doc_id: r.n_removed for r in lines.op10(before).collect()}
            assert gone and all(lost[i] for i in gone)
            assert {r.doc_id for r in docs.collect() if r.n_chars != len(r.text)} <= {i for i, n in lost.items() if not n}
        if k == 2:
            labels = {r.doc_id: r.component_id for r in near.op4(before).collect()}
            assert sorted(r.doc_id for r in docs.collect()) == sorted(set(labels.values()))
    assert seen[1] < seen[0] and seen[2] <= seen[1] and seen[3] <= seen[2]
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, SF).toPandas()
    assert packed.groupby("sequence_id").length.sum().max() <= 2048
    assert set(packed.doc_id) == {r.doc_id for r in docs.select("doc_id").distinct().collect()}


def test_run_is_its_stages(spark):
    assert corpus_pipeline.run(spark, SF).count() > 100


def test_edge_cases(spark, tmp_path):
    """Nulls in every column, empty and long texts, repeated rows, an empty table and columns with clashing names."""
    good = [" ".join(f"word{i}x{k}" for k in range(40)) + "." for i in range(6)]
    rows = [(1, good[0], "en", "src1", 9), (1, good[0], "en", "src1", 9), (2, good[1], None, None, None), (None, good[2], "en", None, 1), (None, good[2], "en", None, 1), (None, None, None, None, None), (3, "", "de", "src2", 0), (4, good[3] + "\n" + good[4], "en", "src1", 5), (5, good[4], "fr", "src9", 5), (6, " ".join(f"t{k}" for k in range(30000)), "en", "src1", 5)]
    docs = spark.createDataFrame([(*r, "x", 1.5) for r in rows], "doc_id long, text string, lang string, source string, n_chars long, tokens string, stats double")
    spark.createDataFrame([(1, 1, 0), (None, None, None)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() > 0
    for now in (docs, docs.limit(0)):
        for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
            out = stage(spark, now, str(tmp_path))
            assert k == 4 or out.columns == docs.columns
            got = sorted(map(str, out.collect()))
            if k in (1, 2):
                assert got == sorted(map(str, stage(spark, now.repartition(3), str(tmp_path)).collect()))
            assert got or k in (3, 4) or not now.take(1)


def test_clashing_names_change_nothing(spark, tmp_path):
    """Extra columns named like what operators use inside: every stage and operator gives what it gives without them."""
    names = sorted({"n", "times", "rows", "key", "count", "size", "cid", "column", "component", "component_id", "group", "first", "own", "place", "near", "u", "v", "d", "e", "k", "i", "lines", "words", "stats", "stats_kept", "rule", "tokens", "domain", "epoch", "taken", "bucket", "budget", "row", "row_key", "id", "text_key", "removed", "kept", "length", "piece", "start", "offset", "sequence_id", "ids", "label", "quality", "score", "fold", "block", "chunk", "set", "name", "a.b", "node", "order_key", "full", "rest", "odd", "capacity", "weight", "share", "bad", "prune"})
    rows = [(r.doc_id, r.text, r.lang, r.source, r.n_chars) for r in spark.read.parquet(f"{SF}/documents.parquet").limit(40).collect()]
    rows += [rows[0], rows[0], (None, rows[1][1], None, None, None), (None, None, None, None, None), (10**6, "", "en", "src1", 0), (10**6 + 1, rows[2][1] + "\n" + rows[3][1], "en", "src2", 5)]
    plain = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    extra = plain.select("*", *(spark_lit(c) for c in names))
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        want, got = stage(spark, plain, SF), stage(spark, extra, SF)
        if k < 4:
            assert sorted(got.columns) == sorted(extra.columns), name
            rows = sorted(map(str, got.select(*plain.columns).collect()))
            if k < 3:
                assert rows == sorted(map(str, want.select(*plain.columns).collect())), name
            else:  # the order that a budget takes rows in is by all their columns
                assert rows and set(rows) <= set(map(str, plain.collect()))
            assert all(r.n == "n" and r["a.b"] == "a.b" for r in got.collect())
        else:
            assert got.count() == want.count()
        assert stage(spark, extra.limit(0), SF).collect() == []


def spark_lit(name):
    from pyspark.sql import functions as F

    return F.lit(name).alias(name)
