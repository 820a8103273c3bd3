"""Operators on small literal tables with known outcomes."""

import pytest
from pyspark.sql import functions as F

from fieldglass.functions import exprs as X
from fieldglass.functions import text as T
from fieldglass.operators import cleanse, evidence, frames, ranking, scoring, spatial, workspace
from fieldglass.operators.indicators import INDICATORS


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def values(spark, column, *rows, schema="v double"):
    return [r["x"] for r in spark.createDataFrame([(r,) if not isinstance(r, tuple) else r for r in rows], schema).select("*", column.alias("x")).collect()]


def test_percentiles(spark):
    assert sorted(values(spark, X.mid_rank("v"), 1.0, 2.0, 2.0, 3.0, 9.0)) == [10, 40, 40, 70, 90]
    assert sorted(values(spark, X.lower_rank("v"), 1.0, 2.0, 2.0, 3.0, 9.0)) == [0, 20, 20, 60, 80]
    assert values(spark, X.mid_rank("v", least=5), 1.0, 2.0) == [None, None]
    assert sorted(values(spark, X.mid_rank("v"), 1.0, None, 3.0), key=str) == [25, 75, None]


def test_unknown_is_never_zero(spark):
    assert one(spark, X.ratio(F.lit(3), F.lit(0))) is None and one(spark, X.ratio(F.lit(3), F.lit(None).cast("int"))) is None
    assert one(spark, X.smoothed(F.lit(6), F.lit(0))) == 6 and one(spark, X.smoothed(F.lit(6), F.lit(None).cast("int"))) is None
    assert [one(spark, X.half_up(F.lit(v))) for v in (-2.5, 2.5, 2.4)] == [-2, 3, 2]
    assert one(spark, X.clamp(F.lit(None).cast("double"))) is None and one(spark, X.clamp(F.lit(120.0))) == 100
    df = spark.createDataFrame([("5",), ("-666666",), ("",), (None,), ("NaN",)], "s string")
    assert [r[0] for r in df.select(X.measured("s")).collect()] == [5.0, None, None, None, None]
    df = spark.createDataFrame([("a", 1.0), ("a", None), ("b", 2.0), ("b", 3.0)], "k string, v double")
    assert {r.k: r.x for r in df.groupBy("k").agg(X.whole_sum("v").alias("x")).collect()} == {"a": None, "b": 5.0}


def test_medians_and_means(spark):
    df = spark.createDataFrame([(float(v), w) for v, w in ((1, 0), (2, 0), (3, 0), (4, 0))], "v double, w int")
    assert df.agg(X.upper_median("v").alias("x")).first()["x"] == 3
    assert df.agg(X.weighted_mean("v", "w").alias("x")).first()["x"] == 3  # 2.5 rounds up
    df = spark.createDataFrame([(90.0, 90), (10.0, 10)], "v double, w int")
    assert df.agg(X.weighted_mean("v", "w").alias("x")).first()["x"] == 82


def test_distances(spark):
    assert one(spark, X.miles(F.lit(39.1), F.lit(-94.58), F.lit(38.63), F.lit(-90.2))) == pytest.approx(237, abs=5)
    w = lambda d, r, a: one(spark, X.disc_weight(F.lit(d), F.lit(r), F.lit(a)))
    assert w(0.0, 2.0, 1.0) == 1 and w(20.0, 2.0, 1.0) == 0 and 0 < w(2.0, 2.0, 3.0) < 1 and w(0.0, 2.0, 400.0) < 0.05
    for d in (0.0, 1.0, 3.0, 6.0):
        found = [w(d, r, 9.0) for r in (2.0, 5.0, 10.0)]
        assert found == sorted(found)


def test_radius_join_equals_all_pairs(spark):
    import random

    rng = random.Random(2)
    points = [(i, rng.uniform(60, 71), rng.uniform(-20, 20)) for i in range(300)]
    df = spark.createDataFrame(points, "id int, lat double, lon double")
    sites = df.limit(40).withColumnRenamed("id", "site")
    got = {(r.site, r.id) for r in spatial.within(sites, df, 40).collect()}
    want = {(r.site, r.id) for r in sites.select("site", F.col("lat").alias("a"), F.col("lon").alias("b")).join(df, F.lit(True)).where(X.miles("a", "b", "lat", "lon") <= 40).collect()}
    assert got == want and len(got) > 40


def test_polygon_with_a_hole(spark):
    square = lambda w, e, s, n: [(w, s), (w, n), (e, n), (e, s)]
    hole = square(-90.6, -90.4, 38.4, 38.6)
    shapes = spark.createDataFrame([("29189", 0, [square(-91.0, -90.0, 38.0, 39.0), hole]), ("29510", 1, [hole])], "shape string, order int, rings array<array<struct<lon:double,lat:double>>>")
    points = spark.createDataFrame([(1, 38.5, -90.5), (2, 38.2, -90.8), (3, 45.0, -100.0)], "id int, lat double, lon double")
    assert {r.id: r["shape"] for r in spatial.locate(points, shapes, "id").collect()} == {1: "29510", 2: "29189", 3: None}


def test_text_keys(spark):
    key = lambda s: one(spark, T.area_key(F.lit(s)))
    assert key("St. Louis city, Missouri") == "stlouiscity" and key("DE KALB") == key("DeKalb County") and key("Ste. Genevieve") == key("SAINTE GENEVIEVE")
    pub = lambda s: one(spark, T.publisher(F.lit(s)))
    assert pub("news.example.com") == "example.com" and pub("news.east.example.co.uk") == "example.co.uk" and pub("") == "" and pub("www.nschdata.org") == "childhealthdata.org"
    assert one(spark, T.clean_url(F.lit("https://Example.org/Path/?utm_source=x&id=2&fbclid=abc#top"))) == "https://example.org/Path?id=2"
    assert one(spark, T.phones(F.lit("call 1 (800) 273-8255, 816-555-0199 or 800.273.8255"))) == ["(800) 273-8255"]
    assert one(spark, T.emails(F.lit("A@b.org a@b.org x@y.png noreply@z.com"))) == ["a@b.org", "noreply@z.com"]
    years = lambda s: one(spark, T.age_years(F.lit(s)))
    assert years("6 WKS") == pytest.approx(0.12, abs=0.01) and years("2 YRS 6 MOS") == 2.5 and years("12") == 12 and years("unknown") is None
    assert one(spark, T.has_word(F.lit("tornados passed"), "ados")) is False and one(spark, T.has_word(F.lit("the ados test"), "ados")) is True


def test_indicator_catalog():
    assert len(INDICATORS) == len({x.id for x in INDICATORS}) == 90
    families = [x.family for x in INDICATORS]
    assert {f: families.count(f) for f in set(families)} == {"service_gap": 30, "referral_network": 20, "payer_fit": 13, "access": 10, "need_intensity": 7, "validation": 10}
    assert all(len(x.metrics) >= 1 for x in INDICATORS) and sum(x.direction == "agreement" for x in INDICATORS) == 10


def test_ranking_order_and_confidence(spark):
    rows = [("s", f"a{i}", ind, fam, "higher", float(i)) for i in range(6) for ind, fam in (("x", "service_gap"), ("y", "access"))]
    rows += [("s", "empty", ind, fam, "higher", None) for ind, fam in (("x", "service_gap"), ("y", "access"))]
    long = spark.createDataFrame(rows, "state string, area string, indicator string, family string, direction string, raw double")
    out = {r.area: r for r in ranking.ordinal(ranking.composite(ranking.percentiles(long))).collect()}
    assert [k for k in sorted(out, key=lambda k: out[k]["rank"] or 99)] == ["a5", "a4", "a3", "a2", "a1", "a0", "empty"]
    assert out["empty"]["rank"] is None and out["a0"]["ranked_of"] == 6 and out["a5"]["confidence"] == 83


def test_integrity_in_order(spark):
    df = spark.createDataFrame([(5.0, 3.0, 4.0)], "a double, b double, c double")
    r = cleanse.part_of_whole(df, [("a", "b"), ("c", "b")]).first()
    assert (r.a, r.b, r.c, r.issues) == (None, None, 4.0, ["a > b"])
    r = cleanse.universe_ratio(spark.createDataFrame([(10.0, 100.0, 1000.0), (10.0, 100.0, 150.0)], "x double, t double, base double"), ["x", "t"], "t", "base", 0.8, 1.2).collect()
    assert r[0].x is None and r[1].x == 10


def test_assembly_priority(spark):
    long = spark.createDataFrame([("s", "a", "m", 1.0, 1), ("s", "a", "m", 2.0, 2), ("s", "b", "n", 3.0, 1)], "state string, area string, metric string, value double, priority int")
    assert {r.area: (r.m, r.n) for r in frames.assemble(long, ["m", "n"]).collect()} == {"a": (2.0, None), "b": (None, 3.0)}


def test_corroboration_counts_publishers(spark):
    hits = spark.createDataFrame([("r", "p1", 1, "same story", True), ("r", "p1", 2, "other", True), ("r", "p2", 3, "Same story!", False), ("r", "p3", 4, "third", False), ("r", "", 5, "x", True)], "rule string, publisher string, doc_id int, text string, inst boolean")
    alone = evidence.independent(evidence.first_publishers(hits, ["rule"]), ["rule"], "text")
    assert sorted(r.publisher for r in alone.collect()) == ["p1", "p3"]
    r = evidence.corroborate(alone.withColumn("official", F.lit(False)), ["rule"], "inst", "official").first()
    assert r.publishers == 2 and r.verified and (r.value, r.confidence) == (64, 62)


def test_reconcile_is_idempotent(spark):
    ts = lambda s: F.col(s).cast("timestamp")
    mk = lambda rows: spark.createDataFrame(rows, "id string, v int, at string").withColumn("at", ts("at"))
    local = mk([("local-only", 1, "2024-01-01"), ("local-newer", 2, "2024-02-01"), ("tie", 3, "2024-01-01"), ("bad", 4, None)])
    durable = mk([("local-newer", 20, "2024-01-01"), ("tie", 30, "2024-01-01"), ("bad", 40, "2024-01-01"), ("durable-only", 50, "2024-01-01")])
    out = workspace.reconcile(local, durable, "id", "at")
    assert {r.id for r in out.where("backfill").collect()} == {"local-only", "local-newer"}
    assert {r.id: r.v for r in out.collect()} == {"local-only": 1, "local-newer": 2, "tie": 30, "bad": 40, "durable-only": 50}
    again = workspace.reconcile(out.drop("backfill"), out.drop("backfill"), "id", "at")
    assert not again.where("backfill").count() and {r.id: r.v for r in again.collect()} == {r.id: r.v for r in out.collect()}


def test_upsert_keeps_stages(spark):
    old = spark.createDataFrame([("a", "Won", 1), ("b", "New", 2)], "id string, stage string, v int")
    new = spark.createDataFrame([("a", "New", 9), ("c", "New", 3)], "id string, stage string, v int")
    assert {tuple(r) for r in workspace.upsert(old, new, "id", keep=["stage"]).collect()} == {("a", "Won", 9), ("b", "New", 2), ("c", "New", 3)}
