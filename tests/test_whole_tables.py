"""Queries that cover their tables whole."""

import time

from pyspark.sql import functions as F

from fieldglass.operators import matching
from fieldglass.plans import registry


def test_phones_of_texts_without_parentheses(spark, tmp_path):
    rows = [(1, "call 816-555-2345"), (2, "816.555.2345"), (3, "+1 816 555 2345"), (4, "(816) 555-2345"), (5, "none"), (6, None)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: r.phones for r in registry.QUERIES["phone_extract"](spark, str(tmp_path)).collect()}
    assert got == {**dict.fromkeys((1, 2, 3, 4), "(816) 555-2345"), 5: ""}


def test_every_order_has_a_place(spark):
    sf = "/root/testdata/sf0.01"
    got = registry.QUERIES["task_order"](spark, sf)
    n = spark.read.parquet(f"{sf}/orders.parquet").count()
    assert n > 200 and sorted(r.place for r in got.collect()) == list(range(1, n + 1))


def test_replicas_hold_every_event(spark, tmp_path):
    rows = [(i, 100 + i, "view", f"2024-01-0{1 + i} 00:00:00", 1.0) for i in range(6)]
    events = spark.createDataFrame(rows, "event_id long, user_id long, event_type string, ts string, value double")
    events.selectExpr("event_id", "user_id", "event_type", "cast(ts as timestamp) ts", "value").write.parquet(str(tmp_path / "events.parquet"))
    for name in ("reconcile_lww", "upsert_merge"):
        assert {r.user_id for r in registry.QUERIES[name](spark, str(tmp_path)).collect()} == set(range(100, 106))


def test_listings_and_results_of_one_name_never_meet_one_by_one(spark):
    """20,000 listings of a name by 20,000 results of a title: 400 million pairs, for four rows a listing."""
    listings = spark.range(20_000).selectExpr("id as listing", "'Green House 1' as name", "if(id % 2 = 0, 'h.org', null) as host")
    results = spark.range(20_000).selectExpr("id as result", "id % 89 as rank", "if(id % 89 = 1, 'h.org', 'i.org') as host", "if(id % 89 = 0, 'Oak', 'The GREEN house 1') as title")
    began = time.monotonic()
    got = matching.listing_results(listings, results).groupBy("place").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("result").alias("kinds"), F.min("result").alias("low")).orderBy("place").collect()
    assert [tuple(r) for r in got] == [(k + 1, 20_000, 1, 1 + 89 * k) for k in range(4)]
    assert time.monotonic() - began < 60


def test_texts_of_one_wording_meet_names_once(spark, monkeypatch):
    """Names and texts that repeat are matched as one of each, and every pair of them comes out."""
    seen = []
    match = matching.match
    monkeypatch.setattr(matching, "match", lambda docs, rules, *by: seen.append((docs.count(), rules.count())) or match(docs, rules, *by))
    orgs = spark.createDataFrame([(1, "Oak Valley"), (2, "OAK valley"), (3, "Elm Hill"), (4, "Oak")], "org long, name string")
    texts = spark.createDataFrame([(10, "the oak, valley"), (11, "The Oak valley"), (12, "elm on a hill"), (13, "oak"), (14, None)], "doc long, text string")
    assert sorted(map(tuple, matching.mentioned(orgs, texts).collect())) == [(1, 10), (1, 11), (2, 10), (2, 11), (3, 12)]
    assert seen == [(2, 2)]
