"""Boards, rosters and listings on rows with nulls, blanks and fixed results."""

from pyspark.sql import functions as F

from fieldglass.operators import listings as L


def test_review_titles(spark):
    rows = [
        ("Bright Path Behavioral Therapy - Reviews", "Bright Path Behavioral Therapy", True),
        ("Path to a bright future", "Bright Path Behavioral Therapy", True),
        ("Bright future", "Bright Path Behavioral Therapy", False),
        ("ABA Therapy Center", "ABA Therapy Center", False),
        ("Sun", "Sun", False),
        (None, "Bright Path Behavioral Therapy", False),
        ("Bright Path", None, False),
    ]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, title string, name string, want boolean")
    got = df.select("i", "want", L.review_belongs("title", "name").alias("got")).collect()
    assert [r.i for r in got if r.got != r.want] == []


def test_roster_has_no_fallback(spark):
    df = spark.createDataFrame([("Saline County Infants",), ("Ottawa county program",), (None,)], "name string")
    count = lambda place: L.roster_for(df, "name", place).count()
    assert [count(p) for p in ("Kansas", "", "Saline County, KS", "saline", "Butler County")] == [3, 3, 1, 0, 0]


def test_search_skips_nulls(spark):
    df = spark.createDataFrame([(1, "Ada", None, [" x", "y"]), (2, None, "", None)], "i int, name string, stage string, signals array<string>")
    found = lambda q: [r.i for r in L.board_search(df, ["name", "stage", "signals"], q).collect()]
    assert found(" ada  X ") == [1]
    assert sorted(found("  ")) == [1, 2]


def test_unknown_coverage_is_below_the_floor(spark):
    df = spark.createDataFrame([(12.0, 12, 80, "High"), (11.9, 40, 80, "High"), (None, 40, 80, "High")], "c double, o int, s int, l string")
    assert [tuple(r) for r in df.select(*L.evidence_floor("c", "o", "s", "l")).collect()] == [(80, "High"), (0, "Insufficient Evidence"), (0, "Insufficient Evidence")]


def test_status_needs_two_publishers(spark):
    rows = [("a", "service-capacity.q", True, ["p", "p"]), ("b", "service-capacity.q", True, ["p", "q"]), ("c", "service-capacity.q", False, ["p", "q"]), ("d", "other", True, None), ("e", "school-service-access.q", True, ["", "q"])]
    out = L.demand_status(spark.createDataFrame(rows, "area string, indicator string, corroborated boolean, publishers array<string>"), ["area"])
    assert {r.area for r in out.where(F.col("status") != "unverified").collect()} == {"b"}
    assert out.count() == 5
