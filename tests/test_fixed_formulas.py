"""Results that the formulas must give, as fixed values."""

from datetime import date

from pyspark.sql import functions as F

from fieldglass.functions.text import age_years
from fieldglass.operators import claims, evidence, matching, scoring, sites, spatial, workspace


def test_ages(spark):
    want = {"6 WKS": 0.12, "2 YRS 6 MOS": 2.5, "2.5 yrs": 2.5, "12": 12.0, "45": None, "9 days": None, "": None, "3 MONTHS": 0.25}
    rows = spark.createDataFrame([(k,) for k in want], "t string").select("t", age_years(F.col("t")).alias("y")).collect()
    assert {r.t: r.y for r in rows} == want


def test_crawl_rules(spark):
    urls = spark.createDataFrame([("1", "o", "/a/b"), ("2", "o", "/private/x"), ("3", "o", "/private/open"), ("4", "o", "/f.pdf"), ("5", "o", "/f.pdf?x"), ("6", "p", "/a")], "url string, origin string, path string")
    rules = spark.createDataFrame([("o", "/private", False), ("o", "/private/open", True), ("o", "/*.pdf$", False), ("o", "", False)], "origin string, pattern string, allow boolean")
    assert {r.url: r.allow for r in evidence.allowed(urls, rules).collect()} == {"1": True, "2": False, "3": True, "4": False, "5": True, "6": True}


def test_engine_score_and_grade(spark):
    obs = spark.createDataFrame([("a", 80.0, 30.0), ("b", 20.0, 60.0), ("c", 90.0, 50.0), ("d", 120.0, 40.0)], "indicator string, value double, confidence double")
    dims = spark.createDataFrame([("a", "p", "higher", ["x"]), ("b", "p", "lower", ["x", "y"]), ("c", "q", "confidence", ["x"]), ("d", "q", "gate", ["x"]), ("e", "q", "higher", ["x"]), ("f", "q", "higher", ["y"])], "indicator string, pillar string, direction string, engines array<string>")
    weights = spark.createDataFrame([("p", "x", 3), ("q", "x", 5), ("p", "y", 1)], "pillar string, engine string, weight int")
    got = {r.engine: r for r in scoring.engine_scores(obs, dims, weights).collect()}
    # x: both of p, turned 80 and 80; 2 of 3 observed; .55 * 45 + .25 * 90 + .2 * 67
    assert (got["x"].score, got["x"].coverage, got["x"].confidence, got["x"].observed) == (80.0, 67.0, 61.0, 2)
    assert (got["y"].score, got["y"].coverage) == (80.0, 50.0)
    grade = lambda c, o, s, p: scoring.reliability(spark.createDataFrame([(70.0, c, o, s, p)], "score double, coverage double, observed int, substantive int, publishers int")).first()
    assert grade(11.0, 30, 5, 5).grade == "insufficient" and grade(12.0, 12, 3, 2).grade == "preliminary" and grade(25.0, 25, 3, 4).label == "High"


def test_territory_weights(spark):
    full = spark.createDataFrame([(100.0,) * 9], ", ".join(f"{k} double" for k in scoring.TERRITORY_WEIGHTS))
    r = scoring.territory(full).first()
    assert (r.total, r.label, r.confidence) == (100, "Very High", 100)


def test_credential_grace(spark):
    rules = spark.createDataFrame([("g", "MO", ["rbt"], ["unknown"], "credential", "REVIEW", 90)], "rule string, state string, roles array<string>, payers array<string>, needs string, posture string, grace_days int")
    rows = [(1, True, None), (2, False, None), (3, None, date(2026, 1, 1)), (4, False, date(2025, 10, 3)), (5, False, date(2025, 10, 1)), (6, None, date(2026, 2, 1))]
    contexts = spark.createDataFrame([(i, "MO", "rbt", None, None, None, c, s) for i, c, s in rows], "context int, state string, role string, payer string, license boolean, supervision boolean, credential boolean, since date")
    got = {r.context: r.decision for r in scoring.regulatory(contexts, rules, F.lit(date(2026, 1, 1))).collect()}
    assert got == {1: "PASS", 2: "REVIEW", 3: "REVIEW", 4: "REVIEW", 5: "BLOCK", 6: "REVIEW"}


def test_tiers(spark):
    rows = [(1, ["mo", "osm"], True, None, ["aba"]), (2, ["mo", "organization-website"], True, False, ["aba"]), (3, ["osm"], False, True, ["aba"]), (4, ["mo"], True, True, [])]
    got = {r.id: (r.confirmed_by, r.tier) for r in sites.tiers(spark.createDataFrame(rows, "id int, sources array<string>, licensed boolean, serves_2_5 boolean, inclusion array<string>")).collect()}
    assert got == {1: (2, "priority"), 2: (1, "confirmed"), 3: (1, "likely"), 4: (1, "confirmed")}


def test_funnel_is_cumulative(spark):
    leads = spark.createDataFrame([("r", s) for s in ("a", "b", "b", "c", "d", "zzz")], "p string, stage string")
    r = workspace.funnel(leads, ["a", "b", "c", "d"], "p", ready="b", active="c", won="d").first()
    assert (r.total, r.ready, r.active, r.won) == (6, 4, 2, 1)


def test_ages_that_conflict(spark):
    rows = [(1, "x", "p1", "ages 5 to 12"), (1, "x", "p2", "ages 13-18"), (2, "x", "p1", "ages 6-11"), (2, "x", "p2", "serving ages 2 to 18"), (3, "x", "p1", "an elementary school"), (4, "x", "p1", "ages 8-14")]
    got = {r.o: (r.status, r.publishers) for r in claims.qualify(spark.createDataFrame(rows, "o int, role string, publisher string, text string"), "o", 6, 11).collect()}
    assert got == {1: ("conflicting", 1), 2: ("documented", 2), 3: ("possible", 0), 4: ("mixed", 0)}


def test_numbers_in_names_must_match(spark):
    rows = spark.createDataFrame([("Oak Hill School District 12", "Oak Hill district 14 news"), ("Oak Hill School District 12", "News of Oak Hill 12"), ("Bright Star Center", "the bright star center opens"), ("Oak", "oak")], "n string, t string")
    assert [r.m for r in rows.select(matching.mentions(F.col("n"), F.col("t")).alias("m")).collect()] == [False, True, True, False]


def test_large_areas_reach_rings(spark):
    site = spark.createDataFrame([(1, 40.0, -100.0)], "site int, lat double, lon double")
    areas = spark.createDataFrame([(40.0, -99.0, 20000.0, 10.0), (40.0, -100.01, 1.0, 5.0), (45.0, -100.0, 20000.0, 10.0)], "lat double, lon double, sqmi double, kids double")
    got = {r.radius: r.kids for r in spatial.ring_sums(site, areas, ["kids"]).collect()}
    assert got[2.0] > 5.0 and got[10.0] > got[2.0]
