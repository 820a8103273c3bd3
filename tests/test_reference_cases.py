"""Fixed cases: what a text, a status, a request or a vote must give, as values."""

import random
import re

import pytest
from pyspark.sql import functions as F

from fieldglass.functions import text as T
from fieldglass.operators import claims, desk, matching
from fieldglass.sources import scans


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


@pytest.mark.parametrize("text,want", [
    ("&amp;lt;b&amp;gt;", "&lt;b&gt;"), ("O&#8217;Neil &#x26; Co", "O’Neil & Co"), ("&bogus; stays", "&bogus; stays"), ("a & b &", "a & b &"), ("&#0; &#1114112; &#x110000;", "&#0; &#1114112; &#x110000;"), ("&#128512;&#X1F600;", "\U0001f600\U0001f600"), ("&NBSP;|&hellip;&apos;", " |…'"), ("", ""), ("&#xD800;", "�"), ("&#00065;", "A"),
])
def test_entities(spark, text, want):
    assert one(spark, T.decoded(F.lit(text))) == want


@pytest.mark.parametrize("text,want", [
    ("Call 1-800-555-0123 or 314 555 0100", []), ("Toll free 1 (800) 273-8255", ["(800) 273-8255"]), ("Main 314-362-5000; fictional 314-555-0100", ["(314) 362-5000"]), ("8165552345", []), ("(911) 234-5678", []), ("(816) 911-2345", []), ("(222) 222-2222", []), ("816.555.2345 and 816-555-2345", ["(816) 555-2345"]), ("0816-555-2345", []), ("x" + " 816-555-2345" + " 913-648-0144", ["(816) 555-2345", "(913) 648-0144"]), (" ".join(f"816-234-{1000 + i}" for i in range(12)), [f"(816) 234-{1000 + i}" for i in range(10)]),
])
def test_phones(spark, text, want):
    assert one(spark, T.phones(F.lit(text))) == want


@pytest.mark.parametrize("text,want", [
    ('<a href="mailto:a.b%2Bkids@school.k12.mo.us">x</a>', ["a.b+kids@school.k12.mo.us"]), ("a@example.com info@yourdomain.com jane.doe@x.org x.y@sentry.io b@2x.co logo.woff2@x.woff", []), ("noreply@z.com", ["noreply@z.com"]), ("Intake&#64;Clinic.org, intake@clinic.org", ["intake@clinic.org"]), ("..a@b.org", ["a@b.org"]), ("logo@2x.png", []), ("mailto: c@d.org mailto:e%40f.org?x", ["c@d.org", "e@f.org"]), ("x" * 65 + "@a.org", []), (" ".join(f"p{i}@a.org" for i in range(12)), [f"p{i}@a.org" for i in range(10)]), ("", []),
])
def test_emails(spark, text, want):
    assert one(spark, T.emails(F.lit(text))) == want


def test_page_text(spark):
    page = "<title>A</title><!-- 314-555-9999 <b> --><svg><text>no</text></svg><SCRIPT>636-555-2222</SCRIPT><p>Fees &lt; $50&nbsp;today</p>  end"
    assert one(spark, T.html_text(F.lit(page))) == "A Fees < $50 today end"


def test_status(spark):
    rows = [(i, 1, s, False, "z", 1.0, 2.0) for i, s in enumerate(["Inactive", "Terminated", "License Revoked", "closed", "Expired", "suspended", "Denied", "Surrendered", "Open", None, "Disclosed"])]
    got = scans.roster(spark.createDataFrame(rows, "id long, version long, status string, home boolean, zip string, lat double, lon double"), "id", spark.createDataFrame([], "zip string, lat double, lon double"))
    assert sorted(r.id for r in got.collect()) == [6, 7, 8, 9, 10]


def test_map_elements(spark):
    tag = lambda i, **t: '{"type":"node","id":%d,"lat":%d,"lon":2,"tags":{%s}}' % (i, i, ",".join(f'"{k.replace("__", ":")}":"{v}"' for k, v in t.items()))
    elements = [
        tag(1, name="Behavioral Therapy Center", amenity="school"), tag(2, name="X", healthcare__speciality="autism", amenity="childcare"), tag(3, name="Kids", amenity="kindergarten"), tag(4, name="Pediatric School", amenity="school"), tag(5, name="Y", healthcare="physiotherapist", amenity="school"), tag(6, name="Z", amenity="school"), tag(7, name="H", amenity="hospital"), tag(8, name="C", amenity="clinic"), tag(9, name=" ", amenity="school"), tag(10, name="D", amenity="school", building="semidetached_house"), tag(95, name="Off", amenity="school"),
        '{"type":"node","id":0,"lat":0,"lon":0,"tags":{"name":"Null Island","amenity":"school"}}', '{"type":"way","id":11,"center":{"lat":3,"lon":4},"tags":{"name":"Way","amenity":"school"}}',
    ]
    good, slow = '{"elements":[%s]}' % ",".join(elements), '{"elements":[%s],"remark":"runtime error: Query timed out"}' % tag(50, name="P", amenity="school")
    df = spark.createDataFrame([(good,), (slow,), ('{"remark":"ok"}',)], "payload string")
    got = {r.id: r.kind for r in scans.map_elements(df).collect()}
    assert got == {"node/1": "aba_provider", "node/2": "aba_provider", "node/3": "daycare", "node/4": "pediatrics", "node/5": "therapy", "node/6": "school", "node/7": "hospital", "way/11": "school"}
    assert [r.f for r in df.select(scans.map_failed().alias("f")).collect()] == [False, True, True]


def test_requests_for_private_addresses_are_refused(spark):
    rows = [("home address of a diagnosed child", None, False), ("personal phone of anyone with autism", None, False), ("residential address, ASD disability", None, False), ("autism clinics in Cass County", None, True), ("addresses of schools", None, True), ("find autsim", "find families with autism", False), ("lives at, autsim", "lives at, autism", False), (None, None, True)]
    df = spark.createDataFrame([(a, b or a, c) for a, b, c in rows], "text string, fixed string, want boolean")
    assert all(r.allowed == r.want for r in desk.moderated(df, "text", "fixed").collect())


# ---- organisations ----

ORGANISATION = [
    ("ADAMS COUNTY SCH DIST 12", "Adams County School District 12 Colorado official website", True), ("ADAMS COUNTY SCH DIST 12", "Adams 12 Five Star Schools", True), ("ADAMS COUNTY SCH DIST 12", "Adams County School District 14", False), ("ADAMS COUNTY SCH DIST 12", "Boulder Valley School District", False), ("Bright Steps ABA", "Blue Bell ABA", False), ("Springfield Kid", "visit springfield kids club", True), ("Kid & Co", "the skid and company", True), ("Oak", "oak tree", False),
]


def plain_mentions(name, text):
    def words(x):
        return [matching.SHORT.get(w, w) for w in re.sub(r"[^a-z0-9 ]+", " ", x.lower().replace("&", " and ")).split()]

    own, body = words(name), words(text)
    if len(own) < 2 or len(body) < 2:
        return False
    if " ".join(own) in " ".join(body):
        return True
    telling = list(dict.fromkeys(w for w in own if w not in matching.GENERIC and len(w) >= 2))
    if len(telling) < 2 or any(w.isdigit() and w not in body for w in telling):
        return False
    shared = [w for w in telling if w in body]
    return len(shared) >= 2 and len(shared) / len(telling) >= 0.6


def test_mentions(spark):
    for name, text, want in ORGANISATION:
        assert plain_mentions(name, text) == want
    orgs = sorted({n for n, _, _ in ORGANISATION})
    texts = sorted({t for _, t, _ in ORGANISATION})
    assert_mentions(spark, orgs, texts)


def assert_mentions(spark, orgs, texts):
    got = matching.mentioned(spark.createDataFrame([(str(i), n) for i, n in enumerate(orgs)], "org string, name string"), spark.createDataFrame(list(enumerate(texts)), "doc long, text string"))
    assert sorted((r.org, r.doc) for r in got.collect()) == sorted((str(i), j) for i, n in enumerate(orgs) for j, t in enumerate(texts) if plain_mentions(n, t))


def test_random_names_lose_nothing(spark):
    rng = random.Random(2)
    words = ["oak", "oaks", "co", "school", "sch", "dist", "12", "14", "the", "kid", "kids", "a", "&", "valley", "springfield", "aba", "st."]
    make = lambda n: " ".join(rng.choice(words) for _ in range(rng.randint(1, n)))
    assert_mentions(spark, [make(5) for _ in range(60)], [rng.choice(["", "x"]) + make(9) for _ in range(80)])


def test_enrichment_lowers_what_is_above_its_caps(spark):
    leads = spark.createDataFrame([("a", 80, 80, ["x@a.org"]), ("b", 50, 50, []), ("c", 80, 80, [])], "org string, score int, confidence int, emails array<string>")
    sites = spark.createDataFrame([("a", "a.org", "a.org", True, ["y@a.org"]), ("b", "b.org", "b.org", True, []), ("c", "c.org", "d.org", True, [])], "org string, hit_host string, page_host string, about boolean, emails array<string>")
    got = {r.org: (r.score, r.confidence, r.verified) for r in matching.enriched(leads, sites).collect()}
    assert got == {"a": (65, 74, True), "b": (59, 65, True), "c": (80, 80, False)}


def test_locations_equal_all_pairs(spark):
    rng = random.Random(3)
    cities, counties = ["oak", "oakland", "new oak", "st. oak", "ab", "lee"], ["lee", "oakland", "oak hills", ""]
    rows = [(i, f"n{rng.randint(0, 9)}", f"{rng.randint(0, 6)}", rng.choice(counties), rng.choice(cities)) for i in range(150)]
    targets = [(i, rng.choice([*cities, "oakland county nj", "zzz lee"]), rng.choice([None, f"{rng.randint(0, 6)}"]), rng.choice([None, *counties[:3]]), rng.choice([None, "", *cities, "oak h"])) for i in range(80)]

    def score(t, r):
        s = 100 * bool(t[2] and t[2] == r[2]) + 90 * bool(t[3] and t[3] == r[3]) + 85 * bool(t[4] and t[4] == r[4])
        return s + 55 * bool(t[4] and t[4] in r[4]) + 45 * bool(t[4] and t[4] in r[3]) + 35 * (len(r[4]) >= 3 and r[4] in t[1])

    want = set()
    for t in targets:
        best = sorted((-score(t, r), r[1], r[0]) for r in rows if score(t, r) > 0)[:3]
        want |= {(t[0], i, -s, k + 1) for k, (s, _, i) in enumerate(best)}
    got = matching.located(spark.createDataFrame(targets, "target long, text string, zip string, county string, locality string"), spark.createDataFrame(rows, "id long, name string, zip string, county string, city string"))
    assert {(r.target, r.id, r.score, r.place) for r in got.collect()} == want


def test_duplicates_equal_all_pairs(spark):
    """Groups hold every pair that shares a field, at its score."""
    rng = random.Random(4)
    rows = [(i, rng.choice(["The Oak, LLC", "oak", "Elm Inc.", "the", "", None]), rng.choice(["http://www.A.org/x", "https://a.org", "b.org", "http://b.org:80", "", None]), rng.choice(["(816) 555-1", "8165551", "2", "", None])) for i in range(60)]
    name = lambda x: re.sub(r"[^a-z0-9]+", " ", re.sub(r"\b(llc|inc|corp|corporation|pllc|pc|the)\b", "", x.lower())).strip()
    site = lambda x: (re.match(r"[a-z]+://(?:www\.)?([^/:]+)", x.lower()) or [None, ""])[1]
    digits = lambda x: re.sub(r"\D", "", x)
    want = {}
    for a in rows:
        for b in rows:
            n = sum(bool(x and y and f(x) == f(y)) for x, y, f in zip(a[1:], b[1:], (name, site, digits)))
            if a[0] < b[0] and n:
                want[a[0], b[0]] = n
    groups = {}
    for r in matching.duplicates(spark.createDataFrame(rows, "id long, name string, url string, phone string")).collect():
        groups.setdefault((tuple(r.fields), r.representative), []).append(r.id)
    got = {}
    for (fields, first), ids in groups.items():
        assert min(ids) == first and len(ids) > 1
        for a in ids:
            for b in ids:
                if a < b:
                    got[a, b] = max(got.get((a, b), 0), len(fields))
    assert got == want


# ---- votes and themes ----

EVIDENCE = "entity string, at long, publisher string, kind string, text string"


def votes(spark, rows):
    df = spark.createDataFrame([(e, k, *r) for k, (e, *r) in enumerate(rows)], EVIDENCE)
    v = claims.claim_votes(df, "entity")
    return {(r.entity, r.claim): (r.publishers, r.authority, r.supported) for r in v.collect()}, {r.entity: r.posture for r in claims.evidence_graph(df, v, "entity").collect()}


def test_votes(spark):
    same = "Official facility licensed child care is confirmed in this public report"
    rows = [
        ("rumors", "unknown.net", "other", "Licensed child care facility present on directory"), ("rumors", "randomsource.org", "other", "Public reports separately say licensed child care facility exists"),
        ("real", "licensing.gov", "government", "State license report describes licensed child care facility"), ("real", "clinic.example", "first_party", "Organization directory confirms licensed preschool facility in the service region"),
        ("reposted", "agency.gov", "government", same), ("reposted", "press.org", "press", same + " Read more"),
        ("torn", "clinic.example", "first_party", "Now accepting new patients at the service clinic"), ("torn", "localnews.org", "press", "Not accepting new patients at the service clinic"),
        ("mixed", "a.org", "press", "now hiring one"), ("mixed", "a.org", "first_party", "we are hiring two"), ("mixed", "b.org", "press", "apply now three"),
        ("crowd", "reddit.com", "community", "now hiring"), ("late", "a.org", "press", "now hiring x"), ("late", "b.org", "press", "now hiring x"), ("late", "b.org", "press", "we are hiring y"),
    ]
    got, posture = votes(spark, rows)
    assert got["rumors", "institution_exists"] == (2, False, False)
    assert got["real", "institution_exists"] == (2, True, True) and posture["real"] == "corroborated"
    assert got["reposted", "institution_exists"] == (1, True, False) and posture["reposted"] == "single_source"
    assert posture["torn"] == "conflicting" and not got["torn", "service_available"][2] and ("torn", "service_unavailable") in got
    assert got["mixed", "hiring"] == (2, True, True)
    assert ("crowd", "hiring") not in got and posture["crowd"] == "single_source"
    assert got["late", "hiring"] == (2, False, False)


def test_votes_equal_a_pass(spark):
    """Random entries: near copies of a few stories by a few publishers."""
    rng = random.Random(6)
    bases = [[f"w{b}x{k}" for k in range(50)] for b in range(4)]
    rows = []
    for k in range(160):
        words = [("n" + w if rng.random() < 0.03 else w) for w in rng.choice(bases)]
        rows.append((rng.choice("ef"), f"p{rng.randint(0, 7)}", rng.choice(["government", "press", "community"]), "now hiring " + " ".join(words)))

    def same(x, y):
        a, b = set(x.split()), set(y.split())
        return len(a & b) / len(a | b) >= 0.91

    want = {}
    for e in "ef":
        publishers = {}
        for _, p, kind, text in (r for r in rows if r[0] == e):
            entry = publishers.setdefault(p, [kind, []])
            entry[1].append(text)
            if kind == "government":
                entry[0] = kind
        told, voted, authority = [], set(), False
        for p, (kind, texts) in publishers.items():
            for text in texts if kind != "community" else ():
                if p not in voted and not any(same(t, text) for t in told):
                    told.append(text)
                    voted.add(p)
                    authority |= kind == "government"
        want[e] = (len(voted), authority)
    got, _ = votes(spark, rows)
    assert {e: got[e, "hiring"][:2] for e in "ef"} == want


def test_themes(spark):
    name, domain = "Clearview ABA Therapy", "clearview.org"
    hits = [
        ("a", "news.com", "Clearview ABA Therapy report", "clinic staffing shortage in Denver"), ("a", "daily.net", "Clearview ABA Therapy", "a clinic with staff turnover all year"), ("a", "www.yelp.com", "Clearview ABA Therapy", "clinic staff turnover"), ("a", "m.clearview.org", "Clearview ABA Therapy", "clinic understaffed"), ("a", "blog.net", "Clearview ABA Therapy", "My child was diagnosed; staff turnover at the clinic"), ("a", "other.org", "Another place", "clinic staff turnover"),
        ("b", "one.com", "Clearview ABA Therapy clinic staffing shortage", "A public clinic staffing shortage was identified in Denver"), ("b", "two.net", "Clearview ABA Therapy clinic staffing shortage", "A public clinic staffing shortage was identified in Denver"), ("b", "two.net", "Clearview ABA Therapy", "praised for its kind staff at the clinic"),
    ]
    df = spark.createDataFrame([(o, name, domain, k, h, ".".join(h.split(".")[-2:]), t, s) for k, (o, h, t, s) in enumerate(hits)], "org string, name string, domain string, at long, host string, publisher string, title string, snippet string")
    got = {(r.org, r.theme): (r.publishers, r.sentiment, r.corroborated) for r in claims.review_themes(df, "org").collect()}
    assert got == {("a", "staffing"): (2, "concern", True), ("b", "staffing"): (1, "concern", False), ("b", "positive_feedback"): (1, "positive", False)}


def test_a_child_that_was_welcome_documents_no_ages(spark):
    rows = [("a", "school_program", "x.org", "x.org", "My child was welcome, ages 6 to 11"), ("b", "school_program", "x.org", "x.org", "ages 6 to 11"), ("c", "school_program", "m.facebook.com", "facebook.com", "ages 6 to 11"), ("b", "school_program", "x.org", "x.org", "x" * 2000 + " ages 30 to 40")]
    got = {r.org: r.status for r in claims.qualify(spark.createDataFrame(rows, "org string, role string, host string, publisher string, text string"), "org", 6, 11).collect()}
    assert got == {"b": "documented"}
