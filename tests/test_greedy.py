"""First-match merging against a plain pass in order."""

import math
import random
import re

from fieldglass.operators import evidence, greedy, matching, spatial


def passed(edges):
    """Which records a pass in order would merge, and into which."""
    before = {}
    for a, b in edges:
        before.setdefault(b, set()).add(a)
    into = {}
    for x in sorted({x for e in edges for x in e}):
        hit = [a for a in sorted(before.get(x, ())) if a not in into]
        if hit:
            into[x] = hit[0]
    return into


def frame(spark, edges):
    return spark.createDataFrame(edges, "a long, b long")


def test_random_graphs(spark):
    rng = random.Random(1)
    for n, m in ((30, 20), (60, 120), (40, 400)):
        edges = sorted({tuple(sorted(rng.sample(range(n), 2))) for _ in range(m)})
        got = {r.b: r.a for r in greedy.first_match(frame(spark, edges)).collect()}
        assert got == passed(edges)


def test_chains_take_few_rounds(spark):
    """In a chain every second record is merged; rounds don't grow with its length."""
    edges = [(i, i + 1) for i in range(300)] + [(1000 + i, 1002 + i) for i in range(0, 40, 2)] + [(1001, 1002)]
    gone, rounds = greedy.merged(frame(spark, edges))
    assert {r.node for r in gone.collect()} == set(passed(edges)) and rounds <= greedy.PLAIN_ROUNDS + 2


def test_no_edges(spark):
    assert greedy.first_match(frame(spark, [])).collect() == []


def miles(a, b, c, d):
    a, b, c, d = map(math.radians, (a, b, c, d))
    h = math.sin((c - a) / 2) ** 2 + math.cos(a) * math.cos(c) * math.sin((d - b) / 2) ** 2
    return 2 * 3958.8 * math.asin(min(1, math.sqrt(h)))


def merge(rows):
    """A pass in order over places: id, kind, name, lat, lon, approximate, licensed, website."""
    words = lambda n: {t for t in re.sub(r"[^a-z0-9 ]", " ", n.lower()).split() if len(t) > 2 and t not in matching.PLACE_WORDS}
    kept = []
    for i, kind, name, lat, lon, rough, licensed, site in sorted(rows, key=lambda r: (not r[6], bool(r[5]), r[0])):
        for m in kept:
            a, b = words(m["name"]), words(name)
            alike = m["name"].lower() == name.lower() if not a or not b else len(a & b) / min(len(a), len(b)) >= 0.5
            if m["kind"] == kind and miles(m["lat"], m["lon"], lat, lon) <= (1.5 if m["rough"] or rough else 0.25) and alike:
                m["website"] = m["website"] or site
                m["records"] += 1
                if m["rough"] and not rough:
                    m.update(lat=lat, lon=lon, rough=False)
                break
        else:
            kept.append({"id": i, "kind": kind, "name": name, "lat": lat, "lon": lon, "rough": bool(rough), "website": site, "records": 1})
    return sorted((m["id"], m["name"], round(m["lat"], 6), round(m["lon"], 6), m["rough"], m["website"], m["records"]) for m in kept)


def consolidated(spark, rows):
    df = spark.createDataFrame([(*r, ["s"], None, None) for r in rows], "id long, kind string, name string, lat double, lon double, approximate boolean, licensed boolean, website string, sources array<string>, phone string, capacity long")
    return sorted((r.id, r.name, round(r.lat, 6), round(r.lon, 6), r.approximate, r.website, r.records) for r in matching.consolidate(df).collect())


def test_places_equal_a_pass(spark):
    """Crowded places of all kinds, some of which move to the exact point of one that joins them."""
    for seed, spread, center in ((1, 0.03, (39.0, -94.5)), (2, 0.06, (71.2, 179.99)), (3, 0.012, (-0.01, -179.995))):
        rng = random.Random(seed)
        names = ["Bright Star Learning Center", "Star Academy", "The School", "Little Oak", "Oak Bright Daycare", "the school"]
        rows = []
        for i in rng.sample(range(1000), 120):
            lon = center[1] + rng.uniform(-spread, spread) / math.cos(math.radians(center[0]))
            rows.append((i, rng.choice("xy"), rng.choice(names), center[0] + rng.uniform(-spread, spread), (lon + 180) % 360 - 180, rng.random() < 0.5, rng.choice([True, False, None]), rng.choice([None, f"w{i}"])))
        want = merge(rows)
        assert consolidated(spark, rows) == want and len(want) < 100


def test_a_chain_of_one_name_is_not_glued(spark):
    rows = [(i, "x", "Oak", 40.0 + 0.003 * i, -90.0, False, False, None) for i in range(9)]
    got = consolidated(spark, rows)
    assert [r[0] for r in got] == [0, 2, 4, 6, 8] and got == merge(rows)


def test_independent_in_order(spark):
    base = [f"word{k}" for k in range(60)]
    text = lambda changed: " ".join("new" + w if k in changed else w for k, w in enumerate(base))
    # 1 and 2 alike, 2 and 3 alike, 1 and 3 not: 2 goes, 3 stays though it is like 2.
    rows = [("r", "p9", 1, text(())), ("r", "p8", 2, text((0,))), ("r", "p7", 3, text((0, 1, 2))), ("r", "p6", 4, text((0,)).upper()), ("r", "p9", 5, "own"), ("r", "p5", 6, ""), ("r", "p4", 7, ""), ("q", "p8", 2, text((0,))), ("q", "p7", 3, text((0, 1, 2)))]
    got = evidence.independent(spark.createDataFrame(rows, "rule string, publisher string, doc_id long, text string"), ["rule"], "text")
    assert sorted((r.rule, r.doc_id) for r in got.collect()) == [("q", 2), ("r", 1), ("r", 3), ("r", 6), ("r", 7)]


def test_within_equals_all_pairs(spark):
    """A dense city, many points at one spot, the poles and both sides of 180 degrees."""
    rng = random.Random(4)
    points = [(i, 40 + rng.gauss(0, 0.02), -90 + rng.gauss(0, 0.02)) for i in range(1500)] + [(2000 + i, 40.0, -90.0) for i in range(300)]
    points += [(3000 + i, rng.uniform(-90, 90), rng.uniform(-180, 180)) for i in range(300)] + [(4000 + i, rng.uniform(-0.2, 0.2), rng.choice([-180.0, 180.0, 179.95, -179.9])) for i in range(60)] + [(5000 + i, rng.choice([89.99, -89.95, 90.0]), rng.uniform(-180, 180)) for i in range(30)] + [(6000, None, 1.0)]
    sites = [(0, 40.0, -90.0), (1, 40.05, -90.03), (2, 0.0, 180.0), (3, 0.1, -179.99), (4, 89.97, 10.0), (5, -90.0, 0.0), (6, 12.0, 34.0)]
    df = spark.createDataFrame(points, "id long, lat double, lon double")
    for reach in (0.5, 10.0, 400.0):
        got = sorted((r.site, r.id) for r in spatial.within(spark.createDataFrame(sites, "site long, lat double, lon double"), df, reach, most=64).collect())
        assert got == sorted((s, i) for s, a, b in sites for i, c, d in points if c is not None and miles(a, b, c, d) <= reach)


def test_places_a_whole_turn_apart_are_others(spark):
    """Beyond 180 degrees longitudes are numbers, as in the queries' SQL; within, cells go round."""
    rows = [(1, "clinic", "Oak", 40.0, 10.0, False), (2, "clinic", "Oak", 40.0, 370.0, False), (3, "clinic", "Oak", 40.0, 370.001, True), (4, "clinic", "Oak", 0.0, 179.9995, False), (5, "clinic", "Oak", 0.0, -179.9995, False), (6, "clinic", "Oak", 0.0, 180.0, False), (7, "clinic", "Oak", 40.0, 730.0, True)]
    places = spark.createDataFrame(rows, "id long, kind string, name string, lat double, lon double, approximate boolean")
    assert sorted(map(tuple, matching.same_places(places).collect())) == [(2, 3), (4, 5), (4, 6), (5, 6)]


def test_places_meet_in_one_shuffle(spark):
    """All near pairs at poles, at 180 degrees and beyond, of exact and approximate points, from a table that is shuffled once."""
    rng = random.Random(9)
    names = {"Bright Star": {"bright", "star"}, "Little Oak Star": {"little", "oak", "star"}, "Oak": {"oak"}, "The School": {"=the school"}}
    rows = []
    for i in rng.sample(range(1000), 400):
        lat, lon = rng.choice([(40.0, -94.5), (0.0, 180.0), (0.0, -180.0), (71.2, 179.99), (89.99, 20.0), (-89.99, -160.0), (10.0, 400.0), (0.0, 180.04)])
        lon += rng.uniform(-0.02, 0.02)
        rows.append((i, rng.choice("xy"), rng.choice(list(names)), max(-90.0, min(90.0, lat + rng.uniform(-0.02, 0.02))), lon, rng.choice([True, False, False, None])))
    want = set()
    for a in rows:
        for b in rows:
            u, v = names[a[2]], names[b[2]]
            one_turn = (abs(a[4]) <= 180 and abs(b[4]) <= 180) or abs(a[4] - b[4]) <= 180
            if a[0] < b[0] and a[1] == b[1] and one_turn and miles(*a[3:5], *b[3:5]) <= (1.5 if a[5] or b[5] else 0.25) and len(u & v) >= 0.5 * min(len(u), len(v)):
                want.add((a[0], b[0]))
    df = matching.same_places(spark.createDataFrame(rows, "id long, kind string, name string, lat double, lon double, approximate boolean"))
    got = sorted(map(tuple, df.collect()))
    assert len(want) > 300 and got == sorted(want)
    plan = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert plan.count("ReusedExchange") == 1 and plan.count("Exchange hashpartitioning") == 2 and "Broadcast" not in plan  # the second is the one that is reused


def test_narratives_are_compared_whole(spark):
    """Texts that part after 1,500 characters, and texts that differ in few of all their words."""
    words = [f"word{k}" for k in range(600)]
    docs = spark.createDataFrame([(1, " ".join(words[:300])), (2, " ".join(words[:200] + words[400:])), (3, " ".join(words[:295])), (4, " ".join(words[:300]))], "doc_id long, text string")
    assert sorted(map(tuple, evidence.same_narrative_pairs(docs, "doc_id", "text").collect())) == [(1, 3), (1, 4)]


def test_alike_sets_meet_by_parts_in_every_band(spark):
    """Sets of 9 to 70 words with some swapped, left out or added, in texts of another order, against all pairs."""
    rng, texts = random.Random(5), []
    for k in range(60):
        base = rng.sample([f"w{i:03d}" for i in range(300)], rng.randint(9, 70))
        for _ in range(4):
            own = [w for w in base if rng.random() > 0.03] + [f"x{rng.randint(0, 99):02d}" for _ in range(rng.randint(0, 2))]
            texts.append(" ".join(rng.sample(own, len(own))))
    sets = [set(t.split()) for t in texts]
    alike = lambda x, y: x == y or (min(len(x), len(y)) >= 9 and len(x & y) >= 0.91 * len(x | y))
    want = {(a, b) for a in range(len(texts)) for b in range(a + 1, len(texts)) if min(len(sets[a]), len(sets[b])) >= 9 and alike(sets[a], sets[b])}
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = evidence.same_narratives(docs, "doc_id", "text")[1].collect()
    assert len(got) == len(want) > 60 and {tuple(r) for r in got} == want


def test_parts_outnumber_what_alike_sets_differ_in():
    bands = evidence._bands(0.91, 9, 3000)
    for k, (low, high, parts) in enumerate(bands):
        for a in range(low, high + 1):
            for b in range(a, int(a / 0.91 + 1e-9) + 1):
                assert b <= bands[min(k + 1, len(bands) - 1)][1] or k + 1 == len(bands)
                assert (a + b) - 2 * math.ceil(0.91 / 1.91 * (a + b) - 1e-9) < parts


def test_rows_of_one_text_share_its_story(spark):
    """A text that many rows tell is compared once: stories come from distinct texts, a row without words has none."""
    rows = spark.createDataFrame([(1, "Long wait!"), (2, "long  WAIT"), (3, "..."), (4, None), (5, "other"), (2, "long  WAIT")], "at long, text string")
    held, near = evidence.stories(rows, "at", "text")
    assert sorted((r["at"], r.story) for r in held.collect()) == [(1, 1), (2, 1), (2, 1), (3, None), (4, None), (5, 5)] and near.isEmpty()
    votes = spark.createDataFrame([("k", "p", 1, 5), ("k", "p", 1, 6), ("k", "q", 1, 7), ("k", "q", 2, 8), ("k", "q", 2, 9)], "key string, publisher string, story long, at long")
    assert sorted(r["at"] for r in evidence.first_votes(votes, near, ["key"], "publisher", "at").collect()) == [5, 8]
