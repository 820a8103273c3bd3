"""Survey metrics, policies and leads on rows with nulls, blanks and fixed results."""

from pyspark.sql import functions as F

from fieldglass.operators import leads as L
from fieldglass.operators import survey as S


def survey_row(spark, **changed):
    values = dict.fromkeys(S.VARIABLES, 100) | {"B01003_001E": 9000, "B09001_001E": 1000, "B27010_002E": 1000, "B11005_001E": 900} | changed
    return S.checked(S.derived(spark.createDataFrame([tuple(values.values())], ", ".join(f"{v} long" for v in values)), [])).first()


def test_survey_sums_and_rules(spark):
    assert (len(S.METRICS), len(S.PARTS), len(S.UNIVERSES)) == (34, 17, 5)
    fine = survey_row(spark, B18101_006E=200, B18101_025E=250, B18104_003E=200, B18104_019E=210, B23008_002E=300, B17020_011E=300, B17020_012E=200)
    assert (fine.kids_6to17, fine.kids_pov_universe, fine.lep_hh, fine.issues) == (400, 900, None, ["lep_hh > lep_universe"])
    # what a rule takes tests nothing later: without `kids` neither its parts nor two of the tables are compared
    bad = survey_row(spark, B09001_001E=9001, B09001_003E=9999)
    assert bad.issues[0] == "kids > pop" and not any("kids_u6 > kids" in i for i in bad.issues)
    assert (bad.kids, bad.pop, bad.u19) == (None, None, 1000)
    off = survey_row(spark, B27010_002E=1301)
    assert (off.u19, off.u19_medicaid) == (None, None) and "u19 out of proportion to kids" in off.issues


def test_missing_variables_make_no_sum(spark):
    row = survey_row(spark, B09001_004E=-666666666, B19013_001E=None)
    assert (row.kids_3to5, row.kids_u6, row.mhi, row.kids_u3) == (None, None, None, 100)


def test_programs_of_rows_without_metrics(spark):
    rows = spark.createDataFrame([(1, None), (2, {}), (3, {"cbp.hospitals": None, "acs.kids": 1.0})], "i int, metrics map<string,double>")
    out = {r.i: (r.programs, r.missing) for r in S.missing_programs(rows, ["i"], {"x": ["acs.kids", "cbp.hospitals", "cbp.daycare"]}).collect()}
    both = ["census-acs5", "census-cbp"]
    assert out == {1: (both, both), 2: (both, both), 3: (both, ["census-cbp"])}


def test_written_values(spark):
    rows = [(0.12, "6 wks"), (0.001, "1 wks"), (2.0, "2 yrs"), (2.5, "2.5 yrs"), (None, None)]
    assert [r.got for r in spark.createDataFrame(rows, "x double, want string").orderBy(F.monotonically_increasing_id()).select(S.age_text("x").alias("got")).collect()] == [w for _, w in rows]
    rows = [(None, "—"), (0.456, "0.46"), (-12.34, "-12.3"), (99.96, "100.0"), (1234567.5, "1,234,568")]
    assert [r.got for r in spark.createDataFrame(rows, "x double, want string").select(S.value_text("x").alias("got")).collect()] == [w for _, w in rows]
    rows = [("Kansas City, MO", "Kansas City"), ("Kansas", "Kansas"), ("Clay County Missouri.", "Clay County"), (None, None), ("  ", "")]
    assert [r.got for r in spark.createDataFrame(rows, "x string, want string").select(S.without_state("x").alias("got")).collect()] == [w for _, w in rows]


def test_policy_of_odd_addresses(spark):
    rows = [("https://maps.google.com/x", "restricted_review"), ("https://www.google.com/mapsy", "restricted_review"), ("https://google.com/", None), ("https://m.x.com/a", "community"), ("https://xx.com", None), ("", None), (None, None), ("https://a.agg.example", "aggregate_only")]
    df = spark.createDataFrame(rows, "u string, want string")
    assert [r.got for r in df.select(L.policy("u", ["agg.example"]).alias("got")).collect()] == [w for _, w in rows]
    assert df.where(L.policy("u", []) == "aggregate_only").count() == 0


def test_enrichment_keeps_every_hit(spark):
    pages = spark.createDataFrame([("https://a.example/1", None), ("https://a.example/2", "p"), ("https://www.a.example/3", "q"), (None, "z")], "url string, phone string")
    hits = spark.createDataFrame([(1, "https://a.example", None), (2, "https://a.example", "own"), (3, None, None), (4, "https://b.example", None)], "i int, url string, phone string")
    assert {r.i: r.phone for r in L.enrich(hits, pages, "url", "phone").collect()} == {1: "p", 2: "own", 3: None, 4: None}


def test_context_leaves_the_row_itself_out(spark):
    rows = [(1, "x", "Demand Signal"), (2, "x", "Demand Signal"), (3, "x", "Competitor / Market Signal"), (4, "x", None), (5, None, "Demand Signal"), (6, None, "Demand Signal")]
    out = {r.i: (r.demand_near, r.market_near, r.strength) for r in L.near_context(spark.createDataFrame(rows, "i int, place string, kind string"), "place", "kind").collect()}
    assert out == {1: (1, 1, 5), 2: (1, 1, 5), 3: (2, 0, 6), 4: (2, 1, 8), 5: (0, 0, 0), 6: (0, 0, 0)}


def test_context_matches_brute_force(spark):
    kinds = ["Demand Signal", "Competitor / Market Signal", "Referral Source", None]
    rows = [(i, ["a", "b", None, "c"][i * 7 % 4 if i % 3 else 0], kinds[i * 5 % 4]) for i in range(60)]
    want = {}
    for i, place, _ in rows:
        near = [k for j, p, k in rows if j != i and place is not None and p == place]
        want[i] = min(10, 3 * near.count(kinds[0]) + 2 * near.count(kinds[1]))
    got = L.near_context(spark.createDataFrame(rows, "i int, place string, kind string"), "place", "kind")
    assert {r.i: r.strength for r in got.collect()} == want


def test_faults_of_leads(spark):
    rows = [("candidate", "talent", None, None), ("candidate", "referral", None, "pipeline_mismatch"), ("referral", None, None, "pipeline_mismatch"), ("household", "referral", None, "kind_not_eligible"), (None, "referral", None, "kind_not_eligible"), ("referral", "referral", "candidate", "kind_changed")]
    df = spark.createDataFrame(rows, "k string, p string, s string, want string")
    assert [r.got for r in df.select(L.kind_faults("k", "p", "s").alias("got")).collect()] == [r[3] for r in rows]


def test_same_fields_need_both(spark):
    field = "struct<name:string,url:string,phone:string>"
    rows = [((" The Sun, Inc.", "https://www.sun.example/a", None), ("sun", "http://SUN.example", "1"), ["organization_name", "website_domain"]), ((None, "", ""), (None, "", ""), []), (("a", None, "(816) 555-2345"), ("b", None, "816.555.2345"), ["phone"])]
    df = spark.createDataFrame(rows, f"a {field}, b {field}, want array<string>")
    assert [r.got for r in df.select(L.duplicate_fields("a", "b").alias("got")).collect()] == [r[2] for r in rows]


def test_texts_of_unknown_kinds(spark):
    df = spark.createDataFrame([(None, None, None), ("School", "Competitor / Market Signal", ["x", "y", "z"])], "s string, k string, g array<string>")
    out = df.select(L.contact_roles("s", "k").alias("roles"), L.short_reason("k", "g").alias("reason")).collect()
    assert out[0].roles == L.OTHER_ROLES and out[0].reason == L.NO_REASON
    assert out[1].roles == [] and out[1].reason.endswith("market signal: x, y.")


def test_breakdowns_that_are_no_json(spark):
    df = spark.createDataFrame([("{",), (None,), ('{"score":1,"label":null}',)], "t string")
    got = [r.b for r in df.select(L.unpacked("t", "score long, label string").alias("b")).collect()]
    assert got[1] is None and (got[0] is None or got[0].score is None) and got[2].score == 1
