"""Queries that scan payloads, which Spark derives from the test tables in the form that a source would send."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldglass.functions.store import scratch
from fieldglass.functions.text import clean_url
from fieldglass.operators import frames
from fieldglass.plans.adapters import table
from fieldglass.plans.registry import query
from fieldglass.sources import scans as S

#: Rows that one payload holds.
PAGE = 200


def page_of(key: str):
    return F.floor(F.col(key) / PAGE).cast("long")


def _coded(spark: SparkSession, d: str) -> DataFrame:
    """Customers as rows of coded statistics, some with sentinels, some payloads an error page."""
    c = table(spark, d, "customer")
    row = F.array(F.col("c_custkey").cast("string"), F.col("c_name"), F.when(F.col("c_custkey") % 10 == 0, "-666666666").otherwise((F.col("c_custkey") % 97).cast("string")))
    head = F.array(F.lit("id"), F.lit("NAME"), F.lit("B01001_001E"))
    json = F.to_json(F.concat(F.array(head), F.collect_list(row)))
    return c.groupBy(page_of("c_custkey").alias("page")).agg(F.when(F.col("page") % 5 == 4, "<html>error</html>").otherwise(json).alias("payload"))


@query("SELECT c_custkey // 200 AS page, CAST(c_custkey AS VARCHAR) AS id, c_name AS name, CASE WHEN c_custkey % 10 <> 0 THEN CAST(c_custkey % 97 AS DOUBLE) END AS people FROM customer WHERE (c_custkey // 200) % 5 <> 4")
def header_row_tables(spark: SparkSession, d: str) -> DataFrame:
    rows, _ = S.header_rows(_coded(spark, d), ["id", "NAME", "B01001_001E"])
    return rows.select("page", "id", F.col("NAME").alias("name"), S.number(F.col("B01001_001E")).alias("people"))


@query("SELECT c_custkey // 200 AS page, '<html>error</html>' AS payload FROM customer WHERE (c_custkey // 200) % 5 = 4 GROUP BY 1")
def rejected_payloads(spark: SparkSession, d: str) -> DataFrame:
    return S.header_rows(_coded(spark, d), ["id"])[1].select("page", "payload")


@query("SELECT '05000US' || CAST(s_suppkey AS VARCHAR) AS geography, v AS variable, CASE WHEN s_suppkey % 10 + k >= 1 THEN CAST(s_suppkey % 10 + k AS DOUBLE) END AS value FROM supplier, (VALUES ('B09001_001E', 0), ('B17020_002E', 1)) t(v, k) WHERE s_suppkey % 10 + k >= 1 UNION ALL SELECT '05000US' || CAST(s_suppkey AS VARCHAR), 'B09001_001E', NULL FROM supplier WHERE s_suppkey % 10 = 0")
def nested_estimates(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("s_suppkey")
    first = F.when(k % 10 == 0, F.lit(-1.0)).otherwise((k % 10).cast("double"))
    one = lambda name, value: F.create_map(F.lit("estimate"), F.create_map(F.lit(name), value), F.lit("error"), F.create_map(F.lit(name), F.lit(9.0)))
    tables = F.create_map(F.lit("B09001"), one("B09001001", first), F.lit("B17020"), one("B17020002", (k % 10 + 1).cast("double")))
    return S.nested_estimates(table(spark, d, "supplier").select(F.to_json(F.create_map(F.concat(F.lit("05000US"), k), tables)).alias("payload")))


@query("SELECT CAST(doc_id AS VARCHAR) AS id, md5(coalesce(text, '')) AS body FROM documents")
def quoted_csv(spark: SparkSession, d: str) -> DataFrame:
    """Whole texts, with their quotes, line feeds and carriage returns, through CSV files; columns are found by their headers."""
    path = scratch(spark)
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("Document ID"), F.col("text").alias("Body Text"), "lang")
    docs.write.csv(path, header=True, quote='"', escape='"', quoteAll=True, ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)
    rows = S.resolve_columns(S.csv_files(spark, path), {"id": r"^document", "text": r"body"})
    return rows.select("id", F.md5(F.coalesce("text", F.lit("")).cast("binary")).alias("body"))


@query("SELECT CAST(s_suppkey AS VARCHAR) AS geoid, s_name AS name, round(s_suppkey * 1000000.0E0 / 2589988.110336E0, 6) AS sqmi, CASE WHEN s_suppkey % 9 <> 0 THEN 1 ELSE 0 END AS rings, CASE WHEN s_suppkey % 9 <> 0 THEN s_suppkey * 0.01E0 END AS min_lon, CASE WHEN s_suppkey % 9 <> 0 THEN s_suppkey * 0.01E0 + 1 END AS max_lat FROM supplier")
def boundary_features(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("s_suppkey")
    x = k * F.lit(0.01)
    point = lambda a, b: F.array(x + a, x + b)
    square = F.array(point(0, 0), point(1, 0), point(1, 1), point(0, 1), point(0, 0))
    rings = F.array(F.when(k % 9 == 0, F.slice(square, 1, 3)).otherwise(square), F.slice(square, 1, 2))
    a = F.struct(k.cast("string").alias("GEOID"), F.col("s_name").alias("NAME"), (k * 1000000).cast("string").alias("AREALAND"), x.cast("string").alias("CENTLAT"), F.lit("n/a").alias("CENTLON"))
    feature = F.struct(a.alias("attributes"), F.struct(rings.alias("rings")).alias("geometry"))
    got = S.features(table(spark, d, "supplier").groupBy(page_of("s_suppkey")).agg(F.to_json(F.struct(F.collect_list(feature).alias("features"))).alias("payload")))
    return got.select("geoid", "name", F.round("sqmi", 6).alias("sqmi"), F.size("rings").alias("rings"), "min_lon", "max_lat")


@query("SELECT CAST(s_suppkey AS VARCHAR) AS npi, CASE WHEN s_suppkey % 2 = 0 THEN 'NPI-2' ELSE 'NPI-1' END AS kind, 'T' || CAST(s_suppkey % 5 AS VARCHAR) AS taxonomy, CASE WHEN s_suppkey % 4 = 0 THEN '64' ELSE '65' END || lpad(CAST(s_suppkey % 1000 AS VARCHAR), 3, '0') AS zip FROM supplier WHERE s_suppkey % 7 <> 0")
def provider_registry(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("s_suppkey")
    code = F.lpad((k % 1000).cast("string"), 3, "0")
    address = lambda purpose, start: F.struct(F.lit(purpose).alias("address_purpose"), F.concat(F.lit(start), code, F.lit("1234")).alias("postal_code"), F.lit("X").alias("city"))
    addresses = F.when(k % 4 == 0, F.array(address("MAILING", "64"))).otherwise(F.array(address("MAILING", "64"), address("LOCATION", "65")))
    record = F.struct(k.cast("string").alias("number"), F.when(k % 2 == 0, "NPI-2").otherwise("NPI-1").alias("enumeration_type"), F.struct(F.when(k % 7 == 0, "D").when(k % 7 == 1, "A").alias("status")).alias("basic"), F.array(F.struct(F.concat(F.lit("T"), k % 5).alias("code"))).alias("taxonomies"), addresses.alias("addresses"))
    pages = table(spark, d, "supplier").groupBy(page_of("s_suppkey")).agg(F.to_json(F.struct(F.collect_list(record).alias("results"))).alias("payload"))
    return S.registry(pages).select("npi", "kind", "taxonomy", "zip")


@query("SELECT 'node/' || CAST(p_partkey AS VARCHAR) AS id, CASE WHEN p_partkey % 11 = 0 OR p_partkey % 13 = 0 THEN 'aba_provider' WHEN p_size % 4 = 0 THEN 'daycare' WHEN p_partkey % 5 = 0 THEN 'pediatrics' WHEN p_partkey % 7 = 0 THEN 'therapy' ELSE 'school' END AS kind, p_partkey % 90 * 1.0E0 AS lat FROM part WHERE p_partkey % 3 <> 0 AND (p_partkey % 11 = 0 OR p_partkey % 13 = 0 OR p_size % 4 IN (0, 1) OR p_partkey % 5 = 0 OR p_partkey % 7 = 0)")
def map_places(spark: SparkSession, d: str) -> DataFrame:
    k, s = F.col("p_partkey"), F.col("p_size")
    name = F.when(k % 11 == 0, "Bright Autism Center").when(k % 5 == 0, "Pediatric Care").otherwise("Plain")
    amenity = F.when(s % 4 == 0, "childcare").when(s % 4 == 1, "school").when(s % 4 == 2, "clinic").otherwise("bank")
    building = F.when(k % 6 == 0, "house").when(k % 3 == 0, "semidetached_house").otherwise("yes")
    point = F.struct((k % 90).cast("double").alias("lat"), F.lit(1.0).alias("lon"))
    element = F.struct(F.lit("node").alias("type"), k.alias("id"), F.when(k % 2 == 0, point["lat"]).alias("lat"), F.when(k % 2 == 0, point["lon"]).alias("lon"), F.when(k % 2 == 1, point).alias("center"), F.create_map(F.lit("name"), name, F.lit("amenity"), amenity, F.lit("building"), building, F.lit("healthcare"), F.when(k % 7 == 0, "physiotherapist").otherwise("no"), F.lit("description"), F.when(k % 13 == 0, "Behavioral health").otherwise("plain")).alias("tags"))
    pages = table(spark, d, "part").groupBy(page_of("p_partkey")).agg(F.to_json(F.struct(F.collect_list(element).alias("elements"))).alias("payload"))
    return S.map_elements(pages).select("id", "kind", "lat")


ROSTER_SQL = "roster AS (SELECT o_custkey AS id, o_orderkey AS version, o_orderstatus AS s, o_orderkey % 90 AS own, o_orderkey % 10 AS zip FROM orders WHERE o_orderstatus <> 'O' AND o_orderkey % 6 <> 1 QUALIFY ROW_NUMBER() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) = 1)"


def _roster(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("o_orderkey")
    rows = table(spark, d, "orders").select(
        F.col("o_custkey").alias("id"), k.alias("version"), F.when(F.col("o_orderstatus") == "O", "License Revoked").when(F.col("o_orderstatus") == "F", "Open").alias("status"), (k % 6 == 1).alias("home"), F.concat(F.lit("z"), k % 10).alias("zip"),
        F.when(k % 4 != 0, (k % 90).cast("double")).alias("lat"), F.when(k % 4 != 0, F.lit(1.0)).alias("lon"), F.when(k % 5 != 0, k % 60).alias("capacity"), F.concat(F.lit("county"), F.col("o_custkey") % 40).alias("county"),
    )
    zips = spark.range(9).select(F.concat(F.lit("z"), "id").alias("zip"), (F.col("id") * 10.0).alias("lat"), F.lit(2.0).alias("lon"))
    return S.roster(rows, "id", zips)


@query(f"WITH {ROSTER_SQL} SELECT id, version, CASE WHEN version % 4 <> 0 THEN own * 1.0E0 ELSE zip * 10.0E0 END AS lat, version % 4 = 0 AS approximate FROM roster WHERE version % 4 <> 0 OR zip < 9")
def licensed_roster(spark: SparkSession, d: str) -> DataFrame:
    return _roster(spark, d).select("id", "version", "lat", "approximate")


@query(f"WITH {ROSTER_SQL} SELECT 'county' || CAST(id % 40 AS VARCHAR) AS county, COUNT(*) AS sites, CASE WHEN COUNT(*) FILTER (WHERE version % 5 = 0) = 0 THEN CAST(SUM(version % 60) AS BIGINT) END AS capacity FROM roster WHERE version % 4 <> 0 OR zip < 9 GROUP BY 1")
def roster_statistics(spark: SparkSession, d: str) -> DataFrame:
    from fieldglass.functions.exprs import whole_sum

    return _roster(spark, d).groupBy("county").agg(F.count(F.lit(1)).alias("sites"), whole_sum("capacity").alias("capacity"))


@query(f"WITH {ROSTER_SQL} SELECT id, 'roster:' || 'county' || CAST(id % 40 AS VARCHAR) AS query, concat_ws(' · ', CASE WHEN s = 'F' THEN 'Open' END, CASE WHEN version % 5 <> 0 THEN 'capacity ' || CAST(version % 60 AS VARCHAR) END) AS snippet, ROW_NUMBER() OVER (PARTITION BY id % 40 ORDER BY id) AS rank FROM roster WHERE version % 4 <> 0 OR zip < 9")
def roster_evidence(spark: SparkSession, d: str) -> DataFrame:
    capacity = F.concat(F.lit("capacity "), F.col("capacity"))
    return S.evidence_records(_roster(spark, d), "roster", [F.col("status"), capacity], ["county"], [F.col("id")]).select("id", "query", "snippet", "rank")


LINKS_SQL = "links AS (SELECT page_id, unnest(regexp_extract_all(html, '<a href=\"/([^\"]*)\">([^<]*)</a>', 1)) AS id, unnest(regexp_extract_all(html, '<a href=\"/([^\"]*)\">([^<]*)</a>', 2)) AS name, generate_subscripts(regexp_extract_all(html, '<a href=\"/([^\"]*)\">([^<]*)</a>', 1), 1) AS pos FROM pages)"


@query(f"WITH {LINKS_SQL} SELECT id, trim(name) AS name FROM links QUALIFY ROW_NUMBER() OVER (PARTITION BY id ORDER BY page_id, pos) = 1")
def link_list_roster(spark: SparkSession, d: str) -> DataFrame:
    return S.link_list(table(spark, d, "pages"), "page_id", "html", r'<a href="/([^"]*)">([^<]*)</a>')


def _feeds(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("page_id")
    item = F.concat(F.lit("<item><title><![CDATA[page "), k, F.lit("]]></title>"), F.when(k % 8 != 0, F.concat(F.lit("<link>https://x.org/"), k % 50, F.lit("/</link>"))).otherwise(F.lit("<link></link>")), F.lit("</item>"))
    rows = table(spark, d, "pages").groupBy(F.floor(k / 100).cast("long").alias("feed")).agg(F.sort_array(F.collect_list(F.struct("page_id", item.alias("item")))).alias("x"))
    return rows.select("feed", F.concat(F.lit("<rss>"), F.array_join(F.transform("x", lambda r: r["item"]), ""), F.lit("</rss>")).alias("payload"))


@query("SELECT page_id // 100 AS feed, 'page ' || CAST(page_id AS VARCHAR) AS title, 'https://x.org/' || CAST(page_id % 50 AS VARCHAR) || '/' AS link, ROW_NUMBER() OVER (PARTITION BY page_id // 100 ORDER BY page_id) AS rank FROM pages QUALIFY page_id % 8 <> 0")
def feed_hits(spark: SparkSession, d: str) -> DataFrame:
    return S.feed_hits(_feeds(spark, d), "feed")


@query("WITH h AS (SELECT page_id, page_id // 100 AS feed, 'https://x.org/' || CAST(page_id % 50 AS VARCHAR) AS url FROM pages WHERE page_id % 8 <> 0), f AS (SELECT * FROM h QUALIFY ROW_NUMBER() OVER (PARTITION BY feed, url ORDER BY page_id) = 1) SELECT feed, url, ROW_NUMBER() OVER (PARTITION BY feed ORDER BY page_id) AS rank FROM f")
def reranked_hits(spark: SparkSession, d: str) -> DataFrame:
    hits = S.feed_hits(_feeds(spark, d), "feed").withColumn("url", clean_url(F.col("link")))
    return frames.first_then_rank(hits, ["feed"], "url", "rank").select("feed", "url", "rank")


@query("SELECT page_id // 100 AS batch, CASE WHEN page_id % 3 = 0 THEN 'map' ELSE 'web' END AS kind, 't' || CAST(page_id AS VARCHAR) AS title, url AS link FROM pages WHERE page_id % 4 <> 0 AND url IS NOT NULL")
def search_records(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("page_id")
    web = F.struct(F.when(k % 4 != 0, F.concat(F.lit("t"), k)).alias("title"), F.when(k % 3 != 0, F.col("url")).alias("link"), F.when(k % 3 == 0, F.col("url")).alias("website"), F.lit("s").alias("snippet"))
    pick = lambda test: F.collect_list(F.when(test, web))
    rows = table(spark, d, "pages").groupBy(F.floor(k / 100).cast("long").alias("batch")).agg(F.to_json(F.struct(pick(k % 3 != 0).alias("organic_results"), pick(k % 3 == 0).alias("local_results"))).alias("payload"))
    return S.search_records(rows, "batch").select("batch", "kind", "title", "link")


@query("SELECT CAST(c_custkey AS VARCHAR) AS id, 30 + c_custkey % 20 * 0.5E0 AS lat, -90 - c_custkey % 10 * 1.0E0 AS lon FROM customer WHERE c_custkey % 4 <> 0")
def geocoded_batch(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("c_custkey")
    found = F.concat(F.lit(',"Match","Exact","1 MAIN ST, X","'), (-90 - k % 10).cast("string"), F.lit(","), (30 + k % 20 * 0.5).cast("string"), F.lit('"'))
    line = F.concat(F.lit('"'), k, F.lit('","1 Main ""St"", X"'), F.when(k % 4 == 0, F.lit(',"No_Match"')).otherwise(found))
    return S.geocoded(table(spark, d, "customer").select(line.alias("line")))


@query("SELECT p_partkey, p_retailprice / 20 AS rate FROM part WHERE p_size % 5 = 4 AND p_partkey % 2 = 0 AND p_retailprice / 20 <= 100")
def modelled_cell(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part").select("p_partkey", (F.col("p_size") % 5).cast("string").alias("agecat"), (F.col("p_partkey") % 2).cast("string").alias("iprcat"), (F.col("p_retailprice") / 20).alias("rate"))
    return S.fixed_cell(p, {"agecat": "4", "iprcat": "0"}, "rate").select("p_partkey", "rate")


@query("SELECT c_custkey, c_custkey % 12 <> 0 AND c_acctbal >= 0 AND c_custkey % 50 * 100 <= c_acctbal AS accepted FROM customer")
def strict_records(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "customer").select("c_custkey", F.when(F.col("c_custkey") % 12 != 0, F.col("c_custkey") % 50 * 100.0).alias("under18"), F.col("c_acctbal").cast("double").alias("total"))
    good, bad = S.strict(rows, ["under18", "total"], "under18", "total")
    return good.select("c_custkey", F.lit(True).alias("accepted")).unionByName(bad.select("c_custkey", F.lit(False).alias("accepted")))


AGES_SQL = "cell AS (SELECT o_custkey % 12 AS county, o_orderkey % 86 AS age, COUNT(*) AS people FROM orders GROUP BY 1, 2 HAVING NOT (o_custkey % 12 % 7 = 0 AND o_orderkey % 86 = 5))"


@query(f"WITH {AGES_SQL}, ok AS (SELECT county FROM cell GROUP BY 1 HAVING COUNT(DISTINCT age) = 86) SELECT county, CAST(SUM(people) FILTER (WHERE age BETWEEN 0 AND 17) AS BIGINT) AS children, CAST(SUM(people) FILTER (WHERE age BETWEEN 2 AND 5) AS BIGINT) AS early FROM cell WHERE county IN (SELECT county FROM ok) AND county % 11 <> 3 GROUP BY 1")
def complete_single_ages(spark: SparkSession, d: str) -> DataFrame:
    cells = table(spark, d, "orders").groupBy((F.col("o_custkey") % 12).alias("county"), (F.col("o_orderkey") % 86).alias("age")).agg(F.count(F.lit(1)).alias("people"))
    cells = cells.where(~((F.col("county") % 7 == 0) & (F.col("age") == 5)))
    cells = cells.unionByName(cells.where("county % 11 = 3 AND age = 9"))  # a cell that is there twice
    return S.complete_ages(cells, "county", {"children": (0, 17), "early": (2, 5)})


@query("SELECT t AS name, ok, missing, extra FROM (VALUES ('customer', true, '', 'c_acctbal,c_mktsegment,c_nationkey'), ('orders', false, 'c_custkey,c_name', '" + "o_custkey,o_orderdate,o_orderkey,o_orderpriority,o_orderstatus,o_totalprice') ) v(t, ok, missing, extra)")
def import_contracts(spark: SparkSession, d: str) -> DataFrame:
    found = []
    for name in ("customer", "orders"):
        got = S.import_contract(table(spark, d, name), ["c_custkey", "c_name"])
        found.append((name, got["ok"], ",".join(got["missing"]), ",".join(got["extra"])))
    return spark.createDataFrame(found, "name string, ok boolean, missing string, extra string")


@query("SELECT o_orderkey, o_orderstatus FROM orders ORDER BY CASE WHEN o_orderstatus <> 'P' THEN o_orderdate END ASC NULLS LAST, o_orderkey LIMIT 500")
def bounded_read(spark: SparkSession, d: str) -> DataFrame:
    return frames.bounded_read(table(spark, d, "orders").withColumn("due", F.when(F.col("o_orderstatus") != "P", F.col("o_orderdate"))), [F.col("due").asc_nulls_last(), F.col("o_orderkey")], 500).select("o_orderkey", "o_orderstatus")
