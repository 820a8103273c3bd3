"""Scans of captured payloads. A payload is one response of a source, as text in a row; what can't be read goes to rejects.

Every scan is a projection with explodes over its payloads, so it runs wherever they lie and nothing is gathered. Unknown
values stay null: sentinels below 0, blanks and text that is no number are never taken for 0.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fieldglass.functions.exprs import measured
from fieldglass.functions.text import clean_url, decoded, html_text

SQMI_OF_SQM = 1 / 2589988.110336


def number(x: Column) -> Column:
    """A number at or above 0, else missing."""
    return measured(x.try_cast("double"))


def header_rows(payloads: DataFrame, columns: Sequence[str], text: str = "payload") -> tuple[DataFrame, DataFrame]:
    """JSON arrays of rows whose first row names the columns. Returns rows (the payload's other columns, then `columns` as text) and rejects."""
    good = F.coalesce(F.ltrim(text).startswith("["), F.lit(False))
    own = [c for c in payloads.columns if c != text]
    rows = payloads.where(good).withColumn("__all", F.from_json(text, "array<array<string>>"))
    flat = rows.where(F.size("__all") > 1).select(*own, F.get("__all", F.lit(0)).alias("__head"), F.explode(F.slice("__all", F.lit(2), F.size("__all") - 1)).alias("__row"))
    value = lambda c: F.get("__row", F.array_position("__head", c).cast("int") - 1)
    return flat.select(*own, *(F.when(F.array_contains("__head", c), value(c)).alias(c) for c in columns)), payloads.where(~good)


def nested_estimates(payloads: DataFrame, text: str = "payload") -> DataFrame:
    """JSON of geography, table, kind and id to values: geography, variable (B09001001 becomes B09001_001E) and value."""
    geo = payloads.select(F.explode(F.from_json(text, "map<string,map<string,map<string,map<string,double>>>>")).alias("geography", "__t"))
    kind = geo.select("geography", F.explode("__t").alias("table", "__k")).select("geography", F.explode("__k").alias("kind", "__v")).where("kind = 'estimate'")
    return kind.select("geography", F.explode("__v").alias("id", "value")).select("geography", F.regexp_replace("id", r"^([BC]\d{5}[A-Z]?)(\d{3})$", "$1_$2E").alias("variable"), number(F.col("value")).alias("value"))


def csv_files(spark: SparkSession, path: str, line_end: str = "\n") -> DataFrame:
    """CSV with quotes, doubled quotes, line feeds and carriage returns inside; rows without any value are dropped.

    line_end is what ends a row. It is stated, not guessed, so what is within quotes stays as it is.
    """
    rows = spark.read.csv(path, header=True, quote='"', escape='"', multiLine=True, lineSep=line_end, emptyValue="", nullValue=None)
    return rows.where(F.coalesce(*(F.nullif(F.col(f"`{c}`"), F.lit("")) for c in rows.columns)).isNotNull()) if rows.columns else rows


def resolve_columns(rows: DataFrame, wanted: dict[str, str]) -> DataFrame:
    """The first column whose header matches each pattern, under the given name; an unrecognised file is an error, not an empty result."""
    found = {name: next((c for c in rows.columns if re.search(pattern, c, re.IGNORECASE)), None) for name, pattern in wanted.items()}
    if missing := sorted(k for k, v in found.items() if v is None):
        raise ValueError(f"no column for {', '.join(missing)} among {', '.join(rows.columns)}")
    return rows.select(*(F.col(f"`{v}`").alias(k) for k, v in found.items()))


def import_contract(rows: DataFrame, required: Sequence[str]) -> dict[str, object]:
    """What keeps a table from being imported (missing columns, no rows) and what is merely more than asked for."""
    missing, extra = sorted(set(required) - set(rows.columns)), sorted(set(rows.columns) - set(required))
    empty = not missing and rows.select(*required).where(F.coalesce(*(F.col(c).cast("string") for c in required)).isNotNull()).isEmpty()
    return {"ok": not missing and not empty, "missing": missing, "extra": extra, "empty": empty}


_RING = "array<array<double>>"


def features(payloads: DataFrame, text: str = "payload") -> DataFrame:
    """Boundary features: id, name, square miles, centroid, rings of at least four points, and their bounding box."""
    schema = f"struct<features:array<struct<attributes:struct<GEOID:string,NAME:string,AREALAND:string,CENTLAT:string,CENTLON:string>,geometry:struct<rings:array<{_RING}>>>>>"
    flat = payloads.select(F.explode(F.from_json(text, schema)["features"]).alias("f"))
    a = F.col("f.attributes")
    rings = F.filter("f.geometry.rings", lambda r: F.size(r) >= 4)
    out = flat.select(a["GEOID"].alias("geoid"), a["NAME"].alias("name"), (a["AREALAND"].try_cast("double") * SQMI_OF_SQM).alias("sqmi"), a["CENTLAT"].try_cast("double").alias("lat"), a["CENTLON"].try_cast("double").alias("lon"), rings.alias("rings"))
    points = F.flatten("rings")
    edge = lambda f, k: f(F.transform(points, lambda p: p[k]))
    return out.withColumns({"min_lon": edge(F.array_min, 0), "max_lon": edge(F.array_max, 0), "min_lat": edge(F.array_min, 1), "max_lat": edge(F.array_max, 1)}).where(F.col("geoid").isNotNull())


def registry(payloads: DataFrame, text: str = "payload") -> DataFrame:
    """Provider records: npi, kind, taxonomy, postal code and city of the location's address (else the first), without deactivated ones."""
    schema = "struct<results:array<struct<number:string,enumeration_type:string,basic:struct<status:string>,taxonomies:array<struct<code:string>>,addresses:array<struct<address_purpose:string,postal_code:string,city:string>>>>>"
    flat = payloads.select(F.explode(F.from_json(text, schema)["results"]).alias("r"))
    at = F.coalesce(F.get(F.filter("r.addresses", lambda x: x["address_purpose"] == "LOCATION"), F.lit(0)), F.get("r.addresses", F.lit(0)))
    return flat.where(F.coalesce(F.col("r.basic.status"), F.lit("A")) != "D").select(F.col("r.number").alias("npi"), F.col("r.enumeration_type").alias("kind"), F.get("r.taxonomies", F.lit(0))["code"].alias("taxonomy"), F.substring(at["postal_code"], 1, 5).alias("zip"), at["city"].alias("city"))


#: Names and specialities of behaviour therapy; specialities and names of child medicine. Fixed values.
ABA_NAME = r"(?i)\b(aba|autism|autistic|applied behavior|behavior(?:al)? (?:analysis|therapy|analyst))\b"
MAP_TESTS = {"speciality": r"(?i)autism|behavio", "child": r"(?i)paediatric|pediatric", "child_name": r"(?i)pediatric|paediatric|children'?s clinic", "therapy": r"speech_therapist|occupational_therapist|physiotherapist", "dwelling": r"^(house|residential|apartments|detached|semidetached_house)$"}
#: What a map service says when it failed, with whatever it had until then. A fixed value.
MAP_FAILED = r"(?i)runtime error|timed out|out of memory"


def map_failed(text: str = "payload") -> Column:
    """Whether a map payload is a failure: it has no elements, or a remark that says so. Of a failed one nothing is known, which isn't that there is nothing."""
    whole = F.from_json(text, "struct<elements:array<string>,remark:string>")
    return whole["elements"].isNull() | F.coalesce(whole["remark"].rlike(MAP_FAILED), F.lit(False))


def map_elements(payloads: DataFrame, text: str = "payload") -> DataFrame:
    """Community-map elements of the payloads that didn't fail, with a valid point and a name: id, name, kind (the first that fits; elements of none are left out), lat, lon. Dwellings are never facilities."""
    good = payloads.where(~map_failed(text))
    flat = good.select(F.explode(F.from_json(text, "struct<elements:array<struct<type:string,id:long,lat:double,lon:double,center:struct<lat:double,lon:double>,tags:map<string,string>>>>")["elements"]).alias("e"))
    tag = lambda k: F.coalesce(F.col("e.tags")[k], F.lit(""))
    name, speciality = F.trim(tag("name")), F.concat_ws(" ", tag("healthcare:speciality"), tag("description"))
    kind = (
        F.when(name.rlike(ABA_NAME) | speciality.rlike(MAP_TESTS["speciality"]), "aba_provider")
        .when(tag("amenity").isin("childcare", "kindergarten"), "daycare")
        .when(speciality.rlike(MAP_TESTS["child"]) | name.rlike(MAP_TESTS["child_name"]), "pediatrics")
        .when(tag("healthcare").rlike(MAP_TESTS["therapy"]), "therapy")
        .when(tag("amenity") == "school", "school")
        .when(tag("amenity") == "hospital", "hospital")
    )
    at = lambda c: F.when(F.col("e.center").isNotNull(), F.col(f"e.center.{c}")).otherwise(F.col(f"e.{c}"))
    out = flat.select(F.concat_ws("/", "e.type", "e.id").alias("id"), name.alias("name"), kind.alias("kind"), at("lat").alias("lat"), at("lon").alias("lon"), tag("building").alias("building"))
    valid = (F.abs("lat") <= 90) & (F.abs("lon") <= 180) & ~((F.col("lat") == 0) & (F.col("lon") == 0))
    return out.where(F.col("kind").isNotNull() & (F.col("name") != "") & valid & ~F.col("building").rlike(MAP_TESTS["dwelling"])).drop("building").dropDuplicates(["id"])


#: A status that isn't open. A fixed value.
CLOSED = r"(?i)\b(closed|inactive|revoked|expired|suspended|terminated)\b"


def roster(rows: DataFrame, key: str, zips: DataFrame, status: str = "status", home: str | None = "home") -> DataFrame:
    """Licensed places that are open and no dwellings, a row for each id (that with the greatest version), at their own point or, marked approximate, at their ZIP's."""
    out = rows.where(~F.coalesce(F.col(status).rlike(CLOSED), F.lit(False)))
    if home:
        out = out.where(~F.coalesce(F.col(home), F.lit(False)))
    last = out.groupBy(key).agg(F.max_by(F.struct(*(c for c in rows.columns if c != key)), "version").alias("r")).select(key, "r.*")
    placed = last.join(zips.select("zip", F.col("lat").alias("__lat"), F.col("lon").alias("__lon")), "zip", "left")
    return placed.withColumn("approximate", F.col("lat").isNull()).withColumns({"lat": F.coalesce("lat", "__lat"), "lon": F.coalesce("lon", "__lon")}).where(F.col("lat").isNotNull()).drop("__lat", "__lon")


def shortage_scores(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The greatest score of each county's designations (fips, score), and the states of which the file has rows at all: no score is no shortage only there.

    rows: fips, score, status, kind, discipline, as text (kind and discipline null where the file has no such column). Only mental health
    counts; withdrawn designations, those of facilities and scores outside 0 to 26 go.
    """
    digits = F.regexp_replace(F.coalesce("fips", F.lit("")), "[^0-9]", "")
    named = rows.withColumn("fips", F.when(F.length(digits) < 5, F.lpad(digits, 5, "0")).otherwise(digits)).where(F.length("fips") == 5)
    mental = named.where(F.coalesce(F.col("discipline").rlike("(?i)mental"), F.lit(True)))
    score = F.when(F.trim("score") == "", F.lit(0.0)).otherwise(F.trim("score").try_cast("double"))
    standing = mental.where(~F.coalesce(F.col("status").rlike("(?i)withdrawn"), F.lit(False)) & F.coalesce(F.col("kind").rlike("(?i)geographic|population"), F.lit(True)))
    kept = standing.withColumn("score", score).where(F.col("score").between(0, 26))
    return kept.groupBy("fips").agg(F.max("score").alias("score")), mental.select(F.substring("fips", 1, 2).alias("state")).distinct()


def link_list(pages: DataFrame, key: str, html: str, pattern: str) -> DataFrame:
    """Programs from a page's links: pattern has the id and the name; of an id's links on all pages the first counts."""
    found = pages.select(key, F.posexplode(F.arrays_zip(F.regexp_extract_all(html, F.lit(pattern), F.lit(1)).alias("id"), F.regexp_extract_all(html, F.lit(pattern), F.lit(2)).alias("name"))).alias("at", "x"))
    return found.groupBy(F.col("x.id").alias("id")).agg(F.min_by(F.trim("x.name"), F.struct(key, "at")).alias("name"))


def feed_hits(payloads: DataFrame, key: str, text: str = "payload") -> DataFrame:
    """Ranked hits of a feed: title, link and rank from 1, without items that lack either."""
    items = F.regexp_extract_all(text, F.lit(r"(?s)<item>(.*?)</item>"), F.lit(1))
    flat = payloads.select(key, F.posexplode(items).alias("at", "item"))
    part = lambda tag: F.nullif(F.trim(F.regexp_replace(F.regexp_extract("item", rf"(?s)<{tag}>(.*?)</{tag}>", 1), r"^<!\[CDATA\[|\]\]>$", "")), F.lit(""))
    return flat.select(key, part("title").alias("title"), part("link").alias("link"), (F.col("at") + 1).cast("long").alias("rank")).where(F.col("title").isNotNull() & F.col("link").isNotNull())


#: A result of a result page: its link, its title and, after it, its snippet. A fixed value.
RESULT = r"(?is)<a[^>]*class=\"[^\"]*result__a[^\"]*\"[^>]*href=\"([^\"]+)\"[^>]*>(.*?)</a>.*?(?:<a[^>]*class=\"[^\"]*result__snippet[^\"]*\"[^>]*>|<div[^>]*class=\"[^\"]*result__snippet[^\"]*\"[^>]*>)(.*?)(?:</a>|</div>)"
#: Where advertisements lead, and how a link is wrapped. Fixed values.
ADVERT = r"(?i)^https?://(?:[^/]+\.)?duckduckgo\.com/y\.js"
WRAPPED = r"[?&]uddg=([^&#]*)"


def page_hits(payloads: DataFrame, key: str, text: str = "payload", most: int = 20) -> DataFrame:
    """Ranked hits of HTML result pages: url, title and snippet as text, without advertisements; of equal addresses the first counts, and ranks close up."""
    part = lambda k: F.regexp_extract_all(text, F.lit(RESULT), F.lit(k))
    flat = payloads.select(key, F.posexplode(F.arrays_zip(part(1).alias("link"), part(2).alias("title"), part(3).alias("snippet"))).alias("at", "x"))
    link = decoded(F.col("x.link"))
    target = F.regexp_extract(link, WRAPPED, 1)
    url = F.when(target != "", F.coalesce(F.try_url_decode(F.replace(target, F.lit("+"), F.lit("%2B"))), link)).when(link.startswith("//"), F.concat(F.lit("https:"), link)).otherwise(link)
    hits = flat.select(key, "at", url.alias("url"), F.substring(html_text(F.col("x.title")), 1, 240).alias("title"), F.substring(html_text(F.col("x.snippet")), 1, 700).alias("snippet"))
    hits = hits.where(F.col("url").rlike(r"(?i)^https?://[^/?#\s]+\.[^/?#\s]+") & ~F.col("url").rlike(ADVERT))
    order = Window.partitionBy(key).orderBy("at")
    hits = hits.withColumn("n", F.row_number().over(order)).where(F.col("n") <= most)
    first = hits.withColumn("k", F.row_number().over(Window.partitionBy(key, clean_url(F.col("url"))).orderBy("at"))).where("k = 1")
    return first.select(key, "url", "title", "snippet", F.row_number().over(order).cast("long").alias("rank"))


def search_records(payloads: DataFrame, key: str, text: str = "payload") -> DataFrame:
    """Web and map records of a keyed provider, normalised: title, link and snippet; those without title or link go."""
    record = "array<struct<title:string,link:string,website:string,snippet:string,address:string>>"
    flat = payloads.select(key, F.from_json(text, f"struct<organic_results:{record},local_results:{record}>").alias("j"))
    one = lambda field, kind: flat.select(key, F.lit(kind).alias("kind"), F.explode(f"j.{field}").alias("x"))
    rows = one("organic_results", "web").unionByName(one("local_results", "map"))
    return rows.select(key, "kind", "x.title", F.coalesce("x.link", "x.website").alias("link"), F.coalesce("x.snippet", "x.address").alias("snippet")).where("title IS NOT NULL AND link IS NOT NULL")


def geocoded(lines: DataFrame, line: str = "line") -> DataFrame:
    """A batch geocoder's lines that match: id, lat, lon."""
    row = F.from_csv(line, "id string, address string, result string, quality string, matched string, point string", {"quote": '"', "escape": '"'})
    return lines.select(row.alias("r")).where("r.result = 'Match'").select(F.col("r.id").alias("id"), F.split("r.point", ",")[1].try_cast("double").alias("lat"), F.split("r.point", ",")[0].try_cast("double").alias("lon")).where("lat IS NOT NULL AND lon IS NOT NULL")


def fixed_cell(rows: DataFrame, cell: dict[str, str], rate: str) -> DataFrame:
    """The one cell of a modelled table that is used, rates above 100 or missing dropped."""
    for name, value in cell.items():
        rows = rows.where(F.col(name) == value)
    return rows.withColumn(rate, number(F.col(rate))).where(F.col(rate) <= 100)


def strict(rows: DataFrame, estimates: Sequence[str], part: str, whole: str) -> tuple[DataFrame, DataFrame]:
    """Records all of whose estimates are known and whose part is no more than its whole, and the others."""
    ok = F.lit(True)
    for c in estimates:
        ok = ok & number(F.col(c)).isNotNull()
    ok = F.coalesce(ok & (F.col(part) <= F.col(whole)), F.lit(False))
    return rows.where(ok), rows.where(~ok)


def complete_ages(cells: DataFrame, key: str, bands: dict[str, tuple[int, int]], ages: int = 86) -> DataFrame:
    """Sums by age band of the areas that have each single year exactly once. cells: key, age, people."""
    out = cells.groupBy(key).agg(
        F.count_distinct("age").alias("__ages"), F.count(F.lit(1)).alias("__cells"), F.count("people").alias("__known"),
        *(F.sum(F.when(F.col("age").between(a, b), F.col("people"))).alias(name) for name, (a, b) in bands.items()),
    )
    return out.where((F.col("__ages") == ages) & (F.col("__cells") == ages) & (F.col("__known") == ages)).drop("__ages", "__cells", "__known")


def evidence_records(rows: DataFrame, query: str, parts: Sequence[Column], by: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """Roster rows as evidence: a snippet of the known parts, a query id and a rank without gaps in each query."""
    from pyspark.sql import Window

    rank = F.row_number().over(Window.partitionBy(*by).orderBy(*order)).cast("long")
    return rows.withColumns({"snippet": F.concat_ws(" · ", *parts), "query": F.concat_ws(":", F.lit(query), *by), "rank": rank})
