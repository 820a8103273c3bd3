"""Queries on texts, pages and publishers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldglass.functions import text as T
from fieldglass.functions.store import stored
from fieldglass.operators import catalogs as R
from fieldglass.operators import claims as C
from fieldglass.operators import evidence as E
from fieldglass.plans.adapters import table
from fieldglass.plans.registry import query

SPACES = "[\\x20\\x09-\\x0D]+"
#: Keyword rules over frequent words of the test corpus.
RULES = {"r_the": ["the", "of"], "r_der": ["der", "und", "nicht"], "r_les": ["les ", " en "], "r_key": ["token"], "r_mail": ["@mail"], "r_loud": ["!!"], "r_mark": ["***", "$$$"]}
HIT_SQL = "hit AS (" + " UNION ALL ".join("SELECT doc_id, source, lang, text, '{}' AS rule FROM documents WHERE {}".format(r, " AND ".join(f"contains(lower(text), '{k}')" for k in ks)) for r, ks in RULES.items()) + ")"
HOST_SQL = "nullif(regexp_replace(regexp_replace(regexp_extract(lower(trim(url)), '^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)', 1), '^www\\.', ''), '\\.$', ''), '')"
PUBLISHER_SQL = f"array_to_string(list_slice(string_split({HOST_SQL}, '.'), -2, -1), '.')"


def pages(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages")


@query(f"SELECT page_id, {HOST_SQL} AS host, {PUBLISHER_SQL} AS publisher FROM pages")
def publisher_id(spark: SparkSession, d: str) -> DataFrame:
    h = T.host(F.col("url"))
    return pages(spark, d).select("page_id", h.alias("host"), T.publisher(h).alias("publisher"))


@query(
    "WITH a AS (SELECT page_id, regexp_replace(trim(url), '#.*$', '') AS bare FROM pages), b AS (SELECT *, lower(regexp_extract(bare, '^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)', 1)) AS head FROM a), c AS (SELECT *, substr(bare, length(head) + 1) AS rest FROM b), "
    "e AS (SELECT *, regexp_replace(string_split(rest, '?')[1], '/+$', '') AS path, CASE WHEN contains(rest, '?') THEN list_filter(string_split(regexp_replace(rest, '^[^?]*\\?', ''), '&'), lambda x : x <> '' AND NOT regexp_matches(lower(x), '^(utm_[^=]*|fbclid|gclid|msclkid|mc_cid|mc_eid)(=|$)')) ELSE [] END AS kept FROM c) "
    "SELECT page_id, CASE WHEN head <> '' THEN head || CASE WHEN path = '' THEN '/' ELSE path END || CASE WHEN len(kept) > 0 THEN '?' || array_to_string(kept, '&') ELSE '' END END AS url FROM e"
)
def url_normalise(spark: SparkSession, d: str) -> DataFrame:
    return pages(spark, d).select("page_id", T.clean_url(F.col("url")).alias("url"))


def decode_sql(x: str) -> str:
    """Entities as characters, in one pass, in SQL."""
    named = " ".join(f"WHEN '{k}' THEN '{v if v != chr(39) else chr(39) * 2}'" for k, v in T.ENTITIES.items())
    body = "regexp_extract(p, '^(#[xX][0-9a-fA-F]+|#[0-9]+|[a-zA-Z]+);', 1)"
    code = f"CASE WHEN lower({body}) LIKE '#x%' THEN TRY_CAST('0x' || {body}[3:] AS BIGINT) ELSE TRY_CAST({body}[2:] AS BIGINT) END"
    return (
        f"array_to_string(list_transform(string_split({x}, '&'), lambda p, i : CASE WHEN i = 1 THEN p WHEN {body} = '' THEN '&' || p WHEN {body} LIKE '#%' THEN CASE WHEN {code} BETWEEN 1 AND 1114111 THEN chr(CAST(CASE WHEN {code} BETWEEN 55296 AND 57343 THEN 65533 ELSE {code} END AS INT)) || p[length({body}) + 2 :] ELSE '&' || p END "
        f"ELSE coalesce(CASE lower({body}) {named} END || p[length({body}) + 2 :], '&' || p) END), '')"
    )


_TAGS = "html"
for _pattern in ("(?s)<!--.*?-->", *(f"(?is)<{t}\\b.*?</{t}>" for t in ("script", "style", "noscript", "template", "svg")), "(?s)<[^>]+>"):
    _TAGS = f"regexp_replace({_TAGS}, '{_pattern}', ' ', 'g')"


@query(f"SELECT page_id, length(t) AS n_chars, md5(t) AS digest FROM (SELECT page_id, trim(regexp_replace({decode_sql(_TAGS)}, '[\\x20\\x09-\\x0D\\x{{A0}}]+', ' ', 'g')) AS t FROM pages)")
def page_text(spark: SparkSession, d: str) -> DataFrame:
    t = T.html_text(F.col("html"))
    return pages(spark, d).select("page_id", t.alias("t")).select("page_id", F.length("t").cast("long").alias("n_chars"), F.md5("t").alias("digest"))


def first_sql(x: str, most: int = 10) -> str:
    """The first distinct values of a list, in order."""
    return f"list_slice(list_filter({x}, lambda v, i : list_position({x}, v) = i), 1, {most})"


_FOUND = f"list_transform(regexp_extract_all(regexp_replace({decode_sql('text')}, '(?i)mailto:([^\"''?>\\s]+)', ' \\1 ', 'g'), '{T.MAILBOX}'), lambda m : regexp_replace(lower(m), '^[._%+-]+', ''))"
_KEPT = f"list_filter({_FOUND}, lambda m : length(split_part(m, '@', 1)) <= 64 AND " + " AND ".join(f"NOT regexp_matches(m, '{x}')" for x in T.NO_MAILBOX) + ")"


@query(f"SELECT doc_id, array_to_string(list_sort({first_sql('m')}), ',') AS emails FROM (SELECT doc_id, {_KEPT} AS m FROM documents WHERE contains(text, '@'))")
def email_extract(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").where(F.contains("text", F.lit("@")))
    return docs.select("doc_id", F.array_join(F.array_sort(T.emails(F.col("text"))), ",").alias("emails"))


PHONE_SQL = "list_filter(list_transform(regexp_extract_all(text, '(?:^|[^0-9])((?:\\+?1[\\s.-]?)?(?:\\([0-9]{3}\\)|[0-9]{3})[\\s.-]?[0-9]{3}[\\s.-][0-9]{4})\\b', 1), lambda x : regexp_replace(regexp_replace(x, '[^0-9]', '', 'g'), '^1([0-9]{10})$', '\\1')), lambda x : length(x) = 10 AND x <> repeat(x[1], 10) AND NOT regexp_matches(x, '^[01]|^...[01]|^[0-9]11|^...[0-9]11|^...55501'))"


@query(f"SELECT doc_id, array_to_string(list_sort(list_transform({first_sql('m')}, lambda x : '(' || substr(x, 1, 3) || ') ' || substr(x, 4, 3) || '-' || substr(x, 7, 4))), ',') AS phones FROM (SELECT doc_id, {PHONE_SQL} AS m FROM documents WHERE text IS NOT NULL)")
def phone_extract(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").where(F.col("text").isNotNull())
    return docs.select("doc_id", F.array_join(F.array_sort(T.phones(F.col("text"))), ",").alias("phones"))


@query(f"WITH {HIT_SQL} SELECT doc_id, rule FROM hit")
def keyword_rules(spark: SparkSession, d: str) -> DataFrame:
    return E.match_rules(table(spark, d, "documents").select("doc_id", "text"), RULES).select("doc_id", "rule")


def hits(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", "text", "lang", F.col("source").alias("publisher"))
    return E.match_rules(docs, RULES)


FIRST_SQL = f"{HIT_SQL}, first AS (SELECT * FROM hit QUALIFY ROW_NUMBER() OVER (PARTITION BY rule, source ORDER BY doc_id) = 1)"


@query(f"WITH {FIRST_SQL} SELECT rule, source AS publisher, doc_id FROM first")
def publisher_counts(spark: SparkSession, d: str) -> DataFrame:
    return E.first_publishers(hits(spark, d), ["rule"]).select("rule", "publisher", "doc_id")


WHOLE_STORY_SQL = "trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower(text), 'https?://[^\\x20\\x09-\\x0D]+', ' ', 'g'), '\\b(copyright|all rights reserved|read more|click here)\\b', ' ', 'g'), '[^a-z0-9 ]+', ' ', 'g'), ' +', ' ', 'g'))"
STORY_SQL = f"substr({WHOLE_STORY_SQL}, 1, 1500)"
TOLD_SQL = f"told AS (SELECT rule, source, doc_id, lang, {STORY_SQL} AS story, list_distinct(list_filter(string_split({STORY_SQL}, ' '), lambda w : length(w) > 2)) AS ws FROM first)"
ALIKE = "(x.story = y.story OR (len(x.ws) >= 9 AND len(y.ws) >= 9 AND len(list_intersect(x.ws, y.ws)) >= 0.91 * (len(x.ws) + len(y.ws) - len(list_intersect(x.ws, y.ws)))))"
SEQ_SQL = "seq AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY rule ORDER BY doc_id) AS n FROM told), pass AS (SELECT rule, 0::BIGINT AS n, []::STRUCT(story VARCHAR, ws VARCHAR[])[] AS kept, NULL::BIGINT AS doc_id, false AS ok FROM (SELECT DISTINCT rule FROM told) UNION ALL SELECT p.rule, y.n, CASE WHEN t THEN kept ELSE list_append(kept, {'story': y.story, 'ws': y.ws}) END, y.doc_id, NOT t FROM (SELECT p.*, y AS y, len(list_filter(p.kept, lambda x : y.story <> '' AND x.story <> '' AND ALIKE)) > 0 AS t FROM pass p JOIN seq y ON y.rule = p.rule AND y.n = p.n + 1) p)".replace("ALIKE", ALIKE)
ALONE_SQL = f"{FIRST_SQL}, {TOLD_SQL}, {SEQ_SQL}, alone AS (SELECT told.* FROM told JOIN pass USING (rule, doc_id) WHERE ok)"
VERIFIED_SQL = f"{ALONE_SQL}, c AS (SELECT rule, COUNT(*) AS publishers, bool_or(lang IN ('de', 'fr')) AS institutional, bool_or(lang = 'fr') AS official FROM alone GROUP BY 1), v AS (SELECT *, publishers >= CASE WHEN rule IN ('r_loud', 'r_mail') THEN 3 ELSE 2 END AND institutional AS verified FROM c)"


def independent_hits(spark: SparkSession, d: str) -> DataFrame:
    rows = E.independent(hits(spark, d), ["rule"], "text")
    return rows.withColumns({"institutional": F.col("lang").isin("de", "fr"), "official": F.col("lang") == "fr", "community": F.col("rule").isin("r_loud", "r_mail")})


@query(f"WITH RECURSIVE {VERIFIED_SQL} SELECT rule, publishers, institutional, verified, CASE WHEN verified THEN least(85, 50 + 7 * publishers) END AS value, CASE WHEN verified THEN least(86, 48 + 7 * publishers + CASE WHEN official THEN 9 ELSE 0 END) END AS confidence FROM v")
def corroboration(spark: SparkSession, d: str) -> DataFrame:
    return E.corroborate(independent_hits(spark, d), ["rule"], "institutional", "official", "community")


CHECKS = [("x1", "r_the", "r_key"), ("x2", "r_key", "r_the"), ("x3", "r_mark", "r_none"), ("x4", "r_none", "r_nil"), ("x5", "r_loud", "r_der")]


@query(
    f"WITH RECURSIVE {VERIFIED_SQL}, p AS (SELECT * FROM (VALUES {', '.join(str(x) for x in CHECKS)}) t(name, a, b)), g AS (SELECT rule, list(DISTINCT source) AS s FROM alone GROUP BY 1), j AS (SELECT name, a, b, coalesce(x.s, []) AS l, coalesce(y.s, []) AS r, coalesce(va.verified, false) AND coalesce(vb.verified, false) AS ok FROM p LEFT JOIN g x ON a = x.rule LEFT JOIN g y ON b = y.rule LEFT JOIN v va ON va.rule = a LEFT JOIN v vb ON vb.rule = b) "
    "SELECT name, a, b, len(list_distinct(list_concat(l, r))) AS together, CASE WHEN ok AND len(list_distinct(list_concat(l, r))) >= 3 AND len(list_filter(l, lambda q : NOT list_contains(r, q))) >= 1 THEN 'supported' WHEN len(l) > 0 OR len(r) > 0 THEN 'partial' ELSE 'unobserved' END AS status FROM j"
)
def cross_checks(spark: SparkSession, d: str) -> DataFrame:
    rows = stored(independent_hits(spark, d))  # a row for each rule and publisher
    verified = E.corroborate(rows, ["rule"], "institutional", "official", "community").where("verified").select("rule")
    return E.cross_checks(rows, verified, spark.createDataFrame(CHECKS, "name string, a string, b string"))


SIGNALS = {"s_the": ("en", 6, ["the", "that"]), "s_with": ("en", 5, ["with"]), "s_from": ("en", 3, ["from"]), "s_der": ("de", 6, ["der"]), "s_les": ("fr", 4, ["les", "des"]), "s_los": ("es", 4, ["los"]), "s_token": ("secret", 8, ["token", "password"])}
WORD_SQL = "regexp_matches(lower(text), '(^|[^a-z0-9]){}([^a-z0-9]|$)')"
SIGNAL_SQL = "sig AS (" + " UNION ALL ".join("SELECT doc_id, '{}' AS signal, '{}' AS dimension, {} AS weight FROM documents WHERE {}".format(n, dim, w, " AND ".join(WORD_SQL.format(t) for t in ts)) for n, (dim, w, ts) in SIGNALS.items()) + ")"


def signals(spark: SparkSession, d: str) -> DataFrame:
    rules = spark.createDataFrame([(n, n, dim, False, w, [], [[t] for t in ts], [R.whole_word(t) for t in ts]) for n, (dim, w, ts) in SIGNALS.items()], R.RULE_DDL)
    return R.match(table(spark, d, "documents").select("doc_id", "text"), rules).join(F.broadcast(rules.select("rule", "grp", "weight")), "rule")


@query(f"WITH {SIGNAL_SQL}, b AS (SELECT doc_id, dimension, MAX(weight) AS best, SUM(weight) - MAX(weight) AS rest, COUNT(*) AS n FROM sig GROUP BY 1, 2) SELECT doc_id, least(100.0E0, floor(SUM(best + least(2.0E0, rest / 3.0E0)) * 5 + 0.5E0)) AS fit, CAST(SUM(n) AS BIGINT) AS signals, COUNT(*) AS dimensions FROM b GROUP BY 1")
def narrowing_score(spark: SparkSession, d: str) -> DataFrame:
    return R.narrowing_fit(signals(spark, d), "doc_id").drop("bonus")


@query(f"WITH {SIGNAL_SQL} SELECT signal, dimension, COUNT(*) AS documents, CAST(SUM(weight) AS BIGINT) AS weight FROM sig GROUP BY 1, 2 ORDER BY documents DESC, signal LIMIT 8")
def narrowing_summary(spark: SparkSession, d: str) -> DataFrame:
    s = signals(spark, d).withColumnsRenamed({"rule": "signal", "grp": "dimension"})
    return s.groupBy("signal", "dimension").agg(F.count(F.lit(1)).alias("documents"), F.sum("weight").alias("weight")).orderBy(F.col("documents").desc(), "signal").limit(8)


LEADS = ("", " geriatric ABA clinic", " ABA clinic with a waitlist", " a shortage", " Preschool director", " our Director", " resource list")
LEAD_SQL = "lower(title || ' ' || coalesce(text, '') || ' src')"
CLASS_SQL = "CASE " + " ".join(f"WHEN {' OR '.join(f"contains({LEAD_SQL}, '{t}')" for t in terms)} THEN '{name}'" for name, terms in C.RESULT_CLASSES) + " ELSE 'Weak / Unclear Result' END"


@query(f"SELECT doc_id, {CLASS_SQL} AS class FROM (SELECT *, {list(LEADS)}[CAST(doc_id % 7 AS INT) + 1] AS title FROM documents)")
def first_match_classify(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    title = F.get(F.array(*map(F.lit, LEADS)), (F.col("doc_id") % 7).cast("int"))
    return docs.select("doc_id", C.result_class(title, F.col("text"), F.lit("src")).alias("class"))


@query(
    f"WITH n AS (SELECT doc_id AS id, {WHOLE_STORY_SQL} AS story FROM documents), s AS (SELECT id, story, list_distinct(list_filter(string_split(story, ' '), lambda w : length(w) > 2)) AS ws FROM (SELECT MIN(id) AS id, story FROM n WHERE story <> '' GROUP BY story)) "
    "SELECT x.id AS a, n.id AS b FROM s x JOIN n ON x.id < n.id AND x.story = n.story UNION SELECT x.id, y.id FROM s x JOIN s y ON x.id < y.id AND len(x.ws) >= 9 AND len(y.ws) >= 9 AND len(x.ws) >= 0.91 * len(y.ws) AND len(y.ws) >= 0.91 * len(x.ws) AND len(list_intersect(x.ws, y.ws)) >= 0.91 * (len(x.ws) + len(y.ws) - len(list_intersect(x.ws, y.ws)))"
)
def same_narrative_pairs(spark: SparkSession, d: str) -> DataFrame:
    return E.same_narrative_pairs(table(spark, d, "documents"), "doc_id", "text")


@query(
    f"WITH v AS (SELECT {PUBLISHER_SQL} AS entity, {HOST_SQL} AS domain, 'q' || CAST(page_id % 4 AS VARCHAR) AS query, CASE page_id % 3 WHEN 0 THEN 'community' WHEN 1 THEN 'referral' ELSE 'talent' END AS lane, CASE WHEN page_id % 11 = 0 THEN 'a' || CAST(page_id % 2 AS VARCHAR) || '@b.cd' END AS email, CASE WHEN page_id % 13 = 0 THEN '5551234' END AS phone, 's' || CAST(page_id % 3 AS VARCHAR) AS signal, page_id % 7 = 0 AS enriched, page_id % 2 = 0 AS individual, page_id % 5 = 0 AS aba FROM pages), "
    "e AS (SELECT entity, COUNT(*) AS evidence, COUNT(DISTINCT query) AS queries, COUNT(DISTINCT domain) AS domains, COUNT(DISTINCT email) AS emails, COUNT(DISTINCT phone) AS phones, COUNT(DISTINCT signal) AS signals, bool_or(enriched) AS enriched, bool_or(individual) AS individual, bool_or(aba) AS aba, bool_or(lane = 'talent') AS talent, bool_or(lane = 'referral') AS referral, bool_and(lane = 'community') AS community FROM v GROUP BY 1), "
    "s AS (SELECT *, emails > 0 OR phones > 0 AS contact, least(100, least(20, emails * 8 + phones * 7 + CASE WHEN domains > 0 THEN 5 ELSE 0 END) + least(25, greatest(0, domains - 1) * 12 + CASE WHEN enriched AND domains > 1 THEN 5 ELSE 0 END) + least(35, signals * 5 + CASE WHEN referral THEN 8 ELSE 0 END + CASE WHEN talent THEN 8 ELSE 0 END) + 10) AS raw FROM e) "
    "SELECT entity, evidence, queries, domains, emails, phones, signals, CASE WHEN talent THEN CASE WHEN individual THEN 'candidate' ELSE 'talent_signal' END WHEN community THEN 'community_signal' WHEN aba THEN 'organization' ELSE 'referral' END AS kind, CAST(CASE WHEN domains < 2 THEN least(raw, CASE WHEN contact THEN 55 ELSE 44 END) WHEN contact THEN raw ELSE least(raw, 64) END AS BIGINT) AS score, "
    "CAST(least(90, 24 + domains * 13 + CASE WHEN contact THEN 13 ELSE 0 END + CASE WHEN enriched THEN 10 ELSE 0 END + least(8, queries * 2)) AS BIGINT) AS confidence FROM s"
)
def entity_rollup(spark: SparkSession, d: str) -> DataFrame:
    h, k = T.host(F.col("url")), F.col("page_id")
    one = lambda test, value: F.when(test, F.array(value))
    e = pages(spark, d).select(
        T.publisher(h).alias("entity"), h.alias("domain"), F.concat(F.lit("q"), k % 4).alias("query"), F.when(k % 3 == 0, "community").when(k % 3 == 1, "referral").otherwise("talent").alias("lane"),
        one(k % 11 == 0, F.concat(F.lit("a"), k % 2, F.lit("@b.cd"))).alias("emails"), one(k % 13 == 0, F.lit("5551234")).alias("phones"), F.array(F.concat(F.lit("s"), k % 3)).alias("signals"),
        (k % 7 == 0).alias("enriched"), F.lit(False).alias("official"), (k % 2 == 0).alias("individual"), (k % 5 == 0).alias("aba"), F.lit(True).alias("located"),
    )
    return E.roll_up(e, "entity")


@query(f"WITH h AS (SELECT page_id, {HOST_SQL} AS host FROM pages), c AS (SELECT unnest(['example.com', 'm.example.com', 'com', 'example.org']) AS suffix), t AS (SELECT page_id, host, suffix FROM h LEFT JOIN c ON host = suffix OR ends_with(host, '.' || suffix) QUALIFY ROW_NUMBER() OVER (PARTITION BY page_id ORDER BY length(suffix) DESC NULLS LAST) = 1) SELECT * FROM t")
def longest_suffix_match(spark: SparkSession, d: str) -> DataFrame:
    catalog = spark.createDataFrame([("example.com",), ("m.example.com",), ("com",), ("example.org",)], "suffix string")
    return E.longest_suffix(pages(spark, d).select("page_id", T.host(F.col("url")).alias("host")), catalog).select("page_id", "host", "suffix")


RULE_ROWS = [("/", True), ("/en", False), ("/en/1", True), ("/fr/2", False), ("/fr/2", True), ("/de/", False), ("/*9", False), ("/en/*1$", False), ("/es/$", False), ("", False)]


@query(
    "WITH r AS (SELECT * FROM (VALUES " + ", ".join(f"('{p}', {str(a).lower()})" for p, a in RULE_ROWS) + ") v(pattern, allow)), u AS (SELECT page_id, regexp_extract(url, '^[a-z]+://[^/]*(/[^?#]*)', 1) AS path FROM pages), m AS (SELECT page_id, allow FROM u LEFT JOIN r ON pattern <> '' AND regexp_matches(path, '^' || replace(replace(regexp_replace(pattern, '\\$$', ''), '.', '\\.'), '*', '.*') || CASE WHEN ends_with(pattern, '$') THEN '$' ELSE '' END) QUALIFY ROW_NUMBER() OVER (PARTITION BY page_id ORDER BY length(pattern) DESC NULLS LAST, allow DESC) = 1) SELECT page_id AS url, coalesce(allow, true) AS allow FROM m"
)
def robots_longest_match(spark: SparkSession, d: str) -> DataFrame:
    urls = pages(spark, d).select(F.col("page_id").alias("url"), F.regexp_extract("url", "^[a-z]+://[^/]*(/[^?#]*)", 1).alias("path"), T.publisher(T.host(F.col("url"))).alias("origin"))
    rules = urls.select("origin").distinct().withColumn("x", F.explode(F.array(*(F.struct(F.lit(p).alias("pattern"), F.lit(a).alias("allow")) for p, a in RULE_ROWS)))).select("origin", "x.*")
    return E.allowed(urls, rules)


@query("WITH s AS (SELECT source, COUNT(*) AS size FROM documents GROUP BY 1), r AS (SELECT source, doc_id, ROW_NUMBER() OVER (PARTITION BY source ORDER BY doc_id) AS turn FROM documents) SELECT source, doc_id, turn FROM r JOIN s USING (source) ORDER BY turn, size DESC, source LIMIT 50")
def round_robin_sample(spark: SparkSession, d: str) -> DataFrame:
    return E.pick_in_turn(table(spark, d, "documents").select("source", "doc_id"), "source", "doc_id", 50)
