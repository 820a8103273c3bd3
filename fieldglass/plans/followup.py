"""Queries on clues, follow-up searches, designations and result pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldglass.operators import catalogs as R
from fieldglass.operators import followup as W
from fieldglass.plans.adapters import table
from fieldglass.plans.registry import query
from fieldglass.sources import scans as S

RULES = [r for r in R.fixed_rules() if "." in r[0] and r[4] is None and ":" not in r[0]]
_SHOWN = [" ".join(f'"{g[0]}"' if " " in g[0] else g[0] for g in r[6][:3]) for r in RULES]
RULE_SQL = "rules AS (SELECT * FROM (VALUES " + ", ".join(f"({k}, '{r[0]}', '{r[2]}', '{t}')" for k, (r, t) in enumerate(zip(RULES, _SHOWN, strict=True))) + ") v(k, rule, grp, terms))"
PLAN_SQL = (
    f"{RULE_SQL}, c AS (SELECT c_nationkey AS request, rule, grp, terms, MIN(c_custkey) AS at_key FROM customer JOIN rules ON k = c_custkey * 7 % 180 WHERE c_custkey % 4 <> 0 AND c_custkey % 3 > 0 GROUP BY ALL), "
    "s AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY request, grp ORDER BY at_key, rule) - 1 AS place, COUNT(*) OVER (PARTITION BY request, grp) AS size FROM c), "
    "g AS (SELECT request, grp, ROW_NUMBER() OVER (PARTITION BY request ORDER BY size DESC, grp) - 1 AS rank, COUNT(*) OVER (PARTITION BY request) AS n FROM (SELECT DISTINCT request, grp, size FROM s)), "
    "t AS (SELECT s.*, ROW_NUMBER() OVER (PARTITION BY request ORDER BY ((place - request % 5) % size + size) % size, ((rank - request % 5) % n + n) % n) AS turn FROM s JOIN g USING (request, grp)) "
    "SELECT request, turn, rule, terms || ' Area ' || CAST(request AS VARCHAR) || ' County ' || CASE request % 3 WHEN 0 THEN 'ages 2-5' WHEN 1 THEN 'ages 6-11' ELSE 'children' END || ' ' || CASE turn % 3 WHEN 1 THEN 'public agency report' WHEN 2 THEN 'local news report' ELSE 'public program update' END || ' -site:a' || CAST(at_key % 9 AS VARCHAR) || '.org' AS query FROM t WHERE turn <= 2 + request % 6 AND turn <= 6"
)


@query(f"WITH {PLAN_SQL}")
def followup_plan(spark: SparkSession, d: str) -> DataFrame:
    """Unproved clues of each nation's customers; the rotation is part of the operator."""
    c, n = F.col("c_custkey"), F.col("n_nationkey")
    rules = spark.createDataFrame(RULES, R.RULE_DDL)
    ids = F.array(*(F.lit(r[0]) for r in RULES))
    clues = table(spark, d, "customer").select(F.col("c_nationkey").alias("request"), c.alias("at"), F.get(ids, (c * 7 % 180).cast("int")).alias("rule"), (c % 4 == 0).alias("corroborated"), (c % 3).alias("sources"), F.array(F.concat(F.lit("a"), c % 9, F.lit(".org")), F.lit("not a domain")).alias("domains"))
    requests = table(spark, d, "nation").select(n.alias("request"), F.concat(F.lit('Area "'), n, F.lit('" County')).alias("location"), F.when(n % 3 == 0, "2-5").when(n % 3 == 1, "6-11").otherwise("all").alias("band"), (2 + n % 6).alias("wanted"), (n % 5).alias("rotation"))
    return W.plan_followups(clues, requests, rules)


@query("WITH r AS (SELECT lpad(CAST(s_suppkey * 37 % 60000 AS VARCHAR), 5, '0') AS fips, s_suppkey AS k FROM supplier) SELECT fips, MAX(CAST(k % 31 AS DOUBLE)) AS score FROM r WHERE k % 4 <> 0 AND k % 5 <> 1 AND k % 3 <> 2 AND k % 31 <= 26 GROUP BY 1")
def shortage_designations(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("s_suppkey")
    fips = F.lpad((k * 37 % 60000).cast("string"), 5, "0")
    rows = table(spark, d, "supplier").select(F.when(k % 2 == 0, F.concat(F.substring(fips, 1, 2), F.lit("-"), F.substring(fips, 3, 3))).otherwise((k * 37 % 60000).cast("string")).alias("fips"), (k % 31).cast("string").alias("score"), F.when(k % 4 == 0, "Proposed For Withdrawn").otherwise("Designated").alias("status"), F.when(k % 5 == 1, "Federal Facility").when(k % 5 == 2, "Geographic HPSA").otherwise("High Needs Population").alias("kind"), F.when(k % 3 == 2, "Primary Care").otherwise("Mental Health").alias("discipline"))
    return S.shortage_scores(rows)[0]


@query("WITH p AS (SELECT page_id, 'https://site' || CAST(page_id % 40 AS VARCHAR) || '.org/a?id=' || CAST(page_id AS VARCHAR) AS u FROM pages), h AS (SELECT page_id, unnest([(1, u, 'First & ' || CAST(page_id AS VARCHAR)), (2, 'http://b.org/x', 'Second')], recursive := false) AS x FROM p) SELECT page_id, x[2] AS url, x[3] AS title, 'on ' || CAST(page_id % 40 AS VARCHAR) || CASE x[1] WHEN 1 THEN ' <b>' ELSE '' END AS snippet, CAST(x[1] AS BIGINT) AS rank FROM h")
def result_pages(spark: SparkSession, d: str) -> DataFrame:
    """Result pages on every page: wrapped links, an advertisement and a repeated address among the results."""
    p = F.col("page_id")
    u = F.concat(F.lit("https://site"), p % 40, F.lit(".org/a?id="), p)
    row = lambda link, title, snippet: F.concat(F.lit('<div><a rel="x" class="result__a" href="'), link, F.lit('">'), title, F.lit('</a><span>at</span><a class="result__snippet" href="#">'), snippet, F.lit("</a></div>"))
    on = F.concat(F.lit("on "), p % 40)
    page = F.concat(
        row(F.lit("https://duckduckgo.com/y.js?ad=1"), F.lit("Ad"), F.lit("ad")), row(F.concat(F.lit("//duckduckgo.com/l/?uddg="), F.url_encode(u), F.lit("&amp;rut=1")), F.concat(F.lit("<b>First</b> &amp; "), p), F.concat(on, F.lit(" &lt;b&gt;"))),
        row(F.concat(u, F.lit("#again")), F.lit("Again"), on), row(F.lit("http://b.org/x"), F.lit("Second"), on), row(F.lit("javascript:void(0)"), F.lit("None"), on),
    )
    return S.page_hits(table(spark, d, "pages").select("page_id", page.alias("payload")), "page_id")


@query()
def signal_scan(spark: SparkSession, d: str) -> DataFrame:
    """Clues on all fixed rules and on phrases of `benchmark`, from every document as a hit of its source."""
    from fieldglass.plans.catalogs import rules

    k = F.col("doc_id")
    domain = F.concat("source", F.when(k % 3 == 0, ".gov").when(k % 3 == 1, ".org").otherwise(".com"))
    hits = table(spark, d, "documents").select(k.alias("at"), F.concat(F.lit("https://"), domain, F.lit("/"), k).alias("url"), F.lit("").alias("title"), F.col("text").alias("snippet"))
    return W.scan(hits, rules(spark, d).withColumn("community", F.col("rule").startswith("b1")))
