"""Queries of the rule catalogs: all fixed rules, and rules made from the phrases of `benchmark`, on whole texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldglass.functions.store import stored
from fieldglass.operators import catalogs as R
from fieldglass.plans.adapters import table
from fieldglass.plans.registry import query


def _quoted(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def _sql_pattern(rule: tuple) -> str:
    """Patterns as DuckDB reads them: it knows no lookaround, so signals' terms are framed instead."""
    if rule[0].startswith("N"):
        out = ["(?i)(^|[^a-z0-9])" + "".join(c if c.isalnum() or c == " " else "\\" + c for c in g[0]) + "([^a-z0-9]|$)" for g in rule[6]]
    else:
        out = rule[7]
    return "[" + ", ".join(map(_quoted, out)) + "]::VARCHAR[]"


VALUES = ", ".join(f"({_quoted(r[0])}, [" + ", ".join("[" + ", ".join(map(_quoted, g)) + "]" for g in r[6]) + f"]::VARCHAR[][], {_sql_pattern(r)})" for r in R.fixed_rules())
#: Of a benchmark text: its third and fourth word together, the eighth or the ninth, and a pattern on its first word.
MADE = "SELECT 'b' || CAST(item_id AS VARCHAR) AS rule, [[w[3] || ' ' || w[4]], [w[8], w[9]]] AS words, ['(?i)' || w[3] || '.{0,90}' || w[7]] AS patterns FROM (SELECT item_id, string_split(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g'), ' ') AS w FROM benchmark)"
RULE_SQL = f"rules AS (SELECT * FROM (VALUES {VALUES}) v(rule, words, patterns) UNION ALL {MADE})"
FITS = "CASE WHEN list_bool_and(list_transform(words, lambda g : list_bool_or(list_transform(g, lambda w : contains(low, w))))) THEN len(patterns) = 0 OR list_bool_and(list_transform(patterns, lambda p : regexp_matches({0}, p))) ELSE false END"


def rules(spark: SparkSession, d: str) -> DataFrame:
    w = F.split(F.regexp_replace(F.lower("text"), "[^a-z0-9]+", " "), " ")
    at = lambda k: F.get(F.col("w"), F.lit(k - 1))
    made = table(spark, d, "benchmark").select("item_id", w.alias("w")).select(F.concat(F.lit("b"), "item_id").alias("rule"), F.array(F.array(F.concat(at(3), F.lit(" "), at(4))), F.array(at(8), at(9))).alias("words"), F.array(F.concat(F.lit("(?i)"), at(3), F.lit(".{0,90}"), at(7))).alias("patterns"))
    return stored(R.catalog(spark).select("rule", "words", "patterns").unionByName(made))


@query(f"WITH {RULE_SQL} SELECT doc_id, rule FROM (SELECT doc_id, text, lower(text) AS low FROM documents), rules WHERE {FITS.format('text')}")
def catalog_documents(spark: SparkSession, d: str) -> DataFrame:
    return R.match(table(spark, d, "documents"), rules(spark, d))


@query(f"WITH {RULE_SQL} SELECT page_id, rule FROM (SELECT page_id, html, lower(html) AS low FROM pages), rules WHERE {FITS.format('html')}")
def catalog_pages(spark: SparkSession, d: str) -> DataFrame:
    return R.match(table(spark, d, "pages"), rules(spark, d), "page_id", "html")
