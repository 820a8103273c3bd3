"""From search hits to clues on areas, and from unproved clues to the next searches."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldglass.functions.store import stored
from fieldglass.functions.text import host, publisher
from fieldglass.operators.catalogs import match
from fieldglass.operators.claims import about_household
from fieldglass.operators.evidence import corroborate, independent

#: Hosts of communities, hosts of institutions and of the press, by pattern. Fixed values.
COMMUNITIES = ("reddit.com", "facebook.com", "threads.net", "nextdoor.com", "quora.com", "tiktok.com", "instagram.com", "x.com")
INSTITUTION = r"(?i)\.(gov|edu)$"
PRESS = r"(?i)news|journal|gazette|post|times|tribune|daily|press|report|radio|publicmedia"
#: How a follow-up looks at a clue, in turn, and what it calls the ages. Fixed values.
ANGLES = ("public agency report", "local news report", "public program update")
AGES = {"2-5": "ages 2-5", "6-11": "ages 6-11", "12-18": "ages 12-18"}


def source_class(domain: Column) -> Column:
    """What kind of source a host is: the first that fits."""
    community = reduce(Column.__or__, ((domain == d) | domain.endswith(f".{d}") for d in COMMUNITIES))
    return F.when(community, "community").when(domain.rlike(INSTITUTION), "official").when(domain.rlike(PRESS), "press").when(domain.endswith(".org") | domain.endswith(".health"), "organization").otherwise("other")


def scan(hits: DataFrame, rules: DataFrame, local: Column | None = None, aged: Column | None = None) -> DataFrame:
    """Clues from search hits: for each rule that a hit fits how many independent publishers tell it, how many of the area and the ages asked for, and whether that proves it.

    hits: at (unique, the order), url, title, snippet. rules: as catalogs.match takes them, with community. local and aged are columns over `text`, the
    hit's title and snippet (2,400 characters): whether it names the area and is on the ages; where not given, all are. Hits
    about households and those without a public address are out before anything else. Publishers count once, in order, and not
    for what an earlier one tells; those of the area are counted for themselves, so a first hit from elsewhere hides none.
    """
    text = F.substring(F.concat_ws(" ", F.coalesce("title", F.lit("")), F.coalesce("snippet", F.lit(""))), 1, 2400)
    named = hits.where(F.col("url").rlike("(?i)^https?://")).select("at", host(F.col("url")).alias("host"), text.alias("text"))
    open_ = named.where(F.col("host").isNotNull() & ~about_household(F.col("text"))).withColumns({"class": source_class(F.col("host")), "publisher": publisher(F.col("host"))})
    open_ = stored(open_.withColumns({"local": F.lit(True) if local is None else local, "aged": F.lit(True) if aged is None else aged}))
    found = stored(match(open_, rules, "at").join(open_, "at").join(rules.select("rule", "community"), "rule"))
    every = independent(found, ["rule"], "text", order="at").groupBy("rule").agg(F.count(F.lit(1)).alias("sources"))
    near = independent(found.where("local and aged"), ["rule"], "text", order="at")
    near = near.withColumns({"institutional": ~F.col("class").isin("community", "other"), "official": F.col("class") == "official"})
    proved = corroborate(near, ["rule"], "institutional", "official", "community").withColumnRenamed("publishers", "eligible")
    out = every.join(proved, "rule", "left").withColumns({"eligible": F.coalesce("eligible", F.lit(0)), "verified": F.coalesce("verified", F.lit(False))})
    return out.select("rule", "sources", "eligible", "verified", "value", "confidence", (F.col("eligible") >= 2).alias("in_area"))


def plan_followups(clues: DataFrame, requests: DataFrame, rules: DataFrame, most: int = 6) -> DataFrame:
    """The next searches of each request: request, turn, rule and query, as many as it asks for and `most` at most.

    clues: request, at (their order), rule, corroborated, sources (how many publishers), domains. requests: request, location, band, wanted, rotation. rules: rule, grp, words.
    Groups of unproved clues take turns, large ones first; the rotation says which group begins and which clue of a group, so
    later runs reach others. A clue's turn follows from its place in its group and the group's size, so turns are computed from
    counts by group and nothing is drawn one by one.
    """
    asked = requests.select("request", "location", "band", F.greatest(F.lit(0), F.least(F.lit(most), F.col("wanted"))).alias("wanted"), F.greatest(F.lit(0), F.col("rotation")).alias("rotation"))
    weak = clues.where(~F.col("corroborated") & (F.col("sources") > 0)).groupBy("request", "rule").agg(F.min("at").alias("at"), F.min_by("domains", "at").alias("domains"))
    weak = stored(weak.join(rules.select("rule", "grp", F.transform("words", lambda g: g[0]).alias("words")), "rule"))
    sizes = weak.groupBy("request", "grp").agg(F.count(F.lit(1)).alias("size"))
    groups = sizes.select("*", (F.row_number().over(Window.partitionBy("request").orderBy(F.col("size").desc(), "grp")) - 1).alias("rank"), F.count(F.lit(1)).over(Window.partitionBy("request")).alias("groups"))
    at = (F.row_number().over(Window.partitionBy("request", "grp").orderBy("at", "rule")) - 1).alias("place")
    rows = weak.select("*", at).join(groups, ["request", "grp"]).join(asked, "request")
    turn = F.struct(F.pmod(F.col("place") - F.col("rotation"), F.col("size")).alias("round"), F.pmod(F.col("rank") - F.col("rotation"), F.col("groups")).alias("seat"))
    picked = rows.withColumn("turn", F.row_number().over(Window.partitionBy("request").orderBy(turn))).where(F.col("turn") <= F.col("wanted"))
    quoted = F.array_join(F.transform(F.slice("words", 1, 3), lambda w: F.when(F.contains(w, F.lit(" ")), F.concat(F.lit('"'), F.replace(w, F.lit('"'), F.lit("")), F.lit('"'))).otherwise(w)), " ")
    region = F.substring(F.trim(F.regexp_replace(F.regexp_replace(F.coalesce("location", F.lit("")), r'[\n\r"<>]', " "), r"\s+", " ")), 1, 95)
    ages = reduce(lambda out, kv: F.when(F.col("band") == kv[0], kv[1]).otherwise(out), AGES.items(), F.lit("children"))
    sites = F.array_join(F.transform(F.slice(F.filter(F.array_distinct("domains"), lambda d: d.rlike(r"(?i)^[a-z0-9.-]+\.[a-z]{2,}$")), 1, 2), lambda d: F.concat(F.lit("-site:"), d)), " ")
    angle = F.get(F.array(*map(F.lit, ANGLES)), ((F.col("turn") - 1) % 3).cast("int"))
    query = F.substring(F.trim(F.array_join(F.filter(F.array(quoted, region, ages, angle, F.coalesce(sites, F.lit(""))), lambda x: x != ""), " ")), 1, 280)
    return picked.select("request", F.col("turn").cast("long").alias("turn"), "rule", query.alias("query"))
