"""Leads and the pages they come from: what may become one, what stands near it, which are the same, and what is said of it."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldglass.functions.exprs import ColumnOrName, col
from fieldglass.functions.text import host
from fieldglass.operators.listings import review_belongs

# Hosts whose reviews are not to be read.
BLOCKED = ["google.com", "google.co.uk", "maps.google.com", "yelp.com", "yelp.ca", "glassdoor.com", "indeed.com", "facebook.com", "healthgrades.com"]
# Hosts where people talk; what they say is context and never a lead.
COMMUNITY = ["reddit.com", "facebook.com", "nextdoor.com", "threads.net", "instagram.com", "tiktok.com", "x.com"]
# Kinds that can be leads, and children with the condition in a thousand.
KINDS = ["organization", "referral", "professional", "candidate"]
PREVALENCE = 32.2 / 1000
# Words in a press publisher's host.
PRESS = "news|gazette|journal|tribune|press|times|post|reporter|radio"
# Whom to ask for, by words in the kind of source; the first that fits counts.
ROLES = [
    (["daycare", "preschool"], ["director", "owner", "administrator", "program director"]),
    (["school"], ["principal", "special education coordinator", "student services director", "preschool coordinator"]),
    (["pediatric"], ["office manager", "practice manager", "referral coordinator", "care coordinator", "physician owner"]),
    (["speech", "ot", "occupational"], ["owner", "clinical director", "office manager", "referral coordinator"]),
    (["community", "parent"], ["program director", "family services coordinator", "executive director"]),
]
OTHER_ROLES = ["director", "office manager", "program director"]
# What is said of a classification with signals (%s) and without.
REASONS = {
    "Competitor / Market Signal": ("ABA provider detected — market signal: %s.", "ABA provider detected — market signal, not referral lead."),
    "Demand Signal": ("Public demand signal detected: %s.", "Public demand signal detected; verify details."),
    "Referral Source": ("Potential referral source; signals: %s.", "Potential child/family referral source; verify before outreach."),
    "Directory Source": ("Directory/resource result; use for secondary lead research.",) * 2,
    "Contact Target": ("Possible decision-maker/contact result; verify role before outreach.",) * 2,
}
NO_REASON = "Weak evidence — verify before outreach."


def on_host(url: ColumnOrName, hosts: list[str]) -> Column:
    """Whether the address is on one of the hosts or below it; false where there is no host."""
    h = host(col(url))
    return F.coalesce(reduce(Column.__or__, ((h == x) | h.endswith(f".{x}") for x in hosts), F.lit(False)), F.lit(False))


def on_maps(url: ColumnOrName) -> Column:
    path = F.regexp_extract(col(url), r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)
    return F.coalesce((host(col(url)) == "maps.google.com") | (on_host(url, ["google.com"]) & path.startswith("/maps")) | (host(col(url)) == "g.page"), F.lit(False))


def policy(url: ColumnOrName, aggregate_only: list[str]) -> Column:
    """Why a page may not become a lead: "restricted_review", "community" or "aggregate_only"; null where it may."""
    return F.when(on_host(url, ["yelp.com"]) | on_maps(url), "restricted_review").when(on_host(url, COMMUNITY), "community").when(on_host(url, aggregate_only), "aggregate_only")


def enrich(hits: DataFrame, pages: DataFrame, url: str, value: str) -> DataFrame:
    """Hits with the value of a page on their host where they have none of their own.

    Of several pages on a host, the least value that isn't null counts, so pages are one row a host before the join. Hits without
    a host meet nothing.
    """
    one = pages.select(host(F.col(url)).alias("__host"), F.col(value).alias("__value")).where("__host IS NOT NULL").groupBy("__host").agg(F.min("__value").alias("__value"))
    return hits.withColumn("__host", host(F.col(url))).join(one, "__host", "left").withColumn(value, F.coalesce(value, "__value")).drop("__host", "__value")


def near_context(rows: DataFrame, place: str, kind: str) -> DataFrame:
    """rows with how many others at their place are demand signals and market signals, and `strength`, 0 to 10.

    Counts of a place less the row's own stand for a self join, so a crowded place makes no pairs. A null place has no others.
    """
    own = lambda k: F.coalesce((F.col(kind) == k).cast("long"), F.lit(0))
    demand, market = own("Demand Signal"), own("Competitor / Market Signal")
    at = rows.where(F.col(place).isNotNull()).groupBy(place).agg(F.sum(demand).alias("__demand"), F.sum(market).alias("__market"))
    out = rows.join(at, place, "left").withColumns({"demand_near": F.coalesce(F.col("__demand") - demand, F.lit(0)), "market_near": F.coalesce(F.col("__market") - market, F.lit(0))})
    return out.withColumn("strength", F.least(F.lit(10), F.col("demand_near") * 3 + F.col("market_near") * 2)).drop("__demand", "__market")


def known_areas(rows: DataFrame, others: list[DataFrame], key: str) -> DataFrame:
    """Rows whose area another program knows."""
    return rows.join(reduce(DataFrame.unionByName, (o.select(key) for o in others)).distinct(), key, "left_semi")


def kind_faults(kind: ColumnOrName, pipeline: ColumnOrName, saved_kind: ColumnOrName) -> Column:
    """Why a lead is not saved: its kind is none that may be, it was saved as another kind, or its pipeline is another kind's; null where it is."""
    k, fits = col(kind), F.when(col(kind) == "candidate", "talent").otherwise("referral")
    return F.when(~F.coalesce(k.isin(KINDS), F.lit(False)), "kind_not_eligible").when(col(saved_kind) != k, "kind_changed").when(~col(pipeline).eqNullSafe(fits), "pipeline_mismatch")


def expected(people: ColumnOrName) -> Column:
    """How many of an area's children to expect by the constant rate: a statistic of areas, null where the count is."""
    return col(people) * F.lit(PREVALENCE)


def review_publisher(url: ColumnOrName) -> Column:
    return F.when(on_host(url, ["yelp.com"]), "Yelp").when((host(col(url)) == "g.page") | (on_host(url, ["google.com"]) & on_maps(url) & (host(col(url)) != "maps.google.com")), "Google Maps").when(on_host(url, ["bbb.org"]), "BBB").when(host(col(url)).rlike(PRESS), "Independent press").otherwise("Other public source")


def dossier(hits: DataFrame, by: list[str], url: str, title: str, name: str, order: str, most: int = 8) -> DataFrame:
    """For each organisation, its distinct review pages of known publishers, in order, `most` of them shown, and all their publishers.

    hits: by, name, and each hit's title, address and order. Pages are one by scheme, host and path.
    """
    clean = F.concat(F.lower(F.regexp_extract(url, r"^(https?://[^/?#]*)", 1)), F.regexp_extract(url, r"^https?://[^/?#]*([^?#]*)", 1))
    rows = hits.where(review_belongs(title, name)).select(*by, clean.alias("page"), review_publisher(url).alias("publisher"), order)
    rows = rows.where(F.col("page").startswith("http") & (F.col("publisher") != "Other public source"))
    one = rows.groupBy(*by, "page").agg(F.min("publisher").alias("publisher"), F.min(order).alias("__at"))
    ranked = one.withColumn("__k", F.row_number().over(Window.partitionBy(*by).orderBy("__at", "page")))
    first = F.array_sort(F.collect_list(F.when(F.col("__k") <= most, F.struct("__k", "page"))))
    return ranked.groupBy(*by).agg(F.transform(first, lambda x: x["page"]).alias("pages"), F.count_distinct("publisher").cast("int").alias("publishers"))


def entity_name(x: ColumnOrName) -> Column:
    """Lower case without legal forms, all that is neither a-z nor a digit as one space."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(col(x)), r"\b(llc|inc|corp|corporation|pllc|pc|the)\b", ""), "[^a-z0-9]+", " "))


def duplicate_fields(a: str, b: str) -> Column:
    """Which of name, url and phone two records (structs) share; a field that either lacks is none. The score is their number / 3."""
    both = lambda f, g: (F.col(f"{a}.{f}") != "") & (F.col(f"{b}.{f}") != "") & (g(F.col(f"{a}.{f}")) == g(F.col(f"{b}.{f}")))
    tests = [("organization_name", both("name", entity_name)), ("website_domain", both("url", lambda u: F.coalesce(host(u), F.lit("")))), ("phone", both("phone", lambda p: F.regexp_replace(p, r"[^0-9]", "")))]
    return F.array_compact(F.array(*(F.when(ok, name) for name, ok in tests)))


def stable_id(*parts: ColumnOrName) -> Column:
    """An id of a record's parts that is the same in every run."""
    return F.concat(F.lit("opp-"), F.lower(F.hex(F.xxhash64(*map(col, parts)))))


def contact_roles(source: ColumnOrName, kind: ColumnOrName) -> Column:
    """Whom to ask for at a source of that sort; nobody at a competitor."""
    low = F.lower(col(source))
    holds = lambda words: reduce(Column.__or__, (F.contains(low, F.lit(w)) for w in words))
    roles = lambda names: F.array(*map(F.lit, names))
    out = F.when(col(kind) == "Competitor / Market Signal", F.array().cast("array<string>"))
    return reduce(lambda x, r: x.when(holds(r[0]), roles(r[1])), ROLES, out).otherwise(roles(OTHER_ROLES))


def short_reason(kind: ColumnOrName, signals: ColumnOrName) -> Column:
    """One sentence on a classification, with its first two signals where it has any."""
    top = F.array_join(F.slice(F.coalesce(col(signals), F.array().cast("array<string>")), 1, 2), ", ")
    text = lambda k: F.when(top != "", F.replace(F.lit(REASONS[k][0]), F.lit("%s"), top)).otherwise(F.lit(REASONS[k][1]))
    return reduce(lambda x, k: x.when(col(kind) == k, text(k)), list(REASONS)[1:], F.when(col(kind) == next(iter(REASONS)), text(next(iter(REASONS))))).otherwise(NO_REASON)


def packed(*fields: str) -> Column:
    """A breakdown as a JSON object, nulls kept."""
    return F.to_json(F.struct(*fields), {"ignoreNullFields": "false"})


def unpacked(text: ColumnOrName, schema: str) -> Column:
    """A breakdown from its JSON; null where the text is none."""
    return F.from_json(col(text), schema)


def without_competitors(rows: DataFrame, kind: str, exclude: bool) -> DataFrame:
    """Rows without market signals if they are to be excluded; rows without a kind stay."""
    return rows.where(~F.col(kind).eqNullSafe("Competitor / Market Signal")) if exclude else rows
