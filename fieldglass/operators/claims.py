"""What public texts claim: filters that keep households out, ages and areas that texts name, roles, claims, themes and opportunity scores."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldglass.functions.exprs import half_up
from fieldglass.functions.store import stored
from fieldglass.operators.catalog_values import TERMS
from fieldglass.operators.evidence import first_votes, stories, told_once

#: Texts about a household are no evidence. Fixed values.
HOUSEHOLD = (
    r"(?i)\b(child|kid|son|daughter|boy|girl)\b.{0,90}\b(lives here|lives at|our house|my house|home address)\b",
    r"(?i)\b(lives here|lives at|our house|my house|home address)\b.{0,90}\b(autis|disab|special needs)\b",
    r"(?i)\b\d{1,5}\s+[a-z0-9 .'-]+\s+(street|st|avenue|ave|road|rd|lane|ln|drive|dr)\b",
)
#: A shortage that is denied. A fixed value.
NEGATED = r"(?i)\b(no|zero|without|eliminated|cleared)\s+(current\s+)?(waitlist|waiting list|backlog|shortage)\b"
#: Words of inclusion. A fixed value.
INCLUSION = r"(?i)\b(inclusi(?:ve|on)|special needs|special education|early intervention|developmental(?:ly)?|autism|autistic|therapeutic|IEP|IFSP|ECSE|early childhood special|sensory|speech therapy|occupational therapy|behavior(?:al)? support|ABA)\b"
#: Published age ranges. A fixed value.
AGES = r"(?i)\b(?:ages?|aged|serves ages?|serving ages?|age range|children ages?)\s*:?\s*(\d{1,2})\s*(?:to|through|[-–—])\s*(\d{1,2})\b"
#: Programs whose name hints at ages. Fixed values.
HINTS = ((r"(?i)\b(preschool|pre-?k|head start)\b", 2, 5), (r"(?i)\b(elementary school|primary school)\b", 6, 11), (r"(?i)\b(middle school|junior high)\b", 11, 14), (r"(?i)\b(high school|teen(ager)?s?|adolescents?)\b", 12, 18))
#: What kind of organisation a text is about: the first pattern that fits. Fixed values.
ROLES = (
    ("aba_competitor", r"\b(aba clinic|aba therapy|applied behavior analysis provider|behavior analysis center)\b"),
    ("school_program", r"\b(school district|elementary school|middle school|high school|preschool|child find|head start)\b"),
    ("potential_referral", r"\b(referral|pediatrician|speech therapy|occupational therapy|developmental pediatric|evaluation clinic|early intervention)\b"),
    ("community_resource", r"\b(library|community resource|inclusive recreation|nonprofit support|sensory friendly)\b"),
)
#: Points by role and by age status. Fixed values.
ROLE_POINTS = {"potential_referral": 15, "school_program": 10, "aba_competitor": 0}
AGE_POINTS = {"documented": 30, "possible": 10, "mixed": 2, "conflicting": -15, "outside": -30}
#: Pairs of claims of which only one can be true. Fixed values.
OPPOSITES = (("service_available", "service_unavailable"), ("hiring", "not_hiring"))


def about_household(text: Column) -> Column:
    return reduce(Column.__or__, (F.coalesce(text.rlike(p), F.lit(False)) for p in HOUSEHOLD))


def not_denied(text: Column) -> Column:
    return ~F.coalesce(text.rlike(NEGATED), F.lit(False))


def inclusion(text: Column, most: int = 6) -> Column:
    """The first distinct words of inclusion, in lower case."""
    return F.slice(F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(INCLUSION), F.lit(1)), lambda x: F.lower(x))), 1, most)


def redacted(text: Column, most: int = 700) -> Column:
    """A community text without its writers' names."""
    return F.substring(F.regexp_replace(F.regexp_replace(text, r"u/[A-Za-z0-9_-]+", "community member"), r"@[A-Za-z0-9_.-]+", "community account"), 1, most)


def age_ranges(text: Column) -> Column:
    """The published age ranges of a text, as an array of (low, high)."""
    lows, highs = (F.regexp_extract_all(text, F.lit(AGES), F.lit(k)) for k in (1, 2))
    pairs = F.zip_with(lows, highs, lambda a, b: F.struct(a.cast("int").alias("low"), b.cast("int").alias("high")))
    return F.filter(pairs, lambda x: x["low"] <= x["high"])


def covers(text: Column, low: int, high: int) -> Column:
    """Whether a published range covers the whole band; names of programs alone don't."""
    return F.exists(age_ranges(text), lambda x: (x["low"] <= low) & (x["high"] >= high))


def age_fit(text: Column, cues: str, adults: str, low: int = 2, high: int = 18) -> Column:
    """explicit_target, target_subset, outside, mixed_ages or unspecified, by a text's ranges and, where it has none, its cues."""
    lows, highs = (F.regexp_extract_all(text, F.lit(AGES), F.lit(k)) for k in (1, 2))
    r = F.zip_with(lows, highs, lambda a, b: F.struct(a.cast("int").alias("low"), b.cast("int").alias("high")))
    inside = F.forall(r, lambda x: (x["low"] >= low) & (x["high"] <= high) & (x["low"] <= x["high"]))
    exact = F.exists(r, lambda x: (x["low"] == low) & (x["high"] == high))
    outside = F.forall(r, lambda x: (x["high"] < low) | (x["low"] > high))
    cued, adult = text.rlike(cues), text.rlike(adults)
    by_range = F.when(inside & exact, "explicit_target").when(inside, "target_subset").when(outside, "outside").otherwise("mixed_ages")
    by_cue = F.when(adult, F.when(cued, "mixed_ages").otherwise("outside")).when(cued, "target_subset").otherwise("unspecified")
    return F.when(F.size(r) > 0, by_range).otherwise(by_cue)


def published_area(text: Column, place: Column, state: Column, code: Column, zip_code: Column) -> Column:
    """Whether a text names an area: its ZIP; or the place's words and the state, by name or code; the state alone where no place is given; anything where nothing is."""
    quoted = F.concat(F.lit(r"(?i)\b"), F.array_join(F.filter(F.transform(F.split(F.regexp_replace(F.lower(place), r"\bcounty\b", ""), r"\s+"), lambda w: F.regexp_replace(w, "[^a-z0-9]", "")), lambda w: w != ""), r"\s+"), F.lit(r"\b"))
    words = F.nullif(F.trim(F.regexp_replace(F.lower(F.coalesce(place, F.lit(""))), r"\bcounty\b", "")), F.lit(""))
    in_state = F.when(state.isNull(), F.lit(True)).otherwise(F.regexp(text, F.concat(F.lit(r"(?i)\b("), state, F.lit("|"), code, F.lit(r")\b"))))
    return F.when(zip_code.isNotNull(), F.regexp(text, F.concat(F.lit(r"\b"), zip_code, F.lit(r"\b")))).when(words.isNull(), in_state).otherwise(F.regexp(text, quoted) & in_state)


def role_of(text: Column, competitor: Column) -> Column:
    out = F.lit("unclassified")
    for name, pattern in reversed(ROLES):
        out = F.when(F.lower(text).rlike(pattern), name).otherwise(out)
    return F.when(competitor, "aba_competitor").otherwise(out)


#: Personal texts say nothing about a program, nor do hosts of personal reviews. Fixed values.
PRIVATE_STORY = r"(?i)\b(my child|my son|my daughter|our child|my kid|lives here|lives at|home address)\b"
PERSONAL_HOSTS = r"(^|\.)(reddit\.com|facebook\.com|nextdoor\.com|threads\.net|yelp\.com|google\.com|instagram\.com)$"


def qualify(evidence: DataFrame, key: str, low: int, high: int) -> DataFrame:
    """Age status, supporting publishers and priority of each organisation. evidence: key, role, publisher, text, of which the first 2,000 characters count, and host where hosts of personal reviews aren't out already.

    Ranges that cover the band and ranges outside it conflict; one that covers documents it, for as many publishers as have one.
    """
    text = F.substring("text", 1, 2000)
    r = age_ranges(text)
    hint = reduce(Column.__or__, (text.rlike(p) & F.lit(a <= high and b >= low) for p, a, b in HINTS))
    restricted = F.coalesce(F.col("host").rlike(PERSONAL_HOSTS), F.lit(True)) if "host" in evidence.columns else F.lit(False)
    own = evidence.where(~text.rlike(PRIVATE_STORY) & ~restricted & F.col("publisher").isNotNull())
    facts = own.select(
        key, "role", "publisher", F.exists(r, lambda x: (x["low"] <= low) & (x["high"] >= high)).alias("covers"), F.exists(r, lambda x: (x["high"] < low) | (x["low"] > high)).alias("outside"),
        F.exists(r, lambda x: (x["high"] >= low) & (x["low"] <= high)).alias("overlaps"), (F.size(r) > 0).alias("found"), hint.alias("hint"),
    )
    out = facts.groupBy(key).agg(F.max("role").alias("role"), *(F.bool_or(c).alias(c) for c in ("covers", "outside", "overlaps", "found", "hint")), F.count_distinct(F.when(F.col("covers"), F.col("publisher"))).alias("publishers"))
    status = F.when(F.col("covers") & F.col("outside"), "conflicting").when(F.col("covers"), "documented").when(F.col("overlaps"), "mixed").when(F.col("found"), "outside").when(F.col("hint"), "possible").otherwise("unknown")
    points = lambda c, table, other: reduce(lambda o, kv: F.when(F.col(c) == kv[0], kv[1]).otherwise(o), table.items(), F.lit(other))
    out = out.withColumn("status", status)
    return out.withColumn("priority", points("role", ROLE_POINTS, -6) + points("status", AGE_POINTS, 0) + F.least(F.lit(10), F.col("publishers") * 5)).select(key, "role", "status", "publishers", "priority")


def lead_order(leads: DataFrame, score: str = "score") -> DataFrame:
    """Leads in order of priority: the outside ones go, and only those that don't compete get a bonus from their score."""
    bonus = F.when(F.col("role") == "aba_competitor", 0).otherwise(half_up(F.col(score) / 10))
    return leads.where("status <> 'outside'").withColumn("priority", (F.col("priority") + bonus).cast("long"))


#: What a text claims. Fixed values.
CLAIMS = {
    "institution_exists": r"(?i)\b(licensed (child ?care|preschool|facility)|npi\s*\d+|official (facility|provider)|organization directory)\b",
    "referral_pathway": r"(?i)\b(referral(s)? (accepted|form|partner|process|network)|refer (a|your) patient|accepts referrals)\b",
    "service_available": r"(?i)\b((now |currently )?accepting new (patients|clients|referrals)|now enrolling|intake reopened|new clinic opened)\b",
    "service_unavailable": r"(?i)\b(no longer accepting|not accepting new (patients|clients|referrals)|intake closed|wait ?list closed|permanently closed)\b",
    "hiring": r"(?i)\b(now hiring|we are hiring|apply now|job opening|open position|recruiting behavior)\b",
    "not_hiring": r"(?i)\b(not hiring|no open positions|hiring freeze|positions filled)\b",
    "verified_public_contact": r"(?i)\b(contact (us|the director)|call us|reach our team|referrals?@|intake@)\b",
}
#: Of these a text can't say that a service is available. A fixed value.
SHUT = r"(?i)\b(not accepting new|no longer accepting|intake closed|wait ?list closed)\b"
#: Themes of what is published about an organisation, with their sentiment. Fixed values.
THEMES = (
    ("intake_wait", "concern", r"(?i)\b(waitlists?|waiting list|months? waiting|intake delays?|long wait)\b"),
    ("communication", "concern", r"(?i)\b(unreturned calls?|does not respond|no response|unresponsive|poor communication)\b"),
    ("appointments", "concern", r"(?i)\b(repeated cancellations?|schedule(?:ing)? problems?|appointment delays?)\b"),
    ("staffing", "concern", r"(?i)\b(staff turnover|staff(?:ing)? shortages?|therapist vacancies|understaffed)\b"),
    ("insurance", "concern", r"(?i)\b(insurance denied|insurance issues?|billing dispute|out.of.network)\b"),
    ("availability", "concern", r"(?i)\b(no longer accepting|not taking new clients|intake closed|service unavailable)\b"),
    ("positive_feedback", "positive", r"(?i)\b(praised|commended|recognized for|awarded for)\b.{0,70}\b(care|services|staff|team)\b"),
)
#: Hosts whose reviews are not read, and texts that are personal or about no service. Fixed values.
REVIEW_HOSTS = ("google.com", "google.co.uk", "maps.google.com", "yelp.com", "yelp.ca", "glassdoor.com", "indeed.com", "facebook.com", "healthgrades.com")
PERSONAL = r"(?i)\b(my child|my son|my daughter|our child|diagnos(?:ed|is)|medical record|home address|lives at)\b"
SERVICE = r"(?i)\b(aba|behavioral? therapy|autism services|pediatric therapy|clinic)\b"


def publisher_types(evidence: DataFrame, key: str, order: str = "at") -> DataFrame:
    """type and first order of each publisher of an entity: that of its first entry, but of its last government or first-party entry if it has one."""
    authority = F.col("kind").isin("government", "first_party")
    out = evidence.groupBy(key, "publisher").agg(F.max_by("kind", F.when(authority, F.col(order))).alias("authority"), F.min_by("kind", order).alias("first"), F.min(order).alias("since"))
    return out.select(key, "publisher", F.coalesce("authority", "first").alias("type"), "since")


def claim_votes(evidence: DataFrame, key: str, claims: dict[str, str] = CLAIMS, text: str = "text", order: str = "at") -> DataFrame:
    """Votes by claim: how many publishers make it, whether an authority does, and whether it is supported: two of them, an authority, and nothing to the contrary.

    evidence: key, at (unique), publisher, kind (government, first_party, press, community or other), text. Publishers come in the order of
    their first entries, a publisher's entries in theirs; a publisher votes once for a claim, and an entry that tells what an
    earlier vote for the claim told is a repost, no vote. Community publishers have no vote. The first 2,000 characters count.
    """
    types = stored(publisher_types(evidence, key, order))
    cut = F.substring(text, 1, 2000)
    tests = F.array_compact(F.array(*(F.when(cut.rlike(p) & (~cut.rlike(SHUT) if c == "service_available" else F.lit(True)), F.lit(c)) for c, p in claims.items())))
    voters = types.where(F.col("type") != "community")
    flat = stored(evidence.select(key, "publisher", order, cut.alias("__text"), F.explode(tests).alias("claim")).join(voters, [key, "publisher"]))
    held, near = stories(flat, order, "__text")
    rows = held.select(key, "claim", "publisher", "story", F.struct("since", "publisher", order).alias("__at"), F.col("type").isin("government", "first_party").alias("authority"))
    votes = first_votes(rows, near, [key, "claim"], "publisher", "__at").groupBy(key, "claim").agg(F.count(F.lit(1)).alias("publishers"), F.bool_or("authority").alias("authority"))
    against = F.create_map(*(F.lit(x) for a, b in OPPOSITES for x in (a, b, b, a)))
    votes = stored(votes.withColumn("against", against[F.col("claim")]))
    other = votes.select(key, F.col("claim").alias("against"), F.lit(True).alias("contradicted"))
    out = votes.join(other, [key, "against"], "left").withColumn("contradicted", F.coalesce("contradicted", F.lit(False)))
    return out.select(key, "claim", "publishers", "authority", "contradicted", ((F.col("publishers") >= 2) & F.col("authority") & ~F.col("contradicted")).alias("supported"))


def evidence_graph(evidence: DataFrame, votes: DataFrame, key: str) -> DataFrame:
    """The posture of each entity: conflicting, no_evidence, corroborated or single_source, and its publishers by kind."""
    n = lambda kind: F.count_if(F.col("type") == kind)
    base = publisher_types(evidence, key).groupBy(key).agg(F.count(F.lit(1)).alias("publishers"), n("first_party").alias("first_party"), n("government").alias("government"), n("community").alias("community"))
    found = votes.groupBy(key).agg(F.count_if("supported").alias("confirmed"), F.bool_or("contradicted").alias("conflict"))
    out = base.join(found, key, "left").na.fill({"confirmed": 0, "conflict": False})
    posture = F.when(F.col("conflict"), "conflicting").when(F.col("publishers") == 0, "no_evidence").when(F.col("confirmed") > 0, "corroborated").otherwise("single_source")
    return out.withColumn("posture", posture).drop("conflict")


def plain_name(name: Column) -> Column:
    """Letters and digits of a name or text in lower case, by single spaces."""
    return F.trim(F.regexp_replace(F.lower(name), "[^a-z0-9]+", " "))


def review_themes(hits: DataFrame, key: str, themes: Sequence[tuple[str, str, str]] = THEMES, order: str = "at") -> DataFrame:
    """Themes (theme, sentiment, pattern) by organisation: distinct publishers, one sentiment or mixed, corroborated from two.

    hits: key, name and domain of the organisation, at (unique), host, publisher, title, snippet. A hit must name the organisation (ten characters and two
    words at least) in its title or snippet, on a host that isn't its own and isn't a review platform; personal texts and
    those about no service are out, and of what tells the same the first counts. The first 1,400 characters count.
    """
    name = plain_name(F.col("name"))
    named = (F.length(name) >= 10) & F.contains(name, F.lit(" ")) & (F.contains(plain_name(F.col("title")), name) | F.contains(plain_name(F.col("snippet")), name))
    below = lambda host, domain: (host == domain) | host.endswith(F.concat(F.lit("."), domain))
    restricted = reduce(Column.__or__, (below(F.col("host"), F.lit(h)) for h in REVIEW_HOSTS))
    own = F.coalesce(below(F.col("host"), F.nullif("domain", F.lit(""))), F.lit(False))
    text = F.substring(F.concat_ws(" ", "title", "snippet"), 1, 1400)
    kept = hits.where(named & F.col("host").isNotNull() & ~restricted & ~own & ~text.rlike(PERSONAL) & text.rlike(SERVICE))
    found = F.array_compact(F.array(*(F.when(text.rlike(p), F.struct(F.lit(t).alias("theme"), F.lit(s).alias("sentiment"))) for t, s, p in themes)))
    flat = stored(kept.select(key, "publisher", order, plain_name(text).alias("__text"), F.inline(found)))
    # A theme that is named with two sentiments is told once by a text.
    first = flat.groupBy(key, "theme", order).agg(F.any_value("publisher").alias("publisher"), F.any_value("__text").alias("__text"))
    once = told_once(first, [key, "theme"], "__text", order).select(key, "theme", order)
    out = flat.join(once, [key, "theme", order]).groupBy(key, "theme").agg(F.count_distinct("publisher").alias("publishers"), F.min("sentiment").alias("low"), F.max("sentiment").alias("high"))
    return out.select(key, "theme", "publishers", F.when(F.col("low") == F.col("high"), F.col("low")).otherwise("mixed").alias("sentiment"), (F.col("publishers") >= 2).alias("corroborated"))


#: Terms of sources that refer, and of directories. Fixed values.
REFERRAL_TERMS = ("daycare", "preschool", "child care", "childcare", "pediatric", "speech therapy", "speech language", "occupational therapy", "early intervention", "school", "special education", "family resource", "community nonprofit", "parent organization", "child development")
DIRECTORY_TERMS = ("directory", "resource list", "resources", "provider list", "find a provider")
#: What a search result is: the first list of which it has a term. Fixed values.
RESULT_CLASSES = (("Weak / Unclear Result", TERMS["negative"]), ("Competitor / Market Signal", TERMS["competitor"]), ("Demand Signal", TERMS["demand"]), ("Referral Source", REFERRAL_TERMS), ("Contact Target", TERMS["contact"]), ("Directory Source", DIRECTORY_TERMS))


def result_class(title: Column, snippet: Column, url: Column) -> Column:
    """What a search result is, by its title, snippet and address."""
    low = F.lower(F.concat_ws(" ", F.coalesce(title, F.lit("")), F.coalesce(snippet, F.lit("")), F.coalesce(url, F.lit(""))))
    out = F.lit("Weak / Unclear Result")
    for name, terms in reversed(RESULT_CLASSES):
        out = F.when(reduce(Column.__or__, (F.contains(low, F.lit(t)) for t in terms)), name).otherwise(out)
    return out


def terms_in(text: Column, terms: Sequence[str]) -> Column:
    """Which of the terms a lower-case text has, in the list's order."""
    return F.array_compact(F.array(*(F.when(F.contains(text, F.lit(t)), F.lit(t)) for t in terms)))


def opportunity(rows: DataFrame) -> DataFrame:
    """A rule-based score with caps. rows: class, n_referral, n_demand, n_competitor, n_contact, n_signals, autism_support, has_evidence, evidence_confidence (High, Medium, Low), has_location."""
    competitor = (F.col("class") == "Competitor / Market Signal") | (F.col("n_competitor") > 0)
    sure = F.when(F.col("evidence_confidence") == "High", 10).when(F.col("evidence_confidence") == "Medium", 6).otherwise(2)
    parts = [
        F.when(F.col("class") == "Referral Source", F.least(F.lit(20), 8 + F.col("n_referral") * 4)).otherwise(0),
        F.least(F.lit(20), F.col("n_demand") * 5 + F.when(F.col("autism_support"), 5).otherwise(0)),
        F.when(competitor, 0).otherwise(15),
        F.when(F.col("n_contact") > 0, F.least(F.lit(15), 8 + F.col("n_contact") * 3)).otherwise(4),
        F.when(F.col("n_signals") >= 4, 8).when(F.col("n_signals") >= 2, 5).otherwise(2),
        F.when(F.col("has_location"), 8).otherwise(4),
        sure,
    ]
    total = sum(parts[1:], parts[0])
    for test, most in ((competitor, 45), (F.col("class") == "Demand Signal", 65), (~F.col("has_evidence"), 55), (F.col("evidence_confidence") == "Low", 69)):
        total = F.when(test, F.least(total, F.lit(most))).otherwise(total)
    return rows.withColumn("total", total.cast("long"))


def document_checks(found: DataFrame, pairs: DataFrame) -> DataFrame:
    """Pairs of parsed statements (name, a, b): supported by two publishers each, three together and one institution; partial where any is found.

    found: rule, publisher, institutional.
    """
    held = found.groupBy("rule", "publisher").agg(F.bool_or("institutional").alias("institutional"))
    side = lambda of: pairs.select("name", F.col(of).alias("rule")).join(held, "rule").select("name", "publisher", "institutional", F.lit(of).alias("side"))
    met = side("a").unionByName(side("b")).groupBy("name", "publisher").agg(F.bool_or(F.col("side") == "a").alias("a"), F.bool_or(F.col("side") == "b").alias("b"), F.bool_or("institutional").alias("institutional"))
    n = met.groupBy("name").agg(F.count_if("a").alias("left"), F.count_if("b").alias("right"), F.count(F.lit(1)).alias("publishers"), F.bool_or("institutional").alias("institutional"))
    out = pairs.select("name").join(n, "name", "left")
    ok = (F.col("left") >= 2) & (F.col("right") >= 2) & (F.col("publishers") >= 3) & F.col("institutional")
    return out.select("name", F.coalesce("publishers", F.lit(0)).alias("publishers"), F.when(ok, "supported").when(F.col("publishers") > 0, "partial").otherwise("unobserved").alias("status"))
