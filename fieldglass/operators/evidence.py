"""Evidence from texts: rules by keywords, publishers that corroborate each other, entities and their claims."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldglass.functions.exprs import half_up
from fieldglass.functions.store import stored
from fieldglass.functions.text import narrative
from fieldglass.operators.greedy import merged


def match_rules(docs: DataFrame, rules: dict[str, Sequence[str]], text: str = "text") -> DataFrame:
    """A row for each document and rule all of whose keywords it has: one projection over the rules, not a join."""
    low = F.lower(F.col(text))
    hits = F.array_compact(F.array(*(F.when(_all(F.contains(F.col("__low"), F.lit(k.lower())) for k in words), F.lit(name)) for name, words in rules.items())))
    return docs.withColumn("__low", low).withColumn("rule", F.explode(hits)).drop("__low")


def _all(tests) -> Column:
    out = F.lit(True)
    for t in tests:
        out = out & t
    return out


def first_publishers(hits: DataFrame, key: Sequence[str], publisher: str = "publisher", order: str = "doc_id") -> DataFrame:
    """One row for each key and publisher: the first."""
    w = Window.partitionBy(*key, publisher).orderBy(order)
    return hits.where(F.col(publisher) != "").withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def stories(rows: DataFrame, order: str, text: str) -> tuple[DataFrame, DataFrame]:
    """rows with `story`, the narrative that each tells (null: none), and the pairs (story, other), both ways, of narratives that are alike. A narrative is compared once, whatever tells it; order names a row's text."""
    told = F.coalesce(narrative(F.col(text)), F.lit(""))
    keyed = stored(rows.withColumn("__told", F.sha2(told, 256)))
    # Each text is read by its name once, whatever rows have it; of equal narratives the first row's order is the story.
    kinds = keyed.groupBy("__told").agg(F.min(order).alias("story"), F.min_by(text, order).alias("__text"))
    kinds = stored(kinds.where(F.col("__told") != F.sha2(F.lit(""), 256)))
    links = same_narratives(kinds, "story", "__text")[1]
    near = links.select(F.col("a").alias("story"), F.col("b").alias("other"))
    return keyed.join(kinds.select("__told", "story"), "__told", "left").drop("__told"), near.unionByName(near.select(F.col("other").alias("story"), F.col("story").alias("other")))


def told_once(rows: DataFrame, key: Sequence[str], text: str, order: str = "doc_id") -> DataFrame:
    """The rows of each key, in order, that don't tell what one kept before tells. Rows of a key have distinct orders."""
    held, near = stories(rows, order, text)
    told = stored(held.where(F.col("story").isNotNull()))
    # Of one story only the first of a key can stay; what it is like decides for the others too.
    lead = stored(told.groupBy(*key, "story").agg(F.min(order).alias("__at")))
    other = lead.select(*key, F.col("story").alias("other"), F.col("__at").alias("__before"))
    pairs = lead.join(near, "story").join(other, [*key, "other"]).where(F.col("__before") < F.col("__at"))
    node = lambda at: F.struct(*key, F.col(at).alias("at"))
    gone = merged(pairs.select(node("__before").alias("a"), node("__at").alias("b")))[0]
    kept = lead.select(*key, F.col("__at").alias(order)).withColumn("node", F.struct(*key, F.col(order).alias("at"))).join(gone, "node", "left_anti").drop("node")
    return held.where(F.col("story").isNull()).drop("story").unionByName(told.drop("story").join(kept, [*key, order], "left_semi"))


def independent(rows: DataFrame, key: Sequence[str], text: str, publisher: str = "publisher", order: str = "doc_id") -> DataFrame:
    """One row for each key and publisher, the first, and of these, in order, only those that don't tell what one kept before tells (see same_narratives)."""
    return told_once(stored(first_publishers(rows, key, publisher, order)), key, text, order)


def first_votes(rows: DataFrame, near: DataFrame, key: Sequence[str], publisher: str, at: str, most_rounds: int = 200) -> DataFrame:
    """The rows of each key that a pass in the order of `at` accepts: those of a publisher, and telling a story, that no accepted row has or is like.

    rows: key, publisher, story (null: none) and at, unique in a key. near: pairs of stories that are alike, both ways. In a round all rows are accepted that
    are the first open one of their publisher, their story and all stories like it, and what they rule out goes; groups are
    summed up by their first rows, so copies never meet one by one.
    """
    # Of a publisher's rows with one story only the first may be accepted: what rules it out rules out the others.
    rest = [c for c in rows.columns if c not in (*key, publisher, "story", at)]
    first_rows = rows.groupBy(*key, publisher, "story").agg(F.min(at).alias(at), *(F.min_by(c, at).alias(c) for c in rest)).select(*rows.columns)
    live, out = stored(first_rows), None
    near = stored(near)
    for _ in range(most_rounds):
        if live.isEmpty():
            return rows.limit(0) if out is None else out
        first = lambda df, *by: df.groupBy(*key, *by).agg(F.min(at).alias("__first"))
        told = live.where(F.col("story").isNotNull())
        by_story = first(told, "story")
        like = near.join(by_story.withColumnRenamed("story", "other"), "other").groupBy(*key, "story").agg(F.min("__first").alias("__like"))
        now = live.join(first(live, publisher).withColumnRenamed("__first", "__p"), [*key, publisher]).join(by_story, [*key, "story"], "left").join(like, [*key, "story"], "left")
        is_first = (F.col(at) == F.col("__p")) & (F.col(at) <= F.coalesce("__first", at)) & (F.col(at) <= F.coalesce("__like", at))
        new = stored(now.where(is_first).select(*rows.columns))
        out = new if out is None else out.unionByName(new)
        said = new.where(F.col("story").isNotNull()).select(*key, "story")
        said = said.unionByName(said.join(near, "story").select(*key, F.col("other").alias("story"))).distinct()
        live = live.join(new.select(*key, publisher).distinct(), [*key, publisher], "left_anti")
        live = stored(live.join(said, [*key, "story"], "left_anti").select(*rows.columns))
    raise RuntimeError(f"votes did not settle in {most_rounds} rounds")


def corroborate(rows: DataFrame, key: Sequence[str], institutional: str, official: str, community: str | None = None) -> DataFrame:
    """Whether independent publishers make a key verified: two of them (three where a rule is the community's), one institutional; its value and confidence then."""
    need = F.lit(2) if community is None else F.when(F.bool_or(community), 3).otherwise(2)
    out = rows.groupBy(*key).agg(F.count(F.lit(1)).alias("publishers"), F.bool_or(institutional).alias("institutional"), F.bool_or(official).alias("__official"), need.alias("__need"))
    verified = (F.col("publishers") >= F.col("__need")) & F.col("institutional")
    value = F.when(F.col("verified"), F.least(F.lit(85), 50 + 7 * F.col("publishers"))).cast("long")
    confidence = F.when(F.col("verified"), F.least(F.lit(86), 48 + 7 * F.col("publishers") + F.when(F.col("__official"), 9).otherwise(0))).cast("long")
    return out.withColumn("verified", verified).withColumns({"value": value, "confidence": confidence}).drop("__need", "__official")


def cross_checks(rows: DataFrame, verified: DataFrame, pairs: DataFrame, least: int = 3) -> DataFrame:
    """Pairs of rules (name, a, b): supported where both are verified, with so many publishers together, one of them the left's alone; partial where either has any, else unobserved.

    rows: rule, publisher. verified: rule, a row for each verified one. Publishers meet one by one, so no rule's are gathered.
    """
    held = rows.select("rule", "publisher").distinct()
    side = lambda of: pairs.select("name", F.col(of).alias("rule")).join(held, "rule").select("name", "publisher", F.lit(of).alias("side"))
    met = side("a").unionByName(side("b")).groupBy("name", "publisher").agg(F.bool_or(F.col("side") == "a").alias("left"), F.bool_or(F.col("side") == "b").alias("right"))
    counted = met.groupBy("name").agg(F.count(F.lit(1)).alias("together"), F.count_if(F.col("left") & ~F.col("right")).alias("alone"))
    is_verified = lambda of: verified.select(F.col("rule").alias(of), F.lit(True).alias(f"{of}_verified"))
    out = pairs.join(counted, "name", "left").join(is_verified("a"), "a", "left").join(is_verified("b"), "b", "left")
    supported = F.coalesce(F.col("a_verified") & F.col("b_verified") & (F.col("together") >= least) & (F.col("alone") >= 1), F.lit(False))
    status = F.when(supported, "supported").when(F.col("together") > 0, "partial").otherwise("unobserved")
    return out.select("name", "a", "b", F.coalesce("together", F.lit(0)).cast("long").alias("together"), status.alias("status"))


def roll_up(evidence: DataFrame, key: str) -> DataFrame:
    """Entities from evidence: what supports each, its kind, an additive score of capped parts and a confidence.

    evidence: lane, query, domain, emails, phones, signals (arrays), enriched, official, individual, aba, located. Distinct
    values are counted one by one, so no entity's are gathered. Few publishers cap the score at 44, or 55 with a contact;
    no contact caps it at 64.
    """
    array = lambda kind, values: F.transform(values, lambda x: F.struct(F.lit(kind).alias("kind"), x.alias("value")))
    long = evidence.select(key, F.inline(F.concat(array("query", F.array("query")), array("domain", F.array("domain")), *(array(k, F.coalesce(k, F.array().cast("array<string>"))) for k in ("emails", "phones", "signals")))))
    n = lambda kind: F.count_if(F.col("kind") == kind)
    counts = long.where(F.col("value").isNotNull()).distinct().groupBy(key).agg(n("query").alias("queries"), n("domain").alias("domains"), n("emails").alias("emails"), n("phones").alias("phones"), n("signals").alias("signals"))
    lane = lambda x: F.bool_or(F.col("lane") == x)
    facts = evidence.groupBy(key).agg(
        F.count(F.lit(1)).alias("evidence"), F.bool_and("official").alias("__official"), F.bool_or("enriched").alias("__enriched"), F.bool_or("individual").alias("__individual"), F.bool_or("aba").alias("__aba"), F.bool_or("located").alias("__located"),
        lane("talent").alias("__talent"), lane("referral").alias("__referral"), F.bool_and(F.col("lane") == "community").alias("__community"),
    )
    out = facts.join(counts, key, "left").na.fill(0, ["queries", "domains", "emails", "phones", "signals"])
    flag = lambda c, points: F.when(F.col(c), points).otherwise(0)
    contact = (F.col("emails") > 0) | (F.col("phones") > 0)
    several = F.col("domains") > 1
    parts = [
        F.least(F.lit(20), F.col("emails") * 8 + F.col("phones") * 7 + F.when(F.col("domains") > 0, 5).otherwise(0)),
        F.least(F.lit(25), F.greatest(F.lit(0), F.col("domains") - 1) * 12 + F.when(F.col("__enriched") & several, 5).otherwise(0)),
        F.least(F.lit(35), F.col("signals") * 5 + flag("__referral", 8) + flag("__talent", 8)),
        F.when(F.col("__located"), 10).otherwise(4),
    ]
    raw = F.least(F.lit(100), sum(parts[1:], parts[0]))
    score = F.when(F.col("domains") < 2, F.least(raw, F.when(contact, 55).otherwise(44))).when(contact, raw).otherwise(F.least(raw, F.lit(64)))
    confidence = F.least(F.lit(90), 24 + F.col("domains") * 13 + F.when(contact, 13).otherwise(0) + flag("__enriched", 10) + F.least(F.lit(8), F.col("queries") * 2))
    kind = F.when(F.col("__official"), "referral").when(F.col("__talent"), F.when(F.col("__individual"), "candidate").otherwise("talent_signal")).when(F.col("__community"), "community_signal").when(F.col("__aba"), "organization").otherwise("referral")
    return out.select(key, "evidence", "queries", "domains", "emails", "phones", "signals", kind.alias("kind"), score.cast("long").alias("score"), confidence.cast("long").alias("confidence"))


def _bands(least: float, least_words: int, most_words: int) -> list[tuple[int, int, int]]:
    """Bands of sizes (low, high, parts), so wide that a set and any similar one that is no smaller are in one band or in neighbours.

    Two sets so similar differ in (1 - least) / (1 + least) of the words that both have, taken together; a band has a part more than
    sets of it and of the next one differ in, so similar ones have a part in common.
    """
    out, low = [], least_words
    while low <= most_words:
        high = int(low / least + 1e-9)
        most = int(high / least + 1e-9)
        out.append((low, high, int((high + most) * (1 - least) / (1 + least) + 1e-9) + 1))
        low = high + 1
    return out


def same_narratives(docs: DataFrame, key: str, text: str, least_words: int = 9, least: float = 0.91, most: int | None = 1500) -> tuple[DataFrame, DataFrame]:
    """Which narrative each text tells, as (id, story: the first id that tells it), and which of these tell the same, as pairs (a, b) of stories.

    Stories are alike if their sets of words over two letters, nine or more, are that similar. Words are dealt into more parts than
    such sets can differ in words, so they have a whole part in common: sets meet by parts, by all the words there, and not by
    single words, whose lists grow with the corpus. A set is in its own band of sizes and in the one below. Equal sets meet once,
    as one, and their stories are paired after that.
    """
    hashed = F.array_sort(F.array_distinct(F.transform(F.filter(F.split("told", " "), lambda w: F.length(w) > 2), lambda w: F.xxhash64(w))))
    # Rows are left out once they are written: a filter on the narrative would make it a second time.
    told = docs.select(F.col(key).alias("id"), narrative(F.col(text), most).alias("told"))
    every = stored(told.select("id", F.when(F.col("told") != "", F.sha2("told", 256)).alias("name"), hashed.alias("words"))).where(F.col("name").isNotNull())
    first = every.groupBy("name").agg(F.min("id").alias("story"), F.any_value("words").alias("words")).withColumn("size", F.size("words"))
    first = stored(first.withColumn("bag", F.when(F.col("size") >= least_words, F.sha2(F.array_join(F.col("words").cast("array<string>"), " "), 256))))
    described = first.where(F.col("bag").isNotNull())
    bags = stored(described.groupBy("bag").agg(F.min("story").alias("bag_story"), F.any_value("words").alias("words"), F.any_value("size").alias("size"), F.count(F.lit(1)).alias("n")))
    largest = bags.agg(F.max("size")).first()[0] or 0
    bands = _bands(least, least_words, largest)
    edges = F.array(*(F.struct(F.lit(k).alias("band"), F.lit(low).alias("low"), F.lit(high).alias("high"), F.lit(parts).alias("parts")) for k, (low, high, parts) in enumerate(bands or [(0, 0, 1)])))
    band = F.explode(F.filter(edges, lambda e: ((e["low"] <= F.col("size")) & (F.col("size") <= e["high"])) | ((e["high"] < F.col("size")) & (F.col("size") <= F.floor(e["high"] / F.lit(least) + 1e-9)))))
    dealt = bags.select(F.col("bag_story").alias("story"), "words", "size", band.alias("e"))
    # A word is in the part of its own number; the zeros make a row for parts without a word.
    parts = F.col("e.parts")
    zeros = F.transform(F.sequence(F.lit(0), parts - 1), lambda k: F.struct(k.cast("long").alias("part"), F.lit(0).cast("long").alias("word")))
    dealt = dealt.select("story", "size", "e.band", (F.col("size") <= F.col("e.high")).alias("own"), F.inline(F.concat(F.transform("words", lambda w: F.struct(F.pmod(w, parts).alias("part"), w.alias("word"))), zeros)))
    keyed = dealt.groupBy("story", "size", "band", "own", "part").agg(F.bit_xor("word").alias("of")).select("story", "size", "own", F.xxhash64("band", "part", "of").alias("of"))
    side = lambda x: keyed.select("of", F.col("story").alias(x), F.col("size").alias(f"size_{x}"), F.col("own").alias(f"own_{x}"))
    near = (F.col("own_a") | F.col("own_b")) & (F.least("size_a", "size_b") >= F.greatest("size_a", "size_b") * F.lit(least) - 1e-9)
    met = side("a").join(side("b"), "of").where((F.col("a") < F.col("b")) & near).select("a", "b").distinct()
    own = lambda x: bags.select(F.col("bag_story").alias(x), F.col("words").alias(f"words_{x}"), F.col("bag").alias(f"bag_{x}"))
    held = met.join(own("a"), "a").join(own("b"), "b")
    common = F.size(F.array_intersect("words_a", "words_b"))
    alike = held.where(common >= least * (F.size("words_a") + F.size("words_b") - common)).select("bag_a", "bag_b")
    same = bags.where("n > 1").select(F.col("bag").alias("bag_a"), F.col("bag").alias("bag_b"))
    of = lambda x: described.select(F.col("bag").alias(f"bag_{x}"), F.col("story").alias(x))
    pairs = alike.unionByName(same).join(of("a"), "bag_a").join(of("b"), "bag_b").where((F.col("bag_a") != F.col("bag_b")) | (F.col("a") < F.col("b")))
    links = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    return every.select("id", "name").join(first.select("name", "story"), "name").select("id", "story"), links


def same_narrative_pairs(docs: DataFrame, key: str, text: str, least_words: int = 9, least: float = 0.91) -> DataFrame:
    """Pairs of texts that tell the same, over their whole length: each with the first that tells it word for word, and first ones that are alike."""
    member, links = same_narratives(docs, key, text, least_words, least, None)
    member = stored(member)
    return links.unionByName(member.where(F.col("story") < F.col("id")).select(F.col("story").alias("a"), F.col("id").alias("b")))


def pick_in_turn(rows: DataFrame, group: str, order: str, n: int) -> DataFrame:
    """n rows taken from the groups in turn, large groups first."""
    inside = Window.partitionBy(group).orderBy(order)
    sized = rows.withColumns({"__size": F.count(F.lit(1)).over(Window.partitionBy(group)), "turn": F.row_number().over(inside).cast("long")})
    return sized.orderBy("turn", F.col("__size").desc(), group).limit(n).drop("__size")


def longest_suffix(hosts: DataFrame, catalog: DataFrame) -> DataFrame:
    """The most specific catalog host (suffix) of each host: its suffixes meet the catalog as equal keys."""
    parts = F.split("host", r"\.")
    tails = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, k, F.size(parts)), "."))
    met = hosts.select("host").distinct().withColumn("suffix", F.explode(tails)).join(catalog, "suffix")
    best = met.groupBy("host").agg(F.max_by("suffix", F.length("suffix")).alias("suffix"))
    return hosts.join(best, "host", "left")


def allowed(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """Whether the rules of a url's origin let it be read: the longest matching pattern wins, of equals the one that allows.

    urls: url, origin, path. rules: origin, pattern, allow. In a pattern `*` stands for any run, and a last `$` for the end of the path; empty patterns match nothing.
    """
    body = F.regexp_replace(F.regexp_replace("pattern", r"\$$", ""), r"([.+?^${}()|\[\]\\])", r"\\$1")
    tests = rules.where(F.col("pattern") != "").withColumn("__test", F.concat(F.lit("^"), F.replace(body, F.lit("*"), F.lit(".*")), F.when(F.col("pattern").endswith("$"), "$").otherwise("")))
    met = urls.join(tests, "origin").where(F.expr("path rlike __test"))
    best = met.groupBy("url").agg(F.max_by("allow", F.struct(F.length("pattern"), F.col("allow"))).alias("allow"))
    return urls.select("url").join(best, "url", "left").select("url", F.coalesce("allow", F.lit(True)).alias("allow"))
