"""Catalogs of rules as tables, and one matcher for all of them whose cost doesn't grow with the number of rules.

A rule is a list of groups of words; a text must have a word of each group, and fit every pattern that the rule has. A word is
looked up by its longest piece without a space, which is in one token of a text that has the word.

The words of a very small catalog are tried on each text by Spark. A catalog of few words goes to the texts: each token is looked up in it by its runs of characters, and the rules of all of whose
groups a text has a word are tested on it at once, so texts are read once and never shuffled.

Words of a large catalog are looked up in the corpus's vocabulary, not in each text: a piece meets the distinct tokens that
contain it by their rarest run of three characters. Of each rule the group whose tokens the fewest texts have is looked up in
the texts' postings; what that finds is tested whole. So a text meets only the rules whose rarest group it has.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache, reduce
from operator import and_, or_

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldglass.functions.exprs import half_up
from fieldglass.functions.joins import join_split
from fieldglass.functions.store import stored
from fieldglass.operators.catalog_values import AGE_CHECKS, AGE_RULES, COMMUNITY_GROUPS, CROSS_CHECKS, DOCUMENT_CHECKS, PARSERS, RULES, SIGNALS, TERMS

RULE_DDL = "rule string, name string, grp string, community boolean, weight int, states array<string>, words array<array<string>>, patterns array<string>"
#: Characters in a run that tokens and words meet by.
GRAM = 3
#: Words of a catalog that is sent to the texts, at most.
FEW = 10_000
#: Words of a catalog that are tried on each text, at most.
TRIED = 64
#: Tokens whose pieces a task remembers, and how long they are, at most.
KNOWN, SHORT = 1 << 17, 100


def _lines(text: str) -> list[tuple[str, list[str]]]:
    """Each line's fields, with the group in brackets above it."""
    out, group = [], ""
    for line in text.strip().splitlines():
        if line.startswith("["):
            group = line.strip("[]")
        else:
            out.append((group, [x.strip() for x in line.split(" | ")]))
    return out


def literal_groups(pattern: str) -> list[list[str]]:
    """Of each group of alternatives in a pattern, a piece of plain text that each alternative must have. Groups with an alternative that has none are left out."""
    out = []
    for body in re.findall(r"\(\?:((?:[^()]|\(\?:[^()]*\)\??)*)\)(?!\?)", pattern):
        pieces = []
        for alternative in re.split(r"\|(?![^(]*\))", body):
            plain = re.sub(r"\(\?:[^()]*\)\??|\\s\?|.\?", "\0", alternative)
            pieces.append(max(re.split(r"[\0.*+\\\[\]{}^$]", plain), key=len).strip().lower())
        if pieces and all(len(p) >= GRAM for p in pieces):
            out.append(pieces)
    return out


def fixed_rules() -> list[tuple]:
    """All fixed rules: the public ones and those on ages, the narrowing signals (N001 and on), the parsers of documents and the terms by kind.

    Keywords are compared with the lower-case text as they are written, so those with a capital find nothing, as fixed.
    """
    rows: list[tuple] = []
    for text in (RULES, AGE_RULES):
        for group, (number, name, keywords) in _lines(text):
            rows.append((f"{group}.{number}", name, group, group in COMMUNITY_GROUPS, None, [], [[k] for k in keywords.split("; ")], []))
    for k, (dimension, fields) in enumerate(_lines(SIGNALS)):
        weight, name, terms, states = (*fields, "", "")[:4]
        found = terms.split("; ")
        rows.append((f"N{k + 1:03d}", name, dimension, False, int(weight), states.split(), [[t] for t in found], [whole_word(t) for t in found]))
    for _, (name, title, pattern) in _lines(PARSERS):
        rows.append((name, title, "document", False, None, [], literal_groups(pattern), [f"(?i){pattern}"]))
    for kind, terms in TERMS.items():
        rows += [(f"{kind}:{t}", t, kind, False, None, [], [[t]], []) for t in terms]
    return rows


def catalog(spark: SparkSession) -> DataFrame:
    """The fixed rules as a table."""
    return spark.createDataFrame(fixed_rules(), RULE_DDL)


def check_pairs(spark: SparkSession) -> DataFrame:
    """Pairs of rules (name, a, b) that confirm each other, and of parsers."""
    return spark.createDataFrame([(f[0], f[1], f[2]) for text in (CROSS_CHECKS, AGE_CHECKS, DOCUMENT_CHECKS) for _, f in _lines(text)], "name string, a string, b string")


def whole_word(term: str) -> str:
    """A pattern for a term as whole words, without regard to case."""
    return rf"(?i)(?<![a-z0-9]){re.sub(r'([^A-Za-z0-9 ])', r'\\\1', term)}(?![a-z0-9])"


def narrowing_text(text: Column) -> Column:
    """Curved apostrophes as straight ones, as the signals are written."""
    return F.regexp_replace(text, "[’‘]", "'")


def _grams(text: Column, size: Column) -> Column:
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(text) - size + 1), lambda i: F.substring(text, i, size)))


def token_hits(vocabulary: DataFrame, pieces: DataFrame) -> DataFrame:
    """piece, token and n for each token (of vocabulary: token, n) that contains a piece (of pieces: piece). They meet by the piece's rarest run of characters."""
    pieces = pieces.select("piece").distinct()
    size = F.least(F.lit(GRAM), F.length("piece"))
    sizes = sorted(r[0] for r in pieces.select(size.alias("s")).distinct().collect())  # 1, 2 and 3 at most
    if not sizes:
        return vocabulary.crossJoin(pieces.limit(0)).select("piece", "token", "n")
    runs = F.flatten(F.array(*(F.when(F.length("token") >= s, _grams(F.col("token"), F.lit(s))).otherwise(F.array().cast("array<string>")) for s in sizes)))
    held = vocabulary.select("token", "n", F.explode(runs).alias("gram"))
    wanted = pieces.select("piece", F.explode(_grams(F.col("piece"), size)).alias("gram"))
    often = held.join(F.broadcast(wanted.select("gram").distinct()), "gram", "left_semi").groupBy("gram").agg(F.count(F.lit(1)).alias("tokens"))  # as many grams as the catalog has
    rare = wanted.join(often, "gram", "left").groupBy("piece").agg(F.min_by(F.struct("gram", "tokens"), F.struct(F.coalesce("tokens", F.lit(0)), F.col("gram"))).alias("x"))
    rare = rare.where(F.col("x.tokens") > 0).select("piece", F.col("x.gram").alias("gram"))
    return held.join(rare, "gram").where(F.contains("token", "piece")).select("piece", "token", "n")


def _candidates(rules: list[tuple[str, list[list[str]], list[str]]]):
    """A column function: of a lower-case text in UTF-8 those of the rules (rule, words, patterns) of which it has a word of each group.

    Looked up are the pieces of one group of each rule, that of the longest pieces, as these are rare.
    """
    words = [[[w.encode() for w in g] for g in groups] for _, groups, _ in rules]
    at = defaultdict(list)
    for k, groups in enumerate(words):
        pieces = [{max(w.split(), key=len) for w in g} for g in groups]
        for p in max(pieces, key=lambda g: min(map(len, g))):
            at[p].append(k)
    at, by_run = dict(at), defaultdict(list)
    for p in sorted(p for p in at if len(p) >= GRAM):
        by_run[min((p[i : i + GRAM] for i in range(len(p) - GRAM + 1)), key=lambda r: len(by_run.get(r, ())))].append(p)
    by_run, short = dict(by_run), [p for p in at if len(p) < GRAM]

    def pieces_of(token: bytes) -> list[bytes]:
        return [p for r in by_run.keys() & {token[i : i + GRAM] for i in range(len(token) - GRAM + 1)} for p in by_run[r] if p in token]

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        known = lru_cache(KNOWN)(pieces_of)
        held = pa.array([{"rule": r, "words": w, "patterns": p} for r, w, p in rules], pa.struct({"rule": pa.string(), "words": pa.list_(pa.list_(pa.string())), "patterns": pa.list_(pa.string())}))
        for texts in batches:
            ends, picked = [0], []
            for text in (x.as_py() for x in texts):
                found = {p for p in short if p in text}
                for t in set(text.split()):
                    found.update(known(t) if len(t) <= SHORT else pieces_of(t))
                picked += [k for k in {k for p in found for k in at[p]} if all(any(w in text for w in g) for g in words[k])]
                ends.append(len(picked))
            yield pa.ListArray.from_arrays(pa.array(ends, pa.int32()), held.take(pa.array(picked, pa.int32())))

    run.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}  # as types, not as text
    return F.arrow_udf(run, "array<struct<rule string, words array<array<string>>, patterns array<string>>>")


def match(docs: DataFrame, rules: DataFrame, key: str = "doc_id", text: str = "text", few: int = FEW, tried: int = TRIED) -> DataFrame:
    """key and rule for each document and rule that it fits: a word of each group is in its lower-case text, and all patterns fit the text.

    rules: rule, words (groups of words, each with one group at least), patterns. Words have no space at their ends. Rows of docs
    with a null key or text are left out; rows of one key are texts of their own. Tests run once for each candidate, in one
    pass over the texts. Catalogs of up to `few` words are sent to the texts; those of up to `tried` words are tested whole.
    """
    known = docs.where(F.col(key).isNotNull() & F.col(text).isNotNull()).withColumn("__low", F.lower(F.col(text)))
    size = rules.select(F.sum(F.size(F.flatten("words")))).first()[0] or 0
    rows = [tuple(r) for r in rules.select("rule", "words", "patterns").collect()] if size <= max(few, tried) else []
    if size <= tried:
        has = lambda g: reduce(or_, (F.contains(F.col("__low"), F.lit(w)) for w in g), F.lit(False))
        one = lambda words, patterns: reduce(and_, [*map(has, words), *(F.regexp(F.col(text), F.lit(p)) for p in patterns)])
        held, found = known, F.array(*(F.when(one(words, patterns), F.lit(r)) for r, words, patterns in rows)).cast("array<string>")
    else:
        if size <= few:
            held = known.withColumn("__rules", _candidates(rows)(F.col("__low").cast("binary")))
        else:
            tests = _met(known, rules, key).join(rules.select("rule", "words", "patterns"), "rule").groupBy("__id").agg(F.collect_list(F.struct("rule", "words", "patterns")).alias("__rules"))
            held = known.join(tests, F.col(key) == F.col("__id"))
        fits = lambda r: F.forall(r["words"], lambda g: F.exists(g, lambda w: F.contains(F.col("__low"), w))) & F.forall(r["patterns"], lambda p: F.regexp(F.col(text), p))
        found = F.transform(F.filter("__rules", fits), lambda r: r["rule"])
    # Nulls are texts that no rule fits and, of few rules, those that don't fit.
    return held.select(F.col(key), F.explode_outer(found).alias("rule")).where(F.col("rule").isNotNull())


def _met(known: DataFrame, rules: DataFrame, key: str) -> DataFrame:
    """Pairs (__id, rule) of texts (in __low) and rules of a large catalog that have a token of the rule's rarest group."""
    posted = known.select(F.col(key).alias("__id"), F.explode(F.array_distinct(F.split("__low", r"\s+"))).alias("token")).where("token <> ''")
    words = rules.select("rule", F.posexplode("words").alias("g", "alternatives")).select("rule", "g", F.explode("alternatives").alias("word"))
    longest = F.array_sort(F.split("word", r"\s+"), lambda a, b: F.length(b) - F.length(a))[0]
    flat = stored(words.select("rule", "g", longest.alias("piece")))
    hits = stored(token_hits(posted.groupBy("token").agg(F.count(F.lit(1)).alias("n")), flat))
    groups = flat.distinct().join(hits, "piece", "left").groupBy("rule", "g").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("texts"))
    anchor = groups.groupBy("rule").agg(F.min(F.struct("texts", "g")).alias("x")).where("x.texts > 0").select("rule", F.col("x.g").alias("g"))
    looked_up = flat.join(anchor, ["rule", "g"]).join(hits, "piece").select("token", "n", "rule").distinct()
    return join_split(posted, looked_up, "token", "n", max(10_000, known.count() // 20)).select("__id", "rule").distinct()


def narrowing_fit(signals: DataFrame, key: str) -> DataFrame:
    """Fit of each key from its signals (key, rule, grp, weight), at most 100, and the bonus of a quarter of it: of each dimension the best weight and up to 2 more from a third of the rest, times 5."""
    by = signals.dropDuplicates([key, "rule"]).groupBy(key, "grp").agg(F.max("weight").alias("best"), (F.sum("weight") - F.max("weight")).alias("rest"), F.count(F.lit(1)).alias("n"))
    points = F.col("best") + F.least(F.lit(2.0), F.col("rest") / 3)
    out = by.groupBy(key).agg(F.least(F.lit(100.0), half_up(F.sum(points) * 5).cast("double")).alias("fit"), F.sum("n").alias("signals"), F.count(F.lit(1)).alias("dimensions"))
    return out.withColumn("bonus", half_up(F.col("fit") / 4).cast("long"))
