"""Quality rules: a learned decision list over text statistics, as one ordered Spark conditional expression.

Only DataFrame functions run on the rows. Sequential covering learns rules that reject: each rule is a conjunction of
thresholds, grown on two thirds of the labelled sample by information gain and pruned on the rest. Growing a condition
takes one aggregation to counts by feature and bin, whatever the size of the sample.

Defined cases: null and empty texts have no words, so they fail the base rules and are not kept; rows with a null id are
scored like others; repeated rows and ties give equal results; without labels the list has no rules; extra columns are
left alone; texts are read whole.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldglass.llm.common import SPACE, columns_of, materialize

BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
FEATURES = ("mean_word", "symbol_rate", "dup_line_rate", "repeat_rate", "upper_rate", "bang_rate", "echo_rate", "symbol_word_rate")


def let(value: Column, body) -> Column:
    """body(value) with the value computed once."""
    return F.transform(F.array(value), body)[0]


def repeat_words(hashes: Column, width: int = 5) -> Column:
    """Words in windows of `width` words that occur twice or more. hashes: a column that is not computed on each use."""
    n = F.size(hashes)
    keys = F.transform(F.sequence(F.lit(0), n - width), lambda i: F.xxhash64(*(F.get(hashes, i + k) for k in range(width))))

    def covered(sorted_keys: Column) -> Column:
        def same(j: Column, other: Column) -> Column:
            return F.coalesce(F.get(sorted_keys, j)["k"] == F.get(sorted_keys, other)["k"], F.lit(False))

        at = F.array_sort(F.transform(F.filter(F.sequence(F.lit(0), F.size(sorted_keys) - 1), lambda j: same(j, j - 1) | same(j, j + 1)), lambda j: F.get(sorted_keys, j)["i"]))
        return F.aggregate(
            at,
            F.struct(F.lit(0).alias("n"), F.lit(0).alias("end")),
            lambda a, i: F.struct((a["n"] + i + width - F.greatest(i, a["end"])).alias("n"), (i + width).alias("end")),
            lambda a: a["n"],
        )

    def counted(k: Column) -> Column:
        return F.when(F.size(F.array_distinct(k)) == F.size(k), F.lit(0)).otherwise(let(F.sort_array(F.transform(k, lambda x, i: F.struct(x.alias("k"), i.alias("i")))), covered))

    return F.when(n <= width, F.lit(0)).otherwise(let(keys, counted)).cast("long")


def echoes(hashes: Column) -> Column:
    """Words that repeat the word before."""
    return let(hashes, lambda h: F.size(F.filter(h, lambda x, i: F.coalesce(x == F.get(h, i - 1), F.lit(False)))))


def with_stats(docs: DataFrame, text_col: str = "text", into: str = "stats") -> DataFrame:
    """Adds a struct of the base counts and the features of each whole text."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    hidden = f"__{into}"
    words = F.filter(F.split(text, SPACE), lambda w: w != "")
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    first = F.struct(
        F.transform(words, lambda w: F.xxhash64(w)).alias("h"),
        F.length(F.regexp_replace(text, SPACE, "")).cast("long").alias("word_chars"),
        F.regexp_count(text, F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
        let(lines, lambda x: F.struct(F.size(x).alias("n"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("dup"))).alias("lines"),
        F.regexp_count(text, F.lit("[A-Z]")).alias("upper"),
        F.regexp_count(text, F.lit("!")).alias("bang"),
        F.regexp_count(text, F.lit(r"[#*$%&|<>!]+(?=[\x20\x09-\x0D]|$)")).alias("symbol_words"),
    )

    def rate(a: Column, b: Column) -> Column:
        return F.when(b > 0, a / b).otherwise(F.lit(0.0))

    def second(s: Column) -> Column:
        n = F.size(s["h"]).cast("long")
        return let(
            repeat_words(s["h"]),
            lambda r: F.struct(
                n.alias("n_words"), s["word_chars"].alias("word_chars"), s["n_symbols"].alias("n_symbols"), s["lines"]["dup"].alias("n_dup_lines"), r.alias("n_repeat_words"),
                rate(s["word_chars"], n).alias("mean_word"), rate(s["n_symbols"], s["word_chars"]).alias("symbol_rate"), rate(s["lines"]["dup"], s["lines"]["n"]).alias("dup_line_rate"), rate(r, n).alias("repeat_rate"),
                rate(s["upper"], s["word_chars"]).alias("upper_rate"), rate(s["bang"], n).alias("bang_rate"), rate(echoes(s["h"]), n).alias("echo_rate"), rate(s["symbol_words"], n).alias("symbol_word_rate"),
            ),
        )

    # A generator, so that no filter on the statistics moves below them and computes them again.
    return docs.withColumn(hidden, first).withColumn(into, F.explode(F.array(let(F.col(hidden), second)))).drop(hidden)


def base_failed(stats: Column) -> Column:
    return (stats["n_words"] < 10) | (100 * stats["n_repeat_words"] > 20 * stats["n_words"])


@dataclass
class DecisionList:
    """Ordered rules; a rule is a list of (feature, above, threshold), all of which must hold. The first that holds rejects."""

    rules: list[list[tuple[str, bool, float]]] = field(default_factory=list)

    def verdict(self, stats: Column) -> Column:
        """The number of the first rule that holds, from 1; null if none does."""
        out = None
        for k, rule in enumerate(self.rules, 1):
            out = F.when(rule_holds(rule, stats), F.lit(k)) if out is None else out.when(rule_holds(rule, stats), F.lit(k))
        return F.lit(None).cast("int") if out is None else out


def rule_holds(rule: list[tuple[str, bool, float]], stats: Column) -> Column:
    out = F.lit(True)
    for name, above, cut in rule:
        out = out & ((stats[name] > cut) if above else (stats[name] <= cut))
    return out


def _gain(p0: float, n0: float, p: float, n: float) -> float:
    return p * (math.log2(p / (p + n)) - math.log2(p0 / (p0 + n0))) if p > 0 and p0 > 0 else 0.0


def learn(docs: DataFrame, labels: DataFrame, max_rows: int = 8000, max_rules: int = 8, max_conditions: int = 3, min_precision: float = 0.9, min_covered: int = 3, bins: int = 24) -> DecisionList:
    """Learn rules that reject what `labels.quality` marks 0.

    max_rows bounds the labelled sample: the rows with the smallest hash of their id. A rule is accepted if its precision
    on the pruning third is min_precision or more, and learning stops at the first that isn't.
    """
    picked = labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min("quality").alias("quality"))
    picked = picked.orderBy(F.xxhash64("doc_id", F.lit(11)), "doc_id").limit(max_rows)
    rows = materialize(docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id"), "rule-texts")  # else statistics would run before the join, on all texts
    rows = with_stats(rows).where(~base_failed(F.col("stats")))
    rows = rows.select((F.col("quality") == 0).alias("bad"), (F.pmod(F.xxhash64("doc_id", F.lit(12)), F.lit(3)) == 0).alias("prune"), "stats")
    train = materialize(rows, "rule-sample").coalesce(2)
    cuts_row = train.agg(*(F.percentile_approx(F.col("stats")[f], [k / bins for k in range(1, bins)], 10000).alias(f) for f in FEATURES), *(F.percentile_approx(F.when(F.col("bad"), F.col("stats")[f]), [k / bins for k in range(1, bins)], 10000).alias(f"{f}_bad") for f in FEATURES)).first()
    seen = {f: sorted({*(cuts_row[f] or []), *(cuts_row[f"{f}_bad"] or [])}) for f in FEATURES}
    cuts = {f: [(a + b) / 2 for a, b in zip(x, x[1:], strict=False)] for f, x in seen.items()}  # halfway between values that occur

    def binned(f: str) -> Column:
        return F.size(F.filter(F.array(*(F.lit(float(c)) for c in cuts[f])), lambda c: c < F.col("stats")[f])) if cuts[f] else F.lit(0)

    train = materialize(train.select("bad", "prune", "stats", F.array(*(F.struct(F.lit(f).alias("feature"), binned(f).alias("bin")) for f in FEATURES)).alias("bins")), "rule-bins")

    def counts(where: Column) -> tuple[int, int]:
        got = train.where(where).agg(F.count_if("bad").alias("p"), F.count_if(~F.col("bad")).alias("n")).first()
        return got["p"], got["n"]

    def best(where: Column) -> tuple[float, tuple[str, bool, float] | None]:
        by: dict[str, dict[int, list[int]]] = {}
        for r in train.where(where).select("bad", F.inline("bins")).groupBy("feature", "bin", "bad").count().collect():  # a few hundred counts at most
            by.setdefault(r["feature"], {}).setdefault(r["bin"], [0, 0])[0 if r["bad"] else 1] += r["count"]
        found: tuple[float, tuple[str, bool, float] | None] = (0.0, None)
        for f in sorted(by):
            p0, n0 = (sum(x[k] for x in by[f].values()) for k in (0, 1))
            p = n = 0
            for k, c in enumerate(cuts[f]):
                p, n = p + by[f].get(k, [0, 0])[0], n + by[f].get(k, [0, 0])[1]
                for above, (a, b) in ((False, (p, n)), (True, (p0 - p, n0 - n))):
                    if (g := _gain(p0, n0, a, b)) > found[0] + 1e-9:
                        found = (g, (f, above, float(c)))
        return found

    out, free = DecisionList(), F.lit(True)
    while len(out.rules) < max_rules:
        rule: list[tuple[str, bool, float]] = []
        while len(rule) < max_conditions:
            gain, condition = best(free & ~F.col("prune") & rule_holds(rule, F.col("stats")))
            if condition is None or gain <= 0:
                break
            rule.append(condition)
        if not rule:
            break
        scored = [(counts(free & F.col("prune") & rule_holds(rule[:k], F.col("stats"))), k) for k in range(1, len(rule) + 1)]
        (p, n), k = max(scored, key=lambda x: ((x[0][0] - x[0][1]) / max(1, sum(x[0])), -x[1]))
        if p + n < min_covered or p / (p + n) < min_precision:
            break
        out.rules.append(rule[:k])
        free = free & ~rule_holds(rule[:k], F.col("stats"))
    return out


def judge(docs: DataFrame, rules: DecisionList, text_col: str = "text", into: str = "stats") -> DataFrame:
    """Adds the statistics struct and, beside it, `<into>_rule`, `<into>_failed` and `<into>_kept`."""
    out = with_stats(docs, text_col, into)
    s = F.col(into)
    return out.withColumns({f"{into}_rule": rules.verdict(s), f"{into}_failed": base_failed(s)}).withColumn(f"{into}_kept", ~F.col(f"{into}_failed") & F.col(f"{into}_rule").isNull())


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that neither the base rules nor the learned list rejects, with their own columns."""
    into = "__rules"
    return judge(docs, learn(docs, labels), into=into).where(F.col(f"{into}_kept")).select(*columns_of(docs))


def op8(docs: DataFrame, labels: DataFrame) -> DataFrame:
    out = judge(docs.select("doc_id", "text"), learn(docs, labels))
    return out.select("doc_id", *(F.col("stats")[c].alias(c) for c in BASE), F.col("stats_failed").alias("base_failed"), F.col("stats_kept").alias("kept"), F.col("stats_rule").alias("rule"))
