"""Rule catalogs: the matcher against every pair of text and rule, and the fixed lists."""

import itertools
import random
import re

from fieldglass.operators import catalogs


def pairs(texts, rules):
    """Each text against each rule, one by one."""
    fit = lambda t, r: all(any(w in t.lower() for w in g) for g in r[6]) and all(re.search(p, t) for p in r[7])
    return sorted((i, r[0]) for i, t in texts if i is not None and t is not None for r in rules if fit(t, r))


def found(spark, texts, rules):
    docs = spark.createDataFrame([(i, t, "x") for i, t in texts], "doc_id long, text string, rule string").repartition(3)
    return sorted((r.doc_id, r.rule) for r in catalogs.match(docs, spark.createDataFrame(rules, catalogs.RULE_DDL)).collect())


def test_fixed_lists():
    rules = catalogs.fixed_rules()
    assert len({r[0] for r in rules}) == len(rules)
    kinds = [sum(r[0].startswith("N") and r[4] is not None for r in rules), sum(r[2] == "document" for r in rules), sum("." in r[0] and r[4] is None and ":" not in r[0] for r in rules)]
    assert kinds == [200, 30, 180]
    assert all(r[6] for r in rules)
    by = {r[0]: r for r in rules}
    assert by["N001"][4:6] == (5, ["MO"]) and by["service-capacity.01"][6] == [["aba"], ["waitlist"]] and by["community-context.03"][3]


def test_all_fixed_rules_on_made_texts(spark):
    """Texts made of the rules' own words, in all cases, glued and cut: found are the pairs that fit."""
    rng = random.Random(3)
    rules = catalogs.fixed_rules()
    words = sorted({w for r in rules for g in r[6] for w in g})
    texts = []
    for i in range(400):
        parts = [rng.choice(words) for _ in range(rng.randint(1, 9))]
        text = rng.choice([" ", "  ", "\n", ", ", ""]).join(parts)
        texts.append((i, rng.choice([text, text.upper(), text.title(), f"x{text}y"])))
    texts += [(1000 + k, " and ".join(w for g in r[6] for w in g[:1])) for k, r in enumerate(rules)]
    texts += [(5000, ""), (5001, None), (None, "aba waitlist"), (7, "aba waitlist"), (7, "aba waitlist"), (5002, "aba " * 50_000 + "waitlist")]
    got, want = found(spark, texts, rules), pairs(texts, rules)
    assert got == want and len(want) > 1500


def test_short_words_ties_and_no_match(spark):
    rules = [("a", "", "", False, None, [], [["c"]], []), ("b", "", "", False, None, [], [["zz", "b c"], ["a"]], []), ("none", "", "", False, None, [], [["a"], ["qqqq"]], []), ("same", "", "", False, None, [], [["a"], ["a"]], []), ("p", "", "", False, None, [], [["ab"]], ["^ab$"])]
    texts = [(i, "".join(x)) for i, x in enumerate(itertools.product("abc z", repeat=4))]
    assert found(spark, texts, rules) == pairs(texts, rules)
    assert found(spark, [], rules) == [] and found(spark, texts, []) == []


def test_groups_of_patterns_are_needed():
    """What a parser's groups ask for is in every text that its pattern fits."""
    rng = random.Random(5)
    for name, _, _, _, _, _, words, (pattern,) in (r for r in catalogs.fixed_rules() if r[2] == "document"):
        groups = re.findall(r"\(\?:((?:[^()]|\(\?:[^()]*\)\??)*)\)(?!\?)", pattern)
        assert len(words) >= 2, name
        for _ in range(30):
            parts = [re.sub(r"\(\?:([^()]*)\)\?|\\s\?|(.)\?", lambda m: rng.choice([m[1] or m[2] or " ", ""]), rng.choice(re.split(r"\|(?![^(]*\))", g))) for g in groups]
            text = " then ".join(parts)
            if re.search(pattern, text):
                assert all(any(w in text.lower() for w in g) for g in words), (name, text)


def test_signals_need_every_term_as_whole_words(spark):
    rules = [r for r in catalogs.fixed_rules() if r[0] in ("N001", "N002", "N006", "N013")]
    texts = [(1, "First Steps, early intervention"), (2, "first steps"), (3, "tiny-k!"), (4, "tiny-kids"), (5, "Part C of early intervention"), (6, "party c early intervention"), (7, "the children’s services fund")]
    docs = spark.createDataFrame(texts, "doc_id long, text string").withColumn("text", catalogs.narrowing_text("text"))
    assert sorted((r.doc_id, r.rule) for r in catalogs.match(docs, spark.createDataFrame(rules, catalogs.RULE_DDL)).collect()) == [(1, "N001"), (3, "N002"), (5, "N006"), (7, "N013")]


def test_fit(spark):
    rows = [(1, "a", "x", 5), (1, "b", "x", 3), (1, "c", "x", 6), (1, "a", "x", 5), (1, "d", "y", 1), (2, "a", "x", 5)]
    got = {r.doc_id: (r.fit, r.signals, r.dimensions, r.bonus) for r in catalogs.narrowing_fit(spark.createDataFrame(rows, "doc_id long, rule string, grp string, weight int"), "doc_id").collect()}
    assert got == {1: (45.0, 4, 2, 11), 2: (25.0, 1, 1, 6)}


def test_few_words_go_to_the_texts_and_many_to_the_vocabulary(spark):
    """Both ways find the pairs that fit; a catalog of few words moves no text between tasks."""
    rng = random.Random(7)
    rules = [(f"r{k}", "", "", False, None, [], [[rng.choice(["é", "ab", "ab c", "xyz q", "éab", "a'b"]) for _ in range(rng.randint(1, 3))] for _ in range(rng.randint(1, 3))], rng.choice([[], ["(?i)b "]])) for k in range(80)]
    texts = [(i, "".join(rng.choice(["É", "ab", " ", "c", " ", "xyz", "Q", "a'B", "\u0085", "\n"]) for _ in range(rng.randint(0, 12)))) for i in range(300)] + [(900, "x" * 5000 + "ab c"), (901, None), (None, "ab")]
    docs = spark.createDataFrame(texts, "doc_id long, text string").repartition(3)
    table = spark.createDataFrame(rules, catalogs.RULE_DDL)
    want = pairs(texts, rules)
    for few in (0, 1000):
        assert sorted((r.doc_id, r.rule) for r in catalogs.match(docs, table, few=few).collect()) == want
    assert len(want) > 1000
    plain = spark.createDataFrame(texts, "doc_id long, text string")
    assert "Exchange" not in catalogs.match(plain, table)._jdf.queryExecution().executedPlan().toString()


def test_a_handful_of_words_is_tried_without_python(spark):
    """A very small catalog finds what the look-up of tokens finds, but texts don't leave Spark for it."""
    rng = random.Random(8)
    rules = [(f"r{k}", "", "", False, None, [], [[rng.choice(["é", "ab", "ab c", "xyz q", "a'b"]) for _ in range(rng.randint(1, 2))] for _ in range(rng.randint(1, 2))], rng.choice([[], ["(?i)b "], ["(?i)b ", "c"]])) for k in range(12)]
    texts = [(i, "".join(rng.choice(["É", "ab", " ", "c", " ", "xyz", "Q", "a'B", "\u0085", "\n"]) for _ in range(rng.randint(0, 12)))) for i in range(300)] + [(7, "ab c"), (7, "ab c"), (901, None), (None, "ab")]
    docs, table = spark.createDataFrame(texts, "doc_id long, text string"), spark.createDataFrame(rules, catalogs.RULE_DDL)
    want = pairs(texts, rules)
    plans = []
    for tried in (0, catalogs.TRIED):
        got = catalogs.match(docs, table, tried=tried)
        assert sorted((r.doc_id, r.rule) for r in got.collect()) == want
        plans.append(got._jdf.queryExecution().executedPlan().toString())
    assert len(want) > 300 and ["Python" in p for p in plans] == [True, False]
    assert catalogs.match(docs, table.limit(0)).collect() == []
