"""Secret scan: candidate strings by shape, then a random forest that removes false positives.

Only DataFrame functions and the JVM's forest run on the rows. Features of a candidate: its length, class transitions and
entropy; how much of it the dictionary's four-letter runs cover; hints in the path that the text came from; and the words
around it. The forest learns from labelled findings, of which a bounded sample is used.

Defined cases: null and empty texts have no candidates; null ids and repeated rows are scanned like others, a row for each
candidate; a null path has no hints; without labelled findings of both classes every candidate gets the share of secrets
among them (one half if there are none); an empty table gives no rows; extra columns are left alone; texts are read whole.
Results hold digests of candidates, never the candidates.
"""

from __future__ import annotations

import json
from functools import reduce

from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldglass.llm.common import fold_remainder, join_counted, materialize
from fieldglass.llm.rules import let

#: Sixteen or more characters of a key's alphabet, with a digit or a change from lower to upper case.
CANDIDATE = r"(?<![A-Za-z0-9+/_=-])(?=[A-Za-z+/_=-]*+[0-9]|[A-Za-z+/_=-]*?[a-z][A-Z])[A-Za-z0-9+/_=-]{16,}+"
ASSIGNED = r"(?i)(secret|token|passw|passphrase|api.?key|access.?key|auth|credential|bearer|private)"
HARMLESS = r"(?i)(example|sample|dummy|test|placeholder|order|card|phone|isbn|invoice)"
FEATURES = ("length", "lower", "upper", "digits", "others", "transitions", "distinct", "entropy", "hex", "covered", "path_depth", "path_harmless", "path_config", "assigned_before", "assigned_inside", "harmless_near", "quoted", "equals_before")


def candidates(docs: DataFrame, path_col: str = "source") -> DataFrame:
    """A row for each candidate: doc_id, path, position (of its word), k (within its word), the candidate and its surroundings."""
    own = docs.select("doc_id", F.col(path_col).cast("string").alias("path"), "text").where(F.col("text").rlike(CANDIDATE))
    flat = F.regexp_replace("text", r"[\x09-\x0D]", " ")

    def around(w: Column) -> Column:
        near = lambda i: F.coalesce(F.get(w, i), F.lit(""))
        hits = F.transform(w, lambda x, i: F.when((F.length(x) >= 16) & x.rlike(CANDIDATE), i))
        return F.transform(
            F.filter(hits, lambda i: i.isNotNull()),
            lambda i: F.struct(i.cast("long").alias("position"), F.get(w, i).alias("word"), F.concat_ws(" ", near(i - 3), near(i - 2), near(i - 1)).alias("before"), near(i + 1).alias("after")),
        )

    found = own.select("doc_id", "path", F.inline(let(F.filter(F.split(flat, " "), lambda x: x != ""), around)))
    return found.select("doc_id", "path", "position", "word", "before", "after", F.posexplode(F.regexp_extract_all("word", F.lit(CANDIDATE), F.lit(0))).alias("k", "candidate"))


def runs_of_four(words: list[str], at_least: int = 3) -> list[str]:
    """The runs of four letters that so many words have."""
    seen: dict[str, int] = {}
    for w in words:
        for run in {w[i : i + 4] for i in range(len(w) - 3)}:
            seen[run] = seen.get(run, 0) + 1
    return sorted(k for k, n in seen.items() if n >= at_least)


def dictionary(spark: SparkSession, vocabulary_path: str) -> DataFrame:
    """Four-letter runs of a tokenizer's lower-case words; its size is bounded by the vocabulary's."""
    with open(vocabulary_path, encoding="utf-8") as f:
        vocabulary = json.load(f)["model"]["vocab"]
    words = [w for w in (t.lstrip("Ġ") for t in vocabulary) if w.isascii() and w.isalpha() and w.islower() and len(w) >= 4]
    return spark.createDataFrame([(r,) for r in runs_of_four(words)], "run string")


def with_features(found: DataFrame, runs: DataFrame) -> DataFrame:
    c, word = F.col("candidate"), F.col("word")
    count = lambda x, pattern: F.regexp_count(x, F.lit(pattern)).cast("double")
    flag = lambda x, pattern: F.coalesce(x.rlike(pattern), F.lit(False)).cast("double")
    strings = found.select("candidate").distinct()
    fours = strings.select("candidate", F.explode_outer(F.regexp_extract_all(F.lower("candidate"), F.lit("(?=([a-z]{4}))"), F.lit(1))).alias("run"))
    known = F.broadcast(runs.withColumn("known", F.lit(1)))
    covered = fours.join(known, "run", "left").groupBy("candidate").agg((F.count("known") / F.length("candidate")).alias("covered"))
    covered = covered.join(found.groupBy("candidate").agg(F.count(F.lit(1)).alias("n")), "candidate")
    length = F.length(c).cast("double")
    share = lambda x: (F.length(c) - F.length(F.replace(c, x, F.lit("")))) / F.length(c)
    chars = F.array_distinct(F.filter(F.split(c, ""), lambda x: x != ""))
    before = F.expr("substring_index(word, candidate, 1)")
    path = F.coalesce("path", F.lit(""))
    numbers = {
        "length": length,
        "lower": count(c, "[a-z]") / length,
        "upper": count(c, "[A-Z]") / length,
        "digits": count(c, "[0-9]") / length,
        "others": count(c, "[^A-Za-z0-9]") / length,
        "transitions": reduce(Column.__add__, (count(c, p) for p in ("(?<=[a-z])[^a-z]", "(?<=[A-Z])[^A-Z]", "(?<=[0-9])[^0-9]"))) / length,
        "distinct": F.size(chars) / length,
        "entropy": F.aggregate(chars, F.lit(0.0), lambda a, x: a - share(x) * F.log2(share(x))),
        "hex": flag(c, "^[0-9a-fA-F]+$"),
        "path_depth": count(path, "/"),
        "path_harmless": flag(path, r"(?i)(test|example|sample|fixture|docs?)(/|\.|$)"),
        "path_config": flag(path, r"(?i)(config|\.env|secret|credential|\.pem|\.ya?ml|\.ini)"),
        "assigned_before": flag(F.col("before"), ASSIGNED),
        "assigned_inside": flag(word, ASSIGNED),
        "harmless_near": flag(F.concat_ws(" ", "before", "after"), HARMLESS),
        "quoted": flag(before, "[\"'`]$"),
        "equals_before": flag(F.concat_ws(" ", "before", before), r"[=:]\s*[\"'`]?$"),
    }
    return join_counted(found.withColumns(numbers), covered, ["candidate"], found.count()).drop("n")


#: Kinds of planted findings, secrets (1) and what only looks like one (0), as SQL over h, 64 hexadecimal digits, b, 43 letters
#: and digits, and w, words of the text.
KINDS = {
    "issued": (1, "concat('AKIA', upper(substr(b, 1, 16)))"),
    "hex": (1, "substr(h, 1, 32)"),
    "mixed": (1, "substr(b, 1, 40)"),
    "prefixed": (1, "concat('ghp_', substr(b, 1, 36))"),
    "short": (1, "substr(b, 1, 20)"),
    "checksum": (0, "substr(h, 1, 40)"),
    "uuid": (0, "concat_ws('-', substr(h, 1, 8), substr(h, 9, 4), substr(h, 13, 4), substr(h, 17, 4), substr(h, 21, 12))"),
    "number": (0, "substr(translate(h, 'abcdef', '123456'), 1, 16)"),
    "identifier": (0, "concat(array_join(transform(w, x -> initcap(x)), ''), 'Handler2')"),
    "slug": (0, "concat(array_join(w, '-'), '-2024')"),
}
#: What stands before and after a planted finding: contexts of secrets, of harmless strings, and of either.
SECRET_CONTEXTS = (("token =", ""), ("password=", ""), ("api_key:", ""), ("secret:", "for login"), ("export ACCESS_KEY=", ""), ("credential", "expires"))
HARMLESS_CONTEXTS = (("checksum", "matches"), ("commit", "by"), ("order", "shipped"), ("see", "below"), ("id", "of the record"), ("sha256", ""))
EITHER_CONTEXTS = (("key =", ""), ("value", "here"), ("", ""), ("config", "= set"))


def planted_findings(docs: DataFrame, most: int = 4000) -> DataFrame:
    """Texts with one planted string each, its kind and label: where a corpus has no reviewed findings, these train the forest.

    The words around and the path are the corpus's own; most bounds the sample, the smallest hashes of the ids. A label
    depends on the kind alone, a context on the label in three of four cases, so neither gives the other away.
    """
    keyed = docs.where(F.col("doc_id").isNotNull() & F.col("text").isNotNull()).select("doc_id", "text", "source", F.xxhash64("text").alias("key"))
    # Ids are picked first, `most` of them; only their texts are fetched.
    ids = keyed.select("doc_id", "key").orderBy(F.xxhash64("doc_id", F.lit(21)), "doc_id", "key").limit(most).distinct()
    picked = keyed.join(F.broadcast(ids), ["doc_id", "key"]).select("doc_id", "text", "source")
    names = sorted(KINDS)
    of = lambda salt, n: F.pmod(F.xxhash64("doc_id", F.lit(salt)), F.lit(n)).cast("int")
    h = F.sha2(F.concat(F.lit("planted "), F.col("doc_id").cast("string")), 256)
    b = F.translate(F.base64(F.unhex(F.sha2(F.reverse(h), 256))), "+/=", "Kx7")
    words = F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda x: x.rlike("^[A-Za-z]{4,12}$"))
    rows = picked.withColumns({"h": h, "b": b, "w": F.slice(F.concat(words, F.array(F.lit("plain"), F.lit("words"), F.lit("only"))), 1, 3), "kind": F.get(F.array(*map(F.lit, names)), of(22, len(names)))})
    by_kind = lambda f: reduce(lambda out, k: F.when(F.col("kind") == k, f(k)).otherwise(out), names, F.lit(None))
    rows = rows.withColumns({"label": by_kind(lambda k: F.lit(KINDS[k][0])).cast("int"), "planted": by_kind(lambda k: F.expr(KINDS[k][1]))})
    pick = lambda group, salt: F.get(F.array(*(F.struct(F.lit(x).alias("before"), F.lit(y).alias("after")) for x, y in group)), of(salt, len(group)))
    context = F.when(of(23, 4) == 0, pick(EITHER_CONTEXTS, 24)).when(F.col("label") == 1, pick(SECRET_CONTEXTS, 25)).otherwise(pick(HARMLESS_CONTEXTS, 26))
    glue = F.when(F.col("context.before").endswith("="), "").otherwise(" ")
    text = F.concat(F.array_join(F.slice(words, 4, 6), " "), F.lit(" "), F.col("context.before"), glue, "planted", F.lit(" "), F.col("context.after"), F.lit(" "), F.array_join(F.slice(words, 10, 6), " "))
    return rows.withColumn("context", context).withColumn("text", text).select("doc_id", "text", "source", "kind", "label", "planted")


def labelled(planted: DataFrame, runs: DataFrame) -> DataFrame:
    """The planted strings as candidates with features, kind and label. planted: doc_id (unique), text, source, kind, label, planted."""
    planted = materialize(planted, "planted")
    found = materialize(candidates(planted).join(planted.select("doc_id", "kind", "label", "planted"), "doc_id").where(F.col("candidate").endswith(F.col("planted"))), "planted-candidates")
    return with_features(found, runs)


def fit(labelled: DataFrame, max_rows: int = 20_000, trees: int = 24, depth: int = 6, seed: int = 5):
    """A forest, or the share of secrets where there is one class at most. max_rows bounds the sample: the smallest hashes."""
    rows = labelled.where("label is not null").select("label", *FEATURES, "candidate").orderBy(F.xxhash64("candidate"), "candidate", *FEATURES).limit(max_rows)
    rows = materialize(rows.repartition(1).sortWithinPartitions(F.xxhash64("candidate"), "candidate", *FEATURES), "findings")
    by = {r["label"]: r["count"] for r in rows.groupBy("label").count().collect()}
    if len(by) < 2:
        return 0.5 if not by else float(next(iter(by)))
    ready = VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(rows)
    return RandomForestClassifier(labelCol="label", featuresCol="features", numTrees=trees, maxDepth=depth, seed=seed, featureSubsetStrategy="sqrt").fit(ready)


def score(found: DataFrame, model) -> DataFrame:
    """Adds `probability` of being a secret."""
    if isinstance(model, float):
        return found.withColumn("probability", F.lit(model))
    ready = VectorAssembler(inputCols=list(FEATURES), outputCol="__features").transform(found)
    model.setFeaturesCol("__features").setProbabilityCol("__probability").setRawPredictionCol("").setPredictionCol("")
    return model.transform(ready).withColumn("probability", F.round(vector_to_array("__probability")[1], 9)).drop("__features", "__probability")


def op2(docs: DataFrame, vocabulary_path: str | None = None, threshold: float = 0.5, findings: DataFrame | None = None) -> DataFrame:
    """The findings of all documents. findings: reviewed ones, as `labelled` takes them; without, planted ones train the forest, in documents with crc32(doc_id) mod 5 other than 0."""
    import public_tokenizers

    runs = dictionary(docs.sparkSession, vocabulary_path or public_tokenizers.path("byte_bpe_50k.json"))
    found = materialize(with_features(materialize(candidates(docs), "candidates"), runs), "candidate-features")
    if findings is None:
        findings = planted_findings(docs.where(F.coalesce(fold_remainder(F.col("doc_id")), F.lit(1)) != 0))
    out = score(found, fit(labelled(findings.dropDuplicates(["doc_id"]), runs)))
    return out.select("doc_id", "position", F.col("k").cast("int").alias("k"), F.sha2(F.col("candidate").cast("binary"), 256).alias("candidate_sha256"), F.col("length").cast("int").alias("length"), "probability", (F.col("probability") >= threshold).alias("is_secret"))
