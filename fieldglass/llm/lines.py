"""Line dedup by alignment: documents that share rare lines are aligned by patience diff, and the later loses common blocks.

Lines are compared by two hashes: one finds pairs, the other aligns them. What is aligned is hashes of lines; texts meet
only the numbers of their own removed lines. Decisions are made on the input, not on what earlier removals leave.

The result is that of aligning each document with every earlier one, for lines of any frequency. A block that goes holds a
run of consecutive lines that just reaches min_words, so only documents that share such a run meet. Equal documents are
aligned once. A run that `rare` documents or fewer have pairs all of them; of a more frequent one, each document meets the
first holder and then ever larger shares of the others, until its lines in that run are gone or all earlier holders are
tried. `rare` decides what is tried first and never the result.

Defined cases: null texts stay null and empty texts empty; lines without a word are never compared and stay; documents
with a null id stay as they are; rows of one id are not compared with each other, and each of them loses its own lines;
blocks of fewer words than min_words stay; an empty table gives no rows; extra columns are left alone; texts are read whole.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldglass.llm.common import WORD, bounded_batches, columns_of, join_counted, materialize, mix, starts_of
from fieldglass.llm.rules import let


def _anchors(a: Sequence, a0: int, a1: int, b: Sequence, b0: int, b1: int) -> list[tuple[int, int]]:
    """The longest increasing run of lines that occur once in either part."""
    once = lambda x, lo, hi: {k: None for k, n in Counter(x[lo:hi]).items() if n == 1}
    common = once(a, a0, a1).keys() & once(b, b0, b1).keys()
    where = {b[j]: j for j in range(b0, b1) if b[j] in common}
    pairs = [(i, where[a[i]]) for i in range(a0, a1) if a[i] in common]
    tails: list[int] = []
    at: list[int] = []
    back: list[int] = []
    for n, (_, j) in enumerate(pairs):
        k = bisect_left(tails, j)
        back.append(at[k - 1] if k else -1)
        tails[k : k + 1], at[k : k + 1] = [j], [n]
    out, n = [], at[-1] if at else -1
    while n >= 0:
        out.append(pairs[n])
        n = back[n]
    return out[::-1]


def patience(a: Sequence, b: Sequence) -> list[tuple[int, int]]:
    """Aligned positions of equal lines: equal ends, then unique common lines, then the same between them."""
    out: list[tuple[int, int]] = []
    todo = [(0, len(a), 0, len(b))]
    while todo:
        a0, a1, b0, b1 = todo.pop()
        while a0 < a1 and b0 < b1 and a[a0] == b[b0]:
            out.append((a0, b0))
            a0, b0 = a0 + 1, b0 + 1
        while a0 < a1 and b0 < b1 and a[a1 - 1] == b[b1 - 1]:
            a1, b1 = a1 - 1, b1 - 1
            out.append((a1, b1))
        if a0 < a1 and b0 < b1:
            found = _anchors(a, a0, a1, b, b0, b1)
            if found:
                ends = [(a0 - 1, b0 - 1), *found, (a1, b1)]
                out += found
                todo += [(i + 1, k, j + 1, m) for (i, j), (k, m) in zip(ends, ends[1:], strict=False) if i + 1 < k and j + 1 < m]
    return sorted(out)


def common_blocks(later: Sequence, earlier: Sequence, words: Sequence[int], min_words: int) -> list[int]:
    """Positions in `later` of aligned blocks with min_words or more words."""
    out: list[int] = []
    block: list[tuple[int, int]] = []
    for pair in [*patience(later, earlier), (-9, -9)]:
        if block and (pair[0] != block[-1][0] + 1 or pair[1] != block[-1][1] + 1):
            if sum(words[i] for i, _ in block) >= min_words:
                out += [i for i, _ in block]
            block = []
        block.append(pair)
    return out


def line_table(docs: DataFrame) -> DataFrame:
    """doc_id, a hash of the text, and its lines that have words, as position, two hashes and words."""
    text = F.coalesce("text", F.lit(""))
    lines = F.filter(
        F.transform(F.split(text, "\n"), lambda x, i: F.struct(i.alias("i"), F.xxhash64(x).alias("find"), F.xxhash64(x, F.lit(1)).alias("same"), F.regexp_count(x, F.lit(WORD)).alias("words"))),
        lambda x: x["words"] > 0,
    )
    out = docs.where(F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_key"), lines.alias("lines"))
    return out.where(F.size("lines") > 0)


def _runs(lines: DataFrame, min_words: int) -> DataFrame:
    """u, doc_id and the runs of lines that reach min_words from their first or from their last line: key, from `s` to before `t`."""
    least = max(1, min_words)
    factor = np.uint64(0x9E3779B97F4A7C15)
    inverse = np.uint64(pow(int(factor), -1, 1 << 64))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size = batch.column(2).value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
            same = mix(batch.column(2).flatten().to_numpy(zero_copy_only=False).view(np.uint64))
            words = np.concatenate([[0], np.cumsum(batch.column(3).flatten().to_numpy(zero_copy_only=False).astype(np.int64))])
            row = np.repeat(np.arange(len(size)), size)
            first, n = starts_of(size)[row], len(row)
            here = np.arange(n)
            ends = np.searchsorted(words, words[:-1] + least)
            starts = np.searchsorted(words, words[1:] - least, "right") - 1
            ok, back = ends <= first + size[row], starts >= first
            s, t, r = np.concatenate([here[ok], starts[back]]), np.concatenate([ends[ok], here[back] + 1]), np.concatenate([row[ok], row[back]])
            powers = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(n, factor, np.uint64)]))
            down = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(n, inverse, np.uint64)]))
            sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(same * powers[:-1])])
            key = mix((sums[t] - sums[s]) * down[s] + (t - s).astype(np.uint64)).view(np.int64)
            at = starts_of(size)[r]
            once = np.unique(s * (n + 1) + t, return_index=True)[1]
            ids = [pa.array(batch.column(k).to_numpy(zero_copy_only=False)[r[once]], pa.int64()) for k in (0, 1)]
            yield pa.RecordBatch.from_arrays([*ids, pa.array(key[once]), *(pa.array((x - at)[once].astype(np.int32)) for x in (s, t))], names=["u", "doc_id", "key", "s", "t"])

    return lines.select("u", "doc_id", "same", "words").mapInArrow(run, "u long, doc_id long, key long, s int, t int")


def _aligned(pairs: DataFrame, lists: DataFrame, min_words: int, crowd: int = 1000) -> DataFrame:
    """u and the places `k` in its list that alignment of d_u with e_u removes.

    pairs: d_u, e_u and n, at least how many pairs the e_u may have. A list that many others meet is dealt to a power of two of
    parts, about `crowd` pairs each, so no task gets all of them.
    """
    parts = F.pow(F.lit(2.0), F.ceil(F.log2(F.greatest(F.col("n") / crowd, F.lit(1.0))))).cast("long")
    dealt = pairs.groupBy("d_u", "e_u").agg(F.max("n").alias("n")).withColumn("parts", parts).withColumn("part", F.pmod(F.xxhash64("d_u"), F.col("parts")))
    dealt = materialize(dealt.select("d_u", "e_u", "parts", "part"), "line-pairs")
    a = lists.select(F.col("u").alias("d_u"), F.col("same").alias("d_same"), F.col("words").alias("d_words"))
    b = lists.select(F.col("u").alias("e_u"), F.col("same").alias("e_same")).join(dealt.select("e_u", "parts", "part").distinct(), "e_u")
    both = dealt.join(b, ["e_u", "parts", "part"]).join(a, "d_u").select("d_u", "d_same", "d_words", "e_same")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            us, ks = [], []
            for u, d_same, d_words, e_same in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                found = common_blocks(d_same, e_same, d_words, min_words)
                us += [u] * len(found)
                ks += found
            yield pa.RecordBatch.from_arrays([pa.array(us, pa.int64()), pa.array(ks, pa.int32())], names=["u", "k"])

    return both.mapInArrow(run, "u long, k int").distinct()


def removed_lines(docs: DataFrame, min_words: int = 8, rare: int = 6) -> DataFrame:
    """doc_id, text_key and the sorted positions of the lines that the text loses; only texts that lose some."""
    bounded_batches(docs.sparkSession)
    part = lambda name: F.transform("lines", lambda x: x[name])
    lines = line_table(docs).select("doc_id", "text_key", part("same").alias("same"), part("i").alias("i"), part("words").alias("words"), F.xxhash64(part("same"), part("find")).alias("u"))
    lines = materialize(lines, "lines")
    lists = lines.select("u", "same", "words").distinct()
    runs = materialize(_runs(lines, min_words), "runs")

    has = materialize(runs.groupBy("key", "u").agg(F.min("doc_id").alias("d")), "run-holders")
    known = has.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("d", "u")).alias("first")).where(F.col("n") > 1)
    shared = materialize(join_counted(has, known, ["key"], has.count()).select("key", "u", "d", "n", F.col("first.d").alias("f_d"), F.col("first.u").alias("f_u")), "shared-runs")
    few = shared.where(F.col("n") <= rare)
    side = lambda df, x: df.select("key", F.col("u").alias(f"{x}_u"), F.col("d").alias(x))
    every = side(few, "d").join(side(few, "e"), "key").where(F.col("e") < F.col("d")).select("d_u", "e_u", F.lit(rare).cast("long").alias("n"))
    star = shared.where((F.col("n") > rare) & (F.col("f_d") < F.col("d"))).select(F.col("u").alias("d_u"), F.col("f_u").alias("e_u"), "n")
    gone = materialize(_aligned(star.unionByName(every), lists, min_words), "removed")

    many = shared.where(F.col("n") > rare)
    left = runs.join(many.where(F.col("f_d") < F.col("d")).select("key", "u", "d"), ["key", "u"]).select("key", "u", "d", "s", "t").distinct()
    share = F.pmod(F.xxhash64("key", "u"), F.lit(1 << 30)) / float(1 << 30)
    holders = many.withColumn("turn", F.greatest(F.lit(1), F.ceil(F.log(8.0, share * F.col("n")))))
    last = many.agg(F.ceil(F.log(8.0, F.max("n").cast("double")))).first()[0] or 0
    for turn in range(1, int(last) + 1):
        lost = gone.groupBy("u").agg(F.collect_set("k").alias("ks"))
        left = left.join(lost, "u", "left").where(F.col("ks").isNull() | (F.size(F.array_except(F.sequence("s", F.col("t") - 1), "ks")) > 0)).drop("ks")
        left = materialize(left, "open-runs")
        if left.isEmpty():
            break
        open_now = left.groupBy("key").agg(F.count_distinct("u").alias("n"))
        tried = side(left.select("key", "u", "d").distinct(), "d").join(side(holders.where(F.col("turn") == turn), "e").join(open_now, "key"), "key").where(F.col("e") < F.col("d")).select("d_u", "e_u", "n")
        gone = materialize(gone.unionByName(_aligned(tried, lists, min_words)).distinct(), "removed")

    first = lines.groupBy("u").agg(F.min("doc_id").alias("d"), F.max("doc_id").alias("last"))
    lost = gone.groupBy("u").agg(F.sort_array(F.collect_list("k")).alias("ks"))
    wanted = first.join(lost, "u", "left").where(F.col("ks").isNotNull() | (F.col("last") > F.col("d")))
    total = F.aggregate("words", F.lit(0), lambda x, y: x + y)
    removed = F.when(F.col("doc_id") == F.col("d"), F.transform("ks", lambda k: F.get("i", k))).when(total >= min_words, F.col("i"))
    rows = lines.select("doc_id", "text_key", "u", "i", "words").join(wanted, "u").select(F.col("doc_id").alias("__id"), F.col("text_key").alias("__text"), removed.alias("__removed"))
    return rows.where(F.col("__removed").isNotNull()).groupBy("__id", "__text").agg(F.any_value("__removed").alias("__removed"))


def without_common_lines(docs: DataFrame, min_words: int = 8, rare: int = 6, into: str = "text") -> DataFrame:
    """docs with the text after removal, and `__removed`, the positions of the removed lines (null if none)."""
    found = removed_lines(docs.select("doc_id", "text"), min_words, rare)
    out = docs.join(found, (F.col("doc_id").cast("long") == F.col("__id")) & (F.xxhash64("text") == F.col("__text")), "left").drop("__id", "__text")
    kept = F.array_join(let(F.split("text", "\n"), lambda x: F.transform(F.array_except(F.sequence(F.lit(0), F.size(x) - 1), "__removed"), lambda i: F.get(x, i))), "\n")
    return out.withColumn(into, F.when(F.col("__removed").isNull(), F.col("text")).otherwise(kept))


def dedup_lines(docs: DataFrame, min_words: int = 8, rare: int = 6) -> DataFrame:
    """The documents with what is left of their texts and n_chars to match; those that lose every word go."""
    out = without_common_lines(docs, min_words, rare).where(F.col("__removed").isNull() | F.col("text").rlike(r"[^\x20\x09-\x0D]"))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col("__removed").isNull(), F.col("n_chars")).otherwise(F.length("text").cast(docs.schema["n_chars"].dataType)))
    return out.select(*columns_of(docs))


def op10(docs: DataFrame) -> DataFrame:
    out = without_common_lines(docs.select("doc_id", "text"), into="kept")
    return out.select(
        "doc_id",
        F.size(F.split(F.coalesce("text", F.lit("")), "\n")).cast("long").alias("n_lines"),
        F.coalesce(F.size("__removed"), F.lit(0)).cast("long").alias("n_removed"),
        F.array_join(F.transform("__removed", lambda i: i.cast("string")), ",").alias("removed"),
        F.sha2(F.coalesce("kept", F.lit("")).cast("binary"), 256).alias("kept_sha256"),
    )
