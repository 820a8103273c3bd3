"""Substring dedup by recompression: every word that a repeated window of words covers is removed, exactly.

1. Five rounds of recompression (`recompress`) turn each text into symbols whose names are the same wherever the words are,
   away from the ends. Names meet in blocks, and every name that occurs once rules out the windows that contain its symbol:
   a window that starts anywhere else would have brought it along.
2. The windows left (few more than the repeated ones, and all that hold no whole symbol) are named by two hashes of their
   words and counted, in blocks again; those with another start are repeated.
3. A text loses the words that its repeated windows cover.

Texts that occur twice or more have only repeated windows, so one of each stands for all, counted double. What Spark
shuffles is packed numbers, a few rows for each chunk of documents and block; texts are read again rather than moved.

Defined cases: null and empty texts have no words; texts shorter than the window lose nothing; null ids and repeated rows
are rows of their own, so a long text that is there twice loses every word in both; an empty table gives no rows; extra
columns are left alone; texts are read whole. Windows are judged on the input, not on what is left.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldglass.llm.common import blocks_for, bounded_batches, join_counted, materialize, window_hash
from fieldglass.llm.recompress import symbols

ROUNDS = 5
_DEALT = pa.schema([("block", pa.int32()), ("chunk", pa.string()), ("kind", pa.int32()), ("data", pa.binary()), ("more", pa.binary()), ("place", pa.binary())])
_DEALT_DDL = "block int, chunk string, kind int, data binary, more binary, place binary"
_FACTS = np.dtype([("doc_id", "<i8"), ("known", "?"), ("key", "<i8"), ("a", "<i8"), ("b", "<i8"), ("n", "<i4"), ("sha", "V32")])
_STATE = pa.schema([("doc_id", pa.int64()), ("key", pa.int64()), ("text_a", pa.int64()), ("text_b", pa.int64()), ("n_words", pa.int32()), ("sha", pa.binary()), ("spans", pa.binary())])
_STATE_DDL = "doc_id long, key long, text_a long, text_b long, n_words int, sha binary, spans binary"
_WANTED = np.dtype([("a", "<i8"), ("b", "<i8"), ("n", "<i4"), ("twice", "?")])
_FOUND = pa.schema([("text_a", pa.int64()), ("text_b", pa.int64()), ("n_removed", pa.int32()), ("removed", pa.binary())])
_FOUND_DDL = "text_a long, text_b long, n_removed int, removed binary"


def _emit(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)


def _table(rows: list[tuple], schema: pa.Schema) -> pa.Table:
    return pa.Table.from_batches([_emit(rows, schema)] if rows else [], schema)


def _task() -> int:
    from pyspark import TaskContext

    return TaskContext.get().partitionId()


def _word_hashes(words: list[bytes]) -> np.ndarray:
    from xxhash import xxh3_64_intdigest

    return np.fromiter(map(xxh3_64_intdigest, words), np.uint64, len(words))


def _text_name(text: bytes) -> tuple[int, int]:
    from xxhash import xxh3_128_digest

    return tuple(np.frombuffer(xxh3_128_digest(text), "<i8").tolist())


def _parts(values: np.ndarray, blocks: int) -> Iterator[tuple[int, np.ndarray]]:
    block = (values % np.uint64(blocks)).astype(np.int64)
    order = np.argsort(block, kind="stable")
    ends = np.cumsum(np.bincount(block, minlength=blocks))
    for b in range(blocks):
        part = order[(ends[b - 1] if b else 0) : ends[b]]
        if len(part):
            yield b, part


def spans_of(mask: np.ndarray) -> np.ndarray:
    """The maximal stretches of true values, as starts and ends in turn."""
    edge = np.diff(np.concatenate([[0], mask.astype(np.int8), [0]]))
    return np.stack([np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)], 1).astype("<i4").ravel()


def _rows(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text").cast("binary"), F.lit(b""))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text")).withColumn("key", F.xxhash64("text"))


def _alone(table: pa.Table) -> pa.Table:
    """For each chunk, the stretches of the symbols whose name occurs once."""
    rows = [tuple(r.values()) for r in table.filter(pa.array(np.array(table.column("kind").to_pylist()) == 1)).to_pylist()]
    held = [r for r in table.to_pylist() if r["kind"] == 0]
    if held:
        names = [np.frombuffer(r["data"], "<u4") for r in held]
        every = np.concatenate(names)
        order = np.argsort(every, kind="stable")
        ordered = every[order]
        once = np.ones(len(every), bool)
        same = ordered[1:] == ordered[:-1]
        once[1:] &= ~same
        once[:-1] &= ~same
        alone = np.empty(len(every), bool)
        alone[order] = once
        at = 0
        for r, own in zip(held, names, strict=True):
            keep = alone[at : at + len(own)]
            at += len(own)
            if keep.any():
                rows.append((0, r["chunk"], 0, None, np.frombuffer(r["more"], np.uint8)[keep].tobytes(), np.frombuffer(r["place"], "<u4")[keep].tobytes()))
    return _table(rows, _DEALT)


def _open_windows(width: int):
    def run(table: pa.Table) -> pa.Table:
        """For each text of a chunk, the spans of window starts that no symbol rules out."""
        rows = table.to_pylist()
        facts = np.frombuffer(next(r["data"] for r in rows if r["kind"] == 1), _FACTS)
        ends = np.cumsum(facts["n"].astype(np.int64))
        total = int(ends[-1]) if len(ends) else 0
        change = np.zeros(total + 1, np.int64)
        for r in rows:
            if r["kind"] == 0:
                lo = np.frombuffer(r["place"], "<u4").astype(np.int64)
                hi = lo + np.frombuffer(r["more"], np.uint8)
                first = np.maximum(hi - width, 0)
                change += np.bincount(first, minlength=total + 1) - np.bincount(lo + 1, minlength=total + 1)
        free = np.cumsum(change)[:-1] == 0
        out = []
        for f, end in zip(facts, ends, strict=True):
            n = int(f["n"])
            spans = spans_of(free[end - n : end - width + 1]) if n >= width else np.empty(0, "<i4")
            out.append((int(f["doc_id"]) if f["known"] else None, int(f["key"]), int(f["a"]), int(f["b"]), n, f["sha"].tobytes(), spans.tobytes() if len(spans) else None))
        return _table(out, _STATE)

    return run


def states(docs: DataFrame, blocks: int, width: int) -> DataFrame:
    """For each row: its id, names of its text, its words, their digest, and the spans of starts of windows that may be repeated."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = _task()
        for k, batch in enumerate(batches):
            if not batch.num_rows:
                continue
            texts = batch.column(1).to_pylist()
            facts = np.zeros(len(texts), _FACTS)
            facts["known"] = batch.column(0).is_valid().to_numpy(zero_copy_only=False)
            facts["doc_id"] = batch.column(0).fill_null(0).to_numpy()
            facts["key"] = batch.column(2).to_numpy()
            hashes = []
            for j, text in enumerate(texts):
                words = text.split()
                facts["a"][j], facts["b"][j] = _text_name(text)
                facts["n"][j] = len(words)
                facts["sha"][j] = np.void(hashlib.sha256(b" ".join(words)).digest())
                hashes.append(_word_hashes(words))
            every = np.concatenate(hashes)
            name, lo, hi = symbols(every, np.repeat(np.arange(len(texts)), facts["n"]), ROUNDS)
            inside = (lo >= 0) & (hi - lo <= width)
            name, lo, size = name[inside], lo[inside].astype("<u4"), (hi - lo)[inside].astype(np.uint8)
            chunk = f"{task}-{k}"
            short = ((name // np.uint64(blocks)) & np.uint64(0xFFFFFFFF)).astype("<u4")
            rows = [(k % blocks, chunk, 1, facts.tobytes(), None, None)]
            rows += [(b, chunk, 0, short[p].tobytes(), size[p].tobytes(), lo[p].tobytes()) for b, p in _parts(name, blocks)]
            yield _emit(rows, _DEALT)

    dealt = _rows(docs).select("doc_id", "text", "key").mapInArrow(run, _DEALT_DDL)
    return dealt.repartition(blocks, "block").groupBy("block").applyInArrow(_alone, _DEALT_DDL).groupBy("chunk").applyInArrow(_open_windows(width), _STATE_DDL)


def _once(table: pa.Table) -> pa.Table:
    """For each chunk, the places of the windows that start nowhere else."""
    rows = [tuple(r.values()) for r in table.to_pylist() if r["kind"] == 1]
    held = [r for r in table.to_pylist() if r["kind"] == 0]
    if held:
        a = np.concatenate([np.frombuffer(r["data"], "<u8") for r in held])
        more = [np.frombuffer(r["more"], np.dtype([("b", "<u4"), ("weight", "u1")])) for r in held]
        b = np.concatenate([x["b"] for x in more])
        weight = np.concatenate([x["weight"] for x in more]).astype(np.int64)
        order = np.lexsort((b, a))
        new = np.ones(len(a), bool)
        new[1:] = (a[order][1:] != a[order][:-1]) | (b[order][1:] != b[order][:-1])
        start = np.flatnonzero(new)
        times = np.repeat(np.add.reduceat(weight[order], start), np.diff(np.append(start, len(a))))
        once = np.empty(len(a), bool)
        once[order] = times == 1
        at = 0
        for r, x in zip(held, more, strict=True):
            keep = once[at : at + len(x)]
            at += len(x)
            if keep.any():
                rows.append((0, r["chunk"], 0, None, None, np.frombuffer(r["place"], "<u4")[keep].tobytes()))
    return _table(rows, _DEALT)


def _covered(width: int):
    def run(table: pa.Table) -> pa.Table:
        """For each text of a chunk, the spans of words that repeated windows cover."""
        rows = table.to_pylist()
        own = next(r for r in rows if r["kind"] == 1)
        facts, spans = np.frombuffer(own["data"], _WANTED), np.frombuffer(own["place"], "<i4")
        sizes = np.frombuffer(own["more"], "<i4")
        total = int(facts["n"].astype(np.int64).sum())
        repeated = np.zeros(total + 1, np.int64)
        base, at = 0, 0
        for f, size in zip(facts, sizes, strict=True):
            part = spans[at : at + size].astype(np.int64) + base
            np.add.at(repeated, part[0::2], 1)
            np.add.at(repeated, part[1::2], -1)
            base, at = base + int(f["n"]), at + size
        repeated = np.cumsum(repeated)[:-1] > 0
        for r in rows:
            if r["kind"] == 0:
                repeated[np.frombuffer(r["place"], "<u4")] = False
        starts = np.flatnonzero(repeated)
        change = np.bincount(starts, minlength=total + 1) - np.bincount(starts + width, minlength=total + 1)
        gone = np.cumsum(change)[:-1] > 0
        out, base = [], 0
        for f in facts:
            n = int(f["n"])
            part = gone[base : base + n]
            base += n
            if part.any():
                out.append((int(f["a"]), int(f["b"]), int(part.sum()), None if f["twice"] else spans_of(part).tobytes()))
        return _table(out, _FOUND)

    return run


def _with_texts(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """The rows of docs that wanted names by id and key. They meet by shuffle at any size, so each text moves once and nothing is broadcast that grows."""
    wanted = wanted.withColumnRenamed("doc_id", "__id").withColumnRenamed("key", "__key").hint("merge")
    rows = _rows(docs)
    return rows.join(wanted, (rows["key"] == wanted["__key"]) & rows["doc_id"].eqNullSafe(wanted["__id"]))


def windows(docs: DataFrame, wanted: DataFrame, blocks: int, width: int) -> DataFrame:
    """For each text in wanted that loses words: its name, how many, and which (null if all)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = _task()
        for k, batch in enumerate(batches):
            facts, sizes, spans, hashes, weights, base = [], [], [], [], [], 0
            for text, a, b, twice, open_ in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if _text_name(text) != (a, b):
                    continue
                own = _word_hashes(text.split())
                span = np.frombuffer(open_, "<i4")
                facts.append((a, b, len(own), twice))
                sizes.append(len(span))
                spans.append(span)
                hashes.append(own)
                mask = np.zeros(len(own) + 1, np.int64)
                np.add.at(mask, span[0::2], 1)
                np.add.at(mask, span[1::2], -1)
                weights.append(np.where(np.cumsum(mask)[:-1] > 0, 2 if twice else 1, 0).astype(np.uint8))
                base += len(own)
            if not base:
                continue
            every, weight = np.concatenate(hashes), np.concatenate(weights)
            place = np.flatnonzero(weight).astype("<u4")
            name = window_hash(every, width)[place]
            more = np.empty(len(place), np.dtype([("b", "<u4"), ("weight", "u1")]))
            more["b"], more["weight"] = window_hash(every, width, 9)[place] >> np.uint64(32), weight[place]
            chunk = f"{task}-{k}"
            rows = [(k % blocks, chunk, 1, np.array(facts, _WANTED).tobytes(), np.array(sizes, "<i4").tobytes(), np.concatenate(spans).tobytes())]
            rows += [(b, chunk, 0, name[p].tobytes(), more[p].tobytes(), place[p].tobytes()) for b, p in _parts(name, blocks)]
            yield _emit(rows, _DEALT)

    found = _with_texts(docs, wanted).select("text", "text_a", "text_b", "twice", "spans")
    dealt = found.mapInArrow(run, _DEALT_DDL)
    return dealt.repartition(blocks, "block").groupBy("block").applyInArrow(_once, _DEALT_DDL).groupBy("chunk").applyInArrow(_covered(width), _FOUND_DDL)


def kept_of(docs: DataFrame, partial: DataFrame, texts: bool) -> DataFrame:
    """For each text in partial, the digest of the kept words joined by spaces, and with texts the joined words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text, a, b, removed in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if _text_name(text) == (a, b):
                    words = text.split()
                    for lo, hi in np.frombuffer(removed, "<i4").reshape(-1, 2)[::-1]:
                        del words[lo:hi]
                    kept = b" ".join(words)
                    rows.append((a, b, hashlib.sha256(kept).digest(), kept.decode("utf-8", "replace") if texts else None))
            if rows:
                yield _emit(rows, pa.schema([("text_a", pa.int64()), ("text_b", pa.int64()), ("kept_sha", pa.binary()), ("kept", pa.string())]))

    return _with_texts(docs, partial).select("text", "text_a", "text_b", "removed").mapInArrow(run, "text_a long, text_b long, kept_sha binary, kept string").dropDuplicates(["text_a", "text_b"])


def without_repeats(docs: DataFrame, width: int = 35, texts: bool = False) -> DataFrame:
    """doc_id, n_words, n_removed and kept_sha256 (and with texts, `kept`, null where nothing is removed), a row for each row of docs."""
    if width > 255:
        raise ValueError("a window has 255 words at most")
    spark = docs.sparkSession
    bounded_batches(spark)
    blocks = blocks_for(docs)
    name = ["text_a", "text_b"]
    state = materialize(states(docs, blocks, width), "repeat-states")
    times = state.where(F.col("n_words") >= width).groupBy(*name).agg(F.count(F.lit(1)).alias("rows"), F.min(F.struct("doc_id", "key", "n_words")).alias("first"))
    twice = times.where(F.col("rows") > 1)
    whole = F.concat(_le(F.lit(0)), _le(F.col("first.n_words") - (width - 1)))  # one span: all starts
    several = twice.select("first.doc_id", "first.key", *name, F.lit(True).alias("twice"), whole.alias("spans"))
    single = state.where(F.col("spans").isNotNull()).join(twice.select(*name), name, "left_anti").select("doc_id", "key", *name, F.lit(False).alias("twice"), "spans")
    wanted = materialize(single.unionByName(several), "repeat-wanted")
    found = materialize(windows(docs, wanted, blocks, width).dropDuplicates(name), "repeat-found")
    partial = found.where(F.col("removed").isNotNull()).join(wanted.where(~F.col("twice")).select("doc_id", "key", *name), name)
    kept = kept_of(docs, materialize(partial.select("doc_id", "key", *name, "removed"), "repeat-partial"), texts)
    nothing = F.sha2(F.lit(b""), 256)
    result = found.join(kept, name, "left").select(*name, "n_removed", F.coalesce(F.lower(F.hex("kept_sha")), nothing).alias("kept_sha256"), F.coalesce("kept", F.lit("")).alias("kept"))
    out = state.join(result, name, "left")
    return out.select("doc_id", F.col("n_words").cast("long").alias("n_words"), F.coalesce("n_removed", F.lit(0)).cast("long").alias("n_removed"), F.coalesce("kept_sha256", F.lower(F.hex("sha"))).alias("kept_sha256"), *(["kept"] if texts else []))


def _le(n):
    """The four bytes of a number below 2**31, the lowest first."""
    return F.unhex(F.concat(*(F.lpad(F.hex(F.shiftright(n, 8 * k).bitwiseAND(F.lit(255))), 2, "0") for k in range(4))))


def op7(docs: DataFrame) -> DataFrame:
    return without_repeats(docs)
