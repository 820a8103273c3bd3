"""Cross-tokenizer alignment: which tokens of two vocabularies cover the same bytes, and how often over the corpus.

Everything between the tokenizers and the sums is an Arrow column. A stretch of documents is one flat column of ids with
parent indices; token lengths are looked up and summed within each document, so every token has an end. A hash join on
(document, end) finds where tokens of both end, which cuts groups; a full hash join of the same keys lists all ends, and
between two of them exactly one token of either kind goes on: that pair is a link. Table.group_by counts a stretch's links by
pair of ids, Spark adds up these partial counts for the corpus and joins them back to the stretches' distinct pairs, and each
stretch's documents get the sums over their links.

Two passes read no text twice: the first writes, for each stretch, its documents with their links by pair.

Defined cases: null and empty texts, and texts of which either tokenizer's bytes aren't space and text, have no tokens, zeros
and an empty string for the digest; special tokens' strings are plain text; a null id is kept; repeated rows are documents of
their own, and their links count each; an empty table gives no rows; extra columns are left alone.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldglass.llm.common import id_and_text, join_counted, materialize, slices

_SHIFT = 32
_FACTS = ("n_a", "n_b", "n_groups", "n_links")
#: A stretch: its documents' facts, its distinct pairs of ids (A in the upper half) with counts, and of each document the places
#: of its pairs among these with their counts.
_STRETCH_DDL = "stretch string, doc_id array<long>, n_a array<long>, n_b array<long>, n_groups array<long>, n_links array<long>, groups_sha256 array<string>, pair array<long>, times array<long>, held array<array<int>>, held_times array<array<int>>"
_STRETCH = pa.schema([("stretch", pa.string()), ("doc_id", pa.list_(pa.int64())), *((c, pa.list_(pa.int64())) for c in _FACTS), ("groups_sha256", pa.list_(pa.string())), ("pair", pa.list_(pa.int64())), ("times", pa.list_(pa.int64())), ("held", pa.list_(pa.list_(pa.int32()))), ("held_times", pa.list_(pa.list_(pa.int32())))])
_RESULT_DDL = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"
_RESULT = pa.schema([("doc_id", pa.int64()), *((c, pa.int64()) for c in (*_FACTS, "n_best", "count_sum")), ("groups_sha256", pa.string())])
#: Documents and bytes of text in a stretch. Larger stretches have fewer distinct pairs for their text.
STRETCH_ROWS, STRETCH_BYTES = 1000, 2 << 20

#: The ids of one text.
Encode = Callable[[str], np.ndarray]
_vocabularies: dict[tuple, tuple] = {}


def byte_level_bytes() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: printable ones for themselves, the others from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def byte_bpe(json_path: str, ranks_path: str, pattern: str) -> tuple[Encode, list[bytes]]:
    """The ids of a byte-level BPE tokenizer file without special tokens, by the rank file of the same vocabulary, and each entry's bytes by the tokenizer file."""
    import json

    import tiktoken

    with open(ranks_path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    encode = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
    with open(json_path, encoding="utf-8") as f:
        entries = json.load(f)["model"]["vocab"]
    of = byte_level_bytes()
    table = [b""] * (max(entries.values()) + 1)
    for entry, i in entries.items():
        table[i] = bytes(of[c] for c in entry) if all(c in of for c in entry) else entry.encode()
    return lambda text: np.array(encode(" " + text), np.int32), table


def piece_bpe(model_path: str) -> tuple[Encode, list[bytes]]:
    """The ids of a sentencepiece model, which puts a space before the text itself, and each piece's bytes."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=model_path)
    table = []
    for i in range(model.get_piece_size()):
        piece = model.id_to_piece(i)
        table.append(bytes([int(piece[3:5], 16)]) if model.is_byte(i) else piece.replace("▁", " ").encode())
    return lambda text: np.array(model.encode(text), np.int32), table


class Vocabulary:
    """An encoder with each id's bytes and decimal digits as Arrow columns."""

    def __init__(self, encode: Encode, table: list[bytes]) -> None:
        self.encode = encode
        self.bytes = pa.array(table, pa.binary())
        self.length = pc.binary_length(self.bytes).cast(pa.int64())
        self.digits = pa.array([str(i) for i in range(len(table))], pa.string())


def vocabularies(json_path: str, ranks_path: str, pattern: str, model_path: str) -> tuple[Vocabulary, Vocabulary]:
    """Both, loaded once by each worker."""
    key = (json_path, ranks_path, pattern, model_path)
    if key not in _vocabularies:
        _vocabularies[key] = (Vocabulary(*byte_bpe(json_path, ranks_path, pattern)), Vocabulary(*piece_bpe(model_path)))
    return _vocabularies[key]


_NONE = np.empty(0, np.int32)


def list_array(rows: list[np.ndarray]) -> pa.ListArray:
    """A list column of ids, one list for each text."""
    ends = np.cumsum([len(x) for x in rows]) if rows else []
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]).astype(np.int32)), pa.array(np.concatenate(rows) if rows else _NONE))


def whole(lists: pa.ListArray, table: pa.Array, wanted: list[bytes]) -> np.ndarray:
    """Of which documents the joined bytes of the tokens are those wanted."""
    joined = pc.binary_join(pa.ListArray.from_arrays(lists.offsets, table.take(lists.values)), b"")
    return pc.equal(joined, pa.array(wanted, pa.binary())).to_numpy(zero_copy_only=False)


def ends_table(lists: pa.ListArray, vocabulary: Vocabulary, ids: str, place: str) -> pa.Table:
    """A row for each token: key (document and byte offset of its end), its id and its place in the flat column.

    The running sum over the whole flat column, less its value before the document, is the sum within the document.
    """
    flat, parent = lists.flatten(), pc.list_parent_indices(lists).cast(pa.int64())
    running = pc.cumulative_sum(vocabulary.length.take(flat))
    offsets = lists.offsets.to_numpy()
    before = pa.array(np.concatenate([[0], running.to_numpy()])[offsets[:-1]])
    end = pc.subtract(running, before.take(parent))
    key = pc.bit_wise_or(pc.shift_left(parent, _SHIFT), end)
    return pa.table({"key": key, ids: flat.cast(pa.int64()), place: pa.array(np.arange(len(flat), dtype=np.int32))})


def joined_by(strings: pa.Array, offsets: np.ndarray, by: str) -> pa.Array:
    """Stretches of a column of strings, each joined to one."""
    return pc.binary_join(pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), strings), by)


def aligned(doc_ids: pa.Array, texts: list[str], a: Vocabulary, b: Vocabulary, name: str) -> pa.RecordBatch:
    """The row of one stretch of documents."""
    rows = len(texts)
    given = np.array([bool(t) for t in texts])
    wanted = [b" " + t.encode() if t else b"" for t in texts]
    ids = [[v.encode(t) if t else _NONE for t in texts] for v in (a, b)]
    for v, own in zip((a, b), ids, strict=True):
        given &= whole(list_array(own), v.bytes, wanted)
    lists = [list_array([x if has else _NONE for x, has in zip(own, given.tolist(), strict=True)]) for own in ids]
    del ids, wanted
    table_a, table_b = ends_table(lists[0], a, "a", "at_a"), ends_table(lists[1], b, "b", "at_b")
    # Where both end: the last tokens of a group.
    cut = table_a.join(table_b, "key", join_type="inner", use_threads=False).sort_by("key")
    doc_of = lambda t: np.asarray(t.column("key").to_numpy()) >> _SHIFT
    n_groups = np.bincount(doc_of(cut), minlength=rows)
    sides = [joined_by(v.digits.take(x.values), np.concatenate([[0], cut.column(at).to_numpy() + 1]), ",") for v, x, at in ((a, lists[0], "at_a"), (b, lists[1], "at_b"))]
    texts_of = joined_by(pc.binary_join_element_wise(*sides, "|"), np.concatenate([[0], np.cumsum(n_groups)]), ";")
    digests = [hashlib.sha256(s.encode()).hexdigest() if has else "" for s, has in zip(texts_of.to_pylist(), given.tolist(), strict=True)]
    # All ends: up to each of them the next token of either kind goes on. A document's last end is one of both.
    every = table_a.select(["key", "a"]).join(table_b.select(["key", "b"]), "key", join_type="full outer", coalesce_keys=True, use_threads=False).sort_by("key").combine_chunks()
    links = pa.table({"doc": pa.array(doc_of(every)), "pair": pc.bit_wise_or(pc.shift_left(pc.fill_null_backward(every.column("a")), _SHIFT), pc.fill_null_backward(every.column("b")))})
    held = links.group_by(["doc", "pair"], use_threads=False).aggregate([([], "count_all")])
    total = held.group_by("pair", use_threads=False).aggregate([("count_all", "sum")]).sort_by("pair")
    pairs = total.column("pair").combine_chunks()
    held = held.append_column("place", pc.index_in(held.column("pair"), value_set=pairs)).sort_by([("doc", "ascending"), ("place", "ascending")])
    offsets = pa.array(np.concatenate([[0], np.cumsum(np.bincount(held.column("doc").to_numpy(), minlength=rows))]).astype(np.int32))
    flat = lambda c: held.column(c).combine_chunks().cast(pa.int32())
    facts = [np.diff(lists[0].offsets.to_numpy()), np.diff(lists[1].offsets.to_numpy()), n_groups, np.bincount(links.column("doc").to_numpy(), minlength=rows)]
    columns = [[name], [doc_ids.to_pylist()], *([f.tolist()] for f in facts), [digests], [pairs.to_pylist()], [total.column("count_all_sum").to_pylist()]]
    lists_of = lambda c: pa.ListArray.from_arrays(pa.array([0, rows], pa.int32()), pa.ListArray.from_arrays(offsets, flat(c)))
    return pa.RecordBatch.from_arrays([*(pa.array(c, t) for c, t in zip(columns, _STRETCH.types, strict=False)), lists_of("place"), lists_of("count_all")], schema=_STRETCH)


def stretches(docs: DataFrame, json_path: str, ranks_path: str, pattern: str, model_path: str, rows: int = STRETCH_ROWS, size: int = STRETCH_BYTES) -> DataFrame:
    """The stretches of the documents, written to the shared folder, so the second pass reads the same ones."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        a, b = vocabularies(json_path, ranks_path, pattern, model_path)
        task = TaskContext.get().partitionId()
        for k, batch in enumerate(slices(batches, 1, rows, size)):
            texts = [t.decode("utf-8", "replace") for t in batch.column(1).to_pylist()]
            yield aligned(batch.column(0), texts, a, b, f"{task}-{k}")
            pa.default_memory_pool().release_unused()

    return materialize(id_and_text(docs).mapInArrow(run, _STRETCH_DDL), "aligned", "zstd")


def pair_counts(parts: DataFrame) -> DataFrame:
    """pair, count over the corpus, and whether no pair of the same B id has more; parts has pair and times, n (rows of a pair) comes along."""
    counts = parts.groupBy("pair").agg(F.sum("times").alias("count"), F.count(F.lit(1)).alias("n"))
    b = F.col("pair").bitwiseAND(F.lit((1 << _SHIFT) - 1))
    counts = materialize(counts.withColumn("b", b), "pair-counts")
    most = counts.groupBy("b").agg(F.max("count").alias("most"))
    return counts.join(most, "b").select("pair", "n", "count", (F.col("count") == F.col("most")).alias("best"))


def document_sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each document of each stretch, whose columns are followed by its pairs' places, counts and bests."""
    for batch in batches:
        for row in range(batch.num_rows):
            x = {c: batch.column(c)[row] for c in batch.schema.names}
            place = np.asarray(x["place"].values)
            count, best = np.zeros(len(place), np.int64), np.zeros(len(place), np.int64)
            count[place], best[place] = np.asarray(x["count"].values), x["best"].values.to_numpy(zero_copy_only=False)
            held, times = x["held"].values, np.asarray(x["held_times"].values.flatten()).astype(np.int64)
            at, owner = np.asarray(held.flatten()), np.asarray(pc.list_parent_indices(held))
            n = len(held)
            sums = []
            for value in (best, count):
                running = np.concatenate([[0], np.cumsum(times * value[at])])
                ends = np.searchsorted(owner, np.arange(n), side="right")
                sums.append(np.diff(running[np.concatenate([[0], ends])]))
            yield pa.RecordBatch.from_arrays([x["doc_id"].values, *(x[c].values for c in _FACTS), pa.array(sums[0]), pa.array(sums[1]), x["groups_sha256"].values], schema=_RESULT)


def align(docs: DataFrame, json_path: str, ranks_path: str, pattern: str, model_path: str, rows: int = STRETCH_ROWS, size: int = STRETCH_BYTES) -> DataFrame:
    """A row for each row of docs."""
    made = stretches(docs, json_path, ranks_path, pattern, model_path, rows, size)
    parts = materialize(made.select("stretch", F.posexplode(F.arrays_zip("pair", "times")).alias("place", "x")).select("stretch", "place", "x.pair", "x.times"), "stretch-pairs")
    # A pair that many stretches have is broadcast with its count, so no pair is a hot key.
    counted = join_counted(parts.select("stretch", "place", "pair"), pair_counts(parts), ["pair"], parts.count())
    back = counted.groupBy("stretch").agg(F.collect_list(F.struct("place", "count", "best")).alias("x"))
    back = back.select("stretch", F.col("x.place").alias("place"), F.col("x.count").alias("count"), F.col("x.best").alias("best"))
    light = made.drop("pair", "times").join(back, "stretch", "left")
    none = lambda c, t: F.coalesce(c, F.expr(f"cast(array() as array<{t}>)")).alias(c)
    light = light.select("doc_id", *_FACTS, "groups_sha256", "held", "held_times", none("place", "int"), none("count", "bigint"), none("best", "boolean"))
    return light.mapInArrow(document_sums, _RESULT_DDL)


def op12(docs: DataFrame) -> DataFrame:
    import public_tokenizers as tokenizers

    return align(docs, tokenizers.path("byte_bpe_50k.json"), tokenizers.path("byte_bpe_50k.tiktoken"), tokenizers.PATTERN, tokenizers.path("piece_bpe_32k.model"))
