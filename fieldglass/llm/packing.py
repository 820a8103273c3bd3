"""Vector best-fit packing: pieces of documents go to the open sequence that fits them best under several capacities.

Every piece has a demand in tokens, documents and attention cost (its length squared); every sequence has a capacity in
each. Pieces are dealt to groups of bounded size by a hash of their row's number, so packing runs on all executors; within a group, pieces go
from large to small to the feasible sequence that the measure prefers. Each group wastes about one sequence at most.

Defined cases: a null text is empty, and an empty text is one piece with the end id alone; rows with a null id are packed
like others; repeated rows give a piece each; an empty table gives no rows; extra columns are left alone. Only documents
over the token capacity are cut, the first piece taking the remainder.
"""

from __future__ import annotations

import base64
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldglass.llm.common import bounded_batches, id_and_text

PIECE_DDL = "doc_id long, piece int, start long, length long, ids_crc32 long, ids binary"
PIECES = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("ids", pa.binary())])
#: Words that a worker remembers the ids of, and the longest word remembered.
CACHE_WORDS, CACHE_CHARS = 300_000, 64
#: The added token of the tokenizer file and its id; it is taken out of any text before the rest is split.
SPECIAL, SPECIAL_ID = "<|endoftext|>", 50256

_tokenizers: dict[str, Tokenizer] = {}


class _Odd(Exception):
    """A text whose spaces don't each stand between two words."""


class Tokenizer:
    """Ids of texts as little-endian unsigned 32-bit numbers, the same as a byte-level BPE tokenizer file gives.

    That vocabulary's pattern never joins a space to what precedes it, and a single space between other characters always
    begins a token. So a text can be cut before each such space and the ids of each part remembered. Other texts go to
    the tokenizer whole.
    """

    def __init__(self, ranks_path: str, pattern: str) -> None:
        import tiktoken

        with open(ranks_path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        encode = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self.whole = lambda text: np.array(encode(text), "<u4").tobytes()
        whole = self.whole

        class Known(dict):
            def __missing__(self, word: str) -> bytes:
                if not word or word[0].isspace() or word[-1].isspace():
                    raise _Odd
                ids = encode(" " + word)
                out = struct.pack(f"<{len(ids)}I", *ids)
                if len(word) <= CACHE_CHARS:
                    if len(self) >= CACHE_WORDS:
                        self.clear()
                    self[word] = out
                return out

        self.of = Known().__getitem__
        self.first = whole

    def ids(self, text: str) -> bytes:
        if SPECIAL in text:
            return struct.pack("<I", SPECIAL_ID).join(self.ids(part) if part else b"" for part in text.split(SPECIAL))
        first, *rest = text.split(" ")
        if not first or first[-1].isspace():
            return self.whole(text)
        try:
            return self.first(first) + b"".join(map(self.of, rest))
        except _Odd:
            return self.whole(text)


def tokenizer(ranks_path: str, pattern: str) -> Tokenizer:
    if ranks_path not in _tokenizers:
        _tokenizers[ranks_path] = Tokenizer(ranks_path, pattern)
    return _tokenizers[ranks_path]


def cut(docs: DataFrame, capacity: int, ranks_path: str, pattern: str, end_id: int = 0, keep_ids: bool = False) -> DataFrame:
    """The pieces of each document: ids of the whole text, then end_id, cut only where they exceed the capacity."""
    bounded_batches(docs.sparkSession)
    end = struct.pack("<I", end_id)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of = tokenizer(ranks_path, pattern).ids
        for batch in batches:
            rows: list[tuple] = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids = ids_of(text.decode("utf-8", "replace")) + end
                n = len(ids) // 4
                at, k = 0, 0
                while at < n:
                    size = (n - at) % capacity or capacity
                    part = ids[4 * at : 4 * (at + size)]
                    rows.append((doc_id, k, at, size, zlib.crc32(part), part if keep_ids else None))
                    at, k = at + size, k + 1
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), PIECES.types, strict=True)], schema=PIECES)

    return id_and_text(docs).mapInArrow(run, PIECE_DDL)


def best_fit(demand: np.ndarray, capacity: np.ndarray, weights: np.ndarray, measure: str) -> tuple[np.ndarray, np.ndarray]:
    """The bin and the offset (in the first dimension) of each item, for items in the order given.

    measure "norm" takes the feasible bin with the smallest weighted norm of what is left after placing; "dot" that with
    the largest weighted dot-product of demand and what is left before, on capacities scaled to 1, and among equals the
    fuller bin. Bins too full for the smallest item are closed.
    """
    n = len(demand)
    scale = weights / capacity**2
    left = np.empty((max(n, 1), len(capacity)), np.int64)
    names = np.empty(max(n, 1), np.int64)
    bins, offsets = np.empty(n, np.int64), np.empty(n, np.int64)
    smallest = np.minimum.accumulate(demand[::-1], axis=0)[::-1] if n else demand
    n_open = made = 0
    for i in range(n):
        d = demand[i]
        rest = left[:n_open] - d
        ok = np.flatnonzero((rest >= 0).all(1))
        if len(ok):
            r = rest[ok]
            if measure == "norm":
                k = ok[np.argmin((r * r) @ scale)]
            else:
                worth = ((r + d) * d) @ scale
                top = np.flatnonzero(worth >= worth.max() - 1e-12)
                k = ok[top[np.argmin(r[top, 0])]]
        else:
            k, left[n_open], names[n_open] = n_open, capacity, made
            n_open, made = n_open + 1, made + 1
        bins[i], offsets[i] = names[k], capacity[0] - left[k, 0]
        left[k] -= d
        if i + 1 < n and (left[k] < smallest[i + 1]).any():
            n_open -= 1
            left[k], names[k] = left[n_open], names[n_open]
    return bins, offsets


def pack(pieces: DataFrame, capacity: int = 2048, max_documents: int | None = None, max_attention: int | None = None, weights: tuple[float, float, float] = (1.0, 0.05, 0.05), measure: str = "norm", group_rows: int = 16384) -> DataFrame:
    """Adds sequence_id and offset to rows with `length`.

    group_rows bounds what one group packs, about, so memory doesn't grow with the table. pieces is a written table, whose rows
    have the same numbers whenever they are read. max_documents and max_attention, where
    given, bound the documents and the summed squared lengths of a sequence; by default they follow from the capacity.
    """
    limits = np.array([capacity, max_documents or capacity, max_attention or capacity**2], np.int64)
    if measure not in ("norm", "dot"):
        raise ValueError(f"unknown measure {measure}")
    total = pieces.count()
    groups = max(1, -(-total // group_rows))
    schema = pieces.drop("__group").schema.add("sequence_id", "long").add("offset", "long")
    wanted = np.array(weights)

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.drop(columns="__group")
        length = rows["length"].to_numpy(np.int64)
        order = np.lexsort((rows["ids_crc32"].to_numpy(np.int64), -length))
        demand = np.stack([length, np.ones_like(length), length * length], 1)
        if (demand > limits).any():
            raise ValueError("a piece exceeds a capacity of an empty sequence")
        bins, offsets = np.empty_like(length), np.empty_like(length)
        bins[order], offsets[order] = best_fit(demand[order], limits, wanted, measure)
        return rows.assign(sequence_id=(int(key[0]) << 32) + bins, offset=offsets)

    # By the row's number, not by what is in it: rows that are equal go to all groups alike.
    dealt = F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(groups))
    return pieces.withColumn("__group", dealt).groupBy("__group").applyInPandas(run, schema)


def op6(docs: DataFrame, ranks_path: str | None = None, pattern: str | None = None, capacity: int = 2048) -> DataFrame:
    import public_tokenizers

    from fieldglass.llm.common import materialize

    pieces = cut(docs, capacity, ranks_path or public_tokenizers.path("byte_bpe_50k.tiktoken"), pattern or public_tokenizers.PATTERN)
    pieces = materialize(pieces.drop("ids"), "pieces")
    return pack(pieces, capacity)
