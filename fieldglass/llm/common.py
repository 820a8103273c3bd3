"""Helpers that the operators of this subpackage share: tables in the shared folder, words, mixed hashes, exchanged blobs."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: What separates words: space, tab, line feed, vertical tab, form feed, carriage return.
SPACE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"

_own_dir: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or in local mode a temporary one."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    if not _own_dir:
        _own_dir.append("file://" + tempfile.mkdtemp(prefix="spark-shared-"))
    return _own_dir[0]


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/fieldglass/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str, compression: str = "snappy") -> DataFrame:
    """Write a table to the shared folder and read it back: cuts the lineage and survives lost executors."""
    path = new_path(df.sparkSession, name)
    df.write.option("compression", compression).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop_path(spark: SparkSession, path: str) -> None:
    """Delete a table or folder that no later step reads."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)


def bounded_batches(spark: SparkSession, rows: int = 1000, size: int = 16 << 20) -> None:
    """Keep Arrow batches small enough for long texts."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(size))


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def id_and_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The two columns that an operator needs, the text as UTF-8 bytes, null as empty."""
    return docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col).cast("binary"), F.lit(b"")).alias("text"))


def columns_of(df: DataFrame) -> list[Column]:
    """The columns of a table by their quoted names, so a name may hold any character."""
    return [F.col("`" + c.replace("`", "``") + "`") for c in df.columns]


def row_name(df: DataFrame) -> Column:
    """A hash of all columns of a row but maps, nulls told apart; rows of one name are the same row."""
    own = [c for c, f in zip(columns_of(df), df.schema.fields, strict=True) if f.dataType.typeName() != "map"]
    return F.xxhash64(*own, *(c.isNull() for c in own))


def blocks_for(docs: DataFrame, text_col: str = "text", block_bytes: int = 16 << 20) -> int:
    """How many blocks keep what one holds near block_bytes of text, however large the table."""
    size = docs.agg(F.sum(F.octet_length(text_col))).first()[0] or 0
    return max(8, int(size // block_bytes) + 1)


def join_counted(left: DataFrame, right: DataFrame, key: list[str], rows: int, how: str = "inner", share: int = 1000) -> DataFrame:
    """left joined with right, which has a row for each key and in `n` how many rows of left have it, of `rows` in all.

    Keys that hold more than one row in `share` are `share` at most, whatever the size: those are broadcast, the rest is
    shuffled at any size, so no key has a task of its own. how: inner, or left where right covers all keys of left.
    """
    least = max(10_000, rows // share)
    hot = right.where(F.col("n") > least)
    return left.join(F.broadcast(hot), key).unionByName(left.join(F.broadcast(hot), key, "left_anti").join(right.where(F.col("n") <= least).hint("merge"), key, how))


def fold_remainder(doc_id: Column, k: int = 5) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % k


def word_count(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")


# ---- numpy ----

_M1, _M2, _G = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers whose output bits depend on all input bits."""
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def join_hash(a: np.ndarray, b: np.ndarray, salt: int = 0) -> np.ndarray:
    """The hash of an ordered pair of hashes."""
    return mix(a * _G + mix(b + np.uint64(salt * 2 + 1)))


def window_hash(words: np.ndarray, width: int, salt: int = 0) -> np.ndarray:
    """The hash of each window of so many consecutive words, by doubling widths: about log2(width) passes."""
    n = len(words) - width + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out, done, block, size = None, 0, words, 1
    while True:
        if width & size:
            part = block[done : done + n]
            out = part.copy() if out is None else join_hash(out, part, salt)
            done += size
        if done == width:
            return mix(out + np.uint64(width))
        block = join_hash(block[:-size], block[size:], salt + 7)
        size *= 2


def starts_of(lengths: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(lengths)])[:-1].astype(np.int64) if len(lengths) else np.empty(0, np.int64)


def binary_lists(batches: Iterable[pa.RecordBatch], *names: str) -> Iterator[tuple]:
    """The named columns of each batch as Python lists."""
    for batch in batches:
        if batch.num_rows:
            yield tuple(batch.column(batch.schema.get_field_index(n)).to_pylist() for n in names)


def batch_of(schema: pa.Schema, *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) if not isinstance(c, pa.Array) else pc.cast(c, t) for c, t in zip(columns, schema.types, strict=True)], schema=schema)


def slices(batches: Iterable[pa.RecordBatch], column: int, rows: int = 1000, size: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Stretches of the batches with so many rows or bytes in a column at most, but one row at least. The session's own batch bounds stay as they are."""
    for batch in batches:
        ends = np.cumsum(pc.binary_length(batch.column(column)).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64))
        at = 0
        while at < batch.num_rows:
            before = int(ends[at - 1]) if at else 0
            n = max(1, min(rows, int(np.searchsorted(ends, before + size, side="right")) - at))
            yield batch.slice(at, n)
            at += n
