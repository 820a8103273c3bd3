"""N-gram Jaccard join: near-duplicate documents as an exact, blocked product of the document by shingle incidence.

A document's row is its set of five-word shingles. Columns are dealt to blocks by hash, and a block holds the rows' entries
of its columns as packed numbers, so what Spark shuffles is a few rows for each chunk of documents and block.

1. Of each row, count the entries whose column has another row. Linked rows share three quarters of the larger set, so rows
   with fewer such entries are linked with nothing and go. Equal sets are one row from here on.
2. Of the rows left, keep the rarest columns: two linked sets that are ordered alike, rare columns first, share a column
   among the first quarter of the larger and the first seventh of the smaller. Columns are split by bands of sizes, as
   linked sets differ by a third in size at most.
3. Rows that share such a column are candidates. Crowds first meet the one of their number that has the fewest
   entries of its own, so is likest to the others; what that links is one component. In each round after that every row meets
   a few rows of its columns that are in other components, and the likest of these are tried, until a round links nothing
   more. Only rows outside their column's main component then meet all its rows in other components, in parts of bounded
   size, so a crowd of copies never becomes all its pairs and no column has a task of its own.
4. Candidates that their sizes, the columns' places and a parity sketch allow are intersected whole. Components of the links follow.

No link between different texts is lost: a pair that isn't intersected has fewer common shingles than a link needs, or is in
one component already.

Defined cases: null texts and texts without words have no shingles and are linked with nothing; with fewer than five words
the whole sequence is the one shingle; a null id takes the component of its copies, null if it has none; rows of one id are
one document, linked with what any of its texts is; an empty table gives no rows; extra columns are left alone.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldglass.llm.common import blocks_for, bounded_batches, columns_of, id_and_text, join_counted, materialize, mix, row_name, window_hash
from fieldglass.llm.components import components

WIDTH = 5
#: A link: 100 * intersection >= 75 * union. In whole numbers, of the sizes' sum: 7 * intersection >= 3 * sum.
_DEALT = pa.schema([("block", pa.int32()), ("chunk", pa.string()), ("kind", pa.int32()), ("counts", pa.binary()), ("data", pa.binary()), ("more", pa.binary())])
_DEALT_DDL = "block int, chunk string, kind int, counts binary, data binary, more binary"
_STATE = pa.schema([("doc_id", pa.int64()), ("text_key", pa.int64()), ("n", pa.int32()), ("set_a", pa.int64()), ("set_b", pa.int64()), ("shared", pa.int32())])
_STATE_DDL = "doc_id long, text_key long, n int, set_a long, set_b long, shared int"
_PREFIX = pa.schema([("column", pa.int64()), ("cid", pa.int64()), ("n", pa.int32()), ("own", pa.int32()), ("place", pa.int32()), ("near", pa.bool_())])
_PREFIX_DDL = "column long, cid long, n int, own int, place int, near boolean"
#: A block's index takes the upper half of a column's name.
_HALF = np.uint64(32)


def shingles(text: bytes) -> np.ndarray:
    """The sorted hashes of the set of a text's shingles."""
    from xxhash import xxh3_64_intdigest

    words = text.lower().split()
    hashes = np.fromiter(map(xxh3_64_intdigest, words), np.uint64, len(words))
    return np.unique(window_hash(hashes, min(WIDTH, len(words)))) if words else hashes


def parities(hashes: np.ndarray) -> list[int]:
    """512 bits, each the parity of how many shingles fall on it. Two sets' differing bits are at most the shingles that one alone has."""
    bits = np.bincount((mix(hashes ^ np.uint64(0xA5A5A5A5A5A5A5A5)) & np.uint64(511)).astype(np.int64), minlength=512) & 1
    return np.packbits(bits.astype(np.uint8)).view(np.int64).tolist()


def least_overlap(n: np.ndarray) -> np.ndarray:
    """The least overlap of a set of n with any linked set."""
    return (3 * n + 3) // 4


def _by_block(values: np.ndarray, owner: np.ndarray, blocks: int, n_rows: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Block, entries of each row, and the entries' names within the block, by row."""
    block = (values % np.uint64(blocks)).astype(np.int64)
    name = ((values // np.uint64(blocks)) & np.uint64(0xFFFFFFFF)).astype(np.uint32)
    order = np.argsort(block, kind="stable")
    ends = np.cumsum(np.bincount(block, minlength=blocks))
    for b in range(blocks):
        part = order[(ends[b - 1] if b else 0) : ends[b]]
        if len(part):
            yield b, np.bincount(owner[part], minlength=n_rows).astype(np.uint32), name[part]


def _emit(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)


def _task() -> int:
    from pyspark import TaskContext

    return TaskContext.get().partitionId()


def _chunk(task: int, batch: int, facts: np.ndarray) -> str:
    """A chunk's name: where it came from and what is in it, so a task that runs again over rows in another order mixes with nothing."""
    from xxhash import xxh3_64_hexdigest

    return f"{task}-{batch}-{xxh3_64_hexdigest(np.ascontiguousarray(facts).tobytes())}"


def _blocks(table: pa.Table) -> tuple[list[str], list[np.ndarray], list[np.ndarray]]:
    """Chunk names, entries by row and names of the rows of kind 0."""
    return (table.column("chunk").to_pylist(), [np.frombuffer(x.as_py(), np.uint32) for x in table.column("counts")], [np.frombuffer(x.as_py(), np.uint32) for x in table.column("data")])


def _shared_counts(table: pa.Table) -> pa.Table:
    """For each chunk, how many of each row's entries have a column with another entry. Rows of kind 1 pass."""
    kinds = np.array(table.column("kind").to_pylist())
    rows = [tuple(r.values()) for r in table.filter(pa.array(kinds == 1)).to_pylist()]
    held = table.filter(pa.array(kinds == 0))
    chunks, counts, names = _blocks(held)
    if names:
        every = np.concatenate(names)
        order = np.argsort(every, kind="stable")
        ordered = every[order]
        same = np.zeros(len(every), bool)
        same[1:] = ordered[1:] == ordered[:-1]
        same[:-1] |= same[1:]
        shared = np.empty(len(every), bool)
        shared[order] = same
        at = 0
        for chunk, count, name in zip(chunks, counts, names, strict=True):
            own = shared[at : at + len(name)]
            at += len(name)
            total = np.bincount(np.repeat(np.arange(len(count)), count), weights=own, minlength=len(count)).astype(np.uint32)
            rows.append((0, chunk, 0, total.tobytes(), None, None))
    return pa.Table.from_batches([_emit(rows, _DEALT)] if rows else [], _DEALT)


def _summed(table: pa.Table) -> pa.Table:
    """The state of each row of a chunk."""
    own, total = None, None
    for r in table.to_pylist():
        if r["kind"] == 1:
            own = np.frombuffer(r["data"], np.int64).reshape(-1, 5), np.frombuffer(r["counts"], np.uint8)
        else:
            part = np.frombuffer(r["counts"], np.uint32).astype(np.int64)
            total = part if total is None else total + part
    facts, known = own
    total = np.zeros(len(facts), np.int64) if total is None else total
    columns = [pa.array(facts[:, 0], mask=known == 0), facts[:, 1], facts[:, 2].astype(np.int32), facts[:, 3], facts[:, 4], total.astype(np.int32)]
    return pa.Table.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, t) for c, t in zip(columns, _STATE.types, strict=True)], schema=_STATE)


def states(docs: DataFrame, blocks: int) -> DataFrame:
    """For each row of docs: its id, a hash of its text, the set's size and digest, and its entries in shared columns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = _task()
        for k, batch in enumerate(batches):
            if not batch.num_rows:
                continue
            texts = batch.column(1).to_pylist()
            sets = [shingles(t) for t in texts]
            sizes = np.array([len(s) for s in sets])
            every, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), sizes)
            facts = np.empty((len(sets), 5), np.uint64)
            facts[:, 0] = batch.column(0).fill_null(0).to_numpy().view(np.uint64)
            facts[:, 1] = batch.column(2).to_numpy().view(np.uint64)
            facts[:, 2] = sizes
            for j, salt in ((3, 1), (4, 2)):
                sums = np.concatenate([[np.uint64(0)], np.cumsum(mix(every + np.uint64(salt * 0x5851F42D4C957F2D % (1 << 64))), dtype=np.uint64)])
                ends = np.cumsum(sizes)
                facts[:, j] = sums[ends] - sums[ends - sizes]
            chunk = _chunk(task, k, facts)
            known = batch.column(0).is_valid().cast(pa.uint8()).to_numpy(zero_copy_only=False)
            rows = [(k % blocks, chunk, 1, known.tobytes(), facts.tobytes(), None)]
            rows += [(b, chunk, 0, counts.tobytes(), names.tobytes(), None) for b, counts, names in _by_block(every, owner, blocks, len(sets))]
            yield _emit(rows, _DEALT)

    dealt = id_and_text(docs).withColumn("text_key", F.xxhash64("text")).mapInArrow(run, _DEALT_DDL)
    return dealt.repartition(blocks, "block").groupBy("block").applyInArrow(_shared_counts, _DEALT_DDL).groupBy("chunk").applyInArrow(_summed, _STATE_DDL)


def sets_of(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """cid, n, the sorted set and its parities of the documents in wanted (cid, text_key). They meet by shuffle at any size, so each text moves once and nothing is broadcast that grows."""
    rows = id_and_text(docs).withColumn("text_key", F.xxhash64("text"))
    found = rows.join(wanted.withColumnRenamed("cid", "doc_id").hint("merge"), ["doc_id", "text_key"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc_id, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                found = shingles(text)
                rows.append((doc_id, len(found), found.tobytes(), parities(found)))
            if rows:
                yield _emit(rows, pa.schema([("cid", pa.int64()), ("n", pa.int32()), ("set", pa.binary()), ("parities", pa.list_(pa.int64()))]))

    return found.select("doc_id", "text").mapInArrow(run, "cid long, n int, set binary, parities array<long>")


def _frequencies(table: pa.Table) -> pa.Table:
    """For each chunk, the entries whose column has another entry: their names and the magnitude of the column's count."""
    rows: list[tuple] = [tuple(r.values()) for r in table.filter(pa.array(np.array(table.column("kind").to_pylist()) == 1)).to_pylist()]
    held = table.filter(pa.array(np.array(table.column("kind").to_pylist()) == 0))
    if held.num_rows:
        block = held.column("block")[0].as_py()
        chunks, counts, names = _blocks(held)
        _, inverse, times = np.unique(np.concatenate(names), return_inverse=True, return_counts=True)
        size = np.where(times > 1, 1 + np.floor(2 * np.log2(times)), 0).astype(np.uint8)[inverse]
        at = 0
        for chunk, count, name in zip(chunks, counts, names, strict=True):
            own = size[at : at + len(name)]
            at += len(name)
            keep = own > 0
            left = np.bincount(np.repeat(np.arange(len(count)), count), weights=keep, minlength=len(count)).astype(np.uint32)
            rows.append((block, chunk, 0, left.tobytes(), name[keep].tobytes(), own[keep].tobytes()))
    return pa.Table.from_batches([_emit(rows, _DEALT)] if rows else [], _DEALT)


def _prefixes(table: pa.Table) -> pa.Table:
    """The entries of each row of a chunk that stand in its prefix."""
    ids = sizes = None
    owners, columns, counts = [], [], []
    for r in table.to_pylist():
        if r["kind"] == 1:
            ids, sizes = np.frombuffer(r["data"], np.int64), np.frombuffer(r["counts"], np.int64)
            continue
        left = np.frombuffer(r["counts"], np.uint32)
        owners.append(np.repeat(np.arange(len(left)), left))
        columns.append(np.frombuffer(r["data"], np.uint32).astype(np.uint64) | (np.uint64(r["block"]) << _HALF))
        counts.append(np.frombuffer(r["more"], np.uint8))
    if not owners:
        return _PREFIX.empty_table()
    owner, column, count = np.concatenate(owners), np.concatenate(columns), np.concatenate(counts)
    order = np.lexsort((mix(column), count, owner))
    owner, column = owner[order], column[order]
    shared = np.bincount(owner, minlength=len(ids))
    place = np.arange(len(owner)) - (np.cumsum(shared) - shared)[owner]
    alone = sizes - shared  # entries that come before, in columns of their own
    n = sizes[owner]
    place = place + alone[owner]
    keep = place <= n - least_overlap(n)
    owner, column, place, n = owner[keep], column[keep], place[keep], n[keep]
    near = place <= n - (6 * n + 6) // 7
    arrays = (column.view(np.int64), ids[owner], n.astype(np.int32), alone[owner].astype(np.int32), place.astype(np.int32), near)
    return pa.Table.from_arrays([pa.array(a, t) for a, t in zip(arrays, _PREFIX.types, strict=True)], schema=_PREFIX)


def prefixes(sets: DataFrame, blocks: int) -> DataFrame:
    """column, cid, n, own (entries in columns that no other row has), place among the row's columns, rare ones first, and near (in the shorter prefix)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = _task()
        for k, batch in enumerate(batches):
            if not batch.num_rows:
                continue
            chunk = _chunk(task, k, batch.column(0).to_numpy())
            rows = [np.frombuffer(x, np.uint64) for x in batch.column(2).to_pylist()]
            sizes = np.array([len(x) for x in rows], np.int64)
            out = [(k % blocks, chunk, 1, sizes.tobytes(), batch.column(0).to_numpy().tobytes(), None)]
            out += [(b, chunk, 0, counts.tobytes(), names.tobytes(), None) for b, counts, names in _by_block(np.concatenate(rows), np.repeat(np.arange(len(rows)), sizes), blocks, len(rows))]
            yield _emit(out, _DEALT)

    dealt = sets.select("cid", "n", "set").mapInArrow(run, _DEALT_DDL)
    return dealt.repartition(blocks, "block").groupBy("block").applyInArrow(_frequencies, _DEALT_DDL).groupBy("chunk").applyInArrow(_prefixes, _PREFIX_DDL)


def linked(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) whose whole sets make a link."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b, set_a, set_b = (c.to_pylist() for c in batch.columns)
            ok = []
            for x, y in zip(set_a, set_b, strict=True):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                both = np.concatenate([x, y])
                both.sort()
                ok.append(7 * int(np.count_nonzero(both[1:] == both[:-1])) >= 3 * len(both))
            keep = np.array(ok, bool)
            yield pa.RecordBatch.from_arrays([pa.array(np.array(a, np.int64)[keep]), pa.array(np.array(b, np.int64)[keep])], names=["a", "b"])

    held = pairs.join(sets.select(F.col("cid").alias("b"), F.col("set").alias("set_b")), "b").join(sets.select(F.col("cid").alias("a"), F.col("set").alias("set_a")), "a")
    return held.select("a", "b", "set_a", "set_b").mapInArrow(run, "a long, b long").distinct()


def _possible(n_a: str, place_a: str, n_b: str, place_b: str):
    """What sizes and places leave open: from their first common column on, two rows have at most the lesser rest in common.

    A later common column leaves less open than the first, so a pair goes on if any of its columns lets it.
    """
    return 7 * F.least(F.col(n_a) - F.col(place_a), F.col(n_b) - F.col(place_b)) >= 3 * (F.col(n_a) + F.col(n_b))


#: In a round a row of a column meets so many others of it, and so many of all that it met are intersected with it.
REPRESENTATIVES, TRIED = 16, 4
#: Rows outside a column's main component that one key of the last join holds, about.
PART_ROWS = 256


def _differing(a: str, b: str) -> Column:
    """In how many parities two sets differ."""
    return reduce(Column.__add__, (F.bit_count(F.get(a, F.lit(k)).bitwiseXOR(F.get(b, F.lit(k)))) for k in range(8)))


def _columns(rows: DataFrame) -> DataFrame:
    """Columns whose rows are in several components, one of them with the column in its shorter prefix: with the component that most of them are in, and the least size of a row that has it in the shorter prefix. Components are counted before they meet."""
    parts = rows.groupBy("column", "component").agg(F.count(F.lit(1)).alias("size"), F.bool_or("near").alias("any"), F.bool_or("home").alias("home"), F.min(F.when(F.col("near"), F.col("n"))).alias("least"))
    out = parts.groupBy("column").agg(F.count(F.lit(1)).alias("parts"), F.bool_or("any").alias("any"), F.bool_or("home").alias("home"), F.min("least").alias("least"), F.max_by("component", F.struct("size", "component")).alias("main"))
    return out.where((F.col("parts") > 1) & F.col("any") & F.col("home")).select("column", "main", "least")


def _banded(prefix: DataFrame) -> DataFrame:
    """prefix with each column split by size: linked sets' sizes are in one band or in two that adjoin, as bands are wider than a link lets sizes differ.

    A row is in its own band's column and, as a lesser one, in that of the next band; two rows meet where one is in its own.
    """
    band = F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(1.35)))  # over 4 / 3
    twice = F.array(F.struct(band.alias("band"), F.lit(True).alias("home")), F.struct((band + 1).alias("band"), F.lit(False).alias("home")))
    out = prefix.select("*", F.explode(twice).alias("x"))
    return out.withColumns({"column": F.xxhash64("column", "x.band"), "home": F.col("x.home")}).drop("x")


def _side(x: str) -> list[Column]:
    return [F.col(c).alias(f"{c}_{x}") for c in ("n", "place", "component", "near", "home", "parities")]


def _open_pairs(met: DataFrame) -> DataFrame:
    """Of rows a and b that met in a column, those that aren't in one component and that sizes, places and parities leave open."""
    sizes = (F.col("near_a") & (F.col("n_a") <= F.col("n_b"))) | (F.col("near_b") & (F.col("n_b") <= F.col("n_a")))
    alike = 7 * _differing("parities_a", "parities_b") <= F.col("n_a") + F.col("n_b")
    return met.where((F.col("component_a") != F.col("component_b")) & (F.col("home_a") | F.col("home_b")) & sizes & _possible("n_a", "place_a", "n_b", "place_b") & alike)


def links(sets: DataFrame, prefix: DataFrame, rounds: int = 2) -> DataFrame:
    """Components of the rows in prefix, as `node` and `component`."""
    prefix = materialize(_banded(prefix), "banded-columns")
    # The row of a column that has the fewest entries of its own is likest to the others.
    lead = prefix.groupBy("column").agg(F.count(F.lit(1)).alias("size"), F.bool_or("near").alias("any"), F.min_by(F.struct("cid", "n", "place"), F.struct("own", "cid")).alias("x"))
    lead = lead.where((F.col("size") > 1) & F.col("any")).select("column", F.col("x.cid").alias("a"), F.col("x.n").alias("n_a"), F.col("x.place").alias("place_a"))
    met = prefix.join(lead, "column").where((F.col("cid") != F.col("a")) & _possible("n", "place", "n_a", "place_a"))
    best = met.groupBy("cid", "a").agg(F.count(F.lit(1)).alias("count")).groupBy("cid").agg(F.max_by("a", F.struct(F.col("count"), -F.col("a"))).alias("a"))
    found = materialize(linked(best.select("a", F.col("cid").alias("b")), sets).select(F.col("a").alias("u"), F.col("b").alias("v")), "links")
    label = components(found)
    for k in range(1, rounds + 2):
        rows = prefix.join(label.select(F.col("node").alias("cid"), "component"), "cid", "left").withColumn("component", F.coalesce("component", "cid"))
        # A link's smaller row has the column in its shorter prefix, so a row whose place leaves too little open even for the least of these goes.
        reach = 7 * (F.col("n") - F.col("place")) >= 3 * (F.col("n") + F.col("least"))
        left = materialize(rows.join(_columns(rows), "column").where(reach).join(sets.select("cid", "parities"), "cid"), "open-columns")
        other = left.select("column", F.col("cid").alias("b"), *_side("b"))
        if k <= rounds:  # every row meets a few of each of its columns, others in each round, and the likest of these are tried
            drawn = left.withColumn("turn", F.row_number().over(Window.partitionBy("column").orderBy(F.xxhash64("cid", F.lit(k)), "cid"))).where(F.col("turn") <= REPRESENTATIVES)
            met = _open_pairs(drawn.select("column", F.col("cid").alias("a"), *_side("a")).join(other, "column"))
            once = met.groupBy("b", "a").agg(F.min(_differing("parities_a", "parities_b")).alias("differ"))
            pairs = once.withColumn("turn", F.row_number().over(Window.partitionBy("b").orderBy("differ", "a"))).where(F.col("turn") <= TRIED).select("a", "b")
        else:  # rows outside their column's main component meet all rows of the column, in parts of the former
            odd = left.where(F.col("component") != F.col("main"))
            parts = odd.groupBy("column").agg(F.ceil(F.count(F.lit(1)) / PART_ROWS).cast("int").alias("parts"))
            odd = odd.join(parts, "column").select("column", F.pmod(F.xxhash64("cid"), F.col("parts")).cast("int").alias("part"), F.col("cid").alias("a"), *_side("a"))
            every = other.join(parts, "column").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts")
            pairs = _open_pairs(odd.join(every, ["column", "part"]))
        pairs = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
        new = materialize(linked(pairs, sets).select(F.col("a").alias("u"), F.col("b").alias("v")), "links")
        if new.isEmpty() and k <= rounds:
            rounds = k - 1  # what can be found by drawing is found: the last join follows
            continue
        found = found.unionByName(new)
        label = components(found)
    return label


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id and set_id (the least id with the same set), a row for each row of docs."""
    spark = docs.sparkSession
    bounded_batches(spark)
    blocks = blocks_for(docs)
    state = materialize(states(docs, blocks), "near-states")
    keys = ["n", "set_a", "set_b"]
    classes = state.where(F.col("n") > 0).groupBy(*keys).agg(F.min(F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "text_key"))).alias("first"), F.max("shared").alias("shared"), F.count(F.lit(1)).alias("rows"))
    classes = materialize(classes.select(*keys, F.col("first.doc_id").alias("cid"), F.col("first.text_key").alias("text_key"), "shared", "rows"), "near-sets")
    wanted = classes.where(F.col("cid").isNotNull() & (4 * F.col("shared") >= 3 * F.col("n"))).select("cid", "text_key").distinct()
    sets = materialize(sets_of(docs, wanted).distinct(), "near-rows")
    prefix = materialize(prefixes(sets, blocks), "near-prefixes")
    label = links(sets, prefix)
    ids = classes.join(label.select(F.col("node").alias("cid"), "component"), "cid", "left")
    ids = ids.select(F.col("n").alias("size"), "set_a", "set_b", "cid", F.coalesce("component", "cid").alias("component"), F.col("rows").alias("n"))
    some = join_counted(state.where(F.col("n") > 0).withColumnRenamed("n", "size"), ids, ["size", "set_a", "set_b"], state.count())
    none = state.where(F.col("n") == 0).select("doc_id", F.col("n").alias("size"), F.lit(None).cast("long").alias("cid"), F.lit(None).cast("long").alias("component"))  # linked with nothing, and no key to meet by
    out = some.select(*none.columns).unionByName(none)
    return out.select("doc_id", F.col("size").cast("long").alias("n_shingles"), F.coalesce("component", "doc_id").alias("component_id"), F.coalesce("cid", "doc_id").alias("set_id"))


def keep_one(docs: DataFrame) -> DataFrame:
    """One document of each group of near copies, that with the least id, of equal ids that with the least hash.

    Rows are documents by their id and text: null ids take part like others (and go last), two texts under one id are two
    documents, and rows that repeat both are one, of which the row with the least hash of all columns stays.
    """
    text = F.coalesce("text", F.lit(""))
    named = docs.withColumn("__own", F.xxhash64(F.col("doc_id").isNull(), "doc_id", text))
    group = near_duplicates(named.select(F.col("__own").alias("doc_id"), text.alias("text"))).select(F.col("doc_id").alias("__own"), "component_id").groupBy("__own").agg(F.min("component_id").alias("group"), F.count(F.lit(1)).alias("rows"))
    light = named.select("__own", F.col("doc_id").alias("id")).distinct().join(group, "__own")
    least = light.groupBy("group").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "__own", "rows")).alias("least"))
    kept = materialize(least.select("least.__own", F.col("least.rows").alias("__rows")), "kept")
    out = named.join(kept.where(F.col("__rows") == 1).select("__own").hint("merge"), "__own", "left_semi").select(*columns_of(docs))
    repeated = kept.where(F.col("__rows") > 1).select("__own")
    if not repeated.isEmpty():
        again = named.withColumn("__row", row_name(docs)).join(repeated, "__own", "left_semi")
        out = out.unionByName(again.groupBy("__own").agg(F.min_by(F.struct(*columns_of(docs)), "__row").alias("row")).select("row.*"))
    return out


def op4(docs: DataFrame) -> DataFrame:
    return near_duplicates(docs)
