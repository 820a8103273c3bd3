"""Conversation prefix trie: what rebuilt conversations have in common from their first turn on, by ternary search trees.

1. Distinct turns (role, text) are numbered once; from then on a conversation is an array of ids, and texts are not moved.
2. A conversation starts with the first turns of the first one of its hundred. Equal conversations are one row with a count,
   and the digest of their ids, before anything is ordered.
3. Distinct sequences are dealt out by range, so a shard is a stretch of the dictionary order. Each shard of bounded size
   becomes one ternary search tree: the sequence in the middle of a stretch is inserted first, so siblings are balanced.
   A loop over a stack walks the tree in order and adds up members, leaves and savings.
4. Only nodes on the first and the last path of a shard can have a part in another one. They are merged in order of the
   shards with a stack of one path; every other node is complete where it was made.

Defined cases: rows with a null conv_id belong to no conversation and are left out; a null turn comes first, and rows of one
turn number are ordered by the digest of role and text; null roles and texts are empty; repeated rows are turns of their own;
an empty table gives no rows (no conversation, so no root); extra columns are left alone. A conversation without turns is a
member of the root alone. A whole conversation is one array of ids, 8 bytes for each turn.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldglass.llm.common import join_counted, materialize, partitions

#: The most turns that a conversation takes from the first one of its hundred.
MOST_HEAD = 5
#: Ids of equal conversations are joined to one text for each stretch of 2 ** END_BITS ids.
END_BITS = 12
#: A shard holds so many sequences or ids at most, whichever is reached first, but one sequence at least.
SHARD_SEQUENCES, SHARD_IDS = 50_000, 1_000_000
EMPTY_SHA256 = hashlib.sha256(b"").hexdigest()

_NODE = pa.schema([("shard", pa.int64()), ("at", pa.int64()), ("kind", pa.int8()), ("name", pa.binary()), ("up", pa.binary()), ("conv_id", pa.int64()), ("depth", pa.int64()), ("parent_conv_id", pa.int64()), ("n_convs", pa.int64()), ("n_children", pa.int64()), ("n_leaves", pa.int64()), ("saved_tokens", pa.int64()), ("width", pa.int64()), ("ends_sha256", pa.string())])
_NODE_DDL = "shard long, at long, kind byte, name binary, up binary, conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, width long, ends_sha256 string"
COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def head_turns(conv_id: Column) -> Column:
    """How many turns a conversation takes from the first one of its hundred."""
    return F.crc32(conv_id.cast("string").cast("binary")) % (MOST_HEAD + 1)


def numbered_turns(conversations: DataFrame) -> DataFrame:
    """conv_id, pos (from 0), id and width (code points of the text) of each turn.

    A turn's key is a digest of role and text that no other pair has; ids number the keys. A key that many turns have is
    broadcast in the join back, so no turn is a hot key.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    key = F.unhex(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text).cast("binary"), 256))
    light = materialize(conversations.where(F.col("conv_id").isNotNull()).select("conv_id", "turn", key.alias("key"), F.length(text).cast("long").alias("width")), "turns")
    dictionary = light.groupBy("key").agg(F.count(F.lit(1)).alias("n"))
    dictionary = materialize(dictionary.select("key", "n", F.monotonically_increasing_id().alias("id")), "turn-dictionary")
    named = join_counted(light, dictionary, ["key"], light.count())
    order = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "key")
    return named.select("conv_id", (F.row_number().over(order) - 1).alias("pos"), "id", "width")


def rebuilt(turns: DataFrame) -> DataFrame:
    """conv_id, ids and widths of each rebuilt conversation."""
    own = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("pos", "id", "width"))).alias("own"))
    own = materialize(own.select("conv_id", F.transform("own", lambda x: F.struct(x["id"].alias("id"), x["width"].alias("width"))).alias("own")), "own-turns")
    first = F.col("conv_id") - F.col("conv_id") % 100
    # 199 conversations at most have the same first one (those around 0), so its few turns are no hot key.
    heads = own.where(F.col("conv_id") % 100 == 0).select(F.col("conv_id").alias("first"), F.slice("own", 1, MOST_HEAD).alias("head"))
    h = head_turns(F.col("conv_id"))
    out = own.withColumn("first", first).join(heads, "first", "left").withColumn("h", h.cast("int"))
    empty = F.expr("cast(array() as array<struct<id: bigint, width: bigint>>)")
    tail = F.when(F.size("own") > F.col("h"), F.slice("own", F.col("h") + 1, F.size("own"))).otherwise(empty)
    head = F.when(F.col("h") > 0, F.slice(F.coalesce("head", empty), F.lit(1), F.greatest("h", F.lit(1)))).otherwise(empty)
    whole = out.select("conv_id", F.concat(head, tail).alias("s"))
    return whole.select("conv_id", F.col("s.id").alias("ids"), F.col("s.width").alias("widths"))


def distinct_sequences(whole: DataFrame) -> DataFrame:
    """ids, widths, members, least conv_id and ends_sha256 of each distinct sequence.

    Ids of equal conversations are joined to texts of bounded length before they meet, and a sequence with several such
    texts is digested as they stream by in order.
    """
    part = F.shiftright("conv_id", END_BITS)
    bits = whole.groupBy("ids", part.alias("part")).agg(F.first("widths").alias("widths"), F.count(F.lit(1)).alias("n"), F.min("conv_id").alias("least"), F.concat_ws(",", F.sort_array(F.collect_list("conv_id")).cast("array<string>")).alias("text"))
    bits = materialize(bits, "ends")
    groups = bits.groupBy("ids").agg(F.first("widths").alias("widths"), F.sum("n").alias("n"), F.min("least").alias("least"), F.count(F.lit(1)).alias("texts"), F.sha2(F.min("text").cast("binary"), 256).alias("ends"))
    groups = materialize(groups, "sequences")
    many = bits.join(groups.where("texts > 1").select("ids"), "ids", "left_semi").select("ids", "part", "text")

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state = None, None
        for batch in batches:
            for ids, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if ids != now or state is None:
                    if state is not None:
                        yield pa.RecordBatch.from_arrays([pa.array([now], pa.list_(pa.int64())), pa.array([state.hexdigest()])], names=["ids", "digest"])
                    now, state = ids, hashlib.sha256()
                    state.update(text.encode())
                else:
                    state.update(b"," + text.encode())
        if state is not None:
            yield pa.RecordBatch.from_arrays([pa.array([now], pa.list_(pa.int64())), pa.array([state.hexdigest()])], names=["ids", "digest"])

    digests = many.repartition(partitions(whole.sparkSession), "ids").sortWithinPartitions("ids", "part").select("ids", "text").mapInArrow(digest, "ids array<long>, digest string")
    return groups.join(digests, "ids", "left").select("ids", "widths", "n", "least", F.coalesce("digest", "ends").alias("ends"))


class Tree:
    """A ternary search tree of sorted distinct sequences, balanced by inserting the middle of each stretch first.

    Node 0 is the root of the trie, which has no turn. Every other node has a turn, the sequences lo to hi that begin with its
    path, siblings less and greater than its turn, and the tree of its children.
    """

    def __init__(self, flat: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> None:
        self.depth, self.lo, self.hi, self.parent, self.less, self.greater, self.inner = [0], [0], [len(sizes)], [-1], [-1], [-1], [-1]
        ids, at, size = flat.tolist(), starts.tolist(), sizes.tolist()
        todo = [(0, len(size), 0, self.inner, 0)]  # a stretch, the trie node above it, and where its tree is tied
        while todo:
            lo, hi, above, tie, slot = todo.pop()
            d = self.depth[above]
            while lo < hi and size[lo] == d:  # ends at the node above
                lo += 1
            if lo == hi:
                continue
            turn_of = lambda i, d=d: ids[at[i] + d]
            middle = (lo + hi) // 2
            turn = turn_of(middle)
            a = lo + bisect_left(range(lo, middle), turn, key=turn_of)
            b = middle + bisect_right(range(middle, hi), turn, key=turn_of)
            k = len(self.depth)
            tie[slot] = k
            for column, value in ((self.depth, d + 1), (self.lo, a), (self.hi, b), (self.parent, above), (self.less, -1), (self.greater, -1), (self.inner, -1)):
                column.append(value)
            todo += [(lo, a, above, self.less, k), (b, hi, above, self.greater, k), (a, b, k, self.inner, k)]

    def walk(self) -> list[int]:
        """The nodes in order of their paths, each before those below it."""
        out, todo = [0], [(self.inner[0], False)]
        while todo:
            k, seen = todo.pop()
            if k < 0:
                continue
            if seen:
                out.append(k)
            else:  # lesser siblings, the node, what is below it, greater siblings
                todo += [(self.greater[k], False), (self.inner[k], False), (k, True), (self.less[k], False)]
        return out


def path_names(flat: list[int]) -> list[bytes]:
    """A name of 128 bits for each prefix of a sequence, the empty one first."""
    state, out = hashlib.blake2b(digest_size=16), []
    out.append(state.digest())
    for x in flat:
        state.update(int(x).to_bytes(8, "little", signed=True))
        out.append(state.digest())
    return out


def shard_nodes(shard: int, ids: list[np.ndarray], widths: list[np.ndarray], n: np.ndarray, least: np.ndarray, ends: list[str]) -> pa.RecordBatch:
    """The nodes of a shard, whose sequences are sorted and distinct. Kind 1: on the first or last path, so perhaps not whole."""
    sizes = np.array([len(x) for x in ids], np.int64)
    starts = np.cumsum(sizes) - sizes
    flat = np.concatenate(ids) if len(ids) else np.empty(0, np.int64)
    wide = np.concatenate(widths) if len(ids) else np.empty(0, np.int64)
    tree = Tree(flat, starts, sizes)
    order = tree.walk()
    m = len(order)
    lo, hi, depth, parent = (np.array(x, np.int64) for x in (tree.lo, tree.hi, tree.depth, tree.parent))
    total = np.concatenate([[0], np.cumsum(n)])
    members = total[hi] - total[lo]
    smallest = np.minimum.reduceat(np.append(least, np.iinfo(np.int64).max), np.stack([lo, hi], 1).ravel())[::2]
    width = np.zeros(m, np.int64)
    width[1:] = wide[starts[lo[1:]] + depth[1:] - 1]
    children = np.bincount(parent[1:], minlength=m)
    edge = (lo == 0) | (hi == len(sizes))
    # Of nodes that may go on in another shard only what is below them and whole is added up here.
    leaves, saved = [0] * m, [0] * m
    parent_of, is_edge, kids, own_saved = tree.parent, edge.tolist(), children.tolist(), ((members - 1) * width).tolist()
    inner_children = [0] * m
    for k in reversed(order):
        if not is_edge[k]:
            leaves[k] += kids[k] == 0
            saved[k] += own_saved[k]
            up = parent_of[k]
            leaves[up] += leaves[k]
            saved[up] += saved[k]
            inner_children[up] += 1
    names: dict[int, bytes] = {}
    for sequence in dict.fromkeys((0, len(sizes) - 1)):
        path, k = path_names(ids[sequence].tolist()), 0
        names[0] = path[0]
        on_path = [k for k in np.flatnonzero(edge).tolist() if tree.lo[k] <= sequence < tree.hi[k]]
        for k in on_path:
            names[k] = path[tree.depth[k]]
    ends_at = [EMPTY_SHA256 if not e else None for e in is_edge]
    first, size = lo.tolist(), sizes.tolist()
    for k in range(m):
        if size[first[k]] == tree.depth[k]:
            ends_at[k] = ends[first[k]]
    rows = []
    for k in order:
        if is_edge[k]:
            rows.append((shard, len(rows), 1, names[k], names.get(parent_of[k]), int(smallest[k]), tree.depth[k], None, int(members[k]), inner_children[k], leaves[k], saved[k], int(width[k]), ends_at[k]))
        else:
            up = parent_of[k]
            rows.append((shard, len(rows), 0, None, names[up] if is_edge[up] else None, int(smallest[k]), tree.depth[k], None if is_edge[up] else int(smallest[up]), int(members[k]), kids[k], leaves[k], saved[k], int(width[k]), ends_at[k]))
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _NODE.types, strict=True)], schema=_NODE)


def grow(batches: Iterator[pa.RecordBatch], most_sequences: int = SHARD_SEQUENCES, most_ids: int = SHARD_IDS) -> Iterator[pa.RecordBatch]:
    """The nodes of the shards of one partition, whose rows are sorted: a tree for each stretch of bounded size."""
    from pyspark import TaskContext

    context = TaskContext.get()
    shard = (context.partitionId() if context else 0) << 32
    held: list[tuple] = []
    load = 0

    def made() -> pa.RecordBatch:
        ids, widths, n, least, ends = zip(*held, strict=True)
        return shard_nodes(shard, list(ids), list(widths), np.array(n, np.int64), np.array(least, np.int64), list(ends))

    for batch in batches:
        ids, widths, n, least, ends = batch.columns
        flat, wide = ids.flatten().to_numpy(zero_copy_only=False), widths.flatten().to_numpy(zero_copy_only=False)
        at = np.concatenate([[0], np.cumsum(ids.value_lengths().to_numpy(zero_copy_only=False))]).astype(np.int64)
        for i, row in enumerate(zip(n.to_pylist(), least.to_pylist(), ends.to_pylist(), strict=True)):
            size = int(at[i + 1] - at[i])
            if held and (len(held) >= most_sequences or load + size > most_ids):
                yield made()
                shard, held, load = shard + 1, [], 0
            held.append((flat[at[i] : at[i + 1]], wide[at[i] : at[i + 1]], *row))
            load += size
    if held:
        yield made()


def merge_boundaries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Nodes of kind 1, in order of shards and paths, to whole ones: parts of a node follow one another along the path.

    What is held is one path, and of the nodes on it the rows below that wait for the least conv_id of their parent.
    """
    path: list[dict] = []
    done: list[tuple] = []

    def close() -> None:
        x = path.pop()
        waiting = x["waiting"]
        done.extend((*row[:3], x["conv_id"], *row[3:]) for row in waiting)
        leaf = x["n_children"] == 0
        leaves, saved = x["n_leaves"] + leaf, x["saved_tokens"] + (x["n_convs"] - 1) * x["width"]
        row = (x["name"], x["conv_id"], x["depth"], x["n_convs"], x["n_children"], leaves, saved, x["ends_sha256"] or EMPTY_SHA256)
        if path:
            up = path[-1]
            up["n_leaves"] += leaves
            up["saved_tokens"] += saved
            up["waiting"].append(row)
        else:
            done.append((*row[:3], None, *row[3:]))

    def flush() -> pa.RecordBatch:
        out = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done, strict=True), _WHOLE.types, strict=True)], schema=_WHOLE)
        done.clear()
        return out

    for batch in batches:
        for x in batch.to_pylist():
            d = x["depth"]
            if len(path) > d and path[d]["name"] == x["name"]:
                now = path[d]
                now["conv_id"] = min(now["conv_id"], x["conv_id"])
                for c in ("n_convs", "n_children", "n_leaves", "saved_tokens"):
                    now[c] += x[c]
                now["ends_sha256"] = now["ends_sha256"] or x["ends_sha256"]
                continue
            while len(path) > d:
                close()
            if path:
                path[-1]["n_children"] += 1
            path.append(x | {"waiting": []})
        if len(done) > 10_000:
            yield flush()
    while path:
        close()
    if done:
        yield flush()


_WHOLE = pa.schema([("name", pa.binary()), ("conv_id", pa.int64()), ("depth", pa.int64()), ("parent_conv_id", pa.int64()), ("n_convs", pa.int64()), ("n_children", pa.int64()), ("n_leaves", pa.int64()), ("saved_tokens", pa.int64()), ("ends_sha256", pa.string())])
_WHOLE_DDL = "name binary, conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"


def trie(sequences: DataFrame, shard_sequences: int = SHARD_SEQUENCES, shard_ids: int = SHARD_IDS) -> DataFrame:
    """A row for each distinct prefix of the sequences (ids, widths, n, least, ends), which are distinct."""
    spark = sequences.sparkSession
    # Ranges are of the first turns, so what is sampled for them is bounded; what agrees in all of these stays in one range.
    ordered = sequences.repartitionByRange(partitions(spark), F.slice("ids", 1, 64)).sortWithinPartitions("ids")
    nodes = materialize(ordered.select("ids", "widths", "n", "least", "ends").mapInArrow(lambda b: grow(b, shard_sequences, shard_ids), _NODE_DDL), "trie-nodes")
    edges = nodes.where("kind = 1").repartition(1).sortWithinPartitions("shard", "at")
    whole = materialize(edges.select(*_NODE.names).mapInArrow(merge_boundaries, _WHOLE_DDL), "trie-boundaries")
    inner = nodes.where("kind = 0")
    below = inner.where(F.col("up").isNotNull()).drop("parent_conv_id")
    parents = whole.select(F.col("name").alias("up"), F.col("conv_id").alias("parent_conv_id"), F.col("n_children").alias("n"))
    tied = join_counted(below, parents, ["up"], below.count())
    return inner.where(F.col("up").isNull()).select(*COLUMNS).unionByName(tied.select(*COLUMNS)).unionByName(whole.select(*COLUMNS))


def op11(conversations: DataFrame) -> DataFrame:
    return trie(distinct_sequences(rebuilt(numbered_turns(conversations))))
