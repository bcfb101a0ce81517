"""The trie of conversation prefixes: what each shared beginning of conversations would save.

Conversations become paths of labels (digests of role and text, 16 bytes a turn). Paths are sorted over ranges of
(path, conversation), so every task holds a run of neighbours, and so does every chunk of ``LABELS`` labels within it: a shard.

* Inside a shard, numpy builds a succinct trie in level order (:class:`Louds`): a bit vector and arrays by node. Going through its levels from the
  last to the first, ``add.at`` adds members, leaves and savings of nodes to their parents.
* A node of a shard is whole but for those on the path of the shard's first or last conversation, which neighbours may share: the
  heavy upper levels of the trie. These few are merged apart, by a digest of their path: counts add up; what they
  themselves add to the nodes above is summed along the first and last paths, each node on one of them only.

So a beginning that a third of all conversations share is cut into many shards, as is a conversation that occurs
many times. Memory of a task is bounded by a shard and its longest conversation's labels.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._spark import map_arrow, written

#: Labels, or conversations, of a shard at most (unless one conversation has more labels).
LABELS = 1 << 20
WIDTH = 16
_EMPTY = hashlib.sha256(b"").hexdigest()
_ROWS = "shard long, sides int, key binary, parent_key binary, conv_id long, parent_conv_id long, depth long, n_convs long, n_children long, n_leaves long, saved long, bytes long, ends string, piece string"


def labelled(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """A row (conv_id, turns) for each conversation: its turns in order as (label, size), which are a digest of role and text in hex, and the UTF-8 bytes of the text.

    Turns are ordered by number, null first, and by SHA-256 of role and text where numbers are equal. A null role or text is empty. Rows without a conversation
    belong to none and are left out. Only digests are gathered, not texts."""
    role, text = (F.coalesce(F.col(f"`{c}`"), F.lit("")) for c in (role_col, text_col))
    whole = F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256)
    own = turns.select(F.col(f"`{conv_col}`").cast("long").alias("conv_id"), F.struct(F.col(f"`{turn_col}`").alias("turn"), whole.alias("label"), F.octet_length(text).alias("size")).alias("t"))
    gathered = own.where("conv_id IS NOT NULL").groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("t"))
    return gathered.select("conv_id", F.transform("t", lambda t: F.struct(F.substring(t["label"], 1, 2 * WIDTH).alias("label"), t["size"].alias("size"))).alias("turns"))


class Louds:
    """A trie in level order. Of its bits, each node has a 1 for each child and then a 0, after "10" for the node above the root; so the j-th 1 is node j."""

    def __init__(self, degrees: np.ndarray):
        self.bits = np.ones(2 * len(degrees) + 1, np.uint8)
        self.bits[1] = 0
        self.bits[1 + np.cumsum(degrees + 1)] = 0

    def parents(self) -> np.ndarray:
        """The parent of each node, -1 for the root: the zeros before a node's 1, less that of the node above the root."""
        ones = np.flatnonzero(self.bits)
        return ones - np.arange(len(ones)) - 1

    def degrees(self) -> np.ndarray:
        return np.diff(np.flatnonzero(self.bits == 0)) - 1


def _shared(lengths: np.ndarray, start: np.ndarray, labels: np.ndarray) -> np.ndarray:
    """How many labels each path has in common with the one before."""
    row = np.repeat(np.arange(len(lengths)), lengths)
    depth = np.arange(len(labels)) - start[row]
    before = np.maximum(row - 1, 0)
    there = (row > 0) & (depth < lengths[before])
    at = np.where(there, start[before] + depth, 0)
    same = there & (labels[at] == labels).all(axis=1)
    out = np.zeros(len(lengths), np.int64)
    some = np.flatnonzero(lengths)
    if len(some):
        out[some] = np.minimum(np.minimum.reduceat(np.where(same, len(labels), depth), start[some]), lengths[some])
    return out


def _prefix_keys(labels: np.ndarray) -> list[bytes]:
    h = hashlib.blake2b(digest_size=WIDTH)
    out = [h.digest()]
    for label in labels:
        h.update(label.tobytes())
        out.append(h.digest())
    return out


def shard(number: int, ids: np.ndarray, lengths: np.ndarray, labels: np.ndarray, sizes: np.ndarray) -> dict:
    """Columns of the nodes of a run of paths in order; ``labels`` are rows of WIDTH bytes, ``sizes`` the bytes of their texts."""
    start = np.concatenate([[0], np.cumsum(lengths)])[:-1]
    labels = labels.reshape(-1, WIDTH).view("<u8")
    common = _shared(lengths, start, labels)
    again = np.zeros(len(ids), bool)
    again[1:] = (common[1:] == lengths[1:]) & (lengths[1:] == lengths[:-1])
    first = np.flatnonzero(~again)  # of rows with the same path, the one with the least id
    copies = np.diff(np.append(first, len(ids)))
    n, length, common = len(first), lengths[first], common[first]

    # nodes that a path adds, in level order
    new = length - common
    path = np.repeat(np.arange(n), new)
    depth = np.arange(len(path)) - np.repeat(np.cumsum(new) - new, new) + common[path] + 1
    order = np.lexsort((path, depth))
    path, depth = np.concatenate([[0], path[order]]), np.concatenate([[0], depth[order]])
    place = depth * n + path
    above = np.searchsorted(place, (depth[1:] - 1) * n + path[1:], side="right") - 1
    trie = Louds(np.bincount(above, minlength=len(path)))
    parent, children = trie.parents(), trie.degrees()
    levels = np.searchsorted(depth, np.arange(depth[-1] + 2))
    weight = np.zeros(len(path), np.int64)
    weight[1:] = sizes[start[first[path[1:]]] + depth[1:] - 1]

    def rolled(values: np.ndarray, add=np.add) -> np.ndarray:
        for d in range(len(levels) - 2, 0, -1):
            nodes = slice(levels[d], levels[d + 1])
            add.at(values, parent[nodes], values[nodes])
        return values

    last = np.searchsorted(place, length * n + np.arange(n))
    last[length == 0] = 0
    members, least = np.zeros(len(path), np.int64), np.full(len(path), np.iinfo(np.int64).max)
    np.add.at(members, last, copies)
    np.minimum.at(least, last, ids[first])
    members, least = rolled(members), rolled(least, np.minimum)

    # nodes that the shards beside may share
    sides = np.zeros(len(path), np.int64)
    sides[path == 0] = 1
    on_last = levels[1 : length[-1] + 2] - 1
    sides[on_last] |= 2
    inner = sides == 0
    leaves = rolled(np.where(inner & (children == 0), 1, 0))
    saved = rolled(np.where(inner, (members - 1) * weight, 0))
    own = children - np.bincount(parent[1:][~inner[1:]], minlength=len(path))

    keys = np.full(len(path), None, object)
    for s, nodes in ((0, np.flatnonzero(path == 0)), (n - 1, on_last)):
        begin = start[first[s]]
        keys[nodes] = _prefix_keys(labels[begin : begin + length[s]])
    ends = np.full(len(path), _EMPTY, object)
    pieces = np.full(len(path), None, object)
    bounds = np.append(first, len(ids))
    for s, j in enumerate(last.tolist()):
        text = ",".join(map(str, ids[bounds[s] : bounds[s + 1]].tolist()))
        if inner[j]:
            ends[j] = hashlib.sha256(text.encode()).hexdigest()
        else:
            pieces[j] = text
    up = np.maximum(parent, 0)
    whole = inner & inner[up]
    return {
        "shard": np.full(len(path), number), "sides": sides, "key": keys, "parent_key": np.where(whole | (depth == 0), None, keys[up]), "conv_id": least,
        "parent_conv_id": np.where(whole, least[up], None), "depth": depth, "n_convs": members, "n_children": own, "n_leaves": leaves, "saved": saved, "bytes": weight, "ends": ends, "piece": pieces,
    }


_ARROW = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "string": pa.string()}
_SCHEMA = pa.schema([(name, _ARROW[kind]) for name, kind in (f.split() for f in _ROWS.split(", "))])


def _shards(most: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number = TaskContext.get().partitionId() << 32, 0
        held: list[tuple] = []
        size = 0

        def done() -> Iterator[pa.RecordBatch]:
            columns = shard(part + number, *(np.concatenate(x) for x in zip(*held, strict=True)))
            whole = pa.table([pa.array(columns[f.name], f.type) for f in _SCHEMA], schema=_SCHEMA)
            yield from whole.to_batches(max_chunksize=1 << 14)

        for batch in batches:
            ids = batch.column("conv_id").to_numpy(zero_copy_only=False)
            lists = batch.column("sizes")
            lengths = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
            sizes = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
            labels = np.frombuffer(b"".join(batch.column("path").to_pylist()), np.uint8)
            ends = np.concatenate([[0], np.cumsum(lengths)])
            begin = 0
            while begin < len(ids):  # as many rows as the shard has room for, one at least
                room = most - size
                stop = int(np.searchsorted(ends, ends[begin] + room, side="right")) - 1
                stop = min(max(stop, begin + (not held)), begin + most, len(ids))
                if stop > begin:
                    a, b = ends[begin], ends[stop]
                    held.append((ids[begin:stop], lengths[begin:stop], labels[a * WIDTH : b * WIDTH], sizes[a:b]))
                    size += max(int(b - a), stop - begin)
                begin = stop
                if size >= most or stop < len(ids):
                    yield from done()
                    held, size, number = [], 0, number + 1
        if held:
            yield from done()

    return run


def _ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of the pieces of each key, which come in order: only the state of one hash is held."""
    now, h = None, None
    for batch in batches:
        keys, out = batch.column("key").to_pylist(), []
        for key, piece in zip(keys, batch.column("piece").to_pylist(), strict=True):
            if key != now:
                if h is not None:
                    out.append((now, h.hexdigest()))
                now, h = key, hashlib.sha256(piece.encode())
            else:
                h.update(b"," + piece.encode())
        yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in out], pa.binary()), pa.array([x for _, x in out], pa.string())], ["key", "ends"])
    if h is not None:
        yield pa.RecordBatch.from_arrays([pa.array([now], pa.binary()), pa.array([h.hexdigest()], pa.string())], ["key", "ends"])


def _merged(edge: DataFrame) -> DataFrame:
    """The nodes that shards share, each once: ``edge`` has a row for each of them and each shard that holds it."""
    sums = [F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved")]
    same = [F.first(c, ignorenulls=True).alias(c) for c in ("depth", "parent_key", "bytes")]
    paths = edge.select("key", "shard", "depth", F.explode(F.filter(F.array(F.lit(1), F.lit(2)), lambda s: F.col("sides").bitwiseAND(s) > 0)).alias("side"))
    paths = paths.withColumn("way", F.struct("shard", "side"))
    nodes = edge.groupBy("key").agg(F.min("conv_id").alias("conv_id"), *sums, *same)
    below = nodes.where("parent_key IS NOT NULL").groupBy(F.col("parent_key").alias("key")).agg(F.count("*").alias("more"))
    nodes = written(nodes.join(below, "key", "left").withColumn("n_children", F.col("n_children") + F.coalesce("more", F.lit(0))).drop("more"), "upper")
    # each node adds to those above it on one way only
    adds = nodes.join(paths.groupBy("key").agg(F.min("way").alias("own")), "key")
    adds = adds.select("key", "own", F.expr("bigint(n_children = 0)").alias("leaf"), F.expr("(n_convs - 1) * bytes").alias("saving"))
    along = Window.partitionBy("way").orderBy(F.desc("depth")).rowsBetween(Window.unboundedPreceding, 0)
    mine = lambda c: F.sum(F.when(F.col("way") == F.col("own"), F.col(c)).otherwise(0)).over(along).alias(c)
    sums = paths.join(adds, "key").select("key", mine("leaf"), mine("saving")).groupBy("key").agg(F.sum("leaf").alias("leaf"), F.sum("saving").alias("saving"))
    nodes = nodes.join(sums, "key").withColumn("n_leaves", F.expr("n_leaves + leaf")).withColumn("saved", F.expr("saved + saving")).drop("leaf", "saving")
    pieces = edge.where("piece IS NOT NULL").select("key", "shard", "piece").repartition("key").sortWithinPartitions("key", "shard")
    nodes = nodes.join(map_arrow(pieces, _ends, "key binary, ends string"), "key", "left").withColumn("ends", F.coalesce("ends", F.lit(_EMPTY)))
    above = nodes.select(F.col("key").alias("parent_key"), F.col("conv_id").alias("parent_conv_id"))
    return nodes.join(above, "parent_key", "left")


def prefixes(paths: DataFrame, most: int = LABELS) -> DataFrame:
    """The nodes of the trie of ``paths``, rows (conv_id, turns) as :func:`labelled` gives them, each conv_id once: a row for each distinct sequence of first turns, the
    root (no turn) included.

    ``conv_id`` is the least member (conversation that begins so), ``depth`` the number of turns, ``parent_conv_id`` the parent's conv_id (null for the root), ``n_convs``
    members, ``n_children`` children, ``n_leaves`` childless nodes at or below the node, ``saved_tokens`` the sum over the nodes at or below of (members - 1) times the
    bytes of the node's last text, ``ends_sha256`` the SHA-256 of the ids, in order and joined by commas, of members that have no further turn. A
    conversation without turns ends at the root. Without conversations there are no nodes. ``most`` bounds a shard, not the results.

    SHA-256 is sequential: the ids that end at one node are hashed by one task, from texts that each stand for a shard's ids.
    """
    rows = paths.where("conv_id IS NOT NULL").select("conv_id", F.unhex(F.array_join("turns.label", "")).alias("path"), F.col("turns.size").alias("sizes"))
    ordered = rows.repartitionByRange("path", "conv_id").sortWithinPartitions("path", "conv_id")
    found = written(map_arrow(ordered, _shards(most), _ROWS), "trie")
    upper = written(_merged(found.where("key IS NOT NULL")), "merged")
    inside = found.where("key IS NULL")
    # a shard holds a bounded number of children of a shared node, so none is a hot key here
    held = found.where("key IS NOT NULL").select("shard", "key").join(upper.select("key", F.col("conv_id").alias("parent_conv_id")), "key").withColumnRenamed("key", "parent_key")
    hanging = inside.where("parent_conv_id IS NULL").drop("parent_conv_id").join(held, ["shard", "parent_key"])
    out = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved", "ends")
    whole = inside.where("parent_conv_id IS NOT NULL").select(*out).union(hanging.select(*out)).union(upper.select(*out))
    return whole.withColumnsRenamed({"saved": "saved_tokens", "ends": "ends_sha256"})
