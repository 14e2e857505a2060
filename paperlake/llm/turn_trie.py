"""Conversation prefix trie from padded matrices of turn ids.

A turn's id is a 128-bit digest of its role and text, a conversation's path the ids of its turns in order. Paths
are dealt by ranges of their order, so a task has a run of neighbouring paths and cuts it into shards of bounded
size. A shard's paths become a padded matrix; ``np.lexsort`` orders its rows, differences to the row before are
OR-accumulated over the columns and so mark where nodes start, and ``reduceat`` sums every depth. Only nodes on
a shard's first or last path can go on in other shards; these are recombined by their prefix afterwards.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import bounded_batches, written

#: Bounds of one shard: turns and conversations. Columns of turns that one matrix has; longer paths go on in further ones.
TURNS, ROWS, COLUMNS = 1 << 18, 1 << 16, 8

_PARTIAL = """edge boolean, shard long, key binary, parent_key binary, conv_id long, depth long, parent_conv_id long, n_convs long, n_children long,
 n_leaves long, saved_tokens long, ends_sha256 string, ids array<long>, on_first boolean, on_last boolean, chars long, upto long"""


def rebuilt_paths(conversations: DataFrame, block: int = 100, most: Column | None = None) -> DataFrame:
    """(conv_id, path, chars): each conversation rebuilt on the first turns of its block's conversation.

    Conversation c gets the first h turns of conversation c - c % block, then its own after its first h;
    h is crc32 of the decimal c modulo 6 unless ``most`` says otherwise. Turns go by ``turn``, null first, ties by the turn's digest;
    null roles and texts are empty; rows without conv_id belong to none. ``path`` holds 16 bytes a turn, ``chars`` the texts' code points."""
    role, text = (F.coalesce(c, F.lit("")) for c in ("role", "text"))
    turns = conversations.where("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.struct(F.col("turn").isNotNull().alias("has"), "turn", F.md5(F.concat(F.char_length(role), F.lit(":"), role, text)).alias("digest"), F.char_length(text).cast("long").alias("chars")).alias("t"),
    )
    based = turns.withColumn("base", F.expr(f"conv_id - conv_id % {block}")).repartition("base")
    own = based.groupBy("base", "conv_id").agg(F.sort_array(F.collect_list("t")).alias("own"))
    h = (F.crc32(F.col("conv_id").cast("string")) % 6).cast("int") if most is None else most
    head = F.max(F.when(F.col("conv_id") == F.col("base"), F.slice("own", 1, 5) if most is None else F.col("own"))).over(Window.partitionBy("base"))
    both = own.select("conv_id", "own", head.alias("head"), h.alias("h")).select("conv_id", F.expr("concat(slice(coalesce(head, slice(own, 1, 0)), 1, h), slice(own, h + 1, size(own)))").alias("t"))
    return both.select("conv_id", F.unhex(F.array_join(F.transform("t", lambda x: x.digest), "")).alias("path"), F.transform("t", lambda x: x.chars).alias("chars"))


def ordered(conv: np.ndarray, ids: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows by path and then conv, and how many turns each shares with the row before it in that order (the first: none).

    Row r's turns are ids[at[r]:at[r + 1]], each two numbers. Matrices of COLUMNS turns are made one after another, from
    the second on only of rows that agree with a neighbour in all columns before; so memory follows the turns, not rows times the longest path."""
    n = np.diff(at)
    order, common = np.lexsort((conv, np.minimum(n, 1))), np.zeros(len(n), np.int64)
    group = np.zeros(len(n), np.int64)
    place, first = np.arange(len(n)), 0
    while len(place):
        rows = order[place]
        left = np.clip(n[rows] - first, 0, COLUMNS)
        there = np.arange(COLUMNS) < left[:, None]
        matrix = np.zeros((len(rows), COLUMNS, 2), np.uint64)
        matrix[there] = ids[((at[rows] + first)[:, None] + np.arange(COLUMNS))[there]]
        flat = matrix.reshape(len(rows), -1)
        by = np.lexsort((conv[rows], left, *flat.T[::-1], group[place]))
        order[place], rows, matrix, there = rows[by], rows[by], matrix[by], there[by]
        new = np.r_[True, np.diff(group[place]) != 0]
        change = np.ones((len(rows), COLUMNS), bool)
        change[1:] = (matrix[1:] != matrix[:-1]).any(2) | (there[1:] != there[:-1])
        change |= new[:, None] | ~there
        node = np.logical_or.accumulate(change, axis=1)
        same = (~node).sum(1)
        common[place] += np.where(new, 0, same)
        # a row goes on with the next columns where it agrees with a neighbour in all of these
        with_last = ~new & (same == COLUMNS)
        go = with_last | np.r_[with_last[1:], False]
        label = np.cumsum(~with_last)
        first += COLUMNS
        place, label = place[go], label[go]
        group[place] = label
    return order, common


def _summed(values: np.ndarray, parent: np.ndarray, n: int) -> np.ndarray:
    """Sums by parent; parents ascend."""
    out = np.zeros(n, np.int64)
    if len(parent):
        first = np.flatnonzero(np.r_[True, np.diff(parent) != 0])
        out[parent[first]] = np.add.reduceat(values, first)
    return out


def _ids_hash(ids: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, ids.tolist())).encode()).hexdigest()


def shard_nodes(shard: int, conv: np.ndarray, paths: bytes, at: np.ndarray, chars: np.ndarray) -> list[pa.RecordBatch]:
    """The nodes of one shard's conversations; those on its first and last path as edges, with what recombining needs.

    ``at`` counts turns. Sums are over the shard: members, children, leaves and saved code points as if it were alone."""
    ids = np.frombuffer(paths, ">u8").astype(np.uint64).reshape(-1, 2)
    order, common = ordered(conv, ids, at)
    conv, begin, n = conv[order], at[:-1][order], np.diff(at)[order]
    total, depth = len(conv), int(n.max(initial=0))
    is_leaf = np.r_[common[1:] != n[:-1], True]
    starts, members, lowest, sizes = [], [], [], []
    alive = np.arange(total)
    for d in range(depth + 1):
        alive = alive[n[alive] >= d]
        first = np.flatnonzero(common[alive] < d) if d else np.zeros(1, np.int64)
        starts.append(alive[first])
        members.append(np.diff(np.r_[first, len(alive)]))
        lowest.append(np.minimum.reduceat(conv[alive], first))
        sizes.append(chars[begin[alive[first]] + d - 1] if d else np.zeros(1, np.int64))
    leaf_rows = np.flatnonzero(is_leaf)
    leaf_rows = leaf_rows[np.argsort(n[leaf_rows], kind="stable")]
    cut = np.searchsorted(n[leaf_rows], np.arange(depth + 2))
    parents = [np.zeros(1, np.int64)] + [np.searchsorted(starts[d - 1], starts[d], "right") - 1 for d in range(1, depth + 1)]
    saved = [(m - 1) * s for m, s in zip(members, sizes, strict=True)]
    leaves = [np.bincount(np.searchsorted(starts[d], leaf_rows[cut[d] : cut[d + 1]], "right") - 1, minlength=len(starts[d])) for d in range(depth + 1)]
    children = [_summed(np.ones(len(parents[d + 1]), np.int64), parents[d + 1], len(starts[d])) if d < depth else np.zeros(len(starts[d]), np.int64) for d in range(depth + 1)]
    for d in range(depth, 0, -1):
        saved[d - 1] = saved[d - 1] + _summed(saved[d], parents[d], len(starts[d - 1]))
        leaves[d - 1] = leaves[d - 1] + _summed(leaves[d], parents[d], len(starts[d - 1]))
    # equal rows are neighbours, in order of conv
    ends_at = np.flatnonzero(np.r_[True, (common[1:] != n[1:]) | (n[1:] != n[:-1])])
    ends_to = np.r_[ends_at[1:], total]
    end_of = dict(zip(ends_at.tolist(), ends_to.tolist(), strict=True))
    none = hashlib.sha256(b"").hexdigest()
    keys = {}
    for row in (0, total - 1):
        h = hashlib.blake2b(digest_size=16)
        keys[row] = [h.digest()]
        for i in range(int(begin[row]), int(begin[row] + n[row])):
            h.update(paths[16 * i : 16 * i + 16])
            keys[row].append(h.copy().digest())
    edges: list[tuple] = []
    inner: list[list] = [[] for _ in range(7)]
    hashes: list[str] = []
    above: list[bytes | None] = []
    for d in range(depth + 1):
        s, p = starts[d], parents[d]
        inside = np.ones(len(s), bool)
        for k in {0 if n[0] >= d else -1, int(np.searchsorted(s, total - 1, "right")) - 1 if n[-1] >= d else -1} - {-1}:
            inside[k] = False
            row = int(s[k])
            on_first, on_last = k == 0 and n[0] >= d, k == len(s) - 1 and n[-1] >= d
            path = keys[0 if on_first else total - 1]
            own = conv[row : end_of[row]].tolist() if n[row] == d else None
            upto = int(chars[begin[row] : begin[row] + d].sum())
            edges.append((True, shard, path[d], path[d - 1] if d else None, int(lowest[d][k]), d, None, int(members[d][k]), int(children[d][k]), int(leaves[d][k]), int(saved[d][k]), None, own, on_first, on_last, int(sizes[d][k]), upto))
        if not inside.any():
            continue
        up = lowest[d - 1][p]
        for to, values in zip(inner, (lowest[d], np.full(len(s), d), up, members[d], children[d], leaves[d], saved[d]), strict=True):
            to.append(values[inside])
        hashes += [_ids_hash(conv[r : end_of[r]]) if n[r] == d else none for r in s[inside].tolist()]
        low, high = (keys[0][d - 1] if n[0] >= d - 1 else None), (keys[total - 1][d - 1] if n[-1] >= d - 1 else None)
        above += [low if low is not None and x == 0 else high if high is not None and x == len(starts[d - 1]) - 1 else None for x in p[inside].tolist()]
    out = [_batch(edges)]
    if hashes:
        m = len(hashes)
        same = [pa.array([False] * m), pa.array(np.full(m, shard)), pa.nulls(m, pa.binary()), pa.array(above, pa.binary())]
        rest = [pa.array(hashes), pa.nulls(m, pa.list_(pa.int64())), pa.array([False] * m), pa.array([False] * m), pa.nulls(m, pa.int64()), pa.nulls(m, pa.int64())]
        out.append(pa.RecordBatch.from_arrays([*same, *(pa.array(np.concatenate(x).astype(np.int64)) for x in inner), *rest], _NAMES))
    return out


_TYPES = [pa.bool_(), pa.int64(), pa.binary(), pa.binary(), *[pa.int64()] * 7, pa.string(), pa.list_(pa.int64()), pa.bool_(), pa.bool_(), pa.int64(), pa.int64()]
_NAMES = [x.split()[0] for x in _PARTIAL.replace("\n", " ").split(",")]


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _TYPES, strict=True)], _NAMES)


def _sharded(most_turns: int, most_rows: int):
    """Cuts a partition's rows, which come in order, into shards, and gives their nodes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[pa.RecordBatch, np.ndarray]] = []
        turns = rows = number = 0

        def close() -> list[pa.RecordBatch]:
            nonlocal held, turns, rows, number
            table = pa.Table.from_batches([b for b, _ in held])
            shard = (table.column("part")[0].as_py() << 32) + number
            chars = np.concatenate([np.asarray(c.flatten(), np.int64) for c in table.column("chars").chunks])
            at = np.r_[0, np.cumsum(np.concatenate([x for _, x in held]))]
            out = shard_nodes(shard, table.column("conv_id").to_numpy(), b"".join(table.column("path").to_pylist()), at, chars)
            held, turns, rows, number = [], 0, 0, number + 1
            return out

        for batch in batches:
            size = np.asarray(pc.binary_length(batch.column("path")), np.int64) // 16
            i = 0
            while i < batch.num_rows:
                upto = np.cumsum(size[i:])
                fit = min(int(np.searchsorted(upto, most_turns - turns, "right")), most_rows - rows)
                j = min(i + max(0 if held else 1, fit), batch.num_rows)
                if j > i:
                    held.append((batch.slice(i, j - i), size[i:j]))
                    turns, rows = turns + int(upto[j - i - 1]), rows + j - i
                if j < batch.num_rows or turns >= most_turns or rows >= most_rows:
                    yield from close()
                i = j
        if held:
            yield from close()

    return run


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """ends_sha256 of each key; rows come by key and shard, a key's are together. Holds one row's ids at a time."""
    now, h = None, hashlib.sha256()
    for batch in batches:
        out: list[tuple[bytes, str]] = []
        for key, ids in zip(batch.column("key").to_pylist(), batch.column("ids"), strict=True):
            if key != now:
                if now is not None:
                    out.append((now, h.hexdigest()))
                now, h, comma = key, hashlib.sha256(), ""
            h.update((comma + ",".join(map(str, ids.as_py()))).encode())
            comma = ","
        if out:
            yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in out], pa.binary()), pa.array([x for _, x in out])], ["key", "ends"])
    if now is not None:
        yield pa.RecordBatch.from_arrays([pa.array([now], pa.binary()), pa.array([h.hexdigest()])], ["key", "ends"])


def trie_nodes(paths: DataFrame, most_turns: int = TURNS, most_rows: int = ROWS) -> DataFrame:
    """One row for each distinct prefix of the paths (conv_id, path, chars): conv_id (smallest member), depth, parent_conv_id,
    n_convs, n_children, n_leaves, saved_tokens and ends_sha256; depth 0 is the root.

    conv_id is unique and not null; paths may be empty; no rows give no node. Equal paths, however many, are dealt by conv_id
    too, so no task gets a group of copies whole; only the hash over one node's ids, which is one sequence, is made by
    one task, which streams it. One conversation's path
    must fit in a row. most_turns and most_rows bound a shard's memory; results don't depend on them."""
    bounded_batches(paths.sparkSession)
    paths = written(paths.select("conv_id", "path", "chars"), "paths")
    ranged = paths.repartitionByRange("path", "conv_id").sortWithinPartitions("path", "conv_id")
    partial = written(ranged.select("conv_id", "path", "chars", F.spark_partition_id().cast("long").alias("part")).mapInArrow(_sharded(most_turns, most_rows), _PARTIAL), "nodes")
    edges = partial.where("edge")
    spread = edges.groupBy("key").agg(F.min("shard").alias("lo"), F.max("shard").alias("hi"))
    edges = edges.join(spread, "key")
    # a shard's first path shares its nodes down to depth `before` with earlier shards, its last path those down to `after` with later ones
    early, late = F.col("on_first") & (F.col("shard") > F.col("lo")), F.col("on_last") & (F.col("shard") < F.col("hi"))
    ends = edges.groupBy("shard").agg(F.max(F.when(early, F.col("depth"))).alias("before"), F.max(F.when(early, F.col("upto"))).alias("before_upto"),
                                      F.max(F.when(late, F.col("depth"))).alias("after"), F.max(F.when(F.col("on_last"), F.col("depth"))).alias("last_depth"))
    fixed = edges.join(ends, "shard")
    once = F.col("on_first") & (F.col("depth") <= F.col("before"))
    nodes = fixed.groupBy("key").agg(
        F.min("conv_id").alias("conv_id"), F.first("depth").alias("depth"), F.first("parent_key").alias("parent_key"), F.sum("n_convs").alias("n_convs"),
        F.sum(F.col("n_children") - F.when(F.col("on_first") & (F.col("depth") < F.col("before")), 1).otherwise(0)).alias("n_children"),
        F.sum(F.col("n_leaves") - F.when(F.col("on_last") & (F.col("after") == F.col("last_depth")), 1).otherwise(0)).alias("n_leaves"),
        F.sum(F.col("saved_tokens") + F.when(once, F.col("before_upto") - F.col("upto") + F.col("chars")).otherwise(0)).alias("saved_tokens"),
    )
    hashes = edges.where("ids IS NOT NULL").select("key", "shard", "ids").repartition("key").sortWithinPartitions("key", "shard").mapInArrow(_hashed, "key binary, ends string")
    up = nodes.select(F.col("key").alias("parent_key"), F.col("conv_id").alias("up"))
    out = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    shared = nodes.join(hashes, "key", "left").join(up, "parent_key", "left").withColumn("parent_conv_id", F.col("up")).withColumn("ends_sha256", F.coalesce("ends", F.sha2(F.lit(""), 256)))
    inner = partial.where("NOT edge")
    # by shard as well, so that the root's children, which may be most nodes, aren't one key
    by_shard = edges.select("shard", "key").join(nodes.select("key", F.col("conv_id").alias("up")), "key").withColumnRenamed("key", "parent_key")
    below = inner.where("parent_key IS NOT NULL").join(by_shard, ["shard", "parent_key"]).withColumn("parent_conv_id", F.col("up"))
    return shared.select(out).unionByName(below.select(out)).unionByName(inner.where("parent_key IS NULL").select(out))


def prefix_trie(conversations: DataFrame) -> DataFrame:
    """The trie of all rebuilt conversations (conv_id, turn, role, text); see ``rebuilt_paths`` and ``trie_nodes``.

    Nulls, ties and repeated rows: as there; a row that is repeated is a turn that is repeated. Other columns are ignored; an empty table gives no row."""
    return trie_nodes(rebuilt_paths(conversations))
