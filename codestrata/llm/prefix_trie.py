"""The trie of conversation prefixes, from sorted matrices of turn ids."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codestrata.session import broadcast_if_small, stage

NOTHING = hashlib.sha256(b"").hexdigest()
_SLAB = 32
_EDGE, _INNER, _END = 0, 1, 2
_KINDS = "kind int, key binary, parent binary, conv_id long, parent_conv_id long, depth long, n_convs long, n_children long, n_leaves long, saved long, last long, ends string"
_NAMES = [c.split()[0] for c in _KINDS.split(", ")]
_SUMS = "key binary, conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long"


def conversations_of(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """conv_id and turns, an array of (turn, id, length) in order: a turn's id is a hash of its role and text, its length code points.

    Null turns come first, and equal ones in the order of their ids. Rows without a conversation are left out.
    """
    said, told = (F.coalesce(F.col(f"`{c}`"), F.lit("")) for c in (role, text))
    one = F.struct(F.col(f"`{turn}`").alias("turn"), F.unhex(F.md5(F.concat(F.md5(said), told))).alias("id"), F.length(told).alias("length"))
    rows = rows.select(F.col(f"`{conv}`").cast("long").alias("conv_id"), one.alias("one")).where("conv_id is not null")
    return rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("one")).alias("turns"))


def with_heads(convs: DataFrame, every: int = 100, heads: int = 6) -> DataFrame:
    """conv_id and the turns it has after its first ones, as many as its head h, gave way to those of its group's first conversation.

    h = crc32(conv_id in decimal) % heads; the group's first conversation is conv_id - conv_id % every, as it was.
    """
    base = convs.where(F.col("conv_id") % every == 0).select(F.col("conv_id").alias("base"), F.slice("turns", 1, heads - 1).alias("head"))
    own = convs.withColumn("h", (F.crc32(F.col("conv_id").cast("string").cast("binary")) % heads).cast("int"))
    met = own.join(base, F.col("conv_id") - F.col("conv_id") % every == F.col("base"), "left")
    first = F.slice(F.coalesce("head", F.slice("turns", 1, 0)), F.lit(1), F.col("h"))
    rest = F.slice("turns", F.col("h") + 1, F.size("turns"))
    return met.select("conv_id", F.concat(first, rest).alias("turns"))


def sorted_rows(codes: np.ndarray, size: np.ndarray, conv: np.ndarray) -> np.ndarray:
    """The order of rows by their turns (a row that ends goes first), then by conversation.

    `codes` holds all rows' turns one after another, `size` how many each has. Slabs of columns are padded with 0 and
    sorted by numpy; only rows that are equal so far and go on are in the next slab.
    """
    begin = np.cumsum(size) - size
    rank = np.zeros(len(size), np.int64)
    for first in range(0, int(size.max(initial=0)), _SLAB):
        shared = np.bincount(rank, minlength=len(size))[rank] > 1
        on = np.flatnonzero(shared & (size > first))
        if not len(on):
            break
        matrix = np.zeros((len(on), _SLAB), np.int64)
        wide = np.minimum(size[on] - first, _SLAB)
        cell = np.arange(int(wide.sum())) - np.repeat(np.cumsum(wide) - wide, wide)
        matrix[np.repeat(np.arange(len(on)), wide), cell] = codes[np.repeat(begin[on] + first, wide) + cell] + 1
        order = np.lexsort([*matrix.T[::-1], rank[on]])
        new = np.ones(len(on), bool)
        new[1:] = (matrix[order][1:] != matrix[order][:-1]).any(axis=1) | (rank[on][order][1:] != rank[on][order][:-1])
        within = np.zeros(len(size), np.int64)
        within[on[order]] = np.cumsum(new)
        rank = np.unique(rank * (len(on) + 1) + within, return_inverse=True)[1]
    return np.lexsort((conv, rank))


def common_prefixes(codes: np.ndarray, begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """How many first turns each row shares with the row before it: changes, OR-accumulated over the columns."""
    shared = np.zeros(len(size), np.int64)
    on = np.arange(1, len(size))
    for first in range(0, int(size.max(initial=0)), _SLAB):
        on = on[np.minimum(size[on], size[on - 1]) > first]
        if not len(on):
            break
        wide = np.minimum(np.minimum(size[on], size[on - 1]) - first, _SLAB)
        column = np.arange(_SLAB)
        inside = column < wide[:, None]
        here, above = (np.where(inside, codes[np.where(inside, (begin[r] + first)[:, None] + column, 0)], -1 - k) for k, r in enumerate((on, on - 1)))
        changed = np.logical_or.accumulate(here != above, axis=1)
        shared[on] += _SLAB - changed.sum(axis=1)
        on = on[~changed[:, -1]]
    return shared


def _trail(turns: np.ndarray) -> list[bytes]:
    """The key of every prefix of a row of turn ids, the empty one first."""
    digest = hashlib.blake2b(digest_size=16)
    out = [digest.digest()]
    for turn in turns:
        digest.update(bytes(turn))
        out.append(digest.copy().digest())
    return out


def _hashed(ids: list[int]) -> str:
    return hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()


def _gathered(batches, rows: int = 20_000):
    """The batches in larger ones: a deep trie has few nodes a depth."""
    held, count = [], 0
    for batch in batches:
        held.append(batch)
        count += batch.num_rows
        if count >= rows:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()
            held, count = [], 0
    if held:
        yield from pa.Table.from_batches(held).combine_chunks().to_batches()


def _sharder(batches):
    return _gathered(_nodes(batches))


def _nodes(batches):
    """The nodes of a range of rows: inner ones whole, those that its first or last row is in as parts.

    Only these edge nodes can go on in another range. What their inner descendants sum to stays with them; the
    conversations that end at them follow as rows of their own.
    """
    rows = pa.Table.from_batches(list(batches)).combine_chunks() if (batches := [b for b in batches if b.num_rows]) else None
    if rows is None:
        return
    conv, lists = rows.column(0).to_numpy(), rows.column(1).combine_chunks()
    offsets = lists.offsets.to_numpy().astype(np.int64)
    offsets, size = offsets - offsets[0], np.diff(offsets)
    turns = lists.flatten()
    digests = np.frombuffer(b"".join(turns.field("id").to_pylist()), "V16") if len(turns) else np.zeros(0, "V16")
    length = turns.field("length").to_numpy().astype(np.int64)
    pairs = digests.view(">u8").reshape(-1, 2)
    at = np.lexsort((pairs[:, 1], pairs[:, 0]))
    step = np.zeros(len(at), np.int64)
    step[1:] = (pairs[at][1:] != pairs[at][:-1]).any(axis=1)
    codes = np.zeros(len(at), np.int64)
    codes[at] = np.cumsum(step)

    order = sorted_rows(codes, size, conv)
    conv, size, begin = conv[order], size[order], offsets[:-1][order]
    shared = common_prefixes(codes, begin, size)
    n, deepest = len(conv), int(size.max())
    trails = [_trail(digests[begin[r] : begin[r] + size[r]]) for r in (0, n - 1)]

    levels = []
    for depth in range(deepest + 1):
        alive = np.flatnonzero(size >= depth)
        opens = np.flatnonzero((shared[alive] < depth) | (alive == 0)) if depth else np.zeros(1, np.int64)
        first = alive[opens]
        n_convs = np.diff(np.append(opens, len(alive)))
        ended = np.add.reduceat((size[alive] == depth).astype(np.int64), opens)
        least = np.minimum.reduceat(conv[alive], opens)
        last = length[begin[first] + depth - 1] if depth else np.zeros(1, np.int64)
        final = np.append(first[1:], n) - 1
        edge = (first == 0) | ((np.arange(len(first)) == len(first) - 1) & (size[n - 1] >= depth))
        levels.append((first, n_convs, ended, least, last, edge, final))

    below = None
    for depth in range(deepest, -1, -1):
        first, n_convs, ended, least, last, edge, _ = levels[depth]
        children, leaves, saved = (np.zeros(len(first), np.int64) for _ in range(3))
        if below is not None:
            up = np.searchsorted(first, levels[depth + 1][0], "right") - 1
            inner = ~levels[depth + 1][5]
            for total, amount in zip((children, leaves, saved), (np.ones(len(up), np.int64), *below), strict=True):
                np.add.at(total, up[inner], amount[inner])
        whole_leaves = np.where(children == 0, 1, leaves)
        whole_saved = saved + (n_convs - 1) * last
        below = whole_leaves, whole_saved
        parent = np.zeros(len(first), np.int64) if not depth else np.searchsorted(levels[depth - 1][0], first, "right") - 1
        parent_edge = np.ones(len(first), bool) if not depth else levels[depth - 1][5][parent]
        parent_conv = None if not depth else levels[depth - 1][3][parent]

        def trail(i):
            return trails[0] if first[i] == 0 else trails[1]

        places = np.flatnonzero(edge)
        out = [(_EDGE, trail(i)[depth], trail(i)[depth - 1] if depth else None, int(least[i]), None, depth, int(n_convs[i]), int(children[i]),
                int(leaves[i]), int(saved[i]), int(last[i]), None) for i in places]
        for i in places[ended[places] > 0]:
            # Rows that end at an edge node are its first ones.
            out += [(_END, trail(i)[depth], None, c, *[None] * 8) for c in conv[first[i] : first[i] + ended[i]].tolist()]
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*out, strict=True), _TYPES, strict=True)], names=_NAMES)
        places = np.flatnonzero(~edge)
        if len(places):
            hashes = [_hashed(conv[first[i] : first[i] + ended[i]].tolist()) if ended[i] else NOTHING for i in places]
            above = parent_edge[places]
            # An inner node under an edge node starts with another row's turns, but its parent is on a trail.
            keys = [None if not e else (trails[0] if levels[depth - 1][0][p] == 0 else trails[1])[depth - 1] for e, p in zip(above, parent[places], strict=True)]
            yield pa.RecordBatch.from_arrays([
                pa.array([_INNER] * len(places), pa.int32()), pa.nulls(len(places), pa.binary()), pa.array(keys, pa.binary()),
                pa.array(least[places], pa.int64()), pa.array(parent_conv[places], pa.int64(), mask=above), pa.array([depth] * len(places), pa.int64()),
                *(pa.array(x[places], pa.int64()) for x in (n_convs, children, whole_leaves, whole_saved, last)), pa.array(hashes),
            ], names=_NAMES)


_TYPES = [pa.int32(), pa.binary(), pa.binary(), *[pa.int64()] * 8, pa.string()]


def _recombined(table: pa.Table) -> pa.Table:
    """The edge nodes of all ranges, one row each with the sums over their subtrees."""
    columns = {c: table.column(c).to_pylist() for c in ("key", "parent")}
    place = {key: i for i, key in enumerate(columns["key"])}
    above = np.array([place.get(p, -1) for p in columns["parent"]], np.int64)
    conv, depth, n_convs, children, leaves, saved, last = (
        table.column(c).to_numpy().copy() for c in ("conv_id", "depth", "n_convs", "n_children", "n_leaves", "saved", "last"))
    saved += (n_convs - 1) * last
    np.add.at(children, above[above >= 0], 1)
    for d in range(int(depth.max(initial=0)), -1, -1):
        rows = np.flatnonzero(depth == d)
        leaves[rows[children[rows] == 0]] = 1
        if d:
            np.add.at(leaves, above[rows], leaves[rows])
            np.add.at(saved, above[rows], saved[rows])
    up = pa.array(conv[above], pa.int64(), mask=above < 0)
    return pa.table([table.column("key"), pa.array(conv), pa.array(depth), up, *(pa.array(x) for x in (n_convs, children, leaves, saved))],
                    names=[c.split()[0] for c in _SUMS.split(", ")])


def _end_hasher(batches):
    """key and ends_sha256 from rows in the order of key and conv_id; a node's ids are never held together."""
    key, digest = None, None
    for batch in batches:
        done = []
        for k, c in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if k != key:
                if key is not None:
                    done.append((key, digest.hexdigest()))
                key, digest = k, hashlib.sha256(str(c).encode())
            else:
                digest.update(f",{c}".encode())
        yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in done], pa.binary()), pa.array([h for _, h in done], pa.string())], names=["key", "hash"])
    if key is not None:
        yield pa.RecordBatch.from_arrays([pa.array([key], pa.binary()), pa.array([digest.hexdigest()])], names=["key", "hash"])


def trie(convs: DataFrame, shard_turns: int = 200_000) -> DataFrame:
    """The nodes of the trie of `convs` (conv_id, turns of id and length), one row for every distinct sequence of first turns.

    conv_id (the smallest member), depth, parent_conv_id (null at the root), n_convs, n_children, n_leaves (childless nodes of the
    subtree), saved_tokens (over the subtree: (n_convs - 1) times the length of a node's last turn) and ends_sha256 (of the
    ids of the members that end there, ascending, comma-joined).

    Conversations are range-sorted by their turns, then by id, into ranges of about `shard_turns` turns and ids; so neither a first turn
    nor a whole conversation that many share makes one large task. A task sorts the padded matrix of its turn ids, column changes
    mark where nodes start, and reductions over the marks aggregate every depth. Nodes of its first or last row may go on in other ranges:
    they are recombined by a key of their turns, two paths a range, whatever the number of conversations. The ids that end at
    such a node pass one task in order, as its hash demands, but are not held.

    A conversation is one row of 28 bytes a turn in one task. One without turns is a member of the root. Rows that repeat a
    conversation's id and turns are turns like others. An empty table has no nodes. Null conversation ids take no part.
    """
    convs = stage(convs.select("conv_id", F.transform("turns", lambda t: F.struct(t["id"].alias("id"), t["length"].alias("length"))).alias("turns")), "conversations")
    total = convs.agg(F.sum(F.size("turns") + 1)).first()[0] or 0
    path = F.transform("turns", lambda t: t["id"])
    ranges = convs.withColumn("path", path).repartitionByRange(max(1, -(-total // shard_turns)), "path", "conv_id").drop("path")
    nodes = stage(ranges.mapInArrow(_sharder, _KINDS), "nodes")
    edges = nodes.where(F.col("kind") == _EDGE).groupBy("key").agg(
        F.first("parent").alias("parent"), F.min("conv_id").alias("conv_id"), F.first("depth").alias("depth"), F.first("last").alias("last"),
        *(F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved")))
    edges = stage(edges.groupBy(F.lit(0).alias("all")).applyInArrow(lambda t: _recombined(t.drop_columns([c for c in t.column_names if c == "all"])), _SUMS), "edges")
    ends = nodes.where(F.col("kind") == _END).select("key", "conv_id")
    hashes = ends.repartition("key").sortWithinPartitions("key", "conv_id").mapInArrow(_end_hasher, "key binary, hash string")
    shown = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens"]
    outer = edges.join(broadcast_if_small(stage(hashes, "ends")), "key", "left").select(*shown, F.coalesce("hash", F.lit(NOTHING)).alias("ends_sha256"))
    above = broadcast_if_small(edges.select(F.col("key").alias("up"), F.col("conv_id").alias("up_conv")))
    inner = nodes.where(F.col("kind") == _INNER).join(above, F.col("parent") == F.col("up"), "left").select(
        "conv_id", "depth", F.coalesce("up_conv", "parent_conv_id").alias("parent_conv_id"), "n_convs", "n_children", "n_leaves",
        F.col("saved").alias("saved_tokens"), F.col("ends").alias("ends_sha256"))
    return outer.unionByName(inner)
