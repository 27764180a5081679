"""Links between near-equal vectors of a label, found by counting collisions in windows along sorted projections."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codestrata.llm.near_dup import components
from codestrata.llm.ordering import runs
from codestrata.session import broadcast_if_small, stage

SEED = 20_240_501
#: Projections whose windows are counted, and half a window's width as a multiple of the distance of a pair at the threshold.
PROJECTIONS, WINDOW = 16, 2.0
#: The window along which a task's rows are sorted is wider: no pair is lost to it alone but one in 16,000.
SORT_WINDOW = 4.0
#: A grid cell's width as a multiple of that distance.
CELL = 4.0
_TILE = 256
_ROWS = 65_536


def distance(cosine: float) -> float:
    """Between vectors of length one."""
    return math.sqrt(2 - 2 * cosine)


def _within(sigmas: float) -> float:
    return math.erf(sigmas / math.sqrt(2))


def least_collisions(miss: float) -> int:
    """The count that a pair at the threshold falls below with odds of at most `miss`.

    Along a Gaussian direction a pair's difference is normal with the pair's distance as deviation, whatever the vectors.
    """
    p, total = _within(WINDOW), 0.0
    for count in range(PROJECTIONS + 1):
        total += math.comb(PROJECTIONS, count) * p**count * (1 - p) ** (PROJECTIONS - count)
        if total > miss:
            return count
    return PROJECTIONS


def _same_cell(ratio: float) -> float:
    """Odds that two numbers share a cell of a randomly shifted grid, `ratio` being its width over the deviation of their difference."""
    return _within(ratio) - 2 / (math.sqrt(2 * math.pi) * ratio) * (1 - math.exp(-ratio * ratio / 2))


def tables(rows: int, block: int, cosine: float, miss: float) -> tuple[int, int]:
    """How many grid projections make a cell, and how many tables of such cells: a rule without steps for the size.

    Vectors at right angles fill a cell with about `block` rows, and a pair at the threshold shares no cell of any table with
    odds of at most `miss`.
    """
    gap = distance(cosine)
    depth = max(0, math.ceil(math.log(max(1.0, rows / block)) / -math.log(_same_cell(CELL * gap / math.sqrt(2)))))
    if not depth:
        return 0, 1
    return depth, math.ceil(math.log(miss) / math.log(1 - _same_cell(CELL) ** depth))


def directions(width: int, count: int, what: int) -> np.ndarray:
    """The same Gaussian directions in every task."""
    return np.random.default_rng([SEED, what, width]).normal(size=(count, width))


def _arrays(column: pa.Array, single: bool) -> list[np.ndarray]:
    kind = np.float32 if single else np.float64
    return [np.frombuffer(b, kind) for b in column.to_pylist()]


def _cleaner(single: bool):
    """vec_id, and node (a hash of label and vector), label, width and v of vectors that can link; null otherwise."""
    import xxhash

    def clean(batches):
        for batch in batches:
            vectors = batch.column(2)
            flat = vectors.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False)  # null components become NaN
            ends = np.concatenate([[0], np.cumsum(np.diff(vectors.offsets.to_numpy()) * ~vectors.is_null().to_numpy(zero_copy_only=False))])
            nodes, stored = [], []
            for i, label in enumerate(batch.column(1).to_pylist()):
                v = flat[ends[i] : ends[i + 1]]
                if label is None or not v.size or not np.isfinite(v).all() or not v.any():
                    nodes.append(None)
                    stored.append(None)
                    continue
                stored.append((v + 0.0).astype(np.float32 if single else np.float64).tobytes())  # + 0.0: -0.0 is 0.0
                nodes.append(xxhash.xxh3_128_digest(f"{len(label)}:{label}".encode() + stored[-1]))
            bad = pa.array([n is None for n in nodes], pa.bool_())
            width = pa.array(np.diff(ends).astype(np.int32), mask=bad.to_numpy(zero_copy_only=False))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(nodes, pa.binary()), pa.compute.if_else(bad, None, batch.column(1)), width, pa.array(stored, pa.binary())],
                names=["vec_id", "node", "label", "width", "v"])
    return clean


def _unit(rows: np.ndarray) -> np.ndarray:
    """Scaled to length one; the largest component first, so that no square over- or underflows."""
    rows = rows / np.abs(rows).max(axis=1, keepdims=True)
    return rows / np.sqrt((rows * rows).sum(axis=1, keepdims=True))


def _cells(rows: np.ndarray, depth: int, count: int, gap: float) -> np.ndarray:
    """Rows × tables: a hash of the row's cell in each table."""
    if not depth:
        return np.zeros((len(rows), 1), np.int64)
    width = rows.shape[1]
    shift = np.random.default_rng([SEED, 3, depth, count]).random(depth * count)
    cell = np.floor(rows @ directions(width, depth * count, 2).T / (CELL * gap) + shift).astype(np.int64).view(np.uint64).reshape(len(rows), count, depth)
    key = np.full((len(rows), count), 0x9E3779B97F4A7C15, np.uint64)
    for k in range(depth):
        key = (key ^ cell[:, :, k]) * np.uint64(0xC2B2AE3D27D4EB4F)
        key ^= key >> np.uint64(29)
        key *= np.uint64(0x9E3779B97F4A7C15)
        key ^= key >> np.uint64(32)
    return key.view(np.int64)


def _key(label: str, width: int, table: int, cell: int) -> bytes:
    import xxhash

    return xxhash.xxh3_128_digest(f"{width}:{table}:{cell}:{label}".encode())


def _placer(cosine: float, miss: float, block_bytes: int, single: bool, first_only: bool):
    """Every vector once a table: key (its cell), at (the table), node, weight, v, cells (those of all tables) and core."""
    def place(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            label, width, rows = (batch.column(c).to_pylist() for c in (2, 3, 4))
            vectors = _arrays(batch.column(5), single)
            groups: dict[tuple[int, int, int], list[int]] = {}
            for i, (w, n) in enumerate(zip(width, rows, strict=True)):
                block = block_rows(w, block_bytes)
                if not first_only or n > block:
                    groups.setdefault((w, *tables(n, block, cosine, miss)), []).append(i)
            for (w, depth, count), places in groups.items():
                for a in range(0, len(places), max(1, _ROWS // count)):
                    some = places[a : a + max(1, _ROWS // count)]
                    cells = _cells(_unit(np.stack([vectors[i] for i in some]).astype(np.float64)), depth, count, distance(cosine))
                    at = np.zeros(len(some), np.int64) if first_only else np.tile(np.arange(count), len(some))
                    which = np.arange(len(some)) if first_only else np.repeat(np.arange(len(some)), count)
                    keys = [_key(label[some[i]], w, t, cells[i, t]) for i, t in zip(which.tolist(), at.tolist(), strict=True)]
                    taken = batch.take(pa.array(np.array(some)[which]))
                    yield pa.RecordBatch.from_arrays([
                        pa.array(keys, pa.binary()), pa.array(at.astype(np.int32)), taken.column(0), taken.column(1), taken.column(3), taken.column(5),
                        pa.array([cells[i].tobytes() for i in which.tolist()], pa.binary()), taken.column(6),
                    ], names=["key", "at", "node", "weight", "width", "v", "cells", "core"])
    return place


def block_rows(width: int, block_bytes: int) -> int:
    """Rows of a cell, or of a part of one, that a task holds at once."""
    return max(16, block_bytes // (8 * max(1, width)))


def _summer(single: bool):
    """key and the sum of its vectors, one row a task and key."""
    def add(batches):
        sums: dict[bytes, np.ndarray] = {}
        for batch in batches:
            for key, v in zip(batch.column(0).to_pylist(), _arrays(batch.column(1), single), strict=True):
                unit = _unit(v[None, :].astype(np.float64))[0]
                sums[key] = sums[key] + unit if key in sums else unit
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.binary()), pa.array([s.tobytes() for s in sums.values()], pa.binary())], names=["key", "v"])
    return add


def _total(table: pa.Table) -> pa.Table:
    sums = sum(np.frombuffer(b, np.float64) for b in table.column("v").to_pylist())
    return pa.table({"key": table.column("key").slice(0, 1), "center": pa.array([sums.tobytes()], pa.binary())})


def _core_marker(cosine: float, single: bool):
    """node and the key of its first cell, for vectors within half the threshold's angle of the cell's centre."""
    least = math.cos(math.acos(cosine) / 2) + 1e-9

    def mark(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            keep = []
            for v, center in zip(_arrays(batch.column(2), single), batch.column(3).to_pylist(), strict=True):
                c = np.frombuffer(center, np.float64)
                size = math.sqrt(c @ c)
                keep.append(size > 0 and float(_unit(v[None, :].astype(np.float64))[0] @ c) >= least * size)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["node", "core"]).filter(pa.array(keep, pa.bool_()))
    return mark


class _Forest:
    """Connected rows of a run, by the least place of each set."""

    def __init__(self, n: int):
        self.root = np.arange(n)

    def join(self, a: np.ndarray, b: np.ndarray) -> None:
        while True:
            while (self.root[self.root] != self.root).any():
                self.root = self.root[self.root]
            x, y = self.root[a], self.root[b]
            differ = x != y
            if not differ.any():
                return
            a, b, x, y = a[differ], b[differ], x[differ], y[differ]
            np.minimum.at(self.root, np.maximum(x, y), np.minimum(x, y))


def linked(rows: np.ndarray, weight: np.ndarray, side: np.ndarray, cells: np.ndarray, core: np.ndarray, at: int, cosine: float, miss: float) -> tuple[np.ndarray, np.ndarray, int]:
    """Of rows of one cell: the weight each links with, the least place it is connected with, and how many pairs were verified.

    Rows are sorted along one projection, another in every table. Tiles of neighbours meet the rows after them within its window;
    windows centred on the tile's rows along all projections count collisions, and pairs with enough of them
    have their cosine taken. A pair that shares a cell of an earlier table was met there; rows of one core are known to link.
    With two sides only pairs across them are new.
    """
    gap, n = distance(cosine), len(rows)
    along = rows @ directions(rows.shape[1], PROJECTIONS, 1).T
    lead = along[:, at % PROJECTIONS]
    order = np.argsort(lead, kind="stable")
    lead, rows, weight, side, cells, core, along = (x[order] for x in (lead, rows, weight, side, cells, core, along.astype(np.float32)))
    past = np.searchsorted(lead, lead + SORT_WINDOW * gap, "right")
    need, links, forest, verified = least_collisions(miss), np.zeros(n, np.int64), _Forest(n), 0
    two, half = (side != side[0]).any(), np.float32(WINDOW * gap)
    for a in range(0, n, _TILE):
        b = min(n, a + _TILE)
        end = int(past[b - 1])
        if end <= a + 1:
            continue
        count = np.zeros((b - a, end - a), np.uint8)
        for k in range(PROJECTIONS):
            count += np.abs(along[a:b, k][:, None] - along[a:end, k][None, :]) <= half
        ok = count >= need
        ok &= np.arange(b - a)[:, None] < np.arange(end - a)[None, :]
        if two:
            ok &= side[a:b][:, None] != side[a:end][None, :]
        q, r = np.nonzero(ok)
        q, r = q + a, r + a
        new = (core[q] != core[r]) | (core[q] < 0)
        if at:
            new &= ~(cells[q, :at] == cells[r, :at]).any(axis=1)
        q, r = q[new], r[new]
        verified += len(q)
        for c in range(0, len(q), 1 << 16):
            x, y = q[c : c + (1 << 16)], r[c : c + (1 << 16)]
            good = np.einsum("ij,ij->i", rows[x], rows[y]) >= cosine
            x, y = x[good], y[good]
            np.add.at(links, x, weight[y])
            np.add.at(links, y, weight[x])
            forest.join(x, y)
    out, head = np.zeros(n, np.int64), np.zeros(n, np.int64)
    out[order], head[order] = links, order[forest.root]
    return out, head, verified


def _linker(cosine: float, miss: float, single: bool):
    """node, links and head (the node whose set it is in) of the rows of every run that have links."""
    def link(batches):
        for run in runs(batches, 3):
            if run.num_rows < 2:
                continue
            run = run.combine_chunks()
            column = lambda c: run.column(c).combine_chunks()
            rows = _unit(np.stack(_arrays(column("v"), single)).astype(np.float64))
            cells = np.stack([np.frombuffer(b, np.int64) for b in column("cells").to_pylist()])
            core = column("core").dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
            links, head, _ = linked(rows, column("weight").to_numpy(), column("side").to_numpy(), cells, core, run.column("at")[0].as_py(), cosine, miss)
            some = pa.array(np.flatnonzero(links))
            if len(some):
                yield pa.RecordBatch.from_arrays([
                    column("node").take(some), pa.array(links).take(some), column("node").take(pa.array(head).take(some))], names=["node", "links", "head"])
    return link


def _cores(nodes: DataFrame, cosine: float, miss: float, block_bytes: int, single: bool) -> DataFrame | None:
    """(node, core) of the vectors at the centre of a first-table cell of more than a block of rows, or None.

    Vectors within half the threshold's angle of one centre link with each other, by the triangle inequality of
    angles; so a large group of near copies is counted, not compared.
    """
    size = F.greatest(F.lit(16), F.floor(F.lit(block_bytes) / (8 * F.col("width"))))
    first = nodes.where(F.col("rows") > size)
    if first.isEmpty():
        return None
    schema = "key binary, at int, node binary, weight long, width int, v binary, cells binary, core binary"
    placed = stage(first.withColumn("core", F.lit(None).cast("binary")).mapInArrow(_placer(cosine, miss, block_bytes, single, True), schema), "first-cells")
    hot = stage(placed.groupBy("key", "width").agg(F.count(F.lit(1)).alias("rows")).where(F.col("rows") > size).select("key"), "hot-cells")
    if hot.isEmpty():
        return None
    inside = placed.join(broadcast_if_small(hot), "key").select("key", "node", "v")
    sums = stage(inside.select("key", "v").mapInArrow(_summer(single), "key binary, v binary"), "sums")
    centers = stage(sums.groupBy("key").applyInArrow(_total, "key binary, center binary"), "centers")
    near = inside.join(broadcast_if_small(centers), "key").select("node", "key", "v", "center")
    return stage(near.mapInArrow(_core_marker(cosine, single), "node binary, core binary"), "cores")


def links(vectors: DataFrame, cosine: float = 0.93, id_col: str = "vec_id", vector: str = "embedding", label: str = "label",
          recall: float = 0.999, block_bytes: int = 4 << 20) -> DataFrame:
    """vec_id, n_links, component_id and kept of every row: rows of a label with a cosine of `cosine` or more are linked.

    Equal vectors of a label become one node with a weight. A node is placed in the cells of several tables (`tables`), so that
    a pair at the threshold is missed with odds of at most 1 - `recall`, and closer ones far less; within a cell `linked`
    counts collisions and verifies, and a pair is counted in the first table that it shares a cell of. No pair leaves
    a task: a node's row brings its links and the head of its set. A cell of more than `block_bytes` of vectors is dealt into parts
    and its pairs of parts over tasks; a group of near copies about one centre is a core (`_cores`), whose parts do not meet each other.

    Vectors that are null, empty, zero or hold null or non-finite components, and rows without a label, link with nothing, and only
    vectors of equal length are compared. component_id is the smallest id reachable, null where no row there has an id, and
    kept says that it is the row's own. Rows that repeat an id are rows of their own. An empty table gives no rows. Other columns
    are not read.
    """
    single = dict(vectors.select(F.col(f"`{vector}`").alias("v")).dtypes)["v"] == "array<float>"
    given = vectors.select(F.col(f"`{id_col}`").cast("long").alias("vec_id"), F.col(f"`{label}`").cast("string").alias("label"), F.col(f"`{vector}`").alias("v"))
    clean = stage(given.mapInArrow(_cleaner(single), "vec_id long, node binary, label string, width int, v binary"), "vectors")
    nodes = clean.where("node is not null").groupBy("node").agg(
        F.count(F.lit(1)).alias("weight"), F.min("vec_id").alias("least"), F.first("label").alias("label"), F.first("width").alias("width"), F.first("v").alias("v"))
    nodes = stage(nodes, "distinct-vectors")
    sizes = nodes.groupBy("label", "width").agg(F.count(F.lit(1)).alias("rows"))
    sized = nodes.join(broadcast_if_small(sizes), ["label", "width"]).select("node", "weight", "label", "width", "rows", "v")
    miss = (1 - recall) / 2
    cores = _cores(sized, cosine, miss, block_bytes, single)
    marked = sized.withColumn("core", F.lit(None).cast("binary")) if cores is None else sized.join(cores, "node", "left").select(*sized.columns, "core")
    schema = "key binary, at int, node binary, weight long, width int, v binary, cells binary, core binary"
    placed = marked.mapInArrow(_placer(cosine, miss, block_bytes, single, False), schema)
    hot = None
    if cores is not None or not sized.where(F.col("rows") > F.greatest(F.lit(16), F.floor(F.lit(block_bytes) / (8 * F.col("width"))))).isEmpty():
        placed = stage(placed, "placed")
        block = F.greatest(F.lit(16), F.floor(F.lit(block_bytes) / (8 * F.first("width"))))
        counts = placed.groupBy("key", "core").agg(F.count(F.lit(1)).alias("rows"), block.alias("block"))
        parts = F.struct("core", F.ceil(F.col("rows") / F.col("block")).cast("int").alias("parts"))
        hot = counts.groupBy("key").agg(F.sum("rows").alias("rows"), F.first("block").alias("block"), F.sort_array(F.collect_list(parts)).alias("dealt"))
        hot = stage(hot.where("rows > block").select("key", "dealt"), "hot-cells")
    if hot is not None:
        met = placed.join(broadcast_if_small(hot), "key", "left")
        before = F.expr("aggregate(dealt, named_struct('n', 0, 'mine', -1), (s, d) -> named_struct('n', s.n + d.parts, 'mine', if(d.core <=> core, s.n, s.mine)))")
        met = met.withColumn("sum", before).withColumn("parts", F.expr("element_at(filter(dealt, d -> d.core <=> core), 1).parts"))
        side = F.when(F.col("dealt").isNull(), 0).otherwise(F.col("sum.mine") + F.pmod(F.xxhash64("node"), F.col("parts")).cast("int"))
        met = met.withColumn("side", side)
        # Parts of the same core need not meet; parts of a cell do otherwise, each with itself as well.
        others = F.expr("if(dealt is null, array(0), filter(sequence(0, sum.n - 1), p -> core is null or p < sum.mine or p >= sum.mine + parts))")
        met = met.withColumn("other", F.explode(others)).withColumn("low", F.least("side", "other")).withColumn("high", F.greatest("side", "other"))
    else:
        met = placed.withColumns({"side": F.lit(0), "low": F.lit(0), "high": F.lit(0)})
    met = met.select("key", "low", "high", "at", "node", "weight", "v", "cells", "core", "side")
    runs = met.repartition("key", "low", "high").sortWithinPartitions("key", "low", "high")
    found = stage(runs.mapInArrow(_linker(cosine, miss, single), "node binary, links long, head binary"), "links")
    amounts, edges = found.groupBy("node").agg(F.sum("links").alias("links")), found.where("node <> head").select(F.col("node").alias("x"), F.col("head").alias("y"))
    facts = nodes.select("node", "weight", "least").join(amounts, "node", "left")
    if cores is None:
        facts = facts.select("node", "least", (F.col("weight") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"))
    else:
        held = nodes.select("node", "weight").join(cores, "node").groupBy("core").agg(F.sum("weight").alias("all"), F.min("node").alias("head"))
        held = cores.join(broadcast_if_small(stage(held, "core-sums")), "core")
        edges = edges.unionByName(held.where("node <> head").select(F.col("node").alias("x"), F.col("head").alias("y")))
        # The other members of the core take the place of the copies, which are among them.
        facts = facts.join(held.select("node", "all"), "node", "left").select(
            "node", "least", (F.coalesce("all", "weight") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"))
    facts = stage(facts.join(components(edges), "node", "left").withColumn("comp", F.coalesce("comp", "node")), "facts")
    least = facts.groupBy("comp").agg(F.min("least").alias("component_id"))
    facts = facts.join(least, "comp").select(F.col("node").alias("of"), "n_links", "component_id")
    out = clean.select("vec_id", "node").join(facts, F.col("node") == F.col("of"), "left")
    component = F.when(F.col("of").isNull(), F.col("vec_id")).otherwise(F.col("component_id"))
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"),
                      F.col("vec_id").eqNullSafe(component).alias("kept"))
