"""Exact near-duplicate embeddings by dual traversal of cover trees.

Vectors are points on the unit sphere, where cosine >= c is distance <= sqrt(2 - 2 c). A cover tree has nested levels
with halving radii; a pair of nodes is pruned when the distance of their centres exceeds the sum of their covering
radii and the link distance.

1. Equal vectors (128 bits of hash) become one class, combined on the map side, with a count: a vector that a third
   of all rows share is a row a task.
2. The upper levels are built as tables. The vectors of one length are a cell; a cell with more than `block` vectors
   gets a net of up to `fan` centres, more than half its radius apart, from a few hundred of its vectors, and each
   vector goes to its nearest centre. Covering radii come from all vectors. After each level, pairs of cells are pruned
   by their bounds, and only children of surviving pairs are paired. A cell that is too big but lies closer together
   than a link is long isn't split: all its vectors link with each other. A cell may be several blocks, up to SIDE
   bytes, and a net has no more centres than its cell needs, so cells and their pairs don't outnumber the data.
3. Each surviving pair of cells is a tile: trees are grown below the two cells and traversed against each other down to
   leaves, whose cosines are taken in single precision with a margin and then exactly in double precision.
4. Tiles are worked off in turns. A turn's tiles hold about as many bytes as all vectors do, and its shuffle goes at its
   end, so disk follows the input and not the number of pairs. Each level's table goes once the next one is written.
5. Tasks return link counts and a spanning forest of the links they found, never all pairs; forests are joined to
   components.

Vectors that are null, empty, zero or hold null or non-finite components link with nothing; vectors of different
lengths link with nothing. A null vec_id links with nothing. Rows of one vec_id count as vectors each.
On data without clusters, no bound prunes in high dimension, and the work is that of all pairs of cells: time grows
with the square of the vectors there, and so do the bytes shuffled over all turns, divided by those of a cell.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lectern.plans.components import connected_components
from lectern.plans.stage import Workspace

COSINE, LEAF, FAN = 0.95, 128, 48
SLACK = 1e-5  # on bounds, for rounding
#: Bytes of vectors of a tile's side, blocks of a side at most, and the least bytes of a turn of tiles.
SIDE, SPREAD, TURN = 1 << 24, 16, 1 << 28


class Node:
    __slots__ = ("center", "radius", "rows", "children")

    def __init__(self, center: np.ndarray, radius: float, rows: np.ndarray, children: list[Node]):
        self.center, self.radius, self.rows, self.children = center, radius, rows, children


def _distances(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(((x - c) ** 2).sum(1), 0))


def build(unit: np.ndarray, rows: np.ndarray, scale: float = 2.0, leaf: int = LEAF, fan: int = FAN) -> Node:
    """The tree over unit[rows]: children are a greedy net of half the radius. A node whose net would have more than `fan` children stays a leaf."""
    center = unit[rows[0]]
    d = _distances(unit[rows], center)
    radius = float(d.max())
    if len(rows) <= leaf or radius < 1e-6:
        return Node(center, radius, rows, [])
    while scale / 2 >= radius:
        scale /= 2
    half, left, parts = scale / 2, rows, []
    while len(left):
        if len(parts) == fan:
            return Node(center, radius, rows, [])
        near = _distances(unit[left], unit[left[0]]) <= half
        parts.append(left[near])
        left = left[~near]
    if len(parts) == 1:
        return Node(center, radius, rows, [])
    return Node(center, radius, rows, [build(unit, p, half, leaf, fan) for p in parts])


def grow(unit: np.ndarray, rows: np.ndarray, block: int, fan: int = FAN, depth: int = 0) -> Node:
    """The tree over unit[rows] by nets and nearest centres, as cells are split. Below `block` rows a split stays only
    where it draws the radii in; nodes that don't get any are built greedily."""
    if len(rows) <= LEAF or depth > 40:
        return build(unit, rows)
    center = unit[rows[0]]
    radius = float(_distances(unit[rows], center).max())
    net = net_of(unit[rows[:: -(-len(rows) // 512)]], radius, fan, 1e-3)
    near = (unit[rows] @ net.T).argmax(1)
    parts = [rows[near == k] for k in np.unique(near)]
    if len(parts) == 1:
        return build(unit, rows)
    if len(rows) <= block and sum(len(p) * float(_distances(unit[p], unit[p[0]]).max()) for p in parts) > 0.7 * radius * len(rows):
        return build(unit, rows)
    return Node(center, radius, rows, [grow(unit, p, block, fan, depth + 1) for p in parts])


def traverse(a: Node, b: Node, reach: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows of leaf pairs that the bounds don't prune; each unordered pair of nodes of one tree once."""
    todo = [(a, b)]
    while todo:
        p, q = todo.pop()
        if p is not q and float(np.sqrt(((p.center - q.center) ** 2).sum())) > p.radius + q.radius + reach + SLACK:
            continue
        if p is q and p.children:
            todo += [(x, y) for i, x in enumerate(p.children) for y in p.children[i:]]
        elif not p.children and not q.children:
            yield p.rows, q.rows
        elif p.children and (not q.children or p.radius >= q.radius):
            todo += [(x, q) for x in p.children]
        else:
            todo += [(p, y) for y in q.children]


class _Links:
    """Counts and a spanning forest of the links found between two blocks (or within one)."""

    def __init__(self, ids: np.ndarray, weights: np.ndarray):
        self.ids, self.weights = ids, weights
        self.count = np.zeros(len(ids), np.int64)
        self.label = np.arange(len(ids))

    def root(self, i: int) -> int:
        while self.label[i] != i:
            self.label[i] = self.label[self.label[i]]
            i = self.label[i]
        return i

    def add(self, i: np.ndarray, j: np.ndarray) -> None:
        np.add.at(self.count, i, self.weights[j])
        np.add.at(self.count, j, self.weights[i])
        # a hub takes its partners at once, so that a dense block costs one step a row
        order = np.argsort(i, kind="stable")
        i, j = i[order], j[order]
        first = np.flatnonzero(np.concatenate([[True], i[1:] != i[:-1]])) if len(i) else np.zeros(0, int)
        for k, stop in zip(first, [*first[1:], len(i)], strict=True):
            mine = self.root(int(i[k]))
            for r in np.unique(self.label[j[k:stop]]).tolist():
                other = self.root(r)
                if other != mine:
                    lo, hi = (mine, other) if self.ids[mine] <= self.ids[other] else (other, mine)
                    self.label[hi] = lo
                    mine = lo


def link_blocks(ids: np.ndarray, weights: np.ndarray, x: np.ndarray, split: int | None, cosine: float, block: int = 4096) -> tuple[np.ndarray, ...]:
    """ids, counts and roots of the rows of x (raw) that link: within all rows, or between those before and from `split` on."""
    norm, single = np.empty(len(ids)), np.empty(x.shape, np.float32)
    for lo in range(0, len(ids), 4096):
        some = x[lo : lo + 4096].astype(float)
        norm[lo : lo + 4096] = np.sqrt((some * some).sum(1))
        single[lo : lo + 4096] = some / norm[lo : lo + 4096, None]
    reach = float(np.sqrt(2 - 2 * cosine))
    found = _Links(ids, weights)
    rows = np.arange(len(ids))
    one = grow(single, rows[:split] if split else rows, block)
    two = grow(single, rows[split:], block) if split else one
    for p, q in traverse(one, two, reach):
        other = single[q].T
        for lo in range(0, len(p), 512):
            pp = p[lo : lo + 512]
            i, j = np.nonzero(single[pp] @ other >= cosine - 1e-4)
            i, j = pp[i], q[j]
            if p is q:
                i, j = i[i < j], j[i < j]
            for k in range(0, len(i), 100_000):
                a, b = i[k : k + 100_000], j[k : k + 100_000]
                good = np.einsum("ij,ij->i", x[a].astype(float), x[b].astype(float)) / (norm[a] * norm[b]) >= cosine
                found.add(a[good], b[good])
    hit = np.flatnonzero(found.count)
    return ids[hit], found.count[hit], ids[np.array([found.root(i) for i in hit.tolist()], np.int64)]


def near_vectors(vectors: DataFrame, cosine: float = COSINE, block: int = 4096, sample: int = 256, fan: int = FAN, turn: int = TURN) -> DataFrame:
    """vec_id, n_links, component_id, kept: a row for each row of vectors (vec_id, embedding)."""
    with Workspace(vectors.sparkSession) as space:
        return space.finish(_near_vectors(space, vectors, cosine, block, sample, fan, turn), "near")


def _near_vectors(space: Workspace, vectors: DataFrame, cosine: float, block: int, sample: int, fan: int, turn: int) -> DataFrame:
    e = F.col("embedding")
    numbers = F.coalesce(e.isNotNull() & (F.size(e) > 0) & F.forall(e, lambda v: F.coalesce(~F.isnan(v) & (F.abs(v) < float("inf")), F.lit(False))) & F.exists(e, lambda v: v != 0), F.lit(False))
    single = isinstance(vectors.schema["embedding"].dataType.elementType, T.FloatType)
    kind = np.float32 if single else np.float64
    rows = vectors.select(F.col("vec_id").cast("bigint").alias("vec_id"), F.when(numbers & F.col("vec_id").isNotNull(), e).alias("embedding"))
    keyed = rows.withColumn("k1", F.xxhash64("embedding")).withColumn("k2", F.xxhash64(F.lit(17), "embedding"))
    classes = keyed.where("embedding is not null").groupBy("k1", "k2")
    vectors_ = classes.agg(F.min("vec_id").alias("id"), F.count(F.lit(1)).alias("c"), F.first("embedding").alias("v"))
    links = _links(space, vectors_.select("id", "c", "v"), kind, cosine, block, sample, fan, turn)
    # once more without the vectors, of which a table less lies there
    classes = space.table(classes.agg(F.min("vec_id").alias("id"), F.count(F.lit(1)).alias("c")), "classes")
    counts = links.groupBy("id").agg(F.sum("n").alias("n"))
    parts = connected_components(links.where("id <> root").select("id", "root"), "id", "root")
    known = classes.select("k1", "k2", "id", "c").join(counts, "id", "left").join(parts.withColumnRenamed("node", "id"), "id", "left")
    known = known.select("k1", "k2", (F.coalesce("n", F.lit(0)) + F.col("c") - 1).alias("n_links"), F.coalesce("component", "id").alias("component_id"))
    out = keyed.select("vec_id", F.when(F.col("embedding").isNotNull(), F.col("k1")).alias("k1"), "k2").join(known, ["k1", "k2"], "left")
    component = F.coalesce("component_id", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).alias("n_links"), component.alias("component_id"), F.coalesce(component == F.col("vec_id"), F.lit(True)).alias("kept"))


def net_of(points: np.ndarray, radius: float, fan: int, least: float) -> np.ndarray:
    """Centres of the next level: points more than half the radius apart, or a quarter and so on while they are one."""
    while radius > least:
        radius /= 2
        net = points[:1]
        for p in points[1:]:
            if len(net) == fan:
                break
            if _distances(net, p).min() > radius:
                net = np.vstack([net, p])
        if len(net) > 1:
            return net
    return points[:1]


def _unit(raw: list[bytes], kind: type) -> np.ndarray:
    x = np.frombuffer(b"".join(raw), kind).astype(float).reshape(len(raw), -1)
    return x / np.sqrt((x * x).sum(1))[:, None]


def _pack(classes: DataFrame, kind: type) -> DataFrame:
    """(id, c, v as bytes, cell): all vectors of one length lie in one root cell."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column("v")
            at, flat = column.offsets.to_numpy(), np.asarray(column.values.to_numpy(zero_copy_only=False), kind)
            raw = [flat[a:b].tobytes() for a, b in zip(at[:-1], at[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("c"), pa.array(raw, pa.binary()), pa.array([str(n) for n in np.diff(at)], pa.string())], ["id", "c", "v", "cell"])

    return classes.mapInArrow(run, "id bigint, c bigint, v binary, cell string")


def _nets(picked: DataFrame, kind: type, fan: int, least: float) -> DataFrame:
    """(cell, net) of cells (cell, radius, parts, points) that have more than one centre: about two for each part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cells, nets = [], []
            for r in batch.to_pylist():
                net = net_of(_unit(sorted(r["points"]), kind), r["radius"], min(fan, 2 * r["parts"]), least)
                if len(net) > 1:
                    cells.append(r["cell"])
                    nets.append([x.tobytes() for x in net])
            yield pa.RecordBatch.from_arrays([pa.array(cells, pa.string()), pa.array(nets, pa.list_(pa.binary()))], ["cell", "net"])

    return picked.mapInArrow(run, "cell string, net array<binary>")


def _assign(dealt: DataFrame, nets: DataFrame, kind: type, deal: int) -> DataFrame:
    """(id, c, v, cell, d): vectors of split cells in the cell of their nearest centre, at the distance d from it.

    Vectors of a cell are dealt by hash, with a copy of the cell's net ahead of each share, so a cell with a third of
    all vectors is many shares, and no vector's row carries the net.
    """
    shares = F.ceil(F.col("n") / deal).cast("int")
    net = nets.select("cell", F.explode(F.sequence(F.lit(0), shares - 1)).alias("share"), F.lit(0).alias("kind"), F.lit(None).cast("bigint").alias("id"), F.lit(None).cast("bigint").alias("c"), F.lit(None).cast("binary").alias("v"), "net")
    rows = dealt.join(F.broadcast(nets.select("cell", shares.alias("m"))), "cell")
    rows = rows.select("cell", F.pmod(F.xxhash64(F.lit(3), "id"), "m").cast("int").alias("share"), F.lit(1).alias("kind"), "id", "c", "v", F.lit(None).cast("array<binary>").alias("net"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centres = np.zeros((0, 0))
        for batch in batches:
            cells, kinds, raw, net = (batch.column(c).to_pylist() for c in ("cell", "kind", "v", "net"))
            found, far, at = [], [], 0
            while at < len(cells):
                if kinds[at] == 0:
                    centres = np.stack([np.frombuffer(x, float) for x in net[at]])
                    found.append(None)
                    far.append(None)
                    at += 1
                    continue
                stop = at
                while stop < len(cells) and kinds[stop] == 1:
                    stop += 1
                x = _unit(raw[at:stop], kind)
                near = (x @ centres.T).argmax(1)
                found += [f"{c}.{k}" for c, k in zip(cells[at:stop], near.tolist(), strict=True)]
                far += np.sqrt(((x - centres[near]) ** 2).sum(1)).tolist()
                at = stop
            out = pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("id", "c", "v")), pa.array(found, pa.string()), pa.array(far, pa.float64())], ["id", "c", "v", "cell", "d"])
            yield out.filter(out.column("cell").is_valid())

    return net.unionByName(rows).repartition("cell", "share").sortWithinPartitions("cell", "share", "kind").mapInArrow(run, "id bigint, c bigint, v binary, cell string, d double")


def surviving(pairs: DataFrame, frontier: DataFrame, reach: float) -> DataFrame:
    """(a, b): the pairs of children of pairs that the bound on their centres' distance can't prune; a node is its own
    partner once. Cells that weren't split are their own children."""
    left = frontier.select(F.col("parent").alias("a"), F.col("cell").alias("x"), F.col("radius").alias("rx"), F.col("centre").alias("cx"))
    right = frontier.select(F.col("parent").alias("b"), F.col("cell").alias("y"), F.col("radius").alias("ry"), F.col("centre").alias("cy"))
    apart = F.sqrt(F.aggregate(F.zip_with("cx", "cy", lambda p, q: (p - q) * (p - q)), F.lit(0.0), lambda s, v: s + v))
    both = pairs.join(left, "a").join(right, "b").where("a <> b or x <= y")
    near = (F.col("x") == F.col("y")) | (apart <= F.col("rx") + F.col("ry") + reach + SLACK)
    return both.where(near).select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))


def leaf_cells(space: Workspace, classes: DataFrame, kind: type, cosine: float, block: int, sample: int, fan: int, spread: int = 1) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(vectors with their leaf cell, leaf cells with n, most, radius and centre, pairs of leaf cells that may link).

    Cells with more than `most` vectors are split by nets of half the radius, level by level, until they have fewer or
    lie so close together that all of them link. On each level, pairs of cells are pruned before they are split further.
    `most` is `block`, and up to `spread` times that where the vectors of one length are many, but SIDE bytes.
    Tables of cells are broadcast: they have a few rows for each `most` vectors.
    """
    reach = float(np.sqrt(2 - 2 * cosine))
    least = reach / 2 - SLACK
    held = space.table(_pack(classes, kind), "cells")
    dealt = held.withColumn("d", F.lit(2.0))
    most = F.least(F.greatest(F.lit(block), F.least(F.ceil(F.col("n") / 8), F.lit(spread * block))), F.greatest(F.lit(1), F.floor(F.lit(SIDE) / (F.col("cell").cast("bigint") * np.dtype(kind).itemsize)))).cast("bigint")
    frontier = dealt.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).select(F.col("cell").alias("parent"), "cell", "n", most.alias("most"), F.lit(2.0).alias("radius"), F.lit(None).cast("array<double>").alias("centre"))
    frontier = space.table(frontier, "roots")
    pairs = frontier.select(F.col("cell").alias("a"), F.col("cell").alias("b"))
    done = []
    while True:
        big = frontier.where((F.col("n") > F.col("most")) & (F.col("radius") > least)).select("cell", "n", "most", "radius")
        # a few hundred vectors of each cell, by hash: bounded by its share of the draw, whatever its size
        drawn = dealt.join(F.broadcast(big), "cell").where(F.pmod(F.xxhash64(F.lit(11), "id", "cell"), F.lit(1 << 30)) < F.lit(float(1 << 30)) * 2 * sample / F.col("n"))
        picked = drawn.groupBy("cell").agg(F.first("radius").alias("radius"), F.first(F.ceil(F.col("n") / F.col("most"))).alias("parts"), F.collect_list("v").alias("points"))
        nets = space.table(_nets(picked, kind, fan, least).join(big.select("cell", "n", "most"), "cell"), "nets")
        if not nets.limit(1).count():
            break
        done.append(space.table(dealt.join(F.broadcast(nets.select("cell")), "cell", "left_anti").select("id", "c", "v", "cell"), "done"))
        before, held = held, space.table(_assign(dealt, nets, kind, 16 * block), "cells")
        space.drop(before)
        dealt = held
        numbers = "transform(sequence(0, size(net) - 1), k -> struct(concat(cell, '.', k) as cell, net[k] as raw))"
        centres = _doubles(nets.select(F.col("cell").alias("parent"), F.expr(f"inline({numbers})")))
        sizes = dealt.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.max("d").alias("radius"))
        split = centres.join(sizes, "cell").join(nets.select(F.col("cell").alias("parent"), "most"), "parent").select("parent", "cell", "n", "most", "radius", "centre")
        kept = frontier.join(nets.select("cell"), "cell", "left_anti").select(F.col("cell").alias("parent"), "cell", "n", "most", "radius", "centre")
        frontier = space.table(split.unionByName(kept), "frontier")
        pairs = space.table(surviving(pairs, frontier, reach), "pairs")
    done.append(dealt.select("id", "c", "v", "cell"))
    return reduce(DataFrame.unionByName, done), frontier, pairs


def _doubles(centres: DataFrame) -> DataFrame:
    """centres (parent, cell, raw) with `centre`, an array, in place of its bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = [np.frombuffer(x, float).tolist() for x in batch.column("raw").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("parent"), batch.column("cell"), pa.array(values, pa.list_(pa.float64()))], ["parent", "cell", "centre"])

    return centres.select("parent", "cell", "raw").mapInArrow(run, "parent string, cell string, centre array<double>")


def _tiles(space: Workspace, classes: DataFrame, kind: type, cosine: float, block: int, sample: int, fan: int) -> tuple[DataFrame, ...]:
    """(blocks of vectors by cell and part, tiles as pairs of those with their bytes, links known without a look)."""
    least = float(np.sqrt(2 - 2 * cosine)) / 2 - SLACK
    width = F.substring_index("cell", ".", 1).cast("bigint") * np.dtype(kind).itemsize
    with Workspace(space.spark) as inner:
        rows, cells, pairs = leaf_cells(inner, classes, kind, cosine, block, sample, fan, SPREAD)
        # a cell that is still too big lies closer together than any link is long: all its vectors link, without a look
        cells = cells.withColumn("m", F.ceil(F.col("n") / F.col("most")).cast("int")).withColumn("bytes", F.ceil(F.col("n") * width / F.col("m")))
        cells = cells.select("cell", "m", "bytes", ((F.col("m") > 1) & (F.col("radius") <= least)).alias("dense"))
        cells = inner.table(cells, "leaves")
        part, piece = F.pmod(F.xxhash64(F.lit(5), "id"), "m").cast("int"), F.pmod(F.xxhash64(F.lit(7), "id"), F.ceil(F.col("bytes") / (1 << 20)))
        rows = rows.join(F.broadcast(cells), "cell")
        dense = rows.where("dense").select("id", "c", "cell")
        whole = inner.table(dense.groupBy("cell").agg(F.sum("c").alias("all"), F.min("id").alias("root")), "dense")
        sure = space.table(dense.join(whole, "cell").select("id", (F.col("all") - F.col("c")).alias("n"), "root"), "sure")
        blocks = rows.groupBy("cell", part.alias("part"), piece.alias("piece")).agg(F.collect_list("id").alias("ids"), F.collect_list("c").alias("cs"), F.collect_list("v").alias("vs"))
        blocks = space.table(blocks, "blocks")
        sides = pairs.join(cells.select(F.col("cell").alias("a"), F.col("m").alias("ma"), F.col("bytes").alias("ba"), "dense"), "a").join(cells.select(F.col("cell").alias("b"), F.col("m").alias("mb"), F.col("bytes").alias("bb")), "b").where("a <> b or not dense")
        tiles = sides.withColumn("pa", F.explode(F.sequence(F.lit(0), F.col("ma") - 1))).withColumn("pb", F.explode(F.sequence(F.lit(0), F.col("mb") - 1))).where("a <> b or pa <= pb")
        tiles = space.table(tiles.select("a", "pa", "b", "pb", (F.col("ba") + F.col("bb")).alias("bytes")), "tiles")
    return blocks, tiles, sure


def _links(space: Workspace, classes: DataFrame, kind: type, cosine: float, block: int, sample: int, fan: int, turn: int) -> DataFrame:
    """(id, n, root): parts of link counts, and roots of spanning forests."""
    blocks, tiles, sure = _tiles(space, classes, kind, cosine, block, sample, fan)
    size = blocks.select(F.sum(F.size("ids") * F.length(F.col("vs")[0]))).first()[0] or 0
    n_tiles, total = tiles.agg(F.count(F.lit(1)), F.coalesce(F.sum("bytes"), F.lit(0))).first()
    turns = max(1, -(-total // max(turn, size)))
    schema = "id bigint, n bigint, root bigint"
    tile = ["a", "pa", "b", "pb"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def solve(sides: list[list[tuple]]) -> pa.RecordBatch:
            ids, weights, raw = ([s[k] for side in sides for s in side] for k in range(3))
            ids = np.concatenate(ids)
            x = np.frombuffer(b"".join(raw), kind).reshape(len(ids), -1)
            split = sum(len(s[0]) for s in sides[0]) if sides[1] else None
            return pa.RecordBatch.from_arrays([pa.array(v) for v in link_blocks(ids, np.concatenate(weights), x, split, cosine, block)], ["id", "n", "root"])

        key, sides = None, [[], []]
        for batch in batches:
            for k in range(batch.num_rows):
                at = tuple(batch.column(c)[k].as_py() for c in tile)
                if at != key:
                    if key:
                        yield solve(sides)
                    key, sides = at, [[], []]
                ids, cs, vs = (batch.column(c)[k].values for c in ("ids", "cs", "vs"))
                sides[batch.column("side")[k].as_py()].append((np.array(ids), np.array(cs), b"".join(vs.to_pylist())))
        if key:
            yield solve(sides)

    def found(at: int) -> DataFrame:
        mine = tiles.where(F.pmod(F.xxhash64(*tile), F.lit(turns)) == at)
        one = mine.select(*tile, F.lit(0).alias("side"), F.col("a").alias("cell"), F.col("pa").alias("part"))
        two = mine.where("a <> b or pa <> pb").select(*tile, F.lit(1).alias("side"), F.col("b").alias("cell"), F.col("pb").alias("part"))
        met = blocks.join(F.broadcast(one.unionByName(two)), ["cell", "part"]).select(*tile, "side", "ids", "cs", "vs")
        n = min(2000, max(int(space.spark.conf.get("spark.sql.shuffle.partitions")), -(-n_tiles // turns)))
        return met.repartition(n, *tile).sortWithinPartitions(*tile, "side").mapInArrow(run, schema)

    out = space.pieces(map(found, range(turns)), "links")
    space.drop(blocks, tiles)
    return out.unionByName(sure)


def op1_cover_tree(spark, sf_dir: str) -> DataFrame:
    return near_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding"))
