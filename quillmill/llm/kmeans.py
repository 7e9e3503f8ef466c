"""Centroid clustering in exact integers, with centroids filtered through kd-trees.

Vectors become integers, ``floor(scale * x)``. Each batch of them is built into one kd-tree, once: nodes
hold their number of vectors, the integer sums of these and of their squares, and the box around
them. Trees are written as rows of a table, each as large as its batch, and every round reads
them: a node's candidates are the centroids that its parent left; of them, one that is farther than
another everywhere in the node's box goes; a node with one candidate left is assigned whole, by its
sums; the vectors of leaves with several are compared one by one. What leaves a task is a count
and sums for each centroid, so a round sends (tasks x centroids) rows of sums, whatever the data.

Nothing is rounded: products are made in double precision where all of them stay below 2**53, and
in 64-bit integers elsewhere.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scratch import cut

#: Vectors of a tree, and of a leaf.
TREE = 8192
LEAF = 32
#: Bits of the largest sum of squares of a vector's components; sums of products stay below 2**63 then, and
#: with the smaller bound they are exact in double precision.
BITS, BITS_EXACT = 60, 48

_TREES = "ids array<long>, points binary, split binary, counts binary, sums binary, squares binary, low binary, high binary"


def kd_tree(points: np.ndarray, leaf: int = LEAF) -> tuple[np.ndarray, np.ndarray]:
    """(order of points, nodes as rows of begin, stop, left child, right child); a leaf has children -1.

    A node is cut at the median of its widest dimension; parents come before children.
    """
    order = np.arange(len(points))
    nodes: list[list[int]] = [[0, len(points), -1, -1]]
    for node in nodes:  # grows while it is read
        begin, stop = node[:2]
        if stop - begin <= leaf:
            continue
        here = points[order[begin:stop]]
        wide = int(np.argmax(here.max(axis=0) - here.min(axis=0)))
        if here[:, wide].max() == here[:, wide].min():
            continue  # all equal: the box is the point
        half = (stop - begin) // 2
        order[begin:stop] = order[begin:stop][np.argpartition(here[:, wide], half)]
        node[2:] = [len(nodes), len(nodes) + 1]
        nodes += [[begin, begin + half, -1, -1], [begin + half, stop, -1, -1]]
    return order, np.array(nodes, dtype=np.int32)


class Tree:
    """A batch of integer vectors with the statistics of its kd-tree's nodes."""

    def __init__(self, points: np.ndarray, nodes: np.ndarray, counts: np.ndarray, sums: np.ndarray, squares: np.ndarray, low: np.ndarray, high: np.ndarray):
        self.points, self.nodes, self.counts, self.sums, self.squares, self.low, self.high = points, nodes, counts, sums, squares, low, high

    @classmethod
    def of(cls, points: np.ndarray, leaf: int = LEAF) -> tuple[Tree, np.ndarray]:
        """The tree of int64 ``points``, and the order in which it holds them."""
        order, nodes = kd_tree(points, leaf)
        points = points[order]
        dims = points.shape[1]
        sums, low, high = (np.empty((len(nodes), dims), dtype=np.int64) for _ in range(3))
        squares = np.empty(len(nodes), dtype=object)  # Python's integers: no sum of squares is too large
        for i in range(len(nodes) - 1, -1, -1):
            begin, stop, left, right = nodes[i]
            if left < 0:
                here = points[begin:stop]
                sums[i], low[i], high[i] = here.sum(axis=0), here.min(axis=0), here.max(axis=0)
                squares[i] = sum((here * here).sum(axis=1).tolist())
            else:
                sums[i], low[i], high[i] = sums[left] + sums[right], np.minimum(low[left], low[right]), np.maximum(high[left], high[right])
                squares[i] = squares[left] + squares[right]
        return cls(points, nodes, (nodes[:, 1] - nodes[:, 0]).astype(np.int64), sums, squares, low, high), order

    def _kind(self, centroids: np.ndarray) -> type:
        most = max(int(np.abs(x).max(initial=0)) for x in (self.low, self.high, centroids))
        return np.float64 if most * most * self.points.shape[1] <= 1 << BITS_EXACT else np.int64

    def assign(self, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(owner of each node or -1, owner of each point): a node with an owner has all its points assigned to it."""
        k, kind = len(centroids), self._kind(centroids)
        c = centroids.astype(kind)
        norms = (c * c).sum(axis=1)
        away = c[None, :, :] - c[:, None, :]  # [best, other]: other minus best
        plus, minus = np.maximum(away, 0), np.minimum(away, 0)
        gap = norms[None, :] - norms[:, None]
        owner = np.full(len(self.nodes), -1, dtype=np.int32)
        point_owner = np.full(len(self.points), -1, dtype=np.int32)
        level, open_ = np.zeros(1, dtype=np.int64), np.ones((1, k), dtype=bool)
        asked: list[np.ndarray] = []
        left_open: list[np.ndarray] = []
        while len(level):
            low, high = self.low[level].astype(kind), self.high[level].astype(kind)
            middle = low + high  # twice the middle; distances to it are compared at twice their scale
            near = np.where(open_, (norms * 2)[None, :] - 2 * (middle @ c.T), np.iinfo(np.int64).max if kind is np.int64 else np.inf)
            best = near.argmin(axis=1)
            stays = np.ones_like(open_)
            for b in np.unique(best):
                rows = best == b
                # Smallest |v - other|^2 - |v - best|^2 over the box: above zero means dominated strictly.
                edge = 2 * (high[rows] @ plus[b].T + low[rows] @ minus[b].T)
                stays[rows] = gap[b][None, :] - edge <= 0
            stays &= open_
            single = stays.sum(axis=1) == 1
            owner[level[single]] = stays[single].argmax(axis=1)
            children = self.nodes[level, 2:]
            down = ~single & (children[:, 0] >= 0)
            leaf = ~single & ~down
            asked.append(level[leaf])
            left_open.append(stays[leaf])
            level, open_ = children[down].reshape(-1).astype(np.int64), np.repeat(stays[down], 2, axis=0)
        for node in np.flatnonzero(owner >= 0):
            point_owner[self.nodes[node, 0] : self.nodes[node, 1]] = owner[node]
        leaves = np.concatenate(asked)
        if len(leaves):
            sizes = self.counts[leaves]
            at = np.repeat(self.nodes[leaves, 0] - (np.cumsum(sizes) - sizes), sizes) + np.arange(int(sizes.sum()))
            far = norms[None, :] - 2 * (self.points[at].astype(kind) @ c.T)
            far = np.where(np.repeat(np.concatenate(left_open), sizes, axis=0), far, np.iinfo(np.int64).max if kind is np.int64 else np.inf)
            point_owner[at] = far.argmin(axis=1)  # the first of equals: the smaller number
        return owner, point_owner

    def totals(self, centroids: np.ndarray) -> list[tuple[int, list[int], int]]:
        """(count, sums, sum of squared distances) of each centroid's vectors, in Python's integers."""
        owner, point_owner = self.assign(centroids)
        whole = np.zeros(len(self.points), dtype=bool)
        for node in np.flatnonzero(owner >= 0):
            whole[self.nodes[node, 0] : self.nodes[node, 1]] = True
        out = []
        for number, c in enumerate(centroids.tolist()):
            nodes = np.flatnonzero(owner == number)
            loose = self.points[(point_owner == number) & ~whole]
            count = int(self.counts[nodes].sum()) + len(loose)
            sums = (self.sums[nodes].sum(axis=0) + loose.sum(axis=0)).tolist()
            squares = sum(self.squares[nodes].tolist()) + sum((loose * loose).sum(axis=1).tolist())
            out.append((count, sums, squares - 2 * sum(a * b for a, b in zip(sums, c, strict=True)) + count * sum(x * x for x in c)))
        return out


def _built(dims: int, leaf: int):
    """Trees of batches of (id, vector)."""

    def tree(ids: pa.Array, flat: np.ndarray) -> pa.RecordBatch:
        made, order = Tree.of(flat.reshape(-1, dims), leaf)
        cells = [
            ids.take(pa.array(order)).to_pylist(), made.points.astype("<i4").tobytes(), made.nodes.astype("<i4").tobytes(), made.counts.astype("<i8").tobytes(),
            made.sums.astype("<i8").tobytes(), ",".join(map(str, made.squares)).encode(), made.low.astype("<i4").tobytes(), made.high.astype("<i4").tobytes(),
        ]
        names = [x.split()[0] for x in _TREES.split(", ")]
        return pa.RecordBatch.from_arrays([pa.array([cells[0]], pa.list_(pa.int64())), *(pa.array([x], pa.binary()) for x in cells[1:])], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids: list[pa.Array] = []
        held: list[np.ndarray] = []
        for batch in batches:
            for at in range(0, batch.num_rows, TREE):
                part = batch.slice(at, TREE)
                ids.append(part.column(0))
                held.append(part.column(1).flatten().to_numpy().astype(np.int64))
                if sum(map(len, ids)) >= TREE:
                    yield tree(pa.concat_arrays(ids), np.concatenate(held))
                    ids, held = [], []
        if ids:
            yield tree(pa.concat_arrays(ids), np.concatenate(held))

    return run


def _trees(batch: pa.RecordBatch, dims: int) -> Iterator[tuple[pa.Array, Tree]]:
    for i in range(batch.num_rows):
        ids, points, nodes, counts, sums, squares, low, high = (batch.column(j)[i] for j in range(8))
        view = [np.frombuffer(x.as_buffer(), kind) for x, kind in ((points, "<i4"), (nodes, "<i4"), (counts, "<i8"), (sums, "<i8"), (low, "<i4"), (high, "<i4"))]
        points, nodes, counts, sums, low, high = view
        known = np.array([int(x) for x in squares.as_py().split(b",")] + [None], dtype=object)[:-1]
        yield ids.values, Tree(
            points.reshape(-1, dims).astype(np.int64), nodes.reshape(-1, 4), counts, sums.reshape(-1, dims), known,
            low.reshape(-1, dims).astype(np.int64), high.reshape(-1, dims).astype(np.int64),
        )


def _summed(centroids: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k, dims = centroids.shape
        total = [(0, [0] * dims, 0)] * k
        for batch in batches:
            for _, tree in _trees(batch, dims):
                total = [(a + x, [p + q for p, q in zip(b, y, strict=True)], c + z) for (a, b, c), (x, y, z) in zip(total, tree.totals(centroids), strict=True)]
        values = [[Decimal(x) for x in (*sums, n, inertia)] for n, sums, inertia in total]
        yield pa.RecordBatch.from_arrays([pa.array(range(k), pa.int32()), pa.array(values, pa.list_(pa.decimal128(38, 0)))], names=["cluster", "vals"])

    return run


def _totals(trees: DataFrame, centroids: np.ndarray) -> list[tuple[int, list[int], int]]:
    """(count, sums, inertia) of each cluster over all trees; (dims + 2) numbers a cluster reach the driver."""
    k, dims = centroids.shape
    found = trees.mapInArrow(_summed(centroids), "cluster int, vals array<decimal(38,0)>")
    cells = found.select("cluster", F.posexplode("vals").alias("i", "x")).groupBy("cluster", "i").agg(F.sum("x").alias("x"))
    table = [[0] * (dims + 2) for _ in range(k)]
    for r in cells.collect():
        table[r["cluster"]][r["i"]] = int(r["x"])
    return [(row[dims], row[:dims], row[dims + 1]) for row in table]


def _final(centroids: np.ndarray, inertias: list[int], digests: list[str]):
    known, total = [_long(x) for x in inertias], _long(sum(inertias))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, tree in _trees(batch, centroids.shape[1]):
                owner = tree.assign(centroids)[1]
                away = tree.points - centroids[owner]
                yield pa.RecordBatch.from_arrays(
                    [
                        ids, pa.array(owner), pa.array((away * away).sum(axis=1)), pa.array(known, pa.int64()).take(pa.array(owner)),
                        pa.array([total], pa.int64()).take(pa.array(np.zeros(len(owner), np.int64))), pa.array(digests).take(pa.array(owner)),
                    ],
                    names=["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"],
                )

    return run


def _long(x: int) -> int | None:
    return x if x < 1 << 63 else None


def _whole_numbers(vector: Column, dims: int, scale: int) -> Column:
    """``floor(scale * x)`` of each component; null where the vector takes no part."""
    limit = (2.0**BITS / dims) ** 0.5
    scaled = F.transform(vector, lambda x: F.floor(x.cast("double") * scale))
    sound = (F.size(vector) == dims) & ~F.exists(vector, lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) * scale >= limit))
    return F.when(sound, scaled)


def cluster(
    vectors: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", dims: int = 64, k: int = 8, rounds: int = 10, scale: int = 1024, seed: str = "3:", leaf: int = LEAF
) -> DataFrame:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256) of each vector kept.

    Kept are vectors of ``dims`` components, none null or non-finite, as integers ``floor(scale * x)``;
    vectors with a component of sqrt(2**60 / dims) (2**27 for 64) or more either way after scaling could have
    distances that no long holds, and take no part. Centroids start as the vectors whose ``sha256(seed + id)`` come first (ids that are equal by
    their vectors, null ids last); where there are fewer than ``k`` vectors, as many centroids. In each
    round every vector goes to its nearest centroid (ties: the smaller number), and a centroid with
    vectors becomes the floor of their mean. ``cluster_inertia`` and ``inertia`` are null beyond a long. Repeated
    rows and null ids are rows like others; other columns are not read, whatever their names. A table
    without kept vectors gives no rows.
    """
    made = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), _whole_numbers(F.col(vector), dims, scale).alias("x")).where("x is not null")
    order = F.sha2(F.concat(F.lit(seed), F.col("vec_id").cast("string")), 256)
    first = made.select("x", order.alias("o"), "vec_id").orderBy(F.col("o").asc_nulls_last(), "vec_id", "x").limit(k).collect()
    kinds = "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"
    if not first:
        return vectors.sparkSession.createDataFrame([], kinds)
    centroids = np.array([list(r["x"]) for r in first], dtype=np.int64)
    trees = cut(made.mapInArrow(_built(dims, leaf), _TREES), "trees")
    for _ in range(rounds):
        found = _totals(trees, centroids)
        moved = np.array([[s // n for s in sums] if n else old for (n, sums, _), old in zip(found, centroids.tolist(), strict=True)], dtype=np.int64)
        settled = (moved == centroids).all()
        centroids = moved
        if settled:
            break  # later rounds would change nothing
    inertias = [x[2] for x in _totals(trees, centroids)]
    digests = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]
    return trees.mapInArrow(_final(centroids, inertias, digests), kinds)
