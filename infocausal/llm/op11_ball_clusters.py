"""Centroid clustering of integer vectors, filtered by ball trees.

Each task packs its vectors into trees (one per PART_ROWS vectors, one row of the written table).
A node is a ball: a pivot, a radius that no member exceeds, the number of its vectors and their
integer sum. In a round every tree is walked once for all centroids at the same time. A centroid
that is farther from the pivot than the nearest one by more than twice the radius cannot win
inside the ball; where one centroid is left, the ball's count and sum go to it whole. Otherwise
the walk descends; leaves are settled by exact integer distances. So a round moves one row of
sums a task, and the driver holds the centroids only.

Pivots, radii and the distances from pivots are floating point and only serve to exclude: the
test leaves a margin far over their rounding. Counts, sums, distances and new centroids are integers.

Defined cases: a vector with another number of components, a null or a non-finite one is left out,
as is a null vector; components beyond 2 ** 27 after scaling count as 2 ** 27, so that a squared
distance fits a long; repeated rows count as often as they come; rows with one id tie by their
components; a null id seeds only where there are too few others. With fewer than k vectors there
are fewer centroids, an empty table gives an empty result, and further columns are ignored. A sum
of distances beyond a long is given as the largest long.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from infocausal.llm.common import materialize, release

#: Vectors of a tree, and of a leaf at most (more only where all are equal).
PART_ROWS, LEAF_ROWS = 16_384, 24
MOST = 1 << 27
LONGEST = (1 << 63) - 1


@dataclass(frozen=True)
class Clustering:
    k: int = 16
    rounds: int = 3
    dims: int = 64
    scale: float = 64.0
    #: The seeds are the k vectors with the smallest sha256 of `<salt>:<id>`.
    salt: str = "1"


class BallTree:
    """Nodes in the order of their building; members of a node are rows first to last of the reordered vectors."""

    def __init__(self, points: np.ndarray):
        self.order = np.arange(len(points))
        self.points = points
        first, last, left, right, pivots, radii, sums = [], [], [], [], [], [], []
        open_nodes = [(0, len(points), -1, 0)]
        while open_nodes:
            lo, hi, parent, side = open_nodes.pop()
            own = points[self.order[lo:hi]]
            node = len(first)
            if parent >= 0:
                (left, right)[side][parent] = node
            total = own.sum(axis=0)
            pivot = total / (hi - lo)
            off = np.einsum("ij,ij->i", d := own - pivot, d)
            first.append(lo)
            last.append(hi)
            left.append(-1)
            right.append(-1)
            pivots.append(pivot)
            radii.append(float(np.sqrt(off.max())) * (1 + 1e-9))
            sums.append(total)
            if hi - lo <= LEAF_ROWS or not (own != own[0]).any():
                continue
            # Split along the line from the farthest member to the one farthest from it.
            a = own[int(off.argmax())]
            b = own[int(np.einsum("ij,ij->i", d := own - a, d).argmax())]
            along = (own - a) @ (b - a).astype(np.float64)
            upper = along > along.max() / 2
            mid = lo + int((~upper).sum())
            self.order[lo:hi] = np.concatenate([self.order[lo:hi][~upper], self.order[lo:hi][upper]])
            open_nodes += [(lo, mid, node, 0), (mid, hi, node, 1)]
        self.points = points[self.order]
        self.first, self.last, self.left, self.right = (np.array(x, np.int32) for x in (first, last, left, right))
        self.radii, self.sums = np.array(radii), np.array(sums)
        self.pivots = np.array(pivots)

    def assign(self, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Cluster of each (reordered) vector; counts and sums by centroid. All nodes of a depth are tested together."""
        k = len(centroids)
        cluster = np.empty(len(self.points), np.int32)
        count, total = np.zeros(k, np.int64), np.zeros((k, self.points.shape[1]), np.int64)
        real = centroids.astype(np.float64)
        level = np.zeros(1, np.int32)
        while len(level):
            gap = np.sqrt(np.maximum(_squares(self.pivots[level], real), 0))
            best = gap.argmin(axis=1)
            nearest = gap[np.arange(len(level)), best]
            rivals = gap <= (nearest + 2 * self.radii[level] + 1e-6 * (1 + gap.max(axis=1)))[:, None]
            alone = rivals.sum(axis=1) == 1
            for node, j in zip(level[alone].tolist(), best[alone].tolist(), strict=True):
                cluster[self.first[node] : self.last[node]] = j
            np.add.at(count, best[alone], (self.last - self.first)[level[alone]])
            np.add.at(total, best[alone], self.sums[level[alone]])
            open_nodes = level[~alone]
            leaves = self.left[open_nodes] < 0
            if leaves.any():
                ends = open_nodes[leaves]
                rows = np.concatenate([np.arange(i, j) for i, j in zip(self.first[ends].tolist(), self.last[ends].tolist(), strict=True)])
                points = self.points[rows]
                cluster[rows] = own = _exact(points, centroids).argmin(axis=1)  # the first of equals
                np.add.at(count, own, 1)
                np.add.at(total, own, points)
            inner = open_nodes[~leaves]
            level = np.concatenate([self.left[inner], self.right[inner]])
        return cluster, count, total


def _squares(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.stack([np.einsum("ij,ij->i", d := a - c, d) for c in b], axis=1)


def _exact(points: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    return _squares(points, centroids)


_TREE = "part int, n long, ids binary, known binary, points binary, width int, radii binary, sums binary, shape binary"


def _packed(part: int, tree: BallTree, ids: np.ndarray, known: np.ndarray) -> pa.RecordBatch:
    """Points in the narrowest integers that hold them; of a node its range of members (and so its count), radius and integer sum."""
    most = int(np.abs(tree.points).max(initial=0))
    width = next(w for w in (1, 2, 4) if most < 1 << (8 * w - 1))
    shape = np.stack([tree.first, tree.last, tree.left, tree.right])
    row = {
        "part": part, "n": len(ids), "ids": ids[tree.order].tobytes(), "known": known[tree.order].tobytes(),
        "points": tree.points.astype(f"<i{width}").tobytes(), "width": width, "radii": tree.radii.tobytes(), "sums": tree.sums.tobytes(), "shape": shape.tobytes(),
    }
    kinds = [pa.int32(), pa.int64(), *[pa.binary()] * 3, pa.int32(), *[pa.binary()] * 3]
    return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row.values(), kinds, strict=True)], list(row))


def _opened(row: dict, dims: int) -> tuple[BallTree, np.ndarray, np.ndarray]:
    tree = BallTree.__new__(BallTree)
    tree.points = np.frombuffer(row["points"], f"<i{row['width']}").astype(np.int64).reshape(-1, dims)
    tree.radii, tree.sums = np.frombuffer(row["radii"]), np.frombuffer(row["sums"], np.int64).reshape(-1, dims)
    tree.first, tree.last, tree.left, tree.right = np.frombuffer(row["shape"], np.int32).reshape(4, -1)
    tree.pivots = tree.sums / (tree.last - tree.first)[:, None]
    return tree, np.frombuffer(row["ids"], np.int64), np.frombuffer(row["known"], "?")


def integer_vectors(rows: DataFrame, p: Clustering, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """id, v (array of long): the vectors that are kept."""
    v = F.col(vector)
    fit = (F.size(v) == p.dims) & ~F.exists(v, lambda x: F.coalesce(F.isnan(x) | (F.abs(x) == float("inf")), F.lit(True)))
    whole = F.transform(v, lambda x: F.floor(F.greatest(F.least(x.cast("double") * p.scale, F.lit(float(MOST))), F.lit(float(-MOST)))))
    return rows.filter(F.coalesce(fit, F.lit(False))).select(F.col(key).cast("long").alias("id"), whole.alias("v"))


def grow_trees(vectors: DataFrame, p: Clustering) -> DataFrame:
    """A row for each tree, written to the shared folder."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = 0
        for batch in it:
            for at in range(0, batch.num_rows, PART_ROWS):
                own = batch.slice(at, PART_ROWS)
                points = own.column("v").flatten().to_numpy(zero_copy_only=False).reshape(-1, p.dims)
                ids = own.column("id")
                yield _packed(part, BallTree(points), pc.fill_null(ids, 0).to_numpy(), ids.is_valid().to_numpy(zero_copy_only=False))
                part += 1
        release()

    return materialize(vectors.mapInArrow(run, _TREE), "ball-trees")


def _seeds(vectors: DataFrame, p: Clustering) -> np.ndarray:
    named = vectors.select("id", "v", F.sha2(F.concat(F.lit(f"{p.salt}:"), F.col("id").cast("string")), 256).alias("h"))
    rows = named.orderBy(F.col("h").asc_nulls_last(), "v").limit(p.k).collect()  # k rows
    return np.array([r["v"] for r in rows], np.int64).reshape(-1, p.dims)


def _round(trees: DataFrame, centroids: np.ndarray, p: Clustering) -> np.ndarray:
    """The next centroids. A task sends a row of sums for each centroid."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, total = np.zeros(len(centroids), np.int64), np.zeros(centroids.shape, np.int64)
        for batch in it:
            for row in batch.to_pylist():
                _, n, s = _opened(row, p.dims)[0].assign(centroids)
                count += n
                total += s
        held = np.flatnonzero(count)
        yield pa.RecordBatch.from_arrays(
            [pa.array(held.astype(np.int32)), pa.array(count[held]), pa.array(total[held].tolist(), pa.list_(pa.int64()))], ["cluster", "n", "s"]
        )

    sent = trees.mapInArrow(run, "cluster int, n long, s array<long>")
    # Sums of many tasks may pass a long: decimals hold them, and the floor is exact.
    sums = [F.sum(F.col("s")[i].cast("decimal(20,0)")).alias(f"s{i}") for i in range(p.dims)]
    after = centroids.copy()
    for r in sent.groupBy("cluster").agg(F.sum("n").alias("n"), *sums).collect():  # k rows
        after[r["cluster"]] = [int(r[f"s{i}"]) // r["n"] for i in range(p.dims)]
    return after


def cluster_vectors(rows: DataFrame, p: Clustering = Clustering(), key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """key, cluster, distance (squared), cluster_inertia, inertia, centroid (array of long) for every kept vector."""
    spark = rows.sparkSession
    vectors = integer_vectors(rows, p, key, vector)
    centroids = _seeds(vectors, p)
    trees = grow_trees(vectors, p)
    for _ in range(p.rounds if len(centroids) else 0):
        centroids = _round(trees, centroids, p)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            for row in batch.to_pylist():
                tree, ids, known = _opened(row, p.dims)
                cluster = tree.assign(centroids)[0]
                distance = np.einsum("ij,ij->i", d := tree.points - centroids[cluster], d)
                yield pa.RecordBatch.from_arrays([pa.array(ids, mask=~known), pa.array(cluster), pa.array(distance)], ["id", "cluster", "distance"])

    found = materialize(trees.mapInArrow(run, "id long, cluster int, distance long"), "clusters")
    # k rows.
    by = {r["cluster"]: int(r["s"]) for r in found.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(20,0)")).alias("s")).collect()}
    whole = min(sum(by.values()), LONGEST)
    rows = [(j, min(s, LONGEST), whole, centroids[j].tolist()) for j, s in by.items()]
    known = spark.createDataFrame(rows, "cluster int, cluster_inertia long, inertia long, centroid array<long>")
    return found.join(F.broadcast(known), "cluster").select(F.col("id").alias(key), "cluster", "distance", "cluster_inertia", "inertia", "centroid")
