"""Centroid clustering: dual-tree Lloyd over integer vectors, exact to the last unit.

A vector's components become floor(GRID * x). The vectors of a task are dealt, as they come, to cover trees of at most
SHARD vectors, written once: a node has a centre, a radius over all its vectors, and children whose centres lie
more than radius / BASE apart. Every round builds one more cover tree over the (at most k) centroids and meets each
tree of vectors with it: pairs (node of vectors, node of centroids) start at the two roots; a pair goes when its least
possible distance is above the largest possible distance to another centroid; the wider node of a pair is opened
first. A node that is left with a single centroid is assigned whole; in leaves the remaining pairs are
compared in exact integers (ties: the smaller number). Bounds are floating and widened by far more than their error, so
they never drop a centroid that could win.

Rounds exchange sums only: every task adds up its clusters, Spark adds the tasks, and the driver gets k * dims totals.
No row is shuffled, so no key can be hot; a lost executor's trees are read again from the shared folder.

Defined cases: vectors that are null or of another length, and those with a null or non-finite component, take no part;
nor do those beyond LARGEST, whose components don't fit a long. Fewer vectors than k: as many centroids as
vectors. A null id has the last place among the candidates for a first centroid; rows of one id are vectors of their own
(order among them: their components). Equal centroids: the smallest number wins, the others stay empty and so unchanged.
Distances and sums beyond a long are given as the largest long. An empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmill.llm.common import cut

K, ROUNDS, DIMS, GRID = 40, 5, 64, 256
#: Vectors of one cover tree and of one leaf; by how much a child's radius is at least smaller.
SHARD, LEAF, BASE = 1024, 8, 1.3
LARGEST = float(1 << 62)
#: Components below this have exact squared distances in doubles (dims up to 512).
NARROW = 1 << 21
MOST = (1 << 63) - 1
TREES = "ids array<long>, kind string, points binary, bounds binary, radius binary"


class Tree(NamedTuple):
    """Rows in the order of the tree, and nodes: rows start:stop (the centre is the first), children low:high (none in a leaf)."""

    rows: np.ndarray
    order: np.ndarray
    start: np.ndarray
    stop: np.ndarray
    low: np.ndarray
    high: np.ndarray
    radius: np.ndarray


def lengths(difference: np.ndarray) -> np.ndarray:
    return np.sqrt(np.einsum("ij,ij->i", difference, difference))


def cover_tree(rows: np.ndarray, leaf: int = LEAF, base: float = BASE) -> Tree:
    at, order = rows.astype(np.float64), np.arange(len(rows))
    spans, low, high, radius = [(0, len(rows))], [], [], []
    for start, stop in spans:  # grows while it is read
        own = order[start:stop]
        far = lengths(at[own] - at[own[0]])
        radius.append(far.max())
        low.append(len(spans))
        if stop - start > leaf and radius[-1] > 0:
            near, groups, rest = radius[-1] / base, [own[far <= radius[-1] / base]], own[far > radius[-1] / base]
            while len(rest):
                inside = lengths(at[rest] - at[rest[0]]) <= near
                groups.append(rest[inside])
                rest = rest[~inside]
            order[start:stop] = np.concatenate(groups)
            ends = start + np.cumsum([len(g) for g in groups])
            spans += zip([start, *ends[:-1].tolist()], ends.tolist())
        high.append(len(spans))
    start, stop = np.array(spans, np.int64).T
    return Tree(rows[order], order, start, stop, np.array(low), np.array(high), np.array(radius))


def squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact squared distances of the rows of two integer arrays; Python's integers where 64 bits could overflow."""
    if max(np.abs(a).max(initial=0), np.abs(b).max(initial=0)) < NARROW:
        d = a.astype(np.float64) - b
        return np.einsum("ij,ij->i", d, d).astype(np.int64)
    return np.array([sum((x - y) ** 2 for x, y in zip(p, q)) for p, q in zip(a.tolist(), b.tolist())], object)


def _spread(low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which range, and the numbers low..high-1 of each range."""
    n = high - low
    which = np.repeat(np.arange(len(n)), n)
    return which, np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + low[which]


def nearest(tree: Tree, centroids: np.ndarray) -> np.ndarray:
    """The number of the nearest centroid of each row of tree.rows."""
    kept, number = np.unique(centroids, axis=0, return_index=True)  # of equal centroids the first
    other = cover_tree(kept, leaf=1)
    number = number[other.order]
    middle, centre = tree.rows[tree.start].astype(np.float64), other.rows[other.start].astype(np.float64)
    inner, whole = other.high > other.low, tree.high == tree.low
    label = np.empty(len(tree.rows), np.int64)
    nodes, v, c = np.zeros(1, np.int64), np.zeros(1, np.int64), np.zeros(1, np.int64)
    while len(nodes):
        own = tree.radius[nodes]
        while True:
            d = lengths(middle[nodes[v]] - centre[c])
            most = np.full(len(nodes), np.inf)
            np.minimum.at(most, v, d + own[v])
            keep = d - own[v] - other.radius[c] <= most[v] + 1e-9 * (d + own[v] + other.radius[c] + most[v])
            v, c = v[keep], c[keep]
            wide = inner[c] & ((other.radius[c] > own[v]) | whole[nodes[v]])
            if not wide.any():
                break
            which, child = _spread(other.low[c[wide]], other.high[c[wide]])
            v, c = np.append(v[~wide], v[wide][which]), np.append(c[~wide], child)
        sole = (np.bincount(v, minlength=len(nodes)) == 1)[v] & ~inner[c]
        which, row = _spread(tree.start[nodes[v[sole]]], tree.stop[nodes[v[sole]]])
        label[row] = number[other.start[c[sole]]][which]
        v, c = v[~sole], c[~sole]
        ends = whole[nodes[v]]
        if ends.any():
            which, row = _spread(tree.start[nodes[v[ends]]], tree.stop[nodes[v[ends]]])
            at = other.start[c[ends]][which]
            ranked = np.lexsort((number[at], squared(tree.rows[row], other.rows[at]), row))
            first = ranked[np.append(True, np.diff(row[ranked]) > 0)]
            label[row[first]] = number[at[first]]
        v, c = v[~ends], c[~ends]
        left, v = np.unique(v, return_inverse=True)
        which, child = _spread(tree.low[nodes[left]], tree.high[nodes[left]])
        of = np.argsort(v, kind="stable")
        begin = np.searchsorted(v[of], np.arange(len(left) + 1))
        v, pair = _spread(begin[which], begin[which + 1])
        nodes, c = child, c[of][pair]
    return label


def usable(vectors: DataFrame, id_col: str, vector_col: str, dims: int, grid: int) -> DataFrame:
    """vec_id, v: integer components of the vectors that take part."""
    scaled = F.transform(vector_col, lambda x: x.cast("double") * grid)
    fits = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < LARGEST))
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), scaled.alias("v")).filter((F.size("v") == dims) & fits)
    return rows.select("vec_id", F.transform("v", lambda x: F.floor(x)).alias("v"))


def plant(rows: DataFrame, dims: int, shard: int) -> DataFrame:
    """The vectors of each task as rows of cover trees."""

    def tree_row(ids: pa.Array, v: np.ndarray) -> pa.RecordBatch:
        tree = cover_tree(v)
        kind = np.min_scalar_type(-int(np.abs(v).max(initial=1)) - 1).name
        bounds = np.stack([tree.start, tree.stop, tree.low, tree.high]).astype(np.int32)
        ids = pa.ListArray.from_arrays(pa.array([0, len(v)], pa.int32()), ids.take(pa.array(tree.order)))
        return pa.RecordBatch.from_arrays([ids, *(pa.array([x]) for x in (kind, tree.rows.astype(kind).tobytes(), bounds.tobytes(), tree.radius.tobytes()))], ["ids", "kind", "points", "bounds", "radius"])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            own = pa.Table.from_batches([batch])
            held = own if held is None else pa.concat_tables([held, own])
            while len(held) >= shard:
                yield _of(held.slice(0, shard))
                held = held.slice(shard)
        if held is not None and len(held):
            yield _of(held)

    def _of(part: pa.Table) -> pa.RecordBatch:
        part = part.combine_chunks()
        v = np.concatenate([x.flatten().to_numpy() for x in part.column("v").chunks]).reshape(len(part), dims)
        return tree_row(pa.concat_arrays(part.column("vec_id").chunks), v)

    return cut(rows.mapInArrow(work, TREES), "cover_trees")


def read_tree(row, dims: int) -> Tree:
    start, stop, low, high = np.frombuffer(row.bounds, np.int32).reshape(4, -1).astype(np.int64)
    points = np.frombuffer(row.points, row.kind).reshape(-1, dims).astype(np.int64)
    return Tree(points, np.arange(len(points)), start, stop, low, high, np.frombuffer(row.radius))


def totals(trees: DataFrame, centroids: np.ndarray) -> dict[int, tuple[int, list[int]]]:
    """For every non-empty cluster its number of vectors and their sums by component."""
    k, dims = centroids.shape

    def add(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total, n = np.zeros((k, dims), object), np.zeros(k, np.int64)
        for frame in frames:
            for row in frame.itertuples():
                tree = read_tree(row, dims)
                label = nearest(tree, centroids)
                n += np.bincount(label, minlength=k)
                points = tree.rows if np.abs(tree.rows).max(initial=0) < (1 << 62) // len(tree.rows) else tree.rows.astype(object)
                for c in np.unique(label):
                    total[c] += points[label == c].sum(axis=0).astype(object)
        used = np.flatnonzero(n)
        out = [(int(c), i, int(n[c]), str(x)) for c in used for i, x in enumerate(total[c])]
        yield pd.DataFrame(out, columns=["cluster", "dim", "n", "total"]).astype({"cluster": "int32", "dim": "int32", "n": "int64"})

    parts = trees.mapInPandas(add, "cluster int, dim int, n long, total string")
    found = parts.groupBy("cluster", "dim").agg(F.sum("n").alias("n"), F.sum(F.col("total").cast("decimal(38,0)")).alias("total"))
    out: dict[int, tuple[int, list[int]]] = {}
    for r in found.orderBy("cluster", "dim").collect():  # k * dims rows at most
        out.setdefault(r["cluster"], (r["n"], []))[1].append(int(r["total"]))
    return out


def cluster(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", k: int = K, rounds: int = ROUNDS, dims: int = DIMS, grid: int = GRID, shard: int = SHARD) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256 of every vector that takes part."""
    spark = vectors.sparkSession
    rows = usable(vectors, id_col, vector_col, dims, grid)
    place = F.sha2(F.concat(F.lit("2:"), F.col("vec_id").cast("string")), 256).asc_nulls_last()
    centroids = np.array([r["v"] for r in rows.orderBy(place, "v").limit(k).collect()], np.int64).reshape(-1, dims)
    trees = plant(rows, dims, shard)
    for _ in range(rounds if len(centroids) else 0):
        for c, (n, total) in totals(trees, centroids).items():
            centroids[c] = [x // n for x in total]

    def assign(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for row in frame.itertuples():
                tree = read_tree(row, dims)
                label = nearest(tree, centroids)
                distance = squared(tree.rows, centroids[label])
                ids = pd.array([None if pd.isna(x) else int(x) for x in row.ids], "Int64") if pd.isna(row.ids).any() else np.asarray(row.ids, np.int64)
                yield pd.DataFrame({"vec_id": ids, "cluster": label.astype(np.int32), "distance": np.minimum(distance, MOST).astype(np.int64)})

    found = cut(trees.mapInPandas(assign, "vec_id long, cluster int, distance long"), "clusters")
    sums = {r["cluster"]: int(r["x"]) for r in found.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("x")).collect()}  # k rows at most
    said = [(c, min(x, MOST), min(sum(sums.values()), MOST), hashlib.sha256(",".join(map(str, centroids[c].tolist())).encode()).hexdigest()) for c, x in sums.items()]
    known = spark.createDataFrame(said, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return found.join(F.broadcast(known), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
