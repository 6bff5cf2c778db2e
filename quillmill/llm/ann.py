"""Approximate nearest neighbours by inner product: a hierarchical k-means tree, searched best bin first.

The tree is fitted on a bounded sample (`fit_rows` vectors) and broadcast; every row is put into its leaf.
A query walks the tree through a priority queue that always opens the node whose centroid has the largest
inner product with it, plus what the node's radius can add; leaves come off the queue in visiting order. How
many leaves to visit is calibrated: for a bounded sample of queries the exact neighbours are found among all rows,
and visits are widened until `target_recall` of them lie in the leaves visited. A walk goes on until the leaves hold
more than k rows.

Leaves that follow each other in the tree make a shard of about `shard_rows` rows; a larger leaf is several shards.
A query goes once to each shard that holds a leaf it visits, and gets the best k of those leaves back as one
row. The queries of a shard are taken in blocks of about `query_rows`, each with its own copy of the shard, so neither
a vector that a third of the rows share nor a leaf that all queries visit gathers in one task. Vectors travel as bytes.
What a tree can spare depends on the vectors: where they have no clusters, neighbours lie in many leaves, and
calibration widens the visits accordingly.

Defined cases: vectors that are null, zero, or hold a null or non-finite component take no part, nor do those
whose length isn't the commonest; rows without id take no part; ties go to the smaller id; repeated rows are separate
rows (a row of the query's own id is no candidate); fewer than k candidates give fewer rows; empty tables give an
empty result; other columns are ignored. There are no texts.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillmill.llm.common import cut, join_if_small

#: One row a query and shard: ids and scores of its best rows there.
FOUND = "query_id long, ids array<long>, scores array<double>"


class Tree:
    """Hierarchical k-means over sample rows: arrays of centroids, radii and children."""

    def __init__(self, sample: np.ndarray, branch: int, leaf_rows: float, seed: int = 0):
        self.centroid, self.radius, self.children, self.leaf = [], [], [], []
        self.n_leaves = 0
        rng = np.random.default_rng(seed)
        self._grow(sample, branch, leaf_rows, rng)
        self.centroid, self.radius = np.array(self.centroid), np.array(self.radius)
        self.leaf_nodes = np.array([i for i, x in enumerate(self.leaf) if x >= 0])

    def _grow(self, rows: np.ndarray, branch: int, leaf_rows: float, rng: np.random.Generator) -> int:
        me = len(self.centroid)
        center = rows.mean(axis=0)
        self.centroid.append(center)
        self.radius.append(float(np.sqrt(((rows - center) ** 2).sum(axis=1).max())))
        self.children.append([])
        self.leaf.append(-1)
        label = kmeans(rows, branch, rng) if len(rows) > max(leaf_rows, 1) else None
        if label is None:
            self.leaf[me] = self.n_leaves
            self.n_leaves += 1
        else:
            self.children[me] = [self._grow(rows[label == c], branch, leaf_rows, rng) for c in np.unique(label)]
        return me

    def assign(self, rows: np.ndarray) -> np.ndarray:
        """The leaf of each row: down the tree to the nearest child."""
        out, todo = np.empty(len(rows), dtype=np.int64), [(0, np.arange(len(rows)))]
        while todo:
            node, at = todo.pop()
            if self.leaf[node] >= 0:
                out[at] = self.leaf[node]
            elif len(at):
                kids = self.children[node]
                c = self.centroid[kids]
                near = ((c**2).sum(axis=1) - 2 * rows[at] @ c.T).argmin(axis=1)
                todo += [(kid, at[near == i]) for i, kid in enumerate(kids)]
        return out

    def visits(self, query: np.ndarray, most: int, sizes: np.ndarray | None = None, k: int = 0, reach: float = 0.5) -> list[int]:
        """Leaves in the order in which the best bin comes first: `most` of them, and further ones until they hold more than k rows."""
        worth = (self.centroid @ query + reach * np.linalg.norm(query) * self.radius).tolist()
        queue, out, held = [(-worth[0], 0)], [], 0
        while queue and (len(out) < most or held <= k):
            _, node = heapq.heappop(queue)
            if self.leaf[node] >= 0:
                out.append(self.leaf[node])
                held += k + 1 if sizes is None else sizes[self.leaf[node]]
            for kid in self.children[node]:
                heapq.heappush(queue, (-worth[kid], kid))
        return out


def kmeans(rows: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 8) -> np.ndarray | None:
    """Labels of at least two clusters; None if the rows can't be divided."""
    distinct = np.unique(rows, axis=0)
    if len(distinct) < 2:
        return None
    centers = distinct[rng.choice(len(distinct), min(k, len(distinct)), replace=False)]
    for _ in range(rounds):
        label = ((centers**2).sum(axis=1) - 2 * rows @ centers.T).argmin(axis=1)
        centers = np.array([rows[label == c].mean(axis=0) if (label == c).any() else centers[c] for c in range(len(centers))])
    return label if len(np.unique(label)) > 1 else None


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """vec_id, v (array of double) of the rows that take part."""
    v = F.col(vector_col).cast("array<double>")
    finite = F.forall(v, lambda x: F.coalesce((F.abs(x) < float("inf")) & ~F.isnan(x), F.lit(False)))
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), v.alias("v")).filter(F.col("vec_id").isNotNull() & F.coalesce(finite & F.exists("v", lambda x: x != 0), F.lit(False)))
    common = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.col("count").desc(), "n").first()
    return rows.filter(F.size("v") == (common["n"] if common else 0))


def _matrix(column: pd.Series) -> np.ndarray:
    """One row for each binary vector."""
    return np.frombuffer(b"".join(column), np.float64).reshape(len(column), -1)


def best(query_ids: np.ndarray, queries: np.ndarray, ids: np.ndarray, rows: np.ndarray, k: int, visible=None) -> list[tuple[int, list[int], list[float]]]:
    """Each query's k largest inner products among rows, ties to smaller id; a row of the query's own id doesn't count.

    visible: for some queries at a time, (positions among them, positions of rows) of what they may see; all if None.
    Products of blocks only select; what they select, with a margin for rounding, is computed again pair by pair.
    """
    out = []
    for a in range(0, len(queries), 256):
        part = queries[a : a + 256]
        if visible is None:
            score = part @ rows.T
        else:
            score = np.full((len(part), len(rows)), -np.inf)
            for some, at in visible(a, a + 256):
                score[np.ix_(some, at)] = part[some] @ rows[at].T
        score[query_ids[a : a + 256][:, None] == ids[None, :]] = -np.inf
        edge = np.partition(score, score.shape[1] - k, axis=1)[:, score.shape[1] - k] if score.shape[1] > k else np.full(len(part), -np.inf)
        margin = 1e-9 * (1 + np.abs(np.where(np.isfinite(edge), edge, 0)))
        for q, v, s, e in zip(query_ids[a : a + 256].tolist(), part, score, edge - margin):
            at = np.flatnonzero((s >= e) & (s > -np.inf))
            true = (rows[at] * v).sum(axis=1)
            order = np.lexsort((ids[at], -true))[:k]
            out.append((q, ids[at][order].tolist(), true[order].tolist()))
    return out


def exact(queries: list[tuple[int, bytes]], rows: DataFrame, k: int) -> DataFrame:
    """query_id, vec_id, leaf of the true neighbours of a bounded list of queries among all rows; each batch of rows keeps its best k."""
    at = np.array([q for q, _ in queries]), _matrix([v for _, v in queries])

    def scan(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            if len(frame):
                leaf = dict(zip(frame["vec_id"], frame["leaf"]))
                found = best(*at, frame["vec_id"].to_numpy(), _matrix(frame["v"]), k)
                yield pd.DataFrame([(q, i, s, leaf[i]) for q, ids, scores in found for i, s in zip(ids, scores)], columns=["query_id", "vec_id", "score", "leaf"])

    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    found = rows.mapInPandas(scan, "query_id long, vec_id long, score double, leaf long")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def shards_of(sizes: np.ndarray, shard_rows: int) -> tuple[np.ndarray, np.ndarray]:
    """For each leaf its first shard and its number of shards: leaves share a shard up to shard_rows rows, a larger leaf has several."""
    first, times, shard, held = np.zeros(len(sizes), np.int64), np.ones(len(sizes), np.int64), 0, 0
    for leaf, n in enumerate(sizes.tolist()):
        if held and held + n > shard_rows:
            shard, held = shard + 1, 0
        first[leaf], times[leaf] = shard, max(1, -(-n // shard_rows))
        shard, held = (shard + int(times[leaf]), 0) if times[leaf] > 1 else (shard, held + n)
    return first, times


def search(
    vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", is_query=None, k: int = 20, target_recall: float = 0.95,
    leaf_rows: int = 64, branch: int = 8, fit_rows: int = 20_000, calibration: int = 64, shard_rows: int = 4_096, query_rows: int = 4_096,
) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found of each query, where is_query is a condition on vec_id."""
    is_query = F.pmod("vec_id", F.lit(20)) == 0 if is_query is None else is_query
    usable_rows = usable(vectors, id_col, vector_col)

    def pack(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield pd.DataFrame({"vec_id": frame["vec_id"], "v": [np.asarray(v, np.float64).tobytes() for v in frame["v"]]})

    rows = cut(usable_rows.mapInPandas(pack, "vec_id long, v binary"), "vectors")
    n, n_queries = rows.agg(F.count("*"), F.count_if(is_query)).first()
    spark = vectors.sparkSession
    if not n or not n_queries:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    drawn = lambda of, most, name: F.pmod(F.xxhash64(F.lit(name), "vec_id", F.col("v")), F.lit(1_000_000)) < int(np.ceil(min(1.0, most / of) * 1_000_000))
    sample = [bytes(r["v"]) for r in rows.filter(drawn(n, fit_rows, "fit")).select("v").toLocalIterator()]
    sample = _matrix(sample or [bytes(r["v"]) for r in rows.limit(fit_rows).select("v").collect()])
    tree = Tree(sample, branch, leaf_rows * len(sample) / n)
    shared = spark.sparkContext.broadcast(tree)

    def put(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield frame.assign(leaf=shared.value.assign(_matrix(frame["v"])) if len(frame) else pd.Series(dtype="int64"))

    placed = cut(rows.mapInPandas(put, "vec_id long, v binary, leaf long"), "leaves")

    # Calibration: widen the visits until the target share of true neighbours is in the leaves visited.
    some = lambda df: [(r["vec_id"], bytes(r["v"])) for r in df.toLocalIterator()]
    trial = some(rows.filter(is_query & drawn(n_queries, calibration, "try"))) or some(rows.filter(is_query).limit(1))
    truth = exact(trial, placed, k).select("query_id", "leaf").toPandas()
    needs = []
    for q, v in trial:
        turn = {leaf: i + 1 for i, leaf in enumerate(tree.visits(np.frombuffer(v), tree.n_leaves))}
        needs += [turn[leaf] for leaf in truth["leaf"][truth["query_id"] == q]]
    visits = int(np.quantile(needs, target_recall, method="higher")) if needs else 1

    sizes = np.zeros(tree.n_leaves, np.int64)
    for r in placed.groupBy("leaf").agg(F.count("*").alias("n")).collect():  # one row a leaf of the bounded tree
        sizes[r["leaf"]] = r["n"]
    first, times = shards_of(sizes, shard_rows)

    def walk(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for q, v in zip(frame["vec_id"], frame["v"]):
                leaves = np.array(shared.value.visits(np.frombuffer(v), visits, sizes, k))
                part = np.repeat(first[leaves], times[leaves])
                part += np.arange(len(part)) - np.repeat(np.cumsum(times[leaves]) - times[leaves], times[leaves])
                leaves = np.repeat(leaves, times[leaves])
                order = np.argsort(part, kind="stable")
                cuts = np.flatnonzero(np.diff(part[order])) + 1
                out += [(int(part[own[0]]), q, v, leaves[own].tolist()) for own in np.split(order, cuts)]
            yield pd.DataFrame(out, columns=["shard", "vec_id", "v", "leaves"])

    asked = cut(rows.filter(is_query).mapInPandas(walk, "shard long, vec_id long, v binary, leaves array<long>"), "asked")
    crowd = asked.groupBy("shard").agg(F.ceil(F.count("*") / query_rows).alias("blocks"))  # one row a shard
    spread = spark.createDataFrame(zip(range(tree.n_leaves), first.tolist(), times.tolist()), "leaf long, first long, times long")  # one row a leaf
    of_shard = lambda df: join_if_small(df, crowd, ["shard"], "inner", 16 * int(first[-1] + times[-1]))
    held = placed.join(F.broadcast(spread), "leaf").withColumn("shard", F.col("first") + F.pmod(F.xxhash64("vec_id"), "times"))
    held = of_shard(held.select("shard", "leaf", "vec_id", "v")).withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))).drop("blocks")
    asked = of_shard(asked).withColumn("block", F.pmod(F.xxhash64("vec_id"), "blocks")).drop("blocks")

    def meet(queries: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        found = []
        if len(queries) and len(rows):
            rows = rows.sort_values(["leaf", "vec_id"], kind="stable")
            leaf = rows["leaf"].to_numpy()
            cuts = np.concatenate([[0], np.flatnonzero(np.diff(leaf)) + 1, [len(leaf)]])
            names, wanted = leaf[cuts[:-1]], queries["leaves"].tolist()
            sees = np.array([np.isin(names, w) for w in wanted])

            def visible(a: int, b: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
                for i in range(len(names)):
                    if len(at := np.flatnonzero(sees[a:b, i])):
                        yield at, np.arange(cuts[i], cuts[i + 1])

            found = best(queries["vec_id"].to_numpy(), _matrix(queries["v"]), rows["vec_id"].to_numpy(), _matrix(rows["v"]), k, visible)
        return pd.DataFrame(found, columns=["query_id", "ids", "scores"])

    found = asked.groupBy("shard", "block").cogroup(held.groupBy("shard", "block")).applyInPandas(meet, FOUND)
    # A query's rows: the best k of each shard it went to. They are sorted in the JVM, by falling score, then by id.
    one = F.transform(F.arrays_zip("scores", "ids"), lambda x: F.struct((-x["scores"]).alias("less"), x["ids"].alias("vec_id")))
    nearest = F.slice(F.sort_array(F.flatten(F.collect_list(one))), 1, k)
    ranked = found.groupBy("query_id").agg(nearest.alias("nearest")).select("query_id", F.posexplode("nearest").alias("at", "x"))
    return ranked.select("query_id", (F.col("at") + 1).cast("int").alias("rank"), "x.vec_id", (-F.col("x.less")).alias("score"))
