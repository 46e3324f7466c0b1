"""Approximate nearest neighbours by inner product: a hierarchical k-means tree, searched best bin first.

The tree is fitted on a bounded sample and indexes every vector in a leaf. A query's
leaves are visited in the order of a priority queue over the tree. How many is
calibrated: for CALIBRATION queries the true neighbours are found among all vectors,
and visits are widened until the leaves visited hold the target share of them. Vectors
get one more component that makes all norms equal, so that the nearest by distance are
those with the largest inner products.
"""

from __future__ import annotations

import heapq
import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from cuesheet.scratch import drop, keep


SAMPLE = 160_000
CALIBRATION = 96
BRANCH = 8
LEAF_ROWS = 200
CELL_VECTORS, CELL_QUERIES = 4096, 2048
#: From which leaf of a query's way to which, search by search; the last goes on to the calibrated number.
WIDENINGS = ((0, 1), (1, 8), (8, None))


@dataclass
class Tree:
    """children[i] are the child nodes of node i (none: a leaf), centers its place; leaf numbers leaves."""

    centers: np.ndarray
    children: list[np.ndarray]
    leaf: np.ndarray

    @property
    def leaves(self) -> int:
        return int(self.leaf.max()) + 1

    def assign(self, x: np.ndarray) -> np.ndarray:
        """The leaf of each row of x, by descent to the nearest child."""
        at = np.zeros(len(x), dtype=np.int64)
        moving = np.arange(len(x)) if len(self.children[0]) else np.zeros(0, np.int64)
        while len(moving):
            for node in np.unique(at[moving]):
                rows = moving[at[moving] == node]
                below = self.children[node]
                c = self.centers[below]
                at[rows] = below[np.argmin((c * c).sum(1) - 2 * x[rows] @ c.T, axis=1)]
            moving = moving[[len(self.children[n]) > 0 for n in at[moving]]]
        return self.leaf[at]

    def visit(self, q: np.ndarray, visits: int) -> list[int]:
        """The first leaves on the way of a best-bin-first search for q."""
        queue, out = [(0.0, 0)], []
        while queue and len(out) < visits:
            _, node = heapq.heappop(queue)
            below = self.children[node]
            if not len(below):
                out.append(int(self.leaf[node]))
                continue
            d = self.centers[below] - q
            for distance, child in zip((d * d).sum(1).tolist(), below.tolist(), strict=True):
                heapq.heappush(queue, (distance, child))
        return out


def fit(x: np.ndarray, leaves: int, seed: int = 7) -> Tree:
    """A tree of about so many leaves over the rows of x, each split into BRANCH clusters by k-means."""
    rng = np.random.default_rng(seed)
    centers, children, leaf = [x.mean(0) if len(x) else np.zeros(x.shape[1])], [np.zeros(0, np.int64)], [-1]
    small, todo, n_leaves = max(2, len(x) // max(1, leaves)), [(0, np.arange(len(x)))], 0
    while todo:
        node, rows = todo.pop()
        own = x[rows]
        starts = np.unique(own, axis=0)
        if len(rows) > small and len(starts) > 1:
            k = min(BRANCH, len(starts), max(2, round(len(rows) / small)))
            c = starts[rng.choice(len(starts), k, replace=False)]
            for _ in range(10):
                near = np.argmin((c * c).sum(1) - 2 * own @ c.T, axis=1)
                c = np.array([own[near == j].mean(0) if (near == j).any() else c[j] for j in range(k)])
            near = np.argmin((c * c).sum(1) - 2 * own @ c.T, axis=1)
            used = [j for j in range(k) if (near == j).any()]
            if len(used) > 1:
                children[node] = np.arange(len(centers), len(centers) + len(used))
                for j in used:
                    todo.append((len(centers), rows[near == j]))
                    centers.append(c[j])
                    children.append(np.zeros(0, np.int64))
                    leaf.append(-1)
                continue
        leaf[node] = n_leaves
        n_leaves += 1
    return Tree(np.array(centers), children, np.array(leaf))


def matrix(column: pa.Array) -> np.ndarray:
    """An array column of equal lengths as a matrix of doubles."""
    return np.stack(column.to_numpy(zero_copy_only=False)).astype(np.float64) if len(column) else np.zeros((0, 0))


def lifted(x: np.ndarray, longest: float, query: bool = False) -> np.ndarray:
    """x with the component that gives all vectors the norm `longest`; queries get 0."""
    extra = np.zeros(len(x)) if query else np.sqrt(np.maximum(longest - (x * x).sum(1), 0.0))
    return np.hstack([x, extra[:, None]])


def inner_products(q: np.ndarray, v: np.ndarray) -> np.ndarray:
    """All inner products, each summed component by component in order, so that equal vectors score equally."""
    out = np.zeros((len(q), len(v)))
    for k in range(q.shape[1]):
        out += q[:, k, None] * v[None, :, k]
    return out


def best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k largest scores, largest first, ties to the smaller id."""
    if len(scores) > k:
        kth = np.partition(scores, len(scores) - k)[len(scores) - k]
        at = np.flatnonzero(scores >= kth)
    else:
        at = np.arange(len(scores))
    return at[np.lexsort((ids[at], -scores[at]))][:k]


def usable(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """(vec_id, embedding) of the vectors that take part.

    Components stay floats where they are floats, and are doubles otherwise. Left out: null
    ids; vectors that are null, zero, or hold null or non-finite components; vectors of
    another length than most have, with which there is no inner product (of equally
    frequent lengths, the smallest is kept). Rows of one vec_id are one vector, the smallest of them.
    """
    element = vectors.schema[embedding].dataType.elementType.simpleString()
    kept = F.col(embedding).cast(f"array<{element if element == 'float' else 'double'}>")
    rows = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), kept.alias("embedding")).where("vec_id is not null and embedding is not null")
    odd = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    rows = rows.where(~F.exists("embedding", odd) & F.exists("embedding", lambda x: x != 0))
    length = rows.groupBy(F.size("embedding").alias("n")).agg(F.count(F.lit(1)).alias("rows")).orderBy(F.desc("rows"), "n").first()
    rows = rows.where(F.size("embedding") == (length["n"] if length else 0))
    return rows.groupBy("vec_id").agg(F.min("embedding").alias("embedding"))


def _nearest(by_query: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return by_query.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _exact(rows: DataFrame, queries: np.ndarray, own: np.ndarray, k: int) -> DataFrame:
    """(query_id, vec_id, leaf, score): the k nearest of all rows for each of a few queries."""
    shared = rows.sparkSession.sparkContext.broadcast((queries, own))

    def run(batches):
        q, ids = shared.value
        for batch in batches:
            v, vec_ids, leaves = matrix(batch.column(1)), batch.column(0).to_numpy(), batch.column(2).to_numpy()
            found = [[], [], [], []]
            for i, scores in enumerate(q @ v.T):
                for j in best(np.where(vec_ids == ids[i], -np.inf, scores), vec_ids, k):
                    for out, x in zip(found, (ids[i], vec_ids[j], leaves[j], scores[j]), strict=True):
                        out.append(x)
            yield pa.RecordBatch.from_arrays([pa.array(found[0], pa.int64()), pa.array(found[1], pa.int64()), pa.array(found[2], pa.int32()), pa.array(found[3], pa.float64())], ["query_id", "vec_id", "leaf", "score"])

    return _nearest(rows.select("vec_id", "embedding", "leaf").mapInArrow(run, "query_id long, vec_id long, leaf int, score double"), k)


def _search_cell(k: int):
    def run(queries: pa.Table, vectors: pa.Table) -> pa.Table:
        v, vec_ids = matrix(vectors["embedding"].combine_chunks()), vectors["vec_id"].to_numpy()
        q, ids, least = matrix(queries["embedding"].combine_chunks()), queries["query_id"].to_numpy(), queries["least"].to_numpy()
        found: list[list] = [[], [], []]
        for start in range(0, len(ids) if len(vec_ids) else 0, 256):
            for i, scores in enumerate(inner_products(q[start : start + 256], v), start):
                scores = np.where(vec_ids == ids[i], -np.inf, scores)
                for j in best(scores, vec_ids, k):
                    if scores[j] >= least[i] and scores[j] > -np.inf:
                        for out, x in zip(found, (ids[i], vec_ids[j], scores[j]), strict=True):
                            out.append(x)
        return pa.table({"query_id": pa.array(found[0], pa.int64()), "vec_id": pa.array(found[1], pa.int64()), "score": pa.array(found[2], pa.float64())})

    return run


def _in_cells(queries: DataFrame, vectors: DataFrame, sizes: dict[int, int], k: int) -> DataFrame:
    """Search queries (query_id, embedding, least, leaf) in their leaves.

    A large leaf is split among cells of about CELL_VECTORS vectors, and its queries among
    blocks of about CELL_QUERIES; every block meets every cell of the leaf once.
    """
    asked = {r["leaf"]: r["n"] for r in queries.groupBy("leaf").agg(F.count(F.lit(1)).alias("n")).collect()}

    def split(counts: dict[int, int], of: int) -> Column:
        many = {leaf: math.ceil(n / of) for leaf, n in counts.items() if n > of}
        if not many:
            return F.lit(1)
        table = F.create_map(*[F.lit(x) for pair in many.items() for x in pair])
        return F.coalesce(F.try_element_at(table, F.col("leaf")), F.lit(1))

    cells, blocks = split(sizes, CELL_VECTORS), split(asked, CELL_QUERIES)
    dealt_v = vectors.withColumn("cell", F.pmod(F.xxhash64("vec_id"), cells).cast("int")).withColumn("block", F.explode(F.sequence(F.lit(0), blocks - 1)))
    dealt_q = queries.withColumn("block", F.pmod(F.xxhash64("query_id"), blocks).cast("int")).withColumn("cell", F.explode(F.sequence(F.lit(0), cells - 1)))
    by = ["leaf", "cell", "block"]
    return dealt_q.groupBy(*by).cogroup(dealt_v.groupBy(*by)).applyInArrow(_search_cell(k), "query_id long, vec_id long, score double")


def search(vectors: DataFrame, is_query: Column, k: int = 20, target: float = 0.95, vec_id: str = "vec_id", embedding: str = "embedding", sample: int = SAMPLE) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest vectors found for each query.

    is_query is a condition on vec_id. Candidates are all usable vectors but the query's
    own id; with fewer than k all are returned. score is the inner product of the original
    vectors in double precision; ties go to the smaller vec_id. Empty tables give no rows.

    target is the recall that visits are widened to on the calibration queries. Leaves
    are searched in the steps of WIDENINGS; from a step only scores that could still count
    after those before are sent on.
    """
    spark = vectors.sparkSession
    rows = keep(usable(vectors, vec_id, embedding), "vectors")
    norm = F.aggregate("embedding", F.lit(0.0).cast("double"), lambda a, x: a + x.cast("double") * x.cast("double"))
    total, longest = rows.agg(F.count(F.lit(1)), F.max(norm)).first()
    empty = "query_id long, rank int, vec_id long, score double"
    if not total:
        return spark.createDataFrame([], empty)
    taken = rows.orderBy(F.xxhash64(F.col("vec_id"), F.lit(1))).limit(sample).toArrow()
    taken_x, taken_ids = matrix(taken["embedding"].combine_chunks()), taken["vec_id"].to_numpy()
    tree = fit(lifted(taken_x, longest), max(1, min(total // LEAF_ROWS, len(taken_ids) // 10)))
    shared = spark.sparkContext.broadcast(tree)

    def leaves(batches):
        for batch in batches:
            leaf = shared.value.assign(lifted(matrix(batch.column(1)), longest)) if batch.num_rows else np.zeros(0)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(leaf.astype(np.int32))], ["vec_id", "embedding", "leaf"])

    kind = rows.schema["embedding"].dataType.simpleString()
    placed = keep(rows.mapInArrow(leaves, f"vec_id long, embedding {kind}, leaf int"), "placed")
    sizes = {r["leaf"]: r["n"] for r in placed.groupBy("leaf").agg(F.count(F.lit(1)).alias("n")).collect()}

    trial, trial_ids = taken_x[:CALIBRATION], taken_ids[:CALIBRATION]
    true = _exact(placed, trial, trial_ids, k).select("query_id", "leaf").toPandas()
    place = {int(i): {leaf: n for n, leaf in enumerate(tree.visit(q, tree.leaves))} for i, q in zip(trial_ids, lifted(trial, longest, query=True), strict=True)}
    needed = np.sort([place[i][leaf] + 1 for i, leaf in zip(true["query_id"], true["leaf"], strict=True)])
    visits = int(needed[math.ceil(target * len(needed)) - 1]) if len(needed) else tree.leaves

    def visited(batches):
        for batch in batches:
            x = lifted(matrix(batch.column(1)), longest, query=True) if batch.num_rows else []
            order = [shared.value.visit(q, visits) for q in x]
            lists = pa.array(order, pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), lists], ["query_id", "embedding", "leaves"])

    queries = keep(rows.where(is_query).mapInArrow(visited, f"query_id long, embedding {kind}, leaves array<int>"), "queries")
    found, used = None, [rows, placed, queries]
    for start, stop in WIDENINGS:
        least = F.lit(float("-inf")).cast("double")
        asked = queries
        if found is not None:
            kth = _nearest(found, k).groupBy("query_id").agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("kth")).where(F.col("n") == k)
            asked, least = queries.join(kth.select("query_id", "kth"), "query_id", "left"), F.coalesce("kth", least)
        wider = asked.select("query_id", "embedding", least.alias("least"), F.explode(F.slice("leaves", start + 1, (stop or visits) - start)).alias("leaf")) if visits > start else None
        if wider is not None:
            wider = keep(wider, "asked")
            more = keep(_in_cells(wider, placed, sizes, k), "found")
            drop(wider)
            found = more if found is None else found.union(more)
    for table in used:
        drop(table)
    return _nearest(found, k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
