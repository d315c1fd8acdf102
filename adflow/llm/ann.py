"""Approximate nearest neighbours by a hierarchical k-means tree, searched best bin first.

The tree is fitted on a bounded sample (``FIT`` vectors): every node splits its
share by k-means until a leaf stands for about ``LEAF`` rows of the table.  All
rows are put into leaves.  A search keeps a priority queue of nodes by distance
of their centre; it opens the nearest one, and each leaf it reaches is visited
whole.  How many leaves are visited is calibrated: for ``CALIBRATION`` rows, the
ones of least hash of the whole table, the true neighbours are found by brute
force over the whole table, and visits are widened until ``TARGET`` of those
neighbours lie in visited leaves.  A query whose leaves hold too few other items
goes on until they hold ``k``.

Queries meet the rows of a leaf in blocks: at most ``BLOCK`` rows against
``BLOCK`` queries in one group, so a leaf that holds a third of all rows, or
takes a third of all queries, is many groups.  Each group returns the best few
of each query; the first leaves bound how far the others still look, so what
all groups return stays small.  Distances are computed on the original vectors
in double precision.

Defined results: vectors that are null, all zero, or hold a null or a number
that is not finite take no part, nor do rows without an id, nor vectors of
another length than the most common one (of the longest such); rows that share
an id are one item, whose distance is that of its nearest vector, and which is
no neighbour of itself; ties go to the smaller id; with fewer candidates than
``k``, all are returned; an empty table gives an empty table.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from adflow.llm.base import Scratch, arrow_map, ship_code

K = 10
FIT = 20_000        # vectors that the tree is fitted on
LEAF = 256          # rows of the table in a leaf, about
LEAST = 8           # sampled vectors that a leaf stands on at least
BRANCHES = 8        # children of a node
ROUNDS = 8          # of k-means
CALIBRATION = 128   # rows whose true neighbours are looked up
TARGET = 0.97       # of them must be in visited leaves
BLOCK = 4096        # rows, and queries, that meet at a time


def matrix(vectors: pa.Array) -> np.ndarray:
    """The vectors of a list column as doubles, one per row."""
    if isinstance(vectors, pa.ChunkedArray):
        vectors = vectors.combine_chunks()
    flat = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(vectors), -1)


def squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.maximum((a * a).sum(1)[:, None] + (b * b).sum(1)[None] - 2 * a @ b.T, 0)


@dataclass
class Node:
    centres: np.ndarray | None = None
    children: list[Node] = field(default_factory=list)
    leaf: int = -1


class Tree:
    """A hierarchical k-means tree over ``sample``; leaves are numbered from 0."""

    def __init__(self, sample: np.ndarray, leaf_size: int, seed: int = 5):
        self.leaves = 0
        self._rng = np.random.default_rng(seed)
        self.root = self._grow(sample, leaf_size)

    def _grow(self, points: np.ndarray, leaf_size: int) -> Node:
        if len(points) <= leaf_size or (points == points[0]).all():
            self.leaves += 1
            return Node(leaf=self.leaves - 1)
        centres = points[self._rng.choice(len(points), min(BRANCHES, len(points)), replace=False)]
        for _ in range(ROUNDS):
            near = squared(points, centres).argmin(axis=1)
            used = np.unique(near)
            centres = np.array([points[near == c].mean(axis=0) for c in used])
        near = squared(points, centres).argmin(axis=1)
        used = np.unique(near)
        if len(used) < 2:
            self.leaves += 1
            return Node(leaf=self.leaves - 1)
        return Node(centres[used], [self._grow(points[near == c], leaf_size) for c in used])

    def place(self, points: np.ndarray) -> np.ndarray:
        """The leaf of each point: the nearest child at every level."""
        out = np.zeros(len(points), np.int32)
        todo = [(self.root, np.arange(len(points)))]
        while todo:
            node, some = todo.pop()
            if node.centres is None:
                out[some] = node.leaf
                continue
            near = squared(points[some], node.centres).argmin(axis=1)
            todo.extend((child, some[near == c]) for c, child in enumerate(node.children) if (near == c).any())
        return out

    def nearest_leaves(self, point: np.ndarray, most: int, items: dict[int, int] | None = None, least: int = 0) -> list[int]:
        """The first ``most`` leaves that best-bin-first reaches, and further ones until they hold ``least`` of ``items``."""
        queue: list[tuple[float, int, Node]] = [(0.0, 0, self.root)]
        found, pushed, held = [], 0, 0
        while queue and (len(found) < most or held < least):
            _, _, node = heapq.heappop(queue)
            while node.centres is not None:   # down to the nearest leaf; the siblings wait in the queue
                far = squared(point[None], node.centres)[0]
                best = int(far.argmin())
                for c, child in enumerate(node.children):
                    if c != best:
                        pushed += 1
                        heapq.heappush(queue, (float(far[c]), pushed, child))
                node = node.children[best]
            found.append(node.leaf)
            held += (items or {}).get(node.leaf, 0)
        return found


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    v = F.col(vector_col)
    odd = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return (vectors.where(F.col(id_col).isNotNull() & v.isNotNull() & (F.size(v) > 0))
            .where(~odd & ~F.forall(v, lambda x: x == 0))
            .select(F.col(id_col).cast("long").alias("id"), v.alias("vec")))


def best(queries: np.ndarray, query_ids: np.ndarray, rows: np.ndarray, ids: np.ndarray, k: int,
         bound: np.ndarray | float = np.inf) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each query's ``k`` nearest rows of another id, none beyond its ``bound``: query number, id, distance."""
    rough = squared(queries, rows)
    rough[query_ids[:, None] == ids[None]] = np.inf
    slack = 1e-9 * (1 + (queries * queries).sum(1) + (rows * rows).sum(1).max(initial=0))
    limit = np.minimum(np.partition(rough, min(k, len(ids)) - 1, axis=1)[:, min(k, len(ids)) - 1], np.square(bound)) + slack
    q, r = np.nonzero((rough <= limit[:, None]) & np.isfinite(rough))
    score = np.sqrt(((queries[q] - rows[r]) ** 2).sum(axis=1))
    within = score <= np.broadcast_to(bound, len(queries))[q]
    q, r, score = q[within], r[within], score[within]
    order = np.lexsort((ids[r], score, q))
    q, r, score = q[order], r[order], score[order]
    nth = np.arange(len(q)) - np.searchsorted(q, q)
    keep = nth < k
    return q[keep], ids[r[keep]], score[keep]


def _calibrate(index: DataFrame, tree: Tree, ids: np.ndarray, points: np.ndarray, k: int, target: float) -> int:
    """Leaves to visit: true neighbours of ``points`` by brute force, and where best-bin-first meets their leaf."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, BLOCK):
                part = batch.slice(start, BLOCK)
                rid, leaf = part.column(0).to_numpy(), part.column(1).to_numpy()
                # row numbers stand in for ids here, so that the leaf can be told
                rough = np.arange(len(rid))
                own = np.array([-1] * len(ids))
                q, r, score = best(points, own, matrix(part.column(2)), rough, k + 1)
                other = rid[r] != ids[q]
                yield pa.RecordBatch.from_arrays([pa.array(q[other], pa.int32()), pa.array(rid[r[other]]), pa.array(score[other]),
                                                  pa.array(leaf[r[other]], pa.int32())], ["q", "id", "score", "leaf"])

    near = arrow_map(index.select("id", "leaf", "vec"), run, "q int, id long, score double, leaf int")
    nth = F.row_number().over(Window.partitionBy("q").orderBy("score", "id"))
    true = near.withColumn("nth", nth).where(F.col("nth") <= k).collect()   # CALIBRATION x k rows
    order = [{leaf: n for n, leaf in enumerate(tree.nearest_leaves(p, tree.leaves))} for p in points]
    met = np.sort([order[r["q"]][r["leaf"]] for r in true])
    return int(met[min(len(met) - 1, int(np.ceil(target * len(met))) - 1)]) + 1 if len(met) else tree.leaves


def nearest(vectors: DataFrame, is_query: Column, k: int = K, id_col: str = "vec_id", vector_col: str = "embedding",
            target: float = TARGET) -> DataFrame:
    """``query_id, rank, vec_id, score``: the ``k`` nearest rows found for each row where ``is_query`` (of ``id``)."""
    spark = vectors.sparkSession
    ship_code(spark)
    scratch = Scratch(spark, "ann")
    rows = usable(vectors, id_col, vector_col)
    sizes = sorted((r["count"], r["n"]) for r in rows.groupBy(F.size("vec").alias("n")).count().collect())
    total, width = sizes[-1] if sizes else (0, 0)
    rows = rows.where(F.size("vec") == width)
    sample = rows.sample(min(1.0, FIT / max(total, 1)), seed=3).toArrow()
    if not len(sample):
        sample = rows.limit(FIT).toArrow()
    points = matrix(sample.column("vec")) if len(sample) else np.zeros((1, 1))
    tree = Tree(points, max(LEAST, round(LEAF * len(points) / max(total, 1))))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(tree.place(matrix(batch.column(1))))], ["id", "vec", "leaf"])

    index = scratch.write(arrow_map(rows, place, f"id long, vec {rows.schema['vec'].dataType.simpleString()}, leaf int"), "index")
    counts = {r["leaf"]: r["n"] for r in index.groupBy("leaf").agg(F.count(F.lit(1)).alias("n")).collect()}  # a row a leaf
    # an id counts in one of its leaves only, so leaves together hold at least as many items as their sum
    items = {r["leaf"]: r["n"] for r in index.groupBy("id").agg(F.min("leaf").alias("leaf")).groupBy("leaf").agg(F.count(F.lit(1)).alias("n")).collect()}
    drawn = rows.orderBy(F.xxhash64("id", "vec"), "id").limit(CALIBRATION).toArrow()
    ids = np.array(drawn.column("id").to_pylist(), dtype=np.int64)
    visits = _calibrate(index, tree, ids, matrix(drawn.column("vec")), k, target) if len(ids) else 1

    def reach(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            leaves = [tree.nearest_leaves(p, visits, items, k + 1) for p in matrix(batch.column(1))]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(leaves, pa.list_(pa.int32()))], ["id", "vec", "leaves"])

    queries = rows.where(is_query)
    reached = arrow_map(queries, reach, f"id long, vec {rows.schema['vec'].dataType.simpleString()}, leaves array<int>")
    probes = scratch.write(reached.select("id", "vec", F.posexplode("leaves").alias("nth", "leaf")), "probes")
    asked = {r["leaf"]: r["n"] for r in probes.groupBy("leaf").agg(F.count(F.lit(1)).alias("n")).collect()}
    cut = spark.createDataFrame([(leaf, -(-n // BLOCK), -(-asked.get(leaf, 1) // BLOCK)) for leaf, n in counts.items()],
                                "leaf int, blocks int, chunks int")
    some = lambda n, seed: F.pmod(F.xxhash64(F.lit(seed), "id"), F.col(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    keys = ["leaf", "block", "chunk"]
    blocks = index.join(cut, "leaf").select("leaf", some("blocks", 1).alias("block"), each("chunks").alias("chunk"), "id", "vec")

    def meet(of_rows: pa.Table, of_queries: pa.Table) -> pa.Table:
        q, rid, score = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        if of_rows.num_rows and of_queries.num_rows:
            asked_ids = of_queries.column("id").to_numpy()
            q, rid, score = best(matrix(of_queries.column("vec")), asked_ids, matrix(of_rows.column("vec")),
                                 of_rows.column("id").to_numpy(), k, of_queries.column("bound").to_numpy())
            q = asked_ids[q]
        return pa.table({"query_id": pa.array(q, pa.int64()), "vec_id": pa.array(rid, pa.int64()), "score": pa.array(score)})

    def visit(asking: DataFrame) -> DataFrame:
        chunks = asking.join(cut, "leaf").select("leaf", some("chunks", 2).alias("chunk"), each("blocks").alias("block"), "id", "vec", "bound")
        found = blocks.groupBy(*keys).cogroup(chunks.groupBy(*keys)).applyInArrow(meet, "query_id long, vec_id long, score double")
        return found.groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))

    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    # what the first leaves give bounds what the others may add
    ahead = int(np.ceil(np.sqrt(visits)))
    first = visit(probes.where(F.col("nth") < ahead).withColumn("bound", F.lit(float("inf"))))
    first = scratch.write(first.withColumn("rank", rank).where(F.col("rank") <= k), "first")
    bound = first.where(F.col("rank") == k).select(F.col("query_id").alias("id"), F.col("score").alias("bound"))
    rest = probes.where(F.col("nth") >= ahead).join(bound, "id", "left").withColumn("bound", F.coalesce("bound", F.lit(float("inf"))))
    found = first.select("query_id", "vec_id", "score").unionByName(visit(rest))
    found = found.groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def ann_report(embeddings: DataFrame) -> DataFrame:
    """The columns of query ``op5_ann``: rows whose id is divisible by 100 against all rows."""
    return nearest(embeddings, F.col("id") % 100 == 0)
