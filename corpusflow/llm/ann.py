"""Nearest neighbours by inner product through low-dimensional stable projections and kd-trees.

Vectors are scaled by the largest norm and given one more coordinate that makes them unit vectors, so the largest
inner product is the smallest Euclidean distance. A Gaussian (2-stable) matrix projects them to `dims` numbers. Given
the true distance d of two points, their squared projected distance is d^2 times a chi-square variable of `dims`
degrees of freedom. So once the k-th best verified distance is d, points further away than d * sqrt(q) in the
projection, q the `confidence` quantile of that distribution, are nearer than d with probability 1 - confidence at most:
the search verifies points in order of projected distance until that test holds for all the rest.

Cells. A kd-tree over a bounded sample of projections (`sample` vectors, those with the smallest hash; it shapes the
cells only, every vector is indexed) cuts the space into cells; a cell of more than `cell_rows` vectors is dealt into
parts. Each part gets a kd-tree of its own in the task that searches it. Every query first searches its own cell, which
bounds its k-th distance, then the `near_cells` nearest others for which the test does not hold, judged by their bounding
boxes, which tightens the bound, and then the rest of them. Queries of a cell are dealt into blocks too, so a task holds a
part and a block of bounded size whatever the skew.

Vectors that are null, zero, of another length than most, or that hold null or non-finite components take no part, as
queries or candidates; neither do rows without an id. With fewer than k candidates all are returned. Rows are told apart by
a number that they get when the index is written: rows that share an id are a candidate each, with its own score, and a
query each, with a list of its own; only the query's own row is left out of it. Ties go to the smaller id. An empty table
gives no rows. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusflow.llm.common import bounded_sample, materialize, read_table


@dataclass(frozen=True)
class Projection:
    dims: int = 8
    confidence: float = 0.7
    seed: int = 11
    sample: int = 20_000
    cell_rows: int = 8192
    most_cells: int = 1024
    query_rows: int = 8192
    near_cells: int = 3
    leaf: int = 64


def chi_square_quantile(p: float, dims: int) -> float:
    """x with P(chi-square of `dims` degrees <= x) = p, for even dims, by bisection on the closed form."""
    if dims % 2:
        raise ValueError("dims must be even")
    cdf = lambda x: 1 - math.exp(-x / 2) * sum((x / 2) ** i / math.factorial(i) for i in range(dims // 2))
    lo, hi = 0.0, 1000.0
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if cdf(mid) < p else (lo, mid)
    return hi


def valid_vectors(vectors: DataFrame, vec_id: str, column: str, asked: str) -> DataFrame:
    """id, vec (array<double>) and asked of the vectors that take part."""
    v = F.col("vec")
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    rows = vectors.select(F.col(vec_id).cast("long").alias("id"), F.col(column).cast("array<double>").alias("vec"), F.col(asked).alias("asked")).where(F.col("id").isNotNull() & F.coalesce(fine, F.lit(False)))
    size = rows.groupBy(F.size("vec").alias("n")).count().orderBy(F.desc("count"), F.desc("n")).first()  # the length that most have
    return rows.where(F.size("vec") == (size["n"] if size else 0))


def _rows(column: pa.Array, width: int) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


class Cells:
    """A kd-tree with few leaves over projected points: splits in level order, leaves numbered from the left."""

    def __init__(self, sample: np.ndarray, leaves: int):
        self.depth = max(0, math.ceil(math.log2(max(leaves, 1))))
        self.axis, self.cut = np.zeros(2**self.depth, int), np.zeros(2**self.depth)

        def split(at: int, rows: np.ndarray) -> None:
            if at >= 2**self.depth:
                return
            if len(rows):
                self.axis[at] = int(np.argmax(rows.max(axis=0) - rows.min(axis=0)))
                self.cut[at] = float(np.median(rows[:, self.axis[at]]))
            low = rows[:, self.axis[at]] <= self.cut[at]
            split(2 * at, rows[low])
            split(2 * at + 1, rows[~low])

        split(1, sample)

    def of(self, points: np.ndarray) -> np.ndarray:
        at = np.ones(len(points), int)
        for _ in range(self.depth):
            at = 2 * at + (points[np.arange(len(points)), self.axis[at]] > self.cut[at])
        return at - 2**self.depth


def _leaves(points: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """kd-tree over a part: an order of its points, and where each leaf of at most `size` points begins in it."""
    order, edges, todo = np.arange(len(points)), [0], [(0, len(points))]
    while todo:
        lo, hi = todo.pop()
        if hi - lo <= size:
            edges.append(hi)
            continue
        own = points[order[lo:hi]]
        axis = int(np.argmax(own.max(axis=0) - own.min(axis=0)))
        mid = (hi - lo) // 2
        order[lo:hi] = order[lo:hi][np.argpartition(own[:, axis], mid)]
        todo += [(lo + mid, hi), (lo, lo + mid)]
    return order, np.array(edges)


def _box_distance(low: np.ndarray, high: np.ndarray, points: np.ndarray) -> np.ndarray:
    """Squared distances from points (rows) to boxes (columns)."""
    out = np.zeros((len(points), len(low)))
    for axis in range(points.shape[1]):
        x = points[:, axis][:, None]
        out += np.maximum(0, np.maximum(low[:, axis][None] - x, x - high[:, axis][None])) ** 2
    return out


def search_part(ids, rows, vecs, points, q_rows, q_vecs, q_points, bound, scale, k, quantile, leaf):
    """The k best candidates of a part for each query, best first: their scaled inner products, rounded so that equal vectors
    tie, their places in the part (-1: none), and how many candidates each query was compared with. bound: the least
    similarity that a result must reach.

    Leaves are visited in order of projected distance, more at a time as the search goes on, until the test holds.
    """
    order, edges = _leaves(points, leaf)
    low = np.array([points[order[a:b]].min(axis=0) for a, b in zip(edges, edges[1:])])
    high = np.array([points[order[a:b]].max(axis=0) for a, b in zip(edges, edges[1:])])
    away = _box_distance(low, high, q_points)
    rank = np.argsort(away, axis=1, kind="stable")
    unit = scale * np.linalg.norm(q_vecs, axis=1)
    # ties go by id, then row: a candidate's number is its place in that order
    by_id = np.lexsort((rows, ids))
    number = np.empty(len(ids), np.int64)
    number[by_id] = np.arange(len(ids))
    number, own_rows, own_vecs = number[order], rows[order], vecs[order]
    best = np.full((len(q_rows), k), -np.inf)
    who = np.full((len(q_rows), k), len(ids))
    scored = np.zeros(len(q_rows), np.int64)
    done, step = 0, 1
    while done < len(low):
        kth = np.maximum(best[:, -1], bound)
        todo = rank[:, done : done + step]
        open_ = np.take_along_axis(away, todo, axis=1) < (quantile * np.maximum(0, 2 - 2 * kth) + 1e-9)[:, None]
        if not open_.any():
            break
        q, j = np.nonzero(open_)
        leaf_of = todo[q, j]
        by = np.argsort(leaf_of, kind="stable")
        q, leaf_of = q[by], leaf_of[by]
        cuts = np.flatnonzero(np.concatenate([[True], leaf_of[1:] != leaf_of[:-1]]))
        for a, b in zip(cuts, np.append(cuts[1:], len(q))):
            own, part = q[a:b], slice(edges[leaf_of[a]], edges[leaf_of[a] + 1])
            score = np.round(q_vecs[own] @ own_vecs[part].T / unit[own][:, None], 12)
            scored[own] += score.shape[1]
            score[(own_rows[part][None, :] == q_rows[own][:, None]) | (score < bound[own][:, None])] = -np.inf
            hit = np.flatnonzero((score >= best[own, -1][:, None]).any(axis=1) & (score > -np.inf).any(axis=1))
            own, score = own[hit], score[hit]
            all_ = np.concatenate([best[own], score], axis=1)
            names = np.concatenate([who[own], np.broadcast_to(number[part], score.shape)], axis=1)
            names[all_ == -np.inf] = len(ids)
            top = np.lexsort((names, -all_), axis=1)[:, :k]
            best[own], who[own] = np.take_along_axis(all_, top, axis=1), np.take_along_axis(names, top, axis=1)
        done, step = done + step, step * 2
    return best, np.append(by_id, -1)[who], scored


def nearest(vectors: DataFrame, asked: Column | DataFrame, k: int = 20, p: Projection = Projection(), vec_id: str = "vec_id", column: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found of each query.

    asked: a condition, which names the rows of vectors that are queries too, or a table of queries with the same columns.
    """
    spark = vectors.sparkSession
    within = isinstance(asked, Column)
    marked = vectors.withColumn("__asked", F.coalesce(asked, F.lit(False)) if within else F.lit(False))
    rows = materialize(valid_vectors(marked, vec_id, column, "__asked").withColumn("row", F.monotonically_increasing_id()), "ann-vectors")
    norm = F.sqrt(F.aggregate("vec", F.lit(0.0), lambda a, x: a + x * x))
    facts = rows.agg(F.count(F.lit(1)).alias("n"), F.max(norm).alias("norm"), F.max(F.size("vec")).alias("d")).first()
    n, scale, width = facts["n"], facts["norm"] or 1.0, facts["d"] or 1
    matrix = np.random.Generator(np.random.PCG64(p.seed)).standard_normal((width + 1, p.dims))
    quantile = chi_square_quantile(p.confidence, p.dims)
    m = p.dims

    def projected(v: np.ndarray, query: bool) -> np.ndarray:
        if query:
            return (v / np.linalg.norm(v, axis=1, keepdims=True)) @ matrix[:-1]
        v = v / scale
        rest = np.sqrt(np.maximum(0, 1 - (v * v).sum(axis=1, keepdims=True)))
        return np.concatenate([v, rest], axis=1) @ matrix

    leaves = min(p.most_cells, max(1, n // (p.cell_rows // 2)))
    picked = bounded_sample(rows, p.sample, "id").select("vec").collect()  # at most twice p.sample rows
    cells = Cells(projected(np.array([r["vec"] for r in picked], float).reshape(-1, width), False), leaves)

    def place(query: bool):
        def run(batches):
            for batch in batches:
                v = _rows(batch.column(2), width)
                x = projected(v, query)
                points = pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), m).cast(pa.list_(pa.float64()))
                yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(3)), points, pa.array(cells.of(x).astype(np.int32))], ["id", "row", "vec", "point", "cell"])

        return run

    placed = "id long, row long, vec array<double>, point array<double>, cell int"
    index = materialize(rows.select("id", "row", "vec").mapInArrow(place(False), placed), "ann-index")
    if within:
        queries = rows.where("asked").select("id", "row", "vec")
    else:
        outside = valid_vectors(asked.withColumn("__asked", F.lit(True)), vec_id, column, "__asked").where(F.size("vec") == width)
        queries = materialize(outside.select("id", (-1 - F.monotonically_increasing_id()).alias("row"), "vec"), "ann-outside")
    asked = materialize(queries.mapInArrow(place(True), placed), "ann-queries")
    edges = [f(F.col("point")[i]).alias(f"{name}{i}") for i in range(m) for name, f in (("lo", F.min), ("hi", F.max))]
    boxes = index.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), *edges).collect()  # one row per cell, at most p.most_cells
    low = np.array([[r[f"lo{i}"] for i in range(m)] for r in boxes], float).reshape(-1, m)
    high = np.array([[r[f"hi{i}"] for i in range(m)] for r in boxes], float).reshape(-1, m)
    names = np.array([r["cell"] for r in boxes], np.int32)
    parts = spark.createDataFrame([(r["cell"], max(1, -(-r["n"] // p.cell_rows))) for r in boxes], "cell int, parts int")
    parts = F.broadcast(parts)  # at most p.most_cells rows
    result = "query_id long, query_row long, vec_id long, row long, score double"

    def searched(routed: DataFrame) -> DataFrame:
        """routed: id, row, vec, point, bound, cell. The results of every (query, cell), already cut to k for each part."""
        blocks = routed.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / F.lit(p.query_rows)).cast("int").alias("blocks"))
        blocks = F.broadcast(spark.createDataFrame([tuple(r) for r in blocks.collect()], "cell int, blocks int"))  # one row per cell
        data = index.join(parts, "cell").join(blocks, "cell")
        data = data.select("cell", F.pmod(F.xxhash64("row"), F.col("parts")).cast("int").alias("part"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), "id", "row", "vec", "point")
        some = routed.join(parts, "cell").join(blocks, "cell")
        some = some.select("cell", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.pmod(F.xxhash64("row"), F.col("blocks")).cast("int").alias("block"), "id", "row", "vec", "point", "bound")

        def run(left: pa.Table, right: pa.Table) -> pa.Table:
            out = [np.zeros(0, np.int64)] * 4 + [np.zeros(0)]
            if left.num_rows and right.num_rows:
                vecs, q_vecs = _rows(left.column("vec"), width), _rows(right.column("vec"), width)
                ids, rows, q_ids, q_rows = (t.column(c).to_numpy() for t in (left, right) for c in ("id", "row"))
                _, who, _ = search_part(ids, rows, vecs, _rows(left.column("point"), m), q_rows, q_vecs, _rows(right.column("point"), m), right.column("bound").to_numpy(), scale, k, quantile, p.leaf)
                a, b = np.nonzero(who >= 0)
                at = who[a, b]
                # one order of addition, so that equal vectors score the same
                out = [q_ids[a], q_rows[a], ids[at], rows[at], (vecs[at] * q_vecs[a]).sum(axis=1)]
            return pa.table({f.split()[0]: pa.array(x, pa.float64() if f.endswith("double") else pa.int64()) for f, x in zip(result.split(", "), out)})

        keys = ["cell", "part", "block"]
        return data.groupBy(*keys).cogroup(some.groupBy(*keys)).applyInArrow(run, result)

    order = Window.partitionBy("query_row").orderBy(F.desc("score"), "vec_id", "row")
    top = lambda df: df.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    routes = "id long, row long, vec array<double>, point array<double>, bound double, cell int"

    def route(from_: int, to: int | None):
        """Cells of each query, nearest first, from the from_-th to the to-th, for which the test does not hold; its own is left out."""

        def run(batches):
            for batch in batches:
                v, x, own = _rows(batch.column(2), width), _rows(batch.column(3), m), batch.column(4).to_numpy()
                kth = batch.column(5).to_numpy(zero_copy_only=False)
                bound = np.where(np.isnan(kth), -np.inf, kth / (scale * np.linalg.norm(v, axis=1)) - 1e-11)
                away = _box_distance(low, high, x)
                away[names[None, :] == own[:, None]] = np.inf
                some = np.argsort(away, axis=1, kind="stable")[:, from_:to]
                near = np.take_along_axis(away, some, axis=1) < (quantile * np.maximum(0, 2 - 2 * bound) + 1e-9)[:, None]
                q, j = np.nonzero(near)
                take = pa.array(q)
                yield pa.RecordBatch.from_arrays([*(batch.column(i).take(take) for i in range(4)), pa.array(bound[q]), pa.array(names[some[q, j]])], ["id", "row", "vec", "point", "bound", "cell"])

        return run

    found = materialize(top(searched(asked.withColumn("bound", F.lit(float("-inf"))).select("id", "row", "vec", "point", "bound", "cell"))), "ann-own")
    for from_, to in ((0, p.near_cells), (p.near_cells, None)):
        if len(boxes) - 1 <= from_:
            break
        kth = found.where(F.col("rank") == k).select(F.col("query_row").alias("row"), F.col("score").alias("kth"))
        more = asked.join(kth, "row", "left").select("id", "row", "vec", "point", "cell", F.col("kth").cast("double"))
        more = materialize(more.mapInArrow(route(from_, to), routes), "ann-routes")
        found = materialize(top(found.drop("rank").unionByName(searched(more))), "ann-found")
    return found.select("query_id", "rank", "vec_id", "score")


def op1_projected_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows whose vec_id is divisible by 20 search all rows but their own."""
    return nearest(read_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)
