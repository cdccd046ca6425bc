"""Vectors: cosine distance, exact top-k, a hashing embedder, and collections with upsert."""

from __future__ import annotations

from typing import Protocol

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusflow.config import DEFAULT
from corpusflow.functions.text import let, runs, word_tokens

#: Rows of a block of vectors and of queries in a top-k join, which one task is given, and of the parts of them that it compares at a time.
VECTOR_BLOCK, QUERY_BLOCK = 10_000, 4_000
VECTOR_PART, QUERY_PART = 2_048, 512


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine_distance(a: Column, b: Column) -> Column:
    """1 - cosine; null where either vector is zero."""
    return 1 - F.try_divide(dot(a, b), norm(a) * norm(b))


def sparse_dot(a: Column, b: Column) -> Column:
    """Dot product of two sparse vectors, arrays of (d, w)."""
    weights = F.map_from_entries(F.transform(b, lambda x: F.struct(x["d"], x["w"])))
    return let(weights, lambda m: F.aggregate(a, F.lit(0.0), lambda s, x: s + x["w"] * F.coalesce(F.try_element_at(m, x["d"]), F.lit(0.0))))


def text_similarity(df: DataFrame, embedder: Embedder, left: str, right: str, out: str) -> DataFrame:
    """df with the cosine of two texts' vectors; null where either has none."""
    rows = embedder.embed(embedder.embed(df, left, "_left"), right, "_right")
    sparse = dict(rows.dtypes)["_left"].startswith("array<struct")
    similarity = F.when((F.size("_left") > 0) & (F.size("_right") > 0), sparse_dot(F.col("_left"), F.col("_right"))) if sparse else 1 - cosine_distance(F.col("_left"), F.col("_right"))
    return rows.withColumn(out, similarity).drop("_left", "_right")


def top_k(vectors: DataFrame, query: list[float], k: int = DEFAULT.top_k, where: Column | None = None, vec_id: str = "vec_id", column: str = "embedding") -> DataFrame:
    """The k nearest rows to one query, filtered before distances are taken: an ordered limit, no full sort."""
    rows = vectors.where(where) if where is not None else vectors
    literal = F.array(*(F.lit(float(x)) for x in query))
    return rows.withColumn("distance", cosine_distance(F.col(column), literal)).orderBy("distance", vec_id).limit(k)


def nearest_of_blocks(k: int, dims: int | None = None):
    """Function of a block of vectors and one of queries (id, vec): query_id, vec_id, distance of the k nearest of the block to each query."""

    def matrix(lists: pa.Array, width: int) -> np.ndarray:
        lengths = np.array(pa.compute.fill_null(pa.compute.list_value_length(lists), 0))
        rows, entries = np.repeat(np.arange(len(lists)), lengths), lists.flatten()
        if dims:
            out = np.zeros((len(lists), width))
            out[rows, entries.field("d").to_numpy(zero_copy_only=False)] = entries.field("w").to_numpy(zero_copy_only=False)
            return out
        out = np.full((len(lists), width), np.nan)
        out[rows, np.arange(len(rows)) - np.repeat(np.cumsum(lengths) - lengths, lengths)] = entries.to_numpy(zero_copy_only=False)
        return out

    def sized(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """x, the lengths of its rows, and the rows at unit length in single precision; NaN where they have none."""
        size = np.linalg.norm(x, axis=1)
        good = np.isfinite(size) & (size > 0)
        return x, size, np.where(good[:, None], x / np.where(good, size, 1)[:, None], np.nan).astype(np.float32)

    def exact(y: np.ndarray, y_size: np.ndarray, x: np.ndarray, x_size: np.ndarray, q: np.ndarray, v: np.ndarray) -> np.ndarray:
        out, step = np.empty(len(q)), max(1, (1 << 20) // max(1, x.shape[1]))
        for lo in range(0, len(q), step):
            i, j = q[lo : lo + step], v[lo : lo + step]
            out[lo : lo + step] = 1 - np.einsum("ij,ij->i", y[i], x[j]) / (y_size[i] * x_size[j])
        return np.where(np.isnan(out), np.inf, np.round(out, 12))

    def nearest(a: pa.Table, b: pa.Table) -> pa.Table:
        ids, asked = a.column("id").combine_chunks(), b.column("id").combine_chunks()
        q, v, found = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0)]
        if len(ids) and len(asked):
            lists = [t.column("vec").combine_chunks() for t in (a, b)]
            width = dims or max(pa.compute.max(pa.compute.list_value_length(x)).as_py() or 0 for x in lists)
            margin = 2.0 ** -23 * (width + 16)  # a sum's error in single precision
            place = np.argsort(pa.compute.sort_indices(ids).to_numpy())  # ids in order, so that ties go to the smaller
            with np.errstate(invalid="ignore", divide="ignore", over="ignore", under="ignore"):
                parts = [(lo, *sized(matrix(lists[1].slice(lo, QUERY_PART), width))) for lo in range(0, len(asked), QUERY_PART)]
                best = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0), np.full(len(y), -np.inf)) for _, y, _, _ in parts]
                for start in range(0, len(ids), VECTOR_PART):
                    x, x_size, x_unit = sized(matrix(lists[0].slice(start, VECTOR_PART), width))
                    for n, (_, y, y_size, y_unit) in enumerate(parts):
                        score = y_unit @ x_unit.T
                        score[np.isnan(score)] = -np.inf
                        best_q, best_v, best_d, least = best[n]
                        if len(x) > k and np.isinf(least).any():
                            least = np.maximum(least, np.partition(score, len(x) - k, axis=1)[:, len(x) - k] - margin)
                        at_q, at_v = np.nonzero(score >= (least - margin)[:, None])
                        all_q, all_v = np.append(best_q, at_q), np.append(best_v, at_v + start)
                        all_d = np.append(best_d, exact(y, y_size, x, x_size, at_q, at_v))
                        order = np.lexsort((place[all_v], all_d, all_q))
                        all_q, all_v, all_d = all_q[order], all_v[order], all_d[order]
                        rank = np.arange(len(all_q)) - np.searchsorted(all_q, all_q)
                        last = all_q[rank == k - 1]
                        least = np.full(len(y), -np.inf)
                        least[last] = 1 - all_d[rank == k - 1] - 1e-11
                        best[n] = all_q[rank < k], all_v[rank < k], all_d[rank < k], least
            q, v, found = ([g[i] + (part[0] if i == 0 else 0) for part, g in zip(parts, best)] for i in range(3))
        return pa.table({"query_id": asked.take(pa.array(np.concatenate(q))), "vec_id": ids.take(pa.array(np.concatenate(v))), "distance": pa.array(np.concatenate(found))})

    return nearest


def top_k_join(vectors: DataFrame, queries: DataFrame, k: int = DEFAULT.top_k, vec_id: str = "vec_id", column: str = "embedding", query_id: str = "query_id", dims: int | None = None) -> DataFrame:
    """query_id, vec_id, distance, rank of the k nearest vectors of each query (query_id, column), exactly.

    Blocks of vectors meet blocks of queries; each pair of blocks sends k rows a query, so what is shuffled is both tables once per
    block of the other, and the k best of each block. A task compares parts of its blocks: products in single precision leave out
    what their error cannot bring among the k best so far, and the few others are compared in double precision; so what a task
    holds is its blocks, the k best so far and one part. Ids are longs or strings. Vectors are arrays of numbers or, with dims,
    sparse: arrays of (d, w). Those without a distance (null, zero, holding null or NaN) come last, at infinity.
    """
    counts = [max(1, -(-df.count() // n)) for df, n in ((vectors, VECTOR_BLOCK), (queries, QUERY_BLOCK))]
    kinds = dict(vectors.dtypes)[vec_id], dict(queries.dtypes)[query_id]
    number = lambda df: "array<float>" if dict(df.dtypes)[column] == "array<float>" else "array<double>"
    side = lambda df, key, own, other: df.select(
        F.pmod(F.xxhash64(key), F.lit(counts[own])).cast("int").alias("own"), F.explode(F.sequence(F.lit(0), F.lit(counts[other] - 1))).alias("other"), F.col(key).alias("id"),
        (F.col(column) if dims else F.col(column).cast(number(df))).alias("vec"),
    )
    left = side(vectors, vec_id, 0, 1).withColumnsRenamed({"own": "v", "other": "q"})
    right = side(queries, query_id, 1, 0).withColumnsRenamed({"own": "q", "other": "v"})

    pairs = left.groupBy("v", "q").cogroup(right.groupBy("v", "q")).applyInArrow(nearest_of_blocks(k, dims), f"query_id {kinds[1]}, vec_id {kinds[0]}, distance double")
    order = Window.partitionBy("query_id").orderBy("distance", "vec_id")
    return pairs.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


class Embedder(Protocol):
    """Adds a vector column to rows with texts; external encoders implement it with an Arrow iterator in the workers."""

    def embed(self, df: DataFrame, text: str, out: str) -> DataFrame: ...


class HashingEmbedder:
    """Deterministic bag-of-words vectors of unit length by hashing tokens to dimensions, in expressions alone."""

    def __init__(self, dims: int = 384):
        self.dims = dims

    def vector(self, text: Column) -> Column:
        """Token counts by pmod(crc32(token), dims), over their norm; zeros for a text without tokens."""
        at = F.transform(word_tokens(text), lambda t: F.pmod(F.crc32(t.cast("binary")), F.lit(self.dims)).cast("int"))

        def scaled(counted: Column) -> Column:
            size = F.sqrt(F.aggregate(counted, F.lit(0.0), lambda a, r: a + r["n"] * r["n"]))
            return let(F.struct(counted.alias("r"), size.alias("size")), lambda c: F.transform(c["r"], lambda r: F.struct(r["value"].alias("d"), (r["n"] / c["size"]).alias("w"))))

        return F.coalesce(let(runs(at), scaled), F.array().cast("array<struct<d:int,w:double>>"))

    def embed(self, df: DataFrame, text: str, out: str) -> DataFrame:
        """Sparse vectors: array of (d, w), d ascending."""
        return df.withColumn(out, self.vector(F.col(text)))


def upsert(current: DataFrame, changes: DataFrame, key: str, version: str) -> DataFrame:
    """Rows of both, for each key the one of the highest version; changes win over current ones of the same version."""
    rows = current.withColumn("_new", F.lit(0)).unionByName(changes.withColumn("_new", F.lit(1)))
    last = Window.partitionBy(key).orderBy(F.desc(version), F.desc("_new"))
    return rows.withColumn("_r", F.row_number().over(last)).where("_r = 1").drop("_r", "_new")


def flatten_metadata(df: DataFrame, columns: list[str]) -> Column:
    """Map of the columns as strings: nulls left out, arrays joined by ', '."""
    kinds = dict(df.dtypes)
    value = lambda c: F.array_join(F.col(c).cast("array<string>"), ", ") if kinds[c].startswith("array") else F.col(c).cast("string")
    entries = F.array(*(F.struct(F.lit(c).alias("key"), value(c).alias("value")) for c in columns))
    return F.map_from_entries(F.filter(entries, lambda e: e["value"].isNotNull()))
