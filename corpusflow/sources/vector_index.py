"""Approximate search in a collection of vectors: inverted lists of product-quantised residuals, written beside the collection."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusflow.operators.vectors import cosine_distance
from corpusflow.sources.collections import GONE, Collection

#: Entries and queries of the parts that a task compares at a time, and rows of best entries that it keeps.
ENTRY_PART, QUERY_PART, BEST_ROWS = 4_096, 512, 1_000_000


@dataclass(frozen=True)
class Quantizer:
    """Bounds of the fit and of the search."""

    sample: int = 20_000
    most_lists: int = 4096
    codes: int = 256
    width: int = 2
    rounds: int = 8
    recall: float = 0.97
    k: int = 5
    list_rows: int = 100_000
    query_block: int = 2000


def _nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    out = np.empty(len(x), np.int64)
    half = (centres**2).sum(axis=1) / 2
    for lo in range(0, len(x), 4096):
        out[lo : lo + 4096] = np.argmin(half - x[lo : lo + 4096] @ centres.T, axis=1)
    return out


def k_means(x: np.ndarray, k: int, rounds: int, seed: int = 7) -> np.ndarray:
    """Centres of at most k groups of the rows of x; empty ones keep their place."""
    rng = np.random.Generator(np.random.PCG64(seed))
    centres = x[np.sort(rng.permutation(len(x))[:k])].copy()
    for _ in range(rounds):
        own = _nearest(x, centres)
        n = np.bincount(own, minlength=len(centres))
        sums = np.stack([np.bincount(own, x[:, j], len(centres)) for j in range(x.shape[1])], axis=1)
        centres = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], centres)
    return centres


class Codebooks:
    """Centres of the lists and, for each `width` components of a residual, the centres of its codes. Vectors are of unit length."""

    def __init__(self, lists: np.ndarray, books: np.ndarray, probes: int, depth: int):
        self.lists, self.books, self.probes, self.depth = lists, books, probes, depth

    @property
    def dims(self) -> int:
        return self.lists.shape[1]

    def _parts(self, x: np.ndarray) -> np.ndarray:
        m, _, width = self.books.shape
        return np.pad(x, ((0, 0), (0, m * width - x.shape[1]))).reshape(len(x), m, width)

    def encode(self, unit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """List of each vector and the codes of its residual."""
        own = _nearest(unit, self.lists)
        parts = self._parts(unit - self.lists[own])
        return own, np.stack([_nearest(parts[:, j], self.books[j]) for j in range(len(self.books))], axis=1).astype(np.uint8)

    def decode(self, own: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """The vectors, in single precision, that lists and codes stand for."""
        parts = self.books[np.arange(codes.shape[1]), codes].reshape(len(codes), -1)[:, : self.dims]
        return (self.lists[own] + parts).astype(np.float32)


def estimates(query: np.ndarray, decoded: np.ndarray) -> np.ndarray:
    """Estimated squared distances (queries, entries): those to the decoded vectors, as one product of matrices."""
    query = query.astype(np.float32)
    return (query**2).sum(axis=1)[:, None] + (decoded**2).sum(axis=1) - 2 * (query @ decoded.T)


def fit(x: np.ndarray, total: int, q: Quantizer) -> Codebooks:
    """Lists and codebooks from a sample of unit vectors; the number of lists probed and of entries compared exactly are the least
    that find `recall` of the k nearest of queries held out from the sample (for the entries, among as many as the whole has)."""
    step = max(2, len(x) // 200)
    held = np.arange(len(x)) % step == 0
    asked, x = (x[held], x[~held]) if len(x) > 2 * q.k else (x, x)
    n = max(1, min(q.most_lists, int(round(total**0.5)), len(x) // 8 or 1))
    lists = k_means(x, n, q.rounds)
    own = _nearest(x, lists)
    residual = x - lists[own]
    parts = -(-x.shape[1] // q.width)
    padded = np.pad(residual, ((0, 0), (0, parts * q.width - x.shape[1]))).reshape(len(x), parts, q.width)
    books = np.stack([k_means(padded[:, j], min(q.codes, 256, len(x)), q.rounds) for j in range(parts)])
    books = np.pad(books, ((0, 0), (0, max(0, min(q.codes, 256) - books.shape[1])), (0, 0)), constant_values=1e6)
    made = Codebooks(lists, books, n, 10 * q.k)
    exact = 2 - 2 * asked @ x.T
    best = np.argsort(exact, axis=1, kind="stable")[:, : q.k]
    order = np.argsort((lists**2).sum(axis=1) / 2 - asked @ lists.T, axis=1)
    place = np.argsort(order, axis=1)
    needed = np.sort(np.take_along_axis(place, own[best], axis=1).ravel())
    made.probes = int(needed[min(len(needed) - 1, int(np.ceil(q.recall * len(needed))) - 1)]) + 1
    _, codes = made.encode(x)
    guess = np.empty_like(exact)
    for number in np.unique(own):
        guess[:, own == number] = estimates(asked, made.decode(own[own == number], codes[own == number]))
    ranks = np.argsort(np.argsort(guess, axis=1, kind="stable"), axis=1)
    needed = np.sort(np.take_along_axis(ranks, best, axis=1).ravel())
    depth = int(needed[min(len(needed) - 1, int(np.ceil(q.recall * len(needed))) - 1)]) + 1
    made.depth = max(4 * q.k, int(np.ceil(depth * max(1.0, total / len(x)))))
    return made


def _unit(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Rows that are vectors (not null, finite, of some length), and those at unit length."""
    rows = column.to_pylist()
    width = max((len(r) for r in rows if r is not None), default=0)
    ok = np.array([r is not None and len(r) == width and None not in r for r in rows], bool)
    x = np.array([r for r, good in zip(rows, ok) if good], float).reshape(-1, width)
    size = np.linalg.norm(x, axis=1) if len(x) else np.zeros(0)
    good = np.isfinite(size) & (size > 0)
    at = np.flatnonzero(ok)[good]
    return at, x[good] / size[good, None]


def nearest_entries(books: Codebooks, depth: int, key: str):
    """Function of a table of entries (key, list, code) and one of queries (query_id, lists, unit): query_id, key and estimate of each query's
    `depth` best entries in its lists, ties to the smaller key.

    Parts of the entries meet parts of the queries; what cannot be among the `depth` best so far is left out at once. So a task holds its two tables,
    the best so far, and one part's estimates, however many lists there are and however long they are."""

    def matrix(column: pa.ChunkedArray, kind: str) -> np.ndarray:
        column = column.combine_chunks()
        size = len(column[0].as_py())
        return np.frombuffer(column.buffers()[2], np.uint8)[column.offset * size : (column.offset + len(column)) * size].view(kind).reshape(len(column), -1)

    def nearest(left: pa.Table, right: pa.Table) -> pa.Table:
        ids, asked = left.column(key).combine_chunks(), right.column("query_id").combine_chunks()
        q, e, found = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0)]
        if len(ids) and len(asked):
            own, codes, unit = left.column("list").to_numpy(), matrix(left.column("code"), "u1"), matrix(right.column("unit"), "<f8")
            place = np.argsort(pa.compute.sort_indices(ids).to_numpy())
            order = np.argsort(own, kind="stable")
            probing = np.zeros((len(asked), len(books.lists)), bool)
            probing[np.arange(len(asked))[:, None], right.column("lists").combine_chunks().flatten().to_numpy().reshape(len(asked), -1)] = True
            parts = range(0, len(asked), QUERY_PART)
            best = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0), np.full(min(QUERY_PART, len(asked) - lo), np.inf)) for lo in parts]
            for start in range(0, len(ids), ENTRY_PART):
                at = order[start : start + ENTRY_PART]
                decoded, bounds = books.decode(own[at], codes[at]), np.append(np.flatnonzero(np.diff(own[at], prepend=-1)), len(at))
                for n, lo in enumerate(parts):
                    best_q, best_e, best_d, most = best[n]
                    guess = np.full((len(most), len(at)), np.inf, np.float32)
                    for a, z in zip(bounds[:-1], bounds[1:]):
                        some = np.flatnonzero(probing[lo : lo + QUERY_PART, own[at[a]]])
                        if len(some):
                            guess[some, a:z] = estimates(unit[lo + some], decoded[a:z])
                    if len(at) > depth and np.isinf(most).any():
                        most = np.minimum(most, np.partition(guess, depth - 1, axis=1)[:, depth - 1] + 2e-6)
                    at_q, at_e = np.nonzero((guess <= most[:, None] + 2e-6) & np.isfinite(guess))
                    all_q, all_e = np.append(best_q, at_q), np.append(best_e, at[at_e])
                    all_d = np.append(best_d, np.round(guess[at_q, at_e].astype(float), 6))
                    by = np.lexsort((place[all_e], all_d, all_q))
                    all_q, all_e, all_d = all_q[by], all_e[by], all_d[by]
                    rank = np.arange(len(all_q)) - np.searchsorted(all_q, all_q)
                    most = np.full(len(most), np.inf)
                    most[all_q[rank == depth - 1]] = all_d[rank == depth - 1]
                    best[n] = all_q[rank < depth], all_e[rank < depth], all_d[rank < depth], most
            q, e, found = ([g[i] + (lo if i == 0 else 0) for lo, g in zip(parts, best)] for i in range(3))
        return pa.table({"query_id": asked.take(pa.array(np.concatenate(q))), key: ids.take(pa.array(np.concatenate(e))), "estimate": pa.array(np.concatenate(found))})

    return nearest


class VectorIndex:
    """Inverted lists over a collection's vectors.

    A folder for each folder of the collection holds its entries by list: the id, the codes, and the columns to filter by. `build`
    fits lists and codebooks on a bounded sample; `refresh` writes entries for folders that have none yet, so that an upsert costs the index its own
    rows, and drops those of folders that are no longer read. A search opens the lists that its queries probe, filters within them, takes each
    query's best entries by estimated distance, and compares those exactly by the collection's current rows; so entries of rows
    that were replaced or taken away give no wrong result, and neither does a filter by a column that has changed.

    Vectors that are null, zero or not finite take no part. Lists are dealt to tasks of about `list_rows` entries, a longer list to many, and each
    task sends `depth` entries a query at most, so what is moved and held follows from queries and tasks, not from the lists.
    """

    def __init__(self, collection: Collection, column: str = "embedding", filters: tuple[str, ...] = (), q: Quantizer = Quantizer()):
        self.collection, self.column, self.filters, self.q = collection, column, filters, q
        self.spark, self.path = collection.spark, f"{collection.path}.index"
        self.books: Codebooks | None = None

    def build(self) -> None:
        """Fit on a sample of the collection and index all of it."""
        rows = self.collection.read().select(self.collection.key, self.column)
        total = rows.count()
        share = self.q.sample / max(1, total)
        some = rows if share >= 1 else rows.where(F.pmod(F.xxhash64(self.collection.key), F.lit(1 << 40)) < int(share * (1 << 40)))
        _, x = _unit(some.limit(2 * self.q.sample).select(self.column).toArrow().column(0).combine_chunks())
        self.books = fit(x, total, self.q)
        b = self.books
        model = [(b.probes, b.depth, *b.lists.shape, *b.books.shape, b.lists.astype("<f8").tobytes(), b.books.astype("<f8").tobytes())]
        self.spark.createDataFrame(model, "probes int, depth int, n int, dims int, parts int, codes int, width int, lists binary, books binary").write.mode("overwrite").parquet(f"{self.path}/model")
        for name in self._indexed():
            self._delete(name)
        self.refresh()

    def load(self) -> Codebooks:
        if self.books is None:
            r = self.spark.read.parquet(f"{self.path}/model").first()
            self.books = Codebooks(np.frombuffer(r["lists"], "<f8").reshape(r["n"], r["dims"]), np.frombuffer(r["books"], "<f8").reshape(r["parts"], r["codes"], r["width"]), r["probes"], r["depth"])
        return self.books

    def _at(self, name: str = ""):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/entries{'/' + name if name else ''}")
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()), path

    def _indexed(self) -> list[str]:
        fs, path = self._at()
        return sorted(s.getPath().getName() for s in fs.listStatus(path) if self._at(f"{s.getPath().getName()}/_SUCCESS")[0].exists(self._at(f"{s.getPath().getName()}/_SUCCESS")[1])) if fs.exists(path) else []

    def _delete(self, name: str) -> None:
        fs, path = self._at(name)
        fs.delete(path, True)

    def refresh(self) -> list[str]:
        """Index the collection's folders that are not indexed yet, and return their names."""
        books, done, wanted, key = self.load(), self._indexed(), self.collection.current(), self.collection.key
        names = [key, *self.filters, "list", "code"]
        for name in (n for n in wanted if n not in done):
            rows = self.collection.version_rows(name).where(f"not {GONE}")
            kinds = dict(rows.dtypes)

            def encode(batches):
                for batch in batches:
                    at, unit = _unit(batch.column(batch.num_columns - 1))
                    own, codes = books.encode(unit) if len(at) else (np.zeros(0, np.int64), np.zeros((0, 1), np.uint8))
                    kept = [batch.column(i).take(pa.array(at)) for i in range(batch.num_columns - 1)]
                    yield pa.RecordBatch.from_arrays([*kept, pa.array(own, pa.int32()), pa.array([c.tobytes() for c in codes], pa.binary())], names)

            schema = ", ".join(f"`{c}` {kinds[c]}" for c in (key, *self.filters)) + ", list int, code binary"
            entries = rows.select(key, *self.filters, self.column).mapInArrow(encode, schema)
            entries.repartition("list", F.pmod(F.xxhash64(key), F.lit(16))).sortWithinPartitions("list").write.partitionBy("list").parquet(f"{self.path}/entries/{name}")
        for name in done:
            if name not in wanted:
                self._delete(name)
        return [n for n in wanted if n not in done]

    def entries(self) -> DataFrame:
        """Entries of the folders that the collection reads; the list is a column of the folders' structure."""
        out = None
        for name in self.collection.current():
            rows = self.spark.read.parquet(f"{self.path}/entries/{name}")
            rows = rows.select(self.collection.key, *self.filters, F.col("list").cast("int").alias("list"), "code") if "list" in rows.columns else None  # a folder may have none
            out = rows if out is None else out if rows is None else out.unionByName(rows)
        return out

    def probed(self, queries: DataFrame, query_id: str, vector: str) -> DataFrame:
        """query_id, lists (array) and unit (the query's vector): the lists nearest to each query."""
        books = self.load()

        def run(batches):
            for batch in batches:
                at, unit = _unit(batch.column(1))
                order = np.argsort((books.lists**2).sum(axis=1) / 2 - unit @ books.lists.T, axis=1)[:, : books.probes] if len(at) else np.zeros((0, 1), np.int64)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at)), pa.array(list(order.astype(np.int32)), pa.list_(pa.int32())), pa.array([u.tobytes() for u in unit], pa.binary())], ["query_id", "lists", "unit"])

        return queries.select(query_id, vector).mapInArrow(run, f"query_id {dict(queries.dtypes)[query_id]}, lists array<int>, unit binary")

    def touched(self, queries: DataFrame, query_id: str = "query_id", vector: str = "embedding") -> float:
        """Share of the entries whose codes a query reads, on average."""
        sizes = self.entries().groupBy("list").count()
        asked = self.probed(queries, query_id, vector).select("query_id", F.explode("lists").alias("list"))
        read = asked.join(sizes, "list").groupBy("query_id").agg(F.sum("count").alias("n")).agg(F.avg("n")).first()[0] or 0
        return read / max(1, self.entries().count())

    def guesses(self, queries: DataFrame, depth: int, where: Column | None = None, query_id: str = "query_id", vector: str = "embedding") -> DataFrame:
        """query_id, key and estimate: the `depth` best entries of each query in the lists of each task."""
        books, key, q = self.load(), self.collection.key, self.q
        probes = self.probed(queries, query_id, vector)
        lists = sorted(r[0] for r in probes.select(F.explode("lists").alias("list")).distinct().collect())  # most_lists at most
        entries = self.entries().where(F.col("list").isin(lists))
        entries = entries.where(where) if where is not None else entries
        total, longest = entries.groupBy("list").count().agg(F.sum("count"), F.max("count")).first()
        parts = max(1, -(-(longest or 0) // q.list_rows))  # of each list
        groups = max(1, -(-(total or 0) // (q.list_rows * parts)))
        blocks = max(1, -(-queries.count() // max(1, min(q.query_block, BEST_ROWS // depth))))
        left = entries.select(F.pmod(F.xxhash64("list"), F.lit(groups)).alias("g"), F.pmod(F.xxhash64(key), F.lit(parts)).alias("e"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("q"), key, "list", "code")
        tasks = F.explode(F.sequence(F.lit(0), F.lit(groups * parts - 1))).alias("t")
        right = probes.select(F.pmod(F.xxhash64("query_id"), F.lit(blocks)).cast("int").alias("q"), tasks, "query_id", "lists", "unit")
        right = right.select(F.floor(F.col("t") / parts).alias("g"), (F.col("t") % parts).cast("long").alias("e"), "q", "query_id", "lists", "unit")
        both = left.groupBy("g", "e", "q").cogroup(right.groupBy("g", "e", "q"))
        return both.applyInArrow(nearest_entries(books, depth, key), f"query_id {dict(probes.dtypes)['query_id']}, `{key}` {dict(entries.dtypes)[key]}, estimate double")

    def search(self, queries: DataFrame, k: int, where: Column | None = None, query_id: str = "query_id", vector: str = "embedding") -> DataFrame:
        """query_id, the collection's key, distance (cosine, exact) and rank of the k nearest rows found that fit `where`, a condition on
        filter columns."""
        key, depth = self.collection.key, max(self.load().depth, k)
        guesses = self.guesses(queries, depth, where, query_id, vector)
        order = Window.partitionBy("query_id").orderBy("estimate", key)
        few = guesses.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= depth).select("query_id", key).distinct()
        rows = self.collection.read()
        rows = (rows.where(where) if where is not None else rows).select(key, F.col(self.column).alias("_own"))
        asked = queries.select(F.col(query_id).alias("query_id"), F.col(vector).alias("_asked"))
        near = few.join(rows, key).join(asked, "query_id").select("query_id", key, F.round(cosine_distance(F.col("_asked"), F.col("_own")), 12).alias("distance"))
        rank = F.row_number().over(Window.partitionBy("query_id").orderBy("distance", key))
        return near.withColumn("rank", rank).where(F.col("rank") <= k)
