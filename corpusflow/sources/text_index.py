"""Sparse retrieval: an inverted index in impact order, and exact top-k search that skips what cannot be among the k best."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusflow.functions.text import let, runs, word_tokens
from corpusflow.sources.collections import Collection
from corpusflow.steps import materialize

#: Postings of a block, and the margin for sums of floating point numbers in another order.
BLOCK, MARGIN = 128, 1 - 1e-9
#: Share of the bound up to which values are left out; what they may add is what rows may lack, and still be summed up.
LEFT_OUT = 0.2
#: Postings of a segment, rows of a bucket of bags, and queries that one task sums up for a segment.
SEGMENT, BUCKET_ROWS, QUERY_BLOCK = 1_000_000, 50_000, 256


def bm25_bags(docs: DataFrame, key: str, text: str, k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """key, bag (array of (value, w)) of each text: its words with their saturated, length-normalised counts. The mean length is the
    collection's own, over all rows."""
    counted = docs.select(key, let(word_tokens(F.col(text)), lambda w: F.struct(F.size(w).alias("n"), runs(w).alias("of"))).alias("_words"))
    counted = materialize(counted.select(key, "_words.n", "_words.of"), "word-counts")  # texts are read once
    mean = counted.agg(F.avg("n")).first()[0] or 1.0
    share = F.col("n") / F.lit(max(mean, 1e-9))
    weigh = lambda n: n * (k1 + 1) / (n + k1 * (1 - b + b * share))
    return counted.select(key, bag_of(F.col("of"), weigh).alias("bag"))


def bag_of(counted: Column, weigh=lambda n: n.cast("double")) -> Column:
    """Array of (value, w) from array of (value, n); empty for null."""
    return F.coalesce(F.transform(counted, lambda r: F.struct(r["value"].alias("value"), weigh(r["n"]).cast("double").alias("w"))), F.array().cast("array<struct<value:string,w:double>>"))


def inverse_frequency(df: Column, n: int) -> Column:
    return F.log1p((F.lit(n) - df + 0.5) / (df + 0.5))


def invert(key: str, segment: int, block: int):
    """Function of batches of rows (key, bag): blocks (segment, value, top, ids, weights). Rows are inverted together as soon as they have
    `segment` postings; all of a row's are in one segment. Rows come with their bags, as a posting each would cost several times as much to hand over."""

    def blocks_of(rows: pa.RecordBatch, number: int) -> pa.RecordBatch:
        bags = rows.column(1)
        values, w = bags.flatten().flatten()
        ids = rows.column(0).take(pa.array(np.repeat(np.arange(len(bags)), np.diff(bags.offsets.to_numpy()))))
        codes = values.dictionary_encode().indices.to_numpy()
        order = np.lexsort((-w.to_numpy(), codes))  # equal weights in the rows' order
        first = np.flatnonzero(np.diff(codes[order], prepend=-1))
        size = np.diff(np.append(first, len(order)))
        n = -(-size // block)
        begin = np.repeat(first, n) + block * (np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n))
        offsets, order, head = pa.array(np.append(begin, len(order)), pa.int32()), pa.array(order), pa.array(order[begin])
        lists = pa.ListArray.from_arrays(offsets, ids.take(order)), pa.ListArray.from_arrays(offsets, w.take(order))
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(begin), number)), values.take(head), w.take(head), *lists], ["segment", "value", "top", "ids", "weights"])

    def run(batches):
        number, held, n = TaskContext.get().partitionId() << 32, [], 0
        for batch in batches:
            sizes = np.diff(batch.column(1).offsets.to_numpy())
            begin = 0
            for at in range(len(sizes)):
                n += int(sizes[at])
                if n >= segment:
                    yield blocks_of(pa.Table.from_batches([*held, batch.slice(begin, at + 1 - begin)]).combine_chunks().to_batches()[0], number)
                    number, held, n, begin = number + 1, [], 0, at + 1
            held += [batch.slice(begin)] if begin < len(sizes) else []
        if n:
            yield blocks_of(pa.Table.from_batches(held).combine_chunks().to_batches()[0], number)

    return run


def sum_segment(key: str, k: int):
    """Function of a segment's blocks (ids, weights, asked: query_id, weight, bound and left of the queries that open it): query_id, key, score,
    bound, left of the rows that may still be among the k best. All postings of a row that a query opens are here, so its sum is whole."""

    def run(blocks: pa.Table) -> pa.Table:
        ids, w, asked = (blocks.column(c).combine_chunks() for c in ("ids", "weights", "asked"))
        begin, number = ids.offsets.to_numpy(), ids.flatten().dictionary_encode()
        begin, rows, w = begin - begin[0], number.indices.to_numpy(), w.flatten().to_numpy()
        at = np.repeat(np.arange(len(asked)), np.diff(asked.offsets.to_numpy()))
        pairs = asked.flatten()
        queries = pairs.field("query_id").dictionary_encode()
        q, weight, bound, left = queries.indices.to_numpy(), *(pairs.field(c).to_numpy() for c in ("weight", "bound", "left"))
        order = np.argsort(q, kind="stable")
        first = np.append(np.flatnonzero(np.diff(q[order], prepend=-1)), len(q))
        out = [[np.zeros(0, np.int64)] * 2 + [np.zeros(0)] * 3]
        for a, z in zip(first[:-1], first[1:]):
            own = order[a:z]
            size = begin[at[own] + 1] - begin[at[own]]
            place = np.arange(size.sum()) + np.repeat(begin[at[own]] - np.cumsum(size) + size, size)
            score = np.bincount(rows[place], w[place] * np.repeat(weight[own], size), len(number.dictionary))
            met = np.zeros(len(score), bool)
            met[rows[place]] = True
            met = np.flatnonzero(met)
            lower, lack = bound[own[0]], left[own[0]]
            if len(met) >= k:
                lower = max(lower, np.partition(score[met], len(met) - k)[len(met) - k] * MARGIN)
            met = met[score[met] + lack >= lower]
            out.append([np.full(len(met), q[own[0]]), met, score[met], np.full(len(met), bound[own[0]]), np.full(len(met), lack)])
        q, met, *numbers = (np.concatenate(x) for x in zip(*out))
        return pa.table([queries.dictionary.take(pa.array(q)), number.dictionary.take(pa.array(met)), *map(pa.array, numbers)], names=["query_id", key, "score", "bound", "left"])

    return run


class SparseIndex:
    """Weighted bags of values, inverted in segments of rows.

    `blocks`: in each segment, for each value its postings from the heaviest down, BLOCK at a time, with the largest weight of each. `terms`: how many
    rows have a value, its largest weight and the block that has it. `bags`: the rows themselves, a collection bucketed by id.

    A search takes, for each query, (1) the heaviest block of each of its values, and the k-th best of the sums found there as a bound
    that the k best reach; (2) of the values in order of what they can add, leaves out the first ones that cannot reach a fifth of the bound
    together, and of the others only blocks that can reach it with all that the other values may add; (3) sums what those
    blocks give to each row, segment by segment, takes the k-th best of a segment's sums and then of all as the bound if it is higher, and keeps rows
    that reach it with all that the values left out may add; (4) sums up those few from their bags. A row among the k best passes each step, so the
    result is exact; rows without a common value are not found.

    A segment has about SEGMENT postings and is inverted where its rows are, so that postings are not moved when the index is built; a block is moved
    once for all queries of a block of them, not for each; and a value that a third of all rows have is many blocks in many tasks.
    """

    def __init__(self, spark: SparkSession, path: str, key: str = "id"):
        self.spark, self.path, self.key = spark, path.rstrip("/"), key

    def build(self, bags: DataFrame) -> None:
        """bags: key and bag, an array of (value, w > 0) with distinct values. Rows without a bag count, and are never found."""
        bags = bags.select(self.key, "bag")
        store = Collection(self.spark, self.path, "bags", self.key, buckets=max(8, -(-bags.count() // BUCKET_ROWS)))
        store.add(bags)
        rows, key = store.read(), self.key
        kind, value = dict(rows.dtypes)[key], rows.select(F.explode("bag").alias("x")).select("x.value").dtypes[0][1]
        made = rows.where(F.size("bag") > 0).select(key, "bag").mapInArrow(invert(key, SEGMENT, BLOCK), f"segment long, value {value}, top double, ids array<{kind}>, weights array<double>")
        made.withColumn("block", F.monotonically_increasing_id()).write.mode("overwrite").parquet(f"{self.path}/blocks")
        blocks = self.spark.read.parquet(f"{self.path}/blocks")
        terms = blocks.groupBy("value").agg(F.sum(F.size("ids")).alias("df"), F.max("top").alias("most"), F.max_by("block", "top").alias("first"))
        terms.write.mode("overwrite").parquet(f"{self.path}/terms")

    def _table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/{name}")

    def _known(self, queries: DataFrame, k: int, frequency=None) -> DataFrame:
        """Values of each query: query_id, value, weight, up (what it can add), below (what it and the lesser ones can add together), total,
        bound, left (what the values left out can add)."""
        store = Collection(self.spark, self.path, "bags", self.key)
        factor = frequency(F.col("df"), store.count()) if frequency else F.lit(1.0)
        asked = queries.select("query_id", F.explode("bag").alias("x")).select("query_id", "x.value", "x.w")
        known = asked.join(self._table("terms"), "value").select("query_id", "value", (F.col("w") * factor).alias("weight"), "most", "first")
        known = known.withColumn("up", F.col("weight") * F.col("most"))
        order = Window.partitionBy("query_id")
        known = known.withColumn("below", F.sum("up").over(order.orderBy("up", "value"))).withColumn("total", F.sum("up").over(order))
        known = materialize(known, "asked-values")  # so that joins with it know its size
        first = known.join(self._table("blocks").drop("value", "top"), F.col("first") == F.col("block"))
        partial = self._sums(first, ["query_id"])
        kth = partial.withColumn("r", F.row_number().over(order.orderBy(F.desc("score"), self.key))).where(F.col("r") == k)
        known = known.drop("first").join(kth.select("query_id", (F.col("score") * MARGIN).alias("bound")), "query_id", "left").withColumn("bound", F.coalesce("bound", F.lit(0.0)))
        left_out = F.max(F.when(F.col("below") < F.col("bound") * LEFT_OUT, F.col("below"))).over(order)
        return materialize(known.withColumn("left", F.coalesce(left_out, F.lit(0.0))), "known-values")

    def _opened(self, known: DataFrame, blocks_of_queries: int) -> DataFrame:
        """Blocks that a search opens: segment, q (block of queries), ids, weights, asked (query_id, weight, bound and left of those that open it)."""
        each = known.where(F.col("below") >= F.col("bound") * LEFT_OUT).withColumn("q", F.pmod(F.xxhash64("query_id"), F.lit(blocks_of_queries)))
        each = each.groupBy("value", "q").agg(F.collect_list(F.struct("query_id", "weight", "bound", "left", (F.col("total") - F.col("up")).alias("others"))).alias("asked"))
        asked = F.filter("asked", lambda x: x["weight"] * F.col("top") + x["others"] >= x["bound"])
        opened = self._table("blocks").join(materialize(each, "asked-blocks"), "value").withColumn("asked", asked)
        return opened.where(F.size("asked") > 0).select("segment", "q", "ids", "weights", "asked")

    def live_blocks(self, queries: DataFrame, k: int, frequency=None) -> tuple[DataFrame, DataFrame]:
        """Values of each query (`_known`), and the blocks that a search opens for each (query_id, weight, bound, left, ids, weights)."""
        known = self._known(queries, k, frequency)
        live = self._opened(known, 1).select("ids", "weights", F.explode("asked").alias("x"))
        return known, live.select("x.query_id", "x.weight", "x.bound", "x.left", "ids", "weights")

    def _sums(self, blocks: DataFrame, groups: list[str]) -> DataFrame:
        each = blocks.select(*groups, "weight", F.explode(F.arrays_zip("ids", "weights")).alias("p"))
        return each.groupBy(*groups, F.col("p.ids").alias(self.key)).agg(F.sum(F.col("weight") * F.col("p.weights")).alias("score"))

    def search(self, queries: DataFrame, k: int, frequency=None) -> DataFrame:
        """query_id, key, score and rank of the k best rows of each query (query_id, bag), ties to the smaller key. frequency: weight of a
        value by the number of rows that have it and the number of all."""
        known = self._known(queries, k, frequency)
        opened = self._opened(known, max(1, -(-queries.count() // QUERY_BLOCK)))
        kinds = dict(known.dtypes)["query_id"], dict(opened.select(F.explode("ids").alias("i")).dtypes)["i"]
        sums = opened.groupBy("segment", "q").applyInArrow(sum_segment(self.key, k), f"query_id {kinds[0]}, `{self.key}` {kinds[1]}, score double, bound double, left double")
        found = materialize(sums, "partial-scores")
        best = Window.partitionBy("query_id").orderBy(F.desc("score"), self.key)
        kth = found.withColumn("r", F.row_number().over(best)).where(F.col("r") <= k).groupBy("query_id").agg(F.min("score").alias("least"), F.count(F.lit(1)).alias("n")).where(F.col("n") == k)
        found = found.join(kth.select("query_id", (F.col("least") * MARGIN).alias("least")), "query_id", "left")
        few = found.where(F.col("score") + F.col("left") >= F.greatest("bound", F.coalesce("least", F.lit(0.0)))).select("query_id", self.key)
        bags = Collection(self.spark, self.path, "bags", self.key).read()
        weights = known.groupBy("query_id").agg(F.map_from_entries(F.collect_list(F.struct("value", "weight"))).alias("_weights"))  # a query's own words
        score = F.aggregate("bag", F.lit(0.0), lambda a, x: a + x["w"] * F.coalesce(F.try_element_at("_weights", x["value"]), F.lit(0.0)))
        scored = few.join(bags, self.key).join(weights, "query_id").select("query_id", self.key, F.round(score, 9).alias("score"))
        rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), self.key))
        return scored.withColumn("rank", rank).where(F.col("rank") <= k)


def bm25_search(index: SparseIndex, queries: DataFrame, question: str, k: int) -> DataFrame:
    """The k best rows for each question (query_id and its text), by words, their rarity and lengths."""
    return index.search(queries.select("query_id", bag_of(runs(word_tokens(F.col(question)))).alias("bag")), k, inverse_frequency)
