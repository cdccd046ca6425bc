"""Draws the documents most like a target by importance resampling with Gumbel noise, without replacement.

1. Features. Words (runs of digits, letters a-z and anything beyond ASCII, A-Z lower-cased) and runs of up to `longest` of them fall
   into `buckets` by their crc32. Each document's buckets are written as one array, so that texts are read once.
2. Weights. Tasks count buckets with array operations; the sums over all documents and over the target give each bucket a gain.
   A document's weight is the sum of gains at its buckets, its score adds noise from a hash of its doc_id.
3. Selection by weighted median of medians. Keys (score descending, doc_id, number of the row) are distinct. In each round
   every partition sends the median of its remaining keys and how many remain; the median of those, weighted by
   the numbers, is the pivot: at least a quarter of the remaining keys lie on either side of it. One pass counts the keys up to it, and the
   side without the wanted rank is discarded; this goes on until the pivot is the last drawn key itself. Remaining keys are written anew
   whenever less than a quarter of the last writing remains.
4. Drawn documents are sorted by range, and numbered within partitions behind the sizes of those before. The others pass by.

The driver holds one median per partition of the remaining keys, the gains (fixed size) and nothing of the documents.

Nulls: a null text has no features; a null doc_id takes its noise from the empty id and loses every tie. Very long
texts are whole rows; texts without words have weight 0 and are not drawn. Repeated rows have equal scores and take a rank each. An
empty table gives no rows, and an empty target has gains like any other. Columns other than doc_id and text are not read, whatever
their names.
"""

from __future__ import annotations

import hashlib
import math
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusflow.llm.common import forget, materialize, read_table, slices, text_of


@dataclass(frozen=True)
class Draw:
    longest: int = 1
    buckets: int = 10_000
    least_words: int = 20
    percent: int = 10
    seed: str = "2024"
    slice_chars: int = 1 << 20


_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_INNER = np.zeros(256, bool)
_INNER[[*range(48, 58), *range(97, 123), *range(128, 256)]] = True
#: Words beyond that many bytes are hashed one by one.
LONG = 64


def _crc_table() -> np.ndarray:
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, (table >> 1) ^ np.uint32(0xEDB88320), table >> 1)
    return table


_CRC = _crc_table()


def crc32_of(data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Unsigned crc32 of the bytes of each range, byte place by byte place over all ranges at once."""
    size, state = end - begin, np.full(len(begin), 0xFFFFFFFF, np.uint32)
    alive = np.flatnonzero(size <= LONG)
    for k in range(LONG):
        alive = alive[size[alive] > k]
        if not len(alive):
            break
        s = state[alive]
        state[alive] = _CRC[(s ^ data[begin[alive] + k]) & 0xFF] ^ (s >> np.uint32(8))
    out = ~state
    for i in np.flatnonzero(size > LONG).tolist():
        out[i] = zlib.crc32(data[begin[i] : end[i]].tobytes())
    return out


def feature_buckets(texts: list[str], d: Draw) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Buckets of the features of all texts, text by text, where each text's begin (one more than texts), and its number of words."""
    encoded = [t.encode() for t in texts]
    # every text ends in a byte that is no word's
    data = np.append(_LOWER[np.frombuffer(b" ".join(encoded), np.uint8)], np.uint8(32))
    edges = np.concatenate([[0], np.cumsum([len(e) + 1 for e in encoded])])
    change = np.flatnonzero(np.diff(np.concatenate([[False], _INNER[data]]).astype(np.int8)))
    begin, end = change[0::2], change[1::2]
    first = np.searchsorted(begin, edges)
    n_words = np.diff(first)
    found = [(np.arange(len(begin)), crc32_of(data, begin, end) % d.buckets)]
    for k in range(2, d.longest + 1):
        # runs of k words, joined by one space, are written down and hashed in the same way
        at = np.concatenate([np.arange(a, max(a, z - k + 1)) for a, z in zip(first[:-1].tolist(), first[1:].tolist())] or [np.zeros(0, np.int64)]).astype(np.int64)
        joined = [b" ".join(data[begin[i + j] : end[i + j]].tobytes() for j in range(k)) for i in at.tolist()]
        stop = np.cumsum([len(x) for x in joined]).astype(np.int64)
        found.append((at, crc32_of(np.frombuffer(b"".join(joined), np.uint8), stop - [len(x) for x in joined], stop) % d.buckets))
    at, bucket = (np.concatenate(x) for x in zip(*found))
    order = np.argsort(at, kind="stable")
    return bucket[order], np.searchsorted(at[order], first), n_words


def features(docs: DataFrame, d: Draw) -> DataFrame:
    """doc_id, n_words, n_features and buckets (array of 32-bit numbers) of each row."""

    def run(batches):
        for batch in batches:
            texts = text_of(batch.column(1))
            for lo, hi in slices(len(texts), np.array([len(t) + 1 for t in texts]), d.slice_chars):
                bucket, starts, n_words = feature_buckets(texts[lo:hi], d)
                bucket, cut = bucket.astype("<u4"), list(zip(starts[:-1].tolist(), starts[1:].tolist()))
                yield pa.RecordBatch.from_arrays([batch.column(0)[lo:hi], pa.array(n_words, pa.int64()), pa.array(np.diff(starts), pa.int64()), pa.array([bucket[a:z].tobytes() for a, z in cut], pa.binary())], ["doc_id", "n_words", "n_features", "buckets"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, n_words long, n_features long, buckets binary")


def bucket_counts(found: DataFrame, d: Draw) -> np.ndarray:
    """Features in each bucket; each task sends one count for each of its buckets."""

    def run(batches):
        count = np.zeros(d.buckets, np.int64)
        for batch in batches:
            for x in batch.column(0):
                count += np.bincount(np.frombuffer(x.as_buffer(), "<u4"), minlength=d.buckets)
        at = np.flatnonzero(count)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(count[at], pa.int64())], ["bucket", "n"])

    out = np.zeros(d.buckets, np.int64)
    for bucket, n in found.select("buckets").mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n")).collect():  # `buckets` rows at most
        out[bucket] = n
    return out


def gains_of(docs: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Gain of each bucket, in thousandths, rounded down."""
    n, S, T = len(docs), float(docs.sum()), float(target.sum())
    return np.array([math.floor(1000 * math.log((t + 1.0) * (S + n) / ((s + 1.0) * (T + n)))) for s, t in zip(docs.tolist(), target.tolist())], np.int64)


def noise_of(doc_id: int | None, d: Draw) -> int:
    h = int(hashlib.sha256(f"{d.seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def scored(found: DataFrame, gains: np.ndarray, d: Draw) -> DataFrame:
    """doc_id, n_words, n_features, weight and score of each row of features."""

    def run(batches):
        for batch in batches:
            sums = [int(gains[np.frombuffer(x.as_buffer(), "<u4")].sum()) for x in batch.column(3)]
            noise = [noise_of(x, d) for x in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(3)), pa.array(sums, pa.int64()), pa.array([w + e for w, e in zip(sums, noise)], pa.int64())], ["doc_id", "n_words", "n_features", "weight", "score"])

    return found.select("doc_id", "n_words", "n_features", "buckets").mapInArrow(run, "doc_id long, n_words long, n_features long, weight long, score long")


#: Sorts behind every doc_id.
LAST_ID = 2**63 - 1


def partition_medians(keys: DataFrame) -> list[tuple]:
    """(score, id, number, n): the median key of every partition and its number of keys."""

    def run(batches):
        parts = [[c.to_numpy() for c in batch.columns] for batch in batches if batch.num_rows]
        if parts:
            score, own, number = (np.concatenate(x) for x in zip(*parts))
            middle = np.lexsort((number, own, -score))[(len(score) - 1) // 2]
            yield pa.RecordBatch.from_arrays([pa.array([int(x)], pa.int64()) for x in (score[middle], own[middle], number[middle], len(score))], ["score", "id", "number", "n"])

    return [tuple(r) for r in keys.select("score", "id", "number").mapInArrow(run, "score long, id long, number long, n long").collect()]


def weighted_median(medians: list[tuple]) -> tuple[int, int, int]:
    """The key up to which at least half of all weight lies, in the order of keys."""
    medians = sorted(medians, key=lambda m: (-m[0], m[1], m[2]))
    half, seen = sum(m[3] for m in medians) / 2, 0
    for *key, n in medians:
        seen += n
        if seen >= half:
            break
    return tuple(key)


def up_to(key: tuple[int, int, int]) -> Column:
    """Rows whose key is `key` or stands before it."""
    score, own, number = (F.lit(x).cast("long") for x in key)
    return (F.col("score") > score) | ((F.col("score") == score) & ((F.col("id") < own) | ((F.col("id") == own) & (F.col("number") <= number))))


def cutoff_key(keys: DataFrame, rank: int) -> tuple[int, int, int]:
    """The key of that rank (from 1) among distinct keys (score, id, number); rank is at most their number."""
    written, remaining, at = None, keys, keys.count()
    stored = at
    while True:
        pivot = weighted_median(partition_medians(remaining))
        n = remaining.where(up_to(pivot)).count()
        if n == rank:
            if written is not None:
                forget(written)
            return pivot
        side = up_to(pivot) if n > rank else ~up_to(pivot)
        # a pivot beyond the rank is not itself the cutoff, so it goes as well
        remaining = remaining.where(side if n < rank else side & ~((F.col("score") == pivot[0]) & (F.col("id") == pivot[1]) & (F.col("number") == pivot[2])))
        at, rank = (n - 1, rank) if n > rank else (at - n, rank - n)
        if 4 * at < stored:
            before, written, stored = written, materialize(remaining, "remaining-keys"), at
            remaining = written
            if before is not None:
                forget(before)


def _ranked(drawn: DataFrame) -> DataFrame:
    """The drawn rows with their rank from 1 in the order of keys."""
    in_order = drawn.repartitionByRange(F.col("score").desc(), "id", "number").sortWithinPartitions(F.col("score").desc(), "id", "number")
    placed = materialize(in_order.withColumn("place", F.monotonically_increasing_id()), "drawn")
    part = F.shiftright("place", 33)
    sizes = sorted(tuple(r) for r in placed.groupBy(part.alias("part")).count().collect())  # one row a partition
    ends = np.cumsum([n for _, n in sizes]).tolist()
    offsets = drawn.sparkSession.createDataFrame([(p, e - n) for (p, n), e in zip(sizes, ends)], "part long, offset long")
    return placed.join(F.broadcast(offsets), part == F.col("part")).withColumn("rank", F.col("offset") + F.col("place").bitwiseAND((1 << 33) - 1) + 1)


def importance_resample(docs: DataFrame, target: DataFrame, d: Draw = Draw()) -> DataFrame:
    """One row per row of docs: doc_id, n_words, n_features, weight, score and rank (null if not drawn). target: text."""
    spark = docs.sparkSession
    found = materialize(features(docs, d), "features")
    wanted = features(target.select(F.lit(None).cast("long").alias("doc_id"), "text"), d)
    gains = gains_of(bucket_counts(found, d), bucket_counts(wanted, d))
    rows = materialize(scored(found, gains, d).withColumns({"number": F.monotonically_increasing_id(), "id": F.coalesce("doc_id", F.lit(LAST_ID))}), "scores")
    forget(found)
    names = ["doc_id", "n_words", "n_features", "weight", "score"]
    eligible = rows.where(F.col("n_words") >= d.least_words)
    rank = d.percent * eligible.count() // 100
    if not rank:
        return rows.select(*names, F.lit(None).cast("long").alias("rank"))
    cutoff = up_to(cutoff_key(eligible.select("score", "id", "number"), rank))
    drawn = (F.col("n_words") >= d.least_words) & cutoff
    others = rows.where(~drawn).select(*names, F.lit(None).cast("long").alias("rank"))
    return _ranked(rows.where(drawn)).select(*names, "rank").unionByName(others)


def op13_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = importance_resample(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "n_features", "weight", "score", "rank")
