"""How five filters act on each other, from a sparse document-term matrix.

1. Shards. Each task cuts its documents into shards of about `shard_chars` characters (a longer document is one alone). A
   shard is a matrix in compressed sparse row form, one row a document: row starts, the words of each row by their number in the
   shard's own word list, and how often each occurs. The list is in order of hash parts, and each part of it goes to the part of
   the dictionary that it belongs to.
2. Dictionary. Every part numbers its distinct words; a word's code is made of its number and its part, so that codes of all parts
   differ. The parts send each shard the codes of its words, as one array, and every shard takes them for its own numbers.
3. The sums of a row are its words and its nonzero entries its distinct words; they decide filters A and B. The
   flags that need the characters (C, D) and a digest of the text are taken where the shard is made.
4. E: the smallest doc_id of each text met more than once, by grouped minima. Labels join by doc_id. Then documents are counts by
   part and set of filters failed, at most 32 a part, and every order and step is a product of those with a fixed matrix.

A failing document: A under 50 words; B 100 * distinct words < 65 * words; C 100 * [A-Z] > 5 * code points; D holds one of
#$%&*|; E identical to the text of a smaller doc_id. Nulls: a null text is the empty one and a null source the part ''; rows
without a doc_id are never identical to a smaller one and have no label, nor do they count as the smaller one. Rows that repeat
a doc_id are documents each; several labels of one doc_id count as one that says what any of them says. Very long texts are whole rows. An
empty table gives no rows. Columns other than doc_id, source and text are not read, whatever their names.
"""

from __future__ import annotations

import hashlib
from itertools import permutations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusflow.llm.common import forget, materialize, read_table, slices, text_of
from corpusflow.llm.wordhash import words_of

FILTERS = "ABCDE"
MIN_WORDS, MIN_DISTINCT, MAX_CAPITALS, SYMBOLS = 50, 65, 5, "#$%&*|"
SHARD = "shard long, doc_ids array<long>, parts array<string>, shown array<int>, digests array<binary>, starts binary, words binary, counts binary, lists array<binary>"
#: More texts than that with copies are joined by hash.
BROADCAST_TEXTS = 500_000


def _in(chars: str) -> np.ndarray:
    table = np.zeros(256, np.int64)
    table[list(chars.encode())] = 1
    return table


_CAPITAL, _SYMBOL = _in("ABCDEFGHIJKLMNOPQRSTUVWXYZ"), _in(SYMBOLS)


def pack(numbers: np.ndarray) -> bytes:
    """32-bit numbers, their bytes ordered by place (the high ones are mostly zero) and compressed."""
    return zstandard.ZstdCompressor(level=1).compress(numbers.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes())


def unpack(blob: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), np.uint8).reshape(4, -1).T).view("<u4").ravel()


def document_term_shards(docs: DataFrame, parts: int, shard_chars: int = 1 << 20) -> DataFrame:
    """Shards in compressed sparse row form over their own word lists, with the documents' ids, parts, flags C and D (bits 4 and 8)
    and digests beside. starts, words (each row's ascending numbers, as steps) and counts are packed; lists are the shard's words
    by part of the dictionary, apart by spaces and compressed."""

    def run(batches):
        from pyspark import TaskContext

        shard, zip_ = TaskContext.get().partitionId() << 32, zstandard.ZstdCompressor(level=1)
        for batch in batches:
            sizes = pc.fill_null(pc.binary_length(batch.column(2)), 0).to_numpy(zero_copy_only=False)
            for lo, hi in slices(batch.num_rows, sizes + 1, shard_chars):
                ids, sources, column = (batch.column(i).slice(lo, hi - lo) for i in range(3))
                texts = text_of(column)
                words = words_of(texts)
                edges = np.concatenate([[0], np.cumsum(sizes[lo:hi])]).astype(np.int64)
                each = lambda marks: np.diff(np.concatenate([[0], np.cumsum(marks)])[edges])
                capitals = 100 * each(_CAPITAL[words.data]) > MAX_CAPITALS * each((words.data & 0xC0) != 0x80)
                shown = 4 * capitals + 8 * (each(_SYMBOL[words.data]) > 0)
                known, first, number = np.unique(words.hashes, return_index=True, return_inverse=True)
                part = ((known >> np.uint64(33)) % np.uint64(parts)).astype(np.int64)
                order = np.argsort(part, kind="stable")
                place = np.empty(len(known), np.int64)
                place[order] = np.arange(len(known))
                width = max(1, len(known))
                cells, counts = np.unique(np.repeat(np.arange(hi - lo), np.diff(words.first)) * width + place[number], return_counts=True)
                starts = np.searchsorted(cells, np.arange(hi - lo + 1) * width)
                steps = np.diff(cells % width, prepend=0)
                at = starts[:-1][starts[:-1] < len(cells)]
                steps[at] = cells[at] % width
                begin, end = words.begin[first[order]].tolist(), words.end[first[order]].tolist()
                spelled, cut = [words.data[a:z].tobytes() for a, z in zip(begin, end)], np.searchsorted(part[order], np.arange(parts + 1)).tolist()
                lists = [zip_.compress(b" ".join(spelled[a:z])) if z > a else None for a, z in zip(cut[:-1], cut[1:])]
                digests = [hashlib.blake2b(t.encode(), digest_size=16).digest() for t in texts]
                of = lambda x, kind: pa.array([x], pa.list_(kind))
                yield pa.RecordBatch.from_arrays([
                    pa.array([shard], pa.int64()), of(ids.to_pylist(), pa.int64()), of(sources.to_pylist(), pa.string()), of(shown.tolist(), pa.int32()),
                    of(digests, pa.binary()), *(pa.array([pack(x)], pa.binary()) for x in (starts, steps, counts)), of(lists, pa.binary()),
                ], [c.split()[0] for c in SHARD.split(", ")])
                shard += 1

    return docs.select(F.col("doc_id").cast("long"), F.coalesce(F.col("source").cast("string"), F.lit("")), F.col("text").cast("string")).mapInArrow(run, SHARD)


def _word_lists(shards: DataFrame) -> DataFrame:
    return shards.select("shard", F.posexplode("lists").alias("part", "words")).where("words is not null")


def _words(blobs: list[bytes]) -> tuple[pa.Array, np.ndarray]:
    """The words of compressed lists as one array, and the number of each list."""
    unzip = zstandard.ZstdDecompressor()
    lists = [unzip.decompress(x) + b" " for x in blobs]
    data = np.frombuffer(b"".join(lists), np.uint8)
    space = data == 32
    ends = np.flatnonzero(space)
    offsets = np.concatenate([[0], ends - np.arange(len(ends))]).astype(np.int32)
    words = pa.Array.from_buffers(pa.binary(), len(ends), [None, pa.py_buffer(offsets), pa.py_buffer(data[~space])])
    edges = np.concatenate([[0], np.cumsum([len(x) for x in lists])])
    return words, np.diff(np.searchsorted(ends, edges))


def dictionary_codes(shards: DataFrame, parts: int) -> DataFrame:
    """(shard, part, codes): the dictionary's codes of each list, in its order, packed. A part is one group: it numbers its distinct words,
    and the code of a word is number * parts + part."""

    def number(table: pa.Table) -> pa.Table:
        words, sizes = _words(table.column("words").to_pylist())
        coded = words.dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)
        ends = np.cumsum(sizes)
        return pa.table({"shard": table.column("shard"), "part": table.column("part"), "codes": pa.array([pack(coded[e - n : e]) for n, e in zip(sizes.tolist(), ends.tolist())], pa.binary())})

    return _word_lists(shards).groupBy("part").applyInArrow(number, "shard long, part int, codes binary")


def dictionary(shards: DataFrame, parts: int) -> DataFrame:
    """(word, code) of every word of all shards."""

    def spell(key: tuple, table: pa.Table) -> pa.Table:
        words = _words(table.column("words").to_pylist())[0].dictionary_encode().dictionary
        return pa.table({"word": words.cast(pa.string()), "code": pa.array(np.arange(len(words)) * parts + key[0].as_py(), pa.int64())})

    return _word_lists(shards).groupBy("part").applyInArrow(spell, "word string, code long")


def globally_encoded(shards: DataFrame, codes: DataFrame, parts: int) -> DataFrame:
    """One row per shard: doc_ids, parts, shown, digests, and its matrix over the dictionary: starts and counts as before, codes
    (array of 64-bit dictionary codes of its entries)."""
    names = ["shard", "doc_ids", "parts", "shown", "digests", "starts", "counts"]

    def encode(left: pa.Table, right: pa.Table) -> pa.Table:
        right = right.sort_by("part")
        of = [unpack(c).astype(np.int64) * parts + p for p, c in zip(right.column("part").to_pylist(), right.column("codes").to_pylist())]
        code = np.concatenate([*of, np.zeros(0, np.int64)])
        made = []
        for starts, steps in zip(left.column("starts").to_pylist(), left.column("words").to_pylist()):  # one
            starts, sums = unpack(starts).astype(np.int64), np.concatenate([[0], np.cumsum(unpack(steps).astype(np.int64))])
            local = sums[1:] - np.repeat(sums[starts[:-1]], np.diff(starts))
            made.append(code[local].astype("<i8").tobytes())
        return pa.table({**{c: left.column(c) for c in names}, "codes": pa.array(made, pa.binary())})

    types = {c.split()[0]: c for c in SHARD.split(", ")}
    schema = ", ".join([*(types[c] for c in names), "codes binary"])
    return shards.drop("lists").groupBy("shard").cogroup(codes.groupBy("shard")).applyInArrow(encode, schema)


def document_flags(matrix: DataFrame) -> DataFrame:
    """doc_id, part, digest and failed (bits 1, 2, 4, 8 for A to D) of every document, from the rows of the matrix."""

    def run(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                starts, counts = (unpack(batch.column(c)[k].as_py()).astype(np.int64) for c in ("starts", "counts"))
                sums, nonzero = np.diff(np.concatenate([[0], np.cumsum(counts)])[starts]), np.diff(starts)
                failed = (sums < MIN_WORDS) + 2 * (100 * nonzero < MIN_DISTINCT * sums) + np.array(batch.column("shown")[k].values)
                yield pa.RecordBatch.from_arrays([batch.column("doc_ids")[k].values, batch.column("parts")[k].values, batch.column("digests")[k].values, pa.array(failed, pa.int32())], ["doc_id", "part", "digest", "failed"])

    names = ["doc_ids", "parts", "shown", "digests", "starts", "counts"]
    return matrix.select(*names).mapInArrow(run, "doc_id long, part string, digest binary, failed int")


def _steps() -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
    """(order, step) in order; filter of each, and the filters before it and its own as sets of bits."""
    orders = ["".join(x) for x in permutations(FILTERS)]
    own = np.array([[FILTERS.index(f) for f in o] for o in orders])
    bits = 1 << own
    return orders, own.ravel(), (np.cumsum(bits, axis=1) - bits).ravel(), bits.ravel()


def interactions(counts: DataFrame) -> DataFrame:
    """counts: part and seen, a list of (failed, n, good, toxic) of its documents. One row per part, order and step."""
    names = ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]

    def run(batches):
        orders, own, before, bit = _steps()
        failed = np.arange(1 << len(FILTERS))
        hit, earlier = (failed & bit[:, None]) != 0, (failed & before[:, None]) != 0
        keep, lost, redundant, only = ~hit & ~earlier, hit & ~earlier, hit & earlier, failed == bit[:, None]
        order, step = np.repeat(orders, len(FILTERS)), np.tile(np.arange(1, len(FILTERS) + 1), len(orders))
        for batch in batches:
            for part, seen in zip(batch.column(0), batch.column(1)):
                n, good, toxic = np.zeros((3, len(failed)), np.int64)
                for x in seen.as_py():
                    n[x["failed"]], good[x["failed"]], toxic[x["failed"]] = x["n"], x["good"], x["toxic"]
                removed = lost @ n
                shapley = np.bincount(own, removed, len(FILTERS)).astype(np.int64)[own]
                numbers = [keep @ n, removed, redundant @ n, only @ n, lost @ good, lost @ toxic, shapley]
                yield pa.RecordBatch.from_arrays([pa.array([part.as_py()] * len(order), pa.string()), pa.array(order.tolist(), pa.string()), pa.array(step, pa.int32()), *(pa.array(x, pa.int64()) for x in numbers)], ["part", "filter_order", "step", *names])

    return counts.mapInArrow(run, "part string, filter_order string, step int, " + ", ".join(f"{c} long" for c in names))


def filter_audit(docs: DataFrame, labels: DataFrame, shard_chars: int = 1 << 20, part_bytes: int = 16 << 20) -> DataFrame:
    """Counts of every part, order of the five filters and step: kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley.

    The dictionary has a part for every part_bytes of text, whose words are held at once."""
    total = docs.agg(F.sum(F.octet_length(F.col("text").cast("string")))).first()[0] or 0
    parts = max(8, -(-total // part_bytes))
    shards = materialize(document_term_shards(docs, parts, shard_chars), "term-shards")
    matrix = globally_encoded(shards, dictionary_codes(shards, parts), parts)
    flags = materialize(document_flags(matrix), "filter-flags")
    forget(shards)
    texts = flags.groupBy("digest").agg(F.min("doc_id").alias("smallest"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    texts = materialize(texts, "texts-with-copies")
    flags = flags.join(F.broadcast(texts) if texts.count() <= BROADCAST_TEXTS else texts, "digest", "left")
    flags = flags.select("doc_id", "part", (F.col("failed") + F.when(F.col("doc_id") > F.col("smallest"), 16).otherwise(0)).alias("failed"))
    says = lambda c: F.max((F.col(c) == 1).cast("int")).alias(c)
    labels = labels.where("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(says("quality"), says("toxic"))
    known = flags.where("doc_id is not null").join(labels, "doc_id", "left").select("part", "failed", "quality", "toxic")
    others = flags.where("doc_id is null").select("part", "failed", F.lit(0).alias("quality"), F.lit(0).alias("toxic"))
    total = lambda c: F.sum(F.coalesce(c, F.lit(0)).cast("long"))
    counts = known.unionByName(others).groupBy("part", "failed").agg(F.count(F.lit(1)).alias("n"), total("quality").alias("good"), total("toxic").alias("toxic"))
    return interactions(counts.groupBy("part").agg(F.collect_list(F.struct("failed", "n", "good", "toxic")).alias("seen")))  # 32 at most


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))
