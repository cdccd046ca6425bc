"""Token ids of documents in binary shards: one zstandard frame per document, one shared dictionary.

File format. A store is a folder with two Parquet tables written by Spark's committing writer:

* `dictionary`: one row, the zstandard dictionary (empty if none could be trained) and its SHA-256;
* `blocks`: one row per block of about `block_bytes` compressed bytes of one shard, documents ascending:
  shard, block, first_doc_id, last_doc_id, n_docs, first_token (ids before the block in its shard), n_tokens,
  dict_sha256, width (bytes of an id: 2 or 4), doc_ids (int64), ends (int64: the offset index, where each frame
  ends in the payload), payload (the frames in a row). All integers are little-endian.

A document is read by its block (first_doc_id and last_doc_id are Parquet statistics), its place in doc_ids and
its two offsets; no other frame is touched. Shards hold ascending ranges of doc_id, so the store is in doc_id order.

The dictionary is trained on a bounded sample (`sample_docs` documents, about those with the smallest hash of
doc_id; of each a span of `sample_ids` ids at a hashed place), a parameter of compression alone; every document is encoded
whole. An id too large for `width` raises.

Nulls: a null text is the empty text (just the end id); a null doc_id sorts first. Equal doc_ids are ordered by text, and
repeated rows are stored as often as they occur. A very long text is one frame in a block of its own size. An empty table
gives an empty store. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusflow.llm.common import bounded_sample, read_table, shared_dir, text_of
from corpusflow.llm.wordcodec import library_codec

BLOCKS = (
    "shard int, block int, first_doc_id long, last_doc_id long, n_docs int, first_token long, n_tokens long, "
    "dict_sha256 string, width int, doc_ids binary, ends binary, payload binary"
)

_ARROW = {"int": pa.int32(), "long": pa.int64(), "string": pa.string(), "binary": pa.binary()}


def _serialized(ids: bytes, width: int) -> bytes:
    """Ids in 2 or 4 bytes each; an id that does not fit raises."""
    if width == 4:
        return ids
    own = np.frombuffer(ids, "<u4")
    if len(own) and own.max() > 0xFFFF:
        raise ValueError(f"id {own.max()} needs width 4")
    return own.astype("<u2").tobytes()


def train_dictionary(docs: DataFrame, tokenizer: str, end_id: int, width: int, sample_docs: int, sample_ids: int, dict_bytes: int) -> bytes:
    """A zstandard dictionary from the serialized ids of the sample; empty where the sample is too small for one.

    Sampled documents are encoded whole in tasks; of each a span of at most `sample_ids` ids, at a place that follows from
    its hash, comes to the driver. So at most twice sample_docs * sample_ids ids do, whatever the texts.
    """
    import zstandard

    def spans(batches):
        codec, end = library_codec(tokenizer), np.array([end_id], "<u4").tobytes()
        for batch in batches:
            out = []
            for text in text_of(batch.column(0)):
                ids = codec.encode(text) + end
                room = len(ids) // 4 - sample_ids
                at = 4 * (zlib.crc32(ids) % (room + 1)) if room > 0 else 0
                out.append(_serialized(ids[at : at + 4 * sample_ids], width))
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["ids"])

    picked = bounded_sample(docs.select("doc_id", "text"), sample_docs, "doc_id")
    samples = [bytes(r["ids"]) for r in picked.select("text").mapInArrow(spans, "ids binary").collect()]  # at most twice sample_docs rows
    try:
        return zstandard.train_dictionary(min(dict_bytes, sum(map(len, samples)) // 8), samples).as_bytes()
    except (zstandard.ZstdError, ValueError):
        return b""


def write_store(
    docs: DataFrame,
    path: str,
    tokenizer: str = "word_bpe_49k.json",
    end_id: int = 1,
    shards: int | None = None,
    width: int = 2,
    level: int = 3,
    block_bytes: int = 4 << 20,
    sample_docs: int = 1000,
    sample_ids: int = 2000,
    dict_bytes: int = 64 << 10,
) -> None:
    """Encode, compress and write every document, in ascending doc_id order. width 2 needs ids below 65,536."""
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    trained = train_dictionary(docs, tokenizer, end_id, width, sample_docs, sample_ids, dict_bytes)
    digest = hashlib.sha256(trained).hexdigest()
    spark.createDataFrame([(trained, digest)], "dictionary binary, dict_sha256 string").coalesce(1).write.parquet(f"{path}/dictionary")
    shards = shards or max(spark.sparkContext.defaultParallelism, docs.rdd.getNumPartitions()) * 2
    # ranges of doc_id from Spark's sample of the keys; a partition is a shard, and equal ids share one
    dealt = docs.repartitionByRange(shards, "doc_id").sortWithinPartitions("doc_id", "text")
    fields = BLOCKS.split(", ")

    def blocks(batches):
        import zstandard

        codec, end = library_codec(tokenizer), np.array([end_id], "<u4").tobytes()
        options = {"dict_data": zstandard.ZstdCompressionDict(trained)} if trained else {}
        press = zstandard.ZstdCompressor(level=level, **options)
        at, block, done, tokens, ids, ends, payload = TaskContext.get().partitionId(), 0, 0, 0, [], [], []

        def flush():
            known = [i for i in ids if i is not None]
            row = (at, block, min(known, default=None), max(known, default=None), len(ids), done, tokens, digest, width)
            row += (np.array([i if i is not None else np.iinfo("<i8").min for i in ids], "<i8").tobytes(), np.array(ends, "<i8").tobytes(), b"".join(payload))
            return pa.RecordBatch.from_arrays([pa.array([v], _ARROW[f.split()[1]]) for v, f in zip(row, fields)], [f.split()[0] for f in fields])

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), text_of(batch.column(1))):
                if ids and ends[-1] >= block_bytes:
                    yield flush()
                    block, done = block + 1, done + tokens
                    tokens, ids, ends, payload = 0, [], [], []
                raw = codec.encode(text) + end
                frame = press.compress(_serialized(raw, width))
                tokens += len(raw) // 4
                ids.append(doc_id)
                payload.append(frame)
                ends.append((ends[-1] if ends else 0) + len(frame))
        if ids:
            yield flush()

    dealt.mapInArrow(blocks, BLOCKS).write.parquet(f"{path}/blocks")


def read_store(spark: SparkSession, path: str, with_ids: bool = False) -> DataFrame:
    """One row per stored document: doc_id, start, n_tokens, ids_crc32[, ids as little-endian 32-bit integers]."""
    kept = spark.read.parquet(f"{path}/dictionary").first()
    trained, digest = bytes(kept["dictionary"]), kept["dict_sha256"]
    table = spark.read.schema(BLOCKS).parquet(f"{path}/blocks")
    totals = table.groupBy("shard").agg(F.sum("n_tokens").alias("n"))
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)  # one row per shard
    bases = totals.select("shard", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    placed = table.join(bases, "shard").select((F.col("base") + F.col("first_token")).alias("first_token"), "dict_sha256", "width", "doc_ids", "ends", "payload")
    names = ["doc_id", "start", "n_tokens", "ids_crc32"] + ["ids"] * with_ids

    def unpack(batches):
        import zstandard

        options = {"dict_data": zstandard.ZstdCompressionDict(trained)} if trained else {}
        press = zstandard.ZstdDecompressor(**options)
        for batch in batches:
            for row in batch.to_pylist():
                if row["dict_sha256"] != digest:
                    raise ValueError("the block was written with another dictionary")
                doc_ids, ends, start = np.frombuffer(row["doc_ids"], "<i8").tolist(), np.frombuffer(row["ends"], "<i8").tolist(), row["first_token"]
                rows = []
                for doc_id, lo, hi in zip(doc_ids, [0, *ends], ends):
                    raw = press.decompress(row["payload"][lo:hi])
                    ids = np.frombuffer(raw, f"<u{row['width']}").astype("<u4").tobytes()
                    rows.append((doc_id if doc_id != np.iinfo("<i8").min else None, start, len(ids) // 4, zlib.crc32(ids), ids)[: len(names)])
                    start += len(ids) // 4
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), [pa.int64()] * 4 + [pa.binary()])], names)

    return placed.mapInArrow(unpack, "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids binary" * with_ids)


def read_document(spark: SparkSession, path: str, doc_id: int) -> list[int] | None:
    """The ids of one document through the offset index: one block is read, one frame decompressed."""
    import zstandard

    row = spark.read.schema(BLOCKS).parquet(f"{path}/blocks").where((F.col("first_doc_id") <= doc_id) & (F.col("last_doc_id") >= doc_id)).first()
    if row is None:
        return None
    at = np.flatnonzero(np.frombuffer(row["doc_ids"], "<i8") == doc_id)
    if not len(at):
        return None
    trained = bytes(spark.read.parquet(f"{path}/dictionary").first()["dictionary"])
    ends = [0, *np.frombuffer(row["ends"], "<i8").tolist()]
    options = {"dict_data": zstandard.ZstdCompressionDict(trained)} if trained else {}
    raw = zstandard.ZstdDecompressor(**options).decompress(bytes(row["payload"])[ends[at[0]] : ends[at[0] + 1]])
    return np.frombuffer(raw, f"<u{row['width']}").tolist()


def op6_token_id_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Write all documents as binary shards in the shared folder, then read the result back from them."""
    path = f"{shared_dir(spark)}/token-files-{uuid.uuid4().hex}"
    write_store(read_table(spark, sf_dir, "documents"), path)
    return read_store(spark, path)
