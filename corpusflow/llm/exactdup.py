"""Exact duplicates by two-pass Bloom filtering, on DataFrame functions alone.

Texts are equal if they are identical once A-Z are lower-cased. The texts are read and hashed once; what follows reads the
written hashes.

1. First pass: a counting filter of `width` positions a row. Every hash falls on one position, and positions are counted by
   grouped sums with map-side combination, so that a text with any number of copies is one number per task. Only positions that were
   met at least twice go on.
2. Those positions fill a Bloom filter, two bits each within one block of 4096. It has `bits` bits for each of them, and
   never more than `most_blocks` blocks (256 MiB), which bounds what is broadcast whatever the table; beyond that size it fills up
   and lets more rows through, which costs shuffle and changes no result.
3. Second pass: every row asks the filter. Rows that it does not hold are the only ones with their text and pass straight through. The
   others are possibly repeated: these alone are shuffled, grouped by their sha256 with map-side combination and given their group's
   size and survivor. Groups with several rows meet their rows by broadcast where they are counted to be few, by hash
   otherwise, where AQE splits the rows of a hot group.

Of equal texts the row with the largest doc_id stays; of several rows with that doc_id, one. Nulls: a null text is the
empty one; a null doc_id is smaller than any, and keep_id is null only in groups without any. Very long texts are hashed
whole; texts without A-Z, empty ones too, are texts like others. An empty table gives no rows. Other columns travel in the
struct `row`, whatever their names.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusflow.llm.common import materialize, read_table

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Bits of a block of the filter: 64 words of 64.
BLOCK = 4096


@dataclass(frozen=True)
class Exact:
    width: int = 64
    bits: int = 16
    most_blocks: int = 1 << 19
    broadcast_groups: int = 500_000


def normalised(text: Column) -> Column:
    """The text with A-Z in lower case and nothing else changed; null is the empty text."""
    text = F.coalesce(text.cast("string"), F.lit(""))
    # lower() knows other alphabets as well, so only texts in ASCII alone may take it
    return F.when(F.length(text) == F.octet_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, UPPER.lower()))


def _places(position: Column, blocks: int) -> tuple[Column, Column, Column]:
    """Block and two bits of a position."""
    bits = F.xxhash64(position, F.lit(2))
    return F.pmod(F.xxhash64(position, F.lit(1)), F.lit(blocks)), bits.bitwiseAND(BLOCK - 1), F.shiftright(bits, 20).bitwiseAND(BLOCK - 1)


def repeated_filter(positions: DataFrame, p: Exact) -> tuple[DataFrame, int]:
    """Blocks (block, words) of a Bloom filter of the positions that occur at least twice, and their number."""
    twice = materialize(positions.groupBy("position").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("position"), "repeated-positions")
    blocks = min(p.most_blocks, max(1, -(-twice.count() * p.bits // BLOCK)))
    block, one, two = _places(F.col("position"), blocks)
    bits = twice.select(block.alias("block"), F.explode(F.array(one, two)).alias("bit"))
    words = bits.groupBy("block", F.shiftright("bit", 6).cast("int").alias("at")).agg(F.expr("bit_or(shiftleft(1L, cast(bit & 63 as int)))").alias("word"))
    packed = words.groupBy("block").agg(F.map_from_entries(F.collect_list(F.struct("at", "word"))).alias("of"))  # 64 at most
    every = F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: F.coalesce(F.try_element_at("of", i), F.lit(0).cast("long")))
    return materialize(packed.select("block", every.alias("words")), "repeated-filter"), blocks


def exact_duplicates(docs: DataFrame, p: Exact = Exact(), carry: list[str] | None = None) -> DataFrame:
    """One row per row of docs: row (its columns, or those of carry, as a struct), keep_id, group_size, kept, text_sha256."""
    text = normalised(F.col("text"))
    of = docs.select(F.struct(*(f"`{c}`" for c in carry or docs.columns)).alias("row"), F.col("doc_id").cast("long").alias("id"), F.unhex(F.sha2(text, 256)).alias("digest"))
    of = materialize(of.withColumn("number", F.monotonically_increasing_id()), "exact-hashes")
    positions = max(1, of.count() * p.width)
    of = of.withColumn("position", F.pmod(F.xxhash64("digest"), F.lit(positions)))
    held, blocks = repeated_filter(of.select("position"), p)
    block, one, two = _places(F.col("position"), blocks)
    bit = lambda b: F.getbit(F.get("words", F.shiftright(b, 6).cast("int")), b.bitwiseAND(63).cast("int")) == 1
    asked = of.withColumns({"own_block": block, "one": one, "two": two})
    in_filter = (F.col("own_block") == F.col("block")) & bit(F.col("one")) & bit(F.col("two"))
    possible = asked.join(F.broadcast(held), in_filter, "left_semi")
    others = asked.join(F.broadcast(held), in_filter, "left_anti")
    groups = possible.groupBy("digest").agg(F.count(F.lit(1)).alias("n"), F.max(F.struct("id", "number")).alias("last")).where("n > 1")
    groups = materialize(groups, "exact-groups")
    few = groups.count() <= p.broadcast_groups
    met = possible.join(F.broadcast(groups) if few else groups, "digest", "left")
    alone = F.col("last").isNull()
    result = lambda df, keep, n, kept: df.select("row", keep.alias("keep_id"), n.cast("long").alias("group_size"), kept.alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"))
    judged = result(met, F.when(alone, F.col("id")).otherwise(F.col("last.id")), F.coalesce("n", F.lit(1)), alone | (F.col("number") == F.col("last.number")))
    return judged.unionByName(result(others, F.col("id"), F.lit(1), F.lit(True)))


def drop_exact_copies(docs: DataFrame, p: Exact = Exact()) -> DataFrame:
    """docs with one row of each group of equal texts."""
    return exact_duplicates(docs, p).where("kept").select("row.*")


def op11_bloom_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = exact_duplicates(read_table(spark, sf_dir, "documents"), carry=["doc_id"])
    return out.select("row.doc_id", "keep_id", "group_size", "kept", "text_sha256")
