"""Best-fit packing of tokenised documents into fixed-length sequences, under several capacities.

Every document becomes pieces of at most `seq_len` tokens. A sequence is a bin with three capacities:
tokens, pieces and attention cost (the sum of squared piece lengths). A piece whose own cost is beyond the attention
capacity uses all of it, so it stands alone in its sequence. Pieces go in by descending length;
each takes, among the open bins that can hold it under every constraint, the one that scores best, by the
weighted norm of what stays free ("norm") or by the weighted dot-product of need and free room ("dot").

A piece is known to this rule by its length alone. So the rule runs on the driver over the histogram of
lengths (at most seq_len numbers, whatever the corpus), moving whole groups of equal bins at a time, and
yields a table of ranges: the pieces of one length with ranks from a to b go to these bins at this offset.
Ranks come from counts per partition and length, so neither a global sort nor a single task is needed.

Nulls: a null text is the empty text (one piece: the end id); a null doc_id stays null. Very long texts are cut into as
many pieces as they need. Equal documents and repeated rows are packed as often as they occur; pieces of equal length are
numbered by partition and place in it, bins that score equally by their free room. An empty table gives no rows. Other
columns are ignored, whatever their names.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusflow.llm.common import materialize, read_table, text_of
from corpusflow.llm.wordcodec import library_codec


@dataclass(frozen=True)
class Capacities:
    """tokens and pieces of a sequence, and the attention cost that it may have; None: what tokens imply, which never binds
    before they do."""

    tokens: int = 1024
    pieces: int | None = None
    attention: int | None = None
    weights: tuple[float, float, float] = (1.0, 0.001, 0.001)
    rule: str = "norm"

    def full(self) -> tuple[int, int, int]:
        return self.tokens, self.pieces or self.tokens, self.attention or self.tokens**2


def plan_bins(histogram: dict[int, int], caps: Capacities) -> dict[str, np.ndarray]:
    """Ranges (length, rank, each, bin, offset): pieces of `length` from `rank` on fill bins from `bin` on, `each` to a bin.

    Work and result grow with the number of distinct lengths, not with the number of pieces.
    """
    top = np.array(caps.full(), dtype=float)
    weight = np.array(caps.weights) / top
    states: dict[tuple[int, int, int], list[list[int]]] = {}  # free capacities: runs of [first bin, number]
    out, bins = [], 0
    for length in sorted(histogram, reverse=True):
        if length > caps.tokens:
            raise ValueError(f"a piece of {length} tokens fits no sequence of {caps.tokens}")
        left, rank, need = histogram[length], 0, np.minimum([length, 1, length * length], top).astype(np.int64)
        free = [s for s in states if s[0] >= need[0] and s[1] >= 1 and s[2] >= need[2]]
        if free:
            room = np.array(free, dtype=float)
            score = ((room - need) * weight) ** 2 if caps.rule == "norm" else -(room / top) * (need / top) * np.array(caps.weights)
            # equal scores: the smaller room first, so that the order is total
            free = [free[i] for i in np.lexsort((room[:, 1], room[:, 0], score.sum(axis=1)))]
        for state in [*free, None]:
            if state is None:
                runs, state = [[bins, -1]], caps.full()
            else:
                runs = states[state]
            each = min(state[0] // length, state[1], state[2] // int(need[2]))
            while left and runs:
                run = runs.pop()
                wanted = -(-left // each)
                if run[1] < 0:
                    run[1], bins = wanted, bins + wanted
                taken = min(run[1], wanted)
                if run[1] > taken:
                    runs.append([run[0] + taken, run[1] - taken])
                out.append((length, rank, each, run[0], caps.tokens - state[0]))
                placed = min(left, taken * each)
                last = placed - (taken - 1) * each  # of the last bin, which may get fewer
                for first, number, n in ((run[0], taken - 1, each), (run[0] + taken - 1, 1, last)):
                    if number:
                        after = (state[0] - n * length, state[1] - n, state[2] - n * int(need[2]))
                        states.setdefault(after, []).append([first, number])
                rank, left = rank + placed, left - placed
            if state in states and not states[state]:
                del states[state]
            if not left:
                break
    names = ("length", "rank", "each", "bin", "offset")
    return {k: np.array([r[i] for r in out], dtype=np.int64) for i, k in enumerate(names)}


def cut_documents(docs: DataFrame, tokenizer: str, end_id: int, seq_len: int, with_ids: bool = False) -> DataFrame:
    """Pieces of each document: doc_id, piece, start, length, ids_crc32, and part and rank_in_part, which number equal lengths.

    Only documents longer than seq_len are cut; the first piece takes what is left over. with_ids adds the ids themselves.
    """
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long, part int, rank_in_part long" + ", ids binary" * with_ids
    names = [f.split()[0] for f in schema.split(", ")]
    end = np.array([end_id], dtype="<u4").tobytes()

    def cut(batches):
        codec, part = library_codec(tokenizer), TaskContext.get().partitionId()
        seen = np.zeros(seq_len + 1, dtype=np.int64)
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch.column(0).to_pylist(), text_of(batch.column(1))):
                ids = codec.encode(text) + end
                n = len(ids) // 4
                first = (n - 1) % seq_len + 1
                for k, lo in enumerate([0, *range(first, n, seq_len)]):
                    hi = lo + seq_len if k else first
                    own = ids[4 * lo : 4 * hi]
                    rows.append((doc_id, k, lo, hi - lo, zlib.crc32(own), part, int(seen[hi - lo]), own)[: len(names)])
                    seen[hi - lo] += 1
            types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * len(names), types)], names)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(cut, schema)


def pack_pieces(pieces: DataFrame, caps: Capacities) -> DataFrame:
    """Add sequence_id and offset to a materialised table of pieces."""
    counts = pieces.groupBy("part", "length").agg(F.count(F.lit(1)).alias("n"))
    earlier = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    counts = materialize(counts.withColumn("before", F.coalesce(F.sum("n").over(earlier), F.lit(0))), "pack-counts")
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # one row per length
    plan = plan_bins(histogram, caps)
    ranked = pieces.join(counts.select("part", "length", "before"), ["part", "length"]).withColumn("rank", F.col("before") + F.col("rank_in_part")).drop("part", "rank_in_part", "before")
    kept = [c for c in ranked.columns if c != "rank"]
    order = np.lexsort((plan["rank"], plan["length"]))
    plan = {k: v[order] for k, v in plan.items()}
    # one number that sorts as (length, rank): ranks stay below the total
    step = max(histogram.values(), default=0) + 1
    plan["key"] = plan["length"] * step + plan["rank"]

    def place(batches):
        for batch in batches:
            length, rank = (batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("length", "rank"))
            at = np.searchsorted(plan["key"], length * step + rank, side="right") - 1
            nth = rank - plan["rank"][at]
            seq = plan["bin"][at] + nth // plan["each"][at]
            off = plan["offset"][at] + nth % plan["each"][at] * length
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(seq), pa.array(off)], [*kept, "sequence_id", "offset"])

    kinds = dict(ranked.dtypes)
    return ranked.mapInArrow(place, ", ".join(f"`{c}` {kinds[c]}" for c in kept) + ", sequence_id long, offset long")


def pack_documents(docs: DataFrame, tokenizer: str = "byte_bpe_50k.json", end_id: int = 2, caps: Capacities = Capacities(), with_ids: bool = False) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, [ids,] sequence_id, offset."""
    pieces = materialize(cut_documents(docs, tokenizer, end_id, caps.tokens, with_ids), "pack-pieces")
    return pack_pieces(pieces, caps)


def op7_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(read_table(spark, sf_dir, "documents"))
