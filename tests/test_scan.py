"""Running values over keys of any size, against plain loops."""

import random

import pytest
from pyspark.sql import functions as F

from corpusflow.operators import chunking
from corpusflow.operators.scan import segmented_scan


@pytest.mark.parametrize("keys", [["a"], ["a", "b"], [None, "a", "b", "c"], [f"k{i}" for i in range(500)]])
def test_running_values(spark, keys):
    rng = random.Random(len(keys))
    rows = [(keys[0] if rng.random() < 0.5 else rng.choice(keys), i, rng.choice([None, 0, 1, -3]), rng.choice([None, None, f"t{i}"])) for i in range(4000)]
    rng.shuffle(rows)
    table = spark.createDataFrame(rows, "k string, at int, n int, t string")
    got = {(r["k"], r["at"]): (r["total"], r["one"], r["last"]) for r in segmented_scan(table, "k", ["at"], {"total": F.col("n"), "one": F.lit(1)}, {"last": F.col("t")}).collect()}
    expected, state = {}, {}
    for k, at, n, t in sorted(rows, key=lambda r: r[1]):
        total, one, last = state.get(k, (0, 0, None))
        state[k] = expected[k, at] = total + (n or 0), one + 1, t if t is not None else last
    assert got == expected
    assert segmented_scan(table.limit(0), "k", ["at"], {"one": F.lit(1)}).collect() == []


def test_one_long_document(spark):
    """A document with nearly all blocks is dealt evenly, and its headings and numbers reach across partitions."""
    n = 60_000
    blocks = spark.range(n).select(F.when(F.col("id") < n - 50, "long").otherwise(F.concat(F.lit("d"), F.col("id").cast("string"))).alias("doc"), (F.col("id") % 1000).alias("page"), F.floor(F.col("id") / 1000).cast("long").alias("position"))
    at = F.col("page") * 1000 + F.col("position")
    blocks = blocks.withColumns({"level": F.when(at == 7, 1).when(at % 90001 == 5, 2).when(at % 4001 == 0, 3).cast("int"), "text": F.concat(F.lit("x"), at.cast("string"))})
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # which would join such small ones
    tracked = chunking.track_sections(blocks, "doc", ["page", "position"])
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    sizes = sorted(spark.read.parquet(f).count() for f in tracked.inputFiles())
    assert len(sizes) >= 4 and sizes[-1] <= 3 * sizes[len(sizes) // 2]
    got = {(r["page"], r["position"]): (r["section"], r["subsection"], r["heading"]) for r in tracked.where("doc = 'long'").collect()}
    section = subsection = deep = None
    for r in sorted(blocks.where("doc = 'long'").collect(), key=lambda r: (r["page"], r["position"])):
        if r["level"] == 1:
            section, subsection, deep = r["text"], None, None
        elif r["level"] == 2:
            subsection, deep = r["text"], None
        elif r["level"] == 3:
            deep = r["text"]
        assert got[r["page"], r["position"]] == (section, subsection, deep or subsection or section), r
    numbered = chunking.number_chunks(blocks, "doc", ["page", "position"]).where("doc = 'long'").select("chunk_index")
    assert numbered.distinct().count() == n - 50 and numbered.agg(F.min("chunk_index"), F.max("chunk_index")).first() == (0, n - 51)
