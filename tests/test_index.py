"""Bucketed collections, and indexes against exhaustive search."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusflow.operators import vectors
from corpusflow.sources.collections import Collection
from corpusflow.sources.vector_index import Quantizer, VectorIndex

SCHEMA = "id string, document_name string, text string"


def test_a_read_moves_nothing_and_a_lookup_opens_one_bucket(spark, tmp_path):
    store = Collection(spark, f"file://{tmp_path}", buckets=16)
    rows = lambda ids, v: spark.createDataFrame([(f"k{i}", f"d{i % 3}", v) for i in ids], SCHEMA)
    store.add(rows(range(500), "base"))
    store.add(rows(range(0, 500, 7), "one"))
    store.add(rows(range(0, 600, 50), "two"))
    read = store.read()
    got = {r["id"]: r["text"] for r in read.collect()}
    assert len(got) == 502 and read.count() == 502
    assert got == {f"k{i}": "two" if i % 50 == 0 else "one" if i % 7 == 0 else "base" for i in [*range(500), 500, 550]}
    plan = read._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and plan.count("SelectedBucketsCount: 16 out of 16") >= 5
    one = store.get("k7")
    plan = one._jdf.queryExecution().executedPlan().toString()
    # a scan that no join needs bucketed is read as files, of the same bucket
    assert plan.count("SelectedBucketsCount: 1 out of 16") + plan.count("disabled by query planner") == plan.count("FileScan") >= 3 and "Exchange" not in plan
    assert [tuple(r) for r in one.select("id", "text").collect()] == [("k7", "one")]
    # another session's catalog knows none of the tables: the folders are enough
    again = Collection(spark, f"file://{tmp_path}")
    for name in again.current():
        spark.sql(f"DROP TABLE corpusflow_{name.split('-')[-1]}")
    assert {r["id"]: r["text"] for r in again.read().collect()} == got


def test_documents_are_replaced_whole(spark, tmp_path):
    store = Collection(spark, f"file://{tmp_path}", buckets=2, bucket_rows=50)
    rows = lambda ids, d, v: spark.createDataFrame([(i, d, v) for i in ids], SCHEMA)
    store.add(rows([f"a{i}" for i in range(100)], "a", "x").unionByName(rows([f"b{i}" for i in range(100)], "b", "x")))
    store.add(rows([f"a{i}" for i in range(90, 105)], "a", "y"), replace_by="document_name")
    assert {(r["id"], r["text"]) for r in store.read().where("document_name = 'a'").collect()} == {(f"a{i}", "y") for i in range(90, 105)} and store.count() == 115
    store.add(rows(["a1"], "c", "z"))
    store.compact()
    assert store.count() == 116 and store.get("a1").first()["document_name"] == "c" and store.current()[0].split("-")[2] == "3"
    with pytest.raises(Exception, match="id is null"):
        store.add(rows([None], "a", "x"))
    assert store.count() == 116


def _brute(table, asked, k, ok):
    out = {}
    unit = {i: np.array(v) / np.linalg.norm(v) for i, (v, _) in table.items() if v is not None and np.linalg.norm(v) > 0}
    for q, v in asked.items():
        v = np.array(v) / np.linalg.norm(v)
        out[q] = [i for _, i in sorted((round(1 - float(v @ u), 12), i) for i, u in unit.items() if ok(table[i][1]))[:k]]
    return out


@pytest.mark.parametrize("size, kind", [(600, "random"), (3000, "random"), (3000, "grouped")])
def test_inverted_lists(spark, tmp_path, size, kind):
    """Recall of filtered and plain search at two sizes; later changes, filters that changed and rows that went are seen."""
    rng = np.random.Generator(np.random.PCG64(size))
    centres = rng.normal(size=(40, 24)) * 3
    draw = lambda n: (rng.normal(size=(n, 24)) + (centres[rng.integers(0, 40, n)] if kind == "grouped" else 0)).astype(float).tolist()
    table = {i: (v, i % 5) for i, v in enumerate(draw(size))}
    schema = "id long, embedding array<double>, label int, document_name string"
    frame = lambda t: spark.createDataFrame([(i, v, label, f"d{i // 10}") for i, (v, label) in t.items()], schema)
    store = Collection(spark, f"file://{tmp_path}", buckets=4)
    odd = {10**6: (None, 1), 10**6 + 1: ([0.0] * 24, 1), 10**6 + 2: ([float("nan")] * 24, 1)}
    store.add(frame(table | odd))
    index = VectorIndex(store, filters=("label",), q=Quantizer(sample=2000, list_rows=100, query_block=16))
    index.build()
    changes = {i: (v, 4) for i, v in zip(range(0, size + 60, 20), draw(size))}
    table |= changes
    store.add(frame(changes))
    assert len(index.refresh()) == 1 and index.refresh() == []
    fresh = {i: (v, 2) for i, v in zip(range(10, 15), draw(5))}
    for i in range(10, 20):
        del table[i]
    table |= fresh
    store.add(frame(fresh), replace_by="document_name")
    VectorIndex(store, filters=("label",)).refresh()
    asked = dict(enumerate(draw(40)))
    queries = spark.createDataFrame(list(asked.items()), "query_id long, embedding array<double>")
    for where, ok in ((None, lambda label: True), (F.col("label") == 4, lambda label: label == 4), (F.col("label") > 9, lambda label: False)):
        got = {q: [] for q in asked}
        for r in index.search(queries, 5, where).orderBy("query_id", "rank").collect():
            got[r["query_id"]].append(r["id"])
        expected = _brute(table, asked, 5, ok)
        total = sum(map(len, expected.values()))
        assert sum(len(set(got[q]) & set(expected[q])) for q in asked) >= 0.9 * total and all(len(set(got[q])) == len(got[q]) == len(expected[q]) for q in asked)
        assert all(ok(table[i][1]) for own in got.values() for i in own)
    share = index.touched(queries)
    assert 0 < share < (0.25 if kind == "grouped" else 0.9), share
    exact = vectors.top_k_join(store.read().where("id < 1000000"), queries, 5, vec_id="id").select("query_id", F.col("vec_id").alias("id"), F.round("distance", 9).alias("d"))
    near = index.search(queries, 5).select("query_id", "id", F.round("distance", 9).alias("d"))
    assert near.join(exact, ["query_id", "id", "d"]).count() >= 0.9 * 200
    # a new base is indexed anew and the folders before it go
    store.compact()
    assert index.refresh() == store.current() == index._indexed()
    assert index.search(queries, 5).count() == 200


def _bm25(docs, asked, k):
    import math
    import re
    from collections import Counter

    words = lambda t: [w for w in re.findall(r"\w+", (t or "").lower()) if len(w) > 1]
    bags = {i: Counter(words(t)) for i, t in docs}
    mean = sum(sum(b.values()) for b in bags.values()) / len(bags)
    df = Counter(w for b in bags.values() for w in b)
    out = {}
    for q, t in asked:
        scores = []
        for i, b in bags.items():
            hit = [(n, w) for w, n in Counter(words(t)).items() if w in b]
            if hit:
                s = sum(n * math.log(1 + (len(bags) - df[w] + 0.5) / (df[w] + 0.5)) * b[w] * 2.2 / (b[w] + 1.2 * (0.25 + 0.75 * sum(b.values()) / mean)) for n, w in hit)
                scores.append((-round(s, 6), i))
        out[q] = sorted(scores)[:k]
    return out


def test_block_max_search_is_exact(spark, tmp_path):
    """Against exhaustive BM25: words that nearly all rows have, equal rows, rare words, and questions without any known word."""
    import random

    from corpusflow.sources import text_index

    rng = random.Random(3)
    rare = [f"rare{i}" for i in range(300)]
    docs = [(i, " ".join(["the"] * rng.randint(0, 9) + rng.choices(rare[:20], k=rng.randint(0, 6)) + rng.choices(rare, k=rng.randint(0, 25)))) for i in range(1500)]
    docs += [(2000 + i, "the same rare1 rare2 text") for i in range(30)] + [(3000, None), (3001, ""), (3002, "THE Rare5 rare5")]
    asked = [(i, " ".join(["the"] + rng.choices(rare, k=rng.randint(1, 12)))) for i in range(25)] + [(90, "the the"), (91, "unknown words"), (92, ""), (93, None), (94, "rare1 rare2 text"), (95, "the rare5")]
    index = text_index.SparseIndex(spark, f"file://{tmp_path}/i", "doc_id")
    index.build(text_index.bm25_bags(spark.createDataFrame(docs, "doc_id long, text string"), "doc_id", "text"))
    frame = spark.createDataFrame(asked, "query_id long, question string")
    got = {q: [] for q, _ in asked}
    for r in text_index.bm25_search(index, frame, "question", 7).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((-round(r["score"], 6), r["doc_id"]))
    expected = _bm25(docs, asked, 7)
    assert all([s for s, _ in got[q]] == pytest.approx([s for s, _ in expected[q]], abs=2e-6) for q in expected)
    assert sum([i for _, i in got[q]] == [i for _, i in expected[q]] for q in got) >= len(got) - 2  # rounding may part ties
    # impact order: blocks of a value fall from its largest weight, none longer than BLOCK
    blocks = index._table("blocks").collect()
    assert all(len(b["ids"]) <= text_index.BLOCK and list(b["weights"]) == sorted(b["weights"], reverse=True) and b["top"] == b["weights"][0] for b in blocks)
    known, live = index.live_blocks(frame.select("query_id", text_index.bag_of(text_index.runs(text_index.word_tokens(F.col("question")))).alias("bag")), 7, text_index.inverse_frequency)
    every = known.join(index._table("blocks"), "value").count()
    assert live.count() < every


def test_a_tasks_best_entries_follow_queries_not_lists(spark, tmp_path):
    """What tasks send on and hold is bounded by queries, however many lists there are; equal entries are taken by id."""
    import tracemalloc

    import pyarrow as pa

    from corpusflow.sources import vector_index

    rng = np.random.Generator(np.random.PCG64(5))
    store = Collection(spark, f"file://{tmp_path}", buckets=2)
    schema = "id long, embedding array<double>"
    x = rng.normal(size=(3000, 16))
    store.add(spark.createDataFrame([(i, v) for i, v in enumerate(x.tolist())], schema))
    index = VectorIndex(store)
    index.build()
    books = index.load()
    assert len(books.lists) > 40 and books.probes > 10
    queries = spark.createDataFrame([(i, v) for i, v in enumerate(rng.normal(size=(30, 16)).tolist())], "query_id long, embedding array<double>")
    assert index.guesses(queries, 20).count() == 30 * 20  # one task's share; by lists it would be several hundred a query

    n, asked = 60_000, 1000
    unit = x[:asked] / np.linalg.norm(x[:asked], axis=1)[:, None]
    own, codes = books.encode(np.repeat(unit, 60, axis=0))
    ids = np.arange(n) * 7 % n  # not in order
    left = pa.table({"id": ids, "list": pa.array(own, pa.int32()), "code": pa.array([c.tobytes() for c in codes], pa.binary())})
    every = np.tile(np.arange(len(books.lists), dtype=np.int32), (asked, 1))
    right = pa.table({"query_id": np.arange(asked), "lists": pa.array(list(every), pa.list_(pa.int32())), "unit": pa.array([u.tobytes() for u in unit], pa.binary())})
    tracemalloc.start()
    got = vector_index.nearest_entries(books, 20, "id")(left, right)
    assert tracemalloc.get_traced_memory()[1] < 150e6 and got.num_rows == 20 * asked
    tracemalloc.stop()
    q, e, d = (got.column(c).to_numpy() for c in ("query_id", "id", "estimate"))
    decoded = books.decode(own[::60], codes[::60]).astype(float)
    full = ((unit[:40, None] - decoded[None]) ** 2).sum(axis=2)
    for i in range(40):
        assert np.abs(np.sort(d[q == i]) - np.sort(np.repeat(full[i], 60))[:20]).max() < 1e-5
        # all copies of the nearest text are equal: the smallest ids of it
        same = np.flatnonzero((np.repeat(decoded, 60, axis=0) == decoded[full[i].argmin()]).all(axis=1))
        assert sorted(e[q == i].tolist()) == sorted(ids[same].tolist())[:20]


def test_segments_are_inverted_and_summed_where_their_rows_are(spark, tmp_path, monkeypatch):
    """Many segments, blocks of queries: the index moves no posting, a row is summed in its segment alone, and results are as with one segment."""
    import random

    from corpusflow.sources import text_index

    rng = random.Random(4)
    words = [f"w{i}" for i in range(200)]
    docs = [(i, " ".join(["the"] * rng.randint(0, 5) + rng.choices(words, k=rng.randint(0, 40)))) for i in range(900)] + [(5000 + i, "the same w1 w2 text") for i in range(40)] + [(9000, None), (9001, "")]
    asked = [(i, " ".join(["the"] + rng.choices(words, k=rng.randint(1, 15)))) for i in range(30)] + [(90, "the"), (91, "none"), (92, None), (93, "same w1")]
    frame = spark.createDataFrame(asked, "query_id long, question string")
    monkeypatch.setattr(text_index, "SEGMENT", 300)
    monkeypatch.setattr(text_index, "BUCKET_ROWS", 90)
    monkeypatch.setattr(text_index, "QUERY_BLOCK", 7)
    index = text_index.SparseIndex(spark, f"file://{tmp_path}/i", "doc_id")
    index.build(text_index.bm25_bags(spark.createDataFrame(docs, "doc_id long, text string"), "doc_id", "text"))
    blocks = index._table("blocks").collect()
    of = {}
    for b in blocks:
        for i in b["ids"]:
            of.setdefault(i, set()).add(b["segment"])
    assert all(len(s) == 1 for s in of.values()) and 20 < len({b["segment"] for b in blocks}) < 300
    bags = {i: dict.fromkeys(w for w in (t or "").split() if len(w) > 1) for i, t in docs}
    assert sorted((b["value"], i) for b in blocks for i in b["ids"]) == sorted((w, i) for i, bag in bags.items() for w in bag)
    got = {q: [] for q, _ in asked}
    for r in text_index.bm25_search(index, frame, "question", 5).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((-round(r["score"], 6), r["doc_id"]))
    expected = _bm25(docs, asked, 5)
    assert all([s for s, _ in got[q]] == pytest.approx([s for s, _ in expected[q]], abs=2e-6) for q in expected)
    assert [i for _, i in got[93]] == [i for _, i in expected[93]] and got[91] == got[92] == []
