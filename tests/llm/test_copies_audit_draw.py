"""Exact duplicates, the filter audit and importance resampling against plain implementations."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict
from itertools import permutations

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusflow.llm import audit, exactdup, resample
from tests.llm.fixtures import SF, SF01, awkward_documents, documents

WORD = re.compile(r"[^\x20\x09-\x0D]+")
CLASHING = ("row", "id", "digest", "number", "position", "block", "words", "own_block", "one", "n", "last", "kept", "keep_id", "group_size", "part", "score", "rank", "shard", "failed")


def lower(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


def odd_rows():
    """The awkward rows, copies that differ in case, by alphabets that have none of A-Z, null ids, rows that repeat an id."""
    rows = awkward_documents() + [(None, "No id Here", "en", None, None), (None, "no ID here", None, "a", 1), (300, "no id here", "en", "a", 1), (301, "ÉCOLE A", "fr", "", 1), (302, "école a", "fr", "", 1), (303, "École A", "fr", "", 1)]
    rows += [(None, "only without id", "en", "b", 1), (None, "Only without id", "en", "b", 2), (400, "twice", "en", "b", 2), (400, "TWICE", "en", "c", 2), (None, None, None, None, None)]
    return rows + [(1000 + i, "The Hot text" if i % 2 else "the hot TEXT", "en", "hot", i) for i in range(500)]


def brute_copies(rows):
    groups = defaultdict(list)
    for doc_id, text in rows:
        groups[lower(text)].append(doc_id)
    return Counter((d, max((x for x in own if x is not None), default=None), len(own), hashlib.sha256(t.encode()).hexdigest()) for t, own in groups.items() for d in own)


@pytest.mark.parametrize("settings", [{}, {"broadcast_groups": 0}, {"most_blocks": 1, "bits": 1}, {"width": 1}])
def test_exact_duplicates(spark, settings):
    docs = documents(spark, odd_rows()).withColumns({c: F.lit("x") for c in CLASHING})
    got = exactdup.exact_duplicates(docs, exactdup.Exact(**settings)).collect()
    assert Counter((r["row"]["doc_id"], r["keep_id"], r["group_size"], r["text_sha256"]) for r in got) == brute_copies([x[:2] for x in odd_rows()])
    assert all(r["row"]["row"] == "x" for r in got)
    kept = [r for r in got if r["kept"]]
    assert len({r["text_sha256"] for r in got}) == len(kept) == len({r["text_sha256"] for r in kept})
    assert all(r["row"]["doc_id"] == r["keep_id"] for r in kept)


def test_exact_duplicates_of_the_tables(spark):
    docs = spark.read.parquet(f"{SF01}/documents.parquet")
    rows = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    got = exactdup.exact_duplicates(docs, carry=["doc_id"]).collect()
    assert Counter((r["row"]["doc_id"], r["keep_id"], r["group_size"], r["text_sha256"]) for r in got) == brute_copies(rows)
    assert exactdup.drop_exact_copies(docs).columns == docs.columns and exactdup.drop_exact_copies(docs).count() == len({lower(t) for _, t in rows})
    assert exactdup.exact_duplicates(documents(spark, [])).collect() == []


def test_only_possible_copies_are_shuffled(spark):
    """Rows that the filter does not hold reach the result without an exchange, and few others do not."""
    docs = documents(spark, [(i, f"a text of its own {i}", "en", "a", 0) for i in range(20_000)] + [(10**6 + i, f"shared {i % 50}", "en", "a", 0) for i in range(100)])
    out = exactdup.exact_duplicates(docs, carry=["doc_id"])
    assert out.count() == 20_100
    assert out.where("group_size > 1").count() == 100
    plan = out._jdf.queryExecution().toString()
    assert not any(x in plan for x in ("Python", "Arrow", "Pandas"))
    anti = [x for x in out._jdf.queryExecution().executedPlan().toString().split("\n") if "LeftAnti" in x]
    assert anti and all("BroadcastHashJoin" in x for x in anti)
    hashes = docs.select(F.xxhash64(exactdup.normalised(F.col("text"))).alias("h")).withColumn("position", F.pmod("h", F.lit(64 * 20_100)))
    held, blocks = exactdup.repeated_filter(hashes.select("position"), exactdup.Exact())
    block, one, two = exactdup._places(F.col("position"), blocks)
    bit = lambda b: F.getbit(F.get("words", F.shiftright(b, 6).cast("int")), b.bitwiseAND(63).cast("int")) == 1
    hit = hashes.withColumns({"b": block, "x": one, "y": two}).join(held, (F.col("b") == F.col("block")) & bit(F.col("x")) & bit(F.col("y")), "left_semi").count()
    assert 100 <= hit <= 1500, hit


def brute_audit(rows, labels):
    first, flags = {}, []
    for doc_id, text, _, _, _ in rows:
        if doc_id is not None:
            first[text or ""] = min(first.get(text or "", doc_id), doc_id)
    good, bad = {d for d, q, _ in labels if q == 1 and d is not None}, {d for d, _, t in labels if t == 1 and d is not None}
    for doc_id, text, _, source, _ in rows:
        t = text or ""
        w = WORD.findall(t)
        fails = (len(w) < 50, 100 * len(set(w)) < 65 * len(w), 100 * sum("A" <= c <= "Z" for c in t) > 5 * len(t), any(c in t for c in "#$%&*|"), doc_id is not None and t in first and doc_id > first[t])
        flags.append((source or "", {f for f, x in zip("ABCDE", fails) if x}, doc_id in good, doc_id in bad))
    out = {}
    for part in {f[0] for f in flags}:
        own = [f for f in flags if f[0] == part]
        shapley = Counter()
        for order in permutations("ABCDE"):
            left = own
            for step, f in enumerate(order, 1):
                removed = [x for x in left if f in x[1]]
                left = [x for x in left if f not in x[1]]
                shapley[f] += len(removed)
                redundant = sum(f in x[1] for x in own) - len(removed)
                out[part, "".join(order), step] = [len(left), len(removed), redundant, sum(x[1] == {f} for x in own), sum(x[2] for x in removed), sum(x[3] for x in removed)]
        for (p, order, step), values in out.items():
            if p == part:
                values.append(shapley[order[step - 1]])
    return out


@pytest.mark.parametrize("settings", [{}, {"shard_chars": 300, "part_bytes": 500}])
def test_filter_audit(spark, settings):
    rng = random.Random(4)
    rows = odd_rows() + [(2000 + i, " ".join(rng.choice(["Word", "plain", "x", "y#", f"z{i}", f"v{rng.randrange(99)}"]) for _ in range(rng.randint(30, 90))), "en", rng.choice("abc"), 0) for i in range(200)]
    labels = [(d, rng.choice([0, 1, None]), rng.choice([0, 1, None])) for d, *_ in rows if rng.random() < 0.6] + [(1, 1, 0), (1, 0, 1), (10**6, 1, 1), (None, 1, 1)]
    docs = documents(spark, rows).withColumns({c: F.lit(1) for c in CLASHING})
    table = spark.createDataFrame(labels, "doc_id long, quality int, toxic int").withColumn("part", F.lit("clash"))
    got = audit.filter_audit(docs, table, **settings).collect()
    expected = brute_audit(rows, labels)
    assert {(r["part"], r["filter_order"], r["step"]): list(r[3:]) for r in got} == expected and len(got) == len(expected)
    assert audit.filter_audit(documents(spark, []), table).collect() == []


def test_the_matrix(spark):
    """Entries of the shards over the dictionary are the word counts of the documents; every word has one code."""
    rows = odd_rows()
    shards = audit.materialize(audit.document_term_shards(documents(spark, rows), 5, 1000), "test")
    words = [tuple(r) for r in audit.dictionary(shards, 5).collect()]
    of = {code: word for word, code in words}
    assert len(of) == len(words) == len({w for w, _ in words}) and {w for w, _ in words} == {w for _, t, *_ in rows for w in WORD.findall(t or "")}
    got = Counter()
    for r in audit.globally_encoded(shards, audit.dictionary_codes(shards, 5), 5).collect():
        starts, counts, codes = audit.unpack(r["starts"]).astype(int), audit.unpack(r["counts"]), np.frombuffer(r["codes"], "<i8")
        for doc_id, a, z in zip(r["doc_ids"], starts[:-1], starts[1:]):
            got[doc_id, tuple(sorted((of[c], int(n)) for c, n in zip(codes[a:z].tolist(), counts[a:z])))] += 1
    assert got == Counter((d, tuple(sorted(Counter(WORD.findall(t or "")).items()))) for d, t, *_ in rows)


def brute_draw(rows, target, d=resample.Draw()):
    def of(text):
        w = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", lower(text))
        return len(w), [zlib.crc32(" ".join(w[i : i + k]).encode()) % d.buckets for k in range(1, d.longest + 1) for i in range(len(w) - k + 1)]

    docs, goal = [(i, *of(t)) for i, t in rows], [of(t)[1] for t in target]
    s, t = Counter(b for *_, x in docs for b in x), Counter(b for x in goal for b in x)
    S, T, n = sum(s.values()), sum(t.values()), d.buckets
    gain = {b: math.floor(1000 * math.log((t[b] + 1) * (S + n) / ((s[b] + 1) * (T + n)))) for b in s}
    out = []
    for i, words, x in docs:
        h = int(hashlib.sha256(f"{d.seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[b] for b in x)
        out.append((i, words, len(x), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    able = sorted((r for r in out if r[1] >= d.least_words), key=lambda r: (-r[4], r[0] is None, r[0]))
    drawn = able[: d.percent * len(able) // 100]
    left = Counter(out)
    left.subtract(drawn)
    return Counter({(*r, k): 1 for k, r in enumerate(drawn, 1)}) + Counter({(*r, None): n for r, n in left.items() if n > 0})


@pytest.mark.parametrize("settings", [{}, {"longest": 3, "buckets": 50, "percent": 55}, {"percent": 100, "least_words": 1}, {"percent": 0}])
def test_resampling(spark, settings):
    d = resample.Draw(**settings, slice_chars=2000)
    rows = [r[:2] for r in odd_rows()] + [(5, "x" * 200 + " y" * 30), (5, "x" * 200 + " y" * 30), (None, "z é 9 " * 20), (None, "z é 9 " * 20)]
    target = ["don't stop here", None, "", "w1 w2 w3 é " * 9]
    docs = documents(spark, [(i, t, None, None, None) for i, t in rows]).withColumns({c: F.lit(1) for c in CLASHING})
    got = resample.importance_resample(docs, spark.createDataFrame([(t,) for t in target], "text string"), d).collect()
    assert Counter(tuple(r) for r in got) == brute_draw(rows, target, d)


def test_resampling_of_the_tables(spark):
    docs, goal = spark.read.parquet(f"{SF01}/documents.parquet"), spark.read.parquet(f"{SF01}/benchmark.parquet")
    got = Counter(tuple(r) for r in resample.importance_resample(docs, goal).collect())
    assert got == brute_draw([tuple(r) for r in docs.select("doc_id", "text").collect()], [r["text"] for r in goal.collect()])
    assert resample.importance_resample(docs.limit(0), goal).collect() == []
    assert resample.importance_resample(spark.read.parquet(f"{SF}/documents.parquet"), goal.limit(0)).count() == spark.read.parquet(f"{SF}/documents.parquet").count()


def test_checksums():
    rng = random.Random(1)
    texts = [bytes(rng.randrange(256) for _ in range(n)) for n in [0, 1, 2, 63, 64, 65, 1000, *range(50)]]
    end = np.cumsum([len(t) for t in texts])
    got = resample.crc32_of(np.frombuffer(b"".join(texts), np.uint8), end - [len(t) for t in texts], end)
    assert got.tolist() == [zlib.crc32(t) for t in texts]


@pytest.mark.parametrize("rank", [1, 2, 499, 500, 777, 2999, 3000])
def test_cutoff(spark, rank):
    """Many equal scores and ids, uneven partitions; every rank's key is found."""
    rng = random.Random(rank)
    keys = [(rng.choice([5, 5, 5, rng.randrange(-9, 9)]), rng.randrange(4), n) for n in range(3000)]
    table = spark.createDataFrame(keys, "score long, id long, number long").repartitionByRange(5, "score")
    assert resample.cutoff_key(table, rank) == sorted(keys, key=lambda k: (-k[0], k[1], k[2]))[rank - 1]
