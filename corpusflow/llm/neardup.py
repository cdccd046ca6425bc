"""Near-duplicate documents by banded MinHash with Bayesian verification, and their connected components.

Sets are the distinct 5-word shingles of a document (as 64-bit hashes). Documents with equal sets are one node.

1. Every node gets a MinHash signature; each band of it puts the node into one bucket.
2. Each bucket pairs its members with its smallest member. Signatures of a pair are compared batch by batch; the pair is
   dropped once the posterior probability that its similarity reaches the threshold, under a uniform prior, is below
   `miss`. Survivors that still join different components are verified exactly on the full sets, smallest partners
   first, and merge components; this repeats until no unverified survivor joins two components.
3. Buckets that hold more than one component after that compare all their members across components, in blocks of
   bounded size, under the same Bayesian test. The sets of members with survivors travel to the block, which verifies the
   survivors exactly, best first, and gives only links that join two components there: fewer than it has members.

A pair within one component changes nothing, so a large group of copies costs a link or a few for each member, and no
list of all its pairs is ever made. What two documents can be missed for is sharing no band, or the pruning at `miss`.

Very long texts are hashed in chunks of a bounded size; their sets travel whole. Other columns of the input are ignored,
whatever their names.

Defined results: a null or wordless text has the empty set, is linked with nothing and is its own component. Documents
with fewer than five words have their whole sequence as one shingle. Rows that share a doc_id are one document. Rows
with a null doc_id are never linked and are kept. Ties cannot arise: order is by doc_id. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusflow.llm.common import forget, materialize, read_table, slices
from corpusflow.llm.wordhash import ngram_hashes, text_column, words_of


@dataclass(frozen=True)
class NearDup:
    words: int = 5
    percent: int = 75
    bands: int = 32
    rows: int = 5
    miss: float = 0.001
    batch: int = 32
    block: int = 2048
    block_bytes: int = 32 << 20

    @property
    def hashes(self) -> int:
        return self.bands * self.rows


def least_matches(p: NearDup) -> list[tuple[int, int]]:
    """(n, m): after n compared hashes a pair needs m matches or its posterior P(similarity >= threshold) is below miss.

    With a uniform prior the posterior is Beta(m + 1, n - m + 1), whose upper tail at t is the chance of at most m
    successes in n + 1 trials of t.
    """
    t, out = p.percent / 100, []
    for n in [*range(p.batch, p.hashes, p.batch), p.hashes]:
        tail, m = 0.0, -1
        while m < n:
            m += 1
            tail += math.comb(n + 1, m) * t**m * (1 - t) ** (n + 1 - m)
            if tail >= p.miss:
                break
        out.append((n, m))
    return out


def shingle_sets(texts: list[str], k: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text."""
    words = words_of(texts, lower=True)
    grams = ngram_hashes(words.hashes, k)
    out = []
    for a, z in zip(words.first[:-1].tolist(), words.first[1:].tolist()):
        if z - a >= k:
            out.append(np.unique(grams[a : z - k + 1]))
        else:
            out.append(ngram_hashes(words.hashes[a:z], z - a) if z > a else np.zeros(0, np.uint64))
    return out


def signature(shingles: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    x = (shingles >> np.uint64(32)).astype(np.uint32)
    least = np.full(len(a), 0xFFFFFFFF, np.uint32)
    for lo in range(0, len(x), 1024):
        least = np.minimum(least, (x[lo : lo + 1024, None] * a + b).min(axis=0))
    return least


def _hash_family(n: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.Generator(np.random.PCG64(75))
    return rng.integers(0, 2**31, n, dtype=np.uint32) * np.uint32(2) + np.uint32(1), rng.integers(0, 2**32, n, dtype=np.uint32)


def document_features(docs: DataFrame, p: NearDup) -> DataFrame:
    """doc_id, n_shingles, set_hash (of the whole set) and sig for each row."""

    def run(batches):
        a, b = _hash_family(p.hashes)
        for batch in batches:
            texts = text_column(batch.column(1))
            n, digest, sig = [], [], []
            for lo, hi in slices(len(texts), np.array([len(t) + 1 for t in texts]), 1 << 20):
                for s in shingle_sets(texts[lo:hi], p.words):
                    n.append(len(s))
                    digest.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest())
                    sig.append(signature(s, a, b).tobytes() if len(s) else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(digest, pa.binary()), pa.array(sig, pa.binary())], ["doc_id", "n_shingles", "set_hash", "sig"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, n_shingles long, set_hash binary, sig binary")


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint32).reshape(-1, width)


def bayes_filter(pairs: DataFrame, signatures: DataFrame, p: NearDup) -> DataFrame:
    """The pairs (a, b) whose signatures pass every batch."""
    steps = least_matches(p)

    def run(batches):
        for batch in batches:
            left, right = _matrix(batch.column(2), p.hashes), _matrix(batch.column(3), p.hashes)
            alive, matches, done = np.arange(len(left)), np.zeros(len(left), np.int64), 0
            for n, least in steps:
                matches[alive] += (left[alive, done:n] == right[alive, done:n]).sum(axis=1)
                alive, done = alive[matches[alive] >= least], n
            yield pa.RecordBatch.from_arrays([batch.column(i).take(pa.array(alive)) for i in (0, 1)], ["a", "b"])

    side = lambda c: signatures.select(F.col("id").alias(c), F.col("sig").alias(f"sig_{c}"))
    return pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "sig_a", "sig_b").mapInArrow(run, "a long, b long")


def _similar(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    """Whether two sorted sets reach the similarity, exactly."""
    if len(x) > len(y):
        x, y = y, x
    if 100 * len(x) < percent * len(y):
        return False
    at = np.minimum(np.searchsorted(y, x), len(y) - 1)
    both = int((y[at] == x).sum())
    return 100 * both >= percent * (len(x) + len(y) - both)


def verify(pairs: DataFrame, sets: DataFrame, p: NearDup) -> DataFrame:
    """The pairs whose full sets are similar enough."""

    def run(batches):
        for batch in batches:
            ok = []
            for x, y in zip(batch.column(2), batch.column(3)):
                ok.append(_similar(np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64), p.percent))
            yield pa.RecordBatch.from_arrays([batch.column(i).filter(pa.array(ok, pa.bool_())) for i in (0, 1)], ["a", "b"])

    side = lambda c: sets.select(F.col("id").alias(c), F.col("shingles").alias(f"set_{c}"))
    return pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "set_a", "set_b").mapInArrow(run, "a long, b long")


def components(edges: DataFrame) -> DataFrame:
    """(id, component) of every node on an edge, component the smallest id reachable: alternating large and small stars.

    Each round is two grouped minima and two joins; the rounds grow with the logarithm of the longest path.
    """
    current = materialize(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "cc")
    while True:
        both = current.unionByName(current.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("m", "u"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u")
        small = small.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(small.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        before, current = current, materialize(small, "cc")
        forget(before)
        # done once every node points at one node, and that node at none
        forked = current.groupBy("u").agg(F.min("v").alias("lo"), F.max("v").alias("hi")).where("lo <> hi")
        if forked.isEmpty() and current.join(current.select(F.col("v").alias("u")), "u", "left_semi").isEmpty():
            break
    top = current.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct()
    return current.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(top)


class Linker:
    """Verified links so far and the components that they make."""

    def __init__(self, spark: SparkSession, sets: DataFrame, p: NearDup):
        self.sets, self.p = sets, p
        self.edges = spark.createDataFrame([], "a long, b long")
        self.labels = spark.createDataFrame([], "id long, component long")

    def labelled(self, df: DataFrame, column: str, name: str) -> DataFrame:
        own = self.labels.select(F.col("id").alias(column), F.col("component").alias(name))
        return df.join(own, column, "left").withColumn(name, F.coalesce(name, column))

    def apart(self, pairs: DataFrame) -> DataFrame:
        """The pairs that join two components."""
        return self.labelled(self.labelled(pairs, "a", "ca"), "b", "cb").where("ca <> cb").select("a", "b")

    def link(self, found: DataFrame) -> None:
        """Take in verified links."""
        if not found.isEmpty():
            self.edges = self.edges.unionByName(found)
            self.labels = components(self.edges)

    def absorb(self, survivors: DataFrame) -> None:
        """Verify survivors: four partners of each document, then those of the others that still join two components."""
        order = Window.partitionBy("a").orderBy("b")
        ranked = survivors.withColumn("r", F.row_number().over(order))
        for some in (ranked.where("r <= 4"), ranked.where("r > 4")):
            picked = materialize(self.apart(some.select("a", "b")), "picked")
            if not picked.isEmpty():
                self.link(materialize(verify(picked, self.sets, self.p), "links"))


def _streamed(table_of, empty):
    """A mapInArrow function: table_of(table) for each run of rows of one unit; rows come sorted by unit."""

    def run(batches):
        kept: pa.Table | None = None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            table = pa.concat_tables([kept, table]) if kept is not None else table
            if not table.num_rows:
                continue
            unit = table.column("unit").to_numpy()
            cut = np.flatnonzero(np.concatenate([[True], unit[1:] != unit[:-1]]))
            for a, z in zip(cut[:-1], cut[1:]):
                yield from table_of(table.slice(a, z - a)).to_batches()
            kept = table.slice(int(cut[-1]))
        if kept is not None:
            yield from table_of(kept).to_batches()
        else:
            yield from empty.to_batches()

    return run


def _surviving(table: pa.Table, p: NearDup, steps: list[tuple[int, int]]):
    """Pairs (i, j, matches) of rows of one unit, of different components, that pass the Bayesian test.

    A pair belongs to the first band that its signatures share, so that it is tested in one bucket alone.
    """
    comp, band = table.column("component").to_numpy(), table.column("band")[0].as_py()
    ids, first, both = (table.column(c).to_numpy() for c in ("id", "first", "both"))
    sig = _matrix(table.column("sig"), p.hashes)
    left, right = np.flatnonzero(both | first), np.flatnonzero(both | ~first)
    for lo in range(0, len(left), 64):
        some = left[lo : lo + 64]
        i, j = np.nonzero((comp[some][:, None] != comp[right][None, :]) & ~(both[some][:, None] & (ids[some][:, None] <= ids[right][None, :])))
        i, j, matches, done = some[i], right[j], np.zeros(len(i), np.int64), 0
        for n, least in steps:
            matches += (sig[i, done:n] == sig[j, done:n]).sum(axis=1)
            ok = matches >= least
            i, j, matches, done = i[ok], j[ok], matches[ok], n
        if band and len(i):
            same = (sig[i, : band * p.rows] == sig[j, : band * p.rows]).reshape(len(i), band, p.rows).all(axis=2).any(axis=1)
            i, j, matches = i[~same], j[~same], matches[~same]
        if len(i):
            yield i, j, matches


def bucket_links(members: DataFrame, signatures: DataFrame, sets: DataFrame, p: NearDup) -> DataFrame:
    """Verified links (a, b) across components of one bucket; members: key, band, id, component, size and bytes (of the bucket).

    Buckets beyond `block` members or `block_bytes` bytes of sets are cut into blocks by hash, and each pair of blocks is a
    unit of work. A first pass over signatures alone finds the members of each unit that have a surviving partner; only
    their sets travel to the unit, where survivors are verified, best matches first, unless links found there join them
    already. So a unit gives fewer rows than it has members, whatever the number of its pairs.
    """
    n = F.greatest(F.ceil(F.col("size") / F.lit(p.block)), F.ceil(F.col("bytes") / F.lit(p.block_bytes))).cast("int")
    rows = members.withColumn("own", F.pmod(F.xxhash64("id"), n).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), n - 1)))
    rows = rows.select("key", "band", F.least("own", "other").alias("x"), F.greatest("own", "other").alias("y"), (F.col("own") < F.col("other")).alias("first"), (F.col("own") == F.col("other")).alias("both"), "id", "component")
    rows = rows.withColumn("unit", F.xxhash64("key", "x", "y")).drop("key", "x", "y")
    steps = least_matches(p)
    flagged = "unit long, band int, id long, component long, first boolean, both boolean"
    names = [f.split()[0] for f in flagged.split(", ")]

    def candidates(table: pa.Table) -> pa.Table:
        hit = np.zeros(table.num_rows, bool)
        for i, j, _ in _surviving(table, p, steps):
            hit[i] = hit[j] = True
        return table.select(names).filter(pa.array(hit))

    def links(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        ids, comp, column = table.column("id").to_numpy(), table.column("component").to_numpy(), table.column("shingles")
        parent = {c: c for c in comp.tolist()}

        def top(c):
            while parent[c] != c:
                parent[c] = c = parent[parent[c]]
            return c

        found = [np.concatenate(x) for x in zip(*_surviving(table, p, steps))]
        a, b = [], []
        if found:
            i, j, matches = found
            for at in np.lexsort((ids[j], ids[i], -matches)).tolist():
                u, v = int(i[at]), int(j[at])
                cu, cv = top(comp[u].item()), top(comp[v].item())
                if cu != cv and _similar(np.frombuffer(column[u].as_buffer(), np.uint64), np.frombuffer(column[v].as_buffer(), np.uint64), p.percent):
                    parent[max(cu, cv)] = min(cu, cv)
                    a.append(max(ids[u], ids[v]))
                    b.append(min(ids[u], ids[v]))
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    by_unit = lambda df: df.repartition("unit").sortWithinPartitions("unit")
    none = pa.table({c: pa.array([], {"long": pa.int64(), "int": pa.int32(), "boolean": pa.bool_()}[t]) for c, t in (f.split() for f in flagged.split(", "))})
    hits = by_unit(rows.join(signatures, "id").select("unit", "band", "id", "component", "first", "both", "sig")).mapInArrow(_streamed(candidates, none), flagged)
    hits = materialize(hits, "candidates")
    whole = by_unit(hits.join(signatures, "id").join(sets, "id").select("unit", "band", "id", "component", "first", "both", "sig", "shingles"))
    return whole.mapInArrow(_streamed(links, pa.table({"a": pa.array([], pa.int64()), "b": pa.array([], pa.int64())})), "a long, b long")


def near_duplicates(docs: DataFrame, p: NearDup = NearDup()) -> DataFrame:
    """One row per row of docs: doc_id, n_shingles, component_id, kept."""
    spark = docs.sparkSession
    features = materialize(document_features(docs, p), "minhash")
    nodes = features.where("n_shingles > 0 and doc_id is not null")
    reps = materialize(nodes.groupBy("set_hash").agg(F.min("doc_id").alias("id")), "representatives")
    nodes = nodes.select("set_hash", F.col("doc_id").alias("id"), "n_shingles", "sig").join(reps, ["set_hash", "id"], "left_semi").dropDuplicates(["set_hash", "id"])
    nodes = materialize(nodes, "nodes")
    wide = 4 * p.rows
    keys = F.array(*(F.xxhash64(F.lit(b), F.substring("sig", 1 + wide * b, wide)) for b in range(p.bands)))
    bands = nodes.select("id", "n_shingles", F.posexplode(keys).alias("band", "key"))
    buckets = bands.groupBy("key").agg(F.min("id").alias("leader"), F.max("id").alias("_last"), F.count(F.lit(1)).alias("size"), (8 * F.sum("n_shingles")).alias("bytes")).where("leader < _last").drop("_last")
    members = materialize(bands.drop("n_shingles").join(buckets, "key"), "members")
    active = members.select("id").distinct()
    signatures = signatures_step = materialize(nodes.join(active, "id", "left_semi").select("id", "set_hash", "sig"), "signatures")

    def sets_of(batches):
        for batch in batches:
            texts = text_column(batch.column(1))
            out = []
            for lo, hi in slices(len(texts), np.array([len(t) + 1 for t in texts]), 1 << 20):
                out += [s.tobytes() for s in shingle_sets(texts[lo:hi], p.words)]
            digests = [hashlib.blake2b(s, digest_size=16).digest() for s in out]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary()), pa.array(digests, pa.binary())], ["id", "shingles", "set_hash"])

    texts = docs.select(F.col("doc_id").cast("long").alias("id"), F.col("text").cast("string")).join(signatures.select("id"), "id", "left_semi")
    sets = texts.mapInArrow(sets_of, "id long, shingles binary, set_hash binary").dropDuplicates(["id", "set_hash"])
    sets = materialize(sets.join(signatures.select("id", "set_hash"), ["id", "set_hash"], "left_semi").select("id", "shingles"), "sets")
    signatures = signatures.select("id", "sig")

    linker = Linker(spark, sets, p)
    stars = members.where("id <> leader").select(F.col("id").alias("a"), F.col("leader").alias("b")).distinct()
    linker.absorb(materialize(bayes_filter(stars, signatures, p), "stars"))
    labelled = linker.labelled(members.where("size > 2").select("key", "band", "id", "size", "bytes"), "id", "component")
    mixed = labelled.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo <> hi").select("key")
    linker.link(materialize(bucket_links(labelled.join(mixed, "key", "left_semi"), signatures, sets, p), "links"))

    forget(members, nodes, signatures_step, sets)  # the labels are written; the result needs them, reps and features
    found = reps.join(linker.labels, "id", "left").select("set_hash", F.coalesce("component", "id").alias("component_id"))
    rows = features.select("doc_id", "n_shingles", F.when((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull(), F.col("set_hash")).alias("set_hash"))
    rows = rows.join(found, "set_hash", "left").withColumn("component_id", F.coalesce("component_id", "doc_id"))
    return rows.select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))


def op3_minhash_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read_table(spark, sf_dir, "documents"))
