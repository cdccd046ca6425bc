"""Removal of every repeated passage, found exactly, through sharded automata of recurring phrases.

A window is `window` consecutive words of one document; a word goes if some window over it has a word sequence that
also starts anywhere else. Windows are judged on the input.

1. Candidates. Each window has one anchor: of its phrases of `phrase` words the one with the smallest hash. Equal windows
   have equal anchors, so only windows whose anchor recurs can recur. The anchors of all documents (about two in
   `window - phrase + 2` words) go, packed by hash shard, to the shard of their hash, which tells each document bucket those
   that were met twice or more anywhere.
2. Confirmation. Each bucket sends the hashes of its candidate windows to shards, and keeps the words of one place of each.
   Shards confirm those met twice or more, name for each window one bucket that owns it, and tell the owner which buckets
   have it. Owners cut the words they kept into passages, runs of confirmed windows that the same buckets have, and send
   each to those buckets. So a window stands in one passage alone.
3. Location. Each bucket compiles phrases of the passages that it received, one in every `window - phrase + 1` words, so that
   each window holds one, into Aho-Corasick automata of at most SHARD_PHRASES phrases, and streams its documents through
   them. Where a phrase is located the words around it are compared with the passage's, and the stretches of `window` words
   or more on which both agree lose their words. Hashes of windows decide nothing here.

Traffic is packed arrays and passages; a phrase or window that is everywhere is one number per bucket, a passage one row per
bucket. The texts are shuffled once (steps 2 and 3 share the exchange). Words are compared by 64-bit hashes.

Nulls: a null text has no words and stays null. Texts shorter than a window stay as they are; very long ones are one row of
their bucket. Repeated rows repeat each other's windows and lose them. Ties of hashes change nothing: anchors at all places
of the smallest hash count. An empty table gives no rows. All other columns pass through, whatever their names, but for
n_words, n_removed and kept_sha256, which are replaced.
"""

from __future__ import annotations

import hashlib
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusflow.llm.common import forget, materialize, read_table, slices, unused
from corpusflow.llm.wordhash import Words, mix, ngram_hashes, ngram_places, words_of

PACKED = "shard int, hashes binary, buckets binary, counts binary"


def _window_minimum(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of `width` values from each place on, for as many places as have so many, by doubling."""
    out, done = values, 1
    while done < width:
        step = min(done, width - done)
        out = np.minimum(out[:-step], out[step:])
        done += step
    return out


class Anchors:
    """Phrase hashes by place, each window's smallest, and which words start a window."""

    def __init__(self, words: Words, window: int, phrase: int):
        self.span = window - phrase + 1
        self.phrases = ngram_hashes(words.hashes, phrase)
        self.least = _window_minimum(self.phrases, self.span)
        self.starts = np.flatnonzero(ngram_places(words.first, window))
        self.least = self.least[self.starts]

    def chosen(self) -> np.ndarray:
        """Places of the windows' smallest hashes."""
        marks = np.zeros(len(self.phrases), bool)
        for j in range(self.span):
            at = self.starts + j
            marks[at[self.phrases[at] == self.least]] = True
        return np.flatnonzero(marks)


def _blobs(arrays: list[np.ndarray]) -> pa.Array:
    return pa.array([x.tobytes() for x in arrays], pa.binary())


def _cuts(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where runs of equal values begin and end."""
    cut = np.flatnonzero(np.concatenate([[True], values[1:] != values[:-1]])) if len(values) else np.zeros(0, np.int64)
    return cut, np.append(cut[1:], len(values)) if len(values) else cut


def _merged(hashes: np.ndarray, buckets: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (hash, bucket) in order, with the sum of their counts, 2 for more."""
    order = np.lexsort((buckets, hashes))
    h, b = hashes[order], buckets[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (b[1:] != b[:-1])
    at = np.flatnonzero(new)
    n = np.add.reduceat(counts[order].astype(np.int64), at) if len(at) else np.zeros(0, np.int64)
    return h[at], b[at], np.minimum(n, 2).astype(np.uint8)


def _pack(hashes: np.ndarray, buckets: np.ndarray, shards: int) -> pa.Table:
    """Distinct hashes of each bucket with their number, 2 for more, one row a shard."""
    h, b, n = _merged(hashes, buckets.astype(np.int32), np.ones(len(hashes), np.uint8))
    shard = ((h >> np.uint64(33)) % np.uint64(shards)).astype(np.int32)
    order = np.argsort(shard, kind="stable")
    h, b, n, shard = h[order], b[order], n[order], shard[order]
    cut, ends = _cuts(shard)
    parts = lambda x: _blobs([x[i:j] for i, j in zip(cut, ends)])
    return pa.table({"shard": pa.array(shard[cut], pa.int32()), "hashes": parts(h), "buckets": parts(b), "counts": parts(n)})


def _unpack(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    kinds = {"hashes": np.uint64, "buckets": np.int32, "counts": np.uint8}
    return _merged(*(np.frombuffer(b"".join(table.column(c).to_pylist()), k) for c, k in kinds.items()))


def _twice(h: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Of each (hash, bucket), in order of hash: whether the hash was met at least twice in all."""
    cut, ends = _cuts(h)
    return np.repeat(np.add.reduceat(n.astype(np.int64), cut) >= 2, ends - cut) if len(h) else np.zeros(0, bool)


def _recurring(packed: DataFrame) -> DataFrame:
    """For each bucket the hashes that it sent and that were met at least twice in all."""

    def judge(table: pa.Table) -> pa.Table:
        h, b, n = _unpack(table)
        keep = _twice(h, n)
        h, b = h[keep], b[keep]
        order = np.argsort(b, kind="stable")
        h, b = h[order], b[order]
        cut, ends = _cuts(b)
        return pa.table({"bucket": pa.array(b[cut], pa.int32()), "hashes": _blobs([h[i:j] for i, j in zip(cut, ends)])})

    return packed.groupBy("shard").applyInArrow(judge, "bucket int, hashes binary")


def _owned(packed: DataFrame) -> DataFrame:
    """For each bucket the recurring hashes that it owns, being the first of their buckets, the number of buckets that have
    each, and those buckets."""

    def judge(table: pa.Table) -> pa.Table:
        h, b, n = _unpack(table)
        keep = _twice(h, n)
        h, b = h[keep], b[keep]
        cut, ends = _cuts(h)
        owner, size = b[cut], ends - cut
        order = np.argsort(owner, kind="stable")
        lo, hi = _cuts(owner[order])
        rows = [order[i:j] for i, j in zip(lo, hi)]
        places = [b[np.repeat(cut[o] - np.concatenate([[0], np.cumsum(size[o])[:-1]]), size[o]) + np.arange(size[o].sum())] for o in rows]
        return pa.table({
            "bucket": pa.array(owner[order][lo], pa.int32()), "hashes": _blobs([h[cut[o]] for o in rows]),
            "sizes": _blobs([size[o].astype(np.int32) for o in rows]), "places": _blobs(places),
        })

    return packed.groupBy("shard").applyInArrow(judge, "bucket int, hashes binary, sizes binary, places binary")


def _members(sorted_set: np.ndarray, values: np.ndarray) -> np.ndarray:
    if not len(sorted_set):
        return np.zeros(len(values), bool)
    at = np.minimum(np.searchsorted(sorted_set, values), len(sorted_set) - 1)
    return sorted_set[at] == values


def _gathered(table: pa.Table) -> np.ndarray:
    return np.unique(np.frombuffer(b"".join(table.column("hashes").to_pylist()), np.uint64))


def _texts(column) -> list[str]:
    return [x if x is not None else "" for x in column.to_pylist()]


#: Phrases of one automaton; more of them make more automata over the same texts.
SHARD_PHRASES = 40_000
#: Pairs of a located phrase and a place of it in a passage that are compared at once.
PAIRS = 1 << 20


def _fenced(words: Words, fence: int) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes with a fence before each text and at the end, and the place of each word among them."""
    out = np.full(len(words.hashes) + len(words.first), fence, np.uint64)
    solid = np.ones(len(out), bool)
    solid[words.first + np.arange(len(words.first))] = False
    at = np.flatnonzero(solid)
    out[at] = words.hashes
    return out, at


def _letters(fenced: np.ndarray, known: np.ndarray) -> str:
    """Three characters a word: the digits of its number among the known words, each place of the number with digits of its
    own; any other word, and a fence, is three zeros. So an occurrence is one of whole words within one text, and a node of
    an automaton has few children, which it searches one by one."""
    base = int(np.ceil(len(known) ** (1 / 3))) + 1
    number = np.searchsorted(known, fenced)
    digits = np.stack([number // base**2, number // base % base + base, number % base + 2 * base], axis=1) + 1
    digits[~_members(known, fenced)] = 0
    return digits.astype("<u4").tobytes().decode("utf-32-le", "surrogatepass")


def locate_passages(words: Words, passages: Words, window: int, phrase: int) -> np.ndarray:
    """Marks of the words of texts that lie in a stretch of `window` words or more of a passage.

    Automata hold the phrases that start at every (window - phrase + 1)-th word of each passage; each window of a passage
    holds one of them. Where one is found the words before and after it are compared, as far as windows over it reach.
    """
    import ahocorasick

    reach = window - phrase
    gone = np.zeros(len(words.hashes) + 1, np.int64)
    text, text_at = _fenced(words, 0)
    own, own_at = _fenced(passages, 1)
    word_of = np.full(len(text), -1)
    word_of[text_at] = np.arange(len(text_at))
    size = np.diff(passages.first)
    seeds = [np.arange(a, z - phrase + 1, reach + 1) for a, z in zip(passages.first[:-1].tolist(), passages.first[1:].tolist()) if z - a >= window]
    seeds = own_at[np.concatenate(seeds)] if seeds else np.zeros(0, np.int64)
    assert len(size) == 0 or size.min() >= window
    for lo in range(0, len(seeds), SHARD_PHRASES):
        places = seeds[lo : lo + SHARD_PHRASES]
        known = np.unique(own[(places[:, None] + np.arange(phrase)).ravel()])
        spelled = _letters(own, known)
        automaton, of = ahocorasick.Automaton(ahocorasick.STORE_INTS), {}
        for place in places.tolist():
            of.setdefault(spelled[3 * place : 3 * (place + phrase)], []).append(place)
        for number, key in enumerate(of):
            automaton.add_word(key, number)
        automaton.make_automaton()
        located = np.array(list(automaton.iter(_letters(text, known))), np.int64).reshape(-1, 2)
        begin, which = located[:, 0] // 3 - phrase + 1, located[:, 1]
        each = np.array([len(x) for x in of.values()])
        first = np.concatenate([[0], np.cumsum(each)])
        every = np.array([x for some in of.values() for x in some], np.int64)
        for a, z in slices(len(begin), each[which], PAIRS):
            n = each[which[a:z]]
            x = np.repeat(begin[a:z], n)
            y = every[np.repeat(first[which[a:z]] - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())]
            back, on = np.zeros(len(x), np.int64), np.zeros(len(x), np.int64)
            for count, step in ((back, -1), (on, 1)):
                alive, far = np.arange(len(x)), phrase - 1 if step > 0 else 0
                for k in range(1, reach + 1):
                    alive = alive[text[x[alive] + step * k + far] == own[y[alive] + step * k + far]]
                    if not len(alive):
                        break
                    count[alive] = k
            fits = back + on >= reach
            np.add.at(gone, word_of[x[fits] - back[fits]], 1)
            np.add.at(gone, word_of[x[fits] + phrase - 1 + on[fits]] + 1, -1)
    return np.cumsum(gone)[:-1] > 0


def drop_repeats(docs: DataFrame, window: int = 35, phrase: int = 12, bucket_bytes: int = 8 << 20, least_buckets: int = 64, shard_bytes: int = 256 << 20) -> DataFrame:
    """docs with text less its repeated words (the kept ones joined by one space; unchanged if none goes), and
    n_words, n_removed and kept_sha256 (of the kept words joined by one space) added."""
    columns, bucket_column = docs.columns, unused(docs, "__bucket")
    total = docs.agg(F.sum(F.octet_length(F.col("text").cast("string")))).first()[0] or 0
    buckets = max(least_buckets, -(-total // bucket_bytes))
    shards = max(16, total // shard_bytes)
    dealt = docs.withColumn("text", F.col("text").cast("string")).withColumn(bucket_column, F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in columns if c in ("doc_id", "text")]), F.lit(buckets)).cast("int"))

    def anchors(batches):
        for batch in batches:
            texts, bucket = _texts(batch.column(1)), batch.column(0).to_numpy(zero_copy_only=False)
            h, b = [], []
            for lo, hi in slices(len(texts), np.array([len(t) + 1 for t in texts]), 1 << 20):
                words = words_of(texts[lo:hi])
                made = Anchors(words, window, phrase)
                at = made.chosen()
                h.append(made.phrases[at])
                b.append(np.repeat(bucket[lo:hi], np.diff(words.first))[at])
            if h:
                yield from _pack(np.concatenate(h), np.concatenate(b), shards).to_batches()

    def candidates(left: pa.Table, right: pa.Table) -> pa.Table:
        """Packed hashes of a bucket's candidate windows, and the words of the first place of each."""
        known, texts = _gathered(right), _texts(left.column("text"))
        h, runs, seen = [], [], np.zeros(0, np.uint64)
        for lo, hi in slices(len(texts), np.array([len(t) + 1 for t in texts]), bucket_bytes):
            words = words_of(texts[lo:hi])
            made = Anchors(words, window, phrase)
            some = _members(known, made.least)
            starts, own = made.starts[some], ngram_hashes(words.hashes, window)[made.starts[some]]
            h.append(own)
            new, at = np.unique(own, return_index=True)
            at = np.sort(at[~_members(seen, new)])
            seen = np.union1d(seen, new)
            places = starts[at]
            cut, ends = _cuts(places - np.arange(len(places)))
            runs += [words.data[words.begin[places[i]] : words.end[places[j - 1] + window - 1]].tobytes() for i, j in zip(cut, ends)]
        bucket = left.column(bucket_column)[0].as_py() if left.num_rows else 0
        h = np.concatenate(h) if h else np.zeros(0, np.uint64)
        packed = _pack(h, np.full(len(h), bucket, np.int32), shards)
        nothing = lambda kind, n: pa.nulls(n, kind)
        return pa.table({
            "bucket": pa.concat_arrays([nothing(pa.int32(), packed.num_rows), pa.array([bucket], pa.int32())]),
            "runs": pa.concat_arrays([nothing(pa.list_(pa.binary()), packed.num_rows), pa.array([runs], pa.list_(pa.binary()))]),
            **{c: pa.concat_arrays([packed.column(c).combine_chunks(), nothing(packed.column(c).type, 1)]) for c in packed.column_names},
        })

    def passages(left: pa.Table, right: pa.Table) -> pa.Table:
        """left: runs of a bucket; right: the windows that it owns. The passages that it sends, and to which buckets."""
        blob = lambda c, kind: np.frombuffer(b"".join(right.column(c).to_pylist()), kind)
        owned, sizes, places = blob("hashes", np.uint64), blob("sizes", np.int32), blob("places", np.int32)
        ends = np.cumsum(sizes)
        order = np.argsort(owned)
        words = words_of([r.decode("utf-8", "surrogatepass") for some in left.column("runs").to_pylist() for r in some])
        starts = np.flatnonzero(ngram_places(words.first, window))
        h = ngram_hashes(words.hashes, window)[starts]
        mine = _members(owned[order], h)
        starts, at = starts[mine], order[np.searchsorted(owned[order], h[mine])]
        # windows that the same buckets have, by the sum of the buckets' hashes
        having = np.add.reduceat(mix(places.astype(np.uint64)), ends - sizes) if len(sizes) else np.zeros(0, np.uint64)
        having = having[at]
        new = np.ones(len(starts), bool)
        new[1:] = (starts[1:] != starts[:-1] + 1) | (having[1:] != having[:-1])
        cut = np.flatnonzero(new)
        to, out = [], []
        for i, j in zip(cut.tolist(), np.append(cut[1:], len(starts)).tolist()):
            own = words.data[words.begin[starts[i]] : words.end[starts[j - 1] + window - 1]].tobytes()
            dests = places[ends[at[i]] - sizes[at[i]] : ends[at[i]]].tolist()
            to += dests
            out += [own] * len(dests)
        return pa.table({"bucket": pa.array(to, pa.int32()), "passage": pa.array(out, pa.binary())})

    def remove(left: pa.Table, right: pa.Table) -> pa.Table:
        texts = _texts(left.column("text"))
        known = words_of([x.decode("utf-8", "surrogatepass") for x in right.column("passage").to_pylist()])
        out, n_words, n_removed, digests = left.column("text").to_pylist(), [], [], []
        for lo, hi in slices(len(texts), np.array([len(t) + 1 for t in texts]), bucket_bytes):
            words = words_of(texts[lo:hi])
            gone = locate_passages(words, known, window, phrase)
            lost_by = np.diff(np.concatenate([[0], np.cumsum(gone)])[words.first])
            for i, (a, z, lost) in enumerate(zip(words.first[:-1].tolist(), words.first[1:].tolist(), lost_by.tolist())):
                every = texts[lo + i].translate(_TO_SPACE).split(" ")
                kept = " ".join(compress(filter(None, every), (~gone[a:z]).tolist()) if lost else filter(None, every))
                if lost:
                    out[lo + i] = kept
                n_words.append(z - a)
                n_removed.append(lost)
                digests.append(hashlib.sha256(kept.encode("utf-8", "surrogatepass")).hexdigest())
        made = {c: (pa.array(out, pa.string()) if c == "text" else left.column(c)) for c in columns}
        made |= {"n_words": pa.array(n_words, pa.int64()), "n_removed": pa.array(n_removed, pa.int64()), "kept_sha256": pa.array(digests, pa.string())}
        return pa.table({f.name: made[f.name] for f in result.fields})

    from pyspark.sql.types import LongType, StringType, StructField, StructType

    own = [StructField("n_words", LongType()), StructField("n_removed", LongType()), StructField("kept_sha256", StringType())]
    result = StructType([*(f for f in dealt.drop(bucket_column).schema.fields if f.name not in {x.name for x in own}), *own])
    phrases = _recurring(dealt.select(bucket_column, "text").mapInArrow(anchors, PACKED))
    grouped = dealt.groupBy(bucket_column)
    found = f"bucket int, runs array<binary>, {PACKED}"
    found = materialize(grouped.cogroup(phrases.groupBy("bucket")).applyInArrow(candidates, found), "repeat-candidates")
    owned = _owned(found.where("shard is not null").select("shard", "hashes", "buckets", "counts"))
    runs = found.where("shard is null").select("bucket", "runs")
    sent = runs.groupBy("bucket").cogroup(owned.groupBy("bucket")).applyInArrow(passages, "bucket int, passage binary")
    sent = materialize(sent, "repeat-passages")
    forget(found)
    return grouped.cogroup(sent.groupBy("bucket")).applyInArrow(remove, result)


_TO_SPACE = {c: " " for c in range(9, 14)}


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drop_repeats(read_table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "n_words", "n_removed", "kept_sha256")
