"""Near-duplicates, repeated passages and quality rules against brute force."""

import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from corpusflow.llm import neardup, quality, substrings
from corpusflow.llm.wordhash import words_of
from tests.llm.fixtures import SF, SF01, SCHEMA, documents, prose

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute_components(rows):
    """{doc_id: (n_shingles, component)} from all pairs that share a shingle."""
    sets, owners = defaultdict(set), defaultdict(set)
    for doc_id, text in rows:
        words = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
        own = {tuple(words[i : i + 5]) for i in range(len(words) - 4)} if len(words) >= 5 else {tuple(words)} if words else set()
        sets[doc_id] |= own
    for d, s in sets.items():
        for x in s:
            owners[x].add(d)
    parent = {d: d for d in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for d, s in sets.items():
        for e, both in Counter(e for x in s for e in owners[x] if e > d).items():
            if 100 * both >= 75 * (len(s) + len(sets[e]) - both):
                a, b = sorted((find(d), find(e)))
                parent[b] = a
    return {d: (len(s), find(d)) for d, s in sets.items()}


@pytest.mark.parametrize("source", ["awkward", SF, SF01])
def test_near_duplicates(spark, source):
    docs = documents(spark) if source == "awkward" else spark.read.parquet(f"{source}/documents.parquet")
    expected = brute_components([(r["doc_id"], r["text"]) for r in docs.collect()])
    got = neardup.near_duplicates(docs).collect()
    assert len(got) == docs.count()
    wrong = [r for r in got if (r["n_shingles"], r["component_id"], r["kept"]) != (*expected[r["doc_id"]], r["doc_id"] == expected[r["doc_id"]][1])]
    assert not wrong


def test_near_duplicate_chains_and_hot_buckets(spark):
    """A large family around one text whose members are not all alike, so that stars do not suffice."""
    rng = random.Random(5)
    base = prose(rng, 150, 5000).split()
    rows = []
    for i in range(700):
        words = list(base)
        for _ in range(rng.randint(0, 5)):
            words[rng.randrange(150)] = f"x{rng.randrange(10**6)}"
        rows.append((1000 - i, " ".join(words), "en", "a", 0))
    rows += [(5000 + i, prose(rng, 100, 5000), "en", "a", 0) for i in range(50)]
    expected = brute_components([r[:2] for r in rows])
    got = neardup.near_duplicates(documents(spark, rows), neardup.NearDup(block=64)).collect()
    wrong = [r for r in got if r["component_id"] != expected[r["doc_id"]][1]]
    assert len(wrong) <= 2, len(wrong)  # pairs near the threshold may be pruned at the chosen miss probability


def test_families_just_under_the_threshold(spark):
    """Thirty families of one text, about 70 % alike to each other, share buckets; members of one family are links."""
    rng = random.Random(9)
    base = prose(rng, 300, 9000).split()
    rows = []
    for family in range(30):
        own = list(base)
        for at in rng.sample(range(0, 300, 6), 11):
            own[at] = f"f{family}x{at}"
        for member in range(12):
            words = list(own)
            words[rng.randrange(300)] = f"m{family}y{member}"
            rows.append((100 * member + family, " ".join(words), "en", "a", 0))
    expected = brute_components([r[:2] for r in rows])
    assert len({c for _, c in expected.values()}) > 10
    for block in (64, 2048):
        got = neardup.near_duplicates(documents(spark, rows), neardup.NearDup(block=block)).collect()
        assert not [r for r in got if r["component_id"] != expected[r["doc_id"]][1]]


def test_near_duplicates_ignore_other_columns(spark):
    clashing = {c: F.lit("x") for c in ("id", "band", "key", "size", "component", "set_hash", "sig", "unit")}
    docs = documents(spark)
    a, b = (neardup.near_duplicates(d) for d in (docs, docs.withColumns(clashing)))
    assert sorted(map(tuple, a.collect()), key=str) == sorted(map(tuple, b.collect()), key=str)


def test_near_duplicates_of_nothing(spark):
    assert neardup.near_duplicates(documents(spark, [])).collect() == []
    got = neardup.near_duplicates(documents(spark, [(None, "a b c d e f", "en", "a", 1), (1, "a b c d e f", "en", "a", 1)])).collect()
    assert {(r["doc_id"], r["component_id"], r["kept"]) for r in got} == {(None, None, True), (1, 1, True)}


def brute_repeats(rows, window=35):
    starts = Counter()
    split = [(d, WORD.findall(t or "")) for d, t in rows]
    for _, w in split:
        starts.update(tuple(w[i : i + window]) for i in range(len(w) - window + 1))
    out = []
    for d, w in split:
        gone = set()
        for i in range(len(w) - window + 1):
            if starts[tuple(w[i : i + window])] > 1:
                gone.update(range(i, i + window))
        out.append((d, len(w), len(gone), hashlib.sha256(" ".join(x for i, x in enumerate(w) if i not in gone).encode()).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("source", ["awkward", SF, SF01])
def test_repeated_passages(spark, source):
    docs = documents(spark) if source == "awkward" else spark.read.parquet(f"{source}/documents.parquet")
    got = substrings.drop_repeats(docs, bucket_bytes=50_000)
    assert got.columns[: len(docs.columns)] == docs.columns
    rows = got.select("doc_id", "n_words", "n_removed", "kept_sha256").collect()
    assert sorted(map(tuple, rows), key=str) == brute_repeats([(r["doc_id"], r["text"]) for r in docs.collect()])


def test_repeats_of_small_vocabularies(spark):
    """Texts of few words repeat in every way: overlapping, periodic, nested, across buckets."""
    rng = random.Random(11)
    rows = [(i, " ".join(rng.choice("abc") for _ in range(rng.randint(0, 60))), "en", "a", 0) for i in range(150)]
    rows += [(200 + i, " ".join(["x", "y"][k % 2] for k in range(40 + i)), "en", "a", 0) for i in range(6)] + [(300, "z " * 500, "en", "a", 0)]
    for window, phrase in ((6, 3), (9, 2), (5, 5)):
        got = substrings.drop_repeats(documents(spark, rows), window, phrase, bucket_bytes=300).select("doc_id", "n_words", "n_removed", "kept_sha256").collect()
        assert sorted(map(tuple, got), key=str) == brute_repeats([r[:2] for r in rows], window)


def test_automata_locate_by_themselves(monkeypatch):
    """Words under windows of given passages, in texts of which nothing else is known, with one automaton and with many."""
    rng = random.Random(12)
    passages = [" ".join(rng.choice("abcdefgh") for _ in range(n)) for n in (35, 36, 90)]
    texts = []
    for _ in range(40):
        own = [rng.choice("abcdefgh") for _ in range(rng.randint(0, 80))]
        words = rng.choice(passages).split()
        lo = rng.randint(0, len(words) - 20)
        texts.append(" ".join(own + words[lo : lo + rng.randint(20, 70)] + own))
    windows = {tuple(w[i : i + 35]) for w in (p.split() for p in passages) for i in range(len(w) - 34)}
    expected = []
    for text in texts:
        w = text.split()
        gone = {i + j for i in range(len(w) - 34) if tuple(w[i : i + 35]) in windows for j in range(35)}
        expected += [i in gone for i in range(len(w))]
    assert any(expected) and not all(expected)
    for most in (40_000, 1):
        monkeypatch.setattr(substrings, "SHARD_PHRASES", most)
        assert substrings.locate_passages(words_of(texts), words_of(passages), 35, 12).tolist() == expected
    assert not substrings.locate_passages(words_of(texts), words_of([]), 35, 12).any()


def test_repeated_passages_of_nothing_and_clashing_names(spark):
    assert substrings.drop_repeats(documents(spark, [])).collect() == []
    docs = documents(spark).withColumn("bucket", F.lit("x")).withColumn("n_words", F.lit(None).cast("string")).withColumn("shard", F.lit(1))
    got = substrings.drop_repeats(docs)
    assert got.count() == docs.count() and dict(got.dtypes)["n_words"] == "bigint"


def brute_quality(text):
    text = text or ""
    words = WORD.findall(text)
    three = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    count, hit = Counter(three), set()
    for i, t in enumerate(three):
        if count[t] > 1:
            hit.update((i, i + 1, i + 2))
    lines = [x for x in text.split("\n") if WORD.search(x)]
    n = len(words)
    return n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(hit), n < 50 or 100 * len(hit) > 50 * n


@pytest.mark.parametrize("source", ["awkward", SF])
def test_quality_counts(spark, source):
    docs = documents(spark) if source == "awkward" else spark.read.parquet(f"{source}/documents.parquet")
    texts = defaultdict(set)
    for r in docs.collect():
        texts[r["doc_id"]].add(brute_quality(r["text"]))
    got = quality.judge_quality(docs).select("row.doc_id", "*").collect()
    assert len(got) == docs.count()
    for r in got:
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]) in texts[r["doc_id"]], r
        assert r["kept"] is not None and not (r["base_failed"] and r["kept"])


def quality_band(rows, group, rules, error):
    """For each document its verdicts under fences from exact quantiles of ranks off by `error` either way: (strict, lenient)."""

    def fence(values, sides, floor, off):
        v = sorted(values)
        at = lambda q: v[min(len(v) - 1, max(0, math.ceil(q * len(v)) - 1))]
        lo, hi = at(0.25 - off), at(0.75 + off)
        narrow = at(0.75 + off) - at(0.25 - off)
        slack = max(rules.reach * narrow, floor)
        return (lo - slack if sides == "both" else -math.inf), hi + slack

    base = [r for r in rows if not r["base_failed"]]
    out = {}
    for r in rows:
        pools = [[x for x in base if group(x) == group(r)], [x for x in base if x["lang"] == r["lang"]], base]
        pool = next((x for x in pools[:2] if len(x) >= rules.min_group), base)
        verdicts = []
        for off in (-error, error):
            ok = not r["base_failed"]
            for f, (sides, floor) in quality.FEATURES.items():
                if ok:
                    lo, hi = fence([x[f] for x in pool], sides, floor, off)
                    ok = lo <= r[f] <= hi
            verdicts.append(ok)
        out[r["key"]] = tuple(verdicts)
    return out


@pytest.mark.parametrize("source", [SF, SF01])
@pytest.mark.parametrize("broadcast", [100, 0])
def test_quality_verdicts_against_exact_quantiles(spark, source, broadcast):
    """Fences are those of exact quantiles within the rank error of the sketches, by broadcast and by salted join."""
    rules = quality.Rules(min_group=40, broadcast_groups=broadcast)
    docs = spark.read.parquet(f"{source}/documents.parquet")
    rows = []
    for r in docs.collect():
        n, chars, symbols, dup, repeat, failed = brute_quality(r["text"])
        lines = sum(bool(WORD.search(x)) for x in (r["text"] or "").split("\n"))
        shares = {"mean_word_chars": chars / max(n, 1), "symbol_share": symbols / max(chars, 1), "dup_line_share": dup / max(lines, 1), "repeat_share": repeat / max(n, 1)}
        rows.append({"key": r["doc_id"], "lang": r["lang"], "source": r["source"], "base_failed": failed} | shares)
    expected = quality_band(rows, lambda x: (x["lang"], x["source"]), rules, 0.01)
    got = {r["doc_id"]: r["kept"] for r in quality.judge_quality(docs, rules).select("row.doc_id", "kept").collect()}
    assert got.keys() == expected.keys()
    assert not [k for k, v in got.items() if (expected[k][0] and not v) or (v and not expected[k][1])]
    assert any(not v for v in got.values()) and any(got.values())


def test_a_long_text_has_no_false_repeats(spark):
    text = " ".join(f"w{i}" for i in range(300_000))
    got = quality.judge_quality(documents(spark, [(1, text, "en", "a", 1), (2, text, "en", "a", 1), (3, text + " w1 w2 w3", None, None, None)])).collect()
    assert [r["n_repeat_words"] for r in sorted(got, key=lambda r: r["n_words"])] == [0, 0, 6]


def test_quality_verdicts_follow_the_labels(spark):
    got = quality.op9_adaptive_quality(spark, SF01).join(spark.read.parquet(f"{SF01}/labels.parquet"), "doc_id").where("not base_failed").groupBy("quality", "kept").count().collect()
    n = {(r["quality"], r["kept"]): r["count"] for r in got}
    assert n.get((1, False), 0) <= 0.03 * n[1, True]


def test_quality_of_nothing(spark):
    assert quality.judge_quality(documents(spark, [])).collect() == []
    assert quality.judge_quality(documents(spark, [(1, "a b", None, None, None)])).first()["kept"] is False


def test_native_plan(spark):
    plan = quality.judge_quality(documents(spark))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
