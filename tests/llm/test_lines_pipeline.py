"""Line templates against a plain implementation; the pipeline's stages one by one."""

import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from corpusflow.llm import linededup
from tests.llm.fixtures import SF, SF01, documents

SPLIT = re.compile(r"[\x20\x09-\x0D]+")


def brute_lines(rows, p=linededup.Lines()):
    """{text: (n_lines, kept text, dropped, spared)}: a tree of dictionaries, filled line by line."""
    parsed = {t or "": [["<*>" if re.search("[0-9]", x) else x for x in SPLIT.split(line) if x] for line in (t or "").split("\n")] for _, t in rows}
    documents_of = defaultdict(set)
    for text, lines in parsed.items():
        for tokens in lines:
            documents_of[tuple(tokens)].add(text)
    gone = {t for t, d in documents_of.items() if t and len(d) >= p.min_docs}
    leaves = defaultdict(set)
    for t, d in documents_of.items():
        leaves[len(t), t[: p.depth]] |= d
    nodes = defaultdict(set)
    for t in documents_of:
        m = len(t) - p.depth
        vary = int(m * (1 - p.similarity)) if m > 0 else 0
        if t not in gone and vary and len(leaves[len(t), t[: p.depth]]) >= p.min_docs:
            for k in range(vary + 1):
                lo, hi = k * m // (vary + 1), (k + 1) * m // (vary + 1)
                nodes[len(t), t[: p.depth], k, t[p.depth + lo : p.depth + hi]].add(t)
    shared = {k: len(set().union(*(documents_of[t] for t in own))) for k, own in nodes.items() if len(own) > 1}
    best = defaultdict(list)
    for k in sorted((k for k, n in shared.items() if n >= p.min_docs), key=lambda k: k[2]):
        for t in nodes[k]:
            best[t].append(k)
    chosen = defaultdict(set)
    for t, keys in best.items():
        chosen[max(keys, key=lambda k: shared[k])].add(t)
    for own in chosen.values():
        count = Counter()
        for t in own:
            for i, x in enumerate(t[p.depth :]):
                count[i, x] += len(documents_of[t])
        alike = defaultdict(list)
        for t in own:
            general = tuple(x if count[i, x] >= p.min_docs else None for i, x in enumerate(t[p.depth :]))
            if sum(x is not None for x in general) >= p.similarity * len(general):
                alike[general].append(t)
        for some in alike.values():
            if len(set().union(*(documents_of[t] for t in some))) >= p.min_docs:
                gone |= set(some)
    out = {}
    for text, lines in parsed.items():
        found = [i for i, t in enumerate(lines) if t and tuple(t) in gone]
        spared = sum(len(lines[i]) for i in found) >= p.most * sum(map(len, lines))
        kept = text if spared else "\n".join(x for i, x in enumerate(text.split("\n")) if i not in found)
        out[text] = sum(map(bool, lines)), kept, 0 if spared else len(found), len(found) if spared else 0
    return out


@pytest.mark.parametrize("source", ["awkward", SF, SF01])
def test_recurring_lines(spark, source):
    if source == "awkward":
        extra = [(500 + i, " ".join(own_text(i)) + f"\nPosted by user {i} on page {i} today\nShare this with all of your {'friends' if i % 3 else 'family'} right now\nlast words of {chr(97 + i)} text", "en", "a", 0) for i in range(20)]
        from tests.llm.fixtures import awkward_documents

        docs = documents(spark, awkward_documents() + extra)
    else:
        docs = spark.read.parquet(f"{source}/documents.parquet")
    expected = brute_lines([(r["doc_id"], r["text"]) for r in docs.collect()])
    got = linededup.drop_recurring_lines(docs.withColumn("before", F.col("text")).withColumn("n_dropped", F.lit("clash")))
    rows = got.collect()
    assert len(rows) == docs.count()
    for r in rows:
        assert (r["n_lines"], r["text"] or "", r["n_dropped"], r["n_spared"]) == expected[r["before"] or ""] and (r["text"] is None) == (r["before"] is None), r["doc_id"]
    assert sum(r["n_dropped"] for r in rows) > 0


def word(i, k=""):
    return f"{chr(97 + i % 26)}{chr(97 + i // 26 % 26)}{k}"


def own_text(i, lines=3):
    return [" ".join(word(i * 31 + k * 7 + j, f"o{chr(97 + k)}") for j in range(12)) for k in range(lines)]


def dropped(spark, texts):
    return linededup.drop_recurring_lines(documents(spark, [(i, t, "en", "a", 0) for i, t in enumerate(texts)])).orderBy("doc_id").collect()


BODY = [f"line {chr(97 + i)} with words of its own {chr(98 + i)}{chr(99 + i)}" for i in range(8)]


@pytest.mark.parametrize("where", ["title", "last line", "byline", "first token", "third token", "anywhere"])
def test_texts_that_documents_share_stay(spark, where):
    """Documents that have most of their words in common lose no line, wherever they differ."""
    texts = []
    for i in range(60):
        own = f"{word(i, 'a')} {word(i, 'b')} is its own"
        lines = {"title": [own, *BODY], "last line": [*BODY, own], "byline": [own, f"{word(i, 'c')} wrote this", *BODY], "first token": [*BODY[:4], f"{word(i)} edited here", *BODY[4:]],
                 "third token": [*BODY[:4], f"edited here {word(i)} only", *BODY[4:]], "anywhere": [x.replace("words", word(i, "w")) if k == i % 8 else x for k, x in enumerate(BODY)]}[where]
        texts.append("\n".join(lines))
    got = dropped(spark, texts)
    assert [r["text"] for r in got] == texts and all(r["n_dropped"] == 0 and r["n_spared"] >= 7 for r in got)


def test_shared_bodies_stand_after_the_pipeline(spark):
    """A body below titles of their own is in one document at least once near copies are gone."""
    docs = spark.read.parquet(f"{SF01}/documents.parquet").where("doc_id < 300")
    fine = corpus_pipeline.quality_rules(spark, docs, SF01).where("n_chars between 2000 and 5000 and size(split(text, '\n')) > 4")
    body = fine.orderBy("doc_id").first()
    made = documents(spark, [(10**6 + i, f"Title {word(i)} of {word(i, 'x')}\n{body['text']}", body["lang"], body["source"], 0) for i in range(20)])
    docs = docs.where(F.col("text") != body["text"]).unionByName(made.withColumn("n_chars", F.length("text").cast("long")))
    for name, stage in corpus_pipeline.STAGES[:3]:
        docs = corpus_pipeline.materialize(stage(spark, docs, SF01), "test")
        left = [r["text"] for r in docs.where("doc_id >= 1000000").collect()]
        assert len(left) == (1 if name == "minhash_dedup" else 20) and all(body["text"] in t for t in left)


def test_notices_go_whatever_copies_there_are(spark):
    """A notice of any number of lines in texts of their own goes; exact and near copies of one such text shield nothing."""
    for size in (1, 2, 5):
        notice = [f"the notice has {w} words here" for w in ("some", "many", "few", "no", "more")][:size]
        texts = ["\n".join([*own_text(i), *notice, *own_text(i + 500)] if i % 2 else [*own_text(i), "", *own_text(i + 500), "", *notice]) for i in range(40)]
        copies = [texts[0]] * 200 + [texts[1].replace(word(0, "oa"), f"edit{word(i)}") for i in range(200)]
        got = dropped(spark, texts + copies)
        assert all(r["n_dropped"] == size and "notice" not in r["text"] for r in got[:40] if r["doc_id"] != 1)


def test_a_leaf_holds_several_templates(spark):
    """Two templates of the same length and leading tokens, and lines that share those alone."""
    texts = []
    for i in range(50):
        texts += ["\n".join([*own_text(i), f"Posted by {word(i)} in the forum today"]), "\n".join([*own_text(i + 200), f"Posted by {word(i)} at our website yesterday"])]
    texts += ["\n".join([*own_text(i + 400), f"Posted by {word(i, 'k')} {word(i, 'l')} {word(i, 'm')} {word(i, 'n')} {word(i, 'p')}"]) for i in range(50)]
    got = dropped(spark, texts)
    assert [r["n_dropped"] for r in got] == [1] * 100 + [0] * 50


def test_leading_tokens_are_no_likeness(spark):
    """Short sentences with the same beginning, and long ones whose fields vary beyond the similarity, stay."""
    texts = ["\n".join([*own_text(i), f"It was a {word(i)}.", f"They saw the {word(i, 'x')} and {word(i, 'y')} there {word(i, 'z')}"]) for i in range(40)]
    assert all(r["n_dropped"] == 0 for r in dropped(spark, texts))


def test_one_document_with_many_lines_of_a_template(spark):
    """Recurring is across documents: twenty lines of one template in one document are one."""
    texts = ["\n".join([*own_text(0, 9), *(f"Sent from {word(k)} to the office today" for k in range(20))])] + ["\n".join(own_text(i + 60)) for i in range(20)]
    assert all(r["n_dropped"] == 0 for r in dropped(spark, texts))
    assert linededup.drop_recurring_lines(documents(spark, [])).collect() == []


def test_lines_by_hash_when_they_are_many(spark):
    """The joins beyond the broadcast bound give the same rows."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    one, two = (sorted(tuple(r) for r in linededup.drop_recurring_lines(docs, linededup.Lines(broadcast_rows=n)).collect()) for n in (0, 500_000))
    assert one == two


def test_lines_are_native(spark):
    plan = linededup.drop_recurring_lines(documents(spark))._jdf.queryExecution().toString()
    assert not any(x in plan for x in ("Python", "Arrow", "Pandas"))


def test_pipeline(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, before = docs.columns, docs.count()
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "line_dedup", "minhash_dedup", "substring_dedup", "best_fit_packing"]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = corpus_pipeline.materialize(stage(spark, docs, SF), "test")
        assert out.columns == columns and [t for _, t in out.dtypes] == [t for _, t in docs.dtypes]
        if name in ("line_dedup", "substring_dedup"):
            assert out.count() == docs.count()
        assert out.where("n_chars <> length(text)").isEmpty() or name == "quality_rules"
        docs = out
    assert 0 < docs.count() < before
    assert {r["doc_id"] for r in corpus_pipeline.run(spark, SF).select("doc_id").distinct().collect()} == {r["doc_id"] for r in docs.collect()}


def test_pipeline_of_awkward_rows(spark, tmp_path):
    documents(spark).unionByName(documents(spark, [(None, None, None, None, None), (None, "x " * 100, None, None, 1)])).write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() > 0
    documents(spark, []).write.parquet(f"{tmp_path}/none/documents.parquet")
    assert corpus_pipeline.run(spark, f"{tmp_path}/none").count() == 0


def test_rows_that_repeat_an_id_or_have_none_leave_one_row(spark):
    """Rows loaded twice, copies without ids and near copies of either; unlike texts of one id both stay."""
    text = lambda k: " ".join(f"{k}{i}" for i in range(60))
    rows = [(1, text("a")), (1, text("a")), (2, text("b")), (None, text("c")), (None, text("c")), (None, text("c") + " end"), (None, text("b")), (3, text("d")), (3, text("e")), (4, text("f")), (4, text("f") + " end"), (5, None), (5, None)]
    docs = documents(spark, [(i, t, "en", "a", 0) for i, t in rows])
    out = corpus_pipeline.materialize(corpus_pipeline.minhash_dedup(spark, docs, SF), "test")
    got = [(r["doc_id"], r["text"] and r["text"][0]) for r in out.collect()]
    assert sorted(got, key=str) == sorted([(1, "a"), (2, "b"), (None, "c"), (3, "d"), (3, "e"), (4, "f"), (5, None)], key=str)
    left = corpus_pipeline.substring_dedup(spark, out, SF).where("text is not null")
    assert left.where("text = ''").isEmpty() and left.count() == 6


def test_pipeline_end_to_end(spark):
    """All stages over the small tables against plain implementations one after the other, up to the ids of every piece."""
    import zlib

    import numpy as np
    import public_tokenizers
    from tokenizers import Tokenizer

    from corpusflow.llm.quality import judge_quality
    from tests.llm.test_dedup import WORD, brute_components

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = judge_quality(docs).where("kept").select("row.doc_id", "row.text").collect()  # verdicts are tested on their own
    lines = brute_lines([tuple(r) for r in kept])
    texts = {r["doc_id"]: lines[r["text"] or ""][1] for r in kept}
    groups = brute_components(list(texts.items()))
    texts = {d: t for d, t in texts.items() if groups[d][1] == d}
    words, starts = {d: WORD.findall(t) for d, t in texts.items()}, Counter()
    for w in words.values():
        starts.update(tuple(w[i : i + 35]) for i in range(len(w) - 34))
    library, expected = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")), set()
    for d, w in words.items():
        gone = {i + j for i in range(len(w) - 34) if starts[tuple(w[i : i + 35])] > 1 for j in range(35)}
        ids = [*library.encode(" ".join(x for i, x in enumerate(w) if i not in gone) if gone else texts[d], add_special_tokens=False).ids, 2]
        first = (len(ids) - 1) % 1024 + 1
        for k, lo in enumerate([0, *range(first, len(ids), 1024)]):
            own = ids[lo : lo + 1024 if k else first]
            expected.add((d, k, lo, len(own), zlib.crc32(np.array(own, "<u4").tobytes())))
    got = corpus_pipeline.run(spark, SF)
    assert {tuple(r) for r in got.select("doc_id", "piece", "start", "length", "ids_crc32").collect()} == expected and got.count() == len(expected)


def test_stages_carry_clashing_columns(spark):
    """Columns named like the operators' own pass through every stage that keeps documents; nulls in them too."""
    names = ("row", "key", "id", "unit", "shard", "bucket", "leaf", "template", "kept", "fence", "n_words", "__id", "__key", "__drop", "__bucket", "part", "component_id")
    docs = documents(spark).withColumns({c: F.lit("x") if i % 2 else F.lit(None).cast("int") for i, c in enumerate(names)})
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = corpus_pipeline.materialize(stage(spark, docs, SF), "test")
        assert out.columns == docs.columns and out.dtypes == docs.dtypes and out.count() > 0
        assert corpus_pipeline.materialize(stage(spark, docs.limit(0), SF), "test").count() == 0
