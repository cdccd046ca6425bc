"""Cases of the document pipeline that the tables do not hold."""

import json

import pytest
from pyspark.sql import functions as F

from corpusflow.functions import guards, ids, metrics
from corpusflow.functions.text import number_facts, token_f1
from corpusflow.operators import chunking, cleaning, evaluation, rag, tables, vectors
from corpusflow.plans.text_queries import BIG_TABLES
from corpusflow.sources import files
from corpusflow.sources.collections import Collection
from corpusflow.streaming.ingest import upsert_stream


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_cleaning(spark):
    clean = lambda t: one(spark, cleaning.clean_page(F.lit(t)))
    assert "\r" not in clean("Hello\r\nWorld\r\nTest")["text"]
    assert clean("This is a uni-\nversity policy") == ("This is a university policy", ["fix_hyphenation"])
    assert clean("7\nbody\n3") == ("body", ["removed_page_number_line: 7", "removed_page_number_line: 3", "whitespace_normalization"])
    assert clean("") == ("", [])


def test_repeated_lines_keep_the_raw_text(spark):
    pages = spark.createDataFrame([("d", i, f"Common header line\nbody {i}") for i in range(3)], "doc string, page int, raw_text string")
    out = cleaning.clean_documents(pages, "doc", "page", "raw_text").orderBy("page").collect()
    assert [r["cleaned_text"] for r in out] == ["body 0", "body 1", "body 2"] and out[0]["raw_text"].startswith("Common")
    assert out[0]["cleaning_ops"] == ["removed_repeated: Common header line"]


def test_chunk_sizes(spark):
    chunks = one(spark, chunking.chunk_text(F.lit("The quick brown fox. " * 200), 500, 50))
    assert len(chunks) > 1 and max(map(len, chunks)) <= 700
    assert one(spark, chunking.chunk_text(F.lit("Short text."))) == ["Short text."] and one(spark, chunking.chunk_text(F.lit(""))) == []


def test_oversize(spark):
    text = "A" * 1600 + "\n\n" + "B" * 1600
    rows = spark.createDataFrame([("c", text, False, 0), ("t", BIG_TABLES[0][1], True, 0), ("s", "This is small", False, 0), ("h", BIG_TABLES[2][1], True, 0)], "chunk_id string, text string, has_table boolean, char_count int")
    out = {r["chunk_id"]: r["text"] for r in chunking.split_oversized(rows).collect()}
    assert out["c_part1"] == "A" * 1600 and out["c_part2"] == "B" * 1600 and out["s"] == "This is small"
    parts = [t for k, t in out.items() if k.startswith("t_")]
    assert len(parts) >= 2 and all(t.startswith("TABLE (page 1):\n| Name | Value |\n|---|---|") for t in parts)
    assert out["h_part1"] == BIG_TABLES[2][1]  # header alone: nothing is lost


def test_order_tables_move_what_their_lines_are_made_of(spark):
    """Long notes are written where tables are split: none is shuffled or stored before."""
    from corpusflow.plans.text_queries import oversize_split_table

    plan = oversize_split_table(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "lineitem.parquet" in plan and "order-tables" not in plan
    moved = [line for line in plan.split("\n") if "collect_list" in line]
    assert moved and not any("repeat(" in line for line in moved if "partial_collect_list" in line)


def test_ids_and_markdown(spark):
    assert one(spark, ids.chunk_id(F.lit("abc12345xyz"), F.lit(3), F.lit(7))) == "abc12345_p0003_c0007"
    assert one(spark, ids.table_id(F.lit("abc12345"), F.lit(5), F.lit(2))) == "abc12345_p0005_t02"
    rows = F.array(F.array(F.lit("a"), F.lit("b")), F.array(F.lit("1")))
    assert one(spark, tables.markdown(rows)) == "| a | b |\n|---|---|\n| 1 |  |"
    assert one(spark, tables.markdown(F.array().cast("array<array<string>>"))) == ""
    assert "extraction failed" in one(spark, tables.table_chunk_text(F.lit(3), F.lit("f.pdf"), F.lit("failed"), F.lit("")))
    assert one(spark, tables.is_table(rows)) and one(spark, tables.clean_cells(F.array(F.array(F.lit(" x "), F.lit(None))))) == [["x", ""]]


def test_p95(spark):
    rows = spark.createDataFrame([(n, float(i)) for n in (1, 2, 5, 20) for i in range(1, n + 1)], "n int, v double")
    got = {r["n"]: r["p"] for r in rows.groupBy("n").agg(metrics.p95_by_index(F.collect_list("v")).alias("p")).collect()}
    assert got == {1: 1.0, 2: 1.0, 5: 4.0, 20: 19.0}


def test_winners(spark, tmp_path):
    rows = spark.createDataFrame([("zero", "a", 0.0), ("zero", "b", 0.0), ("higher", "a", 0.5), ("higher", "b", 0.5), ("higher", "c", 0.9), ("top", "a", 0.2), ("top", "b", 0.7), ("top", "c", 0.7)], "cat string, model string, s double")
    assert {r["cat"]: r["winner"] for r in evaluation.category_winners(rows, "cat", "model", "s").collect()} == {"zero": "a", "higher": "c", "top": "Tie"}
    report = evaluation.render_report(evaluation.model_ranking(spark.createDataFrame([("a", 0.5), ("b", 0.75)], "model string, s double"), "model", "s"), evaluation.category_winners(rows, "cat", "model", "s"))
    assert "| b | 0.75 | 1 |" in report and "| top | Tie | 0.7 |" in report
    evaluation.write_report(evaluation.model_ranking(spark.createDataFrame([("a", 0.5), ("b", 0.75)], "model string, s double"), "model", "s"), evaluation.category_winners(rows, "cat", "model", "s"), f"file://{tmp_path}/report")
    assert spark.read.text(f"file://{tmp_path}/report", wholetext=True).first()[0] == report


def test_metrics(spark):
    assert one(spark, number_facts(F.lit("75% of 1,200.50 on 2026-05-01 [SOURCE 1] b2"))) == ["75", "1,200.50", "2026-05-01", "1"]
    assert one(spark, token_f1(F.lit("the cat the dog"), F.lit("the the the bird"))) == pytest.approx(0.5)
    assert one(spark, metrics.semantic_similarity(F.lit(" "), F.lit("x"))) == 0.0
    assert one(spark, metrics.semantic_similarity(F.lit("a"), F.lit("x"), F.lit(-0.3))) == 0.0


def test_context_and_answers(spark):
    cols = "query_id string, rank int, document_name string, page_start int, section string, heading string, content_type string, table_id string, text string"
    hits = spark.createDataFrame([("q", 1, "d", 1, "S", None, "text", None, "The fee is due in May. Other words."), ("q", 2, "d", 2, None, None, "table", "tab1", "| a |"), ("q", 3, "d", 3, None, None, "text", None, " ")], cols)
    context = rag.build_context(rag.context_sources(hits)).first()
    assert "[SOURCE 1]" in context["context"] and "[SOURCE 2]" in context["context"] and "Table ID: tab1" in context["context"] and context["n_sources"] == 2
    asked = spark.createDataFrame([("q", "When is the fee due?"), ("none", "When is the exam?"), ("bad", "How do I hack the exam portal?")], "query_id string, question string")
    out = {r["query_id"]: r for r in rag.answer(asked, hits, rag.ExtractiveGenerator(), topics=["fee", "exam"]).collect()}
    assert out["q"]["answer"] == "The fee is due in May. [SOURCE 1]" and out["q"]["output_check"]["severity"] == "info"
    assert out["none"]["answer"] == rag.NO_ANSWER and out["bad"]["input_check"]["blocked_by"] == "ContentGuard" and out["bad"]["n_sources"] == 0
    # nothing retrieved on purpose: the generator is asked all the same, and a failure is told
    class Failing:
        def generate(self, df, system, user, out):
            return df.withColumn(out, F.concat(F.lit(" "), system, F.lit(" "))).withColumn(f"{out}_error", F.when(F.col("query_id") == "none", F.lit("no server")))

    bare = {r["query_id"]: r["answer"] for r in rag.answer(asked, None, Failing()).collect()}
    assert bare == {"q": rag.PLAIN_PROMPT, "none": "Error: no server", "bad": rag.PLAIN_PROMPT}
    long = spark.createDataFrame([("q", i, "d", i, None, None, "text", None, "x" * 6000) for i in (1, 2)], cols)
    from corpusflow.config import Config

    assert rag.context_sources(long, config=Config(context_chars=8000)).count() == 1
    assert one(spark, guards.blocked_response(guards.check_input(F.lit("How do I hack the exam portal?"), ["exam"])))["blocked"]


def test_search_and_embedding(spark):
    rows = spark.createDataFrame([(1, [1.0, 0.0], False), (2, [-1.0, 0.0], False), (3, [0.0, 1.0], True)], "vec_id long, embedding array<float>, has_table boolean")
    assert [r["vec_id"] for r in vectors.top_k(rows, [1.0, 0.0], 2).collect()] == [1, 3]
    assert [r["vec_id"] for r in vectors.top_k(rows, [1.0, 0.0], 5, F.col("has_table")).collect()] == [3]
    texts = spark.createDataFrame([(1, "apples and pears"), (2, "pears"), (3, "")], "id long, text string")
    embedded = vectors.HashingEmbedder(64).embed(texts, "text", "vector")
    assert [round(sum(x["w"] ** 2 for x in r["vector"]), 9) for r in embedded.orderBy("id").collect()] == [1.0, 1.0, 0.0]
    meta = texts.select(vectors.flatten_metadata(texts.withColumn("tags", F.lit(None).cast("array<string>")), ["text"]).alias("m")).first()["m"]
    assert meta == {"text": "apples and pears"}


def test_passages_are_searched_once(spark):
    """The context reads its hits twice; the search is not run for each."""
    from corpusflow.plans import registry

    plan = registry.QUERIES["hash_embed_retrieve"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FlatMapCoGroupsInArrow") == 0


def test_a_block_join_holds_parts_of_its_blocks(spark):
    """Equal to brute force with copies, zero, null and odd vectors; a task's memory follows its blocks and not their product."""
    import tracemalloc

    import numpy as np
    import pyarrow as pa

    rng = np.random.Generator(np.random.PCG64(5))
    some = rng.normal(size=(60, 6)).tolist()
    table = {i: some[rng.integers(0, 60)] for i in range(5000)} | {5000: None, 5001: [0.0] * 6, 5002: [1.0, None, 0.0, 0.0, 0.0, 0.0], 5003: [float("nan")] * 6}
    asked = {i: v for i, v in table.items() if i % 500 == 0} | {9: [0.0] * 6, 7: table[7]}
    rows = spark.createDataFrame(list(table.items()), "vec_id long, embedding array<double>")
    got = {}
    for r in vectors.top_k_join(rows, spark.createDataFrame(list(asked.items()), "query_id long, embedding array<double>"), 7).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["distance"], r["vec_id"]))
    unit = lambda v: np.array([x if x is not None else np.nan for x in v or [0.0] * 6]) / np.linalg.norm(np.array([x if x is not None else np.nan for x in v or [0.0] * 6]))
    with np.errstate(invalid="ignore"):
        units = {i: unit(v) for i, v in table.items()}
        for q, v in asked.items():
            d = [(float(x), i) for i, u in units.items() for x in [np.nan_to_num(1 - unit(v) @ u, nan=np.inf)]]
            best = sorted((round(x, 12), i) for x, i in d)[:7]
            assert [i for _, i in got[q]] == [i for _, i in best] and [x for x, _ in got[q]] == pytest.approx([x for x, _ in best], abs=1e-9)
    block = lambda n: pa.table({"id": pa.array(range(n)), "vec": pa.array(list(rng.normal(size=(n, 8))), pa.list_(pa.float64()))})
    a, b = block(10_000), block(2000)
    tracemalloc.start()
    assert vectors.nearest_of_blocks(5)(a, b).num_rows == 10_000
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 60e6, peak  # the product of the blocks alone is 160 MB


def test_answers_are_held_against_their_context(spark):
    """With an embedder the grounding guard runs inside answers: it warns of one that has nothing of its context."""

    class Says:
        def generate(self, df, system, user, out):
            return df.withColumn(out, F.when(F.col("query_id") == 1, "The exam fee is due in May, as always. [SOURCE 1]").otherwise("Purple bananas sing loudly beneath distant moons. [SOURCE 1]"))

    asked = spark.createDataFrame([(1, "When is the exam fee due?"), (2, "When is the exam fee due?")], "query_id int, question string")
    hits = spark.createDataFrame([(q, 1, "d", 1, "", "", "text", "", "The exam fee is due in May, as always, for all students.") for q in (1, 2)], "query_id int, rank int, document_name string, page_start int, section string, heading string, content_type string, table_id string, text string")
    out = {r["query_id"]: r for r in rag.answer(asked, hits, Says(), embedder=vectors.HashingEmbedder(1024)).collect()}
    names = {q: [w["guard_name"] for w in r["output_check"]["warnings"]] for q, r in out.items()}
    assert names == {1: [], 2: ["ContextGroundingGuard"]} and out[1]["grounding"] > 0.5 > 0.15 > out[2]["grounding"]
    plain = rag.answer(asked, hits, Says())
    assert "grounding" not in plain.columns and all(not r["output_check"]["warnings"] for r in plain.collect())


def test_questions_about_code(spark, tmp_path):
    from corpusflow.sources.text_index import SparseIndex, bm25_bags

    files_ = spark.createDataFrame([("a.py", "def parse_header(line):\n    return line.split()\n\ndef other():\n    pass"), ("b.py", "class Widget:\n    color = red")], "path string, body string")
    windows = chunking.line_windows(files_, "path", "body", 2, 0).select(F.concat_ws("#", "path", "chunk_index").alias("id"), F.col("body").alias("text"))
    index = SparseIndex(spark, f"file://{tmp_path}/code")
    index.build(bm25_bags(windows, "id", "text"))
    asked = spark.createDataFrame([(1, "What does parse_header return?"), (2, "zebra?")], "query_id int, question string")
    out = {r["query_id"]: r for r in rag.answer_code(asked, windows, index, rag.ExtractiveGenerator(), 1).collect()}
    assert "parse_header(line)" in out[1]["context"] and out[1]["n_sources"] == 1 and out[2]["n_sources"] == 0 and out[2]["answer"] == rag.NO_ANSWER


def test_collection(spark, tmp_path):
    store = Collection(spark, f"file://{tmp_path}")
    assert store.count() == 0
    rows = lambda v: spark.createDataFrame([("a", "d1", v), ("b", "d1", v)], "id string, document_name string, text string")
    store.add(rows("old"))
    store.add(rows("new").limit(1))
    assert store.count() == 2 and store.get("a").first()["text"] == "new" and [r["id"] for r in store.document_chunks("d1").collect()] == ["a", "b"]
    store.add(spark.createDataFrame([("c", "d1", "only")], "id string, document_name string, text string"), replace_by="document_name")
    assert [r["id"] for r in store.read().collect()] == ["c"]


def test_collections_write_changes_and_compact(spark, tmp_path):
    """An upsert writes its own rows alone; compaction keeps the content; filters on the id reach the scans of all folders."""
    store = Collection(spark, f"file://{tmp_path}", compact_after=3)
    expected = {}
    for step in range(9):
        changed = {f"k{i}": f"s{step}" for i in range(100 if step == 0 else 3 + step)}
        expected |= changed
        store.add(spark.createDataFrame([(k, "d", v) for k, v in changed.items()], "id string, document_name string, text string"))
        assert {r["id"]: r["text"] for r in store.read().collect()} == expected and len(store.current()) <= 3
        if step == 2:
            plan = store.get("k1")._jdf.queryExecution().toString()
            assert plan.count("EqualTo(id,k1)") >= 3
            assert spark.read.parquet(f"{store.path}/{store.versions()[-1]}/rows").count() == 5
    assert len(store.versions()) <= 7 and store.get("nobody").isEmpty()
    store.compact()
    assert {r["id"]: r["text"] for r in store.read().collect()} == expected and len(store.current()) == 1


def test_retrieval_of_the_flagship_query(spark):
    """Hits of hashed bags of words, against counts and cosines in plain Python."""
    import math
    import re
    import zlib
    from collections import Counter

    from corpusflow.plans.registry import flagship

    texts = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", F.substring("text", 1, 300).alias("text"))
    asked = spark.read.parquet("/root/testdata/sf0.001/conversations.parquet").where("turn = 0").select(F.col("conv_id").alias("query_id"), "text")
    embedder = vectors.HashingEmbedder(256)
    got = vectors.top_k_join(embedder.embed(texts, "text", "vector"), embedder.embed(asked, "text", "vector"), 3, "doc_id", "vector", dims=256).collect()

    def bag(text):
        counts = Counter(zlib.crc32(w.encode()) % 256 for w in re.findall(r"[^\W]+", text.lower()) if len(w) > 1)
        size = math.sqrt(sum(n * n for n in counts.values()))
        return {d: n / size for d, n in counts.items()}

    bags = {r["doc_id"]: bag(r["text"]) for r in texts.collect()}
    for r in asked.collect():
        own = bag(r["text"])
        order = sorted((round(1 - sum(w * b.get(d, 0.0) for d, w in own.items()), 9) if b else 9.0, i) for i, b in bags.items())[:3]
        found = sorted((x["rank"], round(x["distance"], 9), x["vec_id"]) for x in got if x["query_id"] == r["query_id"])
        assert [d for _, d, _ in found] == pytest.approx([d for d, _ in order], abs=1e-8)
    assert flagship(spark, "/root/testdata/sf0.001").count() > 0


def test_stream_is_idempotent(spark, tmp_path):
    inbox = tmp_path / "in"
    inbox.mkdir()
    (inbox / "1.json").write_text("\n".join(json.dumps({"chunk_id": f"c{i}", "text": "one"}) for i in range(3)))
    store = Collection(spark, f"file://{tmp_path}/store")
    for _ in range(2):
        upsert_stream(spark, str(inbox), "chunk_id string, text string", store, str(tmp_path / "cp")).awaitTermination()
        (inbox / "2.json").write_text(json.dumps({"chunk_id": "c1", "text": "two"}))
    assert {r["id"]: r["text"] for r in store.read().collect()} == {"c0": "one", "c1": "two", "c2": "one"}


def test_files(spark, tmp_path):
    (tmp_path / "docs/sub").mkdir(parents=True)
    (tmp_path / "docs/a.PDF").write_bytes(b"page one\fpage two")
    (tmp_path / "docs/sub/b.pdf").write_bytes(b"bad")
    (tmp_path / "docs/c.txt").write_text("x")
    found = files.discover(spark, str(tmp_path / "docs")).collect()
    assert sorted(r["filename"] for r in found) == ["a.PDF", "b.pdf"] and all(len(r["document_id"]) == 16 for r in found)

    def extract(path, content):
        if content == b"bad":
            raise ValueError("unreadable")
        for i, p in enumerate(content.decode().split("\f"), 1):
            yield {"source_path": path, "page_number": i, "raw_text": p}

    pages = files.extract_pages(spark, str(tmp_path / "docs"), extract)
    pages = pages.where(F.lower("source_path").endswith("pdf"))
    assert pages.where("error is null").count() == 2 and pages.where("error like '%unreadable%'").count() == 1
    status = files.document_status(pages, pages.where("error is null"))
    assert sorted(r["status"] for r in status.collect()) == ["failed", "ok"]
    files.write_json_lines(spark.createDataFrame([("c1", "é", None)], "chunk_id string, text string, section string"), f"{tmp_path}/chunks.jsonl")
    assert files.read_chunks(spark, f"{tmp_path}/chunks.jsonl").first()["text"] == "é"
    assert files.newest_file(spark, f"{tmp_path}/chunks.jsonl", "*.json").endswith(".json")
    (tmp_path / "q.json").write_text(json.dumps([{"id": "1", "question": "?", "expected_source": ["a", "b"]}, {"id": "2", "expected_source": []}]))
    assert [r["primary_source"] for r in files.answerable_from(files.read_questions(spark, f"{tmp_path}/q.json")).collect()] == ["a"]
    (tmp_path / "src/node_modules").mkdir(parents=True)
    (tmp_path / "src/m.py").write_text("a\n\nb")
    (tmp_path / "src/node_modules/n.js").write_text("x")
    tree = files.source_tree(spark, f"{tmp_path}/src").collect()
    assert [(r["file_path"], r["language"], r["text"]) for r in tree] == [("m.py", "py", "a\n\nb")]


def test_the_rest_stands_alone():
    import ast
    from pathlib import Path

    root = Path(__file__).resolve().parents[1] / "corpusflow"
    for path in root.rglob("*.py"):
        if "llm" not in path.relative_to(root).parts:
            for node in ast.walk(ast.parse(path.read_text())):
                names = [a.name for a in node.names] if isinstance(node, ast.Import) else [node.module or ""] if isinstance(node, ast.ImportFrom) else []
                assert not any("corpusflow.llm" in n for n in names), path


def test_order_statistics(spark):
    rows = spark.createDataFrame([(g, float(v)) for g, n in (("a", 1), ("b", 2), ("c", 5), ("d", 20), ("e", 5000)) for v in range(n, 0, -1)] + [("f", None), ("g", 3.0), ("g", 3.0), ("g", 3.0)], "g string, v double")
    assert {r["g"]: r["p95"] for r in evaluation.p95_by_group(rows, ["g"], "v").collect()} == {"a": 1.0, "b": 1.0, "c": 4.0, "d": 19.0, "e": 4750.0, "g": 3.0}
    assert {r["g"]: r["upper_median"] for r in evaluation.upper_median(rows, ["g"], "v").collect()} == {"a": 1.0, "b": 2.0, "c": 3.0, "d": 11.0, "e": 2501.0, "g": 3.0}


def test_small_tables_of_a_run(spark):
    words = spark.createDataFrame([(1, "90"), (1, "80"), (1, "-1"), (1, "x"), (2, "-1")], "page int, conf string")
    assert {r["page"]: r["ocr_confidence"] for r in tables.page_confidence(words, ["page"]).collect()} == {1: 0.85, 2: None}
    docs = spark.createDataFrame([("a", True), ("b", True), ("c", False)], "d string, critical boolean")
    assert [r["d"] for r in tables.missing_tables(docs, spark.createDataFrame([("a",)], "d string"), "d", "critical").collect()] == ["b"]
    models = spark.createDataFrame([("m1", True), ("m2", False)], "model string, oom_safe boolean")
    assert evaluation.questions_by_model(spark.createDataFrame([("q1",), ("q2",)], "id string"), models).count() == 2
