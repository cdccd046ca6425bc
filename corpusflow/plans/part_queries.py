"""Queries over the smaller parts (sources, sinks, table helpers, prompts, single guards), with DuckDB SQL for the same results."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from corpusflow.config import REFUSAL
from corpusflow.functions import guards, metrics
from corpusflow.operators import chunking, cleaning, rag, tables, vectors
from corpusflow.plans.text_queries import strip, table
from corpusflow.plans.vector_queries import _NEAREST, _hits
from corpusflow.sources import files
from corpusflow.sources.collections import Collection
from corpusflow.sources.vector_index import VectorIndex
from corpusflow.steps import steps_dir
from corpusflow.streaming.ingest import upsert_stream

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__], ORACLES[f.__name__] = f, sql
        return f

    return add


def _folder(spark, label: str) -> str:
    return f"{steps_dir(spark)}/{label}-{uuid.uuid4().hex}"


@query("SELECT page_id, contains(lower(url), 'blog') OR contains(lower(url), '.net/') AS critical FROM pages")
def critical_tables(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", cleaning.has_critical_tables(F.col("url"), ["Blog", ".net/"]).alias("critical"))


@query("SELECT l_orderkey, count(*) >= 2 AS keep FROM lineitem GROUP BY l_orderkey")
def table_size_filter(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.collect_list(F.array("l_returnflag", "l_linestatus")).alias("rows"))
    return rows.select("l_orderkey", tables.is_table(tables.clean_cells(F.col("rows"))).alias("keep"))


@query("""WITH w AS (SELECT l_orderkey AS page, CASE WHEN l_linenumber % 5 = 0 THEN -1 ELSE l_quantity END AS conf FROM lineitem)
SELECT page, round_even(median(conf) FILTER (conf >= 0) / 100, 4) AS ocr_confidence FROM w GROUP BY page""")
def page_confidence(spark, sf_dir):
    words = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("page"), F.when(F.col("l_linenumber") % 5 == 0, F.lit(-1.0)).otherwise(F.col("l_quantity").cast("double")).cast("string").alias("conf"))
    return tables.page_confidence(words, ["page"])


@query("SELECT source FROM documents GROUP BY source HAVING min(doc_id) % 2 = 0 AND source NOT IN (SELECT source FROM documents WHERE doc_id % 97 = 0)")
def missing_tables(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    wanted = docs.groupBy("source").agg((F.min("doc_id") % 2 == 0).alias("critical"))
    return tables.missing_tables(wanted, docs.where("doc_id % 97 = 0"), "source", "critical").select("source")


@query("""SELECT page_id, CASE WHEN page_id % 3 = 0 OR page_id % 5 = 0 THEN '[TABLE — extraction failed or uncertain on page ' || page_id || ' of ' || url || ']' ELSE 'TABLE (page ' || page_id || '):' || chr(10) || '| a |' END AS text FROM pages""")
def table_chunk_texts(spark, sf_dir):
    n = F.col("page_id")
    text = tables.table_chunk_text(n, F.col("url"), F.when(n % 3 == 0, "failed").otherwise("ok"), F.when(n % 5 == 0, "").otherwise("| a |"))
    return table(spark, sf_dir, "pages").select("page_id", text.alias("text"))


@query("""WITH l AS (SELECT doc_id, string_split(text, chr(10)) AS a FROM documents), w AS (SELECT doc_id, a, unnest(range(0, len(a), 4)) AS i FROM l)
SELECT doc_id, (i + 1)::INT AS start_line, md5('File: ' || doc_id || '.txt (Lines ' || (i + 1) || '-' || least(i + 5, len(a)) || ')' || chr(10) || '```' || chr(10) || array_to_string(a[i + 1:i + 5], chr(10)) || chr(10) || '```') AS digest
FROM w WHERE """ + strip("array_to_string(a[i + 1:i + 5], chr(10))") + " <> ''")
def code_chunk_texts(spark, sf_dir):
    out = chunking.line_windows(table(spark, sf_dir, "documents"), "doc_id", "text", 5, 1)
    text = chunking.code_chunk_text(F.concat(F.col("doc_id").cast("string"), F.lit(".txt")), F.col("start_line"), F.col("end_line"), F.col("body"))
    return out.select("doc_id", "start_line", F.md5(text).alias("digest"))


@query("""SELECT n_nationkey, concat_ws(';', 'name=' || n_name, CASE WHEN n_nationkey % 3 > 0 THEN 'region=' || n_regionkey END, 'tags=' || n_name || ', ' || n_regionkey) AS metadata FROM nation""")
def flat_metadata(spark, sf_dir):
    rows = table(spark, sf_dir, "nation").select(
        "n_nationkey", F.col("n_name").alias("name"), F.when(F.col("n_nationkey") % 3 > 0, F.col("n_regionkey")).alias("region"), F.array(F.col("n_name"), F.col("n_regionkey").cast("string")).alias("tags")
    )
    entries = F.array_sort(F.map_entries(vectors.flatten_metadata(rows, ["name", "region", "tags"])))
    return rows.select("n_nationkey", F.array_join(F.transform(entries, lambda e: F.concat(e["key"], F.lit("="), e["value"])), ";").alias("metadata"))


@query(f"WITH {_NEAREST} SELECT query_id, rank, round(1 - distance, 6) AS score, label = 3 AS has_table, NULL::VARCHAR AS section FROM r WHERE rank <= 5")
def hit_projection(spark, sf_dir):
    labels = table(spark, sf_dir, "embeddings").select("vec_id", F.when(F.col("label") == 3, True).alias("has_table"))
    return rag.project_hits(_hits(spark, sf_dir).join(labels, "vec_id"), ("section",)).select("query_id", "rank", F.round("score", 6).alias("score"), "has_table", "section")


@query(f"""SELECT event_id, round(CASE WHEN event_id % 9 = 0 THEN 0 ELSE greatest(0, least(1, (event_id % 150) / 100 - 0.2)) END, 4)::DOUBLE AS similarity,
  CASE WHEN event_id % 4 <> 1 AND event_id % 7 > 0 AND greatest(0, coalesce(CASE WHEN event_id % 6 > 0 THEN (event_id % 150) / 100 - 0.2 END, 1)) < 0.15 THEN 'ContextGroundingGuard' ELSE '' END AS warnings FROM events""")
def grounding(spark, sf_dir):
    e = F.col("event_id")
    cosine = (e % 150) / 100 - 0.2
    answer = F.when(e % 7 > 0, "an answer of enough characters [SOURCE 1]").otherwise(f"I {REFUSAL} for this question, which is all that I can say about it here, sorry for that.")
    found = guards.check_output(answer, e % 4 != 1, F.when(e % 6 > 0, cosine))["warnings"]
    own = F.filter(found, lambda w: w["guard_name"] == "ContextGroundingGuard")
    text = F.when(e % 9 == 0, " ").otherwise("a")
    return table(spark, sf_dir, "events").select("event_id", metrics.semantic_similarity(text, F.lit("b"), cosine).alias("similarity"), F.array_join(F.transform(own, lambda w: w["guard_name"]), ",").alias("warnings"))


@query("""SELECT conv_id, turn, CASE WHEN length(text) > 500 THEN 'The query has ' || length(text) || ' characters; at most 500 are allowed.' ELSE 'All input guards passed.' END AS answer, length(text) > 500 AS stopped, 0::INT AS n_sources FROM conversations""")
def blocked_answers(spark, sf_dir):
    result = guards.check_input(F.when(F.length("text") > 500, F.col("text")).otherwise("hi"), [])
    r = guards.blocked_response(result)
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", r["answer"].alias("answer"), r["blocked_by"].isNotNull().alias("stopped"), F.size(r["sources"]).alias("n_sources"))


@query("""SELECT conv_id, turn, md5(concat_ws(chr(10) || chr(10), 'CATEGORY: chat', 'QUESTION: ' || text, 'RUBRIC: be right', 'REFERENCE ANSWER: none', 'CANDIDATE ANSWER: ' || text, 'CONTEXT (first 2000 chars): ' || CASE WHEN conv_id % 3 = 0 THEN '(no context provided)' ELSE left(repeat(text, 30), 2000) END,
  'Score the CANDIDATE ANSWER by the rubric. Return only a JSON object with the scores.')) AS digest FROM conversations""")
def judge_prompts(spark, sf_dir):
    text = F.col("text")
    prompt = rag.judge_prompt(F.lit("chat"), text, F.lit("be right"), F.lit("none"), text, F.when(F.col("conv_id") % 3 == 0, "").otherwise(F.repeat(text, F.lit(30))))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.md5(prompt).alias("digest"))


@query("SELECT conv_id, md5(string_agg(text, chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY turn, text)) AS digest FROM conversations GROUP BY conv_id")
def code_prompts(spark, sf_dir):
    return rag.code_prompt(table(spark, sf_dir, "conversations"), "conv_id", "turn").select("conv_id", F.md5("context").alias("digest"))


@query("SELECT doc_id::VARCHAR AS id, source AS primary_source FROM documents WHERE doc_id % 4 > 0")
def answerable_questions(spark, sf_dir):
    asked = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("id"), F.when(F.col("doc_id") % 4 > 0, F.array("source", "lang")).otherwise(F.array().cast("array<string>")).alias("expected_source"))
    path = _folder(spark, "questions")
    files.write_json_lines(asked, path)
    return files.answerable_from(spark.read.schema(files.QUESTION).json(path)).select("id", "primary_source")


def _chunks(spark, sf_dir):
    return table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("chunk_id"), F.col("source").alias("document_name"), F.when(F.col("doc_id") % 2 == 0, F.col("lang")).alias("section"), "text")


_CHUNKS = "doc_id::VARCHAR AS chunk_id, source AS document_name, CASE WHEN doc_id % 2 = 0 THEN lang END AS section"


@query(f"SELECT {_CHUNKS}, md5(text) AS digest FROM documents")
def json_lines(spark, sf_dir):
    """Chunks written as JSON lines and read back."""
    path = _folder(spark, "json-lines")
    files.write_json_lines(_chunks(spark, sf_dir), path)
    return files.read_chunks(spark, path).select("chunk_id", "document_name", "section", F.md5("text").alias("digest"))


@query("SELECT source AS document_name, count(*) AS chunks FROM documents GROUP BY source")
def json_lines_by_document(spark, sf_dir):
    """A folder of JSON lines for each document, found again by file discovery."""
    path = _folder(spark, "by-document")
    files.write_json_lines(_chunks(spark, sf_dir).repartition("document_name"), path, by="document_name")
    found = files.discover(spark, path, (".json",)).select(F.regexp_extract("source_path", "document_name=([^/]*)/", 1).alias("document_name")).distinct()
    return found.join(spark.read.json(path).groupBy("document_name").agg(F.count(F.lit(1)).alias("chunks")), "document_name")


@query("SELECT vec_id, CASE WHEN vec_id % 3 = 0 THEN 'second' ELSE 'first' END AS document_name FROM embeddings WHERE vec_id % 5 > 0 OR vec_id % 3 = 0")
def collection_upsert(spark, sf_dir):
    """Rows put into a collection, a third of them put in again later; what the collection holds then."""
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    store = Collection(spark, _folder(spark, "collection"), key="vec_id")
    store.add(rows.where("vec_id % 5 > 0").withColumn("document_name", F.lit("first")))
    store.add(rows.where("vec_id % 3 = 0").withColumn("document_name", F.lit("second")))
    return store.read().select("vec_id", "document_name")


@query(f"SELECT {_CHUNKS.replace('doc_id::VARCHAR AS chunk_id', 'doc_id::VARCHAR AS id')} FROM documents")
def stream_upsert(spark, sf_dir):
    """Files of JSON lines streamed into a collection, twice; the second time nothing is new."""
    inbox, store = _folder(spark, "inbox"), Collection(spark, _folder(spark, "streamed"))
    files.write_json_lines(_chunks(spark, sf_dir), inbox)
    at = _folder(spark, "stream-checkpoint")
    for _ in range(2):
        upsert_stream(spark, inbox, "chunk_id string, document_name string, section string, text string", store, at).awaitTermination()
    return store.read().select("id", "document_name", "section")


def _indexed(spark, sf_dir):
    """A collection of all vectors whose labels of every third row came with a later change, and its index, fitted before it."""
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "label", "embedding")
    store = Collection(spark, _folder(spark, "indexed"), key="vec_id")
    store.add(rows.withColumn("label", F.when(F.col("vec_id") % 3 == 0, F.lit(-1)).otherwise(F.col("label")).cast(dict(rows.dtypes)["label"])))
    index = VectorIndex(store, filters=("label",))
    index.build()
    store.add(rows.where("vec_id % 3 = 0"))
    index.refresh()
    return rows, store, index


@query("""WITH q AS (SELECT count(*) AS queries FROM embeddings WHERE vec_id % 100 = 0)
SELECT 'all' AS rows, queries, queries * least(5, (SELECT count(*) FROM embeddings)) AS hits, true AS recalled FROM q UNION ALL SELECT 'label 3', queries, queries * least(5, (SELECT count(*) FROM embeddings WHERE label = 3)), true FROM q""")
def vec_index_recall(spark, sf_dir):
    """Search by inverted lists, with a filter and without, against exact search: hits, and whether at least 0.9 of the exact ones are among them."""
    rows, store, index = _indexed(spark, sf_dir)
    asked = rows.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    n, out = asked.count(), None
    for name, where in (("all", F.lit(True)), ("label 3", F.col("label") == 3)):
        found = index.search(asked, 5, where)
        exact = vectors.top_k_join(rows.where(where), asked, 5).select("query_id", "vec_id", F.lit(1).alias("exact"))
        met = found.join(exact, ["query_id", "vec_id"], "left").agg(F.count(F.lit(1)).alias("hits"), F.count("exact").alias("right"))
        one = met.select(F.lit(name).alias("rows"), F.lit(n).cast("long").alias("queries"), "hits", (F.col("right") >= 0.9 * F.col("hits")).alias("recalled"))
        out = one if out is None else out.unionByName(one)
    return out


@query("SELECT vec_id, label FROM embeddings WHERE vec_id IN (0, 42, 300)")
def collection_lookup(spark, sf_dir):
    """Rows of a collection by id, the change of a row before its base."""
    _, store, _ = _indexed(spark, sf_dir)
    found = store.get(0).unionByName(store.get(42)).unionByName(store.get(300))
    return found.select("vec_id", "label")
