"""Queries over vectors, retrieval and context assembly, with DuckDB SQL for the same results."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from corpusflow.config import Config
from corpusflow.operators import evaluation, rag, vectors
from corpusflow.plans.text_queries import strip, table
from corpusflow.steps import materialize

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


#: Distances of every query (ids divisible by 100) to every vector, and the k nearest.
_PAIRS = """v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings),
  d AS (SELECT q.vec_id AS query_id, v.vec_id, v.label, q.label AS query_label, round(1 - list_dot_product(q.e, v.e) / (sqrt(list_dot_product(q.e, q.e)) * sqrt(list_dot_product(v.e, v.e))), 12) AS distance FROM v q, v WHERE q.vec_id % 100 = 0)"""
_NEAREST = f"{_PAIRS}, r AS (SELECT *, (row_number() OVER (PARTITION BY query_id ORDER BY distance, vec_id))::INT AS rank FROM d)"


def _hits(spark, sf_dir, k=5):
    rows = table(spark, sf_dir, "embeddings")
    return vectors.top_k_join(rows, rows.where("vec_id % 100 = 0").withColumnRenamed("vec_id", "query_id"), k)


@query("""WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings), q AS (SELECT e FROM v WHERE vec_id = 0)
SELECT vec_id, round(1 - list_dot_product(q.e, v.e) / (sqrt(list_dot_product(q.e, q.e)) * sqrt(list_dot_product(v.e, v.e))), 6) AS distance FROM v, q ORDER BY distance, vec_id LIMIT 5""")
def vec_topk(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings")
    asked = rows.where("vec_id = 0").select("embedding").first()[0]
    return vectors.top_k(rows, asked, 5).select("vec_id", F.round("distance", 6).alias("distance"))


@query(f"WITH {_NEAREST} SELECT query_id, vec_id, rank, round(distance, 6) AS distance FROM r WHERE rank <= 5")
def vec_topk_join(spark, sf_dir):
    return _hits(spark, sf_dir).select("query_id", "vec_id", "rank", F.round("distance", 6).alias("distance"))


@query("""WITH v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings), q AS (SELECT e FROM v WHERE vec_id = 0)
SELECT vec_id, label, round(1 - list_dot_product(q.e, v.e) / (sqrt(list_dot_product(q.e, q.e)) * sqrt(list_dot_product(v.e, v.e))), 6) AS distance FROM v, q WHERE label = 3 ORDER BY distance, vec_id LIMIT 5""")
def vec_topk_filtered(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings")
    asked = rows.where("vec_id = 0").select("embedding").first()[0]
    return vectors.top_k(rows, asked, 5, F.col("label") == 3).select("vec_id", "label", F.round("distance", 6).alias("distance"))


@query("""WITH v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings), c AS (SELECT label, e AS ce FROM v QUALIFY row_number() OVER (PARTITION BY label ORDER BY vec_id) = 1)
SELECT vec_id, round(1 - list_dot_product(ce, e) / (sqrt(list_dot_product(ce, ce)) * sqrt(list_dot_product(e, e))), 6) AS distance FROM v JOIN c USING (label)""")
def cosine_distance(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings")
    first = rows.withColumn("r", F.row_number().over(Window.partitionBy("label").orderBy("vec_id"))).where("r = 1").select("label", F.col("embedding").alias("first"))
    return rows.join(first, "label").select("vec_id", F.round(vectors.cosine_distance(F.col("first"), F.col("embedding")), 6).alias("distance"))


@query("SELECT vec_id, label, round(embedding[1]::DOUBLE, 6) AS first_component FROM embeddings WHERE vec_id = 42")
def vec_point_lookup(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").where(F.col("vec_id") == 42).select("vec_id", "label", F.round(F.col("embedding")[0].cast("double"), 6).alias("first_component"))


@query("""WITH u AS (SELECT vec_id, label, 0 AS version FROM embeddings UNION ALL SELECT vec_id + 100, label + 100, 1 FROM embeddings UNION ALL SELECT vec_id, label - 100, 2 FROM embeddings WHERE vec_id % 3 = 0)
SELECT vec_id, label, version FROM u QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY version DESC) = 1""")
def vec_upsert(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "label")
    changes = rows.select(F.col("vec_id") + 100, F.col("label") + 100, F.lit(1).alias("version")).toDF("vec_id", "label", "version")
    changes = changes.unionByName(rows.where("vec_id % 3 = 0").select("vec_id", (F.col("label") - 100).alias("label"), F.lit(2).alias("version")))
    return vectors.upsert(rows.withColumn("version", F.lit(0)), changes, "vec_id", "version")


@query(f"""WITH {_NEAREST} SELECT query_id, len(list_filter([any_value(query_label), any_value(query_label) + 1], lambda x: list_contains(list(label), x))) / 2.0::DOUBLE AS recall FROM r WHERE rank <= 5 GROUP BY query_id""")
def recall_at_k(spark, sf_dir):
    from corpusflow.functions.metrics import recall_at_k as recall

    labels = table(spark, sf_dir, "embeddings").select("vec_id", "label")
    got = _hits(spark, sf_dir).join(labels, "vec_id").groupBy("query_id").agg(F.collect_set("label").alias("retrieved"))
    own = labels.select(F.col("vec_id").alias("query_id"), F.array("label", F.col("label") + 1).alias("expected"))
    return got.join(own, "query_id").select("query_id", recall(F.col("retrieved"), F.col("expected")).alias("recall"))


@query(f"""WITH {_PAIRS}, o AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, vec_id) AS rank FROM d WHERE vec_id <> query_id), q AS (SELECT DISTINCT query_id FROM d),
  f AS (SELECT q.query_id, min(rank) AS first FROM q LEFT JOIN o ON o.query_id = q.query_id AND rank <= 5 AND contains(o.label::VARCHAR, query_label::VARCHAR) GROUP BY 1)
SELECT count(*) AS queries, round_even(avg(CASE WHEN first <= 1 THEN 1.0 ELSE 0 END)::DOUBLE, 4) AS recall_at_1, round_even(avg(CASE WHEN first <= 3 THEN 1.0 ELSE 0 END)::DOUBLE, 4) AS recall_at_3, round_even(avg(CASE WHEN first <= 5 THEN 1.0 ELSE 0 END)::DOUBLE, 4) AS recall_at_5,
  round_even(avg(coalesce(1 / first, 0)), 4) AS mrr FROM f""")
def retrieval_eval(spark, sf_dir):
    labels = table(spark, sf_dir, "embeddings").select("vec_id", "label")
    hits = _hits(spark, sf_dir, 6).where("vec_id <> query_id").withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("rank")))
    hits = hits.join(labels.withColumnRenamed("label", "document_name"), "vec_id").where("rank <= 5")
    asked = labels.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("label").alias("expected"))
    return evaluation.retrieval_quality(hits, asked)


#: Hits of a source: its documents, longest first.
_HITS = "hits AS (SELECT source AS query_id, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS rank, lang AS document_name, doc_id AS page_start, CASE WHEN doc_id % 2 = 0 THEN source END AS section, CASE WHEN doc_id % 3 = 0 THEN lang END AS heading, text FROM documents)"
_BLOCKS = f"""{_HITS}, numbered AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS source_id FROM hits WHERE {strip("text")} <> ''),
  blocks AS (SELECT *, concat_ws(chr(10), '[SOURCE ' || source_id || ']', 'Document: ' || document_name, 'Page: ' || page_start, 'Section: ' || section, 'Heading: ' || heading, 'Content Type: text', 'Content:', {strip("text")}) || chr(10) AS block FROM numbered),
  fit AS (SELECT *, sum(length(block)) OVER (PARTITION BY query_id ORDER BY rank ROWS UNBOUNDED PRECEDING) AS used FROM blocks)"""


def _source_hits(spark, sf_dir):
    """Ranks are taken of ids and lengths alone; texts meet them by id."""
    docs = table(spark, sf_dir, "documents")
    ranked = docs.select("doc_id", "source", "n_chars").withColumn("rank", F.row_number().over(Window.partitionBy("source").orderBy(F.desc("n_chars"), "doc_id")))
    return docs.join(ranked.select("doc_id", "rank"), "doc_id").select(
        F.col("source").alias("query_id"), "rank", F.col("lang").alias("document_name"), F.col("doc_id").alias("page_start"), F.when(F.col("doc_id") % 2 == 0, F.col("source")).alias("section"),
        F.when(F.col("doc_id") % 3 == 0, F.col("lang")).alias("heading"), F.lit("text").alias("content_type"), F.lit(None).cast("string").alias("table_id"), "text",
    )


@query(f"WITH {_BLOCKS} SELECT query_id, page_start, source_id::INT AS source_id, md5(block) AS digest FROM fit WHERE used <= 1000000000")
def context_blocks(spark, sf_dir):
    out = rag.context_sources(_source_hits(spark, sf_dir), config=Config(context_chars=1_000_000_000))
    return out.select("query_id", "page_start", "source_id", F.md5("block").alias("digest"))


@query(f"WITH {_BLOCKS} SELECT query_id, page_start, source_id::INT AS source_id, used::BIGINT AS used_chars FROM fit WHERE used <= 40000")
def context_budget(spark, sf_dir):
    return rag.context_sources(_source_hits(spark, sf_dir), config=Config(context_chars=40_000)).select("query_id", "page_start", "source_id", "used_chars")


@query(f"""WITH {_BLOCKS}, c AS (SELECT query_id, string_agg(block, chr(10) || chr(10) ORDER BY source_id) AS context FROM fit WHERE used <= 40000 GROUP BY query_id),
  t AS (SELECT '{rag.SYSTEM_PROMPT.replace("{refusal}", rag.NO_ANSWER).replace("'", "''")}' AS t)
SELECT query_id, md5(replace(t, '{{context}}', context)) AS system_digest, 'Please answer the following question based on the provided context:' || chr(10) || chr(10) || 'Question: What does ' || query_id || ' say?' AS user_prompt FROM c, t""")
def rag_prompt(spark, sf_dir):
    context = rag.build_context(rag.context_sources(_source_hits(spark, sf_dir), config=Config(context_chars=40_000)))
    question = F.concat(F.lit("What does "), F.col("query_id"), F.lit(" say?"))
    return context.select("query_id", F.md5(rag.system_prompt(F.col("context"))).alias("system_digest"), rag.user_prompt(question).alias("user_prompt"))


def hash_embed_retrieve(spark, sf_dir):
    """From documents to answers: clean, chunk, embed, retrieve for each first user turn (ids divisible by 100), assemble, answer."""
    from corpusflow.operators import chunking, cleaning

    docs = table(spark, sf_dir, "documents").select("source", "doc_id", "lang", "text")
    cleaned = cleaning.clean_documents(docs, "source", "doc_id", "text")
    chunks = cleaned.select("source", "doc_id", F.posexplode(chunking.chunk_text(F.col("cleaned_text"))).alias("chunk_index", "text"))
    embedder = vectors.HashingEmbedder(1024)
    chunks = embedder.embed(chunks.withColumn("chunk_id", F.format_string("%d_c%04d", "doc_id", "chunk_index")), "text", "vector")
    chunks = materialize(chunks, "chunks")  # counted, searched and read again below
    asked = table(spark, sf_dir, "conversations").where("turn = 0 and conv_id % 100 = 0").select(F.col("conv_id").alias("query_id"), F.col("text").alias("question"))
    hits = vectors.top_k_join(chunks, embedder.embed(asked, "question", "vector"), 5, "chunk_id", "vector", dims=embedder.dims)
    hits = materialize(hits, "hits")  # the context reads them twice: for the places that fit, and for their texts
    hits = hits.withColumnRenamed("vec_id", "chunk_id").join(chunks, "chunk_id").select("query_id", "rank", F.col("source").alias("document_name"), F.col("doc_id").alias("page_start"), F.lit("").alias("section"), F.lit("").alias("heading"), F.lit("text").alias("content_type"), F.lit("").alias("table_id"), "text")
    out = rag.answer(asked, hits, rag.ExtractiveGenerator(), topics=[""])
    return out.select("query_id", "n_sources", F.length("context").alias("context_chars"), "answer", F.col("input_check.passed").alias("input_passed"), F.col("output_check.severity").alias("severity"))


QUERIES["hash_embed_retrieve"] = hash_embed_retrieve
