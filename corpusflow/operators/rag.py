"""Context assembly, prompts and generation for retrieval-augmented answers."""

from __future__ import annotations

from typing import Protocol

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusflow.config import DEFAULT, REFUSAL, Config
from corpusflow.functions import guards
from corpusflow.functions.text import is_blank, sentences, strip, token_f1
from corpusflow.operators.scan import segmented_scan
from corpusflow.operators.vectors import Embedder, text_similarity
from corpusflow.sources.text_index import SparseIndex, bm25_search

NO_ANSWER = f"I {REFUSAL} in the knowledge base to answer that reliably."

SYSTEM_PROMPT = """You answer questions from the context below and from nothing else.

- Give what the context supports, directly; add no names, numbers, dates or rules of your own.
- Name the source of each statement by its tag, as in [SOURCE 1].
- If the context does not hold the answer, reply exactly: "{refusal}"

CONTEXT:
{context}
"""


#: What the generator is told where nothing is retrieved.
PLAIN_PROMPT = "Answer the question directly and briefly."


def source_block(source_id: Column, document: Column, page: Column, section: Column, heading: Column, content_type: Column, table_id: Column, text: Column) -> Column:
    """The text of one source; lines without a value are left out, except the document, page and content type."""
    line = lambda name, value: F.when(F.coalesce(value.cast("string"), F.lit("")) != "", F.concat(F.lit(f"{name}: "), value.cast("string")))
    shown = lambda name, value: F.concat(F.lit(f"{name}: "), F.coalesce(value.cast("string"), F.lit("None")))
    return F.concat(
        F.concat_ws(
            "\n", F.concat(F.lit("[SOURCE "), source_id.cast("string"), F.lit("]")), shown("Document", document), shown("Page", page), line("Section", section), line("Heading", heading),
            shown("Content Type", content_type), line("Table ID", table_id), F.lit("Content:"), strip(text),
        ), F.lit("\n"),
    )


def project_hits(hits: DataFrame, columns: tuple[str, ...] = ("document_name", "page_start", "section", "heading", "content_type", "table_id", "text")) -> DataFrame:
    """query_id, rank, distance, score (1 - distance), has_table (false where unknown) and the given columns, null where hits has
    none of the name."""
    have = set(hits.columns)
    flag = F.coalesce(F.col("has_table").cast("boolean"), F.lit(False)) if "has_table" in have else F.lit(False)
    return hits.select("query_id", "rank", "distance", (1 - F.col("distance")).alias("score"), flag.alias("has_table"), *(F.col(c) if c in have else F.lit(None).cast("string").alias(c) for c in columns))


def context_sources(hits: DataFrame, query: str = "query_id", rank: str = "rank", config: Config = DEFAULT) -> DataFrame:
    """hits (query, rank, document_name, page_start, section, heading, content_type, table_id, text) with source_id, block and
    used_chars added: the blocks of each query that fit the budget, the first that does not ending it. Blank texts take no
    number. Ranks are unique within a query.

    Ranks and lengths alone are ordered and summed; texts meet only the places that fit.
    """
    block = lambda n: source_block(n, *(F.col(c) for c in ("document_name", "page_start", "section", "heading", "content_type", "table_id", "text")))
    solid = hits.where(~is_blank(F.coalesce("text", F.lit(""))))
    sizes = solid.select(query, rank, F.length(block(F.lit(""))).alias("_n"))
    placed = segmented_scan(sizes, query, [rank], totals={"source_id": F.lit(1), "_upto": F.col("_n")})
    n = F.col("source_id")
    digits = sum((F.greatest(n - (10**d - 1), F.lit(0)) for d in range(1, 19)), n)  # of the numbers from 1 to source_id
    fits = placed.withColumn("used_chars", F.col("_upto") + digits).where(F.col("used_chars") <= config.context_chars).withColumn("source_id", n.cast("int")).drop("_n", "_upto")
    return solid.join(fits, [query, rank]).withColumn("block", block(F.col("source_id")))


def build_context(sources: DataFrame, query: str = "query_id") -> DataFrame:
    """query, context (blocks joined by a blank line), n_sources."""
    blocks = F.transform(F.array_sort(F.collect_list(F.struct("source_id", "block"))), lambda s: s["block"])
    return sources.groupBy(query).agg(F.array_join(blocks, "\n\n").alias("context"), F.count(F.lit(1)).alias("n_sources"))


def system_prompt(context: Column) -> Column:
    head, tail = SYSTEM_PROMPT.replace("{refusal}", NO_ANSWER).split("{context}")
    return F.concat(F.lit(head), context, F.lit(tail))


def user_prompt(question: Column) -> Column:
    return F.concat(F.lit("Please answer the following question based on the provided context:\n\nQuestion: "), question)


def judge_prompt(category: Column, question: Column, rubric: Column, reference: Column, candidate: Column, context: Column) -> Column:
    excerpt = F.when(F.coalesce(context, F.lit("")) == "", "(no context provided)").otherwise(F.substring(context, 1, 2000))
    parts = [("CATEGORY", category), ("QUESTION", question), ("RUBRIC", rubric), ("REFERENCE ANSWER", reference), ("CANDIDATE ANSWER", candidate), ("CONTEXT (first 2000 chars)", excerpt)]
    return F.concat_ws("\n\n", *(F.concat(F.lit(f"{k}: "), v) for k, v in parts), F.lit("Score the CANDIDATE ANSWER by the rubric. Return only a JSON object with the scores."))


class Generator(Protocol):
    """Adds an answer column to rows with prompts; model servers implement it with mapInPandas in the workers."""

    def generate(self, df: DataFrame, system: str, user: str, out: str) -> DataFrame: ...


class ExtractiveGenerator:
    """Answers with the sentence of the context that shares most words with the question, citing the first source."""

    def generate(self, df: DataFrame, system: str, user: str, out: str) -> DataFrame:
        body = F.regexp_replace(F.regexp_replace(F.col(system), r"(?s)^.*?CONTEXT:\n", ""), r"(?m)^(?:\[SOURCE \d+\]|[A-Z][A-Za-z ]*:.*)$", "")
        scored = F.transform(sentences(F.regexp_replace(body, r"\s+", " ")), lambda s: F.struct(token_f1(s, F.col(user)).alias("score"), s.alias("text")))
        best = F.array_max(scored)
        return df.withColumn(out, F.when(best.isNull() | (best["score"] == 0), F.lit(NO_ANSWER)).otherwise(F.concat(best["text"], F.lit(" [SOURCE 1]"))))


def answer(
    questions: DataFrame, hits: DataFrame | None, generator: Generator, query: str = "query_id", question: str = "question", topics: list[str] | None = None, config: Config = DEFAULT, embedder: Embedder | None = None, **guard_options
) -> DataFrame:
    """questions with context, n_sources, answer and guard results: input guards (given topics), context, generation, output
    guards.

    Blocked questions get the reason for an answer and no context; questions without context get the canonical refusal. With
    hits None nothing is retrieved: every question that passes goes to the generator with a plain system prompt, and none is
    refused for want of context. With an embedder, answers are held against their context (grounding, the cosine of both) as well. A
    generator that adds `<out>_error` gives an answer of "Error: " and that text where it is
    not null. Answers are stripped.
    """
    passed = F.struct(F.lit(True).alias("passed"), F.lit(None).cast("string").alias("blocked_by"), F.lit("").alias("reason"), F.lit("info").alias("severity"))
    rows = questions.withColumn("input_check", passed if topics is None else guards.check_input(F.col(question), topics, config=config, **guard_options))
    if hits is None:
        rows = rows.withColumns({"context": F.lit(""), "n_sources": F.lit(0).cast("long")})
    else:
        context = build_context(context_sources(hits, query, config=config), query)
        rows = rows.join(context, query, "left").withColumn("context", F.when(F.col("input_check.passed"), F.coalesce("context", F.lit(""))).otherwise(""))
    rows = rows.withColumn("_system", F.lit(PLAIN_PROMPT) if hits is None else system_prompt(F.col("context"))).withColumn("_user", user_prompt(F.col(question)))
    rows = generator.generate(rows, "_system", "_user", "answer").drop("_system", "_user")
    said = strip(F.col("answer"))
    if "answer_error" in rows.columns:
        said = F.when(F.col("answer_error").isNotNull(), F.concat(F.lit("Error: "), F.col("answer_error"))).otherwise(said)
    given = F.when(~F.col("input_check.passed"), F.col("input_check.reason"))
    given = (given if hits is None else given.when(F.col("context") == "", F.lit(NO_ANSWER))).otherwise(said)
    rows = rows.withColumn("answer", given).drop("answer_error").withColumn("n_sources", F.when(F.col("input_check.passed"), F.coalesce("n_sources", F.lit(0))).otherwise(0))
    if embedder is None:
        return rows.withColumn("output_check", guards.check_output(F.col("answer"), F.col("context") != "", config=config))
    rows = text_similarity(rows, embedder, "answer", "context", "grounding")
    return rows.withColumn("output_check", guards.check_output(F.col("answer"), F.col("context") != "", F.col("grounding"), config=config))


def code_prompt(snippets: DataFrame, query: str = "query_id", rank: str = "rank") -> DataFrame:
    """query and the joined snippets (text) of a question about code, ready for a system prompt."""
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(rank, "text"))), lambda s: s["text"]), "\n\n---\n\n")
    return snippets.groupBy(query).agg(joined.alias("context"))


def answer_code(questions: DataFrame, windows: DataFrame, index: SparseIndex, generator: Generator, k: int = 5, question: str = "question") -> DataFrame:
    """questions (query_id, question) with context, n_sources and answer: the k windows of code (the index's key, text) that share the
    most telling words with each question, its prompt, and what the generator makes of it. Without a window the answer is the refusal."""
    hits = bm25_search(index, questions, question, k).join(windows.select(index.key, "text"), index.key)
    counted = hits.groupBy("query_id").agg(F.count(F.lit(1)).alias("n_sources"))
    rows = questions.join(code_prompt(hits), "query_id", "left").join(counted, "query_id", "left").withColumns({"context": F.coalesce("context", F.lit("")), "n_sources": F.coalesce("n_sources", F.lit(0))})
    rows = rows.withColumn("_system", system_prompt(F.col("context"))).withColumn("_user", user_prompt(F.col(question)))
    rows = generator.generate(rows, "_system", "_user", "answer").drop("_system", "_user")
    return rows.withColumn("answer", F.when(F.col("context") == "", F.lit(NO_ANSWER)).otherwise(strip(F.col("answer"))))
