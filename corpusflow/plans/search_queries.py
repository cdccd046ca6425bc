"""Queries over inverted indexes, with DuckDB SQL that scores every row."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from corpusflow.plans.text_queries import table
from corpusflow.sources.text_index import SparseIndex, bm25_bags, bm25_search
from corpusflow.steps import steps_dir

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__], ORACLES[f.__name__] = f, sql
        return f

    return add


_TOKENS = r"list_filter(regexp_extract_all(lower({}), '[\p{{L}}\p{{N}}_]+'), lambda w: length(w) > 1)"


@query(f"""WITH d AS (SELECT doc_id, {_TOKENS.format("coalesce(text, '')")} AS w FROM documents), n AS (SELECT count(*) AS n, avg(len(w)) AS mean FROM d),
  tf AS (SELECT doc_id, x, count(*) AS tf, any_value(size) AS size FROM (SELECT doc_id, unnest(w) AS x, len(w) AS size FROM d) GROUP BY doc_id, x), df AS (SELECT x, count(*) AS df FROM tf GROUP BY x),
  q AS (SELECT item_id, x, count(*) AS q FROM (SELECT item_id, unnest({_TOKENS.format("text")}) AS x FROM benchmark) GROUP BY ALL),
  s AS (SELECT item_id, doc_id, round(sum(q * ln(1 + (n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) * tf * 2.2::DOUBLE / (tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * size / mean))), 9) AS score FROM q JOIN df USING (x) JOIN tf USING (x), n GROUP BY item_id, doc_id),
  r AS (SELECT *, (row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id))::INT AS rank FROM s)
SELECT item_id, doc_id, rank, round(score, 6) AS score FROM r WHERE rank <= 10""")
def bm25_retrieve(spark, sf_dir):
    """The ten documents that answer each benchmark passage best, by BM25 over whole texts."""
    index = SparseIndex(spark, f"{steps_dir(spark)}/bm25-{uuid.uuid4().hex}", "doc_id")
    index.build(bm25_bags(table(spark, sf_dir, "documents"), "doc_id", "text"))
    asked = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    return bm25_search(index, asked, "text", 10).select(F.col("query_id").alias("item_id"), "doc_id", "rank", F.round("score", 6).alias("score"))
