"""Registry of the library's queries, with DuckDB SQL for each that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from corpusflow.plans import eval_queries, part_queries, search_queries, text_queries, vector_queries

_PARTS = (text_queries, vector_queries, eval_queries, part_queries, search_queries)
QUERIES = {name: f for part in _PARTS for name, f in part.QUERIES.items()}
ORACLES = {name: sql for part in _PARTS for name, sql in part.ORACLES.items()}


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents cleaned, chunked, embedded and retrieved into answers."""
    return vector_queries.hash_embed_retrieve(spark, sf_dir)
