"""Shared plumbing of the corpus operators: table access, samples, Arrow helpers."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusflow.shipping import ship_package
from corpusflow.steps import discard_steps, forget, materialize, shared_dir

__all__ = ["bounded_sample", "discard_steps", "forget", "materialize", "read_table", "shared_dir", "slices", "text_of", "unused"]


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the input tables, through Spark's own reader (any file system)."""
    ship_package(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def unused(df: DataFrame, name: str) -> str:
    """A column name that df does not have: name, with underscores after it where it is taken."""
    while name.lower() in {c.lower() for c in df.columns}:
        name += "_"
    return name


def bounded_sample(df: DataFrame, size: int, *keys: str) -> DataFrame:
    """About `size` rows, those whose hash of `keys` is smallest; never more than twice as many, whatever the table.

    The threshold follows from the row count, so no partition sends more than its share to the driver.
    """
    n = df.count()
    if n > size:
        df = df.where(F.pmod(F.xxhash64(*keys), F.lit(2**40)) < int(2**40 * size / n))
    return df.limit(2 * size)


def text_of(column: pa.Array) -> list[str]:
    """Python strings of an Arrow string column; null becomes the empty text."""
    return [x if x is not None else "" for x in column.to_pylist()]


def slices(total: int, sizes: np.ndarray, most: int):
    """Ranges of consecutive rows whose sizes sum to about `most`, at least one row each."""
    if not total:
        return
    ends = np.cumsum(sizes)
    lo = 0
    while lo < total:
        base = ends[lo - 1] if lo else 0
        hi = max(lo + 1, int(np.searchsorted(ends, base + most, side="right")))
        yield lo, hi
        lo = hi
