"""From raw documents to packed training sequences, one operator a stage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusflow.llm.common import materialize, read_table, unused
from corpusflow.llm.linededup import drop_recurring_lines
from corpusflow.llm.neardup import near_duplicates
from corpusflow.llm.packing import Capacities, pack_documents
from corpusflow.llm.quality import judge_quality
from corpusflow.llm.substrings import drop_repeats
from corpusflow.shipping import ship_package


def _texts_by(operator, own: tuple[str, ...], docs: DataFrame) -> DataFrame:
    """docs with the texts that operator gives them, n_chars following, and all other columns as they are. Those named like the
    columns that it adds (own) go by other names meanwhile."""
    aside = {c: unused(docs, f"__aside_{c}") for c in docs.columns if c in own}
    changed = operator(docs.withColumnsRenamed(aside)).drop(*own)
    out = changed.withColumnsRenamed({v: k for k, v in aside.items()}).select(*(f"`{c}`" for c in docs.columns))
    return out.withColumn("n_chars", F.length("text").cast(dict(docs.dtypes)["n_chars"])) if "n_chars" in docs.columns else out


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep, with all their columns as they are.

    Null and empty texts fail the base rule; null lang or source is a group of its own; very long texts are judged whole;
    repeated rows get one verdict each, the same; values on a fence are kept; no rows give none."""
    return judge_quality(docs).where("kept").select("row.*")


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, without its recurring lines; n_chars follows, other columns stay whatever their names.

    Null texts stay null; texts that lose all lines become empty; very long texts are lines like others; repeated rows lose
    the same lines; no rows give none."""
    return _texts_by(drop_recurring_lines, ("n_lines", "n_dropped"), docs)


def _documents(docs: DataFrame) -> DataFrame:
    """Rows of docs as structs, their text, __id, one value for each document, and __odd, true for rows of ids that several rows
    or none have.

    Rows with the same id and text are one document. Of the texts that share an id the first by digest keeps it; the
    others, and rows without an id, get ids beyond the largest (an overflow of long raises).
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("__of"), F.md5(F.coalesce(F.col("text").cast("string"), F.lit(""))).alias("__digest"))
    again = rows.groupBy("__of").agg(F.count(F.lit(1)).alias("n")).where("n > 1 or __of is null").select(F.col("__of").alias("__again"))
    again = materialize(again, "repeated-ids")
    texts = materialize(rows.join(again, F.col("__of").eqNullSafe(F.col("__again")), "left_semi").distinct(), "repeated-texts")
    own = texts.where("__of is not null").groupBy("__of").agg(F.min("__digest").alias("__digest")).withColumn("__id", F.col("__of"))
    other = texts.join(own, ["__of", "__digest"], "left_anti").withColumn("part", F.pmod(F.xxhash64("__of", "__digest"), F.lit(1024)))
    last = docs.agg(F.max(F.col("doc_id").cast("long"))).first()[0] or 0
    number = F.row_number().over(Window.partitionBy("part").orderBy("__of", "__digest")).cast("long")
    other = other.select("__of", "__digest", (F.lit(max(last, 0)).cast("long") + number * 1024 + F.col("part")).alias("__id"))
    found = materialize(own.unionByName(other), "documents").select(F.col("__of").alias("__a"), F.col("__digest").alias("__b"), F.col("__id").alias("__new"))
    row = F.struct(*(f"`{c}`" for c in docs.columns)).alias("row")  # whatever their names
    marked = docs.select(row, F.col("doc_id").cast("long").alias("__of"), F.col("text").cast("string").alias("text"), F.md5(F.coalesce(F.col("text").cast("string"), F.lit(""))).alias("__digest"))
    marked = marked.join(found, F.col("__of").eqNullSafe(F.col("__a")) & (F.col("__digest") == F.col("__b")), "left")
    return marked.select("row", "text", F.coalesce("__new", "__of").alias("__id"), F.col("__new").isNotNull().alias("__odd"))


def minhash_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies, whether their ids differ, repeat or are null, with its columns as they are.

    Null and empty texts are linked with nothing and stay, repeated rows among them once; of a group the smallest id stays,
    of its rows any; very long texts are compared whole; no rows give none."""
    ship_package(spark)
    marked = _documents(docs)
    kept = near_duplicates(marked.select(F.col("__id").alias("doc_id"), "text")).where("kept").select(F.col("doc_id").alias("__id")).distinct()
    left = marked.join(kept, "__id", "left_semi")
    once = left.where("__odd").groupBy("__id").agg(F.first("row").alias("row")).select("row.*")
    return left.where("not __odd").select("row.*").unionByName(once)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, without passages that occur elsewhere; n_chars follows, other columns stay whatever their names.

    Null texts stay null; texts below a window stay as they are; very long texts are searched whole; repeated rows would
    lose all to each other, but the stage before leaves one; no rows give none."""
    ship_package(spark)
    return _texts_by(drop_repeats, ("n_words", "n_removed", "kept_sha256"), docs)


#: Sequences of the pipeline: at most 4 documents, and at most three quarters of the attention cost of one full piece unless
#: a longer piece stands alone.
SEQUENCES = Capacities(tokens=1024, pieces=4, attention=3 * 1024 * 1024 // 4)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents placed in sequences, under token, document and attention capacities. A null text is the empty one;
    very long texts are cut into pieces; repeated rows are packed as often as they occur; no rows give none; columns other
    than doc_id and text end here."""
    ship_package(spark)
    return pack_documents(docs, caps=SEQUENCES)


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup),
    ("minhash_dedup", minhash_dedup),
    ("substring_dedup", substring_dedup),
    ("best_fit_packing", best_fit_packing),
]

#: Tokenisation, hashing and packing are beyond SQL; tests/llm hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
