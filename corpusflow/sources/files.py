"""Sources and sinks: document discovery, page extraction adapters, JSON lines, newest file, source trees."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from corpusflow.functions.ids import document_id

CHUNK = (
    "chunk_id string, document_id string, document_name string, source_path string, page_start int, page_end int, section string, subsection string, "
    "heading string, chunk_index int, content_type string, extraction_method string, ocr_used boolean, ocr_confidence double, has_table boolean, "
    "table_id string, char_count int, text string"
)
PAGE = (
    "page_id string, document_id string, filename string, source_path string, page_number int, char_count int, extraction_method string, "
    "ocr_engine string, ocr_confidence double, warnings array<string>, raw_text string"
)
QUESTION = "id string, question string, category string, expected_source array<string>, reference_answer string, answerable boolean, judge_rubric string"


def discover(spark: SparkSession, folder: str, extensions: tuple[str, ...] = (".pdf",)) -> DataFrame:
    """document_id, filename, source_path, file_type, file_size_bytes of the files under a folder, at any depth. Contents are
    not read. A folder that does not exist raises."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).select("path", "length")
    name = F.element_at(F.split("path", "/"), -1)
    suffix = F.lower(F.regexp_extract(name, r"(\.[^.]*)$", 1))
    return files.where(suffix.isin(*(e.lower() for e in extensions))).select(document_id(F.col("path")).alias("document_id"), name.alias("filename"), F.col("path").alias("source_path"), suffix.alias("file_type"), F.col("length").alias("file_size_bytes"))


def extract_pages(spark: SparkSession, paths: str, extract: Callable[[str, bytes], Iterator[dict]], schema: str | StructType = PAGE + ", error string") -> DataFrame:
    """Rows that `extract(path, content)` yields for each file, in the workers. A file that fails yields one row with its path
    and the error, and the others go on."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(paths).select("path", "content")
    names = [f.name for f in (schema if isinstance(schema, StructType) else StructType.fromDDL(schema)).fields]

    def run(batches):
        import pandas as pd

        for batch in batches:
            rows = []
            for path, content in zip(batch["path"], batch["content"]):
                try:
                    rows += list(extract(path, content))
                except Exception as e:  # one unreadable file must not stop the rest
                    rows.append({"source_path": path, "error": f"{type(e).__name__}: {e}"})
            yield pd.DataFrame([{n: r.get(n) for n in names} for r in rows], columns=names)

    return files.mapInPandas(run, schema)


def document_status(pages: DataFrame, chunks: DataFrame) -> DataFrame:
    """source_path and status: failed if every row of a file is an error, partial if pages but no chunks, else ok."""
    read = pages.groupBy("source_path").agg(F.count_if(F.col("error").isNull()).alias("good"))
    made = chunks.groupBy("source_path").agg(F.count(F.lit(1)).alias("made"))
    status = F.when(F.col("good") == 0, "failed").when(F.coalesce("made", F.lit(0)) == 0, "partial").otherwise("ok")
    return read.join(made, "source_path", "left").select("source_path", status.alias("status"))


def write_json_lines(df: DataFrame, path: str, by: str | None = None) -> None:
    """One object a line, nulls kept, in a folder; with `by`, a subfolder for each of its values."""
    writer = df.write.mode("overwrite").option("ignoreNullFields", "false")
    (writer.partitionBy(by) if by else writer).json(path)


def read_chunks(spark: SparkSession, path: str) -> DataFrame:
    """Chunks from JSON lines; blank lines are skipped."""
    return spark.read.schema(CHUNK).json(path)


def read_questions(spark: SparkSession, path: str) -> DataFrame:
    """Evaluation questions from one JSON array."""
    return spark.read.schema(QUESTION).option("multiLine", "true").json(path)


def answerable_from(questions: DataFrame) -> DataFrame:
    """Questions with an expected source, the first of which is primary."""
    return questions.where(F.size("expected_source") > 0).withColumn("primary_source", F.col("expected_source")[0])


def newest_file(spark: SparkSession, folder: str, pattern: str = "*.jsonl") -> str | None:
    """Path of the file written last; of several at that time the last by name."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(folder).select("path", "modificationTime")
    row = files.orderBy(F.desc("modificationTime"), F.desc("path")).first()
    return row["path"] if row else None


def source_tree(spark: SparkSession, root: str, include: tuple[str, ...] = (), exclude: tuple[str, ...] = ("node_modules", "venv", ".git", "__pycache__", "dist", "build"), extensions: tuple[str, ...] = (".py", ".js", ".jsx")) -> DataFrame:
    """file_path (below root), language and text of source files under the included folders (all if none is named)."""
    folders = [f"{root.rstrip('/')}/{d}" for d in include] or [root]
    files = spark.read.option("recursiveFileLookup", "true").text(folders, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))
    parts = F.split("path", "/")
    suffix = F.regexp_extract("path", r"(\.[^./]*)$", 1)
    base = root.split("://")[-1].rstrip("/") + "/"
    rows = files.where(suffix.isin(*extensions) & ~F.arrays_overlap(parts, F.array(*(F.lit(x) for x in exclude))))
    return rows.select(F.substring_index(F.col("path"), base, -1).alias("file_path"), F.substring(suffix, 2, 10).alias("language"), "text")
