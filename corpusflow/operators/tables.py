"""Tables: size filter, Markdown, and rows from the word boxes of a scanned page."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusflow.config import DEFAULT, Config
from corpusflow.functions.text import let, strip


def clean_cells(rows: Column) -> Column:
    """Cells stripped, null cells empty."""
    return F.transform(rows, lambda r: F.transform(r, lambda c: F.coalesce(strip(c), F.lit(""))))


def is_table(rows: Column, config: Config = DEFAULT) -> Column:
    """Enough rows, and one of them wide enough."""
    return (F.size(rows) >= config.table_min) & (F.array_max(F.transform(rows, F.size)) >= config.table_min)


def markdown(rows: Column) -> Column:
    """Markdown of rows, padded to the widest, the first being the header; '' for none."""

    def render(r: Column) -> Column:
        width = F.array_max(F.transform(r, F.size))
        line = lambda cells: F.concat(F.lit("| "), F.array_join(F.concat(cells, F.array_repeat(F.lit(""), width - F.size(cells))), " | "), F.lit(" |"))
        rule = F.concat(F.lit("|"), F.array_join(F.array_repeat(F.lit("---"), width), "|"), F.lit("|"))
        body = F.transform(F.slice(r, F.lit(2), F.greatest(F.size(r) - 1, F.lit(0))), line)
        return F.array_join(F.concat(F.array(line(r[0]), rule), body), "\n")

    return F.when(F.coalesce(F.size(rows), F.lit(0)) <= 0, F.lit("")).otherwise(let(rows, render))


def table_chunk_text(page: Column, filename: Column, status: Column, text: Column) -> Column:
    failed = F.concat(F.lit("[TABLE — extraction failed or uncertain on page "), page.cast("string"), F.lit(" of "), filename, F.lit("]"))
    return F.when((status != "ok") | (F.coalesce(text, F.lit("")) == ""), failed).otherwise(F.concat(F.lit("TABLE (page "), page.cast("string"), F.lit("):\n"), text))


def cluster_rows(words: DataFrame, page: list[str], min_confidence: float = 10.0) -> DataFrame:
    """Rows of text on each page from word boxes (text, left, top, width, height, conf): page columns, row_index, n_words,
    row_text, confidence (mean over 100).

    Words go from top to bottom; one joins the current row if their vertical overlap exceeds 0.4 of the smaller height, and
    the row grows to hold it. That depends on every step before, so it is a fold over the (few hundred) words of a page.
    """
    fine = words.where((strip(F.col("text")) != "") & (F.coalesce(F.col("conf").try_cast("double"), F.lit(-1.0)) > min_confidence))
    box = F.struct(F.col("top").cast("double").alias("top"), F.col("left").cast("double").alias("left"), (F.col("top") + F.col("height")).cast("double").alias("bottom"), strip(F.col("text")).alias("text"), F.col("conf").cast("double").alias("conf"))
    pages = fine.groupBy(*page).agg(F.array_sort(F.collect_list(box)).alias("w"))
    word = "struct<left:double,text:string,conf:double>"
    empty = F.struct(F.array().cast(f"array<array<{word}>>").alias("rows"), F.array().cast(f"array<{word}>").alias("cur"), F.lit(0.0).alias("top"), F.lit(0.0).alias("bottom"))

    def step(acc: Column, w: Column) -> Column:
        overlap = F.least(acc["bottom"], w["bottom"]) - F.greatest(acc["top"], w["top"])
        joins = (F.size(acc["cur"]) > 0) & (overlap > F.least(acc["bottom"] - acc["top"], w["bottom"] - w["top"]) * 0.4)
        one = F.array(F.struct(w["left"].alias("left"), w["text"].alias("text"), w["conf"].alias("conf")))
        return F.struct(
            F.when(joins | (F.size(acc["cur"]) == 0), acc["rows"]).otherwise(F.concat(acc["rows"], F.array(acc["cur"]))).alias("rows"),
            F.when(joins, F.concat(acc["cur"], one)).otherwise(one).alias("cur"),
            F.when(joins, F.least(acc["top"], w["top"])).otherwise(w["top"]).alias("top"),
            F.when(joins, F.greatest(acc["bottom"], w["bottom"])).otherwise(w["bottom"]).alias("bottom"),
        )

    rows = F.aggregate("w", empty, step, lambda acc: F.concat(acc["rows"], F.array(acc["cur"])))
    out = pages.select(*page, F.posexplode(rows).alias("row_index", "r")).withColumn("r", F.array_sort("r"))
    mean = F.aggregate("r", F.lit(0.0), lambda a, x: a + x["conf"]) / F.size("r") / 100
    return out.select(*page, "row_index", F.size("r").alias("n_words"), F.array_join(F.transform("r", lambda x: x["text"]), " ").alias("row_text"), mean.alias("confidence"))


def page_confidence(words: DataFrame, page: list[str]) -> DataFrame:
    """page columns and ocr_confidence: the median confidence of a page's words over 100, rounded to 4; words without one
    (below 0, or no number) do not count, and a page without any has null."""
    value = F.col("conf").try_cast("double")
    return words.groupBy(*page).agg(F.bround(F.median(F.when(value >= 0, value)) / 100, 4).alias("ocr_confidence"))


def missing_tables(documents: DataFrame, tables: DataFrame, document: str, critical: str) -> DataFrame:
    """Documents marked critical for their tables of which none was found."""
    return documents.where(F.col(critical)).join(tables.select(document).distinct(), document, "left_anti")
