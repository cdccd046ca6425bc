"""Page text cleaning, routing of pages and documents, removal of lines that repeat across a document's pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusflow.config import DEFAULT, Config
from corpusflow.functions.text import SPACE, WORD, let, strip
from corpusflow.steps import materialize

PAGE_NUMBER = r"(?i)^(?:\d{1,4}|[-–]\s*\d{1,4}\s*[-–]|(?:page|pg\.?)\s*\d{1,4})$"


def page_method(text: Column, config: Config = DEFAULT) -> Column:
    """native if a page has enough text of its own, else scanned."""
    return F.when(F.length(strip(F.coalesce(text, F.lit("")))) >= config.native_page_chars, F.lit("native")).otherwise(F.lit("scanned"))


def route_documents(pages: DataFrame, document: str, text: str = "text", config: Config = DEFAULT) -> DataFrame:
    """document, pages, native_pages and doc_method: native_pdf if enough pages are native."""
    native = F.sum((page_method(F.col(text), config) == "native").cast("long"))
    grouped = pages.groupBy(document).agg(F.count(F.lit(1)).alias("pages"), native.alias("native_pages"))
    return grouped.withColumn("doc_method", F.when(F.col("native_pages") / F.col("pages") >= config.native_page_share, "native_pdf").otherwise("ocr_tesseract"))


def has_critical_tables(filename: Column, markers: list[str]) -> Column:
    return F.exists(F.array(*(F.lit(m.lower()) for m in markers)), lambda m: F.contains(F.lower(filename), m)) if markers else F.lit(False)


def clean_page(text: Column) -> Column:
    """Struct (text, ops): line ends unified, hyphenated line breaks joined, lines right-stripped with runs of spaces
    collapsed, page numbers near the edges removed, at most two blank lines in a row, all stripped. ops names what was done."""
    # a pattern is tried only where its plain part is found
    replaced = lambda x, part, pattern, by: F.when(F.contains(x, F.lit(part)), F.regexp_replace(x, pattern, by)).otherwise(x)
    unified = replaced(text, "\r", "\r\n?", "\n")
    joined = replaced(unified, "-\n", f"({WORD})-\n({WORD})", "$1$2")
    lines = F.transform(F.split(joined, "\n"), lambda x: F.rtrim(replaced(x, "  ", "  +", " "), F.lit(SPACE)))
    near_edge = lambda i, n: (i < 2) | (i >= n - 2)
    is_number = lambda x: strip(x).rlike(PAGE_NUMBER)

    def finish(a: Column) -> Column:
        kept = F.filter(a, lambda x, i: ~(near_edge(i, F.size(a)) & is_number(x)))
        gone = F.transform(F.filter(a, lambda x, i: near_edge(i, F.size(a)) & is_number(x)), lambda x: F.concat(F.lit("removed_page_number_line: "), strip(x)))
        out = let(F.array_join(kept, "\n"), lambda x: strip(replaced(x, "\n\n\n\n", "\n{4,}", "\n\n\n")))
        hyphens = joined != unified
        named = F.array_compact(F.array(F.when(hyphens, F.lit("fix_hyphenation"))))

        def done(out: Column) -> Column:
            spacing = F.array_compact(F.array(F.when((out != strip(text)) & ~hyphens, F.lit("whitespace_normalization"))))
            return F.struct(out.alias("text"), F.concat(named, gone, spacing).alias("ops"))

        return let(out, done)

    untouched = F.struct(text.alias("text"), F.array().cast("array<string>").alias("ops"))
    return F.when(text.isNull() | (text == ""), untouched).otherwise(let(lines, finish))


#: Hashes of likely repeats that are broadcast; more of them meet their lines by hash.
BROADCAST_LINES = 500_000


def _likely_lines(pages: DataFrame, document: str, page: str, text: str, config: Config) -> DataFrame:
    """document, page, line of the stripped lines of some length whose hash enough rows of the document have, among them all repeated
    lines.

    A first pass counts hashes alone, with map-side combination; only lines with a count that a repeat must have are moved.
    """
    kept = F.filter(F.array_distinct(F.transform(F.split(text, "\n"), strip)), lambda x: F.length(x) >= config.repeat_min_chars)
    lines = pages.select(document, page, F.explode(kept).alias("line")).withColumn("_hash", F.xxhash64(document, "line"))
    likely = lines.groupBy("_hash").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= config.repeat_min_pages).select("_hash")
    likely = materialize(likely, "likely-lines")
    few = likely.count() <= BROADCAST_LINES
    return materialize(lines.join(F.broadcast(likely) if few else likely, "_hash", "left_semi").drop("_hash"), "repeats")


def _repeats(likely: DataFrame, document: str, page: str, config: Config) -> DataFrame:
    return likely.groupBy(document, "line").agg(F.count_distinct(page).alias("pages")).where(F.col("pages") >= config.repeat_min_pages)


def repeated_lines(pages: DataFrame, document: str, page: str, text: str, config: Config = DEFAULT) -> DataFrame:
    """document, line, pages: stripped lines of some length that enough of a document's pages have."""
    return _repeats(_likely_lines(pages, document, page, text, config), document, page, config)


def remove_repeated_lines(pages: DataFrame, document: str, page: str, text: str, config: Config = DEFAULT) -> DataFrame:
    """pages with the repeated lines gone from text, and removed_lines (array, in order) added.

    Repeated lines reach a page by a join on (document, line), so neither a document nor its set of lines must fit a task.
    """
    likely = _likely_lines(pages, document, page, text, config)
    hits = likely.join(_repeats(likely, document, page, config).drop("pages"), [document, "line"], "left_semi")
    per_page = hits.groupBy(document, page).agg(F.collect_set("line").alias("_repeated"))
    joined = pages.join(per_page, [document, page], "left")
    found = F.filter(F.split(text, "\n"), lambda x: F.array_contains("_repeated", strip(x)))
    left = F.array_join(F.filter(F.split(text, "\n"), lambda x: ~F.array_contains("_repeated", strip(x))), "\n")
    none = F.col("_repeated").isNull()
    removed = F.when(none | F.col(text).isNull(), F.array().cast("array<string>")).otherwise(found)
    return joined.withColumns({"removed_lines": removed, text: F.when(none, F.col(text)).otherwise(left)}).drop("_repeated")


def clean_documents(pages: DataFrame, document: str, page: str, text: str, config: Config = DEFAULT) -> DataFrame:
    """pages with cleaned_text and cleaning_ops added: each page cleaned, then repeated lines removed; text itself stays. Cleaned pages
    are written once, and read by what follows."""
    cleaned = materialize(pages.withColumn("_clean", clean_page(F.col(text))).withColumn("cleaned_text", F.col("_clean.text")), "cleaned-pages")
    removed = remove_repeated_lines(cleaned, document, page, "cleaned_text", config)
    named = F.transform("removed_lines", lambda x: F.concat(F.lit("removed_repeated: "), F.substring(strip(x), 1, 40)))
    return removed.withColumn("cleaning_ops", F.concat("_clean.ops", named)).drop("_clean", "removed_lines")
