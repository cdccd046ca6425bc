"""Chunks of documents: paragraph and sentence packing with overlap, heading structure, validation, oversize splits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusflow.config import DEFAULT, Config
from corpusflow.functions import ids
from corpusflow.functions.text import SPACE, is_blank, let, paragraphs, sentences, strip
from corpusflow.operators.scan import segmented_scan

_CHUNKS = "struct<chunks:array<string>,cur:string>"


def chunk_text(text: Column, size: int = DEFAULT.chunk_chars, overlap: int = DEFAULT.chunk_overlap) -> Column:
    """Array of chunks: paragraphs (sentences of oversized paragraphs) packed greedily up to size, each chunk after the first
    opening with the last `overlap` characters of the one before. One fold over the units."""
    unit = lambda u, s: F.struct(u.alias("unit"), F.lit(s).alias("sentence"))
    units = F.flatten(F.transform(paragraphs(text), lambda p: F.when(F.length(p) > size, F.transform(sentences(p), lambda s: unit(s, True))).otherwise(F.array(unit(p, False)))))

    def step(acc: Column, u: Column) -> Column:
        cur = acc["cur"]
        full = (F.length(cur) + F.length(u["unit"]) + 2 > size) & (cur != "")
        tail = F.when(F.length(cur) > overlap, F.right(cur, F.lit(overlap))).otherwise(cur)
        opened = F.when(u["sentence"], F.concat(tail, F.lit(" "), u["unit"])).otherwise(F.ltrim(F.concat(tail, F.lit("\n\n"), u["unit"]), F.lit(SPACE)))  # units end in no white space
        grown = F.when(cur == "", u["unit"]).otherwise(F.ltrim(F.concat(cur, F.lit("\n\n"), u["unit"]), F.lit(SPACE)))
        return F.struct(F.when(full, F.concat(acc["chunks"], F.array(strip(cur)))).otherwise(acc["chunks"]).alias("chunks"), F.when(full, opened).otherwise(grown).alias("cur"))

    def finish(acc: Column) -> Column:
        return F.when(is_blank(acc["cur"]), acc["chunks"]).otherwise(F.concat(acc["chunks"], F.array(strip(acc["cur"]))))

    start = F.struct(F.array().cast("array<string>").alias("chunks"), F.lit("").alias("cur")).cast(_CHUNKS)
    none = F.array().cast("array<string>")
    packed = let(units, lambda u: F.when(F.size(u) == 0, F.array(F.substring(text, 1, size))).otherwise(F.aggregate(u, start, step, finish)))
    return F.when(F.length(text) > size, packed).when(is_blank(text), none).otherwise(F.array(text))


def track_sections(blocks: DataFrame, document: str, order: list[str], level: str = "level", heading: str = "text", totals: dict[str, Column] | None = None) -> DataFrame:
    """Add section, subsection and heading (the deepest one) in force at each block, itself included.

    level is 1..3 at a heading and null elsewhere. A level-1 heading clears the two below, level 2 the third. totals are running
    sums to take along. A document of any length is many tasks.
    """
    # of headings down to each level the last one says which is in force: none, if it is of a level above
    down_to = {f"_l{n}": F.when(F.col(level) <= n, F.concat(F.col(level).cast("string"), F.col(heading))) for n in (1, 2, 3)}
    out = segmented_scan(blocks, document, order, totals, down_to)
    own = lambda n: F.when(F.startswith(f"_l{n}", F.lit(str(n))), F.substr(f"_l{n}", F.lit(2)))
    out = out.withColumns({"section": own(1), "subsection": own(2), "_h3": own(3)})
    return out.withColumn("heading", F.coalesce("_h3", "subsection", "section")).drop(*down_to, "_h3")


def heading_segments(blocks: DataFrame, document: str, page: str, position: str, is_heading: str = "is_heading", text: str = "text") -> DataFrame:
    """Bodies between headings, one per page and run of blocks: document, page, segment, n_blocks, body (joined by a blank
    line). Blank blocks are skipped, and so are images where blocks has an is_image column."""
    rows = blocks.where(~is_blank(F.col(text)))
    rows = rows.where(~F.coalesce(F.col("is_image"), F.lit(False))) if "is_image" in blocks.columns else rows
    of = F.to_json(F.struct(document, page))
    rows = segmented_scan(rows.withColumn("_of", of), "_of", [position], totals={"segment": F.col(is_heading).cast("int")}).drop("_of").where(~F.col(is_heading))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(position, text))), lambda s: s[text]), "\n\n")
    return rows.groupBy(document, page, "segment").agg(F.count(F.lit(1)).alias("n_blocks"), body.alias("body"))


def number_chunks(chunks: DataFrame, document: str, order: list[str]) -> DataFrame:
    """Add chunk_index: dense from 0 in each document, in the order of columns that tell its chunks apart."""
    return segmented_scan(chunks, document, order, totals={"chunk_index": F.lit(1)}).withColumn("chunk_index", (F.col("chunk_index") - 1).cast("int"))


def chunk_document(blocks: DataFrame, document: str, page: str, position: str, tables: DataFrame | None = None, config: Config = DEFAULT) -> DataFrame:
    """Chunks of documents with headings. blocks: document, page, position, level (null for body), text. tables (optional):
    document, page, table_id, text; each is one chunk, ahead of its page's text, in the section in force at the page's start.

    Per heading one chunk; per body segment its packed text. Columns: document, page, chunk_index, chunk_id, content_type,
    section, subsection, heading, table_id, char_count, text.
    """
    rows = blocks.select(document, page, F.col(position).alias("position"), "level", "text", F.lit(None).cast("string").alias("table_id"))
    if tables is not None:
        once = tables.dropDuplicates(["table_id"]).select(document, page, F.lit(-1).cast("long").alias("position"), F.lit(None).cast("int").alias("level"), "text", "table_id")
        rows = rows.unionByName(once)
    order = [page, "position", "table_id"]
    tracked = track_sections(rows, document, order, totals={"segment": F.col("level").isNotNull().cast("int")}).where(~is_blank(F.col("text")))
    where = ["section", "subsection", "heading"]
    single = tracked.where("level is not null or table_id is not null").select(
        document, page, "segment", F.col("position").alias("at"), F.when(F.col("table_id").isNotNull(), "table").otherwise("heading").alias("content_type"), *where, "table_id", F.array("text").alias("parts")
    )
    parts = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("position", "text"))), lambda s: s["text"]), "\n\n")
    body = tracked.where("level is null and table_id is null").groupBy(document, page, "segment").agg(F.min("position").alias("at"), *(F.first(c).alias(c) for c in where), parts.alias("body"))
    body = body.select(document, page, "segment", "at", F.lit("text").alias("content_type"), *where, F.lit(None).cast("string").alias("table_id"), chunk_text(F.col("body"), config.chunk_chars, config.chunk_overlap).alias("parts"))
    out = single.unionByName(body).select("*", F.posexplode("parts").alias("part", "chunk")).drop("parts")
    out = number_chunks(out, document, [page, "at", "table_id", "part"])
    name = ids.chunk_id(F.col(document).cast("string"), F.col(page).cast("long"), F.col("chunk_index").cast("long"))
    return out.select(document, page, "chunk_index", name.alias("chunk_id"), "content_type", *where, "table_id", F.length("chunk").alias("char_count"), F.col("chunk").alias("text"))


def validate_chunks(chunks: DataFrame, config: Config = DEFAULT) -> DataFrame:
    """chunk_id, issue: one row per fault. The first of equal ids is no duplicate; order is by document_id and text."""
    again = F.row_number().over(Window.partitionBy("chunk_id").orderBy("document_id", "text")) > 1
    n = F.length(F.coalesce("text", F.lit("")))
    issues = F.array_compact(
        F.array(
            F.when(F.col("_again"), "duplicate chunk_id"), F.when(n < config.small_chunk, "too small"), F.when(n > config.large_chunk, "too large"),
            F.when(F.coalesce("document_id", F.lit("")) == "", "missing document_id"), F.when(is_blank(F.coalesce("text", F.lit(""))), "empty text"),
        )
    )
    return chunks.withColumn("_again", again).select("chunk_id", F.explode(issues).alias("issue"))


def split_text(text: Column, limit: int = DEFAULT.embed_chars) -> Column:
    """Parts of an oversized text, packed from the pieces between blank lines, without overlap; a text that fits is itself."""

    def step(acc: Column, piece: Column) -> Column:
        full = (F.length(acc["cur"]) + F.length(piece) + 2 > limit) & (acc["cur"] != "")
        more = F.concat(piece, F.lit("\n\n"))
        return F.struct(F.when(full, F.concat(acc["chunks"], F.array(strip(acc["cur"])))).otherwise(acc["chunks"]).alias("chunks"), F.when(full, more).otherwise(F.concat(acc["cur"], more)).alias("cur"))

    start = F.struct(F.array().cast("array<string>").alias("chunks"), F.lit("").alias("cur")).cast(_CHUNKS)
    parts = F.aggregate(F.split(text, "\n\n"), start, step, lambda acc: F.concat(acc["chunks"], F.array(strip(acc["cur"]))))
    return F.when(F.length(text) <= limit, F.array(text)).otherwise(parts)


def split_table(text: Column, limit: int = DEFAULT.embed_chars) -> Column:
    """Parts of an oversized table, each opening with its header (the lines up to the first that begins with |-, else the
    first line). A table that is header alone stays whole."""

    def split(lines: Column) -> Column:
        rule = F.array_position(F.transform(lines, lambda x: F.startswith(F.ltrim(x, F.lit(SPACE)), F.lit("|-"))), True).cast("int")

        def below(top: Column) -> Column:
            header = F.concat(F.array_join(F.slice(lines, F.lit(1), top), "\n"), F.lit("\n"))
            return let(F.struct(header.alias("header"), F.slice(lines, top + 1, F.greatest(F.size(lines) - top, F.lit(0))).alias("rows")), parts)

        return let(F.greatest(rule, F.lit(1)), below)

    def parts(h: Column) -> Column:
        # lengths alone tell where parts begin; the text of a part is put together once
        def step(acc: Column, n: Column) -> Column:
            full = (acc["n"] + n + 1 > limit) & (acc["i"] > F.element_at(acc["begin"], -1))
            return F.struct(
                F.when(full, F.concat(acc["begin"], F.array(acc["i"]))).otherwise(acc["begin"]).alias("begin"), (F.when(full, F.length(h["header"])).otherwise(acc["n"]) + n + 1).alias("n"), (acc["i"] + 1).alias("i")
            )

        start = F.struct(F.array(F.lit(0)).alias("begin"), F.length(h["header"]).alias("n"), F.lit(0).alias("i")).cast("struct<begin:array<int>,n:int,i:int>")
        begins = F.aggregate(F.transform(h["rows"], F.length), start, step, lambda acc: acc["begin"])
        rows = lambda i, n: F.array_join(F.slice(h["rows"], i + 1, n - i), "\n")
        texts = let(begins, lambda e: F.transform(e, lambda i, j: strip(F.concat(h["header"], rows(i, F.coalesce(F.get(e, j + 1), F.size(h["rows"])))))))
        return F.when(F.size(h["rows"]) == 0, F.array(text)).otherwise(texts)

    return F.when(F.length(text) <= limit, F.array(text)).otherwise(let(F.split(text, "\n"), split))


def split_oversized(chunks: DataFrame, limit: int = DEFAULT.embed_chars) -> DataFrame:
    """chunks (chunk_id, text, has_table, ...) with the oversized ones in parts `<chunk_id>_part<n>`, char_count following."""
    parts = F.when(F.coalesce("has_table", F.lit(False)), split_table(F.col("text"), limit)).otherwise(split_text(F.col("text"), limit))
    out = chunks.withColumn("_long", F.length("text") > limit).select("*", F.posexplode(parts).alias("_part", "_text"))
    named = F.when(F.col("_long"), F.concat("chunk_id", F.lit("_part"), (F.col("_part") + 1).cast("string"))).otherwise(F.col("chunk_id"))
    out = out.withColumn("chunk_id", named).withColumn("text", F.col("_text"))
    out = out.withColumn("char_count", F.length("text")) if "char_count" in chunks.columns else out
    return out.drop("_long", "_part", "_text")


def line_windows(files: DataFrame, key: str, text: str, size: int = DEFAULT.code_lines, overlap: int = DEFAULT.code_overlap) -> DataFrame:
    """Windows of `size` lines, each `overlap` lines into the one before, until a window begins past the end: key,
    chunk_index, start_line, end_line, body. Blank windows are left out and take no index; the last may lie within the one before."""
    lines = F.split(text, "\n")
    starts = F.sequence(F.lit(0), F.size(lines) - 1, F.lit(size - overlap))
    windows = files.select(key, F.explode(let(lines, lambda a: F.transform(starts, lambda i: F.struct(i.alias("at"), F.least(i + size, F.size(a)).alias("end_line"), F.array_join(F.slice(a, i + 1, F.lit(size)), "\n").alias("body"))))).alias("w"))
    windows = windows.select(key, (F.col("w.at") + 1).alias("start_line"), "w.end_line", "w.body").where(~is_blank(F.col("body")))
    return windows.withColumn("chunk_index", F.row_number().over(Window.partitionBy(key).orderBy("start_line")) - 1)


def code_chunk_text(path: Column, start: Column, end: Column, body: Column) -> Column:
    return F.format_string("File: %s (Lines %d-%d)\n```\n%s\n```", path, start, end, body)


def heading_level(size: Column, median: Column, bold: Column, text: Column) -> Column:
    """1..3 by the ratio of font sizes; bold short text is level 3; null for body."""
    ratio = size / F.when(median > 0, median).otherwise(F.lit(12.0))
    return F.when(ratio >= 1.6, 1).when(ratio >= 1.3, 2).when(ratio >= 1.15, 3).when(bold & (F.length(text) < 120), 3)


def sample_chunks(chunks: DataFrame, document: str, index: str = "chunk_index", text: str = "text") -> DataFrame:
    """For each document its first text chunk of more than 100 characters, else its first chunk."""
    fits = (F.col("content_type") == "text") & (F.length(text) > 100) if "content_type" in chunks.columns else F.length(text) > 100
    first = Window.partitionBy(document).orderBy(F.when(fits, 0).otherwise(1), index)
    return chunks.withColumn("_r", F.row_number().over(first)).where("_r = 1").drop("_r")
