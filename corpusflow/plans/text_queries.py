"""Queries over texts and pages, with DuckDB SQL for the same results."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusflow.functions import ids
from corpusflow.functions.text import sentences
from corpusflow.operators import chunking, cleaning, evaluation, tables
from corpusflow.shipping import ship_package
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


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship_package(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: SQL fragments: white space, and strip().
WS = "concat(' ', chr(9), chr(10), chr(11), chr(12), chr(13))"
STRIP = f"trim({{}}, {WS})"


def strip(x: str) -> str:
    return STRIP.format(x)


@query(f"""SELECT doc_id, CASE WHEN length({strip("text")}) >= 50 THEN 'native' ELSE 'scanned' END AS method FROM documents""")
def page_routing(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", cleaning.page_method(F.col("text")).alias("method"))


@query(f"""
SELECT source, count(*) AS pages, sum(CASE WHEN length({strip("text")}) >= 50 THEN 1 ELSE 0 END)::BIGINT AS native_pages,
  CASE WHEN sum(CASE WHEN length({strip("text")}) >= 50 THEN 1 ELSE 0 END) / count(*) >= 0.3 THEN 'native_pdf' ELSE 'ocr_tesseract' END AS doc_method
FROM documents GROUP BY source""")
def doc_routing(spark, sf_dir):
    return cleaning.route_documents(table(spark, sf_dir, "documents"), "source")


#: Pages that the tables lack: line ends, hyphens, page numbers at edges and in the middle, blank runs, empty text.
PAGES = [
    (1, "Hello\r\nWorld\rTest"), (2, "This is a uni-\nversity policy"), (3, "12\nBody  text   here\n\n\n\n\nMore\n- 7 -"), (4, "Page 3\nA\nB\n42\nC\nD\nPg. 9"), (5, ""),
    (6, "  lead\ttab  \n99\nx\n5"), (7, "wert-\nüber und naïve-\nté"), (8, "1\n2\n3\n4\n5"), (9, "12345\nno number\n–  8 –"),
]


def _values(rows) -> str:
    cell = lambda v: "NULL" if v is None else "'" + v.replace("'", "''").replace("\r", "'||chr(13)||'").replace("\n", "'||chr(10)||'").replace("\t", "'||chr(9)||'") + "'" if isinstance(v, str) else str(v)
    return ", ".join("(" + ", ".join(map(cell, r)) + ")" for r in rows)


def _clean_sql(source: str, key: str) -> str:
    """Common table expressions ending in `cleaned` (key, text, out, hyphens, numbers)."""
    number = r"(?i)(\d{1,4}|[-–]\s*\d{1,4}\s*[-–]|(page|pg\.?)\s*\d{1,4})"
    edge = f"((i <= 2 OR i >= len(lines) - 1) AND regexp_full_match({strip('x')}, '{number}'))"
    return rf"""
  unified AS (SELECT {key}, text, regexp_replace(text, '\r\n?', chr(10), 'g') AS u FROM {source}),
  joined AS (SELECT *, regexp_replace(u, '([\p{{L}}\p{{N}}_])-\n([\p{{L}}\p{{N}}_])', '\1\2', 'g') AS h FROM unified),
  split AS (SELECT *, list_transform(string_split(h, chr(10)), lambda x: regexp_replace(rtrim(x, {WS}), '  +', ' ', 'g')) AS lines FROM joined),
  cleaned AS (SELECT {key}, text, CASE WHEN text = '' THEN '' ELSE {strip(f"regexp_replace(array_to_string(list_filter(lines, lambda x, i: NOT {edge}), chr(10)), '{chr(92)}n{{4,}}', chr(10) || chr(10) || chr(10), 'g')")} END AS out,
    h <> u AS hyphens, CASE WHEN text = '' THEN 0 ELSE len(list_filter(lines, lambda x, i: {edge})) END AS numbers FROM split)"""


@query(f"""
WITH pages AS (SELECT doc_id, text FROM documents UNION ALL SELECT -n, t FROM (VALUES {_values(PAGES)}) v(n, t)), {_clean_sql("pages", "doc_id")}
SELECT doc_id, length(out)::INT AS n_chars, md5(out) AS digest,
  (hyphens::INT + numbers + CASE WHEN text <> '' AND NOT hyphens AND out <> {strip("text")} THEN 1 ELSE 0 END)::INT AS n_ops FROM cleaned""")
def clean_page(spark, sf_dir):
    pages = table(spark, sf_dir, "documents").select("doc_id", "text").unionByName(spark.createDataFrame([(-n, t) for n, t in PAGES], "doc_id long, text string"))
    out = pages.select("doc_id", cleaning.clean_page(F.col("text")).alias("c"))
    return out.select("doc_id", F.length("c.text").alias("n_chars"), F.md5("c.text").alias("digest"), F.size("c.ops").alias("n_ops"))


_REPEATED = """
  lines AS (SELECT DISTINCT source, doc_id, {line} AS line FROM (SELECT source, doc_id, unnest(string_split({text}, chr(10))) AS x FROM {pages})),
  repeated AS (SELECT source, line, count(DISTINCT doc_id) AS pages FROM lines WHERE length(line) >= 10 GROUP BY ALL HAVING count(DISTINCT doc_id) >= 3)"""


@query(f"WITH {_REPEATED.format(line=strip('x'), text='text', pages='documents')} SELECT source, line, pages FROM repeated")
def repeated_lines(spark, sf_dir):
    return cleaning.repeated_lines(table(spark, sf_dir, "documents"), "source", "doc_id", "text")


_REMOVED = f"""
  kept AS (SELECT p.source, p.doc_id, p.{{text}} AS t, list_filter(string_split(p.{{text}}, chr(10)), lambda x: NOT list_contains(coalesce(r.l, []), {strip('x')})) AS k
    FROM {{pages}} p LEFT JOIN (SELECT source, list(line) AS l FROM repeated GROUP BY source) r USING (source))"""


@query(f"""WITH {_REPEATED.format(line=strip('x'), text='text', pages='documents')}, {_REMOVED.format(text='text', pages='documents')}
SELECT source, doc_id, (len(string_split(t, chr(10))) - len(k))::INT AS removed, md5(array_to_string(k, chr(10))) AS digest FROM kept""")
def remove_repeated_lines(spark, sf_dir):
    out = cleaning.remove_repeated_lines(table(spark, sf_dir, "documents").select("source", "doc_id", "text"), "source", "doc_id", "text")
    return out.select("source", "doc_id", F.size("removed_lines").alias("removed"), F.md5("text").alias("digest"))


@query(f"""WITH {_clean_sql("documents", "source, doc_id")},
  {_REPEATED.format(line=strip('x'), text='out', pages='cleaned')}, {_REMOVED.format(text='out', pages='cleaned')}
SELECT k.source, k.doc_id, (len(string_split(t, chr(10))) - len(k))::INT AS removed, md5(array_to_string(k, chr(10))) AS digest FROM kept k""")
def clean_documents(spark, sf_dir):
    out = cleaning.clean_documents(table(spark, sf_dir, "documents").select("source", "doc_id", "text"), "source", "doc_id", "text")
    removed = F.size(F.filter("cleaning_ops", lambda o: F.startswith(o, F.lit("removed_repeated"))))
    return out.select("source", "doc_id", removed.alias("removed"), F.md5("cleaned_text").alias("digest"))


def _sentences_sql(x: str) -> str:
    return f"list_filter(list_transform(string_split(regexp_replace({x}, '([.!?])\\s+([A-Z])', '\\1' || chr(1) || '\\2', 'g'), chr(1)), lambda s: {strip('s')}), lambda s: s <> '')"


@query(f"""SELECT doc_id, (unnest(range(len(s))))::INT AS pos, unnest(s) AS sentence FROM (SELECT doc_id, {_sentences_sql("text")} AS s FROM documents)""")
def sentence_split(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.posexplode(sentences(F.col("text"))).alias("pos", "sentence"))


def _chunk_sql(source: str, key: str, size: int = 1800, overlap: int = 350) -> str:
    """Common table expressions ending in `chunked` (key, c: list of chunks): the packing fold as a list_reduce."""
    paragraphs = f"list_filter(list_transform(regexp_split_to_array(text, '\\n{{2,}}'), lambda p: {strip('p')}), lambda p: p <> '')"
    unit = lambda u, s: f"{{'unit': {u}, 'sent': {s}, 'chunks': []::VARCHAR[], 'cur': ''}}"
    tail = f"CASE WHEN length(a.cur) > {overlap} THEN right(a.cur, {overlap}) ELSE a.cur END"
    full = f"(length(a.cur) + length(u.unit) + 2 > {size} AND a.cur <> '')"
    nl = "chr(10) || chr(10)"
    cur = f"""CASE WHEN {full} AND u.sent THEN {tail} || ' ' || u.unit WHEN {full} THEN {strip(f"({tail}) || {nl} || u.unit")}
      WHEN a.cur = '' THEN u.unit ELSE {strip(f"a.cur || {nl} || u.unit")} END"""
    step = f"{{'unit': '', 'sent': false, 'chunks': CASE WHEN {full} THEN list_append(a.chunks, {strip('a.cur')}) ELSE a.chunks END, 'cur': {cur}}}"
    return f"""
  units AS (SELECT {key}, text, flatten(list_transform({paragraphs}, lambda p: CASE WHEN length(p) > {size}
    THEN list_transform({_sentences_sql("p")}, lambda s: {unit("s", "true")}) ELSE [{unit("p", "false")}] END)) AS us FROM {source}),
  folded AS (SELECT {key}, text, len(us) AS n, list_reduce(list_prepend({unit("''", "false")}, us), lambda a, u: {step}) AS f FROM units),
  chunked AS (SELECT {key}, CASE WHEN length(text) <= {size} THEN CASE WHEN {strip("text")} = '' THEN [] ELSE [text] END WHEN n = 0 THEN [left(text, {size})]
    WHEN {strip("f.cur")} = '' THEN f.chunks ELSE list_append(f.chunks, {strip("f.cur")}) END AS c FROM folded)"""


@query(f"""WITH {_chunk_sql("documents", "doc_id")}
SELECT doc_id, i::INT AS chunk_index, length(c[i + 1])::INT AS n_chars, md5(c[i + 1]) AS digest FROM (SELECT doc_id, c, unnest(range(len(c))) AS i FROM chunked)""")
def chunk_text(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(chunking.chunk_text(F.col("text"))).alias("chunk_index", "c"))
    return rows.select("doc_id", "chunk_index", F.length("c").alias("n_chars"), F.md5("c").alias("digest"))


_DIALOGUES = "dialogues AS (SELECT conv_id, string_agg(text, chr(10) || chr(10) ORDER BY turn, text) AS text FROM conversations GROUP BY conv_id)"


def dialogues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as documents whose paragraphs are their turns."""
    turns = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "text"))).alias("t"))
    return turns.select("conv_id", F.array_join(F.transform("t", lambda x: x["text"]), "\n\n").alias("text"))


@query(f"""WITH {_DIALOGUES}, {_chunk_sql("dialogues", "conv_id", 500, 50)}
SELECT conv_id, i::INT AS chunk_index, length(c[i + 1])::INT AS n_chars, md5(c[i + 1]) AS digest FROM (SELECT conv_id, c, unnest(range(len(c))) AS i FROM chunked)""")
def chunk_paragraphs(spark, sf_dir):
    rows = dialogues(spark, sf_dir).select("conv_id", F.posexplode(chunking.chunk_text(F.col("text"), 500, 50)).alias("chunk_index", "c"))
    return rows.select("conv_id", "chunk_index", F.length("c").alias("n_chars"), F.md5("c").alias("digest"))


#: Blocks of a document with headings of every level: (doc, page, position, level, text).
BLOCKS = [
    ("d1", 1, 0, 1, "One"), ("d1", 1, 1, None, "intro"), ("d1", 1, 2, 3, "One deep"), ("d1", 1, 3, None, "deep body"), ("d1", 2, 0, 2, "One b"), ("d1", 2, 1, None, "b body"),
    ("d1", 2, 2, 3, "One b i"), ("d1", 2, 3, None, "  "), ("d1", 2, 4, None, "i body"), ("d1", 3, 0, None, "carried"), ("d1", 3, 1, 1, "Two"), ("d1", 3, 2, None, "two body"),
    ("d2", 1, 0, None, "no heading yet"), ("d2", 1, 1, 2, "Sub first"), ("d2", 1, 2, None, "x"), ("d2", 1, 3, None, "y"), ("d2", 2, 0, 1, "Main"), ("d2", 2, 1, None, "z"),
]
_BLOCK_VALUES = f"blocks AS (SELECT doc, page::BIGINT AS page, position::BIGINT AS position, level::INT AS level, text FROM (VALUES {_values(BLOCKS)}) v(doc, page, position, level, text))"


#: Begin and end of headings and paragraphs, marked by two characters that no page holds. A paragraph ends at its closing tag or
#: where the next one, or the article, ends or begins; tags inside it are stripped later.
_MARKS = [("(?i)<h1(\\s[^>]*)?>", "\x01h"), ("(?i)<p(\\s[^>]*)?>", "\x01p"), ("(?i)</(h1|p|article)>", "\x02")]


def page_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Headings (level 1) and paragraphs of the web pages in order, and the blocks above: doc, page, position, level, text."""
    html = F.col("html")
    for pattern, mark in _MARKS:
        html = F.regexp_replace(html, pattern, mark)
    found = F.slice(F.split(html, "\x01"), 2, F.size(F.split(html, "\x01")))
    pages = table(spark, sf_dir, "pages").select(F.col("page_id").cast("string").alias("doc"), F.posexplode(found).alias("position", "b"))
    body = F.regexp_replace(F.substring_index(F.substr("b", F.lit(2)), "\x02", 1), "<[^>]*>", "")
    own = pages.select("doc", (F.col("position") / 5).cast("long").alias("page"), F.col("position").cast("long").alias("position"), F.when(F.startswith("b", F.lit("h")), 1).alias("level"), body.alias("text"))
    return own.unionByName(spark.createDataFrame(BLOCKS, "doc string, page long, position long, level int, text string"))


def _marked_sql(x: str) -> str:
    for pattern, mark in _MARKS:
        x = f"regexp_replace({x}, '{pattern}', '{mark}', 'g')"
    return x


_PAGE_BLOCKS = f"""{_BLOCK_VALUES},
  found AS (SELECT page_id::VARCHAR AS doc, string_split({_marked_sql("html")}, chr(1))[2:] AS f FROM pages),
  each AS (SELECT doc, unnest(range(len(f))) AS position, unnest(f) AS b FROM found),
  every AS (SELECT doc, (position // 5)::BIGINT AS page, position::BIGINT AS position, CASE WHEN starts_with(b, 'h') THEN 1 END AS level, regexp_replace(string_split(b[2:], chr(2))[1], '<[^>]*>', '', 'g') AS text FROM each
    UNION ALL SELECT * FROM blocks)"""
_TRACKED = """
  n1 AS (SELECT *, sum(CASE WHEN level = 1 THEN 1 ELSE 0 END) OVER w AS n1, last_value(CASE WHEN level = 1 THEN text END IGNORE NULLS) OVER w AS section FROM every WINDOW w AS (PARTITION BY doc ORDER BY page, position ROWS UNBOUNDED PRECEDING)),
  n2 AS (SELECT *, sum(CASE WHEN level = 2 THEN 1 ELSE 0 END) OVER w AS n2, last_value(CASE WHEN level = 2 THEN text END IGNORE NULLS) OVER w AS subsection FROM n1 WINDOW w AS (PARTITION BY doc, n1 ORDER BY page, position ROWS UNBOUNDED PRECEDING)),
  tracked AS (SELECT *, coalesce(last_value(CASE WHEN level = 3 THEN text END IGNORE NULLS) OVER w, subsection, section) AS heading FROM n2 WINDOW w AS (PARTITION BY doc, n1, n2 ORDER BY page, position ROWS UNBOUNDED PRECEDING))"""


@query(f"WITH {_PAGE_BLOCKS}, {_TRACKED} SELECT doc, page, position, section, subsection, heading FROM tracked")
def section_tracker(spark, sf_dir):
    return chunking.track_sections(page_blocks(spark, sf_dir), "doc", ["page", "position"]).select("doc", "page", "position", "section", "subsection", "heading")


@query(f"""WITH {_PAGE_BLOCKS}, runs AS (SELECT *, sum(CASE WHEN level IS NOT NULL THEN 1 ELSE 0 END) OVER (PARTITION BY doc, page ORDER BY position ROWS UNBOUNDED PRECEDING) AS segment FROM every WHERE {strip("text")} <> '')
SELECT doc, page, segment::BIGINT AS segment, count(*) AS n_blocks, string_agg(text, chr(10) || chr(10) ORDER BY position) AS body FROM runs WHERE level IS NULL GROUP BY ALL""")
def heading_segments(spark, sf_dir):
    blocks = page_blocks(spark, sf_dir).withColumn("is_heading", F.col("level").isNotNull())
    return chunking.heading_segments(blocks, "doc", "page", "position")


@query(f"WITH {_PAGE_BLOCKS} SELECT doc, page, position, (row_number() OVER (PARTITION BY doc ORDER BY page, position) - 1)::INT AS chunk_index FROM every")
def chunk_numbering(spark, sf_dir):
    return chunking.number_chunks(page_blocks(spark, sf_dir), "doc", ["page", "position"]).select("doc", "page", "position", "chunk_index")


TABLE_TEXTS = [("d1", 2, "t1", "TABLE (page 2):\n| a | b |\n|---|---|\n| 1 | 2 |"), ("d2", 1, "t2", "TABLE (page 1):\n| x |\n|---|")]


@query(f"""WITH {_PAGE_BLOCKS.replace("every AS", "own AS")}, tabs AS (SELECT doc, page::BIGINT AS page, table_id, text FROM (VALUES {_values(TABLE_TEXTS)}) v(doc, page, table_id, text)),
  every AS (SELECT doc, page, position, level, text, NULL AS table_id FROM own UNION ALL SELECT doc, page, -1, NULL, text, table_id FROM tabs), {_TRACKED},
  runs AS (SELECT *, sum(CASE WHEN level IS NOT NULL THEN 1 ELSE 0 END) OVER (PARTITION BY doc, page ORDER BY position, table_id ROWS UNBOUNDED PRECEDING) AS segment FROM tracked),
  parts AS (SELECT doc, page, position AS spot, CASE WHEN table_id IS NOT NULL THEN 'table' ELSE 'heading' END AS content_type, section, subsection, heading, table_id, text FROM runs WHERE level IS NOT NULL OR table_id IS NOT NULL
    UNION ALL SELECT doc, page, min(position), 'text', first(section), first(subsection), first(heading), NULL, string_agg(text, chr(10) || chr(10) ORDER BY position) FROM runs WHERE level IS NULL AND table_id IS NULL AND {strip("text")} <> '' GROUP BY doc, page, segment),
  keyed AS MATERIALIZED (SELECT *, row_number() OVER (ORDER BY doc, page, spot, table_id NULLS FIRST) AS pk FROM parts WHERE {strip("text")} <> ''),
  bodies AS (SELECT pk, text FROM keyed WHERE content_type = 'text'), {_chunk_sql("bodies", "pk")},
  pieces AS (SELECT pk, unnest(range(len(c))) AS part, unnest(c) AS text FROM chunked UNION ALL SELECT pk, 0, text FROM keyed WHERE content_type <> 'text'),
  numbered AS (SELECT doc, page, content_type, section, subsection, heading, table_id, pieces.text, row_number() OVER (PARTITION BY doc ORDER BY page, spot, table_id NULLS FIRST, part) - 1 AS k FROM pieces JOIN keyed USING (pk))
SELECT doc, page, k::INT AS chunk_index, format('{{}}_p{{:04d}}_c{{:04d}}', left(doc, 8), page, k) AS chunk_id, content_type, section, subsection, heading, table_id, length(text)::INT AS char_count, text FROM numbered""")
def chunk_document(spark, sf_dir):
    return chunking.chunk_document(page_blocks(spark, sf_dir), "doc", "page", "position", spark.createDataFrame(TABLE_TEXTS, "doc string, page long, table_id string, text string"))


@query(f"""WITH rows AS (SELECT 'c' || (doc_id // 2) AS chunk_id, CASE WHEN doc_id % 50 = 0 THEN NULL ELSE source END AS document_id, text FROM documents),
  seen AS (SELECT *, row_number() OVER (PARTITION BY chunk_id ORDER BY document_id NULLS FIRST, text) > 1 AS again FROM rows)
SELECT chunk_id, issue FROM (SELECT chunk_id, unnest([CASE WHEN again THEN 'duplicate chunk_id' END, CASE WHEN length(text) < 80 THEN 'too small' END, CASE WHEN length(text) > 8000 THEN 'too large' END,
  CASE WHEN coalesce(document_id, '') = '' THEN 'missing document_id' END, CASE WHEN {strip("text")} = '' THEN 'empty text' END]) AS issue FROM seen) WHERE issue IS NOT NULL""")
def validate_chunks(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    rows = docs.select(F.concat(F.lit("c"), F.floor(F.col("doc_id") / 2).cast("string")).alias("chunk_id"), F.when(F.col("doc_id") % 50 != 0, F.col("source")).alias("document_id"), "text")
    return chunking.validate_chunks(rows)


@query("SELECT source, doc_id, format('{}_p{:04d}_c{:04d}', left(source, 8), 1, doc_id) AS chunk_id, (row_number() OVER (PARTITION BY source ORDER BY format('{}_p{:04d}_c{:04d}', left(source, 8), 1, doc_id)))::INT AS place FROM documents")
def doc_chunks(spark, sf_dir):
    from pyspark.sql import Window

    name = ids.chunk_id(F.col("source"), F.lit(1), F.col("doc_id"))
    return table(spark, sf_dir, "documents").select("source", "doc_id", name.alias("chunk_id")).withColumn("place", F.row_number().over(Window.partitionBy("source").orderBy("chunk_id")))


@query("SELECT source, doc_id FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY CASE WHEN length(text) > 100 THEN 0 ELSE 1 END, doc_id) AS r FROM documents) WHERE r = 1")
def sample_chunk(spark, sf_dir):
    return chunking.sample_chunks(table(spark, sf_dir, "documents"), "source", "doc_id").select("source", "doc_id")


def _fold_sql(pieces: str, cur0: str, full: str, opened: str, grown: str) -> str:
    """list_reduce over pieces of text, giving {chunks, cur}."""
    return f"""list_reduce(list_prepend({{'p': '', 'chunks': []::VARCHAR[], 'cur': {cur0}}}, list_transform({pieces}, lambda x: {{'p': x, 'chunks': []::VARCHAR[], 'cur': ''}})),
    lambda a, u: {{'p': '', 'chunks': CASE WHEN {full} THEN list_append(a.chunks, {strip('a.cur')}) ELSE a.chunks END, 'cur': CASE WHEN {full} THEN {opened} ELSE {grown} END}})"""


@query(f"""WITH {_DIALOGUES}, f AS (SELECT conv_id, text, {_fold_sql("string_split(text, chr(10) || chr(10))", "''", "(length(a.cur) + length(u.p) + 2 > 1500 AND a.cur <> '')", "u.p || chr(10) || chr(10)", "a.cur || u.p || chr(10) || chr(10)")} AS f FROM dialogues),
  p AS (SELECT conv_id, length(text) > 1500 AS long, CASE WHEN length(text) <= 1500 THEN [text] ELSE list_append(f.chunks, {strip("f.cur")}) END AS c FROM f)
SELECT conv_id::VARCHAR || CASE WHEN long THEN '_part' || (i + 1) ELSE '' END AS chunk_id, length(c[i + 1])::INT AS char_count, md5(c[i + 1]) AS digest FROM (SELECT *, unnest(range(len(c))) AS i FROM p)""")
def oversize_split_text(spark, sf_dir):
    rows = dialogues(spark, sf_dir).select(F.col("conv_id").cast("string").alias("chunk_id"), "text", F.lit(False).alias("has_table"), F.lit(0).alias("char_count"))
    return chunking.split_oversized(rows).select("chunk_id", "char_count", F.md5("text").alias("digest"))


#: Oversized tables: with a rule line, without one, header alone, and one that fits.
BIG_TABLES = [
    ("a", "TABLE (page 1):\n| Name | Value |\n|---|---|\n" + "\n".join(f"| row {i} | value {i * 7} |" for i in range(120))), ("b", "\n".join(f"plain line number {i}" for i in range(150))),
    ("c", "| " + "h" * 1600 + " |\n|---|"), ("d", "| a |\n|---|\n| 1 |"), ("e", "|h|\n|---|\n" + "w" * 1700 + "\nshort"),
]


@query(f"""WITH t AS (SELECT * FROM (VALUES {_values(BIG_TABLES)}) v(chunk_id, text) UNION ALL
    SELECT l_orderkey::VARCHAR, '| Part | Note |' || chr(10) || '|---|---|' || chr(10) || string_agg('| ' || l_partkey || ' | ' || repeat(l_returnflag || ' ' || l_suppkey || ' ', 60) || '|', chr(10) ORDER BY l_linenumber, '| ' || l_partkey || ' | ' || l_returnflag || ' ' || l_suppkey || ' ') FROM lineitem GROUP BY l_orderkey), l AS (SELECT *, string_split(text, chr(10)) AS lines FROM t),
  r AS (SELECT *, CASE WHEN len(list_filter(lines, lambda x: starts_with({strip("x")}, '|-'))) = 0 THEN 1 ELSE list_position(list_transform(lines, lambda x: starts_with({strip("x")}, '|-')), true) END AS top FROM l),
  h AS (SELECT *, array_to_string(lines[1:top], chr(10)) || chr(10) AS header, lines[top + 1:] AS data FROM r),
  f AS (SELECT *, {_fold_sql("data", "header", "(length(a.cur) + length(u.p) + 1 > 1500 AND a.cur <> header)", "header || u.p || chr(10)", "a.cur || u.p || chr(10)")} AS f FROM h),
  p AS (SELECT chunk_id, length(text) > 1500 AS long, CASE WHEN length(text) <= 1500 OR len(data) = 0 THEN [text] ELSE list_append(f.chunks, {strip("f.cur")}) END AS c FROM f)
SELECT chunk_id || CASE WHEN long THEN '_part' || (i + 1) ELSE '' END AS chunk_id, length(c[i + 1])::INT AS char_count, md5(c[i + 1]) AS digest FROM (SELECT *, unnest(range(len(c))) AS i FROM p)""")
def oversize_split_table(spark, sf_dir):
    """Tables by hand, and one for each order with a row of a long note for each of its (few) line items."""
    rows = spark.createDataFrame([(k, t, True, 0) for k, t in BIG_TABLES], "chunk_id string, text string, has_table boolean, char_count int")
    # what a line is made of is moved, and its long note written where its table is split
    note = F.concat("l_returnflag", F.lit(" "), F.col("l_suppkey").cast("string"), F.lit(" "))
    parts = F.struct("l_linenumber", F.concat(F.lit("| "), F.col("l_partkey").cast("string"), F.lit(" | ")).alias("part"), note.alias("note"))
    lines = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.sort_array(F.collect_list(parts)).alias("l"))
    text = F.concat(F.lit("| Part | Note |\n|---|---|\n"), F.array_join(F.transform("l", lambda x: F.concat(x["part"], F.repeat(x["note"], F.lit(60)), F.lit("|"))), "\n"))
    rows = rows.unionByName(lines.select(F.col("l_orderkey").cast("string").alias("chunk_id"), text.alias("text"), F.lit(True).alias("has_table"), F.lit(0).alias("char_count")))
    return chunking.split_oversized(rows).select("chunk_id", "char_count", F.md5("text").alias("digest"))


@query(f"""WITH l AS (SELECT doc_id, string_split(text, chr(10)) AS a FROM documents), w AS (SELECT doc_id, a, unnest(range(0, len(a), 4)) AS i FROM l),
  b AS (SELECT doc_id, (i + 1)::INT AS start_line, least(i + 5, len(a))::INT AS end_line, array_to_string(a[i + 1:i + 5], chr(10)) AS body FROM w)
SELECT doc_id, start_line, end_line, md5(body) AS digest, (row_number() OVER (PARTITION BY doc_id ORDER BY start_line) - 1)::INT AS chunk_index FROM b WHERE {strip("body")} <> ''""")
def line_windows(spark, sf_dir):
    out = chunking.line_windows(table(spark, sf_dir, "documents"), "doc_id", "text", 5, 1)
    return out.select("doc_id", "start_line", "end_line", F.md5("body").alias("digest"), "chunk_index")


@query("""WITH r AS (SELECT n_regionkey, list(CASE WHEN n_nationkey % 3 = 0 THEN [n_name] ELSE [n_name, n_nationkey::VARCHAR] END ORDER BY n_nationkey) AS rows FROM nation GROUP BY n_regionkey),
  w AS (SELECT *, list_max(list_transform(rows, lambda x: len(x))) AS width FROM r), p AS (SELECT *, list_transform(rows, lambda x: '| ' || array_to_string(list_resize(x, width, ''), ' | ') || ' |') AS lines FROM w)
SELECT n_regionkey, array_to_string(list_concat([lines[1], '|' || array_to_string(list_resize(['---'], width, '---'), '|') || '|'], lines[2:]), chr(10)) AS markdown FROM p""")
def markdown_table(spark, sf_dir):
    cells = F.when(F.col("n_nationkey") % 3 == 0, F.array("n_name")).otherwise(F.array("n_name", F.col("n_nationkey").cast("string")))
    rows = table(spark, sf_dir, "nation").select("n_regionkey", F.struct("n_nationkey", cells.alias("cells")).alias("r")).groupBy("n_regionkey").agg(F.array_sort(F.collect_list("r")).alias("rows"))
    return rows.select("n_regionkey", tables.markdown(F.transform("rows", lambda r: r["cells"])).alias("markdown"))


#: Word boxes of two pages: (page, text, left, top, width, height, conf); overlaps just above and below 0.4.
WORDS = [
    (1, "Name", 10, 100, 40, 10, 90.0), (1, "Value", 100, 102, 40, 10, 80.0), (1, "low", 200, 104, 40, 10, 70.0), (1, "next", 10, 113, 40, 10, 95.0), (1, "row", 60, 115, 40, 10, 85.0), (1, "noise", 5, 100, 5, 5, 9.0),
    (1, " ", 8, 100, 5, 5, 99.0), (2, "A", 50, 10, 10, 10, 60.0), (2, "B", 10, 16, 10, 10, 61.0), (2, "C", 10, 21, 10, 10, 62.0), (2, "D", 90, 15, 10, 10, 63.0), (2, "?", 95, 15, 10, 10, -1.0),
]


@query(f"""WITH RECURSIVE w AS (SELECT page, trim(text) AS text, l::DOUBLE AS l, t::DOUBLE AS t, (t + h)::DOUBLE AS b, conf::DOUBLE AS conf, row_number() OVER (PARTITION BY page ORDER BY t, l, t + h, trim(text)) AS i FROM (SELECT page::BIGINT AS page, text, l, t, w, h, conf FROM (VALUES {_values(WORDS)}) v(page, text, l, t, w, h, conf)
    UNION ALL SELECT l_orderkey + 10, l_returnflag || l_linestatus || l_partkey, l_linenumber * 60, l_suppkey % 40, 40, 10 + l_linenumber % 3, l_quantity FROM lineitem) WHERE trim(text) <> '' AND conf > 10),
  walk AS (SELECT page, i, text, l, conf, 0 AS r, t AS top, b AS bottom FROM w WHERE i = 1 UNION ALL
    SELECT w.page, w.i, w.text, w.l, w.conf, CASE WHEN j THEN r ELSE r + 1 END, CASE WHEN j THEN least(top, w.t) ELSE w.t END, CASE WHEN j THEN greatest(bottom, w.b) ELSE w.b END
    FROM (SELECT walk.*, w.t AS wt, w.b AS wb, (least(bottom, w.b) - greatest(top, w.t)) > 0.4 * least(bottom - top, w.b - w.t) AS j FROM walk JOIN w ON w.page = walk.page AND w.i = walk.i + 1) s JOIN w ON w.page = s.page AND w.i = s.i + 1)
SELECT page, r::INT AS row_index, count(*)::INT AS n_words, string_agg(text, ' ' ORDER BY l, text) AS row_text, round(avg(conf) / 100, 6) AS confidence FROM walk GROUP BY page, r""")
def row_cluster(spark, sf_dir):
    """Word boxes by hand, and one for each line item, its order the page."""
    words = spark.createDataFrame(WORDS, "page int, text string, left int, top int, width int, height int, conf double").withColumn("page", F.col("page").cast("long"))
    n = F.col("l_linenumber").cast("int")
    text = F.concat("l_returnflag", "l_linestatus", F.col("l_partkey").cast("string"))
    items = table(spark, sf_dir, "lineitem").select((F.col("l_orderkey") + 10).cast("long"), text, n * 60, (F.col("l_suppkey") % 40).cast("int"), F.lit(40), n % 3 + 10, F.col("l_quantity").cast("double"))
    words = words.unionByName(items.toDF(*words.columns))
    return tables.cluster_rows(words, ["page"]).withColumn("confidence", F.round("confidence", 6))


@query("""SELECT p_partkey, CASE WHEN p_size / 20 >= 1.6 THEN 1 WHEN p_size / 20 >= 1.3 THEN 2 WHEN p_size / 20 >= 1.15 THEN 3 WHEN p_partkey % 7 = 0 AND length(p_name) < 120 THEN 3 END::INT AS level FROM part""")
def heading_level(spark, sf_dir):
    level = chunking.heading_level(F.col("p_size").cast("double"), F.lit(20.0), F.col("p_partkey") % 7 == 0, F.col("p_name"))
    return table(spark, sf_dir, "part").select("p_partkey", level.cast("int").alias("level"))


@query("""WITH g AS (SELECT p_brand, list_sort(list(p_size::DOUBLE)) AS s, median(p_retailprice) AS m FROM part GROUP BY p_brand) SELECT p_brand, s[len(s) // 2 + 1] AS upper_median, round(m, 4) AS true_median FROM g""")
def medians(spark, sf_dir):
    rows = table(spark, sf_dir, "part").withColumn("p_size", F.col("p_size").cast("double"))
    true_median = rows.groupBy("p_brand").agg(F.round(F.median("p_retailprice"), 4).alias("true_median"))
    return evaluation.upper_median(rows, ["p_brand"], "p_size").join(true_median, "p_brand")


@query("""SELECT page_id, left(sha1(url), 16) AS document_id, format('{}_page_{:04d}', left(sha1(url), 8), page_id) AS page_name, format('{}_p{:04d}_c{:04d}', left(sha1(url), 8), page_id, 7) AS chunk_id, format('{}_p{:04d}_t{:02d}', left(sha1(url), 8), page_id, 2) AS table_id FROM pages""")
def stable_ids(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").withColumn("document_id", ids.document_id(F.col("url")))
    d, n = F.col("document_id"), F.col("page_id")
    return pages.select("page_id", "document_id", ids.page_id(d, n).alias("page_name"), ids.chunk_id(d, n, F.lit(7)).alias("chunk_id"), ids.table_id(d, n, F.lit(2)).alias("table_id"))


@query("""SELECT d.source, count(DISTINCT d.doc_id) AS pages, count(DISTINCT CASE WHEN l.quality = 1 THEN d.doc_id END) AS tables, count(*) AS chunks, array_to_string(list_sort(list(DISTINCT d.lang)), ', ') AS methods
FROM documents d LEFT JOIN labels l USING (doc_id) GROUP BY d.source""")
def document_stats(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left").withColumn("table_id", F.when(F.col("quality") == 1, F.col("doc_id")))
    return evaluation.document_stats(rows, "source", "doc_id", "lang", "table_id")


_REPORT = """report AS (SELECT source, count(*) AS pages, sum(n_chars)::BIGINT AS chars, round_even(min(c), 4) AS min_confidence, round_even(max(c), 4) AS max_confidence, round_even(avg(c), 4) AS mean_confidence
  FROM (SELECT *, CASE WHEN doc_id % 3 = 0 THEN (doc_id % 97) / 97 END AS c FROM documents) GROUP BY source)"""


def _report(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "documents").withColumn("c", F.when(F.col("doc_id") % 3 == 0, (F.col("doc_id") % 97) / 97))
    return evaluation.document_report(pages, "source", "n_chars", "c")


@query(f"WITH {_REPORT} SELECT *, coalesce(mean_confidence < 0.7, false) AS low_confidence FROM report")
def doc_report(spark, sf_dir):
    return _report(spark, sf_dir)


@query(f"""WITH {_REPORT}, s AS (SELECT *, CASE WHEN pages = 0 THEN 'failed' WHEN mean_confidence IS NULL THEN 'ocr_skipped' WHEN mean_confidence < 0.5 THEN 'partial' ELSE 'ok' END AS s FROM report)
SELECT count(*) AS documents, count(*) FILTER (s = 'ok') AS ok, count(*) FILTER (s = 'partial') AS "partial", count(*) FILTER (s = 'failed') AS failed, count(*) FILTER (s = 'ocr_skipped') AS ocr_skipped,
  sum(pages)::BIGINT AS pages, sum(chars)::BIGINT AS chars, round_even(avg(mean_confidence), 4) AS mean_confidence FROM s""")
def run_summary(spark, sf_dir):
    status = F.when(F.col("pages") == 0, "failed").when(F.col("mean_confidence").isNull(), "ocr_skipped").when(F.col("mean_confidence") < 0.5, "partial").otherwise("ok")
    return evaluation.run_summary(_report(spark, sf_dir), status)
