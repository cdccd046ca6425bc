"""Removal of recurring lines by a log-template tree of fixed depth, on DataFrame functions alone.

A line is its tokens, those with a digit replaced by a wildcard. The tree has a level for the number of tokens, one for each of
the first `depth` tokens, and below each such leaf one for a stretch of the places after them. Blank lines are none, and
documents with the same text count as one.

1. Lines with the same tokens are one template; it recurs if `min_docs` documents have it.
2. Other templates have variable fields: of the m places after the leading tokens, at most (1 - similarity) * m may
   vary. Cut into one stretch more than that, those places have a stretch without a variable field. So every line has a
   node for each of its stretches, and lines of one template share one, beside which other templates of the leaf have nodes of their own.
   A line stands at the one of its nodes that most documents share, `min_docs` at least (of equal ones the first). There, tokens that as
   many documents have at their place are constants and the others become wildcards. Lines that come out alike, with constants at `similarity` of the places at least, are one template; it recurs
   if `min_docs` documents have it.
3. Lines of recurring templates go, unless they hold half of the document's words or more (`most`). Such a document is a
   copy of others or little else than what they share; it keeps all of its lines, for deduplication of documents to judge. So no text is
   emptied, and the lines of near copies stay, wherever those differ. The lines spared are counted.

All thresholds are numbers of documents: copies of one text neither cause nor prevent the loss of a line in other texts, but that at
least `min_docs` unlike texts have it.

Every count is a grouped sum with map-side combination; a hot template is one row per task. Lines meet the leaves, nodes and
templates that matter by broadcast where those are counted to be few, by hash otherwise; documents join their list of dropped
places by their id and text, the one shuffle of texts.

Nulls: a null text stays null. Blank lines are kept. Rows with equal texts lose equal lines. A very long text is its lines,
each of them judged; ties cannot arise but for equal hashes. An empty table gives no
rows. All other columns pass through, whatever their names, but for n_lines, n_dropped and n_spared, which are replaced.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusflow.llm.common import forget, materialize, read_table, unused
from corpusflow.llm.quality import SPACES, _let

#: A token with a digit; it starts where no token character precedes, so the scan is linear.
NUMBERED = "(?<![^\\x20\\x09-\\x0D])[^\\x20\\x09-\\x0D0-9]*+[0-9][^\\x20\\x09-\\x0D]*+"
#: Lines with a digit, or whose tokens do not stand apart by one space each.
ODD = "[0-9\\x09-\\x0D]|  |^ | $"
OWN = ("n_lines", "n_dropped", "n_spared")


@dataclass(frozen=True)
class Lines:
    depth: int = 2
    min_docs: int = 10
    similarity: float = 0.75
    most: float = 0.5
    broadcast_rows: int = 500_000

    @property
    def min_tokens(self) -> int:
        """Lines with fewer have no place that may vary."""
        m = 1
        while int(m * (1 - self.similarity)) < 1:
            m += 1
        return self.depth + m


def _tokens(line: Column) -> Column:
    masked = F.when(line.rlike("[0-9]"), F.regexp_replace(line, NUMBERED, "<*>")).otherwise(line)
    return F.filter(F.split(masked, SPACES), lambda t: t != "")


def _text() -> Column:
    return F.coalesce(F.col("text").cast("string"), F.lit(""))


def _row() -> Column:
    """Of rows with the same id and text."""
    return F.xxhash64(F.col("doc_id"), _text())


def _parsed(p: Lines) -> Column:
    """Array of (pos, template, leaf, n, total, line) of the lines of text that are not blank: total is the number of tokens of all of
    them, line the text of those long enough to be generalised."""
    lines = F.split(_text(), "\n")
    of = lambda n, t, template: F.struct(F.xxhash64(template).alias("template"), F.xxhash64(n, *(F.get(t, F.lit(i)) for i in range(p.depth))).alias("leaf"), n.alias("n"))
    spaces = lambda x: F.octet_length(x) - F.octet_length(F.replace(x, F.lit(" "), F.lit("")))
    # plain lines, nearly all: tokens are counted by their spaces, and only the leading ones are cut off
    plain = lambda x: of(spaces(x) + 1, F.split(x, " ", p.depth + 1), x)
    any_ = lambda x: _let(_tokens(x), lambda t: of(F.size(t), t, F.array_join(t, " ")))
    each = F.transform(lines, lambda x, i: F.struct(i.alias("pos"), x.alias("line"), F.when((x != "") & ~x.rlike(ODD), plain(x)).otherwise(any_(x)).alias("of")))
    solid = F.filter(each, lambda s: s["of"]["n"] > 0)
    total = lambda a: F.aggregate(a, F.lit(0).cast("long"), lambda x, s: x + s["of"]["n"])
    row = lambda s, n: F.struct(s["pos"].alias("pos"), *(s["of"][c].alias(c) for c in ("template", "leaf", "n")), n.alias("total"), F.when(s["of"]["n"] >= p.min_tokens, s["line"]).alias("line"))
    return _let(solid, lambda a: _let(total(a), lambda n: F.transform(a, lambda s: row(s, n))))


def _shared(lines: DataFrame, by: str, p: Lines) -> DataFrame:
    """Values of `by` that enough documents have."""
    return lines.groupBy(by, "key").agg(F.lit(1).alias("x")).groupBy(by).agg(F.count(F.lit(1)).alias("docs")).where(F.col("docs") >= p.min_docs).select(by)


def _few(df: DataFrame, label: str, p: Lines) -> DataFrame:
    """df (rows of one or two numbers) written and counted; up to broadcast_rows it is broadcast, beyond that joined by hash,
    where AQE splits the partition of a hot key."""
    df = materialize(df, label)
    return F.broadcast(df) if df.count() <= p.broadcast_rows else df


def _nodes(rest: Column, leaf: Column, p: Lines) -> Column:
    """Array of the nodes of a line, one for each stretch of its tokens after the leading ones."""

    def cut(r: Column) -> Column:
        m = F.size(r)
        n = F.floor(m * F.lit(1 - p.similarity)).cast("int") + 1
        at = lambda s: F.floor(s * m / n).cast("int")
        return F.transform(F.sequence(F.lit(0), n - 1), lambda s: F.xxhash64(leaf, s, F.slice(r, at(s) + 1, at(s + 1) - at(s))))

    return _let(rest, cut)


def generalised_templates(lines: DataFrame, exact: DataFrame, p: Lines) -> DataFrame:
    """Templates, other than exact ones, whose lines recur with variable fields."""
    long_ = lines.where(F.col("line").isNotNull())
    some = long_.join(_few(_shared(long_, "leaf", p), "leaves", p), "leaf", "left_semi").join(exact, "template", "left_anti")
    rest = lambda: F.slice(_tokens(F.col("line")), p.depth + 1, F.size(_tokens(F.col("line"))))
    placed = some.select("key", "template", F.posexplode(_nodes(rest(), F.col("leaf"), p)).alias("stretch", "node"))
    several = placed.groupBy("node").agg(F.min("template").alias("lo"), F.max("template").alias("hi"), F.count(F.lit(1)).alias("n")).where((F.col("lo") < F.col("hi")) & (F.col("n") >= p.min_docs))
    near = materialize(placed.join(_few(several.select("node"), "shared-nodes", p), "node", "left_semi"), "node-lines")
    docs = near.groupBy("node", "key").agg(F.lit(1).alias("x")).groupBy("node").agg(F.count(F.lit(1)).alias("docs")).where(F.col("docs") >= p.min_docs)
    # a template stands at the most shared of its nodes, the first of them
    best = near.join(_few(docs, "nodes", p), "node").groupBy("template").agg(F.max_by("node", F.struct("docs", -F.col("stretch"))).alias("node"))
    best = materialize(best, "template-nodes")
    owners = materialize(near.join(_few(best.select("template"), "node-templates", p), "template", "left_semi").groupBy("template", "key").agg(F.lit(1).alias("x")).drop("x"), "template-documents")
    texts = some.join(_few(best.select("template"), "node-templates", p), "template", "left_semi").groupBy("template").agg(F.first("line").alias("line"))
    each = best.join(owners.groupBy("template").agg(F.count(F.lit(1)).alias("docs")), "template").join(texts, "template")
    tokens = materialize(each.select("node", "template", "docs", F.posexplode(rest()).alias("place", "token")), "node-tokens")
    frequent = tokens.groupBy("node", "place", "token").agg(F.sum("docs").alias("docs")).where(F.col("docs") >= p.min_docs).select("node", "place", "token", F.lit(True).alias("constant"))
    masked = tokens.join(frequent, ["node", "place", "token"], "left").groupBy("node", "template").agg(F.count("constant").alias("constants"), F.count(F.lit(1)).alias("places"), F.array_sort(F.collect_list(F.struct("place", F.when(F.col("constant"), F.col("token")).alias("token")))).alias("general"))
    fits = masked.where(F.col("constants") >= F.col("places") * p.similarity).select("template", F.xxhash64("node", F.to_json("general")).alias("general"))
    fits = materialize(fits, "general-templates")
    recurring = _shared(owners.join(fits, "template"), "general", p)
    out = materialize(fits.join(recurring, "general", "left_semi").select("template"), "recurring-templates")
    forget(near, best, owners, tokens, fits)
    return out


def drop_recurring_lines(docs: DataFrame, p: Lines = Lines()) -> DataFrame:
    """docs with the recurring lines gone from text, and n_lines (not blank), n_dropped and n_spared (long) added."""
    columns = [c for c in docs.columns if c not in OWN]
    lines = materialize(docs.select(_row().alias("row"), F.xxhash64(_text()).alias("key"), F.explode(_parsed(p)).alias("line")).select("row", "key", "line.*"), "lines")
    exact = _few(_shared(lines, "template", p), "templates", p)
    gone = _few(exact.unionByName(generalised_templates(lines, exact, p)), "all-templates", p)
    key, drop = unused(docs, "__key"), unused(docs, "__drop")
    found = lines.join(gone, "template", "left_semi").groupBy("row").agg(F.max("total").alias("total"), F.collect_set(F.struct("pos", "n")).alias("lost"))
    words = F.aggregate("lost", F.lit(0).cast("long"), lambda x, s: x + s["n"])
    places = found.select(F.col("row").alias(key), F.struct((words >= F.col("total") * p.most).alias("spared"), F.transform("lost", lambda s: s["pos"]).alias("at")).alias(drop))
    places = materialize(places, "line-drops")
    forget(lines)  # the drops are all that the result needs
    every = F.split(F.col("text").cast("string"), "\n")
    kept = lambda x: F.transform(F.array_except(F.sequence(F.lit(0), F.size(x) - 1), F.col(drop)["at"]), lambda i: F.get(x, i))
    loses = F.coalesce(~F.col(drop)["spared"], F.lit(False))
    text = F.when(loses, _let(every, lambda x: F.array_join(kept(x), "\n"))).otherwise(F.col("text").cast("string"))
    # by hash at every size: the places grow with the documents
    rows = docs.select(*(f"`{c}`" for c in columns)).withColumn(key, _row()).join(places.hint("merge"), key, "left")
    solid = F.size(F.filter(every, lambda x: F.length(F.btrim(x, F.lit(" \t\n\x0b\x0c\r"))) > 0))
    found_here = F.coalesce(F.size(F.col(drop)["at"]), F.lit(0))
    own = {"n_lines": F.when(F.col("text").isNull(), 0).otherwise(solid), "n_dropped": F.when(loses, found_here).otherwise(0), "n_spared": F.when(loses, 0).otherwise(found_here)}
    rows = rows.withColumns({c: v.cast("long") for c, v in own.items()})
    return rows.withColumn("text", text).select(*(f"`{c}`" for c in columns), *OWN)


def op8_line_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = drop_recurring_lines(read_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_dropped", "n_spared", F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256"))
