"""Quality rules with thresholds that follow the data, on DataFrame functions alone.

Features of each text come from column expressions. For each (language, source) a mergeable KLL sketch holds the
distribution of every feature; the sketches of all sources of a language, and of all languages, are merged from
those, not computed anew. A group's thresholds are Tukey fences on its sketch: the upper quartile plus (lower less)
`reach` times the interquartile range, widened by a floor so that a feature that hardly varies rejects nothing.
Groups with fewer than `min_group` documents take the fences of their language, and languages with fewer those of
the whole corpus. Documents join their group's fences, and are kept if no feature lies outside.

Nulls: a null text has no words and fails the base rule; null lang or source form a group of their own. A very long text
is one row like any other: its words are an array in one task. Equal rows and ties get equal verdicts: a value that equals
a fence is inside. An empty table gives no rows. Extra columns are carried in the struct `row`, whatever their names.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusflow.llm.common import materialize, read_table

#: White space of the word rule: space, tab, line feed, vertical tab, form feed, carriage return.
SPACES = "[\\x20\\x09-\\x0D]+"
SYMBOLS = "[#*$%&|<>]"


@dataclass(frozen=True)
class Rules:
    min_words: int = 50
    max_repeat_percent: int = 50
    reach: float = 3.0
    min_group: int = 200
    sketch_k: int = 400
    broadcast_groups: int = 100_000
    salts: int = 64


#: Feature, sides that are fenced, floor of the fence's distance from the quartile.
FEATURES = {
    "mean_word_chars": ("both", 1.5),
    "symbol_share": ("upper", 0.02),
    "dup_line_share": ("upper", 0.50),
    "repeat_share": ("upper", 0.20),
}


def _let(value: Column, body) -> Column:
    """body(value) with the value computed once a row, however often the body's lambdas use it."""
    return F.transform(F.array(value), body)[0]


def words_of(text: Column) -> Column:
    """Words [^\\x20\\x09-\\x0D]+ of a text; null gives none."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACES), lambda w: w != "")


def repeated_window_words(words: Column, width: int = 3) -> Column:
    """Words that lie in a window of `width` words found at least twice in the array.

    Windows are their 64-bit hashes, each beside its place; once sorted, equal hashes are neighbours.
    """

    def marked(w: Column) -> Column:
        n = F.size(w)
        keys = F.transform(F.sequence(F.lit(0), n - width), lambda i: F.struct(F.xxhash64(*(F.get(w, i + k) for k in range(width))).alias("h"), i.alias("p")))

        def covered(s: Column) -> Column:
            # beyond the ends the neighbour is null, and so is the comparison
            same = lambda x, i: F.coalesce(x["h"] == F.get(s, i)["h"], F.lit(False))
            at = F.filter(s, lambda x, i: same(x, i - 1) | same(x, i + 1))
            places = F.array_sort(F.transform(at, lambda x: x["p"]))
            own = lambda p: F.transform(p, lambda x, i: F.least(F.lit(width), F.coalesce(F.get(p, i + 1) - x, F.lit(width))))
            return _let(places, lambda p: F.aggregate(own(p), F.lit(0).cast("long"), lambda a, x: a + x))

        return _let(F.sort_array(keys), covered)

    return F.when(F.size(words) < width + 1, F.lit(0).cast("long")).otherwise(_let(words, marked))


def text_features(docs: DataFrame) -> DataFrame:
    """Add n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words (long) to rows with a text column."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: F.length(F.btrim(x, F.lit(" \t\n\x0b\x0c\r"))) > 0)
    return (
        docs.withColumn("_words", words_of(F.col("text").cast("string")))
        .withColumn(
            "_f",
            _let(
                F.col("_words"),
                lambda w: F.struct(
                    F.size(w).cast("long").alias("n_words"),
                    F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
                    repeated_window_words(w).alias("n_repeat_words"),
                ),
            ),
        )
        .withColumn("n_words", F.col("_f.n_words"))
        .withColumn("word_chars", F.col("_f.word_chars"))
        .withColumn("n_symbols", F.regexp_count(text, F.lit(SYMBOLS)).cast("long"))
        .withColumn("_l", _let(lines, lambda x: F.struct(F.size(x).cast("long").alias("n"), F.size(F.array_distinct(x)).cast("long").alias("d"))))
        .withColumn("n_lines", F.col("_l.n"))
        .withColumn("n_dup_lines", F.col("_l.n") - F.col("_l.d"))
        .withColumn("n_repeat_words", F.col("_f.n_repeat_words"))
        .drop("_words", "_f", "_l")
    )


def _shares(df: DataFrame) -> DataFrame:
    words = F.greatest(F.col("n_words"), F.lit(1)).cast("double")
    return df.withColumns({
        "mean_word_chars": F.col("word_chars") / words,
        "symbol_share": F.col("n_symbols") / F.greatest(F.col("word_chars"), F.lit(1)).cast("double"),
        "dup_line_share": F.col("n_dup_lines") / F.greatest(F.col("n_lines"), F.lit(1)).cast("double"),
        "repeat_share": F.col("n_repeat_words") / words,
    })


def group_fences(features: DataFrame, rules: Rules) -> DataFrame:
    """Fences per (lang, source): lo_<feature> and hi_<feature>, from sketches merged up where a group is small."""
    base = features.where("not base_failed")
    sketch = [F.kll_sketch_agg_double(F.col(f), F.lit(rules.sketch_k)).alias(f) for f in FEATURES]
    count = F.count(F.lit(1)).alias("n")
    # every group gets a row of its own, also where all its documents fail the base rule
    cells = features.select("lang", "source").distinct()
    leaf = base.groupBy("lang", "source").agg(count, *sketch)
    merged = [F.kll_merge_agg_double(F.col(f)).alias(f) for f in FEATURES]
    by_lang = leaf.groupBy("lang").agg(F.sum("n").alias("n"), *merged)
    overall = leaf.agg(F.sum("n").alias("n"), *merged)

    def fenced(df: DataFrame, name: str) -> Column:
        out = []
        for f, (sides, floor) in FEATURES.items():
            q = [F.kll_sketch_get_quantile_double(F.col(f), F.lit(p)) for p in (0.25, 0.75)]
            slack = F.greatest((q[1] - q[0]) * F.lit(rules.reach), F.lit(floor))
            out += [(q[0] - slack if sides == "both" else F.lit(None).cast("double")).alias(f"lo_{f}"), (q[1] + slack).alias(f"hi_{f}")]
        return F.struct(F.col("n"), *out).alias(name)

    own = leaf.select("lang", "source", fenced(leaf, "own"))
    lang = by_lang.select(F.col("lang").alias("l_lang"), fenced(by_lang, "of_lang"))
    every = overall.where("n is not null").select(F.lit(1).alias("one"), fenced(overall, "of_all"))
    enough = lambda c: F.col(f"{c}.n") >= rules.min_group
    return (
        cells.join(own.withColumnsRenamed({"lang": "o_lang", "source": "o_source"}), F.col("lang").eqNullSafe(F.col("o_lang")) & F.col("source").eqNullSafe(F.col("o_source")), "left")
        .join(lang, F.col("lang").eqNullSafe(F.col("l_lang")), "left")
        .join(every, F.col("one") == F.lit(1), "left")
        .withColumn("fence", F.when(enough("own"), F.col("own")).when(enough("of_lang"), F.col("of_lang")).otherwise(F.col("of_all")))
        .select(F.col("lang").alias("f_lang"), F.col("source").alias("f_source"), "fence")
    )


def _beside(features: DataFrame, fences: DataFrame, rules: Rules) -> DataFrame:
    """features with their group's fence, without moving the documents of a group together.

    The fences, one row per language and source, are written and counted: up to `broadcast_groups` of them are broadcast;
    more are joined by hash, every group dealt to `salts` keys so that a hot group is many tasks.
    """
    fences = materialize(fences, "quality-fences")
    same = F.col("lang").eqNullSafe(F.col("f_lang")) & F.col("source").eqNullSafe(F.col("f_source"))
    if fences.count() <= rules.broadcast_groups:
        return features.join(F.broadcast(fences), same, "left")
    dealt = features.withColumn("_salt", F.pmod(F.xxhash64(*(c for c, t in features.dtypes if t in ("bigint", "double"))), F.lit(rules.salts)))
    every = fences.withColumn("f_salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(rules.salts - 1).cast("long"))))
    return dealt.join(every, same & (F.col("_salt") == F.col("f_salt")), "left")


def judge_quality(docs: DataFrame, rules: Rules = Rules(), carry: list[str] | None = None) -> DataFrame:
    """One row per row of docs: row (its columns, or those of carry, whatever their names, as a struct), the features,
    base_failed and kept. Documents that fail a fence or the base rule are not kept."""
    base = (F.col("n_words") < rules.min_words) | (F.lit(100) * F.col("n_repeat_words") > F.lit(rules.max_repeat_percent) * F.col("n_words"))
    own = [(F.col(f"`{c}`") if c in docs.columns else F.lit(None)).cast("string").alias(c) for c in ("lang", "source", "text")]
    rows = docs.select(F.struct(*(f"`{c}`" for c in carry or docs.columns)).alias("row"), *own)
    features = materialize(text_features(rows).drop("text").withColumn("base_failed", base), "quality-features")
    features = _shares(features)
    fences = group_fences(features.drop("row"), rules)
    inside = F.lit(True)
    for f in FEATURES:
        inside = inside & F.coalesce(F.col(f) >= F.col(f"fence.lo_{f}"), F.lit(True)) & F.coalesce(F.col(f) <= F.col(f"fence.hi_{f}"), F.lit(True))
    joined = _beside(features, fences, rules)
    return joined.select("row", "n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "base_failed", (~F.col("base_failed") & inside).alias("kept"), *FEATURES)


def op9_adaptive_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = judge_quality(read_table(spark, sf_dir, "documents"), carry=["doc_id"])
    return out.select("row.doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
