"""Rollups of evaluation facts, retrieval quality, winners and rankings, and the report built on them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusflow.functions.metrics import ascii_bar, winner_direction

SCORES = ("correctness", "relevance", "groundedness", "completeness")


def _mean(column: Column, digits: int = 4) -> Column:
    return F.bround(F.coalesce(F.avg(column), F.lit(0.0)), digits)


def nth_smallest(df: DataFrame, groups: list[str], value: str, rank: Column, out: str, margin: float = 5e-4) -> DataFrame:
    """groups and out: the exact value of a rank (an expression of n, the group's number of values, from 1) in each group.

    A mergeable sketch brackets the rank between its 201 quantiles; only values in the bracket, about a hundredth of a group, are sorted. So a group of
    any size is counted where its rows are, and small groups are bracketed whole. Null values do not count.
    """
    rows = df.where(F.col(value).isNotNull()).select(*groups, F.col(value).alias("_v"))
    at = lambda side: F.percentile_approx("_v", F.array(*(F.lit(i / 200) for i in range(201))), 10_000).alias(side)
    sketch = rows.groupBy(*groups).agg(F.count(F.lit(1)).alias("n"), at("_q")).withColumn("_k", rank.cast("long"))
    step = F.col("_k") / F.col("n") * 200
    low = F.when(step - 1 - 200 * margin >= 0, F.get("_q", F.floor(step - 1 - 200 * margin).cast("int")))
    high = F.when(step + 1 + 200 * margin <= 200, F.get("_q", F.ceil(step + 1 + 200 * margin).cast("int")))
    bracket = sketch.select(*groups, "_k", low.alias("_lo"), high.alias("_hi"))
    placed = rows.join(bracket, groups)
    below = placed.where(F.col("_v") < F.col("_lo")).groupBy(*groups).agg(F.count(F.lit(1)).alias("_below"))
    inside = placed.where((F.col("_lo").isNull() | (F.col("_v") >= F.col("_lo"))) & (F.col("_hi").isNull() | (F.col("_v") <= F.col("_hi"))))
    # equal values meet before they are ordered
    ties = inside.groupBy(*groups, "_k", "_v").agg(F.count(F.lit(1)).alias("_c"))
    upto = F.sum("_c").over(Window.partitionBy(*groups).orderBy("_v").rowsBetween(Window.unboundedPreceding, 0))
    ranked = ties.withColumn("_upto", upto).join(below, groups, "left").withColumn("_upto", F.col("_upto") + F.coalesce("_below", F.lit(0)))
    return ranked.where((F.col("_upto") >= F.col("_k")) & (F.col("_upto") - F.col("_c") < F.col("_k"))).select(*groups, F.col("_v").alias(out))


def p95_by_group(df: DataFrame, groups: list[str], value: str, out: str = "p95", digits: int = 3) -> DataFrame:
    """The int(n * 0.95)-th smallest value of each group, of one value that one."""
    k = F.floor(F.col("n") * F.lit(0.95))
    found = nth_smallest(df, groups, value, F.when(k == 0, F.col("n")).otherwise(k), out)
    return found.withColumn(out, F.round(out, digits))


def upper_median(df: DataFrame, groups: list[str], value: str, out: str = "upper_median") -> DataFrame:
    return nth_smallest(df, groups, value, F.floor(F.col("n") / 2) + 1, out)


def model_summary(facts: DataFrame, model: str = "model", latency: str = "latency", correct: str = "correct", means: tuple[str, ...] = (), flag: str | None = None) -> DataFrame:
    """model, questions, correct, accuracy, avg_<mean>..., [flag_rate,] avg_latency, p95_latency."""
    out = facts.groupBy(model).agg(
        F.count(F.lit(1)).alias("questions"), F.sum(F.col(correct).cast("long")).alias("correct"), _mean(F.col(correct).cast("int")).alias("accuracy"), *(_mean(F.col(c)).alias(f"avg_{c}") for c in means),
        *([_mean(F.col(flag).cast("int")).alias("flag_rate")] if flag else []), _mean(F.col(latency), 3).alias("avg_latency"),
    )
    return out.join(p95_by_group(facts, [model], latency, "p95_latency"), model, "left").fillna(0.0, ["p95_latency"])


def token_means(columns: tuple[str, ...]) -> list[Column]:
    """avg_<column>: means over all rows of a group, a missing count being 0, rounded half to even to whole numbers."""
    return [F.bround(F.sum(F.coalesce(F.col(c), F.lit(0))) / F.count(F.lit(1)), 0).cast("long").alias(f"avg_{c}") for c in columns]


def token_sums(facts: DataFrame, groups: list[str], columns: tuple[str, ...]) -> DataFrame:
    """groups, sum_<column> and avg_<column> of counts of tokens."""
    sums = [F.sum(F.coalesce(F.col(c), F.lit(0))).cast("long").alias(f"sum_{c}") for c in columns]
    return facts.groupBy(*groups).agg(*sums, *token_means(columns))


def category_summary(
    facts: DataFrame, categories: DataFrame, models: DataFrame, category: str = "category", model: str = "model", scores: tuple[str, ...] = SCORES, latency: str = "latency", flag: str | None = None,
    means: tuple[str, ...] = (), tokens: tuple[str, ...] = (),
) -> DataFrame:
    """Every category and model, zeros where no fact is: questions, llm_accuracy (share of the first score >= 3), avg_<score> (over
    5) of each score, [hallucination_rate (share of flag),] avg_<mean>..., avg_<token>... (rounded half to even to a whole
    number), avg_latency, p95_latency. Facts of other categories are left out. Both lists are a handful of names."""
    grid = categories.select(category).distinct().join(models.select(model).distinct(), how="cross")
    grouped = facts.groupBy(category, model).agg(
        F.count(F.lit(1)).alias("questions"), _mean((F.col(scores[0]) >= 3).cast("int")).alias("llm_accuracy"), *(_mean(F.col(s) / 5).alias(f"avg_{s}") for s in scores),
        *([_mean(F.coalesce(F.col(flag), F.lit(False)).cast("int")).alias("hallucination_rate")] if flag else []), *(_mean(F.col(c)).alias(f"avg_{c}") for c in means), *token_means(tokens),
        _mean(F.col(latency), 3).alias("avg_latency"),
    ).join(p95_by_group(facts, [category, model], latency, "p95_latency"), [category, model], "left")
    values = [c for c in grouped.columns if c not in (category, model)]
    return grid.join(grouped, [category, model], "left").select(category, model, *(F.coalesce(F.col(c), F.lit(0)).cast(dict(grouped.dtypes)[c]).alias(c) for c in values))


def overall_unweighted(summary: DataFrame, model: str = "model", columns: tuple[str, ...] = ("llm_accuracy", "avg_correctness", "avg_latency")) -> DataFrame:
    """Means over categories of the categories' means, each category counting once."""
    return summary.groupBy(model).agg(*(F.round(F.avg(c), 6).alias(c) for c in columns))


def metric_winners(summary: DataFrame, by: str, model: str, metrics: list[str], order: str | None = None) -> DataFrame:
    """by, metric, winner: the best model by the metric's direction; the first in `order` (model name) wins ties."""
    entries = F.array(*(F.struct(F.lit(m).alias("metric"), F.lit(winner_direction(m)).alias("way"), F.col(m).cast("double").alias("value")) for m in metrics))
    rows = summary.select(by, F.col(model).alias("_m"), F.col(order or model).alias("_o"), F.explode(entries).alias("e")).select(by, "_m", "_o", "e.*")
    value = F.coalesce("value", F.when(F.col("way") < 0, F.lit(float("inf"))).otherwise(F.lit(0.0)))
    best = Window.partitionBy(by, "metric").orderBy(F.desc(value * F.col("way")), "_o")
    return rows.withColumn("_r", F.row_number().over(best)).where("_r = 1").select(by, "metric", F.when(F.col("way") == 0, "N/A").otherwise(F.col("_m")).alias("winner"))


def category_winners(summary: DataFrame, by: str, model: str, score: str) -> DataFrame:
    """by, winner, best: "Tie" if more than one model has the highest score and it is above 0; at 0 the first model."""
    rows = summary.join(summary.groupBy(by).agg(F.max(score).alias("best")), by)
    return rows.where(F.col(score) == F.col("best")).groupBy(by).agg(F.when((F.count(F.lit(1)) > 1) & (F.max("best") > 0), "Tie").otherwise(F.min(model)).alias("winner"), F.max("best").alias("best"))


def model_ranking(summary: DataFrame, model: str, score: str) -> DataFrame:
    """model, score, rank by descending score, ties by name, with a bar. One row a model."""
    rank = F.row_number().over(Window.orderBy(F.desc(score), model))
    return summary.select(model, score, rank.cast("int").alias("rank"), ascii_bar(F.col(score)).alias("bar"))


def retrieval_quality(hits: DataFrame, queries: DataFrame, query: str = "query_id", expected: str = "expected", retrieved: str = "document_name", rank: str = "rank") -> DataFrame:
    """queries, recall_at_1, recall_at_3, recall_at_5, mrr: a hit is a retrieved name that contains the expected one."""
    found = hits.join(queries, query).where(F.contains(F.col(retrieved).cast("string"), F.col(expected).cast("string")) & (F.col(rank) <= 5))
    first = found.groupBy(query).agg(F.min(rank).alias("first"))
    rows = queries.select(query).join(first, query, "left")
    within = lambda k: F.bround(F.avg(F.when(F.col("first") <= k, 1.0).otherwise(0.0)), 4).alias(f"recall_at_{k}")
    return rows.agg(F.count(F.lit(1)).alias("queries"), within(1), within(3), within(5), F.bround(F.avg(F.coalesce(1 / F.col("first"), F.lit(0.0))), 4).alias("mrr"))


def document_stats(chunks: DataFrame, document: str, page: str, method: str, table_id: str) -> DataFrame:
    """document, pages, tables, chunks, methods (sorted, joined by ', '; "native" for none). Rows without a document are left out."""
    methods = F.array_join(F.array_sort(F.collect_set(method)), ", ")
    return chunks.where(F.col(document).isNotNull()).groupBy(document).agg(
        F.count_distinct(page).alias("pages"), F.count_distinct(table_id).alias("tables"), F.count(F.lit(1)).alias("chunks"), F.when(methods == "", "native").otherwise(methods).alias("methods")
    )


def document_report(pages: DataFrame, document: str, chars: str, confidence: str, low: float = 0.70) -> DataFrame:
    """document, pages, chars, min/max/mean confidence (of pages that have one, rounded to 4), low_confidence."""
    c = F.col(confidence)
    out = pages.groupBy(document).agg(
        F.count(F.lit(1)).alias("pages"), F.sum(chars).alias("chars"), F.bround(F.min(c), 4).alias("min_confidence"), F.bround(F.max(c), 4).alias("max_confidence"), F.bround(F.avg(c), 4).alias("mean_confidence")
    )
    return out.withColumn("low_confidence", F.coalesce(F.col("mean_confidence") < low, F.lit(False)))


def run_summary(report: DataFrame, status: Column, chars: str = "chars", pages: str = "pages", confidence: str = "mean_confidence") -> DataFrame:
    """One row over all documents: counts by status, sums, and the mean of the documents' means."""
    rows = report.withColumn("_s", status)
    when = lambda s: F.count_if(F.col("_s") == s).alias(s)
    return rows.agg(F.count(F.lit(1)).alias("documents"), when("ok"), when("partial"), when("failed"), when("ocr_skipped"), F.sum(pages).alias("pages"), F.sum(chars).alias("chars"), F.bround(F.avg(confidence), 4).alias("mean_confidence"))


def suite_rollup(results: DataFrame, test_id: str, passed: str) -> DataFrame:
    """suite (first three characters of the id), total, passed, failed."""
    return results.groupBy(F.substring(test_id, 1, 3).alias("suite")).agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col(passed)).alias("passed"), F.count_if(~F.col(passed)).alias("failed"))


def score_delta(summary: DataFrame, model: str, new: str, old: str) -> DataFrame:
    """model, new, old and what the new score adds to the old one."""
    return summary.select(model, new, old, F.round(F.col(new) - F.col(old), 4).alias("delta"))


def render_report(ranking: DataFrame, winners: DataFrame, title: str = "Model evaluation") -> str:
    """Markdown of a ranking and of the winners by category: a handful of rows each, collected to be written."""
    lines = [f"# {title}", "", "## Ranking", ""]
    lines += ["| " + " | ".join(map(str, r)) + " |" for r in [tuple(ranking.columns), ("---",) * len(ranking.columns), *ranking.orderBy("rank").collect()]]
    lines += ["", "## Winners", ""]
    lines += ["| " + " | ".join(map(str, r)) + " |" for r in [tuple(winners.columns), ("---",) * len(winners.columns), *winners.orderBy(*winners.columns).collect()]]
    return "\n".join(lines) + "\n"


def write_report(ranking: DataFrame, winners: DataFrame, path: str, title: str = "Model evaluation") -> None:
    """The rendered report as one text file in the folder `path`, on any file system."""
    spark = ranking.sparkSession
    spark.createDataFrame([(render_report(ranking, winners, title).rstrip("\n"),)], "value string").coalesce(1).write.mode("overwrite").text(path)


def write_summaries(path: str, **summaries: DataFrame) -> None:
    """Each rollup (a row per model or category) as JSON lines in one file in a folder of its name under `path`."""
    for name, rows in summaries.items():
        rows.coalesce(1).write.mode("overwrite").json(f"{path.rstrip('/')}/{name}")


def file_stamp(at: Column | None = None) -> Column:
    """Date and time as in file names, of a moment or of now."""
    return F.date_format(F.current_timestamp() if at is None else at, "yyyyMMdd_HHmmss")


def questions_by_model(questions: DataFrame, models: DataFrame, model: str = "model", safe: str | None = "oom_safe") -> DataFrame:
    """Every question for every model (those marked safe, where models has such a column): a handful of models by a list of
    questions, dealt by model so that an adapter loads each once per task."""
    chosen = models.where(F.col(safe)) if safe and safe in models.columns else models
    return questions.join(chosen, how="cross").repartition(model)
