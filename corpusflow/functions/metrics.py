"""Scores of answers as expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from corpusflow.config import REFUSAL
from corpusflow.functions.text import is_refusal, let, number_facts, strip, token_f1

SCORES = ("correctness", "relevance", "groundedness", "completeness")


def answer_accuracy(answer: Column, reference: Column, answerable: Column, least: float = 0.10) -> Column:
    refused = is_refusal(answer, REFUSAL)
    return F.when(~answerable, refused).when(refused, F.lit(False)).otherwise(token_f1(answer, reference) > least)


def answer_relevance(answer: Column, question: Column) -> Column:
    return F.when(is_refusal(answer, REFUSAL), F.lit(0)).otherwise(let(token_f1(answer, question), lambda f: F.when(f >= 0.25, F.lit(2)).when(f >= 0.08, F.lit(1)).otherwise(F.lit(0))))


def semantic_similarity(answer: Column, reference: Column, cosine: Column | None = None) -> Column:
    """A cosine clamped to 0..1 and rounded to 4; without one the token F1; 0 if either text is blank."""
    clamped = token_f1(answer, reference) if cosine is None else F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), cosine)), 4)
    return F.when((strip(answer) == "") | (strip(reference) == ""), F.lit(0.0)).otherwise(clamped)


def hallucination_rate(answer: Column, context: Column) -> Column:
    """Share of the answer's numeric facts that the context lacks; 0 for refusals and answers without facts."""
    facts = F.struct(number_facts(answer).alias("a"), number_facts(context).alias("c"))
    share = let(facts, lambda f: F.when(F.size(f["a"]) == 0, F.lit(0.0)).otherwise(F.bround(F.size(F.array_except(f["a"], f["c"])) / F.size(f["a"]), 4)))
    return F.when(is_refusal(answer, REFUSAL), F.lit(0.0)).otherwise(share)


def recall_at_k(retrieved: Column, expected: Column) -> Column:
    """Share of the expected names among the retrieved ones, exactly; 1 if none is expected."""
    hits = F.size(F.filter(expected, lambda e: F.array_contains(retrieved, e)))
    return F.when(F.size(expected) == 0, F.lit(1.0)).otherwise(hits / F.size(expected))


def clamp_score(value: Column) -> Column:
    """0..5, decimals truncated, anything that is no number 0."""
    return F.greatest(F.lit(0), F.least(F.lit(5), F.coalesce(value.try_cast("double").try_cast("int"), F.lit(0))))


def judge_scores(raw: Column) -> Column:
    """Struct of a judge's reply: the first {...} (up to the first closing brace), its four scores clamped, the flag, and
    normalized_score = sum / 20. Null if there is no JSON with all four scores and the flag."""
    found = F.regexp_extract(raw, r"(?s)(\{.*?\})", 1)
    fields = {k: F.get_json_object(found, f"$.{k}") for k in (*SCORES, "hallucination_flag", "reasoning")}
    complete = found != ""
    for k in (*SCORES, "hallucination_flag"):
        complete = complete & fields[k].isNotNull()
    clamped = {k: clamp_score(fields[k]) for k in SCORES}
    total = sum(clamped.values(), F.lit(0))
    return F.when(
        complete,
        F.struct(
            *(v.alias(k) for k, v in clamped.items()),
            F.coalesce(fields["hallucination_flag"].try_cast("boolean"), F.lit(True)).alias("hallucination_flag"),
            F.coalesce(fields["reasoning"], F.lit("")).alias("reasoning"),
            F.round(total / 20, 4).alias("normalized_score"),
        ),
    )


def judge_fallback(candidate: Column, reference: Column, question: Column) -> Column:
    """Scores from word overlap alone, halves rounded to even."""
    own = let(F.struct(token_f1(candidate, reference).alias("r"), token_f1(candidate, question).alias("q")), lambda f: F.struct(F.bround(f["r"] * 5).cast("int").alias("c"), F.when(is_refusal(candidate, REFUSAL), F.lit(0)).otherwise(F.bround(F.least(f["q"] * 10, F.lit(5.0))).cast("int")).alias("v")))
    return let(own, lambda s: F.struct(s["c"].alias("correctness"), s["v"].alias("relevance"), F.lit(3).alias("groundedness"), s["c"].alias("completeness"), F.lit(False).alias("hallucination_flag"), F.round((s["c"] * 2 + s["v"] + 3) / 20, 4).alias("normalized_score")))


def judge_normalize(score: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), score / 5))


def score_label(score: Column) -> Column:
    return F.when(score >= 0.8, "Excellent").when(score >= 0.6, "Good").when(score >= 0.4, "Adequate").when(score >= 0.2, "Poor").otherwise("Very Poor")


def ascii_bar(value: Column, most: Column | float = 1.0, width: int = 20) -> Column:
    most = F.lit(most) if isinstance(most, float) else most
    full = F.greatest(F.lit(0), F.least(F.lit(width), F.floor(value / F.greatest(most, F.lit(1e-9)) * width))).cast("int")
    return F.concat(F.repeat(F.lit("█"), full), F.repeat(F.lit("░"), F.lit(width) - full))


def p95_by_index(values: Column) -> Column:
    """sorted[int(n * 0.95) - 1], index -1 being the last; 0 for no values."""
    def pick(s: Column) -> Column:
        k = F.floor(F.size(s) * F.lit(0.95)).cast("int")
        return F.when(F.size(s) == 0, F.lit(0.0)).otherwise(F.element_at(s, F.when(k == 0, -1).otherwise(k)))

    return let(F.array_sort(values), pick)


# Metrics of which more is better, and those of which less is.
MORE_IS_BETTER = {
    "llm_accuracy", "avg_correctness", "avg_relevance", "avg_groundedness", "avg_completeness", "avg_semantic_similarity", "avg_token_f1",
    "avg_recall_at_k",
}
LESS_IS_BETTER = {"hallucination_rate", "avg_latency_s", "avg_total_tokens"}


def winner_direction(metric: str) -> int:
    """1 if more is better, -1 if less is, 0 if unknown."""
    return 1 if metric in MORE_IS_BETTER else -1 if metric in LESS_IS_BETTER else 0
