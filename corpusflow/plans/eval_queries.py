"""Queries over guards, metrics and evaluation rollups, with DuckDB SQL for the same results."""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from corpusflow.config import REFUSAL
from corpusflow.functions import guards, metrics, text
from corpusflow.operators import evaluation
from corpusflow.plans.text_queries import _values, strip, table
from corpusflow.steps import steps_dir

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


_Q = lambda s: "'" + s.replace("'", "''") + "'"
#: Guard cases in the manner of a help desk: (id, query, whether it should pass).
CASES = [
    ("OUT01", "Who wrote the longest novel of the last century?", False), ("OUT02", "How is bread baked at high altitude?", False), ("LEN01", "What is the attendance policy? " * 25, False), ("LEN02", "A" * 600, False),
    ("CON01", "How do I hack the portal?", False), ("PII01", "My number is 1234 5678 9012, is there a fee waiver?", False), ("PII02", "Write to student@example.com about the hostel", False), ("PII03", "ABCDE1234F is my card for the exam", False),
    ("PII04", "Call 9876543210 about the exam", False), ("PII05", "123-45-6789 exam", False), ("VAL01", "What attendance is required for exams?", True), ("VAL02", "When is the fee due?", True), ("VAL03", "hi there", True), ("VAL04", "Is there a hackathon on campus?", False), ("VAL05", "Where can I buy coffee in town today?", True),
]
#: Words of the test tables that stand in for topics and blocked words.
HELP_TOPICS = ["exam", "fee", "attendance", "hostel", "campus"]
DATA_TOPICS, DATA_BLOCKED = ["the", "de", "der", "que"], ["lichkeit", "blewh", "eauxvi"]


def _any(x: str, words: list[str]) -> str:
    return "(" + " OR ".join(f"contains(lower({x}), {_Q(w)})" for w in words) + ")"


def _label_sql(x: str) -> str:
    return "CASE " + " ".join(f"WHEN regexp_matches({x}, {_Q(p)}) THEN {_Q(n)}" for p, n in guards.PERSONAL) + " END"


def _input_sql(x: str, topics: list[str], blocked: list[str]) -> str:
    return f"""CASE WHEN length({x}) > 500 THEN 'InputLengthGuard' WHEN {_any(x, blocked)} THEN 'ContentGuard' WHEN {_label_sql(x)} IS NOT NULL THEN 'PIIGuard'
      WHEN NOT {_any(x, topics)} AND length({strip(x)}) >= 15 THEN 'ScopeGuard' END"""


@query(f"""WITH r AS (SELECT conv_id, turn, {_input_sql("text", DATA_TOPICS, DATA_BLOCKED)} AS blocked_by FROM conversations WHERE role = 'user')
SELECT conv_id, turn, blocked_by IS NULL AS passed, blocked_by, CASE WHEN blocked_by IS NULL THEN 'info' ELSE 'block' END AS severity FROM r""")
def guard_input(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").where("role = 'user'")
    return rows.select("conv_id", "turn", guards.check_input(F.col("text"), topics=DATA_TOPICS, blocked=DATA_BLOCKED).alias("r")).select("conv_id", "turn", "r.passed", "r.blocked_by", "r.severity")


@query(f"""WITH t AS (SELECT doc_id::VARCHAR AS id, text FROM documents UNION ALL SELECT * FROM (VALUES {_values([c[:2] for c in CASES])}) v(id, text)) SELECT id, {_label_sql("text")} AS label FROM t""")
def pii_label(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("id"), "text").unionByName(spark.createDataFrame([c[:2] for c in CASES], "id string, text string"))
    return rows.select("id", guards.personal_label(F.col("text")).alias("label"))


_TURNS = "t AS (SELECT conv_id, turn, role, text, lag(text) OVER (PARTITION BY conv_id ORDER BY turn, text) AS question FROM conversations)"


def _answers(spark, sf_dir):
    """Assistant turns with the turn before them as question; some made into refusals."""
    rows = table(spark, sf_dir, "conversations")
    rows = rows.withColumn("question", F.lag("text").over(Window.partitionBy("conv_id").orderBy("turn", "text"))).where("role = 'assistant' and question is not null")
    refused = F.concat(F.lit("I Couldn't find enough information. "), F.substring("text", 1, 60))
    return rows.withColumn("answer", F.when(F.col("conv_id") % 11 == 0, refused).when(F.col("conv_id") % 13 == 0, F.concat("text", F.lit(" [source 3]"))).otherwise(F.col("text"))).withColumn("available", F.col("turn") % 4 != 1)


_ANSWERS = f"""{_TURNS}, a AS (SELECT conv_id, turn, question, text, turn % 4 <> 1 AS available, CASE WHEN conv_id % 11 = 0 THEN 'I Couldn''t find enough information. ' || left(text, 60) WHEN conv_id % 13 = 0 THEN text || ' [source 3]' ELSE text END AS answer
  FROM t WHERE role = 'assistant' AND question IS NOT NULL)"""
_REFUSED = f"contains(lower(answer), {_Q(REFUSAL)})"


@query(f"""WITH {_ANSWERS}, g AS (SELECT *, length({strip("answer")}) AS n, {_REFUSED} AS refused FROM a),
  w AS (SELECT conv_id, turn, list_filter([CASE WHEN n < 20 OR n > 3000 THEN 'MinimumLengthGuard' END, CASE WHEN (NOT available AND NOT refused) OR (available AND refused AND n < 80) THEN 'RefusalConsistencyGuard' END,
    CASE WHEN available AND NOT refused AND NOT regexp_matches(answer, '(?i)\\[SOURCE\\s*\\d+\\]') THEN 'SourceCitationGuard' END], lambda x: x IS NOT NULL) AS w FROM g)
SELECT conv_id, turn, CASE WHEN len(w) > 0 THEN 'warning' ELSE 'info' END AS severity, array_to_string(w, ',') AS warnings FROM w""")
def guard_output(spark, sf_dir):
    rows = _answers(spark, sf_dir).select("conv_id", "turn", guards.check_output(F.col("answer"), F.col("available")).alias("r"))
    return rows.select("conv_id", "turn", "r.severity", F.array_join(F.transform("r.warnings", lambda w: w["guard_name"]), ",").alias("warnings"))


@query(f"""WITH c AS (SELECT id, q, e = 1 AS expected FROM (VALUES {_values([(a, b, int(c)) for a, b, c in CASES])}) v(id, q, e) UNION ALL SELECT upper(left(role, 3)) || conv_id, text, turn % 2 = 0 FROM conversations), r AS (SELECT id, (({_input_sql("q", HELP_TOPICS, guards.BLOCKED)}) IS NULL) = expected AS ok FROM c)
SELECT left(id, 3) AS suite, count(*) AS total, count(*) FILTER (ok) AS passed, count(*) FILTER (NOT ok) AS failed FROM r GROUP BY 1""")
def guard_suite_rollup(spark, sf_dir):
    """Cases by hand, and every turn of the conversations, the even ones expected to pass."""
    cases = spark.createDataFrame(CASES, "id string, q string, expected boolean")
    turns = table(spark, sf_dir, "conversations").select(F.concat(F.upper(F.left("role", F.lit(3))), F.col("conv_id").cast("string")).alias("id"), F.col("text").alias("q"), (F.col("turn") % 2 == 0).alias("expected"))
    cases = cases.unionByName(turns)
    return evaluation.suite_rollup(cases.withColumn("ok", guards.check_input(F.col("q"), HELP_TOPICS)["passed"] == F.col("expected")), "id", "ok")


def _f1_sql(pairs: str, left: str, right: str) -> str:
    """Common table expressions ending in `scored` (all columns of pairs, which has a unique k, and f1)."""
    tokens = lambda x: f"unnest(list_filter(regexp_extract_all(lower({x}), '[\\p{{L}}\\p{{N}}_]+'), lambda w: length(w) > 1))"
    return f"""la AS (SELECT k, w, count(*) AS n FROM (SELECT k, {tokens(left)} AS w FROM {pairs}) GROUP BY ALL), lb AS (SELECT k, w, count(*) AS n FROM (SELECT k, {tokens(right)} AS w FROM {pairs}) GROUP BY ALL),
  sa AS (SELECT k, sum(n) AS a FROM la GROUP BY k), sb AS (SELECT k, sum(n) AS b FROM lb GROUP BY k), both_ AS (SELECT k, sum(least(la.n, lb.n)) AS c FROM la JOIN lb USING (k, w) GROUP BY k),
  scored AS (SELECT p.*, CASE WHEN coalesce(c, 0) = 0 THEN 0.0::DOUBLE ELSE 2 * (c / a) * (c / b) / ((c / a) + (c / b)) END AS f1 FROM {pairs} p LEFT JOIN sa USING (k) LEFT JOIN sb USING (k) LEFT JOIN both_ USING (k))"""


_KEYED = f"{_ANSWERS}, keyed AS (SELECT *, row_number() OVER (ORDER BY conv_id, turn, answer) AS k FROM a)"


@query(f"WITH {_KEYED}, {_f1_sql('keyed', 'answer', 'question')} SELECT conv_id, turn, round(f1, 6) AS f1 FROM scored")
def token_f1(spark, sf_dir):
    return _answers(spark, sf_dir).select("conv_id", "turn", F.round(text.token_f1(F.col("answer"), F.col("question")), 6).alias("f1"))


@query(f"""WITH {_KEYED}, {_f1_sql('keyed', 'answer', 'question')} SELECT conv_id, turn, CASE WHEN NOT available THEN {_REFUSED} WHEN {_REFUSED} THEN false ELSE f1 > 0.10 END AS correct FROM scored""")
def answer_accuracy(spark, sf_dir):
    return _answers(spark, sf_dir).select("conv_id", "turn", metrics.answer_accuracy(F.col("answer"), F.col("question"), F.col("available")).alias("correct"))


@query(f"""WITH {_KEYED}, {_f1_sql('keyed', 'answer', 'question')} SELECT conv_id, turn, CASE WHEN {_REFUSED} THEN 0 WHEN f1 >= 0.25 THEN 2 WHEN f1 >= 0.08 THEN 1 ELSE 0 END::INT AS relevance FROM scored""")
def answer_relevance(spark, sf_dir):
    return _answers(spark, sf_dir).select("conv_id", "turn", metrics.answer_relevance(F.col("answer"), F.col("question")).alias("relevance"))


_FACTS = r"list_distinct(list_filter(list_transform(regexp_extract_all(' ' || replace({0}, ' ', '  ') || ' ', '[^\p{{L}}\p{{N}}_](\d(?:[\d,./%-]*\d)?)[^\p{{L}}\p{{N}}_]', 1), lambda x: x), lambda x: x <> ''))"
#: Answers and contexts with figures: (id, answer, context).
FACTS = [
    ("a", "The fee is 1,200.50 by 2026-05-01 [SOURCE 1]", "Pay 1,200.50 until 2026-05-02 1"), ("b", "75% attendance", "at least 75 percent"), ("c", "no figures", "1 2 3"), ("d", "12 and 13 and 14", "13"),
    ("e", "I couldn't find enough information on 7", "none"), ("f", "room b2 is 3rd; 4 left", "4"), ("g", "1/2 or 3-4", "3-4"),
]


@query(f"""WITH p AS (SELECT doc_id::VARCHAR AS id, text AS answer, lead(text) OVER (PARTITION BY source ORDER BY doc_id) AS context FROM documents WHERE doc_id % 2 >= 0 UNION ALL SELECT * FROM (VALUES {_values(FACTS)}) v(id, a, c)),
  f AS (SELECT id, answer, {_FACTS.format("answer")} AS a, {_FACTS.format("coalesce(context, '')")} AS c FROM p)
SELECT id, CASE WHEN {_REFUSED} OR len(a) = 0 THEN 0.0::DOUBLE ELSE round_even(len(list_filter(a, lambda x: NOT list_contains(c, x))) / len(a), 4) END AS rate FROM f""")
def hallucination_rate(spark, sf_dir):
    following = F.lead("text").over(Window.partitionBy("source").orderBy("doc_id"))
    rows = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("id"), F.col("text").alias("answer"), following.alias("context"))
    rows = rows.unionByName(spark.createDataFrame(FACTS, "id string, answer string, context string"))
    return rows.select("id", metrics.hallucination_rate(F.col("answer"), F.coalesce("context", F.lit(""))).alias("rate"))


#: Replies of a judge: (id, reply).
REPLIES = [
    ("ok", 'Sure: {"correctness": 4, "relevance": 5, "groundedness": 3, "completeness": 2, "hallucination_flag": false, "reasoning": "fine"} end'), ("missing", '{"correctness": 4, "relevance": 5}'), ("none", "no json here"),
    ("clamped", '{"correctness": 9, "relevance": -2, "groundedness": 3.9, "completeness": "x", "hallucination_flag": true}'), ("nested", '{"correctness": {"a": 1}, "relevance": 5, "groundedness": 3, "completeness": 2, "hallucination_flag": false}'),
    ("lines", 'text\n{\n "correctness": 1,\n "relevance": 1, "groundedness": 1, "completeness": 1, "hallucination_flag": false}\nmore {"x": 1}'), ("string", '{"correctness": "3", "relevance": 2, "groundedness": 1, "completeness": 0, "hallucination_flag": false}'),
]


#: A reply for each event, of four kinds: whole, without a score, without JSON, with scores as text and beyond the scale.
_REPLY = """CASE event_id % 4 WHEN 0 THEN 'So: {"correctness": ' || event_id % 6 || ', "relevance": ' || event_id % 5 || ', "groundedness": 3, "completeness": ' || event_id % 3 || ', "hallucination_flag": ' || CASE WHEN event_id % 7 = 0 THEN 'true' ELSE 'false' END || '}'
  WHEN 1 THEN '{"correctness": ' || event_id % 6 || '}' WHEN 2 THEN 'a score of ' || event_id ELSE '{"correctness": "' || event_id % 9 || '", "relevance": ' || -(event_id % 4) || ', "groundedness": 2, "completeness": 9, "hallucination_flag": true}' END"""


def _score_sql(k: str) -> str:
    return f"greatest(0, least(5, coalesce(trunc(try_cast(json_extract_string(j, '$.{k}') AS DOUBLE))::INT, 0)))"


@query(f"""WITH r AS (SELECT id, regexp_extract(reply, '(?s)(\\{{.*?\\}})', 1) AS j FROM (SELECT * FROM (VALUES {_values(REPLIES)}) v(id, reply) UNION ALL SELECT event_id::VARCHAR, {_REPLY} FROM events)), p AS (SELECT id, CASE WHEN json_valid(j) THEN j ELSE '{{}}' END AS j FROM r),
  s AS (SELECT id, {", ".join(f"{_score_sql(k)} AS {k}" for k in metrics.SCORES)}, json_extract_string(j, '$.hallucination_flag')::BOOLEAN AS hallucination_flag, {" AND ".join(f"json_extract_string(j, '$.{k}') IS NOT NULL" for k in (*metrics.SCORES, "hallucination_flag"))} AS complete FROM p)
SELECT id, complete AS parsed, {", ".join(f"CASE WHEN complete THEN {k} END::INT AS {k}" for k in metrics.SCORES)}, CASE WHEN complete THEN hallucination_flag END AS hallucination_flag, CASE WHEN complete THEN round(({" + ".join(metrics.SCORES)}) / 20, 4) END AS normalized_score FROM s""")
def judge_parse(spark, sf_dir):
    """Replies by hand, and one for each event."""
    e = F.col("event_id")
    text = lambda n: (e % n).cast("string")
    whole = F.concat(F.lit('So: {"correctness": '), text(6), F.lit(', "relevance": '), text(5), F.lit(', "groundedness": 3, "completeness": '), text(3), F.lit(', "hallucination_flag": '), F.when(e % 7 == 0, "true").otherwise("false"), F.lit("}"))
    odd = F.concat(F.lit('{"correctness": "'), text(9), F.lit('", "relevance": '), (-(e % 4)).cast("string"), F.lit(', "groundedness": 2, "completeness": 9, "hallucination_flag": true}'))
    reply = F.when(e % 4 == 0, whole).when(e % 4 == 1, F.concat(F.lit('{"correctness": '), text(6), F.lit("}"))).when(e % 4 == 2, F.concat(F.lit("a score of "), e.cast("string"))).otherwise(odd)
    rows = spark.createDataFrame(REPLIES, "id string, reply string").unionByName(table(spark, sf_dir, "events").select(e.cast("string").alias("id"), reply.alias("reply")))
    rows = rows.select("id", metrics.judge_scores(F.col("reply")).alias("s"))
    return rows.select("id", F.col("s").isNotNull().alias("parsed"), *(F.col(f"s.{k}").alias(k) for k in metrics.SCORES), "s.hallucination_flag", "s.normalized_score")


@query(f"""WITH {_KEYED}, both1 AS (SELECT * FROM keyed), {_f1_sql('both1', 'answer', 'question')}, ref AS (SELECT k, conv_id, turn, answer, f1 AS q FROM scored), next AS (SELECT k, conv_id, turn, answer, coalesce(lead(answer) OVER (PARTITION BY conv_id ORDER BY turn, answer), '') AS reference FROM keyed),
  {_f1_sql('next', 'answer', 'reference').replace('la AS', 'la2 AS').replace('lb AS', 'lb2 AS').replace('sa AS', 'sa2 AS').replace('sb AS', 'sb2 AS').replace('both_ AS', 'both2 AS').replace('scored AS', 'scored2 AS').replace('FROM la ', 'FROM la2 ').replace('FROM lb ', 'FROM lb2 ').replace('least(la.n, lb.n)', 'least(la2.n, lb2.n)').replace('la JOIN lb', 'la2 JOIN lb2').replace('la2 JOIN lb ', 'la2 JOIN lb2 ').replace('JOIN sa ', 'JOIN sa2 ').replace('JOIN sb ', 'JOIN sb2 ').replace('JOIN both_ ', 'JOIN both2 ')},
  s AS (SELECT r.conv_id, r.turn, round_even(n.f1 * 5, 0)::INT AS correctness, CASE WHEN contains(lower(r.answer), {_Q(REFUSAL)}) THEN 0 ELSE round_even(least(r.q * 10, 5), 0) END::INT AS relevance FROM ref r JOIN scored2 n USING (k))
SELECT conv_id, turn, correctness, relevance, round((2 * correctness + relevance + 3) / 20, 4) AS normalized_score FROM s""")
def judge_fallback(spark, sf_dir):
    rows = _answers(spark, sf_dir)
    rows = rows.withColumn("reference", F.coalesce(F.lead("answer").over(Window.partitionBy("conv_id").orderBy("turn", "answer")), F.lit("")))
    out = rows.select("conv_id", "turn", metrics.judge_fallback(F.col("answer"), F.col("reference"), F.col("question")).alias("s"))
    return out.select("conv_id", "turn", "s.correctness", "s.relevance", "s.normalized_score")


@query("SELECT event_id, round(greatest(0, least(1, (value % 7 - 1) / 5))::DOUBLE, 6) AS normalized FROM events")
def judge_normalize(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", F.round(metrics.judge_normalize(F.col("value") % 7 - 1), 6).alias("normalized"))


@query("SELECT event_id, CASE WHEN s >= 0.8 THEN 'Excellent' WHEN s >= 0.6 THEN 'Good' WHEN s >= 0.4 THEN 'Adequate' WHEN s >= 0.2 THEN 'Poor' ELSE 'Very Poor' END AS label FROM (SELECT event_id, (event_id % 101) / 100 AS s FROM events)")
def score_label(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", metrics.score_label((F.col("event_id") % 101) / 100).alias("label"))


#: Events as evaluation facts: the user's remainder is the model, the type the category, the value the latency.
_FACT = "facts AS (SELECT 'm' || (user_id % 3) AS model, event_type AS category, value AS latency, (event_id % 6)::INT AS correctness, (event_id % 5)::INT AS relevance, (event_id % 4)::INT AS groundedness, (event_id % 3)::INT AS completeness, CASE WHEN event_id % 8 > 0 THEN event_id % 501 END AS prompt_tokens, event_id % 77 AS total_tokens, event_id % 4 = 0 AS correct, event_id % 9 = 0 AS flag, (event_id % 10) / 10 AS recall FROM events)"
_P95 = "round(list_sort(list(latency))[CASE WHEN floor(count(latency) * 0.95) = 0 THEN -1 ELSE floor(count(latency) * 0.95) END::INT], 3)"


def _facts(spark, sf_dir):
    return table(spark, sf_dir, "events").select(
        F.concat(F.lit("m"), (F.col("user_id") % 3).cast("string")).alias("model"), F.col("event_type").alias("category"), F.col("value").alias("latency"), (F.col("event_id") % 6).cast("int").alias("correctness"),
        (F.col("event_id") % 5).cast("int").alias("relevance"), (F.col("event_id") % 4).cast("int").alias("groundedness"), (F.col("event_id") % 3).cast("int").alias("completeness"),
        F.when(F.col("event_id") % 8 > 0, F.col("event_id") % 501).alias("prompt_tokens"), (F.col("event_id") % 77).alias("total_tokens"),
        (F.col("event_id") % 4 == 0).alias("correct"), (F.col("event_id") % 9 == 0).alias("flag"), ((F.col("event_id") % 10) / 10).alias("recall"),
    )


@query(f"""WITH {_FACT} SELECT model, count(*) AS questions, count(*) FILTER (correct) AS correct, round_even(avg(correct::INT), 4) AS accuracy, round_even(avg(recall), 4) AS avg_recall, round_even(avg(correctness), 4) AS avg_correctness,
  round_even(avg(flag::INT), 4) AS flag_rate, round_even(avg(latency), 3) AS avg_latency, {_P95} AS p95_latency FROM facts GROUP BY model""")
def model_summary(spark, sf_dir):
    return evaluation.model_summary(_facts(spark, sf_dir), means=("recall", "correctness"), flag="flag")


@query(ORACLES["model_summary"])
def summary_files(spark, sf_dir):
    """The rollup by model written as JSON and read back."""
    path = f"{steps_dir(spark)}/summaries-{uuid.uuid4().hex}"
    rows = model_summary(spark, sf_dir)
    evaluation.write_summaries(path, models=rows)
    return spark.read.schema(rows.schema).json(f"{path}/models")


_TOKENS = ("prompt_tokens", "total_tokens")
_SUMMARY = f"""{_FACT}, names AS (SELECT DISTINCT category FROM facts UNION ALL SELECT 'never'), grid AS (SELECT category, model FROM names, (SELECT DISTINCT model FROM facts)),
  g AS (SELECT category, model, count(*) AS questions, round_even(avg((correctness >= 3)::INT), 4) AS llm_accuracy, {", ".join(f"round_even(avg({c} / 5), 4) AS avg_{c}" for c in metrics.SCORES)}, round_even(avg(flag::INT), 4) AS hallucination_rate, round_even(avg(recall), 4) AS avg_recall,
    {", ".join(f"round_even(sum(coalesce({c}, 0)) / count(*), 0)::BIGINT AS avg_{c}" for c in _TOKENS)}, round_even(avg(latency), 3) AS avg_latency, {_P95} AS p95_latency FROM facts GROUP BY ALL),
  summary AS (SELECT category, model, {", ".join(f"coalesce({c}, 0) AS {c}" for c in ("questions", "llm_accuracy", *(f"avg_{c}" for c in (*metrics.SCORES, "recall", *_TOKENS)), "hallucination_rate", "avg_latency", "p95_latency"))} FROM grid LEFT JOIN g USING (category, model))"""


def _summary(spark, sf_dir):
    facts = _facts(spark, sf_dir)
    names = facts.select("category").distinct().unionByName(spark.createDataFrame([("never",)], "category string"))
    return evaluation.category_summary(facts, names, facts.select("model"), flag="flag", means=("recall",), tokens=_TOKENS)


@query(f"WITH {_SUMMARY} SELECT * FROM summary")
def category_summary(spark, sf_dir):
    return _summary(spark, sf_dir)


@query(f"WITH {_FACT} SELECT model, {', '.join(f'sum(coalesce({c}, 0))::BIGINT AS sum_{c}, round_even(sum(coalesce({c}, 0)) / count(*), 0)::BIGINT AS avg_{c}' for c in _TOKENS)} FROM facts GROUP BY model")
def token_sums(spark, sf_dir):
    return evaluation.token_sums(_facts(spark, sf_dir), ["model"], _TOKENS)


@query("SELECT event_id, strftime(ts, '%Y%m%d_%H%M%S') AS stamp FROM events")
def file_stamps(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", evaluation.file_stamp(F.col("ts")).alias("stamp"))


@query(f"""WITH {_FACT}, m AS (SELECT DISTINCT model FROM facts WHERE model <> 'm1') SELECT conv_id, turn, model FROM conversations, m""")
def questions_by_model(spark, sf_dir):
    models = _facts(spark, sf_dir).select("model").distinct().withColumn("oom_safe", F.col("model") != "m1")
    return evaluation.questions_by_model(table(spark, sf_dir, "conversations").select("conv_id", "turn"), models).select("conv_id", "turn", "model")


@query(f"""WITH {_FACT}, o AS (SELECT model, round_even(avg(correctness), 4) AS old, round_even(avg(relevance), 4) AS new FROM facts GROUP BY model) SELECT model, new, old, round(new - old, 4) AS delta FROM o""")
def score_delta(spark, sf_dir):
    means = evaluation.model_summary(_facts(spark, sf_dir), means=("correctness", "relevance")).withColumnsRenamed({"avg_correctness": "old", "avg_relevance": "new"})
    return evaluation.score_delta(means, "model", "new", "old")


@query(f"""WITH v AS (SELECT user_id AS g, value AS latency FROM events UNION ALL SELECT -n, x FROM (VALUES (1, 5.0), (2, 1.0), (2, 2.0), (5, 1.0), (5, 2.0), (5, 3.0), (5, 4.0), (5, 5.0)) t(n, x)) SELECT g, {_P95} AS p95 FROM v GROUP BY g""")
def p95_floor_index(spark, sf_dir):
    own = spark.createDataFrame([(-1, 5.0), (-2, 1.0), (-2, 2.0), *((-5, float(i)) for i in range(1, 6))], "g long, latency double")
    rows = table(spark, sf_dir, "events").select(F.col("user_id").alias("g"), F.col("value").alias("latency")).unionByName(own)
    return evaluation.p95_by_group(rows, ["g"], "latency")


@query(f"WITH {_SUMMARY} SELECT model, round(avg(llm_accuracy), 6) AS llm_accuracy, round(avg(avg_correctness), 6) AS avg_correctness, round(avg(avg_latency), 6) AS avg_latency FROM summary GROUP BY model")
def overall_unweighted(spark, sf_dir):
    return evaluation.overall_unweighted(_summary(spark, sf_dir))


@query(f"""WITH {_SUMMARY}, named AS (SELECT category, model, llm_accuracy, avg_correctness, avg_latency AS avg_latency_s FROM summary), u AS (UNPIVOT named ON llm_accuracy, avg_correctness, avg_latency_s INTO NAME metric VALUE value)
SELECT category, metric, model AS winner FROM u QUALIFY row_number() OVER (PARTITION BY category, metric ORDER BY CASE WHEN metric = 'avg_latency_s' THEN value ELSE -value END, model) = 1 UNION ALL SELECT DISTINCT category, 'unheard_of', 'N/A' FROM summary""")
def metric_winner(spark, sf_dir):
    rows = _summary(spark, sf_dir).withColumnRenamed("avg_latency", "avg_latency_s").withColumn("unheard_of", F.lit(1.0))
    return evaluation.metric_winners(rows, "category", "model", ["llm_accuracy", "avg_correctness", "avg_latency_s", "unheard_of"])


@query(f"""WITH {_SUMMARY}, m AS (SELECT category, max(llm_accuracy) AS best FROM summary GROUP BY category)
SELECT category, CASE WHEN count(*) > 1 AND any_value(best) > 0 THEN 'Tie' ELSE min(model) END AS winner, any_value(best) AS best FROM summary JOIN m USING (category) WHERE llm_accuracy = best GROUP BY category""")
def category_winner_tie(spark, sf_dir):
    return evaluation.category_winners(_summary(spark, sf_dir), "category", "model", "llm_accuracy")


_BAR = lambda x: f"repeat('█', greatest(0, least(20, floor({x} * 20)))::INT) || repeat('░', 20 - greatest(0, least(20, floor({x} * 20)))::INT)"


@query(f"""WITH {_SUMMARY}, o AS (SELECT model, round(avg(avg_correctness), 6) AS avg_correctness FROM summary GROUP BY model)
SELECT model, avg_correctness, (row_number() OVER (ORDER BY avg_correctness DESC, model))::INT AS rank, {_BAR("avg_correctness")} AS bar FROM o""")
def model_ranking(spark, sf_dir):
    return evaluation.model_ranking(evaluation.overall_unweighted(_summary(spark, sf_dir)), "model", "avg_correctness")


@query(f"SELECT event_id, {_BAR('((event_id % 140 - 10) / 100)')} AS bar FROM events")
def ascii_bar(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", metrics.ascii_bar((F.col("event_id") % 140 - 10) / 100).alias("bar"))
