"""Evaluation cases, scores and metrics."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexspark.functions import fixed
from lexspark.operators.windows import nearest_rank
from lexspark.plans import answers, evaluation
from lexspark.registry import inputs
from lexspark.registry.base import query, step
from lexspark.registry.retrieval import _legal_steps
from lexspark.registry.steps import neighbours, vectors
from lexspark.registry.views import view

_DOMAINS = ", ".join(f"'{d}'" for d in fixed.EVALUATION_DOMAINS)
step("c_cases", f"""SELECT item_id, language, question || chr(10) || 'A) ' || option_a || chr(10) || 'B) ' || option_b || chr(10) || 'C) ' || option_c
  || chr(10) || 'D) ' || option_d AS question, question AS simple_question, coalesce(upper(trim(correct_answer)), 'A') AS correct_answer,
  CASE coalesce(upper(trim(correct_answer)), 'A') WHEN 'A' THEN option_a WHEN 'B' THEN option_b WHEN 'C' THEN option_c WHEN 'D' THEN option_d
    ELSE coalesce(correct_answer, '') END AS correct_text, coalesce(topic, 'General') AS topic, subject_domain,
  coalesce(question_level, 'Unknown') AS level FROM v_mcq_questions WHERE subject_domain IN ({_DOMAINS})""")
_SCORES = """count(*) AS total, count(*) FILTER (WHERE correct) AS total_correct, count(*) FILTER (WHERE correct AND language = 'fr') AS fr_correct,
  count(*) FILTER (WHERE correct AND language <> 'fr') AS other_correct,
  round(count(*) FILTER (WHERE correct) / greatest(count(*), 1), 6) AS overall_accuracy,
  round(count(*) FILTER (WHERE correct AND language = 'fr') / greatest(count(*) FILTER (WHERE language = 'fr'), 1), 6) AS fr_accuracy,
  round(count(*) FILTER (WHERE correct AND language <> 'fr') / greatest(count(*) FILTER (WHERE language <> 'fr'), 1), 6) AS other_accuracy,
  round(avg(response_time_ms), 4) AS avg_time_ms, min(response_time_ms) AS min_time_ms, max(response_time_ms) AS max_time_ms"""


def _rounded(df):
    for name in ("overall_accuracy", "fr_accuracy", "other_accuracy"):
        df = df.withColumn(name, F.round(name, 6))
    return df.withColumn("avg_time_ms", F.round("avg_time_ms", 4))


@query("set_union_tests", "SELECT item_id, question, language FROM v_mcq_questions")
def set_union_tests(spark, sf):
    questions = view(spark, sf, "mcq_questions")
    parts = {name: questions.where(F.col("language") == name).drop("language") for name in ("en", "hi")}
    return evaluation.union_cases(parts).select("item_id", "question", "language")


@query("evl_prepare_cases", "SELECT * FROM c_cases")
def evl_prepare_cases(spark, sf):
    return evaluation.prepare_cases(view(spark, sf, "mcq_questions"))


@query("evl_prepare_cases_capped", """SELECT item_id, language, correct_answer FROM c_cases
QUALIFY row_number() OVER (PARTITION BY language ORDER BY item_id) <= CASE language WHEN 'en' THEN 20 ELSE 15 END""")
def evl_prepare_cases_capped(spark, sf):
    cases = evaluation.prepare_cases(view(spark, sf, "mcq_questions"), caps=fixed.EVALUATION_CAPS)
    return cases.select("item_id", "language", "correct_answer")


@query("evl_keyword_score", """SELECT test_id, array_to_string(keywords, ',') AS keywords, keywords_matched, total_keywords, correct FROM c_outcome""")
def evl_keyword_score(spark, sf):
    scored = evaluation.keyword_score(view(spark, sf, "eval_cases"))
    return scored.select("test_id", F.array_join("keywords", ",").alias("keywords"), "keywords_matched",
                         "total_keywords", "correct")


@query("evl_result_rows", "SELECT * FROM c_eval_results")
def evl_result_rows(spark, sf):
    return inputs.eval_results(spark, sf)


@query("agg_eval_metrics", f"SELECT {_SCORES} FROM c_eval_results")
def agg_eval_metrics(spark, sf):
    return _rounded(evaluation.metrics(inputs.eval_results(spark, sf), "fr"))


@query("agg_p95_nearest", """SELECT language, response_time_ms AS p95_time_ms FROM (
  SELECT language, response_time_ms, row_number() OVER (PARTITION BY language ORDER BY response_time_ms) AS rn,
    count(*) OVER (PARTITION BY language) AS n FROM c_eval_results) WHERE rn = floor(0.95 * n) + 1""")
def agg_p95_nearest(spark, sf):
    return nearest_rank(inputs.eval_results(spark, sf), "response_time_ms", "test_id", ["language"], name="p95_time_ms")


@query("agg_eval_by_dim", """SELECT dimension, value, count(*) AS total, count(*) FILTER (WHERE correct) AS total_correct,
  round(avg(correct::int), 6) AS accuracy, round(avg(response_time_ms), 6) AS avg_time_ms FROM (
  SELECT 'all' AS dimension, NULL AS value, * FROM c_eval_results UNION ALL SELECT 'language', language, * FROM c_eval_results
  UNION ALL SELECT 'subject_domain', subject_domain, * FROM c_eval_results UNION ALL SELECT 'topic', topic, * FROM c_eval_results
  UNION ALL SELECT 'level', level, * FROM c_eval_results) GROUP BY dimension, value""")
def agg_eval_by_dim(spark, sf):
    grouped = evaluation.metrics_by(inputs.eval_results(spark, sf), ["language", "subject_domain", "topic", "level"])
    return grouped.withColumn("accuracy", F.round("accuracy", 6)).withColumn("avg_time_ms", F.round("avg_time_ms", 6))


@query("evl_metrics", f"""SELECT {_SCORES}, (SELECT response_time_ms FROM (SELECT response_time_ms, row_number() OVER (ORDER BY response_time_ms) AS rn,
  count(*) OVER () AS n FROM c_eval_results) WHERE rn = floor(0.95 * n) + 1) AS p95_time_ms FROM c_eval_results""")
def evl_metrics(spark, sf):
    return _rounded(evaluation.full_metrics(inputs.eval_results(spark, sf), "fr"))


@query("agg_latency_percentiles", """SELECT language, count(*) AS total, true AS p50_within_bound, true AS p95_within_bound
FROM c_eval_results GROUP BY language""")
def agg_latency_percentiles(spark, sf):
    """Approximate percentiles, each between the exact values one part in a hundred to both sides."""
    results = inputs.eval_results(spark, sf)
    checked = evaluation.latency_percentiles(results, ["language"])
    for share in (0.5, 0.95):
        name = f"p{round(100 * share)}"
        for side, at in (("low", share - 0.01), ("high", min(share + 0.01, 0.999))):
            exact = nearest_rank(results, "response_time_ms", "test_id", ["language"], at, f"{name}_{side}")
            checked = checked.join(exact, "language")
        checked = checked.withColumn(f"{name}_within_bound", F.col(f"{name}_time_ms").between(F.col(f"{name}_low"), F.col(f"{name}_high")))
    return checked.select("language", "total", "p50_within_bound", "p95_within_bound")


step("c_asked_cases", "SELECT item_id AS question_id, simple_question AS question FROM c_cases")
vectors("c_case_vec", "c_asked_cases", "question_id", "question")
neighbours("c_case_near", "c_case_vec", "c_chunk_vec", 5)
step("c_case_results", "SELECT n.query_id AS question_id, n.rank, c.*, n.distance, n.similarity FROM c_case_near n JOIN c_chunks c USING (chunk_id)")
_legal_steps("c_case_legal", "c_case_results", "c_asked_cases")


@query("evl_end_to_end", r"""SELECT c.item_id AS test_id, c.language, c.correct_answer AS correct_option, l.answer AS actual_answer,
  len(list_filter(words, lambda w: contains(lower(l.answer), w))) AS keywords_matched, len(words) AS total_keywords,
  len(list_filter(words, lambda w: contains(lower(l.answer), w))) >= greatest(1, len(words) // 2) AS correct, 'legal_question' AS intent, 'BNSAgent' AS agent_used
FROM (SELECT *, list_transform(list_filter(regexp_split_to_array(trim(regexp_replace(correct_text, '\s+', ' ', 'g')), ' '),
    lambda w: length(w) > 4)[1:5], lambda w: lower(w)) AS words FROM c_cases) c JOIN c_case_legal l ON l.question_id = c.item_id""".replace("\\\\s", "\\s"))
def evl_end_to_end(spark, sf):
    """Cases to routed answers to scored rows."""
    cases = evaluation.prepare_cases(view(spark, sf, "mcq_questions"))
    questions = cases.select(F.col("item_id").alias("question_id"), F.col("simple_question").alias("question"))
    routed = answers.route(questions, inputs.chunk_vectors(spark, sf), view(spark, sf, "bns_sections"), inputs.schemes(spark, sf),
                           inputs.mapping(spark, sf))
    rows = evaluation.result_rows(evaluation.keyword_score(evaluation.answered_cases(cases, routed)))
    return rows.select("test_id", "language", "correct_option", "actual_answer", "keywords_matched", "total_keywords", "correct",
                       "intent", "agent_used")


@query("srt_latest_results", """SELECT test_id, language, topic, level, correct, keywords_matched, total_keywords, trunc(response_time_ms)::int AS time_ms
FROM c_eval_results ORDER BY test_id DESC LIMIT 10""")
def srt_latest_results(spark, sf):
    latest = inputs.eval_results(spark, sf).orderBy(F.desc("test_id")).limit(10)
    return latest.select("test_id", "language", "topic", "level", "correct", "keywords_matched", "total_keywords",
                         F.col("response_time_ms").cast("int").alias("time_ms"))
