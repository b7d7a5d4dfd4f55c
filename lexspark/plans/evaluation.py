"""Multiple-choice cases, keyword scores and metrics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexspark.functions import fixed
from lexspark.functions import text as tx
from lexspark.operators.windows import nearest_rank, top_k


def union_cases(by_language: dict[str, DataFrame]) -> DataFrame:
    """Question tables of several languages in one, with the language as a column."""
    frames = [df.withColumn("language", F.lit(name)) for name, df in by_language.items()]
    whole = frames[0]
    for frame in frames[1:]:
        whole = whole.unionByName(frame)
    return whole


def prepare_cases(questions: DataFrame, domains: Sequence[str] = tuple(fixed.EVALUATION_DOMAINS),
                  caps: dict[str, int] | None = None, key: str = "item_id") -> DataFrame:
    """Questions of the wanted domains with option list, right letter and right text.

    ``caps`` limits the number of cases per language (the first by key); None takes all of them.
    """
    wanted = questions.where(F.col("subject_domain").isin(*domains))
    if caps is not None:
        ranked = top_k(wanted, ["language"], [key], max(caps.values()), "_n")
        cap = F.element_at(F.create_map(*[F.lit(x) for pair in caps.items() for x in pair]), F.col("language"))
        wanted = ranked.where(F.col("_n") <= cap).drop("_n")
    letter = tx.option_letter(F.col("correct_answer"))
    options = {name: F.col(f"option_{name.lower()}") for name in "ABCD"}
    return wanted.select(
        key, "language",
        tx.fill("{q}\nA) {a}\nB) {b}\nC) {c}\nD) {d}", q=F.col("question"), a=options["A"], b=options["B"],
                c=options["C"], d=options["D"]).alias("question"),
        F.col("question").alias("simple_question"),
        letter.alias("correct_answer"),
        tx.option_text(letter, F.col("correct_answer"), options).alias("correct_text"),
        tx.or_default(F.col("topic"), "General").alias("topic"),
        tx.or_default(F.col("subject_domain"), "Unknown").alias("subject_domain"),
        tx.or_default(F.col("question_level"), "Unknown").alias("level"))


def keyword_score(cases: DataFrame) -> DataFrame:
    """Keywords of the right text, how many the answer holds, and whether that is enough."""
    scored = cases.withColumn("keywords", tx.score_keywords(F.col("correct_text")))
    total = F.size("keywords").cast("bigint")
    matched = tx.matched_keywords(F.col("keywords"), F.col("actual_answer"))
    return scored.withColumn("keywords_matched", matched).withColumn("total_keywords", total).withColumn(
        "correct", F.col("keywords_matched") >= F.greatest(F.lit(1), F.floor(F.col("total_keywords") / 2)))


def result_rows(scored: DataFrame, text_chars: int | None = None, error_chars: int | None = None) -> DataFrame:
    """The stored evaluation row; a failed case counts as wrong, with time 0 and marked texts.

    The limits cut stored texts and messages; by default they stay whole.
    """
    failed = F.col("failed")

    def unless_failed(value: Column, instead) -> Column:
        return F.when(failed, F.lit(instead)).otherwise(value)

    return scored.select(
        "test_id",
        tx.cut(F.col("question"), text_chars).alias("question"),
        "language", "subject_domain", "topic", "level", "correct_option",
        tx.cut(F.col("correct_text"), text_chars).alias("correct_text"),
        F.when(failed, F.concat(F.lit("ERROR: "), tx.cut(F.coalesce("error", F.lit("")), error_chars)))
        .otherwise(tx.cut(F.col("actual_answer"), text_chars)).alias("actual_answer"),
        unless_failed(F.col("keywords_matched"), 0).cast("bigint").alias("keywords_matched"),
        unless_failed(F.col("total_keywords"), 0).cast("bigint").alias("total_keywords"),
        unless_failed(F.col("correct"), False).alias("correct"),
        unless_failed(F.col("response_time_ms"), 0.0).alias("response_time_ms"),
        unless_failed(F.col("intent"), "error").alias("intent"),
        unless_failed(F.col("agent_used"), "error").alias("agent_used"),
    )


def answered_cases(cases: DataFrame, routed: DataFrame, key: str = "item_id") -> DataFrame:
    """Prepared cases with what routing made of their plain questions; a case without an answer failed.

    ``routed`` has question_id (the case's key), answer, intent, agent_used, and response_time_ms if measured.
    """
    time = F.col("response_time_ms") if "response_time_ms" in routed.columns else F.lit(0)
    found = routed.select(F.col("question_id").alias(key), F.col("answer").alias("actual_answer"), "intent", "agent_used",
                          time.cast("double").alias("response_time_ms"))
    joined = cases.drop("question").join(found, key, "left")
    return joined.select(
        F.col(key).alias("test_id"), F.col("simple_question").alias("question"), "language", "subject_domain", "topic", "level",
        F.col("correct_answer").alias("correct_option"), "correct_text", "actual_answer", "response_time_ms",
        F.col("actual_answer").isNull().alias("failed"), F.lit("no answer").alias("error"), "intent", "agent_used")


def _share(hits: Column, total: Column) -> Column:
    return hits / F.greatest(total, F.lit(1))


def _metric_columns(special: str) -> list[Column]:
    hit = F.coalesce(F.col("correct"), F.lit(False)).cast("bigint")
    inside = (F.col("language") == special)
    total, right = F.count("*"), F.sum(hit)
    total_in = F.coalesce(F.sum(inside.cast("bigint")), F.lit(0))
    right_in = F.coalesce(F.sum(F.when(inside, hit).otherwise(0)), F.lit(0))
    time = F.col("response_time_ms")
    return [
        total.alias("total"), right.alias("total_correct"), right_in.alias(f"{special}_correct"),
        (right - right_in).alias("other_correct"),
        _share(right, total).alias("overall_accuracy"),
        _share(right_in, total_in).alias(f"{special}_accuracy"),
        _share(right - right_in, total - total_in).alias("other_accuracy"),
        F.avg(time).alias("avg_time_ms"), F.min(time).alias("min_time_ms"), F.max(time).alias("max_time_ms"),
    ]


def metrics(results: DataFrame, special: str = "hi", exclude_errors: bool = False) -> DataFrame:
    """One row of accuracies, counts and latencies; failed cases count (time 0) unless excluded."""
    if exclude_errors:
        results = results.where(F.col("intent") != "error")
    return results.agg(*_metric_columns(special))


def full_metrics(results: DataFrame, special: str = "hi") -> DataFrame:
    """``metrics`` with the 95th percentile as one row."""
    # Both sides are single rows.
    p95 = nearest_rank(results.select("response_time_ms", "test_id"), "response_time_ms", "test_id",
                       name="p95_time_ms")
    one = metrics(results, special).withColumn("_one", F.lit(1))
    return one.join(p95.withColumn("_one", F.lit(1)), "_one").drop("_one")


def metrics_by(results: DataFrame, dimensions: Sequence[str]) -> DataFrame:
    """Counts, accuracy and latency per value of each dimension and over all, in one pass."""
    sets = [[], *[[d] for d in dimensions]]
    grouped = results.groupingSets([[F.col(c) for c in s] for s in sets], *[F.col(d) for d in dimensions])
    hit = F.coalesce(F.col("correct"), F.lit(False)).cast("bigint")
    named = F.lit("all")
    for dimension in dimensions:
        named = F.when(F.grouping(dimension) == 0, F.lit(dimension)).otherwise(named)
    return grouped.agg(
        named.alias("dimension"), F.count("*").alias("total"), F.sum(hit).alias("total_correct"),
        F.avg(hit).alias("accuracy"), F.avg("response_time_ms").alias("avg_time_ms"),
    ).select("dimension", F.coalesce(*dimensions).alias("value"), "total", "total_correct", "accuracy", "avg_time_ms")


def latency_percentiles(results: DataFrame, groups: Sequence[str], fractions: Sequence[float] = (0.5, 0.95),
                        accuracy: int = 10_000) -> DataFrame:
    """Approximate percentiles per group, combined inside tasks; ``nearest_rank`` gives exact ones."""
    wanted = F.percentile_approx("response_time_ms", list(fractions), accuracy)
    made = results.groupBy(*groups).agg(F.count("*").alias("total"), wanted.alias("_p"))
    return made.select(*groups, "total", *[
        F.col("_p")[i].alias(f"p{round(100 * f)}_time_ms") for i, f in enumerate(fractions)])
