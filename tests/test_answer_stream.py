"""Answered questions as a stream: once per query_id across restarts, measured times, readable by the recent-log report."""

import datetime

from pyspark.sql import functions as F

from lexspark.operators import reports
from lexspark.plans import answers
from lexspark.session import scratch_path
from lexspark.streaming import jobs

SCHEMA = "query_id string, question_id long, question string, asked_at timestamp"


def answer(batch):
    routed = answers.classify(batch.drop("query_id"))
    return answers.log_rows(routed, query_id=F.col("question_id").cast("string"), timestamp=F.col("asked_at")).drop("response_time_ms")


def test_logged_once_across_restarts(spark):
    now = datetime.datetime(2024, 5, 1, 12, 0, 0)
    rows = [(str(i), i, q, now) for i, q in enumerate(["What is Section 302?", "How did IPC 420 change?", "Which scheme can a farmer apply for?",
                                                       "धारा 5 क्या है?", "hello"])]
    folder, target, state = (scratch_path(spark, n) for n in ("q-in", "log", "state"))
    spark.createDataFrame(rows[:3], SCHEMA).write.mode("append").parquet(folder)
    jobs.answer_log(spark, folder, spark.createDataFrame([], SCHEMA).schema, answer, target, state)
    # the second delivery re-sends two questions; the job starts again on the same checkpoint
    spark.createDataFrame(rows[3:] + rows[:2], SCHEMA).write.mode("append").parquet(folder)
    jobs.answer_log(spark, folder, spark.createDataFrame([], SCHEMA).schema, answer, target, state)
    jobs.answer_log(spark, folder, spark.createDataFrame([], SCHEMA).schema, answer, target, state)  # nothing new
    log = spark.read.parquet(target)
    assert sorted(r.query_id for r in log.collect()) == ["0", "1", "2", "3", "4"]
    assert all(r.response_time_ms >= 0 for r in log.collect()) and max(r.response_time_ms for r in log.collect()) > 0
    assert reports.recent(log, 3).count() == 3
