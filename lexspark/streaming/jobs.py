"""The two incremental jobs: file ingest and the question log."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexspark.functions import fixed
from lexspark.plans.corpus import clean_documents


def ingest_files(spark: SparkSession, folder: str, schema: T.StructType, shape, target: str, state: str,
                 pattern: str = "*", files_per_batch: int = fixed.FILES_PER_BATCH) -> None:
    """Clean the files that have arrived since the last call, 50 per micro-batch, and store them.

    ``shape`` maps the raw rows to (filename, text). Each micro-batch owns one folder of the target,
    which it replaces as a whole; a batch that is run again after a failure leaves no duplicates.
    """
    raw = (
        spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch)
        .option("pathGlobFilter", pattern).parquet(folder)
    )
    stamped = clean_documents(shape(raw)).withColumn(
        "extracted_at", F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"))

    def store(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{target}/batch_num={number + 1}")

    query = (
        stamped.writeStream.foreachBatch(store).option("checkpointLocation", state)
        .trigger(availableNow=True).start()
    )
    query.awaitTermination()


def append_log(log_stream: DataFrame, target: str, state: str) -> None:
    """Append streaming log rows to the log files, each exactly once."""
    query = (
        log_stream.writeStream.format("parquet").outputMode("append").option("path", target)
        .option("checkpointLocation", state).trigger(availableNow=True).start()
    )
    query.awaitTermination()


def answer_log(spark: SparkSession, folder: str, schema: T.StructType, answer: Callable[[DataFrame], DataFrame], target: str, state: str,
               delay: str = "1 hour", files_per_batch: int = fixed.FILES_PER_BATCH) -> None:
    """Answer the questions that have arrived as files since the last call and log each question once.

    Rows carry ``query_id``, ``question`` and ``asked_at``. A question that arrives again with the same query_id
    within ``delay`` of the latest arrival is dropped by streaming state (kept in ``state``, so a restart does not
    answer or log it again); state expires with the watermark. ``answer`` maps a micro-batch of questions to log
    rows without ``response_time_ms``; each row's response time is the measured time of its micro-batch divided by
    its questions. A micro-batch owns one folder of ``target``, replaced as a whole if the batch runs again.
    """
    arriving = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(folder)
    once = arriving.withWatermark("asked_at", delay).dropDuplicatesWithinWatermark(["query_id"])

    def store(batch: DataFrame, number: int) -> None:
        from lexspark.session import remove_at_exit, scratch_path

        started = time.monotonic()
        staging = scratch_path(batch.sparkSession, "answered")
        answer(batch).write.parquet(staging)
        remove_at_exit(batch.sparkSession, staging)
        answered = batch.sparkSession.read.parquet(staging)
        count = answered.count()
        spent = int(round((time.monotonic() - started) * 1000 / max(count, 1)))
        answered.withColumn("response_time_ms", F.lit(spent).cast("bigint")) \
            .write.mode("overwrite").parquet(f"{target}/batch_num={number + 1}")

    query = once.writeStream.foreachBatch(store).option("checkpointLocation", state).trigger(availableNow=True).start()
    query.awaitTermination()
