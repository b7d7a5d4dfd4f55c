"""Sinks, snapshots and the two streams: written to the shared folder and read back."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from lexspark.plans import corpus
from lexspark.registry import inputs
from lexspark.registry.base import query
from lexspark.registry.views import view
from lexspark.session import remove_at_exit, scratch_path
from lexspark.sources import sinks, tables
from lexspark.streaming import jobs


def _table(name: str) -> str:
    return f"lexspark_{name}_{uuid.uuid4().hex}"


@query("src_file_listing")
def src_file_listing(spark, sf):
    return tables.list_files(spark, sf, ".parquet")


@query("src_fallback_table", "SELECT item_id, question, subject_domain, NULL AS section_reference FROM v_mcq_questions")
def src_fallback_table(spark, sf):
    name = _table("questions")
    view(spark, sf, "mcq_questions").createOrReplaceTempView(name)
    schema = spark.sql("SELECT cast(NULL AS bigint) item_id, '' question, '' subject_domain, '' section_reference").schema
    return tables.table_or_fallback(spark, name, [(0, "What is Section 1?", "General", "1")], schema)


@query("src_latest_snapshot", "SELECT chunk_id, source_law, chunk_text, 20240201 AS snapshot_ts FROM v_chunks_v2")
def src_latest_snapshot(spark, sf):
    path = scratch_path(spark, "snapshots")
    for stamp, name in [(20240101, "chunks_v1"), (20240201, "chunks_v2")]:
        view(spark, sf, name).withColumn("snapshot_ts", F.lit(stamp)).write.mode("append") \
            .partitionBy("snapshot_ts").parquet(path)
    return tables.latest_snapshot(spark.read.parquet(path)).select("chunk_id", "source_law", "chunk_text", "snapshot_ts")


@query("snk_overwrite", "SELECT source_file, scheme_name, ministry, income_limit_inr FROM c_schemes")
def snk_overwrite(spark, sf):
    name, path = _table("schemes"), scratch_path(spark, "schemes")
    rows = inputs.schemes(spark, sf).select("source_file", "scheme_name", "ministry", "income_limit_inr")
    sinks.overwrite(rows.where(F.col("ministry").isNotNull()), name, path)
    sinks.overwrite(rows, name, path)
    return spark.table(name)


@query("snk_append_merge_schema", """SELECT filename, text, char_count, NULL AS lang_flag FROM c_documents
UNION ALL SELECT filename, text, char_count, 'scheme' FROM c_raw_schemes""")
def snk_append_merge_schema(spark, sf):
    path = scratch_path(spark, "raw-text")
    sinks.append_merge_schema(corpus.clean_documents(view(spark, sf, "raw_docs")), path)
    sinks.append_merge_schema(inputs.raw_schemes(spark, sf).withColumn("lang_flag", F.lit("scheme")), path)
    return sinks.read_merged(spark, path).select("filename", "text", "char_count", "lang_flag")


@query("snk_append_or_create", "SELECT * FROM c_eval_results UNION ALL SELECT * FROM c_eval_results")
def snk_append_or_create(spark, sf):
    name, path = _table("eval_results"), scratch_path(spark, "eval-results")
    rows = inputs.eval_results(spark, sf)
    sinks.append_or_create(rows, name, path)
    sinks.append_or_create(rows, name, path)
    return spark.table(name)


@query("snk_table_metadata", "SELECT change_type, count(*) AS row_count, 'Old sections mapped to new ones' AS comment FROM c_mapping GROUP BY ALL")
def snk_table_metadata(spark, sf):
    name, path = _table("mapping"), scratch_path(spark, "mapping")
    sinks.overwrite(inputs.mapping(spark, sf), name, path)
    sinks.describe(spark, name, "Old sections mapped to new ones", {"quality": "checked"})
    counted = spark.table(name).groupBy("change_type").agg(F.count("*").alias("row_count"))
    return counted.withColumn("comment", F.lit(sinks.table_comment(spark, name)))


@query("snk_vector_table", """SELECT chunk_id AS id, chunk_text AS document, section_number, coalesce(title, '') AS title, source_law,
  coalesce(chapter, '') AS chapter, content_type, 64 AS dimension FROM c_chunks""")
def snk_vector_table(spark, sf):
    path = scratch_path(spark, "vectors")
    sinks.write_vectors(inputs.chunk_vectors(spark, sf), path)
    stored = spark.read.parquet(path)
    return stored.withColumn("dimension", F.size("embedding")).drop("embedding")


@query("stm_file_ingest", "SELECT 'doc_' || doc_id AS filename, t AS text, length(t) AS char_count FROM (SELECT d.doc_id, c.text AS t "
       "FROM documents d JOIN c_clean_docs c ON c.filename = d.source || '_' || lpad(d.doc_id::varchar, 8, '0')) WHERE length(t) > 100")
def stm_file_ingest(spark, sf):
    schema = tables.read_table(spark, sf, "documents").schema
    target, state = scratch_path(spark, "ingested"), scratch_path(spark, "ingest-state")
    jobs.ingest_files(
        spark, tables.stream_path(sf, "documents"), schema,
        lambda raw: raw.select(F.concat(F.lit("doc_"), F.col("doc_id").cast("string")).alias("filename"), "text"),
        target, state)
    return spark.read.parquet(target).select("filename", "text", "char_count")


@query("stm_query_log_append", """SELECT query_id, original_query, detected_lang, intent, agent_used, response_time_ms FROM v_query_logs""")
def stm_query_log_append(spark, sf):
    logs = view(spark, sf, "query_logs")
    schema = tables.read_table(spark, sf, "events").schema
    stream = spark.readStream.schema(schema).parquet(tables.stream_path(sf, "events"))
    stream.createOrReplaceTempView(name := _table("events"))
    shaped = spark.sql(_log_sql(name)).select(*logs.columns)
    target, state = scratch_path(spark, "query-log"), scratch_path(spark, "log-state")
    jobs.append_log(shaped, target, state)
    return spark.read.parquet(target).select(
        "query_id", "original_query", "detected_lang", "intent", "agent_used", "response_time_ms")


@query("stm_answer_log", """SELECT question_id::varchar AS query_id, question AS original_query, question AS english_query, detected_lang, intent, agent_used
FROM c_routed""")
def stm_answer_log(spark, sf):
    """Questions arrive as files in two deliveries (the second re-sends a third of the first); the stream is stopped
    and started again on the same checkpoint between them. Every question is classified and logged once."""
    from lexspark.plans import answers

    questions = view(spark, sf, "routed_questions")
    asked = questions.select("*", F.col("question_id").cast("string").alias("query_id"), F.current_timestamp().alias("asked_at"))
    folder, target, state = scratch_path(spark, "questions-in"), scratch_path(spark, "answer-log"), scratch_path(spark, "answer-state")
    first = asked.where(F.abs(F.xxhash64("query_id")) % 2 == 0)
    second = asked.where(F.abs(F.xxhash64("query_id")) % 2 == 1).unionByName(first.where(F.abs(F.xxhash64("query_id")) % 3 == 0))

    def answer(batch):
        routed = answers.classify(batch.drop("query_id"))
        stamp = F.col("asked_at") if "asked_at" in routed.columns else None
        return answers.log_rows(routed, query_id=F.col("question_id").cast("string"), timestamp=stamp).drop("response_time_ms")

    for delivery in (first, second):
        delivery.write.mode("append").parquet(folder)
        jobs.answer_log(spark, folder, first.schema, answer, target, state)  # a new start each time: a restart
    for path in (folder, target, state):
        remove_at_exit(spark, path)
    return spark.read.parquet(target).select("query_id", "original_query", "english_query", "detected_lang", "intent", "agent_used")


def _log_sql(table: str) -> str:
    from lexspark.registry.views import VIEWS

    return VIEWS["query_logs"].format(events=table)
