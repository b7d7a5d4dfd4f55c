import uuid

from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexspark.plans.corpus import clean_documents
from lexspark.session import scratch_path, shared_dir
from lexspark.sources import sinks, tables
from lexspark.streaming import jobs


def _name():
    return f"t_{uuid.uuid4().hex}"


def test_shared_folder_is_one_per_session(spark):
    assert shared_dir(spark) == shared_dir(spark)
    assert scratch_path(spark, "x") != scratch_path(spark, "x")


def test_overwrite_then_append_then_comment(spark, rows):
    name, path = _name(), scratch_path(spark, "t")
    one = spark.createDataFrame([(1, "a")], "id long, v string")
    sinks.overwrite(one, name, path)
    sinks.overwrite(spark.createDataFrame([(2, "b")], "id long, v string"), name, path)
    sinks.append_or_create(one, name)
    assert rows(spark.table(name)) == [(1, "a"), (2, "b")]
    sinks.describe(spark, name, "it's a table", {"reviewer": "x'y"})
    assert sinks.table_comment(spark, name) == "it's a table"
    assert ("reviewer", "x'y") in {tuple(r) for r in spark.sql(f"SHOW TBLPROPERTIES {name}").collect()}


def test_append_creates_a_missing_table(spark):
    name = _name()
    sinks.append_or_create(spark.range(3), name, scratch_path(spark, "t"))
    sinks.append_or_create(spark.range(2), name)
    assert spark.table(name).count() == 5


def test_new_columns_are_merged(spark, rows):
    path = scratch_path(spark, "merge")
    sinks.append_merge_schema(spark.createDataFrame([(1,)], "a long"), path)
    sinks.append_merge_schema(spark.createDataFrame([(2, "x")], "a long, b string"), path)
    assert rows(sinks.read_merged(spark, path), "a", "b") == [(1, None), (2, "x")]


def test_vectors_have_no_null_metadata_and_lie_by_source(spark):
    path = scratch_path(spark, "vectors")
    df = spark.createDataFrame([("a", None, None, "t", "law", None, "legal_section", [1.0])],
                               "chunk_id string, section_number string, title string, chunk_text string, source_law string, chapter string, content_type string, embedding array<double>")
    sinks.write_vectors(df, path)
    row = spark.read.parquet(path).first()
    assert (row.id, row.section_number, row.title, row.chapter, row.source_law) == ("a", "", "", "", "law")


def test_fallback_table_has_every_column(spark, rows):
    schema = T.StructType([T.StructField("question", T.StringType()), T.StructField("domain", T.StringType())])
    assert rows(tables.table_or_fallback(spark, _name(), [("q", None)], schema)) == [("q", None)]
    name = _name()
    spark.createDataFrame([("z", 1)], "question string, other int").createOrReplaceTempView(name)
    assert rows(tables.table_or_fallback(spark, name, [], schema)) == [("z", None)]


def test_listing_does_not_read_contents(spark):
    folder = scratch_path(spark, "files")
    spark.range(4).repartition(2).write.parquet(folder)
    listed = tables.list_files(spark, folder, ".parquet")
    assert listed.count() == 2 and all(r.filename.endswith(".parquet") for r in listed.collect())
    assert "content" not in listed._jdf.queryExecution().executedPlan().toString().split("ReadSchema")[-1]


def test_latest_snapshot(spark, rows):
    df = spark.createDataFrame([(1, 20240101), (2, 20240301), (3, 20240301)], "id long, snapshot_ts int")
    assert rows(tables.latest_snapshot(df), "id") == [(2,), (3,)]


def test_row_counts(spark, rows):
    assert rows(tables.row_counts({"a": spark.range(3), "b": spark.range(0)})) == [("a", 3), ("b", 0)]


def test_stream_equals_batch_and_picks_up_only_new_files(spark):
    folder, target, state = (scratch_path(spark, n) for n in ("in", "out", "state"))
    docs = spark.range(7).select(F.concat(F.lit("d"), F.col("id").cast("string")).alias("filename"),
                                 F.repeat(F.lit("word "), (F.col("id") * 20).cast("int")).alias("text"))
    docs.repartition(7, "filename").write.parquet(folder)

    def run():
        jobs.ingest_files(spark, folder, docs.schema, lambda raw: raw, target, state, files_per_batch=2)
        return {r.filename: r.char_count for r in spark.read.parquet(target).select("filename", "char_count").collect()}

    want = {r.filename: r.char_count for r in clean_documents(docs).collect()}
    assert run() == want and len(want) == 5
    batches = spark.read.parquet(target).select("batch_num").distinct().count()
    assert batches > 1
    docs.where("filename = 'd6'").withColumn("filename", F.lit("new")).coalesce(1).write.mode("append").parquet(folder)
    assert run() == want | {"new": want["d6"]}
    assert spark.read.parquet(target).count() == 6


def test_log_stream_appends_each_row_once(spark):
    folder, target, state = (scratch_path(spark, n) for n in ("log-in", "log-out", "log-state"))
    logs = spark.range(5).select(F.col("id").cast("string").alias("query_id"))
    logs.write.parquet(folder)
    for _ in range(2):
        jobs.append_log(spark.readStream.schema(logs.schema).parquet(folder), target, state)
    assert spark.read.parquet(target).count() == 5
