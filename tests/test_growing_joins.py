from lexspark.operators.lookups import MAP_COLUMNS, lookup_by_number, lookup_by_topic
from lexspark.plans import answers
from lexspark.registry.views import view


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_lookups_broadcast_neither_queries_nor_map(spark, rows):
    queries = spark.createDataFrame([(1, "red ring"), (2, "12"), (3, "ring")], "query_id long, query string")
    mapping = spark.createDataFrame([("12", "Red Ring", "7", "blue bolt", "renamed", "moved", "none"),
                                     ("13", "green nut", "8", "Small ring", "renamed", "moved", "none")], MAP_COLUMNS)
    by_topic, by_number = lookup_by_topic(queries, mapping), lookup_by_number(queries, mapping)
    assert rows(by_topic, "query_id", "rank", "ipc_section") == [(1, 1, "12"), (3, 1, "12"), (3, 2, "13")]
    assert rows(by_number, "query_id", "ipc_section") == [(2, "12")]
    assert "Broadcast" not in _plan(by_topic) and "Broadcast" not in _plan(by_number)


def test_views_do_not_broadcast_customers_or_parts(spark, tmp_path):
    spark.sql("SELECT id AS c_custkey, 'x' AS c_mktsegment, 1 AS c_nationkey FROM range(9)").write.parquet(f"{tmp_path}/customer.parquet")
    spark.sql("SELECT id AS p_partkey, 'large ring' AS p_name FROM range(9)").write.parquet(f"{tmp_path}/part.parquet")
    made = view(spark, str(tmp_path), "compare_queries")
    assert made.count() == 9 and "Broadcast" not in _plan(made)


def test_answers_broadcast_neither_questions_nor_texts(spark):
    chunks = spark.createDataFrame([("c1", "1", "Theft", "theft of property", "BNS", "legal_section"),
                                    ("c2", "2", "Ring", "a red ring", "IPC", "legal_section")], answers.RESULT_COLUMNS[:4] + ["source_law", "content_type"])
    vectors = answers.embed_chunks(chunks)[0]
    asked = spark.createDataFrame([(1, "theft", None), (2, "ring", "nowhere")], "question_id long, question string, wanted string")
    compared = spark.createDataFrame([(1, "12"), (2, "ring"), (3, "other")], "query_id long, query string")
    mapping = spark.createDataFrame([("12", "Red Ring", "7", "blue bolt", "renamed", "moved", "none")], MAP_COLUMNS)
    near, both = answers.retrieve(asked, vectors, 1), answers.hybrid(asked, vectors, 1, wanted="wanted")
    replies = answers.compare_answers(compared, mapping, vectors)
    assert "Broadcast" not in _plan(near) and "Broadcast" not in _plan(both) and "Broadcast" not in _plan(replies)
    assert {(r.question_id, r.chunk_id, r.found_by) for r in both.collect()} == {(1, "c1", "semantic"), (2, "c2", "keyword")}
    assert replies.count() == 3


def test_a_hybrid_search_keeps_ids_only_until_texts_are_asked_for(spark):
    chunks = spark.createDataFrame([("c1", "1", "Theft", "theft of property", "BNS", "legal_section")], answers.RESULT_COLUMNS[:4] + ["source_law", "content_type"])
    asked = spark.createDataFrame([(1, "theft", None)], "question_id long, question string, wanted string")
    found = answers.hybrid(asked, answers.embed_chunks(chunks)[0], 1, wanted="wanted")
    kept = found.where("found_by = 'semantic'").select("question_id", "chunk_id")
    assert kept.count() == 1
    scans = [f for f in kept.inputFiles() if "/near-" in f]
    assert scans and set(spark.read.parquet(scans[0]).columns) == {"question_id", "rank", "chunk_id", "distance", "similarity"}
