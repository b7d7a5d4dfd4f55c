import pytest

from __spark_entry__ import queries


@pytest.mark.parametrize("files", [0, 3])  # one file, a folder of files
@pytest.mark.parametrize("name", ["stm_file_ingest", "stm_query_log_append"])
def test_a_stream_reads_a_table_of_one_file_or_of_many(spark, rows, tmp_path, name, files):
    made = {
        "documents": spark.sql("SELECT id AS doc_id, repeat('a word ', 20 + id) AS text, 'en' AS lang, 'web' AS source, 200L AS n_chars FROM range(9)"),
        "events": spark.sql("SELECT id AS event_id, id AS user_id, 'click' AS event_type, 1.5D AS value, timestamp'2024-01-01 00:00:00' AS ts, '{}' AS props FROM range(9)"),
    }
    for table, df in made.items():
        if files:
            df.repartition(files).write.parquet(f"{tmp_path}/{table}.parquet")
        else:
            df.toPandas().to_parquet(f"{tmp_path}/{table}.parquet", coerce_timestamps="us")
    assert queries()[name](spark, str(tmp_path)).count() == 9
