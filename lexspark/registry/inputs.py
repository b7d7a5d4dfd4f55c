"""Intermediate DataFrames that several registered queries start from."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lexspark.plans import answers, corpus, evaluation
from lexspark.registry.views import view
from lexspark.session import remove_at_exit, scratch_path

_PATHS: dict[tuple[str, str, str], str] = {}


def raw_schemes(spark: SparkSession, sf: str) -> DataFrame:
    # The table is a small file of many rows, read by one or two tasks; the patterns on its texts need more of them.
    texts = view(spark, sf, "scheme_texts").repartition(4 * spark.sparkContext.defaultParallelism, "filename")
    return corpus.clean_documents(texts)


def schemes(spark: SparkSession, sf: str) -> DataFrame:
    return corpus.scheme_table(raw_schemes(spark, sf))


def mapping(spark: SparkSession, sf: str) -> DataFrame:
    return corpus.mapping_table(view(spark, sf, "section_pairs"))


def sections(spark: SparkSession, sf: str) -> DataFrame:
    return corpus.extract_sections(view(spark, sf, "statute_pages"), "IPC_1860")


def statutes(spark: SparkSession, sf: str) -> dict[str, DataFrame]:
    return {
        "bns_": view(spark, sf, "bns_sections"),
        "bnss_": view(spark, sf, "bnss_sections"),
        "bsa_": view(spark, sf, "bsa_sections"),
        "ipc_": sections(spark, sf),
    }


def _stored(spark: SparkSession, sf: str, name: str, build) -> DataFrame:
    """The built table, written once per session to the shared folder, as the corpus build would leave it."""
    key = (spark.sparkContext.applicationId, sf, name)
    if key not in _PATHS:
        path = scratch_path(spark, name)
        build().write.mode("overwrite").parquet(path)
        remove_at_exit(spark, path)
        _PATHS[key] = path
    return spark.read.parquet(_PATHS[key])


def built_chunks(spark: SparkSession, sf: str) -> DataFrame:
    return corpus.unified_chunks(statutes(spark, sf), schemes(spark, sf))


def chunks(spark: SparkSession, sf: str) -> DataFrame:
    return _stored(spark, sf, "chunks", lambda: built_chunks(spark, sf))


def chunk_vectors(spark: SparkSession, sf: str) -> DataFrame:
    return _stored(spark, sf, "chunk-vectors", lambda: answers.embed_chunks(chunks(spark, sf))[0])


def results(spark: SparkSession, sf: str) -> DataFrame:
    return answers.retrieve(view(spark, sf, "questions"), chunk_vectors(spark, sf), 5)


def eval_results(spark: SparkSession, sf: str) -> DataFrame:
    return evaluation.result_rows(evaluation.keyword_score(view(spark, sf, "eval_cases")))
