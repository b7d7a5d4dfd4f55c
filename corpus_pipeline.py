"""From raw documents to packed sequences: five stages, each written to the shared folder and read again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexspark.llm import decontamination, lines, packing, quality, simhash
from lexspark.llm.store import saved
from lexspark.session import ship_package
from lexspark.sources.tables import read_table


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass all rules of policy v2 stay."""
    return quality.accepted(docs, "v2")


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later repeats of three or more lines, or of fewer that have 15 words, are cut out; every document stays, n_chars follows its text."""
    done = lines.without_repeats(docs, run=3, words=15)
    return done.withColumn("n_chars", F.when(F.col("_removed") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """SimHash near-dedup with the operator's contract: 3-word shingles, fingerprints within 2 bits are linked;
    the document of the smallest doc_id of each component stays."""
    ship_package(spark)
    return simhash.one_of_each(docs, width=3)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold ten consecutive words of a benchmark item, or a whole shorter item, go."""
    ship_package(spark)
    return decontamination.clean(docs, read_table(spark, sf_dir, "benchmark"), window=10)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What is left, in sequences of at most 2,048 tokens."""
    ship_package(spark)
    return packing.sequences(docs, size=2048)


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("decontaminate", decontaminate),
    ("pack", pack),
]

#: SQL has neither XXH64 nor the tokenizer; tests compare run() with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = saved(stage(spark, docs, sf_dir), f"corpus-{name}")
    return docs
