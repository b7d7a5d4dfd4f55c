"""Point lookups of section numbers and of section-map rows, for tables of questions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexspark.functions.text import is_section_number, section_reference, strip
from lexspark.operators.containment import contains_pairs
from lexspark.operators.windows import top_k

MAP_COLUMNS = ["ipc_section", "ipc_title", "bns_section", "bns_title", "change_type", "change_detail",
               "impact_for_citizen"]


def first_row(df: DataFrame, key: str, order: list[str]) -> DataFrame:
    """One row per key, the least by ``order``; combined inside tasks before the shuffle."""
    others = [c for c in df.columns if c != key]
    least = F.min_by(F.struct(*others), F.struct(*order)).alias("_row")
    return df.groupBy(key).agg(least).select(key, "_row.*")


def lookup_section(questions: DataFrame, sections: DataFrame) -> DataFrame:
    """The section whose number the question names; questions without a hit keep NULLs."""
    one_each = first_row(
        sections.select(F.col("section_number").alias("found_section"), F.col("title").alias("found_title"),
                        F.col("full_text").alias("found_text"), F.col("source_law").alias("found_law")),
        "found_section", ["found_law", "found_title", "found_text"])
    asked = questions.withColumn("asked_section", section_reference(F.col("question")))
    naming = asked.where(F.col("asked_section").isNotNull()).join(
        one_each, F.col("asked_section") == F.col("found_section"), "left")
    # Questions that name no section stay where they are instead of meeting under NULL in one task.
    return naming.unionByName(asked.where(F.col("asked_section").isNull()), allowMissingColumns=True)


def lookup_by_number(queries: DataFrame, mapping: DataFrame) -> DataFrame:
    """Section-map row for queries that are a bare section number: old number first, then new number."""
    mapping = mapping.select(*MAP_COLUMNS)
    numbers = queries.where(is_section_number(F.col("query"))).select(
        "query_id", strip(F.col("query")).alias("number"))
    sides = [
        first_row(mapping.withColumn("number", F.col(side)).withColumn("side", F.lit(order)), "number",
                  ["ipc_section", "bns_section", "ipc_title"])
        for order, side in enumerate(["ipc_section", "bns_section"])
    ]
    best = first_row(sides[0].unionByName(sides[1]), "number", ["side"])
    # Both sides of these joins grow, and the size of a compressed file says little about its rows: no broadcast.
    return numbers.join(best.hint("merge"), "number").select("query_id", *MAP_COLUMNS)


def lookup_by_topic(queries: DataFrame, mapping: DataFrame, rows: int = 3) -> DataFrame:
    """First map rows (by old section) whose titles or change detail contain the query, ignoring case."""
    topics = queries.where(~is_section_number(F.col("query"))).select(
        "query_id", F.lower("query").alias("topic"))
    order = ["ipc_section", "bns_section", "ipc_title"]
    filed = mapping.select(
        *MAP_COLUMNS,
        F.explode(F.array(F.lower("ipc_title"), F.lower("bns_title"), F.lower("change_detail"))).alias("text"),
    ).where(F.col("text").isNotNull())
    # Titles repeat: match each distinct text once, and keep only the rows that it can put forward.
    once = filed.select("text").distinct().withColumn("body", F.col("text"))
    hits = contains_pairs(topics.select("topic"), "topic", once, "text", "body")
    leading = top_k(filed.distinct(), ["text"], order, rows, "text_rank").drop("text_rank")
    found = hits.join(leading.hint("merge"), "text").drop("text").distinct()
    best = top_k(found, ["topic"], order, rows)
    return topics.join(best.hint("merge"), "topic").select("query_id", "rank", *MAP_COLUMNS)


def section_map_sample(mapping: DataFrame, rows: int = 5) -> DataFrame:
    """Context lines of the first map rows, whatever the query."""
    line = F.concat(F.lit("IPC "), "ipc_section", F.lit(" → BNS "), "bns_section", F.lit(": "), "change_type")
    return (
        mapping.orderBy("ipc_section", "bns_section", "ipc_title").limit(rows)
        .select("ipc_section", "bns_section", "ipc_title", "change_type", "change_detail", line.alias("line"))
    )
