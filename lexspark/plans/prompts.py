"""Prompt columns for sections, schemes and section-map rows, and what models reply to them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexspark.functions import fixed
from lexspark.functions.text import cut, fill, or_default, strip
from lexspark.operators.models import Model, score
from lexspark.operators.reports import collect_by_class


def summarize_sections(sections: DataFrame, chars: int | None = None) -> DataFrame:
    return sections.withColumn("prompt", fill(
        fixed.SUMMARY_PROMPT, number=F.col("section_number"), title=F.col("title"), text=cut(F.col("full_text"), chars)))


def classify_schemes(schemes: DataFrame, chars: int | None = None) -> DataFrame:
    return schemes.withColumn("prompt", fill(
        fixed.CLASSIFY_PROMPT, name=F.col("scheme_name"), text=cut(F.col("full_text"), chars)))


def extract_from_schemes(schemes: DataFrame, chars: int | None = None) -> DataFrame:
    return schemes.withColumn("prompt", fill(
        fixed.EXTRACT_PROMPT, name=F.col("scheme_name"), text=cut(F.col("full_text"), chars)))


def explain_changes(mapping: DataFrame) -> DataFrame:
    return mapping.withColumn("prompt", fill(
        fixed.EXPLAIN_CHANGE_PROMPT, old=F.col("ipc_section"), old_title=F.col("ipc_title"), new=F.col("bns_section"),
        change=F.col("change_type"), detail=F.col("change_detail")))


def one_word_classes(schemes: DataFrame, chars: int | None = None) -> DataFrame:
    return schemes.withColumn("prompt", fill(fixed.ONE_WORD_PROMPT, text=cut(F.col("full_text"), chars)))


def replies(prompted: DataFrame, models: Sequence[tuple[str, Model]], column: str = "reply") -> DataFrame:
    """Every row's prompt answered by the first model that works; NULL where none does. Equal prompts are asked once."""
    return score(prompted, "prompt", models, F.lit(None).cast("string"), answer=column)


def model_class_counts(schemes: DataFrame, models: Sequence[tuple[str, Model]], default: str = fixed.DEFAULT_CLASS,
                       names_per_class: int | None = None) -> DataFrame:
    """Named schemes counted and listed by the class that a model gave them."""
    classed = replies(one_word_classes(schemes.where(F.col("scheme_name").isNotNull())), models, "_class")
    named = classed.withColumn("category", or_default(strip(F.col("_class")), default))
    return collect_by_class(named, "category", "scheme_name", ["scheme_name", "source_file"], names_per_class)
