"""Quality rules as a ledger of bits: every rule is evaluated once, policies and ablations read the bits.

Everything here is a column or an aggregation; texts are neither shuffled nor sent to Python.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexspark.functions.text import once

WORD, WHITE = r"[^\x20\x09-\x0D]+", r"[\x20\x09-\x0D]"
SYMBOLS = r"[#*$%&|<>]"  # fixed value
MEASURES = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_capitals", "n_exclaimed")


@dataclass(frozen=True)
class Rule:
    """``failed`` is SQL over the measures; bit numbers are never given to another rule."""

    bit: int
    name: str
    failed: str


RULES = (
    Rule(0, "too_few_words", "n_words < 50"),
    Rule(1, "repeated_phrases", "100 * n_repeat_words > 50 * n_words"),
    Rule(2, "symbols", "10 * n_symbols > 3 * n_words"),
    Rule(3, "short_words", "word_chars < 2 * n_words"),
    Rule(4, "long_words", "word_chars > 20 * n_words"),
    Rule(5, "repeated_lines", "n_lines >= 4 AND 2 * n_dup_lines > n_lines"),
    Rule(6, "capitals", "2 * n_capitals > word_chars"),
    Rule(7, "exclamations", "4 * n_exclaimed > n_words"),
)
#: A policy is the set of rules that reject. Old versions stay, so that old corpora can be made again.
POLICIES: Mapping[str, tuple[str, ...]] = {
    "base": ("too_few_words", "repeated_phrases"),
    "v1": ("too_few_words", "repeated_phrases", "symbols", "repeated_lines"),
    "v2": tuple(r.name for r in RULES),
}


def mask(policy: str) -> int:
    wanted = POLICIES[policy]
    return sum(1 << r.bit for r in RULES if r.name in wanted)


def measured(documents: DataFrame) -> DataFrame:
    """All columns of ``documents`` but text, and the ``MEASURES`` (long) of the whole text; null has no words.

    For repeated phrases each 3-word window is one number, its hash above and its place below. Sorting these brings
    equal windows together; neighbours of equal hash are compared word by word.
    """
    names = [c for c in documents.columns if c != "text"]
    low = "(shiftleft(1L, _bits) - 1)"
    others = ["_row"]  # the caller's columns travel in one struct, so that no name can clash
    row = F.struct(F.lit(True).alias("_"), *[F.col(f"`{c}`") for c in names]).alias("_row")
    rows = documents.select(row, F.coalesce(F.col("text").cast("string"), F.lit("")).alias("_text"))
    rows = once(rows, *others, "_text", _words=F.regexp_extract_all("_text", F.lit(WORD), F.lit(0)),
                _lines=F.filter(F.split("_text", "\n"), lambda x: x.rlike(WORD)))
    rows = once(rows.withColumn("_bits", F.length(F.bin(F.size("_words").cast("long")))), *others, "_text", "_words", "_lines", "_bits",
                _sorted=F.expr("CASE WHEN size(_words) < 3 THEN array() ELSE sort_array(transform(sequence(1, size(_words) - 2), "
                               "i -> shiftleft(shiftright(xxhash64(_words[i - 1], _words[i], _words[i + 1]), _bits), _bits) | cast(i AS bigint))) END"))
    rows = once(rows, *others, "_text", "_words", "_lines", "_bits", "_sorted", _equal=F.expr(
        f"""filter(transform(_sorted, (x, j) -> CASE WHEN j > 0 AND shiftright(_sorted[j - 1], _bits) = shiftright(x, _bits)
            AND slice(_words, cast(_sorted[j - 1] & {low} AS int), 3) = slice(_words, cast(x & {low} AS int), 3) THEN j END), j -> j IS NOT NULL)"""))
    rows = once(rows, *others, "_text", "_words", "_lines", _places=F.expr(
        f"sort_array(array_distinct(transform(concat(_equal, transform(_equal, j -> j - 1)), j -> cast(_sorted[j] & {low} AS int))))"))
    covered = F.expr("aggregate(transform(_places, (p, k) -> CASE WHEN k + 1 < size(_places) THEN least(3, _places[k + 1] - p) ELSE 3 END), "
                     "0L, (total, c) -> total + c)")
    count = lambda pattern: F.regexp_count("_text", F.lit(pattern)).cast("long")
    rows = once(rows, *others, n_words=F.size("_words").cast("long"), word_chars=F.length(F.array_join("_words", "")).cast("long"),
                n_symbols=count(SYMBOLS), n_lines=F.size("_lines").cast("long"),
                n_dup_lines=(F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
                n_repeat_words=covered, n_capitals=count("[A-Z]"), n_exclaimed=count("!!"))
    return rows.select(*[F.col("_row").getField(c).alias(c) for c in names], *MEASURES)


def ledger(documents: DataFrame) -> DataFrame:
    """All columns but text, the measures, and ``failed_bits`` (long): bit b is set if the rule of that bit fails.

    ``documents`` needs text; every other column is carried along unless a measure has its name. Null or
    empty text has zero measures and fails ``too_few_words``. Repeated rows are judged each for itself.
    """
    keep = documents.drop(*MEASURES, "failed_bits")
    bits = sum((F.when(F.expr(r.failed), F.lit(1 << r.bit)).otherwise(F.lit(0)).cast("long") for r in RULES), F.lit(0).cast("long"))
    return measured(keep).withColumn("failed_bits", bits)


def passes(policy: str) -> Column:
    """True where no rule of the policy failed."""
    return F.col("failed_bits").bitwiseAND(F.lit(mask(policy))) == 0


def patterns(rows: DataFrame) -> DataFrame:
    """(failed_bits, n): at most one row for each combination of rules. All ablations come from this table."""
    return rows.groupBy("failed_bits").agg(F.count("*").alias("n"))


def ablations(rows: DataFrame, policy: str) -> DataFrame:
    """Per rule of a policy: how many rows fail it, fail only it (so would stay without it), and fail the policy."""
    held = F.lit(mask(policy))
    wanted = [r for r in RULES if r.name in POLICIES[policy]]
    counts = patterns(rows).withColumn("held", F.col("failed_bits").bitwiseAND(held))
    per = counts.select("n", "held", F.inline(F.array(*[
        F.struct(F.lit(r.name).alias("rule"), F.lit(1 << r.bit).cast("long").alias("own")) for r in wanted])))
    total = lambda condition: F.sum(F.when(condition, F.col("n")).otherwise(0))
    return per.groupBy("rule").agg(total(F.col("held").bitwiseAND(F.col("own")) != 0).alias("n_failed"),
                                   total(F.col("held") == F.col("own")).alias("n_failed_alone"),
                                   total(F.col("held") != 0).alias("n_rejected"))


def accepted(documents: DataFrame, policy: str = "v2") -> DataFrame:
    """``documents`` that pass the policy, with their own columns."""
    packed = documents.select(F.struct(*[F.col(f"`{c}`") for c in documents.columns]).alias("document"), F.col("text"))
    return ledger(packed).filter(passes(policy)).select("document.*")


def report(documents: DataFrame, policy: str = "v2") -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, failed_bits."""
    rows = ledger(documents.select("doc_id", "text"))
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                       (~passes("base")).alias("base_failed"), passes(policy).alias("kept"), "failed_bits")
