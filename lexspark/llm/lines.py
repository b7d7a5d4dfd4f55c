"""Removal of repeated runs of lines by winnowing. Columns, joins and aggregations only.

The hashes of a document's lines are its sequence. Of every window of ``run`` lines the smallest hash is
a fingerprint, so two equal runs of at least that length share one, at the same place in both. Fingerprints met
once leave; the others bring their windows, which are joined on the hash of the whole window. Each
later window is a match that reaches ``run`` lines around its fingerprint; matches that follow each other extend
it both ways. Lines of later matches are deleted, the first occurrence stays.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexspark.functions.text import once
from lexspark.llm.store import saved

WORD = r"[^\x20\x09-\x0D]"


def _lines(documents: DataFrame, counted: bool = False) -> DataFrame:
    """doc_id, ``version`` (tells rows of one doc_id apart) and the hash of each line, trimmed; blank lines have 0.

    If ``counted``, also ``words``, the number of words of each line.
    """
    text = F.col("text").cast("string")
    rows = documents.filter("doc_id IS NOT NULL AND text IS NOT NULL").select(
        F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("version"), text.alias("text"))
    trim = lambda x: F.btrim(x, F.lit(" \t\x0b\f\r"))
    split = F.split("text", "\n")
    words = {"words": F.transform(split, lambda x: F.regexp_count(x, F.lit(WORD + "+")))} if counted else {}
    return once(rows, "doc_id", "version", hashes=F.transform(
        split, lambda x: F.when(F.length(trim(x)) == 0, F.lit(0).cast("long")).otherwise(F.xxhash64(trim(x)))), **words)


def _windows(size: int) -> str:
    """SQL of all windows of ``size`` lines."""
    return (f"transform(filter(sequence(0, size(hashes) - 1), i -> i + {size} <= size(hashes)), i -> named_struct('line', i, 'size', {size}, 'fingerprint', "
            f"array_min(filter(slice(hashes, i + 1, {size}), h -> h != 0)), 'window', xxhash64(slice(hashes, i + 1, {size}))))")


def repeated_lines(documents: DataFrame, run: int = 3, words: int | None = None) -> DataFrame:
    """(doc_id, version, line): places of the lines (from 0) inside later repeats of ``run`` or more lines.

    With ``words``, a repeat of fewer lines counts as well if it has that many words.
    """
    held = [_windows(run)]
    for size in range(1, run if words else 1):
        held.append(f"filter({_windows(size)}, w -> aggregate(slice(words, w.line + 1, {size}), 0, (n, x) -> n + x) >= {words})")
    windows = _lines(documents, bool(words)).select("doc_id", "version", F.inline(F.expr(f"concat({', '.join(held)})")))
    windows = saved(windows.filter("fingerprint IS NOT NULL"), "line-windows")
    met = windows.groupBy("fingerprint").agg(F.count("*").alias("n")).filter("n > 1").select("fingerprint")
    joined = windows.join(met, "fingerprint")
    place = F.struct("doc_id", "line")
    first = joined.groupBy("fingerprint", "window").agg(F.min(place).alias("first"), F.max(place).alias("last")).filter("first < last")
    # Written first, so that the join deals out both sides itself and can split a hot window.
    first = saved(first.drop("last"), "first-windows")
    later = joined.join(first, ["fingerprint", "window"]).filter("struct(doc_id, line) > first")
    return later.select("doc_id", "version", F.explode(F.sequence("line", F.col("line") + F.col("size") - 1)).alias("line")).distinct()


def without_repeats(documents: DataFrame, run: int = 3, words: int | None = None) -> DataFrame:
    """``documents`` with the repeated lines cut out of ``text``, and ``_lines`` and ``_removed`` (long).

    A run has ``run`` or more lines, or any number of lines that have ``words`` words together if that is given.
    It repeats if the same lines, trimmed, stand in this order in a document of smaller doc_id or earlier in the same one;
    a run of blank lines does not count. ``documents`` needs doc_id (long) and text; other columns are kept, whatever
    their names. Rows without doc_id and null texts stay as they are; repeated rows do not delete each other.
    A document may lose all its lines; its text is then empty.
    """
    gone = (repeated_lines(documents.select("doc_id", "text"), run, words)
            .groupBy("doc_id", "version").agg(F.sort_array(F.collect_list("line")).alias("gone")))
    rows = documents.select(F.struct(*[F.col(f"`{c}`") for c in documents.columns]).alias("document"),
                            F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.col("text").cast("string")).alias("version"))
    rows = rows.join(gone, ["doc_id", "version"], "left")
    lines = F.split(F.col("document.text").cast("string"), "\n")
    left = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), "gone")
    rest = F.when(F.col("gone").isNull(), F.col("document.text")).otherwise(
        F.array_join(F.transform(left, lambda i: F.get(lines, i)), "\n"))
    return rows.select(*[(rest if c == "text" else F.col("document").getField(c)).alias(c) for c in documents.columns],
                       F.coalesce(F.size(lines), F.lit(0)).cast("long").alias("_lines"),
                       F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias("_removed"))
