"""License scans: fixed phrases, and an exact set-similarity join of text blocks with license templates.

Words are the matches of ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` after lower-casing A-Z (letters, digits and
anything beyond ASCII). Base: every place where a phrase's words stand consecutively.

Method (exact set-similarity join). A block is a window of ``2 L`` words at stride ``L`` over a document's
words, ``L`` the longest template in words, so that every stretch of up to ``L + 1`` words lies in one block;
a document shorter than that is one block. A template matches a block when
``|T & B| >= ceil(tenths / 10 * |T|)`` (containment of the template's distinct words). Only template words can
be shared, so a block is reduced to its template words. All such words are ordered globally by the number
of blocks holding them over the whole table (rarest first, ties by the word), and then

* prefix filter: a match shares a word among the first ``|T| - a + 1`` of T and the first ``|B| - a + 1`` of B;
* length filter: ``|B| >= a``;
* positional filter: with the first shared word at places ``i`` of T and ``j`` of B, at most
  ``min(|T| - i, |B| - j)`` words can be shared;
* verification: the exact overlap of the two sets.

The join of block prefixes with template prefixes is an equi-join on the word's rank; templates are a fixed,
small parameter and are broadcast. Results are exact: every block meeting the threshold is found.

Defined cases: null text has no words (n_words 0, no places, first/last null, labels ''). Repeated rows give
equal rows. Very long texts are scanned whole, block by block. Callers' other columns, clashing names included, are
not read and do not reach the result of ``report``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

# Fixed values of the contract: base phrases and their labels.
PHRASES = [
    ("under the mit license", "mit"),
    ("apache license version 2", "apache-2"),
    ("cc by nc", "cc-by-nc"),
]

# Templates of the method: common license notices, as their words (public license texts, shortened).
TEMPLATES = [
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software"),
    ("mit", "released under the mit license"),
    ("apache-2", "licensed under the apache license version 2 0"),
    ("gpl-3", "licensed under the gnu general public license version 3"),
    ("lgpl", "gnu lesser general public license"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted"),
    ("mpl-2", "subject to the terms of the mozilla public license version 2 0"),
    ("cc-by", "licensed under a creative commons attribution 4 0 international license"),
    ("cc-by-nc", "creative commons attribution noncommercial license"),
    ("cc-by-sa", "creative commons attribution sharealike license"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
]
TENTHS = 8  # containment of a template in a block: 0.8 or more


def words(text: Column) -> Column:
    """The matches of WORD: the non-empty pieces between runs of its complement (split is far cheaper than extraction)."""
    return F.array_remove(F.split(F.translate(F.coalesce(text, F.lit("")), _UPPER, _LOWER), _BETWEEN), "")


def _plain(text: str) -> list[str]:
    import re

    return re.findall(WORD, text.translate(str.maketrans(_UPPER, _LOWER)))


def base_places(ws: Column) -> Column:
    """Array of (start, label) of every phrase place, by start then phrase order."""
    found = []
    for phrase, label in PHRASES:
        parts = _plain(phrase)
        room = F.size(ws) - len(parts)
        starts = F.when(room >= 0, F.filter(F.sequence(F.lit(0), room), _test(ws, parts))).otherwise(F.array().cast("array<int>"))
        found.append(F.transform(starts, _tagged(label)))
    return F.array_sort(F.flatten(F.array(*found)))


def _test(ws: Column, parts: list[str]):
    def test(i: Column) -> Column:
        held = F.lit(True)
        for k, part in enumerate(parts):
            held = held & (F.element_at(ws, i + k + 1) == F.lit(part))
        return held

    return test


def _tagged(label: str):
    return lambda i: F.struct(i.cast("long").alias("start"), F.lit(label).alias("label"))


class Templates:
    """Templates as distinct word sets, with the numbers the filters need."""

    def __init__(self, templates=TEMPLATES, tenths: int = TENTHS):
        self.rows = [(n, label, sorted(set(_plain(text)))) for n, (label, text) in enumerate(templates)]
        self.tenths = tenths
        self.vocabulary = sorted({w for _, _, ws in self.rows for w in ws})
        self.span = max(len(_plain(text)) for _, text in templates)

    def needed(self, size: int) -> int:
        return max(1, (self.tenths * size + 9) // 10)


def blocks(docs: DataFrame, templates: Templates) -> DataFrame:
    """(_row, block, tokens): the template words of every block, distinct."""
    span = templates.span
    vocabulary = F.array(*(F.lit(w) for w in templates.vocabulary))
    count = F.greatest(F.lit(1), F.ceil((F.size("_words") - span) / span).cast("int"))
    windows = F.transform(F.sequence(F.lit(0), count - 1),
                          lambda b: F.struct(b.alias("block"), F.array_intersect(F.slice("_words", b * span + 1, 2 * span), vocabulary).alias("tokens")))
    return (docs.where(F.size("_words") > 0).select("_row", F.explode(windows).alias("b"))
            .select("_row", "b.block", "b.tokens").where(F.size("tokens") > 0))


def matches(docs: DataFrame, templates: Templates | None = None) -> DataFrame:
    """(_row, template, label, overlap, size): every (document, template) with a block meeting the threshold."""
    templates = templates or Templates()
    spark = docs.sparkSession
    held = blocks(docs, templates)
    # global order: blocks holding each template word, counted over the whole table (rows <= vocabulary)
    counts = dict(held.select(F.explode("tokens").alias("w")).groupBy("w").count().collect())
    order = sorted(templates.vocabulary, key=lambda w: (counts.get(w, 0), w))
    rank = {w: r for r, w in enumerate(order)}
    ranks = F.create_map(*(x for w in order for x in (F.lit(w), F.lit(rank[w]))))

    entries, smallest = [], None
    for n, label, ws in templates.rows:
        size, need = len(ws), templates.needed(len(ws))
        smallest = need if smallest is None else min(smallest, need)
        for i, r in enumerate(sorted(rank[w] for w in ws)[: size - need + 1]):
            entries.append((n, label, size, need, i, r, sorted(rank[w] for w in ws)))
    index = spark.createDataFrame(entries, "template int, label string, size int, need int, i int, rank int, ranks array<int>")

    sets = held.select("_row", "block", F.array_sort(F.transform("tokens", lambda w: F.element_at(ranks, w).cast("int"))).alias("ranks"))
    prefix = (sets.where(F.size("ranks") >= smallest)
              .select("_row", "block", "ranks", F.posexplode(F.slice("ranks", 1, F.size("ranks") - smallest + 1)).alias("j", "rank")))
    candidates = (prefix.join(F.broadcast(index.withColumnRenamed("ranks", "template_ranks")), "rank")
                  .where(F.col("j") <= F.size("ranks") - F.col("need"))
                  .groupBy("_row", "block", "template", "label", "size", "need")
                  .agg(F.min(F.struct("i", "j")).alias("first"), F.first("ranks").alias("ranks"), F.first("template_ranks").alias("template_ranks")))
    kept = candidates.where(F.least(F.col("size") - F.col("first.i"), F.size("ranks") - F.col("first.j")) >= F.col("need"))
    verified = kept.withColumn("overlap", F.size(F.array_intersect("ranks", "template_ranks"))).where(F.col("overlap") >= F.col("need"))
    return verified.groupBy("_row", "template", "label", "size").agg(F.max("overlap").alias("overlap"))


def report(docs: DataFrame, templates: Templates | None = None) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score of every row.

    A row is keyed by its doc_id and two hashes of its text: rows of equal key are repeated rows and get the same
    result, so nothing has to be written to number rows, and only narrow columns meet the matches in the join.
    """
    templates = templates or Templates()
    key = F.struct(F.coalesce(F.col("doc_id"), F.lit(0)).alias("i"), F.col("doc_id").isNull().alias("n"),
                   F.xxhash64(F.coalesce("text", F.lit(""))).alias("a"), F.hash(F.coalesce("text", F.lit(""))).alias("b"))
    rows = docs.select(key.alias("_row"), "doc_id", words(F.col("text")).alias("_words"))
    found = (matches(rows.select("_row", "_words"), templates).groupBy("_row")
             .agg(F.array_sort(F.collect_set("label")).alias("method"), F.max(F.col("overlap") / F.col("size")).alias("score")))
    places = rows.select("_row", "doc_id", F.size("_words").cast("long").alias("n_words"), base_places(F.col("_words")).alias("_places"))
    base = F.array_sort(F.array_distinct(F.transform(F.col("_places"), lambda p: p["label"])))
    narrow = places.select("_row", "doc_id", "n_words", F.size("_places").cast("long").alias("n_base"),
                           F.array_min(F.transform("_places", lambda p: p["start"])).alias("first_word"),
                           F.array_max(F.transform("_places", lambda p: p["start"])).alias("last_word"), base.alias("_base"))
    return (narrow.join(found, "_row", "left")
            .select("doc_id", "n_words", "n_base", "first_word", "last_word", F.array_join("_base", ",").alias("base_labels"),
                    F.array_join(F.array_sort(F.array_distinct(F.concat("_base", F.coalesce("method", F.array().cast("array<string>"))))), ",").alias("labels"),
                    F.coalesce("score", F.lit(0.0)).cast("double").alias("score")))
