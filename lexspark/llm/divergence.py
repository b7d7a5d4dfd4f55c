"""Source divergence audit: how far each source's term distribution stands from the others of its language.

Method: single-pass in-memory indexing. Every task reads its documents once and builds block postings
``(lang, source, term) -> (occurrences, documents)`` of ``SLICE_BYTES`` of text at a time, sorted by key. Blocks are
hash-partitioned by key and merged per shard into frequencies. Pair distances then stream as corrections of a baseline:

* a kept term that neither group uses differs by ``|z_g - z_o|``, ``z`` a group's probability of an absent term;
  ``(V - |T_g| - |T_o| + |T_g & T_o|) * |z_g - z_o|`` covers all of them at once;
* every posting of g against the z of every other group (a broadcast fan-out summed map-side), and
* every pair of postings of one term (a self-join on (lang, term), at most one posting a source)

correct it exactly for the terms one or both hold. Nothing is collected by group; a language's hot term has at
most one posting a source.

Contract: null text, lang and source read as ''. Terms are the matches of ``[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+``
after lower-casing A-Z only. A language keeps the ``V`` terms found in at least ``min_docs`` of its documents (each
row is a document, repeated rows count again). ``p = 1 + floor(1e9 * (count + 5) / (N + 5 V))`` in exact integer
arithmetic, ``N`` the sum of kept counts of the group (or language). Every occurring (lang, source) group gets
``pair`` rows for every other source of its language, and ``term`` rows for its kept terms with count > 0 whose
p exceeds the language's, only ranks 1 to ``top``. Ranks run from 1 per group and part, value descending, item
ascending in UTF-8 order. Empty tables give no rows; a language of one source has no pair rows; V = 0 gives
pair values 0. Callers' extra columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexspark.llm.words import Words, byte_set, slices

# Fixed values of the contract.
TERM = r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+"
_MEMBERS = ~byte_set((0x00, 0x40), (0x5B, 0x60), (0x7B, 0x7F))  # the bytes of terms
SCALE, SMOOTHING = 1_000_000_000, 5
MIN_DOCS, TOP = 30, 50

BUDGET = 100_000  # postings that the plain Python blocks hold before a run is spilled
SLICE_BYTES = 12_000_000  # text of one block; bounds the memory of a task
BROADCAST_GROUPS = 200_000  # (lang, source) groups up to which their list is broadcast
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_POSTINGS = "lang string, source string, term string, count long, docs long"


def _runs(budget: int):
    """Block postings of a task's documents, spilled as term-sorted runs whenever ``budget`` keys are held."""
    pattern = re.compile(TERM)
    table = str.maketrans(_UPPER, _LOWER)

    def spill(block: dict) -> pd.DataFrame:
        keys = sorted(block, key=lambda k: (k[2], k[0], k[1]))
        return pd.DataFrame({"lang": [k[0] for k in keys], "source": [k[1] for k in keys], "term": [k[2] for k in keys],
                             "count": [block[k][0] for k in keys], "docs": [block[k][1] for k in keys]})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        block: dict[tuple[str, str, str], list[int]] = {}
        for batch in batches:
            for lang, source, text in zip(batch["lang"], batch["source"], batch["text"]):
                seen: dict[str, int] = {}
                for term in pattern.findall(text.translate(table)):
                    seen[term] = seen.get(term, 0) + 1
                for term, n in seen.items():
                    held = block.get((lang, source, term))
                    if held is None:
                        block[(lang, source, term)] = [n, 1]
                    else:
                        held[0] += n
                        held[1] += 1
                if len(block) >= budget:
                    yield spill(block)
                    block = {}
        if block:
            yield spill(block)

    return run


def _p(count: str, total: str, size: str):
    """1 + floor(1e9 * (count + 5) / (total + 5 V)) over named columns, in exact integer arithmetic."""
    return F.expr(f"1 + (CAST({count} + {SMOOTHING} AS DECIMAL(38,0)) * CAST({SCALE} AS DECIMAL(38,0))) "
                  f"div CAST({total} + {SMOOTHING} * {size} AS DECIMAL(38,0))").cast("long")


def _block(rows: pa.RecordBatch) -> pa.RecordBatch:
    """Postings of one slice of documents: one row per (lang, source, term), sorted by these as they are numbered."""
    words = Words(rows.column("text"), _MEMBERS, lower=True)
    # words are all bytes that are not separators, so they lie end to end once those are left out
    ends = np.concatenate([[0], np.cumsum(words.ends - words.starts)]).astype("int64")
    held = words.data[_MEMBERS[words.data]]
    terms = pa.LargeStringArray.from_buffers(len(words), pa.py_buffer(ends), pa.py_buffer(held)).dictionary_encode()
    langs, sources = rows.column("lang").dictionary_encode(), rows.column("source").dictionary_encode()
    group = langs.indices.to_numpy().astype("int64") * max(len(sources.dictionary), 1) + sources.indices.to_numpy()
    size = max(len(terms.dictionary), 1)
    in_text, times = np.unique(words.texts() * size + terms.indices.to_numpy(), return_counts=True)
    keys = group[in_text // size] * size + in_text % size
    order = np.argsort(keys, kind="stable")
    keys, times = keys[order], times[order]
    first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.zeros(0, dtype="int64")
    keys, counts = keys[first], np.add.reduceat(times, first) if len(first) else first
    lang, source = np.divmod(keys // size, max(len(sources.dictionary), 1))
    return pa.RecordBatch.from_arrays(
        [langs.dictionary.take(pa.array(lang)), sources.dictionary.take(pa.array(source)),
         terms.dictionary.take(pa.array(keys % size)).cast(pa.string()),
         pa.array(counts, pa.int64()), pa.array(np.diff(np.append(first, len(order))), pa.int64())],
        names=["lang", "source", "term", "count", "docs"])


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for rows in slices(batches, limit=SLICE_BYTES):
        yield _block(rows)


def frequencies(docs: DataFrame, budget: int = BUDGET, python: bool = False) -> DataFrame:
    """(lang, source, term, count, docs): block postings of every task merged per hash shard.

    By default the blocks are built from whole Arrow slices, without a loop over words. A block has one row per key, so
    it is shuffled as it is: a partial aggregation before the shuffle would find little to combine. ``python=True`` builds them word by word with a budget of ``budget`` keys
    (same result, much slower; the tests compare both).
    """
    clean = docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")))
    runs = clean.mapInPandas(_runs(budget), _POSTINGS) if python else clean.mapInArrow(_blocks, _POSTINGS)
    key = ["lang", "source", "term"]
    return runs.repartition(*key).groupBy(*key).agg(F.sum("count").alias("count"), F.sum("docs").alias("docs"))


def audit(docs: DataFrame, min_docs: int = MIN_DOCS, top: int = TOP, budget: int = BUDGET, python: bool = False) -> DataFrame:
    """lang, source, part, item, value, rank of every occurring group (see the module's contract)."""
    from lexspark.llm.store import saved

    merged = saved(frequencies(docs, budget, python), "divergence-postings")
    groups = docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source"))).distinct()
    by_lang = merged.groupBy("lang", "term").agg(F.sum("docs").alias("df"), F.sum("count").alias("lang_count"))
    kept = by_lang.where(F.col("df") >= min_docs).select("lang", "term", "lang_count")
    sizes = kept.groupBy("lang").agg(F.count("*").alias("V"), F.sum("lang_count").alias("NL"))
    postings = merged.join(kept.select("lang", "term"), ["lang", "term"], "left_semi").select("lang", "source", "term", "count")
    totals = postings.groupBy("lang", "source").agg(F.sum("count").alias("N"), F.count("*").alias("held"))
    groups = saved(groups.join(totals, ["lang", "source"], "left").join(sizes, "lang", "left")
                   .select("lang", "source", F.coalesce("N", F.lit(0)).cast("long").alias("N"),
                           F.coalesce("V", F.lit(0)).cast("long").alias("V"),
                           F.coalesce("held", F.lit(0)).cast("long").alias("held"))
                   .withColumn("z", F.when(F.col("V") > 0, _p("0", "N", "V"))), "divergence-groups")
    scored = saved(postings.join(groups, ["lang", "source"]).withColumn("p", _p("count", "N", "V"))
                   .select("lang", "source", "term", "p", "z"), "divergence-scored")

    lang_p = kept.join(sizes, "lang").select("lang", "term", _p("lang_count", "NL", "V").alias("q"))
    terms = (scored.join(lang_p, ["lang", "term"]).where(F.col("p") > F.col("q"))
             .select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), (F.col("p") - F.col("q")).alias("value")))

    # pairs: sum over kept terms of |P_g - P_o|, P = p where the group holds the term, else its z
    other = groups.select("lang", F.col("source").alias("other"), F.col("z").alias("zo"), F.col("held").alias("held_o"))
    if groups.count() <= BROADCAST_GROUPS:  # the list of groups is broadcast only under a counted bound
        other = F.broadcast(other)
    pairs = groups.join(other, "lang").where(F.col("source") != F.col("other"))
    # every posting of g against every other z_o: streamed from a broadcast join into partial sums
    fan = (scored.join(other, "lang").where(F.col("source") != F.col("other"))
           .groupBy("lang", "source", "other").agg(F.sum(F.abs(F.col("p") - F.col("zo"))).alias("g_vs_z")))
    # terms both hold: a self-join on (lang, term), at most one posting a source each
    theirs = scored.select("lang", "term", F.col("source").alias("other"), F.col("p").alias("po"), F.col("z").alias("zo"))
    # each unordered pair once (source < other), mirrored afterwards
    half = (scored.join(theirs, ["lang", "term"]).where(F.col("source") < F.col("other"))
            .groupBy("lang", "source", "other")
            .agg(F.count("*").alias("n_both"), F.sum(F.abs(F.col("p") - F.col("po"))).alias("both"),
                 F.sum(F.abs(F.col("p") - F.col("zo"))).alias("g_vs_zo"), F.sum(F.abs(F.col("po") - F.col("z"))).alias("o_vs_zg")))
    both = half.unionByName(half.select("lang", F.col("other").alias("source"), F.col("source").alias("other"), "n_both", "both",
                                        F.col("o_vs_zg").alias("g_vs_zo"), F.col("g_vs_zo").alias("o_vs_zg")))
    back = fan.select("lang", F.col("other").alias("source"), F.col("source").alias("other"), F.col("g_vs_z").alias("o_vs_z"))
    zero = F.lit(0).cast("long")
    value = (F.coalesce("both", zero) + F.coalesce("g_vs_z", zero) - F.coalesce("g_vs_zo", zero)
             + F.coalesce("o_vs_z", zero) - F.coalesce("o_vs_zg", zero)
             + (F.col("V") - F.col("held") - F.col("held_o") + F.coalesce("n_both", zero)) * F.abs(F.coalesce(F.col("z") - F.col("zo"), zero)))
    pairs = (pairs.join(fan, ["lang", "source", "other"], "left").join(back, ["lang", "source", "other"], "left")
             .join(both, ["lang", "source", "other"], "left")
             .select("lang", "source", F.lit("pair").alias("part"), F.col("other").alias("item"), value.cast("long").alias("value")))

    order = Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), F.col("item").asc())
    ranked_pairs = pairs.withColumn("rank", F.row_number().over(order).cast("int"))
    # a filter on row_number alone lets Spark keep the best ``top`` of each group before the shuffle
    ranked_terms = terms.withColumn("rank", F.row_number().over(order).cast("int")).where(F.col("rank") <= top)
    return ranked_pairs.unionByName(ranked_terms).select("lang", "source", "part", "item", F.col("value").cast("long"), "rank")
