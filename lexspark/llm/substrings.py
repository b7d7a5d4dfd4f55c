"""Removal of long passages that repeat across documents, by compaction of a De Bruijn graph of words.

Edges of the graph are windows of ``window`` consecutive words, nodes the window less one word. As in
minimizer-partitioned graph builders, each document's walk is cut where the smallest hash of the seeds
(``seed`` words) within the window changes. Such a *piece* is a stretch of edges, and all occurrences of
an edge lie in pieces of the same minimizer, so one join on minimizers finds every repeat:

* a minimizer met in one document only has no repeated edge and leaves at once;
* a minimizer whose pieces are all equal is a path without branches: it is handled whole;
* where its pieces differ, the path branches, and only there the single edges are compared.

Each repeated stretch carries the coordinates of its first source. Stretches whose coordinates advance
together in both documents are one path and are joined to a span; a span thereby holds for every word.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lexspark.llm.store import saved
from lexspark.llm.words import OTHER_BASE, Sequences, Words, sliding_min, slices

_WALK = ("doc_id long, n_words long, kept_sha256 string, minimizer long, piece long, start long, edges long")
_EDGES = "doc_id long, minimizer long, edge long, start long"
_KEPT = "doc_id long, whole_sha256 string, n_removed long, kept_sha256 string"


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def _walks(window: int, seed: int):
    """Per document its size and digest; per piece the minimizer, the hash of all its words and its place."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            ids, words = part.column("doc_id"), Words(part.column("text"))
            whole = [hashlib.sha256(b" ".join((t.as_py() or b"").split())).hexdigest()
                     for t in part.column("text").cast(pa.binary())]
            counts, docs = words.counts, words.texts()
            minimizer = piece = starts = edges = np.zeros(0, dtype=np.int64)
            if len(words) >= window:
                hashes = words.hashes()
                seeds = Sequences(hashes, OTHER_BASE).windows(seed)
                least = sliding_min(seeds, window - seed + 1)
                ends = words.first[1:]
                inside = np.flatnonzero(np.arange(len(least)) + window <= ends[docs[:len(least)]])
                if len(inside):
                    values, owner = least[inside], docs[inside]
                    cut = np.flatnonzero(np.concatenate([[True], (values[1:] != values[:-1]) | (owner[1:] != owner[:-1])]))
                    sizes = np.diff(np.concatenate([cut, [len(inside)]]))
                    begin = inside[cut]
                    minimizer, edges = values[cut], sizes
                    piece = Sequences(hashes).between(begin, begin + sizes + window - 1)
                    starts, docs = begin - words.first[owner[cut]], owner[cut]
            n, m = part.num_rows, len(starts)
            docs = docs[:m]
            yield pa.RecordBatch.from_arrays([
                pa.concat_arrays([ids, ids.take(pa.array(docs.astype(np.int64)))]),
                pa.array(np.concatenate([counts, np.zeros(m, np.int64)]), mask=np.arange(n + m) >= n),
                pa.concat_arrays([pa.array(whole, pa.string()), pa.nulls(m, pa.string())]),
                pa.concat_arrays([pa.nulls(n, pa.int64()), _signed(minimizer)]),
                pa.concat_arrays([pa.nulls(n, pa.int64()), _signed(piece)]),
                pa.concat_arrays([pa.nulls(n, pa.int64()), pa.array(starts.astype(np.int64))]),
                pa.concat_arrays([pa.nulls(n, pa.int64()), pa.array(edges.astype(np.int64))]),
            ], names=["doc_id", "n_words", "kept_sha256", "minimizer", "piece", "start", "edges"])

    return run


def _single_edges(window: int):
    """The edges of the given pieces (``branching``) of each text, hashed one by one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            words = Words(part.column("text"))
            listed = part.column("branching")
            lists, rows = listed.flatten(), np.repeat(np.arange(part.num_rows), np.diff(listed.offsets.to_numpy()))
            if not len(rows):
                continue
            minimizer, begin, n = (lists.field(c).to_numpy() for c in ("minimizer", "start", "edges"))
            within = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            local = np.repeat(begin, n) + within
            places = np.repeat(words.first[rows], n) + local
            edge = Sequences(words.hashes()).between(places, places + window)
            yield pa.RecordBatch.from_arrays([
                part.column("doc_id").take(pa.array(np.repeat(rows, n))), pa.array(np.repeat(minimizer, n)),
                _signed(edge), pa.array(local)], names=["doc_id", "minimizer", "edge", "start"])

    return run


def _rest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts without the words of their spans."""
    for part in slices(batches):
        whole, removed, digests = [], [], []
        for text, spans in zip(part.column("text").cast(pa.binary()), part.column("spans"), strict=True):
            words, at, kept = (text.as_py() or b"").split(), 0, []
            for span in sorted(spans.as_py() or [], key=lambda s: s["start"]):
                kept += words[at:span["start"]]
                at = max(at, span["end"])
            kept += words[at:]
            whole.append(hashlib.sha256(b" ".join(words)).hexdigest())
            removed.append(len(words) - len(kept))
            digests.append(hashlib.sha256(b" ".join(kept)).hexdigest())
        yield pa.RecordBatch.from_arrays(
            [part.column("doc_id"), pa.array(whole, pa.string()), pa.array(removed, pa.int64()), pa.array(digests, pa.string())],
            names=["doc_id", "whole_sha256", "n_removed", "kept_sha256"])


class RepeatedPassages:
    """Passages of at least ``window`` words that also stand in a document of smaller id.

    ``documents`` needs ``doc_id`` (long) and ``text``; further columns of any name are ignored. Words are
    runs without space, tab or line ends; null or empty text has none. Rows without doc_id are never sources
    and nothing is taken from them. Repeats within one document do not count, nor do those between rows
    that share a doc_id and a text; rows of one doc_id but other text get the spans of all its rows
    that fit, so ids should be unique. Ties of sources go to the smallest place. Texts are read whole.
    """

    def __init__(self, documents: DataFrame, window: int = 50, seed: int = 10):
        if not 1 <= seed <= window:
            raise ValueError("seed must be between 1 and window")
        self.texts = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
        self.window = window
        walks = saved(self.texts.mapInArrow(_walks(window, seed), _WALK), "walks")
        self.sizes = walks.filter("minimizer IS NULL").select("doc_id", "n_words", "kept_sha256")
        pieces = walks.filter("minimizer IS NOT NULL AND doc_id IS NOT NULL").drop("n_words", "kept_sha256")
        repeated = (pieces.groupBy("minimizer")
                    .agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high"),
                         (F.min("piece") != F.max("piece")).alias("branching"))
                    .filter("low < high").select("minimizer", "branching"))
        self.pieces = saved(pieces.join(repeated, "minimizer"), "repeated-pieces")
        named = self.pieces.groupBy("doc_id").agg(
            F.collect_list(F.when(F.col("branching"), F.struct("minimizer", "start", "edges"))).alias("branching"))
        #: Texts that hold a repeated minimizer, with the pieces to be looked at edge by edge.
        self.suspects = saved(self.texts.join(named, "doc_id"), "suspects")

    def spans(self) -> DataFrame:
        """(doc_id, start, end, source_doc_id, source_start): repeated paths in words, end exclusive."""
        edges = saved(self.suspects.filter(F.size("branching") > 0).mapInArrow(_single_edges(self.window), _EDGES), "edges")
        found = None
        for table, keys, size in ((self.pieces.filter("NOT branching"), ["minimizer", "piece"], F.col("edges")),
                                  (edges, ["minimizer", "edge"], F.lit(1))):
            sources = table.groupBy(*keys).agg(F.min(F.struct("doc_id", "start")).alias("source"), F.max("doc_id").alias("high"))
            # Written first, so that the join deals out both sides itself and can split a hot key.
            sources = saved(sources.filter("source.doc_id < high").drop("high"), "sources")
            hit = (table.join(sources, keys).filter("source.doc_id < doc_id")
                   .select("doc_id", "start", (F.col("start") + size + self.window - 1).alias("end"),
                           F.col("source.doc_id").alias("source_doc_id"), F.col("source.start").alias("source_start")))
            found = hit if found is None else found.union(hit)
        diagonal = W.partitionBy("doc_id", "source_doc_id", F.col("start") - F.col("source_start")).orderBy("start", "end")
        reach = F.max("end").over(diagonal.rowsBetween(W.unboundedPreceding, -1))
        path = F.sum(F.when(F.col("start") <= F.col("reach"), 0).otherwise(1)).over(diagonal)
        return (found.withColumn("reach", reach).withColumn("path", path)
                .groupBy("doc_id", "source_doc_id", (F.col("start") - F.col("source_start")).alias("shift"), "path")
                .agg(F.min("start").alias("start"), F.max("end").alias("end"))
                .select("doc_id", "start", "end", "source_doc_id", (F.col("start") - F.col("shift")).alias("source_start")))

    def remaining(self) -> DataFrame:
        """(doc_id, n_words, n_removed, kept_sha256) of every row, the kept words joined by single spaces."""
        lists = self.spans().groupBy("doc_id").agg(F.collect_list(F.struct("start", "end")).alias("spans"))
        cut = self.suspects.select("doc_id", "text").join(lists, "doc_id").mapInArrow(_rest, _KEPT).dropDuplicates()
        cut = cut.select("doc_id", "whole_sha256", "n_removed", F.col("kept_sha256").alias("rest_sha256"))
        sizes = self.sizes.withColumnRenamed("kept_sha256", "whole_sha256")
        return sizes.join(cut, ["doc_id", "whole_sha256"], "left").select(
            "doc_id", "n_words", F.coalesce("n_removed", F.lit(0).cast("long")).alias("n_removed"),
            F.coalesce("rest_sha256", "whole_sha256").alias("kept_sha256"))
