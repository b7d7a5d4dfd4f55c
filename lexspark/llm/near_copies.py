"""Near copies by the real similarity of their shingle sets.

Two texts are near copies if the sets of their ``width``-word shingles have a Jaccard similarity of at least 0.8.
A pair of that similarity differs in about 15% of the bits of a SimHash of any width, so that segments wide enough
to be selective are rarely equal. Candidates are therefore found by minima: each of 24 bands joins the least shingles
under six permutations, and a pair of similarity s shares a band with probability 1 - (1 - s^6)^24, which is 0.9993
at 0.8 and over 0.99999 from 0.86 on. Every candidate is verified on the whole sets before it is linked.
Texts of equal sets are one node. In a bucket all nodes are compared with its least and its largest one first; only nodes
that are then not yet connected are compared with each other, so a bucket of true near copies makes no pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexspark.llm.components import components
from lexspark.llm.store import saved
from lexspark.llm.words import Sequences, Words, _mixed, slices

BANDS, ROWS = 24, 6
TENTHS = 8


def shingle_sets(texts: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Offsets and the distinct shingle hashes of each text, ascending; a text of fewer words is one shingle."""
    words = Words(texts, lower=True)
    owner, at = words.texts(), np.arange(len(words))
    ends = words.first[1:][owner] if len(words) else at
    starts = at[(at + width <= ends) | (at == words.first[:-1][owner])] if len(words) else at
    hashes = Sequences(words.hashes()).between(starts, np.minimum(starts + width, ends[starts])) if len(words) else np.zeros(0, dtype=np.uint64)
    owner = owner[starts]
    order = np.lexsort((hashes, owner))
    owner, hashes = owner[order], hashes[order]
    fresh = np.ones(len(hashes), dtype=bool)
    fresh[1:] = (hashes[1:] != hashes[:-1]) | (owner[1:] != owner[:-1])
    owner, hashes = owner[fresh], hashes[fresh]
    return np.searchsorted(owner, np.arange(len(texts) + 1)), hashes


def nodes(offsets: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """One number for each set; zero for the empty one."""
    sums = np.zeros(len(hashes) + 1, dtype=np.uint64)
    np.cumsum(_mixed(hashes ^ np.uint64(0xA5A5A5A5A5A5A5A5)), out=sums[1:])
    sizes = np.diff(offsets).astype(np.uint64)
    return np.where(sizes > 0, _mixed(sums[offsets[1:]] - sums[offsets[:-1]] + sizes), np.uint64(0)).view(np.int64)


def band_keys(offsets: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """A row of ``BANDS`` keys for each set that is not empty."""
    firsts = offsets[:-1][np.diff(offsets) > 0]
    factors = np.random.default_rng(5).integers(0, 1 << 63, (BANDS * ROWS, 2), dtype=np.uint64)
    keys = np.zeros((len(firsts), BANDS), dtype=np.uint64)
    if len(firsts):
        for k, (factor, shift) in enumerate(factors):
            least = np.minimum.reduceat(hashes * (factor * np.uint64(2) + np.uint64(1)) + shift, firsts)
            keys[:, k // ROWS] = _mixed(keys[:, k // ROWS] ^ least)
    return keys.view(np.int64)


def _signed(documents: DataFrame, width: int) -> DataFrame:
    """doc_id, ``node`` and ``keys`` (one a band; none for a text without words)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            offsets, hashes = shingle_sets(part.column("text"), width)
            full = np.diff(offsets) > 0
            keys = pa.ListArray.from_arrays(np.concatenate([[0], np.cumsum(full) * BANDS]).astype(np.int32), pa.array(band_keys(offsets, hashes).ravel()))
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(nodes(offsets, hashes)), keys], names=["doc_id", "node", "keys"])

    return documents.mapInArrow(run, "doc_id long, node long, keys array<long>")


def _sets(documents: DataFrame, width: int) -> DataFrame:
    """``node`` and its ``shingles``, ascending."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            offsets, hashes = shingle_sets(part.column("text"), width)
            held = pa.ListArray.from_arrays(offsets.astype(np.int32), pa.array(hashes.view(np.int64)))
            yield pa.RecordBatch.from_arrays([pa.array(nodes(offsets, hashes)), held], names=["node", "shingles"])

    return documents.mapInArrow(run, "node long, shingles array<long>")


def _verified(pairs: DataFrame, sets: DataFrame, tenths: int) -> DataFrame:
    """Those pairs (a, b) of nodes whose sets are alike enough."""
    sizes = sets.select("node", F.size("shingles").alias("n"))
    side = lambda df, x, n: df.withColumnsRenamed({"node": x, "n": n, "shingles": f"of_{x}"})
    able = pairs.join(side(sizes, "a", "na"), "a").join(side(sizes, "b", "nb"), "b").filter(
        F.least("na", "nb") * 10 >= F.greatest("na", "nb") * tenths)
    both = able.hint("merge").join(side(sets, "a", "na"), "a").hint("merge").join(side(sets, "b", "nb"), "b")
    shared = F.size(F.array_intersect("of_a", "of_b"))
    return both.filter(shared * 10 >= (F.col("na") + F.col("nb") - shared) * tenths).select("a", "b")


def links(documents: DataFrame, signed: DataFrame, width: int = 5, tenths: int = TENTHS) -> DataFrame:
    """(node, root) of all nodes that a chain of verified pairs connects with another."""
    least = signed.groupBy("node").agg(F.min("doc_id").alias("doc_id"), F.first("keys").alias("keys"))
    places = least.select("node", F.posexplode("keys").alias("band", "key"))
    met = places.groupBy("band", "key").agg(F.min("node").alias("low"), F.max("node").alias("high")).filter("low < high")
    members = saved(places.hint("merge").join(met, ["band", "key"]), "band-members")
    suspects = members.select("node").distinct()
    texts = documents.join(least.select("node", "doc_id").join(suspects, "node").select("doc_id").distinct(), "doc_id", "left_semi")
    sets = _sets(texts.select("text"), width).join(suspects, "node", "left_semi")
    sets = saved(sets.groupBy("node").agg(F.first("shingles").alias("shingles")), "shingle-sets")
    pair = lambda x, y: F.struct(F.least(x, y).alias("a"), F.greatest(x, y).alias("b"))
    stars = saved(members.select(F.inline(F.array(pair("node", "low"), pair("node", "high")))).filter("a < b").distinct(), "stars")
    near = saved(_verified(stars, sets, tenths), "star-links")
    roots = components(near)
    # What the stars have left apart in a bucket is compared there one by one.
    rooted = members.select("band", "key", "node").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    parted = rooted.groupBy("band", "key").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.count("*").alias("n")).filter("low < high AND n > 2")
    rest = saved(rooted.hint("merge").join(parted.select("band", "key"), ["band", "key"]), "parted")
    other = rest.select("band", "key", F.col("node").alias("b"), F.col("root").alias("root_b"))
    pairs = rest.withColumnRenamed("node", "a").hint("merge").join(other, ["band", "key"]).filter("a < b AND root != root_b").select("a", "b").distinct()
    more = _verified(saved(pairs.join(stars, ["a", "b"], "left_anti"), "rest-pairs"), sets, tenths)
    return components(near.union(more))


def one_of_each(documents: DataFrame, width: int = 5, tenths: int = TENTHS) -> DataFrame:
    """``documents`` with one document of each component of near copies: that of the smallest doc_id.

    Near copies share at least ``tenths`` tenths of all their distinct shingles; exact copies always are, texts without words as well.
    Rows that share a doc_id are one document and stay or go together. Rows without doc_id stay.
    """
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).filter("doc_id IS NOT NULL")
    signed = saved(_signed(rows, width), "signed")
    roots = links(rows, signed, width, tenths)
    named = signed.select("doc_id", "node").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    least = named.groupBy("root").agg(F.min("doc_id").alias("kept"))
    gone = named.join(least, "root").filter("doc_id != kept").select("doc_id").distinct()
    return documents.join(gone, "doc_id", "left_anti")
