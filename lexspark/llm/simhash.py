"""Near-duplicates by SimHash fingerprints and multi-index hashing.

The 64 bits are cut in two segments of 32. If two fingerprints differ in at most two bits, then either
their high segments differ in at most one bit or their low segments are equal. So each fingerprint is
stored under both segments and looked up under its low segment, its high segment, and the small ball
around the latter (its zero bits set one at a time; the partner's lookups cover the other direction).
Fingerprints that meet no other in any table leave. For the others the complete distance is verified
without forming pairs: two fingerprints differ in at most two bits exactly if some number lies within
one bit of both, so every fingerprint is hung on the smallest one around each of its 65 neighbours.
Work is linear in the number of distinct fingerprints, however many share a segment.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexspark.llm.components import components
from lexspark.llm.store import saved
from lexspark.llm.words import buffers, slices

_ROWS = 1 << 16


def fingerprint(text: bytes, width: int, seed: int = 42) -> int:
    """SimHash of the ``width``-word shingles; a bit is set if it is in over half of their XXH64 values."""
    words = text.lower().split()  # bytes: A-Z and ASCII white space only
    if not words:
        return 0
    joined, ends = b" ".join(words), np.cumsum([len(w) + 1 for w in words]) - 1
    last = max(1, len(words) - width + 1)
    starts = np.concatenate([[0], ends[:-1] + 1])[:last].tolist()
    stops = ends[min(width, len(words)) - 1:].tolist()
    digest, bits = xxhash.xxh64_digest, np.zeros(64, dtype=np.int64)
    for at in range(0, last, _ROWS):
        held = b"".join([digest(joined[a:b], seed) for a, b in zip(starts[at:at + _ROWS], stops[at:at + _ROWS])])
        rows = np.frombuffer(held, dtype=np.uint8).reshape(-1, 8)
        bits += np.unpackbits(rows, axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(bits * 2 > last).tobytes(), "big", signed=True)


def fingerprints(documents: DataFrame, width: int = 5) -> DataFrame:
    """All columns of ``documents`` but text, and ``fingerprint`` (long, the 64 bits) of the whole text.

    A text with fewer words is one shingle; one without words, and a null text, has fingerprint zero.
    """
    others = [c for c in documents.columns if c != "text"]
    schema = documents.drop("text").schema.add("fingerprint", "long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            offsets, data = buffers(part.column("text"))
            held = data.tobytes()
            values = [fingerprint(held[a:b], width) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())]
            yield pa.RecordBatch.from_arrays([part.column(c) for c in others] + [pa.array(values, pa.int64())],
                                             names=[*others, "fingerprint"])

    return documents.mapInArrow(run, schema)


def _flips(value: Column, bits: range, unset_only: bool) -> Column:
    masks = F.array(*[F.lit(1 << b if b < 63 else -(1 << 63)).cast("long") for b in bits])
    if unset_only:
        masks = F.filter(masks, lambda m: value.bitwiseAND(m) == 0)
    return F.transform(masks, lambda m: value.bitwiseXOR(m))


def links(distinct: DataFrame) -> DataFrame:
    """(a, b): edges between distinct ``fingerprint`` values whose closure joins all within two bits."""
    value = F.col("fingerprint")
    high = F.shiftrightunsigned(value, 32)
    low = value.bitwiseAND(0xFFFFFFFF)
    entry = lambda table, key, own: F.struct(F.lit(table).alias("table"), key.alias("key"), F.lit(own).alias("stored"))
    stored = F.array(entry(0, high, True), entry(1, low, True))
    near = F.transform(_flips(high, range(32), True), lambda k: entry(0, k, False))
    lookups = distinct.select("fingerprint", F.inline(F.concat(stored, near)))
    matched = (lookups.groupBy("table", "key")
               .agg(F.count("*").alias("met"), F.max("stored").alias("stored")).filter("stored AND met > 1"))
    # Exploded rows look as few as their source to the optimizer; the hints keep it from broadcasting them.
    met = lookups.hint("merge").join(matched.select("table", "key"), ["table", "key"])
    suspects = saved(met.select("fingerprint").distinct(), "suspects")
    around = suspects.select("fingerprint", F.explode(F.concat(F.array("fingerprint"), _flips(value, range(64), False))).alias("middle"))
    centres = around.groupBy("middle").agg(F.min("fingerprint").alias("centre"), F.max("fingerprint").alias("other"))
    edges = around.hint("merge").join(centres.filter("centre < other").drop("other"), "middle").filter("fingerprint != centre")
    verified = edges.filter(F.bit_count(F.col("fingerprint").bitwiseXOR(F.col("centre"))) <= 2)
    return verified.select(F.col("fingerprint").alias("a"), F.col("centre").alias("b")).distinct()


def groups(documents: DataFrame, width: int = 5) -> DataFrame:
    """All columns of ``documents`` but text, ``fingerprint`` and ``component_id``.

    ``documents`` needs ``doc_id`` (long) and ``text``; its other columns may have any other name. Documents
    whose fingerprints differ in at most two of 64 bits are linked, and component_id is the smallest
    doc_id reachable, itself included. Equal fingerprints are compared once, so copies in any number are cheap.
    Rows without doc_id take part but name no component; if none in a component has an id, it is null.
    """
    printed = saved(fingerprints(documents, width), "fingerprints")
    distinct = printed.groupBy("fingerprint").agg(F.min("doc_id").alias("smallest"))
    roots = components(links(distinct.select("fingerprint")))
    named = distinct.join(roots.withColumnRenamed("node", "fingerprint"), "fingerprint", "left").withColumn(
        "root", F.coalesce("root", "fingerprint"))
    least = named.groupBy("root").agg(F.min("smallest").alias("component_id"))
    classes = saved(named.join(least, "root").select("fingerprint", "component_id"), "classes")
    return printed.join(classes, "fingerprint").select(*printed.columns, "component_id")


def one_of_each(documents: DataFrame, width: int = 5) -> DataFrame:
    """``documents`` with one document of each near-duplicate component: that of the smallest doc_id.

    Rows that share a doc_id are one document and stay or go together. Rows without doc_id stay.
    """
    grouped = groups(documents.select("doc_id", "text").filter("doc_id IS NOT NULL"), width)
    gone = grouped.filter("doc_id != component_id").select("doc_id")
    return documents.join(gone, "doc_id", "left_anti")
