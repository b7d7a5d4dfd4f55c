"""Benchmark decontamination with suffix arrays over shards of the training texts.

Each slice of documents that a task reads is a shard. Its words are coded by the benchmark's vocabulary,
its suffixes that start like some test suffix are sorted by their words, and every test suffix is looked
up in that array by binary search. Suffixes that start unlike any test suffix can't be met by a search
and are left out of the array, which keeps it small. Shards need nothing from each other, so documents are read
once and never shuffled; the benchmark is broadcast in blocks of a fixed size, one pass for each.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexspark.llm.store import total_bytes
from lexspark.llm.words import Sequences, Words, byte_set, slices

#: ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`` after lower-casing A-Z.
ALPHANUMERIC = ~byte_set((0x00, 0x2F), (0x3A, 0x60), (0x7B, 0x7F))
BLOCK_BYTES = 16 << 20
_HEAD = 3  # words by which suffixes are picked for the array
_SPAN = "array<struct<start:long,end:long>>"
_MATCH = "array<struct<item_id:string,item_start:long,start:long,words:long>>"


@dataclass
class Block:
    """A block of test items: vocabulary, coded words, and the distinct windows with their places."""

    vocabulary: np.ndarray  # sorted word hashes; the code of a word is its place plus one
    groups: list[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]
    names: list[str | None]


def _coded(hashes: np.ndarray, vocabulary: np.ndarray) -> np.ndarray:
    at = np.minimum(np.searchsorted(vocabulary, hashes), len(vocabulary) - 1)
    return np.where(vocabulary[at] == hashes, at + 1, 0).astype(np.uint32)


def _order(codes: np.ndarray, starts: np.ndarray, width: int) -> np.ndarray:
    """Order of suffixes by their first ``width`` words."""
    return np.lexsort([codes[starts + k] for k in range(width - 1, -1, -1)])


def block_of(items: pa.Table, window: int) -> Block | None:
    """Suffixes of the items; an item with fewer words than a window, but not none, is one window."""
    words = Words(items.column("text").combine_chunks(), ALPHANUMERIC, lower=True)
    if not len(words):
        return None
    ids = items.column("item_id").combine_chunks().cast(pa.string())
    vocabulary = np.unique(words.hashes())
    codes, owner = _coded(words.hashes(), vocabulary), words.texts()
    counts, place = words.counts[owner], np.arange(len(words)) - words.first[owner]
    groups = []
    for width in sorted({int(c) for c in np.minimum(words.counts, window) if c}):
        starts = np.flatnonzero((np.minimum(counts, window) == width) & (place + width <= counts))
        order = _order(codes, starts, width)
        starts = starts[order]
        rows = codes[starts[:, None] + np.arange(width)]
        fresh = np.concatenate([[True], (rows[1:] != rows[:-1]).any(axis=1)])
        heads = Sequences(codes.astype(np.uint64)).between(starts, starts + min(width, _HEAD))
        groups.append((width, rows[fresh], np.append(np.flatnonzero(fresh), len(starts)),
                       owner[starts], place[starts], np.unique(heads)))
    return Block(vocabulary, groups, ids.to_pylist())


def _member(values: np.ndarray, known: np.ndarray) -> np.ndarray:
    at = np.minimum(np.searchsorted(known, values), len(known) - 1)
    return known[at] == values


def _below(suffixes: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Binary search: place of the first suffix that isn't smaller, for rows of words."""
    low, high = np.zeros(len(wanted), np.int64), np.full(len(wanted), len(suffixes), np.int64)
    while (open_ := low < high).any():
        middle = (low + high) // 2
        rows = suffixes[np.minimum(middle, len(suffixes) - 1)]
        differ = rows != wanted
        first = np.argmax(differ, axis=1)
        line = np.arange(len(wanted))
        smaller = differ.any(axis=1) & (rows[line, first] < wanted[line, first])
        low, high = np.where(open_ & smaller, middle + 1, low), np.where(open_ & ~smaller, middle, high)
    return low


def search(texts: pa.Array, block: Block) -> tuple[Words, np.ndarray, np.ndarray]:
    """Words, a flag for each word that a window covers, and matches.

    A match is a row of the text, item, start in the item, start in the text and number of words, as long as
    it can be extended verbatim.
    """
    words = Words(texts, ALPHANUMERIC, lower=True)
    rises = np.zeros(len(words) + 1, dtype=np.int64)
    found = []
    if len(words):
        codes, owner = _coded(words.hashes(), block.vocabulary), words.texts()
        left = words.first[1:][owner] - np.arange(len(words))
        sums = Sequences(codes.astype(np.uint64))
        for width, tests, bounds, items, places, heads in block.groups:
            size = min(width, _HEAD)
            able = np.flatnonzero((left >= width) & (codes > 0))
            able = able[_member(sums.between(able, able + size), heads)] if len(able) else able
            if not len(able):
                continue
            suffixes = able[_order(codes, able, width)]
            sorted_words = codes[suffixes[:, None] + np.arange(width)]
            present = np.flatnonzero(np.isin(tests[:, 0], sorted_words[:, 0]))
            low = _below(sorted_words, tests[present])
            wanted = tests[present]
            hit = low < len(suffixes)
            hit[hit] = (sorted_words[low[hit]] == wanted[hit]).all(axis=1)
            present, low = present[hit], low[hit]
            if not len(present):
                continue
            fresh = np.concatenate([[True], (sorted_words[1:] != sorted_words[:-1]).any(axis=1)])
            runs = np.append(np.flatnonzero(fresh), len(suffixes))
            run = np.searchsorted(runs, low)
            n = runs[run + 1] - low
            test = np.repeat(present, n)
            at = suffixes[np.repeat(low, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)]
            np.add.at(rises, at, 1)
            np.add.at(rises, at + width, -1)
            found.append(_extended(width, at, test, bounds, items, places, owner, words.first))
    covered = np.cumsum(rises[:-1]) > 0 if len(words) else np.zeros(0, dtype=bool)
    return words, covered, np.concatenate(found) if found else np.zeros((0, 5), dtype=np.int64)


def _extended(width, at, test, bounds, items, places, owner, first) -> np.ndarray:
    """Longest match of each text and item; windows that follow each other in both are one match."""
    per = bounds[test + 1] - bounds[test]
    entry = np.repeat(bounds[test], per) + np.arange(per.sum()) - np.repeat(np.cumsum(per) - per, per)
    at = np.repeat(at, per)
    text, item, inside = owner[at], items[entry], places[entry]
    order = np.lexsort([at, at - inside, item, text])
    text, item, inside, at = text[order], item[order], inside[order], at[order]
    joined = (text[1:] == text[:-1]) & (item[1:] == item[:-1]) & (at[1:] - at[:-1] == 1) & (inside[1:] - inside[:-1] == 1)
    begin = np.flatnonzero(np.concatenate([[True], ~joined]))
    size = np.diff(np.append(begin, len(at))) + width - 1
    rows = np.stack([text[begin], item[begin], inside[begin], at[begin] - first[text[begin]], size], axis=1)
    rows = rows[np.lexsort([rows[:, 2], rows[:, 3], -rows[:, 4], rows[:, 1], rows[:, 0]])]
    keep = np.concatenate([[True], (rows[1:, :2] != rows[:-1, :2]).any(axis=1)])
    return rows[keep]


def _united(spans: list[dict]) -> list[dict]:
    out: list[dict] = []
    for span in sorted(spans, key=lambda s: s["start"]):
        if out and span["start"] <= out[-1]["end"]:
            out[-1]["end"] = max(out[-1]["end"], span["end"])
        else:
            out.append(dict(span))
    return out


def _pass(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = shared.value
        for part in slices(batches):
            words, covered, matches = search(part.column("text"), block)
            n = part.num_rows
            spans = [list(x or []) for x in part.column("_spans").to_pylist()]
            listed = [list(x or []) for x in part.column("_matches").to_pylist()]
            edge = np.diff(np.concatenate([[0], covered.astype(np.int8), [0]]))
            starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
            for start, end in zip(starts.tolist(), ends.tolist()):
                text = int(np.searchsorted(words.first, start, side="right")) - 1
                while start < end:  # neighbouring texts may both be covered
                    stop = min(end, int(words.first[text + 1]))
                    if stop > start:
                        spans[text].append({"start": start - int(words.first[text]), "end": stop - int(words.first[text])})
                    start, text = max(start, stop), text + 1
            for text, item, inside, at, size in matches.tolist():
                listed[text].append({"item_id": block.names[item], "item_start": inside, "start": at, "words": size})
            kept = {c: part.column(c) for c in ("document", "text")}
            kept |= {"_words": pa.array(words.counts, pa.int64()), "_spans": pa.array([_united(s) for s in spans], _SPANS),
                     "_matches": pa.array(listed, _MATCHES)}
            assert len(kept["_spans"]) == n
            yield pa.RecordBatch.from_pydict(kept)

    return run


_SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
_MATCHES = pa.list_(pa.struct([("item_id", pa.string()), ("item_start", pa.int64()), ("start", pa.int64()), ("words", pa.int64())]))


def overlaps(documents: DataFrame, benchmark: DataFrame, window: int = 10, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``document`` (all columns as one struct), ``_words`` (their number), ``_spans`` and ``_matches``.

    ``_spans`` are the stretches of words inside any occurrence of a window of an item, ``_matches`` the longest
    verbatim match with each item: its id as a string, place there, place here, words. ``documents`` needs
    ``text``, ``benchmark`` needs ``item_id`` and ``text``; other columns may have any name. Null texts have no words.
    Items with a null id take part and have a null name; rows with one id are one item. The benchmark is counted
    first and broadcast in blocks of about ``block_bytes``; each block is one more pass over the rows.
    """
    spark = documents.sparkSession
    items = benchmark.select("item_id", F.col("text").cast("string").alias("text"))
    blocks = 1 + total_bytes(items, "text") // block_bytes
    whole = F.struct(*[F.col(f"`{c}`") for c in documents.columns]).alias("document")
    result = documents.select(whole, F.col("text").cast("string").alias("text"), F.lit(0).cast("long").alias("_words"), F.array().cast(_SPAN).alias("_spans"),
                              F.array().cast(_MATCH).alias("_matches"))
    schema = result.schema
    empty = Block(np.zeros(1, np.uint64), [], [])
    for k in range(blocks):
        part = items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == k) if blocks > 1 else items
        result = result.mapInArrow(_pass(spark.sparkContext.broadcast(block_of(part.toArrow(), window) or empty)), schema)
    return result.drop("text")


def contaminated(documents: DataFrame, benchmark: DataFrame, window: int = 10, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(doc_id, n_words, n_hit, n_items, items_sha256, contaminated) of every row.

    Items without an id count among n_items as one, and are not named in the digest.
    """
    ids = F.array_sort(F.array_distinct(F.filter(F.transform("_matches", lambda m: m["item_id"]), lambda i: i.isNotNull())))
    hit = F.aggregate("_spans", F.lit(0).cast("long"), lambda total, s: total + s["end"] - s["start"])
    return overlaps(documents.select("doc_id", "text"), benchmark, window, block_bytes).select(
        "document.doc_id", F.col("_words").alias("n_words"), hit.alias("n_hit"),
        F.size(F.array_distinct(F.transform("_matches", lambda m: m["item_id"]))).cast("long").alias("n_items"),
        F.sha2(F.array_join(ids, ","), 256).alias("items_sha256"), (F.size("_spans") > 0).alias("contaminated"))


def clean(documents: DataFrame, benchmark: DataFrame, window: int = 10, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``documents`` without those that hold a window of the benchmark, columns as given."""
    return overlaps(documents, benchmark, window, block_bytes).filter(F.size("_spans") == 0).select("document.*")
