"""Best-fit packing of tokenized documents into sequences, by hierarchical rounds.

Documents are tokenized once, and only sizes and checksums go on. Pieces are spread by hash, so each leaf is a
sample of all lengths, and packed there by best fit in falling order. Nearly full bins are final. Underfull
bins go on as items of their own, and the leaves of a node of the tree are packed together again, until
one node is left. What a leaf hands on is bounded whatever the lengths are: best fit leaves at most one
bin that is half empty, and only such bins can be moved into others, so a few receivers besides it are
enough; all further bins are final too.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexspark.llm.store import saved
from lexspark.llm.vocabularies import byte_bpe, encoded_with_specials, special_tokens
from lexspark.llm.words import slices

LEAF_PIECES, FAN_IN, RECEIVERS = 10_000, 16, 48
_PIECE = "doc_id long, piece int, start long, length long, ids_crc32 long"
_MEMBER = "struct<doc_id:long,piece:int,start:long,length:long,ids_crc32:long,offset:long>"
_BIN = f"node long, final boolean, sequence_id long, fill long, members array<{_MEMBER}>"


def cut_points(n: int, size: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of ``n`` tokens: one, or full ones after a first that may be shorter."""
    if n <= size:
        return [(0, n)]
    head = n % size
    return ([(0, head)] if head else []) + [(at, size) for at in range(head, n, size)]


def pieces(documents: DataFrame, size: int = 2048, vocabulary: str | None = None, end_id: int = 0) -> DataFrame:
    """Per piece: doc_id, piece, start, length and the CRC-32 of its ids as little-endian 32-bit numbers.

    Null text counts as empty; every document ends with ``end_id``. ``vocabulary`` is the path of the
    byte-level BPE's ranks (by default that of the installed public vocabulary). Special tokens of the JSON
    tokenizer inside a text get their own ids, as ``tokenizers`` gives them with add_special_tokens=False.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding, specials = byte_bpe(vocabulary), special_tokens()
        for part in slices(batches):
            out: list[tuple] = []
            for doc, text in zip(part.column("doc_id").to_pylist(), part.column("text").to_pylist()):
                ids = np.append(encoded_with_specials(encoding, text or "", specials), np.uint32(end_id)).astype("<u4")
                out += [(doc, k, start, n, zlib.crc32(ids[start:start + n].tobytes()))
                        for k, (start, n) in enumerate(cut_points(len(ids), size))]
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)],
                                             names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, _PIECE)


def best_fit(fills: list[int], size: int) -> list[list[int]]:
    """Indexes of the items of each bin; ``fills`` fall. The fullest bin that still takes an item gets it."""
    bins: list[list[int]] = []
    by_room: list[list[int]] = [[] for _ in range(size + 1)]
    rooms = 0  # bit r is set if some bin has room r
    for item, fill in enumerate(fills):
        fitting = rooms >> fill
        if fitting:
            room = fill + (fitting & -fitting).bit_length() - 1
            target = by_room[room].pop()
            if not by_room[room]:
                rooms ^= 1 << room
            bins[target].append(item)
        else:
            room, target = size, len(bins)
            bins.append([item])
        by_room[room - fill].append(target)
        rooms |= 1 << (room - fill)
    return bins


def _node(level: int, size: int, last: bool):
    def run(table: pa.Table) -> pa.Table:
        node = table.column("node")[0].as_py()
        items = sorted(zip(table.column("fill").to_pylist(), table.column("members").to_pylist()),
                       key=lambda x: (-x[0], x[1][0]["doc_id"] is None, x[1][0]["doc_id"] or 0, x[1][0]["piece"], x[1][0]["start"]))
        made = []
        for bin_ in best_fit([f for f, _ in items], size):
            members, fill = [], 0
            for k in bin_:
                members += [m | {"offset": m["offset"] + fill} for m in items[k][1]]
                fill += items[k][0]
            made.append((fill, members))
        made.sort(key=lambda x: x[0])
        spare = RECEIVERS
        rows = []
        for k, (fill, members) in enumerate(made):
            goes_on = not last and fill < size - size // 256 and (2 * fill <= size or spare > 0)
            spare -= goes_on and 2 * fill > size
            rows.append({"node": node // FAN_IN, "final": not goes_on, "sequence_id": level << 58 | node << 24 | k,
                         "fill": fill, "members": members})
        return pa.Table.from_pylist(rows, schema=_BIN_ARROW)

    return run


_BIN_ARROW = pa.schema([
    ("node", pa.int64()), ("final", pa.bool_()), ("sequence_id", pa.int64()), ("fill", pa.int64()),
    ("members", pa.list_(pa.struct([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()),
                                    ("ids_crc32", pa.int64()), ("offset", pa.int64())])))])


def pack(cut: DataFrame, size: int = 2048) -> DataFrame:
    """``pieces`` with ``sequence_id`` and ``offset``: gapless sequences of at most ``size`` tokens.

    Each piece lies in exactly one sequence. Ties of equal length go by doc_id, piece and start; repeated rows are
    pieces of their own. An empty table gives an empty result.
    """
    cut = saved(cut, "pieces")
    nodes = 1 + cut.count() // LEAF_PIECES
    member = F.struct("doc_id", "piece", "start", "length", "ids_crc32", F.lit(0).cast("long").alias("offset"))
    bins = cut.select(F.pmod(F.xxhash64("doc_id", "piece"), F.lit(nodes)).alias("node"), F.col("length").alias("fill"),
                      F.array(member.cast(_MEMBER)).alias("members"))
    level, done = 0, None
    while True:
        packed = saved(bins.groupBy("node").applyInArrow(_node(level, size, nodes == 1), _BIN), "bins")
        full = packed.filter("final").select("sequence_id", "members")
        done = full if done is None else done.union(full)
        if nodes == 1:
            break
        nodes, level = -(-nodes // FAN_IN), level + 1
        bins = packed.filter("NOT final").select("node", "fill", "members")
    return done.select("sequence_id", F.inline("members")).select(
        "doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def sequences(documents: DataFrame, size: int = 2048, vocabulary: str | None = None) -> DataFrame:
    """``pack`` of the ``pieces`` of whole documents; needs doc_id and text, ignores other columns."""
    return pack(pieces(documents, size, vocabulary), size)
