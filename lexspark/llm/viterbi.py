"""Token counts under a unigram vocabulary, without building the tokens.

An Aho-Corasick automaton yields every vocabulary piece that ends at a position; dynamic programming carries
the best score and the number of pieces of the best path. Ties follow the tokenizer: a later
candidate replaces an earlier one only if its score is strictly greater, and candidates come by their start, so the
longest last piece wins. A character that no piece covers costs the lowest score less ten and falls back to
one token per byte. Pieces hold the space mark only at their beginning (this is checked), so a text falls
apart before each space that follows another character; equal parts are scored once per batch and kept
in a bounded cache that never changes a result.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexspark.llm.words import buffers, byte_hashes, slices

MARK = "▁"
CACHED_PARTS = 500_000


class UnigramCounter:
    """Best score and number of tokens of a string under (piece, score) pairs."""

    def __init__(self, pieces: list[tuple[str, float]], unknown_score: float):
        import ahocorasick

        if any(MARK in piece.lstrip(MARK) for piece, _ in pieces):
            raise ValueError("a piece has a space mark inside")
        self.unknown, self.automaton = unknown_score, ahocorasick.Automaton()
        for piece, score in pieces:
            self.automaton.add_word(piece, (len(piece), score))
        if pieces:
            self.automaton.make_automaton()
        self.single = {piece for piece, _ in pieces if len(piece) == 1}

    def count(self, text: str) -> tuple[float, int]:
        n = len(text)
        score, tokens = [0.0] + [None] * n, [0] * (n + 1)
        at = 1

        def close(end: int) -> None:
            """Fallback for the character before ``end``; it starts last, so it must be strictly better."""
            char = text[end - 1]
            if char not in self.single:
                other = score[end - 1] + self.unknown
                if score[end] is None or other > score[end]:
                    score[end], tokens[end] = other, tokens[end - 1] + len(char.encode())

        if len(self.automaton):
            for last, (size, value) in self.automaton.iter(text):  # longest piece of each end first
                end = last + 1
                while at < end:
                    close(at)
                    at += 1
                other = score[end - size] + value
                if score[end] is None or other > score[end]:
                    score[end], tokens[end] = other, tokens[end - size] + 1
        while at <= n:
            close(at)
            at += 1
        return score[n], tokens[n]


@functools.lru_cache(maxsize=2)
def piece_counter(path: str | None = None) -> UnigramCounter:
    """The normal pieces of a public vocabulary with their scores."""
    import public_tokenizers
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path or public_tokenizers.path("piece_bpe_32k.model"))
    ids = range(model.get_piece_size())
    normal = [i for i in ids if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]
    return UnigramCounter([(model.id_to_piece(i), model.get_score(i)) for i in normal], min(model.get_score(i) for i in normal) - 10.0)


def parts_of(offsets: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and first part of each text: cut before spaces that follow something else."""
    space = data == 32
    begins = space.copy()
    begins[1:] &= ~space[:-1]
    full = offsets[:-1] < offsets[1:]
    begins[offsets[:-1][full]] = True
    starts = np.flatnonzero(begins)
    return starts, np.append(starts[1:], len(data)), np.searchsorted(starts, offsets)


def token_counts(documents: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """All columns of ``documents`` but text, and ``_tokens`` (long), the tokens of the whole text.

    A space mark is put in front of the text and for every space; nothing else is normalized. Null and empty
    texts have no tokens. Repeated rows are counted each for itself.
    """
    others = [c for c in documents.columns if c != "text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter, known = piece_counter(vocabulary), {}
        for part in slices(batches):
            raw, data = buffers(part.column("text"))
            sizes = np.diff(raw)
            marked = np.insert(data, raw[:-1][sizes > 0], 32)  # the mark in front of each text
            offsets = np.concatenate([[0], np.cumsum(sizes + (sizes > 0))])
            starts, ends, first = parts_of(offsets, marked)
            totals = np.zeros(len(sizes) + 1, dtype=np.int64)
            if len(starts):
                hashes = byte_hashes(marked, starts, ends)
                distinct, where, back = np.unique(hashes, return_index=True, return_inverse=True)
                if len(known) > CACHED_PARTS:
                    known.clear()
                held, counts = marked.tobytes(), np.empty(len(distinct), dtype=np.int64)
                for k, (value, begin, end) in enumerate(zip(distinct.tolist(), starts[where].tolist(), ends[where].tolist())):
                    n = known.get(value)
                    if n is None:
                        n = known[value] = counter.count(held[begin:end].decode().replace(" ", MARK))[1]
                    counts[k] = n
                sums = np.concatenate([[0], np.cumsum(counts[back])])
                totals = sums[first]
            yield pa.RecordBatch.from_arrays([part.column(c) for c in others] + [pa.array(np.diff(totals), pa.int64())], names=[*others, "_tokens"])

    return documents.mapInArrow(run, documents.drop("text").schema.add("_tokens", "long"))


def report(documents: DataFrame) -> DataFrame:
    """doc_id, n_chars (code points; 0 for null) and n_tokens of every row."""
    texts = documents.select("doc_id", F.coalesce(F.length("text"), F.lit(0)).cast("long").alias("n_chars"), F.col("text").cast("string").alias("text"))
    return token_counts(texts).withColumnRenamed("_tokens", "n_tokens")
