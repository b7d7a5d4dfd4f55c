"""Texts to vectors in small batches, through a function given by the caller."""

from __future__ import annotations

import hashlib
import re
import time
from collections.abc import Callable, Iterator, Sequence
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexspark.functions import fixed
from lexspark.operators.changes import snapshot_diff

DIMENSION = 64
_ROWS_AT_ONCE = 256
Embedder = Callable[[Sequence[str]], Sequence[Sequence[float]]]
_WORD = re.compile(r"[^\W_]+")


class RateLimited(Exception):
    """Raised by an embedder that asks the caller to wait."""


@lru_cache(maxsize=200_000)
def _bucket(word: str, dimension: int) -> int:
    return int(hashlib.md5(word.encode()).hexdigest()[:8], 16) % dimension


def hashed_counts(dimension: int = DIMENSION) -> Embedder:
    """Default embedder: counts of hashed words, scaled to unit length (zero if there is no word)."""

    def embed(texts: Sequence[str]) -> list[np.ndarray]:
        vectors = []
        for text in texts:
            buckets = [_bucket(word, dimension) for word in _WORD.findall(text.lower())]
            counts = np.bincount(buckets, minlength=dimension).astype("float64") if buckets else np.zeros(dimension)
            vectors.append(counts / (np.sqrt((counts * counts).sum()) or 1.0))
        return vectors

    return embed


def _attempt(embedder: Embedder, texts: Sequence[str], tries: int, wait: float, pause: Callable[[float], None]):
    """Vectors of one batch, or the reason why there are none."""
    reason = "no attempt"
    for turn in range(1, tries + 1):
        try:
            vectors = embedder(texts)
        except RateLimited as error:
            reason = f"rate limited: {error}"
            pause(wait * turn)
        except Exception as error:  # any failure of the caller's function is a failed batch, not a failed job
            reason = f"{type(error).__name__}: {error}"
            if turn < tries:
                pause(wait)
        else:
            if vectors is not None and len(vectors) == len(texts):
                return vectors, None
            return None, "the number of vectors differs from the number of texts"
    return None, reason


def embed(df: DataFrame, text: str = "chunk_text", embedder: Embedder | None = None, *,
          batch_size: int = fixed.EMBED_BATCH, tries: int = fixed.EMBED_TRIES, wait: float = 5.0,
          column: str = "embedding", pause: Callable[[float], None] = time.sleep) -> DataFrame:
    """Add ``embedding``, ``embed_status`` (ok / failed) and ``embed_error`` to every row.

    Each batch is tried up to ``tries`` times; a rate limit makes it wait 1, 2, 3 ... times
    ``wait`` seconds. Rows of a failed batch stay, with a NULL vector and the reason.
    """
    function = embedder or hashed_counts()

    step = batch_size * -(-_ROWS_AT_ONCE // batch_size)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, step):  # only these rows become Python objects at a time
                rows = batch.slice(start, step)
                texts = ["" if t is None else t for t in rows.column(rows.schema.get_field_index(text)).to_pylist()]
                vectors: list = []
                errors: list = []
                for low in range(0, len(texts), batch_size):
                    part = texts[low:low + batch_size]
                    got, error = _attempt(function, part, tries, wait, pause)
                    vectors += list(got) if got is not None else [None] * len(part)
                    errors += [error] * len(part)
                added = {column: pa.array(vectors, pa.list_(pa.float64())),
                         "embed_status": pa.array(["ok" if e is None else "failed" for e in errors], pa.string()),
                         "embed_error": pa.array(errors, pa.string())}
                yield pa.RecordBatch.from_arrays([*rows.columns, *added.values()], names=[*rows.schema.names, *added])

    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
    return df.mapInArrow(run, f"{columns}, {column} array<double>, embed_status string, embed_error string")


def embedded(df: DataFrame) -> DataFrame:
    """The rows that got a vector."""
    return df.where(F.col("embed_status") == "ok").drop("embed_status", "embed_error")


def failures(df: DataFrame, key: str = "chunk_id") -> DataFrame:
    """(key, embed_error) of the rows that did not."""
    return df.where(F.col("embed_status") != "ok").select(key, "embed_error")


def status_counts(df: DataFrame) -> DataFrame:
    """Rows per status and error."""
    return df.groupBy("embed_status", "embed_error").agg(F.count("*").alias("row_count"))


def embed_incremental(old_vectors: DataFrame, old_chunks: DataFrame, new_chunks: DataFrame,
                      embedder: Embedder | None = None, key: str = "chunk_id", text: str = "chunk_text",
                      **options) -> DataFrame:
    """Vectors of the new snapshot: inserted and changed chunks, and those without a vector, are embedded.

    ``embed_status`` and ``embed_error`` tell which of them failed; these stay with a NULL vector and are
    tried again by the next run, since ``old_vectors`` counts only rows that have one.
    """
    changes = snapshot_diff(old_chunks, new_chunks, key)
    held = old_vectors.where(F.col("embedding").isNotNull()).drop("embed_status", "embed_error", "origin")
    kept = held.join(changes.select(key), key, "left_anti").join(new_chunks.select(key), key, "left_semi")
    fresh = embed(new_chunks.join(kept.select(key), key, "left_anti"), text, embedder, **options)
    return (
        kept.withColumns({"embed_status": F.lit("ok"), "embed_error": F.lit(None).cast("string"), "origin": F.lit("kept")})
        .unionByName(fresh.withColumn("origin", F.lit("embedded")), allowMissingColumns=True)
    )


def text_similarity(df: DataFrame, question: str, parts: Sequence[str], embedder: Embedder | None = None,
                    column: str = "similarity_score") -> DataFrame:
    """Cosine of a fixed question and each row's joined text columns, rounded to 4 digits."""
    function = embedder or hashed_counts()
    target = [float(x) for x in function([question])[0]]

    @F.pandas_udf("double")
    def cosine(texts: pd.Series) -> pd.Series:
        matrix = np.stack([np.asarray(v, dtype="float64") for v in function(texts.fillna("").tolist())])
        against = np.asarray(target)
        lengths = np.sqrt((matrix * matrix).sum(1)) * (np.sqrt((against * against).sum()) or 1.0)
        return pd.Series(np.round((matrix @ against) / np.where(lengths == 0, 1.0, lengths), 4))

    return df.withColumn(column, cosine(F.concat_ws(" ", *parts)))
