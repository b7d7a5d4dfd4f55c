"""Spans of several kinds in a text, their order, digest and Arrow form."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexspark.llm.words import slices

Span = tuple[str, int, int]  # kind, start, end in code points, end exclusive
COLUMN = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.IntegerType()),
                                   T.StructField("end", T.IntegerType()), T.StructField("base", T.BooleanType())]))
_ARROW = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("base", pa.bool_())]))


def written(spans: list[Span], kinds: Sequence[str]) -> str:
    """``kind:start:end`` by start, then by kind as listed, joined by commas."""
    rank = {kind: k for k, kind in enumerate(kinds)}
    return ",".join(f"{k}:{a}:{b}" for k, a, b in sorted(spans, key=lambda s: (s[1], rank[s[0]], s[2])))


def free(spans: list[Span], taken: list[Span]) -> list[Span]:
    """Those of ``spans`` that touch none of ``taken``, nor an earlier one of their own."""
    out, held = [], sorted((a, b) for _, a, b in taken)
    for kind, a, b in sorted(spans, key=lambda s: (s[1], -s[2])):
        if all(b <= x or y <= a for x, y in held):
            out.append((kind, a, b))
            held.append((a, b))
    return out


def with_spans(documents: DataFrame, finder: Callable[[], Callable[[list[str]], list[tuple[list[Span], list[Span]]]]]) -> DataFrame:
    """All columns but text, and ``_spans``. ``finder`` is made once per task; it gets a list of texts
    and returns base and added spans of each."""
    others = [c for c in documents.columns if c != "text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = finder()
        for part in slices(batches):
            found = [[{"kind": k, "start": a, "end": b, "base": x} for x, spans in ((True, base), (False, more)) for k, a, b in spans]
                     for base, more in find([t or "" for t in part.column("text").to_pylist()])]
            yield pa.RecordBatch.from_arrays([part.column(c) for c in others] + [pa.array(found, _ARROW)], names=[*others, "_spans"])

    return documents.mapInArrow(run, documents.drop("text").schema.add("_spans", COLUMN))


def digest(found: DataFrame, base: Sequence[str], kinds: Sequence[str]) -> DataFrame:
    """doc_id, a count for each base kind, base_sha256 and all spans as text."""
    rank = F.create_map(*[F.lit(x) for k, kind in enumerate(kinds) for x in (kind, k)])

    def text(spans):
        keyed = F.transform(spans, lambda s: F.struct(s["start"].alias("start"), rank[s["kind"]].alias("rank"), s["end"].alias("end"), s["kind"].alias("kind")))
        return F.array_join(F.transform(F.array_sort(keyed), lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    def number(kind):
        return F.size(F.filter("_spans", lambda s: s["base"] & (s["kind"] == kind))).cast("long").alias(f"n_{kind}")

    return found.select(
        "doc_id", *[number(kind) for kind in base],
        F.sha2(text(F.filter("_spans", lambda s: s["base"])), 256).alias("base_sha256"), text(F.col("_spans")).alias("spans"))
