"""Fill-in-the-middle over a piece table, as column expressions only.

A document is never copied while it is cut: it becomes a list of descriptors ``(buffer, start, length)``
over two immutable buffers, the text itself (buffer 0) and the sentinel buffer ``<P><S><M>`` (buffer 1).
Cutting splits the one descriptor of the text into prefix, middle and suffix; an arrangement is a
permutation of descriptors with sentinel descriptors between them; the output is the descriptors read
in order. Restoring parses the output back into descriptors over the output buffer and applies the
inverse permutation, so that the round trip is checked on every row.

Units are the matches of ``[\\x20\\x09-\\x0D]*[^\\x20\\x09-\\x0D]+|[\\x20\\x09-\\x0D]+`` from left to right: they tile
the text, so the cut after ``k`` units is the sum of their lengths in code points.

Defined cases: a null text is empty (n = 0, form ``plain``). A null doc_id has no keys and is ``plain``.
Texts holding a sentinel stay ``plain``, so the sentinels of an output are always unambiguous. Repeated
rows give repeated, equal result rows. Callers' columns are kept unless they bear a result name, which
this module then replaces.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed values of the contract: sentinels, seed prefix and unit pattern.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
SEED = "42:"
UNIT = r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+"
PLAIN_SHARE, SPM_SHARE = 50, 80  # per cent: h3 % 100 >= 50 keeps a text plain; h4 % 100 < 80 gives spm

SENTINELS = PREFIX + SUFFIX + MIDDLE
_TEXT, _SENTINEL = 0, 1
_RESULTS = ("n", "form", "prefix_chars", "middle_chars", "pieces", "output", "restored")


def _key(doc_id: Column, i: int) -> Column:
    """The i-th 8-digit group (from 1) of sha256('42:' || doc_id), read as an unsigned number."""
    digest = F.sha2(F.concat(F.lit(SEED), doc_id.cast("string")), 256)
    return F.conv(F.substring(digest, 8 * i - 7, 8), 16, 10).cast("long")


def _piece(buffer: int | Column, start: Column | int, length: Column | int) -> Column:
    return F.struct(F.lit(buffer).alias("buffer") if isinstance(buffer, int) else buffer.alias("buffer"),
                    (F.lit(start) if isinstance(start, int) else start).cast("long").alias("start"),
                    (F.lit(length) if isinstance(length, int) else length).cast("long").alias("length"))


def _sentinel(which: str) -> Column:
    return _piece(_SENTINEL, SENTINELS.index(which), len(which))


def arranged(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """``docs`` with n, form, prefix_chars, middle_chars and ``pieces``, the descriptors of the output."""
    body = F.coalesce(F.col(text), F.lit(""))
    lengths = F.transform(F.regexp_extract_all(body, F.lit(f"({UNIT})"), 1), lambda u: F.length(u).cast("long"))
    n = F.size(lengths).cast("long")
    held = F.greatest(*(F.col(text).contains(s) for s in (PREFIX, SUFFIX, MIDDLE)))
    h1, h2, h3, h4 = (_key(F.col(doc_id), i) for i in range(1, 5))
    plain = F.col(doc_id).isNull() | (n == 0) | F.coalesce(held, F.lit(False)) | (h3 % 100 >= PLAIN_SHARE)
    form = F.when(plain, "plain").when(h4 % 100 < SPM_SHARE, "spm").otherwise("psm")
    cut = lambda k: F.aggregate(F.slice(F.col("_fim_lengths"), 1, F.col(k).cast("int")), F.lit(0).cast("long"), lambda a, x: a + x)
    out = (docs.drop(*_RESULTS)
           .withColumn("_fim_lengths", lengths)
           .withColumn("n", n)
           .withColumn("form", form)
           .withColumn("_fim_a", F.least(h1 % (F.col("n") + 1), h2 % (F.col("n") + 1)))
           .withColumn("_fim_b", F.greatest(h1 % (F.col("n") + 1), h2 % (F.col("n") + 1)))
           .withColumn("_fim_i", cut("_fim_a"))
           .withColumn("_fim_j", cut("_fim_b"))
           .withColumn("_fim_all", F.length(body).cast("long")))
    prefix = _piece(_TEXT, F.lit(0), F.col("_fim_i"))
    middle = _piece(_TEXT, F.col("_fim_i"), F.col("_fim_j") - F.col("_fim_i"))
    suffix = _piece(_TEXT, F.col("_fim_j"), F.col("_fim_all") - F.col("_fim_j"))
    pieces = (F.when(F.col("form") == "psm", F.array(_sentinel(PREFIX), prefix, _sentinel(SUFFIX), suffix, _sentinel(MIDDLE), middle))
              .when(F.col("form") == "spm", F.array(_sentinel(SUFFIX), suffix, _sentinel(PREFIX), prefix, _sentinel(MIDDLE), middle))
              .otherwise(F.array(_piece(_TEXT, F.lit(0), F.col("_fim_all")))))
    return (out.withColumn("pieces", pieces)
            .withColumn("prefix_chars", F.when(F.col("form") != "plain", F.col("_fim_i")))
            .withColumn("middle_chars", F.when(F.col("form") != "plain", F.col("_fim_j") - F.col("_fim_i")))
            .drop("_fim_lengths", "_fim_a", "_fim_b", "_fim_i", "_fim_j", "_fim_all"))


def read(pieces: Column, text: Column, buffers: Column | None = None) -> Column:
    """The string that ``pieces`` describe: buffer 0 is ``text``, buffer 1 the sentinels."""
    sentinels = F.lit(SENTINELS) if buffers is None else buffers
    return F.array_join(F.transform(pieces, lambda p: F.when(p["length"] == 0, F.lit("")).otherwise(F.substring(
        F.when(p["buffer"] == _TEXT, text).otherwise(sentinels), (p["start"] + 1).cast("int"), p["length"].cast("int")))), "")


def restored(output: Column, form: Column) -> Column:
    """The text rebuilt from an output alone: its sentinels cut it into descriptors, the inverse permutation orders them."""
    at = lambda s: F.instr(output, s).cast("long") - 1
    size = F.length(output).cast("long")
    p, s, m = at(PREFIX), at(SUFFIX), at(MIDDLE)
    # descriptors over the output buffer (buffer 0 here); for psm the order read is P, S, M, for spm S, P, M
    prefix = _piece(_TEXT, p + 3, F.when(form == "psm", s - p - 3).otherwise(m - p - 3))
    suffix = _piece(_TEXT, s + 3, F.when(form == "psm", m - s - 3).otherwise(p - s - 3))
    middle = _piece(_TEXT, m + 3, size - m - 3)
    inverse = F.when(form == "plain", F.array(_piece(_TEXT, F.lit(0), size))).otherwise(F.array(prefix, middle, suffix))
    return read(inverse, output)


def transformed(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """``arranged`` plus ``output``, the transformed text, and ``restored``, the text rebuilt from it."""
    out = arranged(docs, text, doc_id)
    out = out.withColumn("output", read(F.col("pieces"), F.coalesce(F.col(text), F.lit(""))))
    return out.withColumn("restored", restored(F.col("output"), F.col("form")))


def report(docs: DataFrame) -> DataFrame:
    """The contract's digest of every document."""
    done = transformed(docs.select("doc_id", "text"))
    return done.select("doc_id", "n", "form", "prefix_chars", "middle_chars",
                       F.sha2(F.col("output"), 256).alias("output_sha256"), F.sha2(F.col("restored"), 256).alias("restored_sha256"))
