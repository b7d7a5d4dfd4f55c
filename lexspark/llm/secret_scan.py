"""Secrets in texts: fixed patterns, and strings that a language's tokenizer cannot compress.

A vocabulary of frequent pieces covers words with few tokens, also in code and in foreign languages,
while random strings fall apart: few characters per token tell them from words and names. Digests of
known lengths and identifiers are as random but no secrets, so they are excluded before the test.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexspark.llm.spans import Span, digest, free, with_spans
from lexspark.llm.vocabularies import byte_bpe

# The base patterns.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
LEAST = {"assign": 8, "access": 16, "hex": 32}
BASE = ("assign", "access", "hex")
KINDS = (*BASE, "random")

_HEX_RUN = re.compile(r"[0-9a-f]{32,}")  # maximal runs, so the length can stand in the pattern
_CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{16,}")
_IDENTIFIERS = re.compile("|".join((
    r"[0-9A-Fa-f]{8}(?:-[0-9A-Fa-f]{4}){3}-[0-9A-Fa-f]{12}",  # UUID
    r"[0-9A-HJKMNP-TV-Z]{26}",  # ULID
    r"(?:sha\d+|md5)[-_=]?[A-Za-z0-9+/]{20,}={0,2}",  # named digests
    r"[0-9A-Fa-f]{32}|[0-9A-Fa-f]{40}|[0-9A-Fa-f]{56}|[0-9A-Fa-f]{64}|[0-9A-Fa-f]{96}|[0-9A-Fa-f]{128}",  # digests by length
    r"[0-9]+(?:[-_/][0-9]+)*",  # numbers and dates
)))
_PARTS = re.compile(r"[^/=_-]{16,}")
_LONG, _LETTERS_ONLY = 5, 0.9  # a token of whole words; the share of the ratio for strings without a digit


def base_spans(text: str) -> list[Span]:
    """Leftmost non-overlapping matches of each base pattern; those that are too short are dropped."""
    lowered = text.lower()
    out: list[Span] = []
    if any(w in lowered for w in ("pass", "secret", "token", "api")):
        out += [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= LEAST["assign"]]
    if "AKIA" in text:
        out += [("access", m.start(), m.end()) for m in ACCESS.finditer(text) if len(m[0]) >= LEAST["access"]]
    return out + [("hex", m.start(), m.end()) for m in _HEX_RUN.finditer(text)]


def looks_random(text: str, tokens: list[int], ratio: float) -> bool:
    """No known digest or identifier, few characters per token (fewer still without digits), and not mostly long tokens.

    ``tokens`` are the lengths of the tokens of ``text``.
    """
    if _IDENTIFIERS.fullmatch(text) or len(set(text)) < 8:
        return False
    if 2 * sum(n for n in tokens if n >= _LONG) > len(text):
        return False
    return len(text) / len(tokens) < (ratio if re.search("[0-9]", text) else _LETTERS_ONLY * ratio)


def random_spans(text: str, lengths: Callable[[str], list[int]], ratio: float) -> list[Span]:
    """Candidates that look random as a whole, else those of their parts between / = _ - that do."""
    out: list[Span] = []
    for m in _CANDIDATE.finditer(text):
        if _IDENTIFIERS.fullmatch(m[0]):
            continue
        parts = [p for p in _PARTS.finditer(text, m.start(), m.end())]
        if not any(_IDENTIFIERS.fullmatch(p[0]) for p in parts) and looks_random(m[0], lengths(m[0]), ratio):
            out.append(("random", m.start(), m.end()))
        else:
            out += [("random", p.start(), p.end()) for p in parts if looks_random(p[0], lengths(p[0]), ratio)]
    return out


def secrets(documents: DataFrame, ratio: float = 2.2, vocabulary: str | None = None) -> DataFrame:
    """All columns of ``documents`` but text, and ``_spans``: kind, start, end (code points), base or added.

    Candidates for ``random`` are runs of 16 or more characters of keys and encodings, and their parts of that length; those with fewer than ``ratio``
    characters per token of the byte-level vocabulary are added where they touch no base span. Null text counts as
    empty. Repeated rows are judged each for itself; text is read whole, and no other column is looked at.
    """

    def finder():
        encoding = byte_bpe(vocabulary)

        def lengths(text: str) -> list[int]:
            return [len(encoding.decode_single_token_bytes(t)) for t in encoding.encode_ordinary(text)]

        def find(texts: list[str]):
            out = []
            for text in texts:
                base = base_spans(text)
                out.append((base, free(random_spans(text, lengths, ratio), base)))
            return out

        return find

    return with_spans(documents, finder)


def report(documents: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans."""
    texts = documents.select("doc_id", F.col("text").cast("string").alias("text"))
    return digest(secrets(texts), BASE, KINDS)
