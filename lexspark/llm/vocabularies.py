"""Vocabularies of public tokenizers. They are read where the task runs, never trained or copied."""

from __future__ import annotations

import base64
import functools
import re

import numpy as np

#: A space between two visible ASCII characters always begins a new pre-token.
_SAFE = re.compile(r"(?<=[!-~])(?= [!-~])")
_LONG = 100_000


@functools.lru_cache(maxsize=2)
def byte_bpe(path: str | None = None):
    """Byte-level BPE with ids of the ``byte_bpe_50k`` vocabulary, from its ranks."""
    import public_tokenizers
    import tiktoken

    with open(path or public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    return tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def encoded(encoding, text: str) -> np.ndarray:
    """Ids of a whole text. Long ones are given in parts, cut only where a pre-token begins anyway."""
    if len(text) <= _LONG:
        return np.array(encoding.encode_ordinary(text), dtype=np.uint32)
    parts, at = [], 0
    while at < len(text):
        cut = _SAFE.search(text, at + _LONG)
        end = cut.start() if cut else len(text)
        parts.append(np.array(encoding.encode_ordinary(text[at:end]), dtype=np.uint32))
        at = end
    return np.concatenate(parts)


def special_tokens(path: str | None = None) -> dict[str, int]:
    """The added special tokens of the JSON tokenizer: content -> id."""
    import json

    import public_tokenizers

    with open(path or public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as source:
        return {t["content"]: t["id"] for t in json.load(source).get("added_tokens", []) if t.get("special")}


def encoded_with_specials(encoding, text: str, specials: dict[str, int]) -> np.ndarray:
    """Ids as the JSON tokenizer gives them: special tokens in the text are found first and keep their ids."""
    if not specials or not any(s in text for s in specials):
        return encoded(encoding, text)
    import re

    parts, at = [], 0
    for found in re.finditer("|".join(re.escape(s) for s in sorted(specials, key=len, reverse=True)), text):
        parts.append(encoded(encoding, text[at:found.start()]))
        parts.append(np.array([specials[found.group(0)]], dtype=np.uint32))
        at = found.end()
    parts.append(encoded(encoding, text[at:]))
    return np.concatenate(parts)
