"""Public byte-level BPE tokenizers inside tasks; their files are named by path, never copied."""

from __future__ import annotations

import base64
from functools import lru_cache

import public_tokenizers

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")


#: Ids of the strings that ``byte_bpe_50k.json`` takes for special tokens wherever they stand in a text.
SPECIAL = {"<|endoftext|>": 50256}


@lru_cache(maxsize=4)
def encoding(ranks_path: str = RANKS):
    """The tokenizer whose ids equal those of ``byte_bpe_50k.json``; built once a worker."""
    import tiktoken

    with open(ranks_path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("granary", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=SPECIAL)


def encode(text: str | None, ranks_path: str = RANKS, special: bool = False) -> list[int]:
    """Ids of a whole text; null is empty.

    With ``special``, strings of special tokens get their one id, as the tokenizer's defaults
    have it; else they are ordinary text.
    """
    if not text:
        return []
    if special:
        return encoding(ranks_path).encode(text, allowed_special="all", disallowed_special=())
    return encoding(ranks_path).encode_ordinary(text)
