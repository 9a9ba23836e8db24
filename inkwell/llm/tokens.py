"""Token ids of the byte-level BPE vocabulary.

The ids equal ``tokenizers.Tokenizer.from_file(path).encode(text,
add_special_tokens=False).ids``; tests compare the two. The encoder used here
reads the same vocabulary as merge ranks and is several times faster.
"""

from __future__ import annotations

import base64
import json
from functools import lru_cache

import numpy as np
import public_tokenizers
import tiktoken

END_OF_TEXT = "<|endoftext|>"
VOCABULARY, RANKS = "byte_bpe_50k.json", "byte_bpe_50k.tiktoken"


class Encoder:
    """Maps a text to its ids (unsigned 32 bit)."""

    # once per Python worker, not per task
    @classmethod
    @lru_cache(maxsize=1)
    def load(cls, vocabulary: str, ranks: str) -> Encoder:
        return cls(vocabulary, ranks)

    def __init__(self, vocabulary: str, ranks: str):
        with open(ranks, "rb") as f:
            table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        with open(vocabulary, encoding="utf-8") as f:
            added = {t["content"]: t["id"] for t in json.load(f)["added_tokens"]}
        # the vocabulary file's special token is one id wherever it stands in a text
        self.end = added[END_OF_TEXT]
        self.bpe = tiktoken.Encoding("byte_bpe", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens={END_OF_TEXT: self.end})

    def ids(self, text: str) -> np.ndarray:
        return self.bpe.encode_to_numpy(text, allowed_special="all")


def default_paths() -> tuple[str, str]:
    return public_tokenizers.path(VOCABULARY), public_tokenizers.path(RANKS)
