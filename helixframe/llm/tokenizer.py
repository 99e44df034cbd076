"""A public byte-level BPE vocabulary, read from a rank file whose path is a parameter."""

from __future__ import annotations

import base64
import functools
import os

import numpy as np

#: Folder of the public vocabularies; a parameter of every operator, or this variable of the environment.
DEFAULT_RANKS = os.path.join(os.environ.get("TOKENIZER_DIR", "/opt/tokenizers"), "byte_bpe_50k.tiktoken")
#: Fixed value: the pattern that splits text before the merges of the rank file.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


class Tokenizer:
    def __init__(self, path: str) -> None:
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self._encoding = tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self._bytes = np.zeros(max(ranks.values()) + 1, np.int64)
        for token, rank in ranks.items():
            self._bytes[rank] = len(token)

    def count(self, text: str) -> int:
        return len(self._encoding.encode_ordinary(text))

    def ends(self, text: str) -> np.ndarray:
        """Byte offset of the end of every token in the UTF-8 form of the text."""
        return np.cumsum(self._bytes[self._encoding.encode_ordinary(text)])


@functools.lru_cache(maxsize=4)
def load(path: str = DEFAULT_RANKS) -> Tokenizer:
    """One tokenizer per Python worker and path."""
    return Tokenizer(path)
