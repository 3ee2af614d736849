"""Byte-level BPE of Arrow batches, with a vocabulary file in the public ``.tiktoken`` form."""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import tiktoken

DEFAULT_VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


class Encoder:
    def __init__(self, path: str):
        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.bpe = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.size = max(ranks.values()) + 1
        self.token_bytes = np.zeros(self.size, np.int64)
        self.token_bytes[list(ranks.values())] = [len(x) for x in ranks]

    @property
    def end_of_text(self) -> int:
        """The first free id."""
        return self.size

    def ids(self, text: str | None) -> list[int]:
        return self.bpe.encode_ordinary(text) if text else []


@lru_cache(maxsize=2)
def encoder(path: str = DEFAULT_VOCABULARY) -> Encoder:
    """One for each process and vocabulary file."""
    return Encoder(path)


def encoded(texts: pa.Array, path: str) -> Iterator[np.ndarray]:
    """The ids of each text in turn; none for a null text. One text is held at a time."""
    bpe = encoder(path)
    for x in texts:
        yield np.array(bpe.ids(x.as_py()), np.uint32)
