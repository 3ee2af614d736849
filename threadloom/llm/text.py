"""Vectorised word tokens: one pass over Arrow buffers, no Python object per word.

A word is a maximal run of ASCII letters and digits and of any character beyond ASCII, in
lower case; everything else separates. In regular-expression form, over lower-cased text:
``[a-z0-9\\x{80}-\\x{10FFFF}]+``. A null text has no words.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

WORD_SQL = "[a-z0-9\\x{80}-\\x{10FFFF}]+"
CHUNK_BYTES = 1 << 20

_IS_WORD = np.zeros(256, bool)
_IS_WORD[[*range(48, 58), *range(97, 123), *range(128, 256)]] = True
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_powers = (np.empty(0, np.uint64), np.empty(0, np.uint64))


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _powers
    if len(_powers[0]) < n:
        size = max(n, CHUNK_BYTES + (CHUNK_BYTES >> 2))
        tables = []
        for base in (_BASE, _INVERSE):
            t = np.full(size, base, np.uint64)
            t[0] = 1
            tables.append(np.multiply.accumulate(t))
        if n > 4 * CHUNK_BYTES:
            return tables[0], tables[1]  # one huge text: not kept
        _powers = (tables[0], tables[1])
    return _powers


def mix(x: np.ndarray) -> np.ndarray:
    """SplitMix64 finaliser."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@dataclass
class Tokens:
    """Words of the texts ``lo`` to ``hi`` of a batch. ``off[i]:off[i+1]`` are the words of text i."""

    hash: np.ndarray
    off: np.ndarray
    start: np.ndarray
    end: np.ndarray
    base: np.ndarray
    buf: np.ndarray

    def doc(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.off) - 1), np.diff(self.off))

    def words(self, i: int) -> list[bytes]:
        raw = self.buf.tobytes()
        return [raw[a:b] for a, b in zip(self.start[self.off[i] : self.off[i + 1]], self.end[self.off[i] : self.off[i + 1]])]


def _tokens(texts: pa.Array) -> Tokens:
    kind = pa.large_string()
    lined = pc.binary_join_element_wise(pc.fill_null(pc.utf8_lower(texts.cast(kind)), ""), pa.scalar("", kind), pa.scalar("\n", kind))
    offsets = np.frombuffer(lined.buffers()[1], np.int64)[lined.offset : lined.offset + len(lined) + 1]
    data = lined.buffers()[2]
    buf = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.empty(0, np.uint8)
    base = offsets - offsets[0]
    if not len(buf):
        z = np.empty(0, np.int64)
        return Tokens(np.empty(0, np.uint64), np.zeros(len(base), np.int64), z, z, base, buf)
    step = np.diff(_IS_WORD[buf].view(np.int8), prepend=np.int8(0))
    start, end = np.flatnonzero(step == 1), np.flatnonzero(step == -1)
    up, down = _power_tables(len(buf))
    total = np.empty(len(buf) + 1, np.uint64)
    total[0] = 0
    np.cumsum((buf.astype(np.uint64) + np.uint64(1)) * up[: len(buf)], out=total[1:])
    h = mix((total[end] - total[start]) * down[start])
    return Tokens(h, np.searchsorted(start, base), start, end, base, buf)


def tokens(texts: pa.Array | list[str | None]) -> Tokens:
    """All texts at once; for batches of any size use :func:`token_chunks`."""
    return _tokens(texts if isinstance(texts, (pa.Array, pa.ChunkedArray)) else pa.array(texts, pa.large_string()))


def token_chunks(texts: pa.Array) -> Iterator[tuple[int, int, Tokens]]:
    """Tokens of slices of about CHUNK_BYTES of text, so memory does not follow the batch; a
    longer text is a slice of its own and is taken whole."""
    sizes = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64) + 1)
    lo, n = 0, len(texts)
    while lo < n:
        done = sizes[lo - 1] if lo else 0
        hi = min(n, max(lo + 1, int(np.searchsorted(sizes, done + CHUNK_BYTES, "right"))))
        yield lo, hi, _tokens(texts.slice(lo, hi - lo))
        lo = hi


def gram_hashes(t: Tokens, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all n-word grams and, for each text, where its grams begin and end. A text of
    1 to n-1 words has one gram: all its words."""
    count = np.diff(t.off)
    grams = np.where(count >= n, count - n + 1, np.minimum(count, 1))
    out = np.cumsum(grams)
    off = np.concatenate([[0], out])
    first = np.repeat(t.off[:-1] - off[:-1], grams) + np.arange(off[-1])
    width = np.repeat(np.minimum(count, n), grams)
    h = np.full(len(first), 0x51ED270B9F652295, np.uint64)
    for k in range(n):
        at = first + k
        live = k < width
        word = t.hash[np.minimum(at, max(len(t.hash) - 1, 0))] if len(t.hash) else np.empty(0, np.uint64)
        h = np.where(live, mix(h * np.uint64(0x2545F4914F6CDD1D) + word), h)
    return h, off


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)
