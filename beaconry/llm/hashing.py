"""Word and shingle hashes of whole Arrow batches, without a Python loop over words."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

_WHITE = np.zeros(256, bool)
_WHITE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_VALUES = np.random.default_rng(7).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = np.uint64(0x9E3779B97F4A7C15)
PIECE = 1 << 21


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64: every input bit moves every output bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _piece_hashes(raw: np.ndarray) -> np.ndarray:
    word = ~_WHITE[raw]
    edge = np.flatnonzero(np.diff(np.concatenate(([False], word, [False])).view(np.int8)))
    starts, ends = edge[::2], edge[1::2]
    if not len(starts):
        return np.empty(0, np.uint64)
    lengths = ends - starts
    power = np.cumprod(np.full(int(lengths.max()), _BASE, np.uint64))
    letters = _VALUES[_LOWER[raw[word]]]
    first = np.cumsum(lengths) - lengths
    place = np.arange(len(letters)) - np.repeat(first, lengths)
    return mix(np.add.reduceat(letters * power[place], first))


def word_hashes(text: bytes | np.ndarray) -> np.ndarray:
    """One 64-bit hash per word of a text: words are runs of bytes other than ASCII white space, A-Z lower-cased."""
    raw = np.frombuffer(text, np.uint8) if isinstance(text, bytes) else text
    if len(raw) <= PIECE:
        return _piece_hashes(raw)
    out, at = [], 0
    while at < len(raw):
        end = min(len(raw), at + PIECE)
        if end < len(raw):
            gap = np.flatnonzero(_WHITE[raw[end:]][: 1 << 16])
            while not len(gap) and end < len(raw):  # a word longer than the look-ahead stays whole
                end = min(len(raw), end + PIECE)
                gap = np.flatnonzero(_WHITE[raw[end:]][: 1 << 16])
            end = end + int(gap[0]) if len(gap) else len(raw)
        out.append(_piece_hashes(raw[at:end]))
        at = end
    return np.concatenate(out)


def shingle_set(words: np.ndarray, width: int) -> np.ndarray:
    """Sorted distinct hashes of ``width``-word shingles; fewer words make one shingle, no words none."""
    n = len(words)
    if n == 0:
        return np.empty(0, np.uint64)
    span = min(width, n)
    total = np.full(n - span + 1, np.uint64(span), np.uint64)
    with np.errstate(over="ignore"):
        for k in range(span):
            total = total * _BASE + words[k : n - span + 1 + k]
        return np.unique(mix(total))


def texts_of(column: pa.Array) -> list[np.ndarray]:
    """UTF-8 bytes of each text as views into the Arrow buffer; null is empty."""
    column = column.cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(column.buffers()[2] or b"", np.uint8)
    null = column.is_null().to_numpy(zero_copy_only=False) if column.null_count else np.zeros(len(column), bool)
    return [raw[:0] if null[i] else raw[offsets[i] : offsets[i + 1]] for i in range(len(column))]
