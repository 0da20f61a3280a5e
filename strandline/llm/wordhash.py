"""Vectorised word splitting and 64-bit word hashes over Arrow text columns.

A batch's UTF-8 bytes are classified by a 256-entry table; words are runs of
word bytes inside one text. A word's hash is a polynomial over random byte
values modulo 2**64, from two prefix sums, so that no Python object is made
per word. Work is cut into chunks of about ``CHUNK`` bytes of whole texts,
which bounds memory by the chunk or by the single longest text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

CHUNK = 1 << 19
_U = np.uint64
_rng = np.random.default_rng(0x5EED)
_BYTE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) * _U(2) + _U(1)
_BYTE[65:91] = _BYTE[97:123]  # A-Z count as a-z
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_powers: list[np.ndarray] = [np.ones(1, _U), np.ones(1, _U)]

NOT_SPACE = np.ones(256, bool)
NOT_SPACE[[0x20, *range(0x09, 0x0E)]] = False
ALNUM = np.zeros(256, bool)
ALNUM[0x30:0x3A] = ALNUM[0x41:0x5B] = ALNUM[0x61:0x7B] = ALNUM[0x80:] = True


def _pow(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        m = max(n, 2 * len(_powers[0]), CHUNK + 1)
        for k, base in enumerate((_BASE, _INVERSE)):
            full = np.full(m, base, _U)
            full[0] = 1
            _powers[k] = np.cumprod(full, dtype=_U)
    return _powers[0][:n], _powers[1][:n]


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    h = h ^ (h >> _U(33))
    h = h * _U(0xFF51AFD7ED558CCD)
    h = h ^ (h >> _U(33))
    h = h * _U(0xC4CEB9FE1A85EC53)
    return h ^ (h >> _U(33))


def combine(parts: list[np.ndarray]) -> np.ndarray:
    """Order-sensitive hash of equally long arrays of hashes."""
    h = np.full(len(parts[0]), len(parts), _U)
    for p in parts:
        h = mix(h * _U(0x9FB21C651E98DF25) + p)
    return h


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and text bounds of a string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not pa.types.is_large_string(column.type):
        column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1] if offsets is not None and len(column) else np.zeros(len(column) + 1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def chunks(bounds: np.ndarray, size: int = CHUNK) -> Iterator[tuple[int, int]]:
    """Ranges of whole texts of about ``size`` bytes."""
    a, n = 0, len(bounds) - 1
    while a < n:
        b = max(a + 1, int(np.searchsorted(bounds, bounds[a] + size, "right")) - 1)
        yield a, min(b, n)
        a = min(b, n)


def spans(raw: np.ndarray, bounds: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte starts and ends of all words, and where each text's words begin."""
    bounds = bounds - bounds[0]
    if not len(raw):
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(len(bounds), np.int64)
    word = table[raw]
    before = np.empty(len(raw), bool)
    before[0] = False
    before[1:] = word[:-1]
    after = np.empty(len(raw), bool)
    after[-1] = False
    after[:-1] = word[1:]
    inner = bounds[(bounds > 0) & (bounds < len(raw))]
    before[inner] = False
    after[inner - 1] = False
    starts = np.flatnonzero(word & ~before)
    ends = np.flatnonzero(word & ~after) + 1
    return starts, ends, np.searchsorted(starts, bounds)


def word_hashes(raw: np.ndarray, bounds: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hashes, starts and ends of the words of texts, and text bounds in words."""
    starts, ends, at = spans(raw, bounds, table)
    if not len(starts):
        return np.zeros(0, _U), starts, ends, at
    up, down = _pow(len(raw) + 1)
    sums = np.empty(len(raw) + 1, _U)
    sums[0] = 0
    np.cumsum(_BYTE[raw] * up[: len(raw)], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * down[starts]), starts, ends, at
