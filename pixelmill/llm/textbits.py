"""Words and shingles of many texts as 64-bit hashes, computed with numpy on the texts' UTF-8 bytes.

A word is a maximal run of bytes that a separator table does not name.  All of UTF-8's bytes of characters beyond ASCII
are 0x80 or more, so a table of ASCII separators cuts code points nowhere.  A word's hash is a polynomial in random
64-bit values of its bytes, mixed; it depends on the word alone.  Two different words or shingles agree with a
probability of about 2**-60.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401

U = np.uint64
SPACES = b"\x20\x09\x0a\x0b\x0c\x0d"
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values whose bits depend on all bits of its input."""
    x = (x ^ (x >> U(32))) * U(0xD6E8FEB86659FD93)
    x = (x ^ (x >> U(32))) * U(0xD6E8FEB86659FD93)
    return x ^ (x >> U(32))


def _random(seed: int, n: int) -> np.ndarray:
    return np.random.Generator(np.random.PCG64(seed)).integers(1, 1 << 63, n, dtype=np.uint64) * U(2) + U(1)


_BYTE = _random(20240, 256)
_BYTE_LOWER = _BYTE.copy()
_BYTE_LOWER[65:91] = _BYTE[97:123]
_PLACE = _random(20241, 64)
_POWERS: list[np.ndarray] = []


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _POWERS or len(_POWERS[0]) < n:
        size = max(n, 1 << 16)
        _POWERS[:] = [np.multiply.accumulate(np.concatenate([np.ones(1, U), np.full(size - 1, x, U)])) for x in (_BASE, _INVERSE)]
    return _POWERS[0], _POWERS[1]


def separators(chars: bytes) -> np.ndarray:
    """A table of 256 flags."""
    table = np.zeros(256, bool)
    table[list(chars)] = True
    return table


WHITE = separators(SPACES)


def raw(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and the n + 1 places where its texts begin and end; a null is an empty text."""
    if column.null_count:
        column = pa.compute.fill_null(column, "")
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    _, places, data = column.buffers()
    n = len(column)
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offs = np.frombuffer(places, kind, count=n + 1, offset=column.offset * np.dtype(kind).itemsize).astype(np.int64)
    end, start = int(offs[-1]), int(offs[0])
    body = np.frombuffer(data, np.uint8, count=end)[start:] if data is not None and end > start else np.zeros(0, np.uint8)
    return body, offs - start


def words(data: np.ndarray, offs: np.ndarray, sep: np.ndarray = WHITE, lower: bool = True, block: int = 1 << 20) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hash, first and end byte of each word, and for each text the number of words before it (n + 1 entries).

    Works in blocks of bytes cut where words end, so memory beyond the result stays bounded whatever a text's length.
    """
    n = len(data)
    if not n:
        z = np.zeros(0, np.int64)
        return np.zeros(0, U), z, z, np.zeros(len(offs), np.int64)
    inside = ~sep[data]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    edges = offs[(offs > 0) & (offs < n)]
    first[edges] = inside[edges]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    last[edges - 1] = inside[edges - 1]
    s, e = np.flatnonzero(first), np.flatnonzero(last) + 1
    out = np.empty(len(s), U)
    table = _BYTE_LOWER if lower else _BYTE
    i = 0
    while i < len(s):
        j = max(i + 1, int(np.searchsorted(e, s[i] + block, "right")))
        lo, hi = int(s[i]), int(e[j - 1])
        up, down = _powers(hi - lo + 1)
        total = np.zeros(hi - lo + 1, U)
        np.cumsum(table[data[lo:hi]] * up[: hi - lo], out=total[1:])
        a, b = s[i:j] - lo, e[i:j] - lo
        out[i:j] = mix((total[b] - total[a]) * down[a])
        i = j
    return out, s, e, np.searchsorted(s, offs)


def shingles(h: np.ndarray, upto: np.ndarray, k: int) -> list[np.ndarray]:
    """For each text the hashes of its k-word shingles in order; of fewer words, one hash of the whole sequence; of none, none."""
    parts, first = windows(h, k), upto[:-1]
    out = []
    for a, b in zip(first.tolist(), upto[1:].tolist(), strict=True):
        if b - a >= k:
            out.append(parts[a : b - k + 1])
        elif b > a:
            out.append(windows(h[a:b], b - a)[:1])
        else:
            out.append(parts[:0])
    return out


def windows(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of h[i : i + k] for each i; it depends on k too."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, U)
    total = np.full(n, U(k))
    for j in range(k):
        total += h[j : j + n] * _PLACE[j]
    return mix(total)
