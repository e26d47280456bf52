"""Vectorised word shingles: 64-bit hashes of a batch of texts, from its Arrow buffers."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

U = np.uint64
_ODD = 0x9E3779B97F4A7C15
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BLANK = np.zeros(256, dtype=bool)
_BLANK[[32, *range(9, 14)]] = True


def mixed(x: np.ndarray) -> np.ndarray:
    """Finalise 64-bit values (the splitmix64 finaliser)."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


_BYTE = mixed((np.arange(1, 257, dtype=U)) * U(_ODD))


_tables: list[tuple[np.ndarray, np.ndarray]] = []


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The odd base's powers, and those of its inverse, n of them at least; only the longest tables are kept."""
    if not _tables or len(_tables[0][0]) < n:
        size = max(1 << 19, 1 << (n - 1).bit_length())
        with np.errstate(over="ignore"):
            up, down = np.full(size, _ODD, dtype=U), np.full(size, pow(_ODD, -1, 1 << 64), dtype=U)
            up[0] = down[0] = 1
            _tables[:] = [(np.multiply.accumulate(up), np.multiply.accumulate(down))]
    return _tables[0]


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The column's UTF-8 bytes, and where each text begins in them (one entry more); null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    _, offsets, data = column.buffers()
    begins = np.frombuffer(offsets, dtype=kind)[column.offset : column.offset + len(column) + 1].astype(np.int64) if len(column) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, dtype=np.uint8)[begins[0] : begins[-1]] if data is not None and begins[-1] > begins[0] else np.zeros(0, np.uint8)
    return raw, begins - begins[0]


def word_spans(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The column's bytes with A-Z in lower case, each word's [^\x20\x09-\x0D]+ begin and end, and each text's first word."""
    raw, begins = text_bytes(column)
    if not len(raw):
        return raw, np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(begins), np.int64)
    solid = ~_BLANK[raw]
    edge = np.zeros(len(raw) + 1, dtype=bool)
    edge[begins] = True
    starts = solid.copy()
    starts[1:] &= ~solid[:-1] | edge[1:-1]
    ends = solid.copy()
    ends[:-1] &= ~solid[1:] | edge[1:-1]
    first, last = np.flatnonzero(starts), np.flatnonzero(ends) + 1
    return _LOWER[raw], first, last, np.searchsorted(first, begins)


def hashed(lower: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """A hash of each word."""
    up, down = _powers(len(lower) + 1)
    with np.errstate(over="ignore"):
        total = np.zeros(len(lower) + 1, dtype=U)
        np.cumsum(_BYTE[lower] * up[: len(lower)], out=total[1:])
        return mixed((total[last] - total[first]) * down[first] + (last - first).astype(U) * U(0xD6E8FEB86659FD93))


def word_hashes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """A hash of each word of the column, and each text's first word."""
    lower, first, last, begins = word_spans(column)
    return hashed(lower, first, last), begins


def folded(parts: list[np.ndarray]) -> np.ndarray:
    """One hash for each sequence of hashes."""
    with np.errstate(over="ignore"):
        out = parts[0]
        for part in parts[1:]:
            out = (out ^ (out >> U(29))) * U(0xFF51AFD7ED558CCD) + part
        return mixed(out)


def shingle_sets(column: pa.Array, size: int = 5) -> list[np.ndarray]:
    """The sorted distinct shingles of each text; with fewer words, the whole sequence is one."""
    words, begins = word_hashes(column)
    rolled = folded([words[k : len(words) - size + 1 + k] for k in range(size)]) if len(words) >= size else words[:0]
    out = []
    for a, b in zip(begins[:-1].tolist(), begins[1:].tolist(), strict=True):
        if b - a >= size:
            out.append(np.unique(rolled[a : b - size + 1]))
        elif b > a:
            out.append(folded([np.array([b - a], dtype=U), *(words[k : k + 1] for k in range(a, b))]))
        else:
            out.append(words[:0])
    return out
