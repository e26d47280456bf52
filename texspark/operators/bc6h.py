"""BC6H encoder and half floats, over many blocks at a time.

Endpoints are the most distant texels of a block or subset, on the scale that the decoder
interpolates on; indices are the nearest entries by the sum of absolute differences. Every
candidate is packed and decoded again, and the least squared error of the half-float
magnitudes wins, the first of equals. Modes that store deltas are skipped for blocks whose
deltas don't fit.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from texspark.operators.bptc import BC6H_DIRECT, BC6H_MODES, WEIGHTS, bc6h_fields, decode_bc6h, partitions, unquantised
from texspark.operators.search import encode_batch, least_squares
from texspark.operators.surfaces import block_rasters, encoded_by_block

# Partitions tried by quality level, and the order of the modes with two subsets.
TRIES = {1: 0, 2: 4, 3: 4, 4: 8, 5: 8, 6: 8, 7: 8, 8: 32, 9: 32, 10: 32}
FAST_MODES, ALL_MODES = (9, 5), (9, 5, 0, 1, 2, 3, 4, 6, 7, 8)
ROUNDS = 4
BLOCKS = 512  # that one step handles


def to_half(values: np.ndarray) -> np.ndarray:
    """Single floats to half-float bits, to the nearest, ties to even."""
    with np.errstate(over="ignore"):
        return np.asarray(values, dtype=np.float32).astype(np.float16).view(np.uint16)


def from_half(bits: np.ndarray) -> np.ndarray:
    """Half-float bits to single floats."""
    return np.asarray(bits, dtype=np.uint16).view(np.float16).astype(np.float32)


def scaled(halves: np.ndarray, signed: bool) -> np.ndarray:
    """Half-float bits on the scale that endpoints are interpolated on."""
    h = halves.astype(np.int64)
    if not signed:
        return (h << 6) // 31
    size = ((h & 0x7FFF) << 5) // 31
    return np.where(h & 0x8000, -size, size)


def quantised(v: np.ndarray, bits: int, signed: bool) -> np.ndarray:
    """Endpoints in so many bits."""
    if not signed:
        if bits >= 15:
            return v
        return np.select([v == 0, v == 0xFFFF], [0, (1 << bits) - 1], ((v << bits) - 0x8000) >> 16)
    if bits >= 16:
        return v
    size, top = np.abs(v), (1 << (bits - 1)) - 1
    up = np.where(v == 0x7FFF, top, ((size << (bits - 1)) - 0x4000) >> 15)
    down = -np.where(size == 0x7FFF, top, ((size << (bits - 1)) + 0x4000) >> 15)
    return np.select([v == 0, v > 0], [0, up], down)


def deltas(base: np.ndarray, others: np.ndarray, bits: tuple[int, int, int]) -> tuple[np.ndarray, np.ndarray]:
    """Endpoints (n, ends, 3) as masked differences from a base (n, 3), and which blocks' fit."""
    half = 1 << (np.array(bits) - 1)
    d = others - base[:, None, :]
    fits = (d < half) & (-d <= half)
    return d & (2 * half - 1), fits.all(axis=(1, 2))


def nearest(v: np.ndarray, e0: np.ndarray, e1: np.ndarray, index_bits: int) -> np.ndarray:
    """Each texel's index: the entry with the least sum of absolute differences."""
    kind = np.int32 if max(np.abs(x).max(initial=0) for x in (v, e0, e1)) < 1 << 22 else np.int64
    texels, e0, e1 = (np.ascontiguousarray(x.T, kind) for x in (v, e0, e1))  # blocks side by side are fast to add up
    least, index = None, np.zeros(texels.shape[1:], np.int64)
    for k, weight in enumerate(WEIGHTS[index_bits].tolist()):
        entry = (e0 * (64 - weight) + e1 * weight + 32) >> 6
        distance = sum(np.abs(texel - e) for texel, e in zip(texels, entry, strict=True))
        if least is None:
            least = distance
        else:
            index[distance < least] = k
            np.minimum(least, distance, out=least)
    return index.T


# Pairs of a block's texels.
FIRST, SECOND = np.triu_indices(16, 1)


def distances(v: np.ndarray) -> np.ndarray:
    """Squared distances (n, 120) of the pairs of each block's texels."""
    return sum((v[:, FIRST, c] - v[:, SECOND, c]) ** 2 for c in range(3))


def distant(v: np.ndarray, inside: np.ndarray, distance: np.ndarray | None = None) -> np.ndarray:
    """The two most distant texels (n, 2, 3) inside a subset, the first pair of equals; of a lone one, itself twice. distance: distances(v), if they are known."""
    distance = np.where(inside[:, FIRST] & inside[:, SECOND], distances(v) if distance is None else distance, -1)
    at, rows = distance.argmax(axis=1), np.arange(len(v))
    lone, first = distance[rows, at] < 0, inside.argmax(axis=1)
    return np.stack([v[rows, np.where(lone, first, FIRST[at])], v[rows, np.where(lone, first, SECOND[at])]], axis=1)


def packed(mode: int, ends: np.ndarray, index: np.ndarray, partition: np.ndarray) -> np.ndarray:
    """Blocks of a mode from stored endpoints (n, ends, 3), indices and partitions."""
    code, code_bits, *_ = BC6H_MODES[mode]
    bits = np.zeros((len(ends), 128), np.uint8)
    bits[:, :code_bits] = code >> np.arange(code_bits) & 1
    at = code_bits
    for name, bit in bc6h_fields()[mode]:
        value = partition if name == "P" else ends[:, int(name[1]), "RGB".index(name[0])]
        bits[:, at] = value >> bit & 1
        at += 1
    size = 3 if mode < 10 else 4
    _, anchors = partitions(2 if mode < 10 else 1)
    widths = size - anchors[partition].astype(np.int64)
    places = at + np.cumsum(widths, axis=1) - widths
    rows = np.broadcast_to(np.arange(len(ends))[:, None], places.shape)
    for k in range(size):
        some = k < widths
        bits[rows[some], (places + k)[some]] = (index >> k & 1)[some]
    return np.packbits(bits, axis=1, bitorder="little")


class Search:
    """The best blocks so far of a batch (n, 16, 3) of half-float bits."""

    def __init__(self, halves: np.ndarray, signed: bool):
        self.signed = signed
        self.target = self.magnitudes(halves)
        self.best = np.zeros((len(halves), 16), np.uint8)
        self.error = np.full(len(halves), np.int64(1) << 62)
        self.v = scaled(halves, signed)

    def magnitudes(self, halves: np.ndarray) -> np.ndarray:
        size = halves.astype(np.int64) & 0x7FFF
        return np.where(halves.astype(np.int64) & 0x8000, -size, size) if self.signed else size

    def consider(self, rows: np.ndarray, found: np.ndarray) -> None:
        error = ((self.magnitudes(decode_bc6h(found, self.signed)) - self.target[rows]) ** 2).sum(axis=(1, 2))
        better = error < self.error[rows]
        self.best[rows[better]], self.error[rows[better]] = found[better], error[better]

    def one_subset(self, mode: int, rows: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Try a mode with one subset; returns the indices."""
        width, bits = BC6H_MODES[mode][2:4]
        wide = [unquantised(quantised(ends[:, k], width, self.signed), width, self.signed) for k in (0, 1)]
        index = nearest(self.v[rows], *wide, 4)
        turned = (index[:, 0] >= 8)[:, None]
        wide = [np.where(turned, wide[1], wide[0]), np.where(turned, wide[0], wide[1])]
        index = np.where(turned, nearest(self.v[rows], *wide, 4), index)
        stored = np.stack([quantised(e, width, self.signed) for e in wide], axis=1)
        fits = np.ones(len(rows), dtype=bool)
        if mode not in BC6H_DIRECT:
            narrow, fits = deltas(stored[:, 0], stored[:, 1:], bits)
            _, first_fits = deltas(quantised(ends[:, 0], width, self.signed), quantised(ends[:, 1:], width, self.signed), bits)
            stored, fits = np.concatenate([stored[:, :1], narrow], axis=1), fits & first_fits
        if fits.any():
            self.consider(rows[fits], packed(mode, stored[fits], index[fits], np.zeros(fits.sum(), np.int64)))
        return index

    def two_subsets(self, mode: int, rows: np.ndarray, ends: np.ndarray, partition: np.ndarray) -> None:
        """Try a mode with two subsets and the given partitions."""
        width, bits = BC6H_MODES[mode][2:4]
        subset, anchors = (table[partition] for table in partitions(2))
        first = quantised(ends, width, self.signed)
        fits = np.ones(len(rows), dtype=bool) if mode in BC6H_DIRECT else deltas(first[:, 0], first[:, 1:], bits)[1]
        rows, subset, anchors, partition, first = (x[fits] for x in (rows, subset, anchors, partition, first))
        if not len(rows):
            return
        wide, index = unquantised(first, width, self.signed), np.zeros((len(rows), 16), np.int64)
        for s in (0, 1):
            own, e0, e1 = subset == s, wide[:, 2 * s], wide[:, 2 * s + 1]
            near = nearest(self.v[rows], e0, e1, 3)
            turned = (near[np.arange(len(rows)), (anchors & own).argmax(axis=1)] >= 4)[:, None]
            e0, e1 = np.where(turned, e1, e0), np.where(turned, e0, e1)
            near = np.where(turned, nearest(self.v[rows], e0, e1, 3), near)
            wide[:, 2 * s], wide[:, 2 * s + 1] = e0, e1
            index = np.where(own, near, index)
        stored = quantised(wide, width, self.signed)
        if mode not in BC6H_DIRECT:
            narrow, fits = deltas(stored[:, 0], stored[:, 1:], bits)
            stored = np.concatenate([stored[:, :1], narrow], axis=1)
            rows, stored, index, partition = (x[fits] for x in (rows, stored, index, partition))
        if len(rows):
            self.consider(rows, packed(mode, stored, index, partition))

    def ranked(self, tries: int) -> np.ndarray:
        """The first partitions of each block by the sum of squares around the subsets' means, cut to whole numbers."""
        subset, _ = partitions(2)
        score = np.zeros((len(self.v), 32), np.int64)
        for s in (0, 1):
            inside = (subset[:32] == s).astype(np.int64)
            n = inside.sum(axis=1)
            for c in range(3):
                total, square = self.v[:, :, c] @ inside.T, (self.v[:, :, c] ** 2) @ inside.T
                mean = np.sign(total) * (np.abs(total) // np.maximum(n, 1))
                score += square - 2 * mean * total + n * mean * mean
        return np.argsort(score, axis=1, kind="stable")[:, :tries]


def encode_bc6h(halves: np.ndarray, signed: bool, level: int = 6) -> np.ndarray:
    """BC6H blocks (n, 16) of half-float bits (n, 16 texels, 3)."""
    level = min(10, max(1, level))
    search = Search(halves, signed)
    rows = np.arange(len(halves))
    everything = np.ones((len(halves), 16), dtype=bool)
    distance = distances(search.v)
    ends = distant(search.v, everything, distance)
    index = search.one_subset(10, rows, ends)
    if level >= 4:
        going = rows
        for _ in range(ROUNDS):
            b = WEIGHTS[4][index[going]]
            e0, e1, found = least_squares(64 - b, b, search.v[going], np.full(len(going), 64), clamp=False)
            going, e0, e1 = going[found], e0[found], e1[found]
            if not len(going):
                break
            new = search.one_subset(10, going, np.stack([e0, e1], axis=1))
            moved = (new != index[going]).any(axis=1)
            index[going] = new
            going = going[moved]
            if not len(going):
                break
        for mode in (11, 12, 13):
            search.one_subset(mode, rows, ends)
    if TRIES[level]:
        order = search.ranked(TRIES[level])
        subset, _ = partitions(2)
        for t in range(order.shape[1]):
            partition = order[:, t]
            pair = np.concatenate([distant(search.v, subset[partition] == s, distance) for s in (0, 1)], axis=1)
            for mode in ALL_MODES if level >= 4 else FAST_MODES:
                search.two_subsets(mode, rows, pair, partition)
    return search.best


def encode_hdr_surfaces(surfaces: DataFrame, signed: bool, level: int = 6) -> DataFrame:
    """surfaces (width, height, rgb16: tight half floats, any other columns) with payload instead of rgb16, and format."""
    keep = [c for c in surfaces.columns if c not in ("rgb16", "format", "payload")]
    name = "BC6HS" if signed else "BC6HU"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            payloads = encode_batch(batch, "rgb16", "<u2", 3, lambda some: encode_bc6h(some, signed, level), BLOCKS)
            yield pa.record_batch({c: batch.column(c) for c in keep} | {"format": pa.array([name] * batch.num_rows, pa.string()), "payload": payloads})

    schema = StructType([*(surfaces.schema[c] for c in keep), *StructType.fromDDL("format string, payload binary").fields])
    return surfaces.select(*keep, "rgb16").mapInArrow(run, schema)


def with_halves(texels: DataFrame) -> DataFrame:
    """texels with rgb16, the half-float bits of r, g, b (floats; null counts as 0) in little-endian order, instead of them."""
    keep = [c for c in texels.columns if c not in ("r", "g", "b", "rgb16")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = np.stack([batch.column(c).cast(pa.float32()).fill_null(0).to_numpy(zero_copy_only=False) for c in "rgb"], axis=1)
            raw = pa.py_buffer(to_half(values).astype("<u2").tobytes())
            rgb16 = pa.FixedSizeBinaryArray.from_buffers(pa.binary(6), batch.num_rows, [None, raw]).cast(pa.binary())
            yield pa.record_batch({c: batch.column(c) for c in keep} | {"rgb16": rgb16})

    schema = StructType([*(texels.schema[c] for c in keep), *StructType.fromDDL("rgb16 binary").fields])
    return texels.select(*keep, "r", "g", "b").mapInArrow(run, schema)


def encode_hdr_texels(texels: DataFrame, signed: bool, level: int = 6) -> DataFrame:
    """Surfaces (texture_id, face, mip, width, height, format, payload) of texel rows with r, g, b as floats; one shuffle by 4x4 block."""
    blocks = block_rasters(with_halves(texels), "rgb16", F.col("rgb16"))
    return encoded_by_block(blocks, lambda some: encode_hdr_surfaces(some, signed, level)).withColumn("format", F.lit("BC6HS" if signed else "BC6HU"))
