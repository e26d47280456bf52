"""BC7 and BC6H blocks, decoded many at a time with NumPy from their bits.

Layouts follow the public BPTC specification: fields are read from the least significant
bit of a 128-bit little-endian word.
"""

from __future__ import annotations

import functools
import re

import numpy as np

# The subset of each texel for every partition of the BPTC formats.
TWO_SUBSETS = """
0011001100110011 0001000100010001 0111011101110111 0001001100110111 0000000100010011 0011011101111111 0001001101111111 0000000100110111
0000000000010011 0011011111111111 0000000101111111 0000000000010111 0001011111111111 0000000011111111 0000111111111111 0000000000001111
0000100011101111 0111000100000000 0000000010001110 0111001100010000 0011000100000000 0000100011001110 0000000010001100 0111001100110001
0011000100010000 0000100010001100 0110011001100110 0011011001101100 0001011111101000 0000111111110000 0111000110001110 0011100110011100
0101010101010101 0000111100001111 0101101001011010 0011001111001100 0011110000111100 0101010110101010 0110100101101001 0101101010100101
0111001111001110 0001001111001000 0011001001001100 0011101111011100 0110100110010110 0011110011000011 0110011010011001 0000011001100000
0100111001000000 0010011100100000 0000001001110010 0000010011100100 0110110010010011 0011011011001001 0110001110011100 0011100111000110
0110110011001001 0110001100111001 0111111010000001 0001100011100111 0000111100110011 0011001111110000 0010001011101110 0100010001110111
""".split()
THREE_SUBSETS = """
0011001102212222 0001001122112221 0000200122112211 0222002200110111 0000000011221122 0011001100220022 0022002211111111 0011001122112211
0000000011112222 0000111111112222 0000111122222222 0012001200120012 0112011201120112 0122012201220122 0011011211221222 0011200122002220
0001001101121122 0111001120012200 0000112211221122 0022002200221111 0111011102220222 0001000122212221 0000001101220122 0000110022102210
0122012200110000 0012001211222222 0110122112210110 0000011012211221 0022110211020022 0110011020022222 0011012201220011 0000200022112221
0000000211221222 0222002200120011 0011001200220222 0120012001200120 0000111122220000 0120120120120120 0120201212010120 0011220011220011
0011112222000011 0101010122222222 0000000021212121 0022112200221122 0022001100220011 0220122102201221 0101222222220101 0000212121212121
0101010101012222 0222011102220111 0002111200021112 0000211221122112 0222011101110222 0002111211120002 0110011001102222 0000000021122112
0110011022222222 0022001100110022 0022112211220022 0000000000002112 0002000100020001 0222122202221222 0101222222222222 0111201122012220
""".split()
# The texel of each subset after the first whose index lacks its top bit.
ANCHOR_OF_TWO = [15, 15, 15, 15, 15, 15, 15, 15, 15, 15, 15, 15, 15, 15, 15, 15, 15, 2, 8, 2, 2, 8, 8, 15, 2, 8, 2, 2, 8, 8, 2, 2, 15, 15, 6, 8, 2, 8, 15, 15, 2, 8, 2, 2, 2, 15, 15, 6, 6, 2, 6, 8, 15, 15, 2, 2, 15, 15, 15, 15, 15, 2, 2, 15]
ANCHOR_1_OF_THREE = [3, 3, 15, 15, 8, 3, 15, 15, 8, 8, 6, 6, 6, 5, 3, 3, 3, 3, 8, 15, 3, 3, 6, 10, 5, 8, 8, 6, 8, 5, 15, 15, 8, 15, 3, 5, 6, 10, 8, 15, 15, 3, 15, 5, 15, 15, 15, 15, 3, 15, 5, 5, 5, 8, 5, 10, 5, 10, 8, 13, 15, 12, 3, 3]
ANCHOR_2_OF_THREE = [15, 8, 8, 3, 15, 15, 3, 8, 15, 15, 15, 15, 15, 15, 15, 8, 15, 8, 15, 3, 15, 8, 15, 8, 3, 15, 6, 10, 15, 15, 10, 8, 15, 3, 15, 10, 10, 8, 9, 10, 6, 15, 8, 15, 3, 6, 6, 8, 15, 3, 15, 15, 15, 15, 15, 15, 15, 15, 15, 15, 3, 15, 15, 8]
# Interpolation weights by index bits.
WEIGHTS = {2: np.array([0, 21, 43, 64]), 3: np.array([0, 9, 18, 27, 37, 46, 55, 64]), 4: np.array([0, 4, 9, 13, 17, 21, 26, 30, 34, 38, 43, 47, 51, 55, 60, 64])}

# BC7 modes as subsets, partition bits, rotation bits, index selection bits, colour bits, alpha bits, P-bits (per endpoint, or shared), index bits, second index bits.
BC7_MODES = [
    (3, 4, 0, 0, 4, 0, "endpoint", 3, 0),
    (2, 6, 0, 0, 6, 0, "shared", 3, 0),
    (3, 6, 0, 0, 5, 0, "", 2, 0),
    (2, 6, 0, 0, 7, 0, "endpoint", 2, 0),
    (1, 0, 2, 1, 5, 6, "", 2, 3),
    (1, 0, 2, 0, 7, 8, "", 2, 2),
    (1, 0, 0, 0, 7, 7, "endpoint", 4, 0),
    (2, 6, 0, 0, 5, 5, "endpoint", 2, 0),
]


@functools.lru_cache(maxsize=8)
def partitions(subsets: int) -> tuple[np.ndarray, np.ndarray]:
    """Each partition's subset by texel, and which texels are anchors."""
    if subsets == 1:
        subset, anchors = np.zeros((1, 16), np.int64), [np.zeros(1, np.int64)]
    else:
        subset = np.array([[int(c) for c in row] for row in (TWO_SUBSETS if subsets == 2 else THREE_SUBSETS)])
        anchors = [np.zeros(64, np.int64), *map(np.array, [ANCHOR_OF_TWO] if subsets == 2 else [ANCHOR_1_OF_THREE, ANCHOR_2_OF_THREE])]
    is_anchor = np.zeros(subset.shape, dtype=bool)
    for a in anchors:
        is_anchor[np.arange(len(subset)), a] = True
    return subset, is_anchor


def bits_of(blocks: np.ndarray) -> np.ndarray:
    """n blocks of 16 bytes as n rows of 128 bits, and some zeros after them."""
    return np.concatenate([np.unpackbits(blocks, axis=1, bitorder="little"), np.zeros((len(blocks), 8), np.uint8)], axis=1).astype(np.int64)


def field(bits: np.ndarray, at: int, size: int) -> np.ndarray:
    return bits[:, at : at + size] @ (1 << np.arange(size)) if size else np.zeros(len(bits), np.int64)


def indices(bits: np.ndarray, start: int, size: int, is_anchor: np.ndarray) -> np.ndarray:
    """Sixteen indices of `size` bits, of which anchors lack the top one; is_anchor is by row."""
    widths = size - is_anchor.astype(np.int64)
    at = start + np.cumsum(widths, axis=1) - widths
    out = np.zeros(at.shape, np.int64)
    for k in range(size):
        out += np.where(k < widths, np.take_along_axis(bits, np.minimum(at + k, bits.shape[1] - 1), axis=1), 0) << k
    return out


def interpolated(a: np.ndarray, b: np.ndarray, weight: np.ndarray) -> np.ndarray:
    return (a * (64 - weight) + b * weight + 32) >> 6


def decode_bc7(blocks: np.ndarray) -> np.ndarray:
    """n x 16 bytes to n x 16 texels of r, g, b, a; blocks without a mode are transparent black."""
    out = np.zeros((len(blocks), 16, 4), np.int64)
    bits_all = bits_of(blocks)
    modes = np.where(blocks[:, 0] == 0, 8, np.argmax(bits_all[:, :8], axis=1))
    for mode, (subsets, p_bits, rotation_bits, select_bits, color_bits, alpha_bits, p_kind, size, size2) in enumerate(BC7_MODES):
        rows = np.flatnonzero(modes == mode)
        if not len(rows):
            continue
        bits, at = bits_all[rows], mode + 1
        partition = field(bits, at, p_bits)
        at += p_bits
        rotation = field(bits, at, rotation_bits)
        at += rotation_bits
        selection = field(bits, at, select_bits)
        at += select_bits
        n = 2 * subsets
        ends = np.full((len(rows), n, 4), 255, np.int64)
        for channel, width in zip(range(4), (color_bits, color_bits, color_bits, alpha_bits), strict=True):
            for e in range(n if width else 0):
                ends[:, e, channel] = field(bits, at, width)
                at += width
        with_p = 0
        if p_kind:
            n_p = subsets if p_kind == "shared" else n
            p = np.stack([field(bits, at + k, 1) for k in range(n_p)], axis=1)
            at += n_p
            p, with_p = np.repeat(p, n // n_p, axis=1), 1
            ends[:, :, : 4 if alpha_bits else 3] = ends[:, :, : 4 if alpha_bits else 3] << 1 | p[:, :, None]
        for channels, width in ((slice(0, 3), color_bits + with_p), (slice(3, 4), (alpha_bits + with_p) if alpha_bits else 0)):
            if width:
                v = ends[:, :, channels] << (8 - width)
                ends[:, :, channels] = v | v >> width
        subset, is_anchor = (table[partition] for table in partitions(subsets))
        index = indices(bits, at, size, is_anchor)
        low = np.take_along_axis(ends, (2 * subset)[:, :, None], axis=1)
        high = np.take_along_axis(ends, (2 * subset + 1)[:, :, None], axis=1)
        weight = WEIGHTS[size][index][:, :, None]
        if size2:
            index2 = indices(bits, at + 16 * size - 1, size2, is_anchor)
            weight2 = WEIGHTS[size2][index2][:, :, None]
            swap = (selection == 1)[:, None, None]
            weight = np.concatenate([np.repeat(np.where(swap, weight2, weight), 3, axis=2), np.where(swap, weight, weight2)], axis=2)
        texels = interpolated(low, high, weight)
        for k in (1, 2, 3):
            turned = rotation == k
            texels[np.ix_(turned, range(16), [k - 1, 3])] = texels[np.ix_(turned, range(16), [3, k - 1])]
        out[rows] = texels
    return out


# BC6H modes as code, its bits, endpoint bits, delta bits of r, g, b, and the fields after the code; R0[0-9] is bits 0 to 9, first bit first.
BC6H_MODES = [
    (0, 2, 10, (5, 5, 5), "G2[4] B2[4] B3[4] R0[0-9] G0[0-9] B0[0-9] R1[0-4] G3[4] G2[0-3] G1[0-4] B3[0] G3[0-3] B1[0-4] B3[1] B2[0-3] R2[0-4] B3[2] R3[0-4] B3[3] P[0-4]"),
    (1, 2, 7, (6, 6, 6), "G2[5] G3[4] G3[5] R0[0-6] B3[0] B3[1] B2[4] G0[0-6] B2[5] B3[2] G2[4] B0[0-6] B3[3] B3[5] B3[4] R1[0-5] G2[0-3] G1[0-5] G3[0-3] B1[0-5] B2[0-3] R2[0-5] R3[0-5] P[0-4]"),
    (2, 5, 11, (5, 4, 4), "R0[0-9] G0[0-9] B0[0-9] R1[0-4] R0[10] G2[0-3] G1[0-3] G0[10] B3[0] G3[0-3] B1[0-3] B0[10] B3[1] B2[0-3] R2[0-4] B3[2] R3[0-4] B3[3] P[0-4]"),
    (6, 5, 11, (4, 5, 4), "R0[0-9] G0[0-9] B0[0-9] R1[0-3] R0[10] G3[4] G2[0-3] G1[0-4] G0[10] G3[0-3] B1[0-3] B0[10] B3[1] B2[0-3] R2[0-3] B3[0] B3[2] R3[0-3] G2[4] B3[3] P[0-4]"),
    (10, 5, 11, (4, 4, 5), "R0[0-9] G0[0-9] B0[0-9] R1[0-3] R0[10] B2[4] G2[0-3] G1[0-3] G0[10] B3[0] G3[0-3] B1[0-4] B0[10] B2[0-3] R2[0-3] B3[1] B3[2] R3[0-3] B3[4] B3[3] P[0-4]"),
    (14, 5, 9, (5, 5, 5), "R0[0-8] B2[4] G0[0-8] G2[4] B0[0-8] B3[4] R1[0-4] G3[4] G2[0-3] G1[0-4] B3[0] G3[0-3] B1[0-4] B3[1] B2[0-3] R2[0-4] B3[2] R3[0-4] B3[3] P[0-4]"),
    (18, 5, 8, (6, 5, 5), "R0[0-7] G3[4] B2[4] G0[0-7] B3[2] G2[4] B0[0-7] B3[3] B3[4] R1[0-5] G2[0-3] G1[0-4] B3[0] G3[0-3] B1[0-4] B3[1] B2[0-3] R2[0-5] R3[0-5] P[0-4]"),
    (22, 5, 8, (5, 6, 5), "R0[0-7] B3[0] B2[4] G0[0-7] G2[5] G2[4] B0[0-7] G3[5] B3[4] R1[0-4] G3[4] G2[0-3] G1[0-5] G3[0-3] B1[0-4] B3[1] B2[0-3] R2[0-4] B3[2] R3[0-4] B3[3] P[0-4]"),
    (26, 5, 8, (5, 5, 6), "R0[0-7] B3[1] B2[4] G0[0-7] B2[5] G2[4] B0[0-7] B3[5] B3[4] R1[0-4] G3[4] G2[0-3] G1[0-4] B3[0] G3[0-3] B1[0-5] B2[0-3] R2[0-4] B3[2] R3[0-4] B3[3] P[0-4]"),
    (30, 5, 6, (6, 6, 6), "R0[0-5] G3[4] B3[0] B3[1] B2[4] G0[0-5] G2[5] B2[5] B3[2] G2[4] B0[0-5] G3[5] B3[3] B3[5] B3[4] R1[0-5] G2[0-3] G1[0-5] G3[0-3] B1[0-5] B2[0-3] R2[0-5] R3[0-5] P[0-4]"),
    (3, 5, 10, (10, 10, 10), "R0[0-9] G0[0-9] B0[0-9] R1[0-9] G1[0-9] B1[0-9]"),
    (7, 5, 11, (9, 9, 9), "R0[0-9] G0[0-9] B0[0-9] R1[0-8] R0[10] G1[0-8] G0[10] B1[0-8] B0[10]"),
    (11, 5, 12, (8, 8, 8), "R0[0-9] G0[0-9] B0[0-9] R1[0-7] R0[11-10] G1[0-7] G0[11-10] B1[0-7] B0[11-10]"),
    (15, 5, 16, (4, 4, 4), "R0[0-9] G0[0-9] B0[0-9] R1[0-3] R0[15-10] G1[0-3] G0[15-10] B1[0-3] B0[15-10]"),
]
#: Modes whose endpoints are stored as they are, not as deltas.
BC6H_DIRECT = (9, 10)


@functools.lru_cache(maxsize=1)
def bc6h_fields() -> list[list[tuple[str, int]]]:
    """For each mode, the field and bit of each stored bit after the code."""
    out = []
    for *_, text in BC6H_MODES:
        stored = []
        for name, first, last in re.findall(r"(\w+)\[(\d+)(?:-(\d+))?\]", text):
            first, last = int(first), int(last or first)
            stored += [(name, k) for k in (range(first, last + 1) if last >= first else range(first, last - 1, -1))]
        out.append(stored)
    return out


def extended_sign(v: np.ndarray, bits: int) -> np.ndarray:
    top = 1 << (bits - 1)
    return (v ^ top) - top


def unquantised(v: np.ndarray, bits: int, signed: bool) -> np.ndarray:
    if not signed:
        if bits >= 15:
            return v
        return np.select([v == 0, v == (1 << bits) - 1], [0, 0xFFFF], ((v << 16) + 0x8000) >> bits)
    if bits >= 16:
        return v
    size = np.abs(v)
    size = np.select([size == 0, size >= (1 << (bits - 1)) - 1], [0, 0x7FFF], ((size << 15) + 0x4000) >> (bits - 1))
    return np.where(v < 0, -size, size)


def decode_bc6h(blocks: np.ndarray, signed: bool) -> np.ndarray:
    """n x 16 bytes to n x 16 texels of r, g, b as half-float bits; reserved modes are zeros."""
    out = np.zeros((len(blocks), 16, 3), np.int64)
    bits_all = bits_of(blocks)
    code = np.where(blocks[:, 0] & 2, blocks[:, 0] & 31, blocks[:, 0] & 3)
    for mode, (stored_code, code_bits, width, deltas, _) in enumerate(BC6H_MODES):
        rows = np.flatnonzero(code == stored_code)
        if not len(rows):
            continue
        bits = bits_all[rows]
        two = mode < 10
        ends = np.zeros((len(rows), 4, 3), np.int64)
        partition = np.zeros(len(rows), np.int64)
        for at, (name, bit) in enumerate(bc6h_fields()[mode], code_bits):
            if name == "P":
                partition |= bits[:, at] << bit
            else:
                ends[:, int(name[1]), "RGB".index(name[0])] |= bits[:, at] << bit
        n = 4 if two else 2
        for c in range(3):
            v = ends[:, :n, c]
            if signed:
                v[:, 0] = extended_sign(v[:, 0], width)
            if mode not in BC6H_DIRECT or signed:
                v[:, 1:] = extended_sign(v[:, 1:], deltas[c])
            if mode not in BC6H_DIRECT:
                v[:, 1:] = (v[:, 1:] + v[:, :1]) & ((1 << width) - 1)
                if signed:
                    v[:, 1:] = extended_sign(v[:, 1:], width)
            ends[:, :n, c] = unquantised(v, width, signed)
        size = 3 if two else 4
        subset, is_anchor = (table[partition] for table in partitions(2 if two else 1))
        index = indices(bits, code_bits + len(bc6h_fields()[mode]), size, is_anchor)
        low = np.take_along_axis(ends, (2 * subset)[:, :, None], axis=1)
        high = np.take_along_axis(ends, (2 * subset + 1)[:, :, None], axis=1)
        v = interpolated(low, high, WEIGHTS[size][index][:, :, None])
        if signed:
            size_ = (np.abs(v) * 31) >> 5
            out[rows] = np.where(v < 0, 0x8000, 0) * (size_ > 0) | size_ & 0x7FFF
        else:
            out[rows] = (v * 31 >> 6) & 0xFFFF
    return out
