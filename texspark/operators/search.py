"""Encoders that search for endpoints, over many blocks at a time.

A batch of blocks is an array (n, 16, 4). Every search step is one array operation over
all blocks, and a mask says which blocks it still concerns; a candidate wins only by a
strictly smaller error, so the order of the candidates decides ties.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from texspark.formats import format_of
from texspark.functions.palettes import SIGNED_FIVE, SIGNED_SEVEN
from texspark.operators.bptc import WEIGHTS as BPTC_WEIGHTS
from texspark.operators.surfaces import block_rasters, encoded_by_block

BLOCKS = 4096  # that one step handles


@dataclass(frozen=True)
class Level:
    """Principal axis or bounding box first; grid pairs tried and their step; alpha grid tries; least-squares rounds. Numbers below 0, and steps below 1, count as those."""

    axis: bool
    tries: int
    step: int
    alpha_tries: int
    rounds: int

    def __post_init__(self):
        for name, least in (("tries", 0), ("step", 1), ("alpha_tries", 0), ("rounds", 0)):
            object.__setattr__(self, name, max(least, getattr(self, name)))


# What the ten quality levels search.
LEVELS = {
    1: Level(False, 0, 1, 0, 0),
    2: Level(False, 8, 1, 8, 2),
    3: Level(False, 16, 1, 16, 2),
    4: Level(False, 32, 1, 32, 2),
    5: Level(True, 32, 1, 32, 2),
    6: Level(True, 64, 1, 64, 2),
    7: Level(True, 96, 1, 96, 2),
    8: Level(True, 256, 2, 256, 4),
    9: Level(True, 384, 1, 384, 4),
    10: Level(True, 512, 1, 512, 4),
}
#: Error weights of red, green and blue in 1,024ths: in general, and of a block of constant red.
GENERAL, BALANCED = np.array([307, 614, 102]), np.array([341, 341, 341])


def rgb565(c: np.ndarray) -> np.ndarray:
    return (c[..., 0] >> 3) << 11 | (c[..., 1] >> 2) << 5 | c[..., 2] >> 3


def from_565(v: np.ndarray) -> np.ndarray:
    r, g, b = v >> 11 & 31, v >> 5 & 63, v & 31
    return np.stack([(r * 255 + 15) // 31, (g * 255 + 31) // 63, (b * 255 + 15) // 31], axis=-1)


# Channels of five and six bits in eight.
FIVE, SIX = ((np.arange(top + 1) * 255 + top // 2) // top for top in (31, 63))
FIVE, SIX = FIVE.astype(np.int32), SIX.astype(np.int32)


def palette_planes(c0: np.ndarray, c1: np.ndarray) -> list[list[np.ndarray]]:
    """color_palette() as four entries of three arrays, one for each channel."""
    a, b = ([FIVE[c >> 11 & 31], SIX[c >> 5 & 63], FIVE[c & 31]] for c in (c0, c1))
    four = c0 > c1
    third = [np.where(four, (2 * x + y + 1) // 3, (x + y) // 2) for x, y in zip(a, b, strict=True)]
    return [a, b, third, [np.where(four, (x + 2 * y + 1) // 3, 0) for x, y in zip(a, b, strict=True)]]


def color_palette(c0: np.ndarray, c1: np.ndarray) -> np.ndarray:
    """Four colours of each endpoint pair; the fourth is black if the pair is not in falling order."""
    a, b = from_565(c0), from_565(c1)
    four = (c0 > c1)[..., None]
    third = np.where(four, (2 * a + b + 1) // 3, (a + b) // 2)
    return np.stack([a, b, third, np.where(four, (a + 2 * b + 1) // 3, 0)], axis=-2)


class Colors:
    """The colour part of a batch: texels, error weights, and which blocks and texels are transparent."""

    def __init__(self, blocks: np.ndarray, threshold: int | None, weights: np.ndarray | None = None):
        self.rgb = blocks[:, :, :3].astype(np.int32)
        below = blocks[:, :, 3] < threshold if threshold is not None else np.zeros(blocks.shape[:2], dtype=bool)
        self.clear, self.below, self.any_below = below.any(axis=1), below, bool(below.any())
        flat = (self.rgb[:, :, 0] == self.rgb[:, :1, 0]).all(axis=1)
        self.weights = (np.where(flat[:, None], BALANCED, GENERAL) if weights is None else np.broadcast_to(weights, (len(blocks), 3))).astype(np.int32)
        self.planes = np.ascontiguousarray(self.rgb.transpose(2, 1, 0))  # channel, texel, block: blocks side by side are fast to add up
        self.room = np.empty((5, *self.planes.shape[1:]), np.int32)
        self.squares = sum(w * p * p for w, p in zip(self.weights.T, self.planes, strict=True))

    def ordered(self, c0: np.ndarray, c1: np.ndarray, rows=slice(None)) -> tuple[np.ndarray, np.ndarray]:
        """Falling order for opaque blocks, rising for others."""
        low, high = np.minimum(c0, c1), np.maximum(c0, c1)
        clear = self.clear[rows]
        return np.where(clear, low, high), np.where(clear, high, low)

    def errors(self, c0: np.ndarray, c1: np.ndarray, rows=slice(None)) -> list[np.ndarray]:
        """For each palette entry the weighted squared error of each texel (16, n), but for the texel's own square; entries that a block can't use are out of reach.

        Weights are 1,024ths, so all fits in 32 bits. The arrays are used again by the next call.
        """
        weights, texels = self.weights[rows].T, self.planes[:, :, rows]
        *out, part = (x[:, : texels.shape[2]] for x in self.room)
        for error, entry in zip(out, palette_planes(c0, c1), strict=True):
            own = sum(w * e * e for w, e in zip(weights, entry, strict=True))
            for c in range(3):
                np.multiply(texels[c], 2 * weights[c] * entry[c], out=part)
                np.subtract(error if c else own, part, out=error)
        out[3] += self.clear[rows].astype(np.int32) << 30
        return out

    def total(self, c0: np.ndarray, c1: np.ndarray, rows=slice(None)) -> np.ndarray:
        errors = self.errors(c0, c1, rows)
        least = errors[0]
        for other in errors[1:]:
            np.minimum(least, other, out=least)
        least += self.squares[:, rows]
        if self.any_below:
            least[self.below[rows].T] = 0
        return least.sum(axis=0, dtype=np.int64)

    def nearest(self, c0: np.ndarray, c1: np.ndarray, rows=slice(None)) -> np.ndarray:
        """Each texel's palette entry (n, 16), the first of equally near ones."""
        errors = self.errors(c0, c1, rows)
        least, index = errors[0], np.zeros(errors[0].shape, np.int64)
        for k in (1, 2, 3):
            index[errors[k] < least] = k
            np.minimum(least, errors[k], out=least)
        return index.T

    def indices(self, c0: np.ndarray, c1: np.ndarray) -> np.ndarray:
        return np.where(self.below, 3, self.nearest(c0, c1))


def axis_ends(rgb: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The texels at the ends of each block's principal axis, by eight rounds of power iteration."""
    p = rgb.astype(np.float64)
    d = p - (rgb.sum(axis=1) / 16.0)[:, None, :]
    cov = {(i, j): (d[:, :, i] * d[:, :, j]).sum(axis=1) for i in range(3) for j in range(i, 3)}
    row = lambda i: [cov[min(i, j), max(i, j)] for j in range(3)]
    dot = lambda a, b: a[0] * b[0] + a[1] * b[1] + a[2] * b[2]
    axis = [np.ones(len(rgb)) for _ in range(3)]
    going = np.ones(len(rgb), dtype=bool)
    for _ in range(8):
        v = [dot(row(i), axis) for i in range(3)]
        size = np.sqrt(dot(v, v))
        going &= size >= 1e-5
        axis = [np.where(going, x / np.where(going, size, 1), a) for x, a in zip(v, axis, strict=True)]
    along = dot([p[:, :, k] for k in range(3)], [a[:, None] for a in axis])
    pick = lambda at: rgb[np.arange(len(rgb)), at]
    return pick(along.argmin(axis=1)), pick(along.argmax(axis=1))


def neighbours(c: np.ndarray, step: int) -> tuple[np.ndarray, np.ndarray]:
    """Endpoints within a step of each channel, red slowest, and which of them are in range."""
    d = np.arange(-step, step + 1)
    dr, dg, db = (x.ravel() for x in np.meshgrid(d, d, d, indexing="ij"))
    r, g, b = (c >> 11)[:, None] + dr, (c >> 5 & 63)[:, None] + dg, (c & 31)[:, None] + db
    good = (r >= 0) & (r < 32) & (g >= 0) & (g < 64) & (b >= 0) & (b < 32)
    return np.where(good, r << 11 | g << 5 | b, 0), good


def rounded_ratio(num: np.ndarray, denom: np.ndarray) -> np.ndarray:
    """num / denom to the nearest, halves away from zero; denom is positive."""
    size = (np.abs(num) + denom // 2) // denom
    return np.where(num < 0, -size, size)


def least_squares(a: np.ndarray, b: np.ndarray, values: np.ndarray, d: np.ndarray, clamp: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Endpoints that fit values (n, 16, channels) best with weights a and b of a sum d, clamped to bytes or not, and where they exist."""
    saa, sbb, sab = ((x * y).sum(axis=1) for x, y in ((a, a), (b, b), (a, b)))
    sap, sbp = ((x[:, :, None] * values).sum(axis=1) for x in (a, b))
    denom = saa * sbb - sab * sab
    safe = np.where(denom == 0, 1, denom)[:, None]
    num0 = d[:, None] * (sap * sbb[:, None] - sbp * sab[:, None])
    num1 = d[:, None] * (sbp * saa[:, None] - sap * sab[:, None])
    e0, e1 = rounded_ratio(num0, safe), rounded_ratio(num1, safe)
    return (np.clip(e0, 0, 255), np.clip(e1, 0, 255), denom != 0) if clamp else (e0, e1, denom != 0)


# How many of d parts of the second endpoint a palette entry has.
PARTS_OF_FOUR, PARTS_OF_THREE, PARTS_OF_EIGHT = np.array([0, 3, 1, 2]), np.array([0, 2, 1, 0]), np.array([0, 7, 1, 2, 3, 4, 5, 6])


def color_ends(colors: Colors, level: Level) -> tuple[np.ndarray, np.ndarray]:
    """Endpoints of each block's colours."""
    low, high = axis_ends(colors.rgb) if level.axis else (colors.rgb.min(axis=1), colors.rgb.max(axis=1))
    inset = (high - low) >> 4  # of an axis a channel may fall; the shift rounds down
    c0, c1 = rgb565(np.clip(high - inset, 0, 255)), rgb565(np.clip(low + inset, 0, 255))
    if not level.tries and not level.rounds:
        return c0, c1
    c0, c1 = colors.ordered(c0, c1)
    best = colors.total(c0, c1)
    if level.tries:
        c0, c1, best = _grid(colors, level, c0, c1, best)
    going = best > 0
    for _ in range(level.rounds):
        rows = np.flatnonzero(going)
        if not len(rows):
            break
        near = colors.nearest(c0[rows], c1[rows], rows)
        clear = colors.clear[rows][:, None]
        d = np.where(clear, 2, 3)
        b = np.where(clear, PARTS_OF_THREE[near], PARTS_OF_FOUR[near])
        used = ~colors.below[rows]
        e0, e1, found = least_squares(np.where(used, d - b, 0), np.where(used, b, 0), colors.rgb[rows].astype(np.int64), d[:, 0])
        n0, n1 = colors.ordered(rgb565(e0), rgb565(e1), rows)
        error = colors.total(n0, n1, rows)
        better = found & ((n0 != c0[rows]) | (n1 != c1[rows])) & (error < best[rows])
        won = rows[better]
        c0[won], c1[won], best[won] = n0[better], n1[better], error[better]
        going[rows] = better & (best[rows] > 0)
    return c0, c1


def _grid(colors: Colors, level: Level, c0: np.ndarray, c1: np.ndarray, best: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The best pair among the first so many pairs of neighbours in range, in row-major order."""
    (near0, good0), (near1, good1) = neighbours(c0, level.step), neighbours(c1, level.step)
    c0, c1, best = c0.copy(), c1.copy(), best.copy()
    tried = np.zeros(len(c0), np.int64)
    for i in range(near0.shape[1]):
        for j in range(near1.shape[1]):
            rows = np.flatnonzero(good0[:, i] & good1[:, j] & (tried < level.tries) & (best > 0))
            if not len(rows):
                continue
            some = rows if len(rows) < len(c0) else slice(None)  # of a whole batch nothing is copied
            n0, n1 = colors.ordered(near0[some, i], near1[some, j], some)
            error = colors.total(n0, n1, some)
            better = error < best[some]
            won = rows[better]
            c0[won], c1[won], best[won] = n0[better], n1[better], error[better]
            tried[rows] += 1
        if not ((tried < level.tries) & (best > 0)).any():
            break
    return c0, c1, best


def color_block(colors: Colors, c0: np.ndarray, c1: np.ndarray) -> np.ndarray:
    """Eight bytes of each block."""
    word = (colors.indices(c0, c1).astype(np.int64) << (2 * np.arange(16))).sum(axis=1)
    return np.concatenate([little(c0, 2), little(c1, 2), little(word, 4)], axis=1)


def little(v: np.ndarray, size: int) -> np.ndarray:
    """Unsigned integers as rows of little-endian bytes."""
    return (v.astype(np.int64)[:, None] >> (8 * np.arange(size)) & 255).astype(np.uint8)


def alpha_palette(a0: np.ndarray, a1: np.ndarray) -> np.ndarray:
    a0, a1 = a0[:, None], a1[:, None]
    k = np.arange(1, 7)
    seven = ((7 - k) * a0 + k * a1 + 3) // 7
    k = np.arange(1, 5)
    five = np.concatenate([((5 - k) * a0 + k * a1 + 2) // 5, 0 * a0, 0 * a0 + 255], axis=1)
    return np.concatenate([a0, a1, np.where(a0 > a1, seven, five)], axis=1)


def signed_palette(a0: np.ndarray, a1: np.ndarray) -> np.ndarray:
    a0, a1 = a0[:, None], a1[:, None]
    mixed = lambda rows: [(p * a0 + q * a1 + 32768) >> 16 for p, q in rows.values()]
    seven = np.concatenate(mixed(SIGNED_SEVEN), axis=1)
    five = np.concatenate([*mixed(SIGNED_FIVE), 0 * a0 - 127, 0 * a0 + 127], axis=1)
    return np.concatenate([a0, a1, np.where(a0 > a1, seven, five)], axis=1)


def _squares(values: np.ndarray, palette: np.ndarray) -> np.ndarray:
    return (values[:, :, None] - palette[:, None, :]) ** 2


def alpha_block(values: np.ndarray, tries: int, rounds: int, signed: bool = False, apart: bool = True) -> np.ndarray:
    """RGTC blocks of one channel (n, 16). apart: equal endpoints are told apart, as all but the alpha of BC3 are."""
    v = values.astype(np.int64)
    palette, low, high = (signed_palette, -127, 127) if signed else (alpha_palette, 0, 255)
    a0, a1 = v.max(axis=1), v.min(axis=1)
    same = a0 == a1
    if signed:
        a0, a1 = np.where(same & (a0 == low), a1 + 1, a0), np.where(same & (a0 > low), a0 - 1, a1)
    elif apart:
        a1 = np.where(same, np.where(a0 > 0, a0 - 1, 1), a1)
    total = lambda x, y, rows=slice(None): _squares(v[rows], palette(x, y)).min(axis=2).sum(axis=1)
    best, seed0, seed1 = total(a0, a1), a0, a1
    searched = best != 0 if not signed else np.ones(len(v), dtype=bool)
    for i in range(min(tries, 9)):  # nine offsets; further tries repeat them
        n0, n1 = np.clip(seed0 + i % 3 - 1, low, high), np.clip(seed1 + i // 3 % 3 - 1, low, high)
        error = total(n0, n1)
        better = searched & (error < best) & ((n0 > n1) if signed else True)
        a0, a1, best = np.where(better, n0, a0), np.where(better, n1, a1), np.where(better, error, best)
    if not signed:
        going = (best != 0) & (apart | ~same)
        for _ in range(rounds):
            rows = np.flatnonzero(going)
            if not len(rows):
                break
            b = PARTS_OF_EIGHT[_squares(v[rows], palette(a0[rows], a1[rows])).argmin(axis=2)]
            e0, e1, found = least_squares(7 - b, b, v[rows][:, :, None], np.full(len(rows), 7))
            n0, n1 = np.maximum(e0, e1)[:, 0], np.minimum(e0, e1)[:, 0]
            error = total(n0, n1, rows)
            better = found & (n0 != n1) & ((n0 != a0[rows]) | (n1 != a1[rows])) & (error < best[rows])
            won = rows[better]
            a0[won], a1[won], best[won] = n0[better], n1[better], error[better]
            going[rows] = better & (best[rows] != 0)
    index = _squares(v, palette(a0, a1)).argmin(axis=2)
    if not apart:
        index[same] = 0
    word = (index.astype(np.int64) << (3 * np.arange(16))).sum(axis=1)
    return np.concatenate([little(a0 & 255, 1), little(a1 & 255, 1), little(word, 6)], axis=1)


def to_snorm(v: np.ndarray) -> np.ndarray:
    return (v.astype(np.int64) * 254 + 127) // 255 - 127


def _stored_mode6(c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Endpoints in seven bits a channel and the common low bit that comes nearest."""
    options = [np.clip((c - p + 1) >> 1, 0, 127) for p in (0, 1)]
    errors = [((c - (q << 1 | p)) ** 2).sum(axis=1) for p, q in enumerate(options)]
    p = (errors[1] < errors[0]).astype(np.int64)
    return np.where(p[:, None] == 1, options[1], options[0]), p


def bc7_mode6(blocks: np.ndarray, rounds: int = 16) -> np.ndarray:
    """BC7 blocks in mode 6: the two most distant texels as endpoints, then least squares while it helps."""
    v = blocks.astype(np.int64)
    weight = BPTC_WEIGHTS[4]
    distance = ((v[:, :, None, :] - v[:, None, :, :]) ** 2).sum(axis=3)
    i, j = np.triu_indices(16, 1)
    far = distance[:, i, j].argmax(axis=1)
    rows = np.arange(len(v))
    (q0, p0), (q1, p1) = _stored_mode6(v[rows, i[far]]), _stored_mode6(v[rows, j[far]])

    def assigned(q0, p0, q1, p1, rows=slice(None)):
        e0, e1 = (q << 1 | p[:, None] for q, p in ((q0, p0), (q1, p1)))
        palette = (e0[:, None, :] * (64 - weight)[:, None] + e1[:, None, :] * weight[:, None] + 32) >> 6
        errors = ((v[rows][:, :, None, :] - palette[:, None, :, :]) ** 2).sum(axis=3)
        return errors.argmin(axis=2), errors.min(axis=2).sum(axis=1)

    index, best = assigned(q0, p0, q1, p1)
    going = np.ones(len(v), dtype=bool)
    for _ in range(rounds):
        rows = np.flatnonzero(going)
        if not len(rows):
            break
        b = weight[index[rows]]
        e0, e1, found = least_squares(64 - b, b, v[rows], np.full(len(rows), 64))
        (n0, m0), (n1, m1) = _stored_mode6(e0), _stored_mode6(e1)
        near, error = assigned(n0, m0, n1, m1, rows)
        better = found & (error < best[rows])
        won = rows[better]
        q0[won], p0[won], q1[won], p1[won], index[won], best[won] = n0[better], m0[better], n1[better], m1[better], near[better], error[better]
        going[rows] = better & (best[rows] > 0)
    turned = index[:, 0] >= 8  # the first index has three bits
    q0[turned], q1[turned] = q1[turned], q0[turned].copy()
    p0[turned], p1[turned] = p1[turned], p0[turned].copy()
    index = np.where(turned[:, None], assigned(q0, p0, q1, p1)[0], index)
    fields = [(np.full(len(v), 1 << 6), 7)]
    for c in range(4):
        fields += [(q0[:, c], 7), (q1[:, c], 7)]
    fields += [(p0, 1), (p1, 1), (index[:, 0], 3), *((index[:, t], 4) for t in range(1, 16))]
    bits = np.concatenate([(x[:, None] >> np.arange(n) & 1).astype(np.uint8) for x, n in fields], axis=1)
    return np.packbits(bits, axis=1, bitorder="little")


def fixed_weights(r: float, g: float, b: float) -> np.ndarray:
    """Relative channel weights in 1,024ths of their sum, halves up; negative ones count as zero."""
    parts = np.maximum([r, g, b], 0.0)
    return np.floor(parts * (1024.0 / parts.sum()) + 0.5).astype(np.int64) if parts.sum() > 0 else np.zeros(3, np.int64)


def encode_array(blocks: np.ndarray, fmt: str, level: int | Level = 6, threshold: int = 128, weights: tuple[float, float, float] | None = None) -> np.ndarray:
    """Encoded bytes (n, block size) of blocks (n, 16, 4) of bytes.

    level: 1 to 10 (others count as the nearest), or what to search; BC7 takes only the
    former. threshold: alpha below it is transparent in BC1 (0 counts as 128). weights: of red, green and blue in colour errors, but not when BC2 picks its
    indices, nor in BC7.
    """
    name = format_of(fmt).name
    search = level if isinstance(level, Level) else LEVELS[min(10, max(1, level))]
    own = None if weights is None else fixed_weights(*weights)
    channel = lambda c, **more: alpha_block(blocks[:, :, c], search.alpha_tries, search.rounds, **more)
    signed = lambda c: alpha_block(to_snorm(blocks[:, :, c]), search.alpha_tries, 0, signed=True)
    if name == "BC1":
        colors = Colors(blocks, threshold or 128, own)
        return color_block(colors, *colors.ordered(*color_ends(colors, search)))
    if name in ("BC2", "BC3"):
        colors = Colors(blocks, None, own)
        ends = color_ends(colors, search)
        if name == "BC3":
            alpha = alpha_block(blocks[:, :, 3], 0, search.rounds, apart=False)
        else:
            nibbles = ((blocks[:, :, 3].astype(np.int64) + 8) // 17).reshape(-1, 8, 2)
            alpha = (nibbles[:, :, 0] | nibbles[:, :, 1] << 4).astype(np.uint8)
            colors.weights = np.broadcast_to(GENERAL, (len(blocks), 3)).astype(np.int32)
        return np.concatenate([alpha, color_block(colors, *ends)], axis=1)
    if name in ("BC4", "BC5"):
        return np.concatenate([channel(c) for c in range(1 if name == "BC4" else 2)], axis=1)
    if name in ("BC4S", "BC5S"):
        return np.concatenate([signed(c) for c in range(1 if name == "BC4S" else 2)], axis=1)
    if name == "BC7":
        from texspark.operators.bc7 import encode_bc7

        return encode_bc7(blocks, 6 if isinstance(level, Level) else level)
    raise ValueError(f"no encoder for {name} yet")


def tiles(images: np.ndarray) -> np.ndarray:
    """The 4x4 blocks (n, 16, channels) of images (m, height, width, channels), row by row; the last column and row are repeated to fill them."""
    if images.shape[1] % 4 or images.shape[2] % 4:
        images = np.pad(images, ((0, 0), (0, -images.shape[1] % 4), (0, -images.shape[2] % 4), (0, 0)), mode="edge")
    m, high, wide, channels = images.shape
    return images.reshape(m, high // 4, 4, wide // 4, 4, channels).transpose(0, 1, 3, 2, 4, 5).reshape(-1, 16, channels)


def blocks_of(rgba: bytes, width: int, height: int) -> np.ndarray:
    """A surface's 4x4 blocks (n, 16, 4), row by row; the last column and row are repeated to fill them."""
    return tiles(np.frombuffer(rgba, dtype=np.uint8).reshape(1, height, width, 4))


def alike(batch: pa.RecordBatch, column: str, dtype: str, channels: int) -> np.ndarray | None:
    """A batch's surfaces (width, height and tight pixels) as one array (m, height, width, channels), if none is null and all have one size."""
    data, width, height = batch.column(column), batch.column("width"), batch.column("height")
    if not batch.num_rows or not pa.types.is_binary(data.type) or data.null_count or width.null_count or height.null_count:
        return None
    w, h = width[0].as_py(), height[0].as_py()
    at = np.frombuffer(data.buffers()[1], np.int32)[data.offset : data.offset + len(data) + 1]
    if w < 1 or h < 1 or (width.to_numpy() != w).any() or (height.to_numpy() != h).any() or (np.diff(at) != w * h * channels * np.dtype(dtype).itemsize).any():
        return None
    return np.frombuffer(data.buffers()[2], np.uint8)[at[0] : at[-1]].view(dtype).reshape(len(data), h, w, channels)


def encode_batch(batch: pa.RecordBatch, column: str, dtype: str, channels: int, encode: Callable[[np.ndarray], np.ndarray], size: int = BLOCKS) -> pa.Array:
    """Encoded payloads of a batch's surfaces; those of one size are cut into blocks together, others one by one."""
    images = alike(batch, column, dtype, channels)
    if images is not None:
        blocks = tiles(images)
        payload = np.concatenate([encode(blocks[k : k + size]) for k in range(0, len(blocks), size)])
        return pa.FixedSizeBinaryArray.from_buffers(pa.binary(payload.size // len(images)), len(images), [None, pa.py_buffer(payload.tobytes())]).cast(pa.binary())
    columns = zip(*(batch.column(c).to_pylist() for c in ("width", "height", column)), strict=True)
    surfaces = [None if data is None else tiles(np.frombuffer(data, dtype).reshape(1, height, width, channels)) for width, height, data in columns]
    return pa.array(encode_many(surfaces, encode), pa.binary())


def encode_many(surfaces: list[np.ndarray | None], encode: Callable[[np.ndarray], np.ndarray]) -> list[bytes | None]:
    """Encoded payloads of surfaces' blocks; small surfaces are encoded together, large ones in parts."""
    out: list[bytes | None] = []
    for k in range(0, len(surfaces), BLOCKS):
        some = [s for s in surfaces[k : k + BLOCKS] if s is not None]
        pieces, waiting, held = [], [], 0
        for s in some:
            waiting.append(s)
            held += len(s)
            if held >= BLOCKS:
                together = np.concatenate(waiting)
                pieces += [encode(together[a : a + BLOCKS]) for a in range(0, held, BLOCKS)]
                waiting, held = [], 0
        if waiting:
            pieces.append(encode(np.concatenate(waiting)))
        joined = np.concatenate(pieces).tobytes() if pieces else b""
        size = len(joined) // max(1, sum(map(len, some)))
        at = 0
        for s in surfaces[k : k + BLOCKS]:
            out.append(None if s is None else joined[at : at + size * len(s)])
            at += 0 if s is None else size * len(s)
    return out


def encode_surfaces(surfaces: DataFrame, fmt: str, level: int | Level = 6, threshold: int = 128, weights: tuple[float, float, float] | None = None) -> DataFrame:
    """surfaces (width, height, rgba, any other columns) with payload instead of rgba, and format.

    No shuffle: a surface is encoded where it is, some thousand blocks at a time. A null
    rgba has a null payload; one of the wrong length fails the query.
    """
    name = format_of(fmt).name
    keep = [c for c in surfaces.columns if c not in ("rgba", "format", "payload")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            payloads = encode_batch(batch, "rgba", "u1", 4, lambda some: encode_array(some, name, level, threshold, weights))
            yield pa.record_batch({c: batch.column(c) for c in keep} | {"format": pa.array([name] * batch.num_rows, pa.string()), "payload": payloads})

    schema = StructType([*(surfaces.schema[c] for c in keep), *StructType.fromDDL("format string, payload binary").fields])
    return surfaces.select(*keep, "rgba").mapInArrow(run, schema)


def encode_texels(texels: DataFrame, fmt: str, level: int | Level = 6, threshold: int = 128, weights: tuple[float, float, float] | None = None) -> DataFrame:
    """Surfaces (texture_id, face, mip, width, height, format, payload) of texel rows, however large.

    Texels are grouped by 4x4 block, so the blocks of one surface are encoded by many
    tasks; only compressed blocks come together, by block row and then by surface.
    """
    encoded = encoded_by_block(block_rasters(texels), lambda blocks: encode_surfaces(blocks, fmt, level, threshold, weights))
    return encoded.withColumn("format", F.lit(format_of(fmt).name))
