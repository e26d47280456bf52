"""BC7 encoders, over many blocks at a time.

For every block the partitions are ranked by the variance inside their subsets; each of
the best is tried: both ends of a subset start at its two most distant texels and are
refitted by least squares while that lowers the error. The mode and partition with the
least error win, the first of equals.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from texspark.operators.bptc import BC7_MODES, WEIGHTS, decode_bc7, partitions
from texspark.operators.search import bc7_mode6, least_squares

ROUNDS = 8
# Partitions tried at each quality level.
TRIES = {1: 0, 2: 4, 3: 4, 4: 8, 5: 8, 6: 8, 7: 16, 8: 16, 9: 32, 10: 64}
#: Levels that try so many partitions try three subsets and all rotations too.
THREE_FROM = 8
FAR = np.int64(1) << 40


@dataclass(frozen=True)
class PartitionMode:
    """What a mode's blocks hold, from the table of modes."""

    number: int

    @property
    def subsets(self) -> int:
        return BC7_MODES[self.number][0]

    @property
    def partition_bits(self) -> int:
        return BC7_MODES[self.number][1]

    @property
    def bits(self) -> int:
        return BC7_MODES[self.number][4]

    @property
    def channels(self) -> int:
        return 4 if BC7_MODES[self.number][5] else 3

    @property
    def p_kind(self) -> str:
        return BC7_MODES[self.number][6]

    @property
    def index_bits(self) -> int:
        return BC7_MODES[self.number][7]

    def expanded(self, stored: np.ndarray, p: np.ndarray) -> np.ndarray:
        """Stored values with their P-bit as bytes."""
        width = self.bits + bool(self.p_kind)
        v = (stored << 1 | p if self.p_kind else stored) << (8 - width)
        return v | v >> width

    def nearest(self, p: int) -> np.ndarray:
        """The stored value that comes nearest to each byte with this P-bit; with eight bits the upper one of two."""
        stored = np.arange(1 << self.bits)
        byte = np.arange(256)
        if self.bits == 7:
            return np.clip((byte - p + 1) >> 1, 0, 127)
        return np.abs(self.expanded(stored, np.int64(p))[None, :] - byte[:, None]).argmin(axis=1)

    def quantised(self, e0: np.ndarray, e1: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Two endpoints as stored values and P-bits, each with the bit that comes nearest, or both with one."""
        options = []
        for p in (0, 1) if self.p_kind else (0,):
            table = self.nearest(p)
            pair = [table[e] for e in (e0, e1)]
            options.append((pair, [((self.expanded(q, np.int64(p)) - e) ** 2).sum(axis=1) for q, e in zip(pair, (e0, e1), strict=True)]))
        if len(options) == 1:
            (q0, q1), _ = options[0]
            return q0, q1, np.zeros(len(q0), np.int64), np.zeros(len(q0), np.int64)
        (low, low_errors), (high, high_errors) = options
        if self.p_kind == "shared":
            p0 = p1 = (sum(high_errors) < sum(low_errors)).astype(np.int64)
        else:
            p0, p1 = ((h < lo).astype(np.int64) for h, lo in zip(high_errors, low_errors, strict=True))
        return np.where(p0[:, None], high[0], low[0]), np.where(p1[:, None], high[1], low[1]), p0, p1

    def palette(self, q0: np.ndarray, q1: np.ndarray, p0: np.ndarray, p1: np.ndarray) -> np.ndarray:
        weight = WEIGHTS[self.index_bits][:, None]
        e0, e1 = self.expanded(q0, p0[:, None])[:, None, :], self.expanded(q1, p1[:, None])[:, None, :]
        return (e0 * (64 - weight) + e1 * weight + 32) >> 6


def squares(v: np.ndarray, palette: np.ndarray) -> np.ndarray:
    """Squared error (n, 16, entries) of texels and palette entries."""
    out = np.zeros((len(v), 16, palette.shape[1]), np.int64)
    for c in range(v.shape[2]):
        d = v[:, :, None, c] - palette[:, None, :, c]
        out += d * d
    return out


def ranked(blocks: np.ndarray, subsets: int, count: int, channels: int, tries: int) -> np.ndarray:
    """For each block the first partitions by the sum of squares around the subsets' whole means."""
    subset, _ = partitions(subsets)
    v = blocks[:, :, :channels].astype(np.int64)
    score = np.zeros((len(v), count), np.int64)
    for s in range(subsets):
        inside = (subset[:count] == s).astype(np.int64)
        n = np.maximum(inside.sum(axis=1), 1)
        for c in range(channels):
            total, square = v[:, :, c] @ inside.T, (v[:, :, c] ** 2) @ inside.T
            mean = total // n
            score += square - 2 * mean * total + inside.sum(axis=1) * mean * mean
    return np.argsort(score, axis=1, kind="stable")[:, :tries]


def _seeds(v: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The two most distant texels of a subset, the first pair of equals; of a lone texel, itself twice."""
    i, j = np.triu_indices(16, 1)
    distance = ((v[:, i] - v[:, j]) ** 2).sum(axis=2)
    distance[~(inside[:, i] & inside[:, j])] = -1
    at = distance.argmax(axis=1)
    rows = np.arange(len(v))
    lone = distance[rows, at] < 0
    first = inside.argmax(axis=1)
    return v[rows, np.where(lone, first, i[at])], v[rows, np.where(lone, first, j[at])]


def _fitted(mode: PartitionMode, v: np.ndarray, inside: np.ndarray) -> list[np.ndarray]:
    """Endpoints q0, q1, p0, p1 of one subset of each block."""
    best = list(mode.quantised(*_seeds(v, inside)))
    total = lambda q, rows: np.where(inside[rows], squares(v[rows], mode.palette(*q)).min(axis=2), 0).sum(axis=1)
    every = np.arange(len(v))
    error = total(best, every)
    going = np.ones(len(v), dtype=bool)
    weight = WEIGHTS[mode.index_bits]
    for _ in range(ROUNDS):
        rows = np.flatnonzero(going)
        if not len(rows):
            break
        near = squares(v[rows], mode.palette(*(x[rows] for x in best))).argmin(axis=2)
        b = weight[near]
        e0, e1, found = least_squares(np.where(inside[rows], 64 - b, 0), np.where(inside[rows], b, 0), v[rows], np.full(len(rows), 64))
        new = mode.quantised(e0, e1)
        tried = total(new, rows)
        better = found & (tried < error[rows])
        won = rows[better]
        for old, x in zip(best, new, strict=True):
            old[won] = x[better]
        error[won] = tried[better]
        going[rows] = better & (error[rows] > 0)
    return best


def _assigned(mode: PartitionMode, v: np.ndarray, subset: np.ndarray, ends: list[list[np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Each texel's index and error with its subset's palette."""
    errors = np.stack([squares(v, mode.palette(*e)) for e in ends], axis=1)
    own = np.take_along_axis(errors, subset[:, None, :, None], axis=1)[:, 0]
    return own.argmin(axis=2), own.min(axis=2)


def tried_partition(mode: PartitionMode, blocks: np.ndarray, partition: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Encoded blocks with the given partition of each, and their errors over all four channels."""
    all_subsets, all_anchors = partitions(mode.subsets)
    subset, is_anchor = all_subsets[partition], all_anchors[partition]
    v = blocks[:, :, : mode.channels].astype(np.int64)
    ends = [_fitted(mode, v, subset == s) for s in range(mode.subsets)]
    index, _ = _assigned(mode, v, subset, ends)
    for s in range(mode.subsets):
        anchor = (is_anchor & (subset == s)).argmax(axis=1)
        turned = index[np.arange(len(v)), anchor] >> (mode.index_bits - 1) == 1
        q0, q1, p0, p1 = ends[s]
        t = turned[:, None]
        ends[s] = [np.where(t, q1, q0), np.where(t, q0, q1), np.where(turned, p1, p0), np.where(turned, p0, p1)]
        index = np.where(t, _assigned(mode, v, subset, ends)[0], index)
    palettes = np.stack([mode.palette(*e) for e in ends], axis=1)
    shown = palettes[np.arange(len(v))[:, None], subset, index]
    error = ((v - shown) ** 2).sum(axis=(1, 2))
    if mode.channels == 3:
        error = error + ((blocks[:, :, 3].astype(np.int64) - 255) ** 2).sum(axis=1)
    fields = [(np.full(len(v), 1 << mode.number), mode.number + 1), (partition, mode.partition_bits)]
    for c in range(mode.channels):
        fields += [(e[k][:, c], mode.bits) for e in ends for k in (0, 1)]
    if mode.p_kind == "shared":
        fields += [(e[2], 1) for e in ends]
    elif mode.p_kind:
        fields += [(e[k], 1) for e in ends for k in (2, 3)]
    head = np.concatenate([(x[:, None] >> np.arange(n) & 1).astype(np.uint8) for x, n in fields], axis=1)
    bits = np.zeros((len(v), 128), np.uint8)
    bits[:, : head.shape[1]] = head
    widths = mode.index_bits - is_anchor.astype(np.int64)
    at = head.shape[1] + np.cumsum(widths, axis=1) - widths
    rows = np.arange(len(v))[:, None]
    for k in range(mode.index_bits):
        some = k < widths
        bits[np.broadcast_to(rows, at.shape)[some], (at + k)[some]] = (index >> k & 1)[some]
    return np.packbits(bits, axis=1, bitorder="little"), error


def best_of_mode(mode: PartitionMode, blocks: np.ndarray, tries: int, order: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The best of the first partitions of a mode; a block without error is tried no further."""
    count = 1 << mode.partition_bits
    order = ranked(blocks, mode.subsets, count, mode.channels, min(tries, count)) if order is None else order
    best, error = np.zeros((len(blocks), 16), np.uint8), np.full(len(blocks), FAR)
    for t in range(order.shape[1]):
        rows = np.flatnonzero(error > 0)
        if not len(rows):
            break
        found, e = tried_partition(mode, blocks[rows], order[rows, t])
        better = e < error[rows]
        best[rows[better]], error[rows[better]] = found[better], e[better]
    return best, error


def _channel_fit(v: np.ndarray, stored_bits: int, index_bits: int, seeds: tuple[np.ndarray, np.ndarray]) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """Endpoints, indices and palette of channels (n, 16, c) without P-bits; the first index has its top bit clear."""
    stored = np.arange(1 << stored_bits)
    expand = lambda q: q << (8 - stored_bits) | (q << (8 - stored_bits)) >> stored_bits
    table = np.abs(expand(stored)[None, :] - np.arange(256)[:, None]).argmin(axis=1)
    weight = WEIGHTS[index_bits][:, None]
    palette = lambda q: (expand(q[0])[:, None, :] * (64 - weight) + expand(q[1])[:, None, :] * weight + 32) >> 6
    best = [table[e] for e in seeds]
    errors = squares(v, palette(best))
    error, near = errors.min(axis=2).sum(axis=1), errors.argmin(axis=2)
    going = np.ones(len(v), dtype=bool)
    for _ in range(ROUNDS):
        rows = np.flatnonzero(going)
        if not len(rows):
            break
        b = WEIGHTS[index_bits][near[rows]]
        e0, e1, found = least_squares(64 - b, b, v[rows], np.full(len(rows), 64))
        new = [table[e0], table[e1]]
        tried = squares(v[rows], palette(new))
        total = tried.min(axis=2).sum(axis=1)
        better = found & (total < error[rows])
        won = rows[better]
        for old, x in zip(best, new, strict=True):
            old[won] = x[better]
        error[won], near[won] = total[better], tried[better].argmin(axis=2)
        going[rows] = better & (error[rows] > 0)
    turned = (near[:, 0] >> (index_bits - 1) == 1)[:, None]
    best = [np.where(turned, best[1], best[0]), np.where(turned, best[0], best[1])]
    final = palette(best)
    return best, squares(v, final).argmin(axis=2), final


def separate_alpha(number: int, blocks: np.ndarray, rotations: int) -> tuple[np.ndarray, np.ndarray]:
    """Blocks of mode 4 or 5, which index colour and alpha apart, and their errors: the best rotation and index set."""
    _, _, _, select_bits, color_bits, alpha_bits, _, size, size2 = BC7_MODES[number]
    best, error = np.zeros((len(blocks), 16), np.uint8), np.full(len(blocks), FAR)
    rows = np.arange(len(blocks))
    i, j = np.triu_indices(16, 1)
    for rotation in range(rotations):
        v = blocks.astype(np.int64)
        if rotation:
            v[:, :, [rotation - 1, 3]] = v[:, :, [3, rotation - 1]]
        color, alpha = v[:, :, :3], v[:, :, 3:]
        far = ((color[:, i] - color[:, j]) ** 2).sum(axis=2).argmax(axis=1)
        for selection in range(1 + select_bits):
            color_index, alpha_index = (size2, size) if selection else (size, size2)
            q, near, shown = _channel_fit(color, color_bits, color_index, (color[rows, i[far]], color[rows, j[far]]))
            qa, near_a, shown_a = _channel_fit(alpha, alpha_bits, alpha_index, (alpha.max(axis=1), alpha.min(axis=1)))
            total = ((color - shown[rows[:, None], near]) ** 2).sum(axis=(1, 2)) + ((alpha - shown_a[rows[:, None], near_a]) ** 2).sum(axis=(1, 2))
            same = lambda x: np.full(len(v), x)
            fields = [(same(1 << number), number + 1), (same(rotation), 2), (same(selection), select_bits)]
            fields += [(e[:, c], color_bits) for c in range(3) for e in q] + [(e[:, 0], alpha_bits) for e in qa]
            first, second = (near_a, near) if selection else (near, near_a)
            for index, width in ((first, size), (second, size2)):
                fields += [(index[:, t], width - (t == 0)) for t in range(16)]
            bits = np.concatenate([(x[:, None] >> np.arange(n) & 1).astype(np.uint8) for x, n in fields], axis=1)
            found = np.packbits(bits, axis=1, bitorder="little")
            better = total < error
            best[better], error[better] = found[better], total[better]
    return best, error


def error_of(encoded: np.ndarray, blocks: np.ndarray) -> np.ndarray:
    return ((decode_bc7(encoded) - blocks.astype(np.int64)) ** 2).sum(axis=(1, 2))


def encode_bc7(blocks: np.ndarray, level: int = 6) -> np.ndarray:
    """BC7 blocks: mode 6 first, then the partition modes that suit a block, the first of equal errors."""
    best = bc7_mode6(blocks)
    tries = TRIES[min(10, max(1, level))]
    if not tries:
        return best
    error = error_of(best, blocks)
    opaque = (blocks[:, :, 3] == 255).all(axis=1)

    def consider(rows: np.ndarray, found: np.ndarray, e: np.ndarray) -> None:
        better = e < error[rows]
        best[rows[better]], error[rows[better]] = found[better], e[better]

    rows = np.flatnonzero(opaque)
    if len(rows):
        order = ranked(blocks[rows], 2, 64, 4, tries)
        for number in (1, 3):
            consider(rows, *best_of_mode(PartitionMode(number), blocks[rows], tries, order))
        for number in (0, 2) if tries >= THREE_FROM else ():
            consider(rows, *best_of_mode(PartitionMode(number), blocks[rows], tries))
    rows = np.flatnonzero(~opaque)
    if len(rows):
        for number in (5, 4):
            consider(rows, *separate_alpha(number, blocks[rows], 4 if tries >= THREE_FROM else 1))
        consider(rows, *best_of_mode(PartitionMode(7), blocks[rows], tries))
    return best
