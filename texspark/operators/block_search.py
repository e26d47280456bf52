"""Searches within 4x4 blocks: texel rows grouped by block in one shuffle, or blocks as they come in none.

Texels come as sixteen rows of a block (keys, t, r, g, b, a); gathered() puts them into
one row each. Farthest texels and partition ranks are array operations over some thousand
blocks, where these are. The others are plans without Python: generators make rows of
pairs or texels of a block, aggregated by the same keys.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from texspark.functions.expressions import Steps, apply, to_bytes
from texspark.operators import bptc
from texspark.operators.encode import BALANCED, WEIGHTS

BLOCKS = 2048  # that one step handles


def gathered(texels: DataFrame, keys: list[str]) -> DataFrame:
    """Rows (keys, px): a block's texels in order."""
    return texels.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("t", "r", "g", "b", "a"))).alias("px"))


def _values(batch: pa.RecordBatch, channels: str) -> tuple[np.ndarray, np.ndarray]:
    """Channels (n, 16, channels) of a batch's blocks, and which blocks (n) lack no value (others count as 0)."""
    if "rgba" in batch.schema.names:
        data = batch.column("rgba")
        known = data.is_valid().to_numpy(zero_copy_only=False)
        raw = np.frombuffer(b"".join(data.fill_null(bytes(64)).to_pylist()), np.uint8)
        if len(raw) != 64 * len(known) or pc.any(pc.not_equal(pc.binary_length(data), 64)).as_py():
            raise ValueError("a block has sixteen texels of four bytes")
        return raw.reshape(-1, 16, 4)[:, :, ["rgba".index(c) for c in channels]].astype(np.int64), known
    px = batch.column("px")
    if px.null_count or pc.any(pc.not_equal(pc.list_value_length(px), 16)).as_py():
        raise ValueError("a block has sixteen texels")
    flat = px.flatten()
    columns = [pc.struct_field(flat, c).cast(pa.int64()) for c in channels]
    known = np.all([c.is_valid().to_numpy(zero_copy_only=False) for c in columns], axis=0).reshape(-1, 16).all(axis=1)
    return np.stack([c.fill_null(0).to_numpy() for c in columns], axis=1).reshape(-1, 16, len(channels)), known


def _searched(blocks: DataFrame, keys: list[str], channels: str, schema: str, rows: int, search: Callable[[np.ndarray], list[np.ndarray]]) -> DataFrame:
    """Columns that a search over arrays of blocks finds, each (n, rows) and the last one null for a block that lacks a value."""
    names = [f.name for f in StructType.fromDDL(schema).fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for k in range(0, whole.num_rows, BLOCKS):
                batch = whole.slice(k, BLOCKS)
                values, known = _values(batch, channels)
                found = search(np.where(known[:, None, None], values, 0))
                own = batch.select(keys).take(pa.array(np.repeat(np.arange(len(known)), rows))) if rows != 1 else batch.select(keys)
                columns = dict(zip(names, (x.ravel() for x in found), strict=True))
                columns |= {names[-1]: pa.array(columns[names[-1]], mask=~np.repeat(known, rows))}
                yield pa.record_batch({c: own.column(c) for c in keys} | columns)

    wide = StructType([*(blocks.schema[c] for c in keys), *StructType.fromDDL(schema).fields])
    return blocks.select(*keys, "rgba" if "rgba" in blocks.columns else "px").mapInArrow(run, wide)


def farthest_pairs(texels: DataFrame, keys: list[str], channels: str = "rgba") -> DataFrame:
    """farthest_in_blocks() of texel rows."""
    return farthest_in_blocks(gathered(texels, keys), keys, channels)


def farthest_in_blocks(blocks: DataFrame, keys: list[str], channels: str = "rgba") -> DataFrame:
    """Rows (keys, i, j, distance): each block's two most distant texels by squared error over the channels, the first of equal pairs; equal texels give 0 and 1.

    blocks: (keys, and px as gathered() makes it or the block's 64 bytes as rgba); no row
    is shuffled. A block that lacks a value gives 0, 1 and null.
    """
    first, second = np.triu_indices(16, 1)

    def search(v: np.ndarray) -> list[np.ndarray]:
        distance = sum((v[:, first, c] - v[:, second, c]) ** 2 for c in range(v.shape[2]))
        far = distance.argmax(axis=1)
        return [first[far].astype(np.int32), second[far].astype(np.int32), distance[np.arange(len(v)), far]]

    return _searched(blocks, keys, channels, "i int, j int, distance long", 1, search)


def partition_ranks(texels: DataFrame, keys: list[str], subsets: int = 2, limit: int = 8, partitions: int = 64) -> DataFrame:
    """partition_ranks_in_blocks() of texel rows."""
    return partition_ranks_in_blocks(gathered(texels, keys), keys, subsets, limit, partitions)


def partition_ranks_in_blocks(blocks: DataFrame, keys: list[str], subsets: int = 2, limit: int = 8, partitions: int = 64) -> DataFrame:
    """Rows (keys, rank, part, score): each block's `limit` best partitions into two (over r, g, b, a) or three subsets (over r, g, b).

    Score: the sum over subsets and channels of squared distances to the mean, which is
    cut to an integer; equal scores by number of partition. blocks: as in
    farthest_in_blocks(). A block that lacks a value has null scores.
    """
    if subsets not in (2, 3):
        raise ValueError("partitions have two or three subsets")
    table = bptc.partitions(subsets)[0][:partitions]
    inside = [(table == s).T for s in range(subsets)]
    rows = max(0, min(limit, len(table)))
    numbers = np.arange(len(table))

    def search(v: np.ndarray) -> list[np.ndarray]:
        # Floats are exact below 2**53; they are multiplied far faster.
        kind = np.float64 if np.abs(v).max(initial=0) < 1 << 20 else np.int64
        v = v.astype(kind)
        score = (v * v).sum(axis=(1, 2))[:, None]
        for member in inside:
            n = member.sum(axis=0).astype(kind)  # no subset of a partition is empty
            for c in range(v.shape[2]):
                total = v[:, :, c] @ member.astype(kind)
                mean = np.trunc(total / n) if kind is np.float64 else np.sign(total) * (np.abs(total) // n)
                score = score + mean * (n * mean - 2 * total)
        score = score.astype(np.int64)
        part = np.sort(score * 64 + numbers, axis=1)[:, :rows] & 63 if kind is np.float64 else np.argsort(score, axis=1, kind="stable")[:, :rows]
        return [np.broadcast_to(np.arange(1, rows + 1, dtype=np.int32), part.shape), part.astype(np.int32), np.take_along_axis(score, part, axis=1)]

    return _searched(blocks, keys, "rgba" if subsets == 2 else "rgb", "rank int, part int, score long", rows, search)


_CLAMP = "greatest(0, least(255, {}))"


def _rgb565(r: str, g: str, b: str) -> str:
    return f"(shiftleft(shiftright({r}, 3), 11) | shiftleft(shiftright({g}, 2), 5) | shiftright({b}, 3))"


def principal_ends(texels: DataFrame, keys: list[str]) -> DataFrame:
    """Rows (keys, lo_t, hi_t, c0, c1): each block's extreme texels along the principal axis of its colours, the first of equal ones, and RGB565 endpoints from them, drawn in by a sixteenth of their distance.

    The axis comes from eight steps of power iteration on the covariance, which is exact;
    a block of one colour keeps the grey axis.
    """
    return principal_in_blocks(gathered(texels, keys)).select(*keys, "lo_t", "hi_t", "c0", "c1")


def principal_in_blocks(blocks: DataFrame) -> DataFrame:
    """blocks (px as gathered() makes it, and others) with lo_t, hi_t, c0 and c1 of principal_ends(), found in the block's own row."""
    products = [f"{a}{b}" for a, b in ("rr", "rg", "rb", "gg", "gb", "bb")]
    sums = [f"s{c}" for c in "rgb"] + [f"s{p}" for p in products]
    terms = [f"x.{c}" for c in "rgb"] + [f"CAST(x.{p[0]} AS BIGINT) * x.{p[1]}" for p in products]
    total = "aggregate(px, named_struct(" + ", ".join(f"'{n}', 0L" for n in sums) + "), (s, x) -> named_struct(" + ", ".join(f"'{n}', s.{n} + {t}" for n, t in zip(sums, terms, strict=True)) + "))"
    length = "sqrt(v.x * v.x + v.y * v.y + v.z * v.z)"
    moved = "named_struct('x', rr * u.x + rg * u.y + rb * u.z, 'y', rg * u.x + gg * u.y + gb * u.z, 'z', rb * u.x + gb * u.y + bb * u.z)"
    unit = "named_struct(" + ", ".join(f"'{c}', CASE WHEN {length} < 1E-5D THEN u.{c} ELSE v.{c} / {length} END" for c in "xyz") + ")"
    axis = f"aggregate(sequence(1, 8), named_struct('x', 1D, 'y', 1D, 'z', 1D), (u, k) -> transform(array({moved}), v -> {unit})[0])"
    along = lambda t: f"transform(px, x -> named_struct('along', x.r * axis.x + x.g * axis.y + x.b * axis.z, 't', {t}, 'r', x.r, 'g', x.g, 'b', x.b))"
    steps: Steps = [
        {"total": total},
        {p: f"CAST(16 * total.s{p} - total.s{p[0]} * total.s{p[1]} AS DOUBLE) / 16" for p in products},
        {"axis": axis},
        {"lo": f"array_min({along('x.t')})", "hi": f"array_max({along('-x.t')})"},
        {f"in_{c}": f"shiftright(hi.{c} - lo.{c}, 4)" for c in "rgb"},
        {f"lo_{c}": _CLAMP.format(f"lo.{c} + in_{c}") for c in "rgb"} | {f"hi_{c}": _CLAMP.format(f"hi.{c} - in_{c}") for c in "rgb"},
    ]
    return apply(blocks, steps).selectExpr(*blocks.columns, "CAST(lo.t AS INT) AS lo_t", "CAST(-hi.t AS INT) AS hi_t", f"CAST({_rgb565('hi_r', 'hi_g', 'hi_b')} AS INT) AS c0", f"CAST({_rgb565('lo_r', 'lo_g', 'lo_b')} AS INT) AS c1")


def _ordered(c0: str, c1: str, first: str, second: str) -> dict[str, str]:
    """Endpoints in the order of their block: the smaller word first if it has transparent texels, else the larger."""
    return {first: f"CASE WHEN clear THEN least({c0}, {c1}) ELSE greatest({c0}, {c1}) END", second: f"CASE WHEN clear THEN greatest({c0}, {c1}) ELSE least({c0}, {c1}) END"}


def _texels(threshold: int | None) -> Steps:
    """Of a block (px): flat, whether its red is constant; clear, whether it has texels of less alpha than the threshold; seen, its other texels; and sums of these, error weights included."""
    seen = "px" if threshold is None else f"filter(px, x -> NOT coalesce(x.a < {threshold}, false))"
    weight = {f"w_{c}": f"CASE WHEN flat THEN {b}L ELSE {a}L END" for c, a, b in zip("rgb", WEIGHTS, BALANCED, strict=True)}
    total = lambda text: f"aggregate(seen, 0L, (s, x) -> s + {text})"
    return [
        {"flat": "aggregate(px, true, (same, x) -> same AND x.r = px[0].r)", "seen": f"transform({seen}, x -> named_struct({', '.join(f'{chr(39)}{c}{chr(39)}, CAST(x.{c} AS BIGINT)' for c in 'rgb')}))"},
        weight | {"clear": "size(seen) < size(px)", "n": "CAST(size(seen) AS BIGINT)"} | {f"sum_{c}": total(f"x.{c}") for c in "rgb"},
        {"squares": total(" + ".join(f"w_{c} * x.{c} * x.{c}" for c in "rgb"))},
    ]


_STATE = ["flat", "clear", "seen", "w_r", "w_g", "w_b", "n", "sum_r", "sum_g", "sum_b", "squares"]


def _palettes(ends: str) -> str:
    """SQL of an array of palettes from an array of endpoints (c0, c1): a texel's error to entry k is q<k> less the products of its channels with r<k>, g<k>, b<k>, but for its own square. An entry that the block can't use is out of reach."""
    place, top = {"r": (11, 31), "g": (5, 63), "b": (0, 31)}, {}
    for c, (at, most) in place.items():
        for k in (0, 1):
            top[f"{c}{k}"] = f"((shiftright(x.c{k}, {at}) & {most}) * 255 + {most // 2}) div {most}"
    fields = lambda columns: "named_struct('c0', x.c0, 'c1', x.c1, " + ", ".join(f"'{n}', {t}" for n, t in columns.items()) + ")"
    mixed = {f"{c}{k}": f"x.{c}{k}" for c in "rgb" for k in (0, 1)}
    for c in "rgb":
        mixed[f"{c}2"] = f"CASE WHEN x.c0 > x.c1 THEN (2 * x.{c}0 + x.{c}1 + 1) div 3 ELSE (x.{c}0 + x.{c}1) div 2 END"
        mixed[f"{c}3"] = f"CASE WHEN x.c0 > x.c1 THEN (x.{c}0 + 2 * x.{c}1 + 1) div 3 ELSE 0L END"
    last = {f"{c}{k}": f"2 * w_{c} * x.{c}{k}" for c in "rgb" for k in range(4)}
    last |= {f"q{k}": " + ".join(f"w_{c} * x.{c}{k} * x.{c}{k}" for c in "rgb") + (f" + CASE WHEN clear THEN {1 << 40} ELSE 0 END" if k == 3 else "") for k in range(4)}
    for columns in (top, mixed, last):
        ends = f"transform({ends}, x -> {fields(columns)})"
    return ends


def _error(palette: str, k: int) -> str:
    return f"{palette}.q{k} - x.r * {palette}.r{k} - x.g * {palette}.g{k} - x.b * {palette}.b{k}"


_PAIR = "array(named_struct('c0', c0, 'c1', c1))"
_NEAREST = "CASE WHEN x.e0 <= x.e1 AND x.e0 <= x.e2 AND x.e0 <= x.e3 THEN 0 WHEN x.e1 <= x.e2 AND x.e1 <= x.e3 THEN 1 WHEN x.e2 <= x.e3 THEN 2 ELSE 3 END"


def neighbour_ends(blocks: DataFrame, keys: list[str], tries: int, step: int = 1, threshold: int | None = None) -> DataFrame:
    """Rows (keys, c0, c1, error): the best of a block's endpoints and the first `tries` pairs of their neighbours, the first of equal ones.

    blocks: (keys, px as gathered() makes it, c0, c1). Neighbours differ by up to `step`
    levels in each channel and stay in range; they come in order of red, green and blue,
    and those of the second endpoint change fastest. threshold: as in encode_bc1().
    """
    return _neighbours(apply(blocks.select(*keys, "px", "c0", "c1"), _texels(threshold)), tries, step).selectExpr(*keys, "CAST(c0 AS INT) AS c0", "CAST(c1 AS INT) AS c1", "error")


def _neighbours(state: DataFrame, tries: int, step: int) -> DataFrame:
    """state (px, c0, c1 and _STATE) with the best neighbours as c0 and c1, and their error."""
    rest = [c for c in state.columns if c not in ("c0", "c1", "error")]
    steps: Steps = [{n: f"CAST({t} AS BIGINT)" for n, t in _ordered("c0", "c1", "s0", "s1").items()}]
    levels = {"r": (11, 31), "g": (5, 63), "b": (0, 31)}
    value = lambda k, c: f"(shiftright(s{k}, {levels[c][0]}) & {levels[c][1]})"
    # Neighbours in range are a box: its least levels and its sides.
    steps += [{f"least{k}_{c}": f"greatest({value(k, c)} - {step}, 0)" for k in (0, 1) for c in "rgb"}, {f"side{k}_{c}": f"least({value(k, c)} + {step}, {levels[c][1]}) - least{k}_{c} + 1" for k in (0, 1) for c in "rgb"}]
    steps += [{f"wide{k}": f"side{k}_r * side{k}_g * side{k}_b" for k in (0, 1)}]
    at = lambda k, i: f"(shiftleft(least{k}_r + {i} div (side{k}_g * side{k}_b), 11) | shiftleft(least{k}_g + {i} div side{k}_b % side{k}_g, 5) | (least{k}_b + {i} % side{k}_b))"
    pair = f"named_struct('a', CASE WHEN p < 0 THEN s0 ELSE {at(0, '(p div wide1)')} END, 'b', CASE WHEN p < 0 THEN s1 ELSE {at(1, '(p % wide1)')} END)"
    ordered = ", ".join(f"'{n}', {t}" for n, t in _ordered("x.a", "x.b", "c0", "c1").items())
    ends = f"transform(transform(sequence(-1L, least({tries}L, wide0 * wide1) - 1), p -> {pair}), x -> named_struct({ordered}))"
    error = "aggregate(seen, squares, (s, x) -> s + least(" + ", ".join(_error("e", k) for k in range(4)) + "))"
    steps += [{"best": f"array_min(transform({_palettes(ends)}, (e, i) -> named_struct('error', {error}, 'i', i, 'c0', e.c0, 'c1', e.c1)))"}]
    return apply(state.selectExpr(*rest, "c0", "c1"), steps).selectExpr(*rest, "best.c0 AS c0", "best.c1 AS c1", "best.error AS error")


def least_squares_ends(blocks: DataFrame, keys: list[str], rounds: int = 2, threshold: int | None = None) -> DataFrame:
    """Rows (keys, c0, c1, error): BC1 endpoints fitted by least squares.

    blocks: (keys, px as gathered() makes it, c0, c1). In a round, texels take their
    nearest palette entry, the normal equations of that choice give new endpoints, and
    these are kept if the weighted error falls; a block whose error no longer falls, or is
    zero, or whose texels all chose one entry, stays as it is. threshold: as in
    encode_bc1(); None treats all blocks as opaque.
    """
    return _fitted(apply(blocks.select(*keys, "px", "c0", "c1"), _texels(threshold)), rounds).selectExpr(*keys, "CAST(c0 AS INT) AS c0", "CAST(c1 AS INT) AS c1", "error")


def _fitted(state: DataFrame, rounds: int) -> DataFrame:
    """state (px, c0, c1 and _STATE) with fitted c0 and c1, and their error."""
    rest = [c for c in state.columns if c not in ("c0", "c1", "error")]
    own = [*rest, "best0", "best1", "best_error"]
    state = apply(state.selectExpr(*rest, "c0 AS s0", "c1 AS s1"), [{n: f"CAST({t} AS BIGINT)" for n, t in _ordered("s0", "s1", "c0", "c1").items()} | {n: "CAST(NULL AS BIGINT)" for n in ("best0", "best1", "best_error")}])
    # y: how many of d parts of the second endpoint the nearest entry has; x, of the first, is what is left.
    parts = f"CASE WHEN clear THEN array(0L, 2L, 1L, 0L) ELSE array(0L, 3L, 1L, 2L) END[{_NEAREST}]"
    sums = {"error": "x.e", "y": "x.y", "yy": "x.y * x.y"} | {f"y{c}": f"x.y * x.{c}" for c in "rgb"}
    rounded = lambda n, d: f"CASE WHEN {n} < 0 THEN -((-{n} + {d} div 2) div {d}) ELSE ({n} + {d} div 2) div {d} END"
    for last in [False] * rounds + [True]:
        near = "transform(seen, x -> named_struct('r', x.r, 'g', x.g, 'b', x.b, " + ", ".join(f"'e{k}', {_error('palette', k)}" for k in range(4)) + "))"
        chosen = f"transform({near}, x -> named_struct('r', x.r, 'g', x.g, 'b', x.b, 'e', least(x.e0, x.e1, x.e2, x.e3), 'y', {'0L' if last else parts}))"
        summed = f"aggregate({chosen}, named_struct({', '.join(f'{chr(39)}{n}{chr(39)}, ' + ('squares' if n == 'error' else '0L') for n in sums)}), (s, x) -> named_struct({', '.join(f'{chr(39)}{n}{chr(39)}, s.{n} + {t}' for n, t in sums.items())}))"
        # A block that stays as it is has no candidate: its c0 is null.
        state = apply(state, [{"palette": f"CASE WHEN c0 IS NOT NULL THEN {_palettes(_PAIR)}[0] END"}, {"sums": f"CASE WHEN c0 IS NOT NULL THEN {summed} END"}, {"better": "c0 IS NOT NULL AND (best_error IS NULL OR sums.error < best_error)"}])
        taken = state.selectExpr(*rest, "sums", "better", *(f"CASE WHEN better THEN {new} ELSE {old} END AS {old}" for old, new in (("best0", "c0"), ("best1", "c1"), ("best_error", "sums.error"))))
        if last:
            return taken.selectExpr(*rest, "best0 AS c0", "best1 AS c1", "best_error AS error")
        steps: Steps = [
            {"d": "CASE WHEN clear THEN 2L ELSE 3L END", "s_yy": "sums.yy"} | {f"s_y{c}": f"sums.y{c}" for c in "rgb"},
            {"s_xx": "d * d * n - 2 * d * sums.y + s_yy", "s_xy": "d * sums.y - s_yy"} | {f"s_x{c}": f"d * sum_{c} - s_y{c}" for c in "rgb"},
            {"det": "CASE WHEN better AND best_error > 0 AND s_xx * s_yy <> s_xy * s_xy THEN s_xx * s_yy - s_xy * s_xy END"},
            {f"n0_{c}": f"d * (s_x{c} * s_yy - s_y{c} * s_xy)" for c in "rgb"} | {f"n1_{c}": f"d * (s_y{c} * s_xx - s_x{c} * s_xy)" for c in "rgb"},
            {f"v{e}_{c}": _CLAMP.format(rounded(f"n{e}_{c}", "det")) for e in (0, 1) for c in "rgb"},
            {f"f{e}": f"CASE WHEN det IS NOT NULL THEN {_rgb565(f'v{e}_r', f'v{e}_g', f'v{e}_b')} END" for e in (0, 1)},
            _ordered("f0", "f1", "o0", "o1"),
            {"n0": "CASE WHEN NOT (o0 = best0 AND o1 = best1) THEN o0 END"},
        ]
        state = apply(taken, steps).selectExpr(*own, "n0 AS c0", "CASE WHEN n0 IS NOT NULL THEN o1 END AS c1")
    raise AssertionError


def box_ends(blocks: DataFrame) -> DataFrame:
    """blocks (px and others) with c0 and c1: the bounding box, drawn in by a sixteenth of its sides."""
    ends = {f"{n}_{c}": f"CAST(array_{f}(transform(px, x -> x.{c})) AS INT)" for c in "rgb" for n, f in (("lo", "min"), ("hi", "max"))}
    drawn = {f"{n}{c}": f"{n}_{c} {sign} shiftright(hi_{c} - lo_{c}, 4)" for c in "rgb" for n, sign in (("lo", "+"), ("hi", "-"))}
    return apply(blocks, [ends, drawn]).selectExpr(*blocks.columns, f"{_rgb565('hir', 'hig', 'hib')} AS c0", f"{_rgb565('lor', 'log', 'lob')} AS c1")


def encode_bc1(texels: DataFrame, keys: list[str], axis: bool = False, tries: int = 8, step: int = 1, rounds: int = 2, threshold: int = 128) -> DataFrame:
    """encode_bc1_blocks() of texel rows."""
    return encode_bc1_blocks(gathered(texels, keys), keys, axis, tries, step, rounds, threshold)


def encode_bc1_blocks(blocks: DataFrame, keys: list[str], axis: bool = False, tries: int = 8, step: int = 1, rounds: int = 2, threshold: int = 128) -> DataFrame:
    """BC1 blocks (keys, block): endpoints from the bounding box or the principal axis, their neighbours, then least squares.

    The parameters are those of search.LEVELS; level 2 by default. A block with a texel of
    less alpha than the threshold has three colours and transparency. blocks: (keys, px as
    gathered() makes it). All happens in a block's own row: none is shuffled, and memory
    does not grow with the blocks.
    """
    own = blocks.select(*keys, "px")
    state = apply((principal_in_blocks(own) if axis else box_ends(own)).select(*keys, "px", "c0", "c1"), _texels(threshold))
    if tries:
        state = _neighbours(state, tries, step)
    state = apply(_fitted(state, rounds), [{"palette": f"{_palettes(_PAIR)}[0]"}])
    errors = "transform(px, x -> named_struct('t', x.t, 'below', " + f"coalesce(x.a < {threshold}, false), " + ", ".join(f"'e{k}', {_error('palette', k)}" for k in range(4)) + "))"
    word = f"aggregate({errors}, 0L, (s, x) -> s | shiftleft(CAST(CASE WHEN x.below THEN 3 ELSE {_NEAREST} END AS BIGINT), 2 * CAST(x.t AS INT)))"
    return apply(state, [{"word": word}]).select(*keys, F.concat(to_bytes(F.col("c0"), 2), to_bytes(F.col("c1"), 2), to_bytes(F.col("word"), 4)).alias("block"))
