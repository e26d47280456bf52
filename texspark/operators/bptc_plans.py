"""BC7 and BC6H blocks to texel rows by layout tables, in generated code.

A block is two BIGINT columns. A broadcast table of the modes says where endpoints lie:
for BC7 as fields with P-bits, for BC6H as runs of scattered bits. They are made once for
a block. The table's rows, by mode and partition (some 300), also list the texels and where
their indices lie, which makes the block's sixteen rows. Nothing is shuffled. There is one
join, it comes first, and its keys can't be null: else Spark would push a test of them,
with all that they are made from, down to the scan, and take minutes to plan it.
"""

from __future__ import annotations

import functools

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from texspark.functions.bits128 import halves, read
from texspark.functions.expressions import Steps, apply
from texspark.operators import bptc

#: Where the weights of 2, 3 and 4 bits begin in one array of all.
WEIGHTS_AT = {2: 0, 3: 4, 4: 12}
_WEIGHTS = f"array({', '.join(str(w) for n in WEIGHTS_AT for w in bptc.WEIGHTS[n].tolist())})"


def _local(spark: SparkSession, rows: list[dict], ddl: str) -> DataFrame:
    """A small constant table as a local relation."""
    return spark.createDataFrame(pa.Table.from_pylist(rows), ddl)


@functools.lru_cache(maxsize=1)
def _partition_rows() -> list[dict]:
    """Each texel's subset, how many anchors stand before it, and whether it is one; 2,064 rows."""
    out = []
    for subsets in (1, 2, 3):
        subset, anchors = bptc.partitions(subsets)
        for part, (places, is_anchor) in enumerate(zip(subset.tolist(), anchors.tolist(), strict=True)):
            out += [{"subsets": subsets, "part": part, "t": t, "s": s, "before": sum(is_anchor[:t]), "anchor": int(is_anchor[t])} for t, s in enumerate(places)]
    return out


_FIELDS = "fields array<struct<at: int, size: int, p_at: int, p: int, width: int>>"
_TEXELS = "texels array<struct<t: int, s: int, i1_at: int, i1_size: int, w1_at: int, i2_at: int, i2_size: int, w2_at: int>>"


def bc7_layout(spark: SparkSession) -> DataFrame:
    """A row for each mode and partition (276): where rotation and index selection lie; the endpoints in the order of subset, end and channel, with their P-bits and full widths; and each texel's subset and indices. Mode 8 is none."""
    rows = []
    for mode, (subsets, part_bits, turn_bits, pick_bits, color, alpha, kind, size, size2) in enumerate([*bptc.BC7_MODES, (1, 0, 0, 0, 0, 0, "", 0, 0)]):
        turn_at = mode + 1 + part_bits
        e_at, n, has_p = turn_at + turn_bits + pick_bits, 2 * subsets, int(bool(kind))
        p_at = e_at + 3 * n * color + n * alpha
        i_at = p_at + (0 if not kind else n if kind == "endpoint" else subsets)
        ends = [
            {"at": e_at + c * n * color + e * bits, "size": bits, "p_at": p_at + (e if kind == "endpoint" else e // 2), "p": has_p, "width": bits + has_p if bits else 0}
            for e in range(n)
            for c, bits in enumerate((color, color, color, alpha))
        ]
        texels: dict[int, list[dict]] = {}
        for x in _partition_rows():
            if x["subsets"] == subsets and x["part"] < 1 << part_bits:
                first = {"i1_at": i_at + size * x["t"] - x["before"], "i1_size": size - x["anchor"], "w1_at": WEIGHTS_AT[size]} if size else {"i1_at": 0, "i1_size": 0, "w1_at": 0}
                second = {"i2_at": i_at + 16 * size - 1 + size2 * x["t"] - (x["t"] > 0), "i2_size": size2 - (x["t"] == 0), "w2_at": WEIGHTS_AT[size2]} if size2 else {"i2_at": 0, "i2_size": 0, "w2_at": -1}
                texels.setdefault(x["part"], []).append({"t": x["t"], "s": x["s"]} | first | second)
        rows += [{"mode": mode, "part": part, "turn_at": turn_at, "turn_bits": turn_bits, "pick_at": turn_at + turn_bits, "pick_bits": pick_bits, "fields": ends, "texels": own} for part, own in texels.items()]
    return _local(spark, rows, f"mode int, part int, turn_at int, turn_bits int, pick_at int, pick_bits int, {_FIELDS}, {_TEXELS}")


def _weight(at: str, index: str) -> str:
    return f"element_at({_WEIGHTS}, CAST({at} + {index} + 1 AS INT))"


#: From a block's halves to its mode and partition.
BC7_HEAD: Steps = [
    {"mode": "coalesce(CASE " + " ".join(f"WHEN lo & {1 << m} <> 0 THEN {m}" for m in range(8)) + " ELSE 8 END, 8)"},
    {"part": "coalesce(CAST(CASE mode WHEN 0 THEN " + read(1, 4) + " " + " ".join(f"WHEN {m} THEN {read(m + 1, 6)}" for m in (1, 2, 3, 7)) + " ELSE 0L END AS INT), 0)"},
]
#: From a block's halves and its layout to all endpoints as bytes, rotation and selection.
BC7_BLOCK: Steps = [
    {"raw": f"transform(fields, f -> shiftleft({read('f.at', 'f.size')}, f.p) | {read('f.p_at', 'f.p')})", "turn": read("turn_at", "turn_bits"), "pick": read("pick_at", "pick_bits")},
    {"ends": "zip_with(fields, raw, (f, v) -> CAST(CASE WHEN f.width = 0 THEN 255 ELSE shiftleft(v, 8 - f.width) | shiftright(shiftleft(v, 8 - f.width), f.width) END AS INT))"},
]
#: From a block's endpoints and a texel of the layout to r, g, b, a.
BC7_TEXEL: Steps = [
    {"w1": _weight("w1_at", read("i1_at", "i1_size")), "w2": f"CASE WHEN w2_at >= 0 THEN {_weight('w2_at', read('i2_at', 'i2_size'))} END"},
    {"wc": "CASE WHEN w2_at >= 0 AND pick = 1 THEN w2 ELSE w1 END", "wa": "CASE WHEN w2_at >= 0 AND pick = 0 THEN w2 ELSE w1 END"},
    {f"m_{c}": f"shiftright(element_at(ends, 8 * s + {k + 1}) * (64 - {w}) + element_at(ends, 8 * s + {k + 5}) * {w} + 32, 6)" for k, (c, w) in enumerate(zip("rgba", ("wc", "wc", "wc", "wa"), strict=True))},
    {c: f"CASE WHEN mode = 8 THEN 0 WHEN turn = {k} THEN m_a ELSE m_{c} END" for k, c in enumerate("rgb", 1)}
    | {"a": "CASE WHEN mode = 8 THEN 0 WHEN turn = 1 THEN m_r WHEN turn = 2 THEN m_g WHEN turn = 3 THEN m_b ELSE m_a END"},
]


def _held(blocks: DataFrame, column: str, keep: list[str]) -> tuple[DataFrame, list[str]]:
    """Blocks as halves; the columns to keep under names that no step uses."""
    lo, hi = halves(F.col(column))
    return blocks.select(*(F.col(c).alias(f"_keep_{c}") for c in keep), lo.alias("lo"), hi.alias("hi")), [f"_keep_{c}" for c in keep]


def decode_bc7(blocks: DataFrame, column: str, keep: list[str]) -> DataFrame:
    """Rows (keep, t, r, g, b, a); a block without a mode is transparent black."""
    rows, held = _held(blocks, column, keep)
    known = apply(apply(rows, BC7_HEAD).join(F.broadcast(bc7_layout(blocks.sparkSession)), ["mode", "part"]), BC7_BLOCK)
    texels = apply(known.select(*held, "lo", "hi", "mode", "turn", "pick", "ends", F.inline("texels")), BC7_TEXEL)
    return texels.select(*(F.col(h).alias(c) for h, c in zip(held, keep, strict=True)), "t", "r", "g", "b", "a")


#: The partition of a BC6H block with two subsets.
_PART_AT, _PART_BITS = 77, 5


def bc6h_layout(spark: SparkSession) -> DataFrame:
    """A row for each code and partition (328): sizes; for each endpoint channel the runs (at, size, shift) of its bits; and each texel's subset and index. Reserved codes have no sizes."""
    rows = []
    for mode, (code, code_bits, width, deltas, _) in enumerate(bptc.BC6H_MODES):
        runs: dict[str, list[list[int]]] = {}
        stored = bptc.bc6h_fields()[mode]
        for at, (name, bit) in enumerate(stored, code_bits):
            mine = runs.setdefault(name, [])
            if mine and mine[-1][0] + mine[-1][1] == at and mine[-1][2] + mine[-1][1] == bit:
                mine[-1][1] += 1
            else:
                mine.append([at, 1, bit])
        subsets, i_at, size = (2, code_bits + len(stored), 3) if mode < 10 else (1, code_bits + len(stored), 4)
        listed = {f"{c.lower()}{e}_runs": [dict(zip(("at", "size", "shift"), run, strict=True)) for run in runs.get(f"{c}{e}", [[0, 0, 0]])] for c in "RGB" for e in range(4)}
        texels: dict[int, list[dict]] = {}
        for x in _partition_rows():
            if x["subsets"] == subsets and x["part"] < 1 << _PART_BITS:
                texels.setdefault(x["part"], []).append({"t": x["t"], "s": x["s"], "i1_at": i_at + size * x["t"] - x["before"], "i1_size": size - x["anchor"], "w1_at": WEIGHTS_AT[size]})
        sizes = {"code": code, "width": width, "delta_r": deltas[0], "delta_g": deltas[1], "delta_b": deltas[2], "direct": int(mode in bptc.BC6H_DIRECT)}
        rows += [sizes | {"part": part} | listed | {"texels": own} for part, own in texels.items()]
    blank = [{"t": t, "s": 0, "i1_at": 0, "i1_size": 0, "w1_at": 0} for t in range(16)]
    rows += [dict.fromkeys(rows[0]) | {"code": code, "part": 0, "texels": blank} for code in range(32) if code & 2 and code not in {m[0] for m in bptc.BC6H_MODES}]
    kinds = {"texels": "array<struct<t: int, s: int, i1_at: int, i1_size: int, w1_at: int>>"}
    return _local(spark, rows, ", ".join(f"{n} {'array<struct<at: int, size: int, shift: int>>' if n.endswith('_runs') else kinds.get(n, 'int')}" for n in rows[0]))


def _gathered(runs: str) -> str:
    return f"aggregate({runs}, 0L, (v, x) -> v | shiftleft({read('x.at', 'x.size')}, x.shift))"


def _extended(v: str, bits: str) -> str:
    return f"(({v} ^ shiftleft(1L, {bits} - 1)) - shiftleft(1L, {bits} - 1))"


def bc6h_ends(signed: bool) -> Steps:
    """From a block's halves and its layout to the endpoints r0 to b3, ready for interpolation."""
    ends = [(c, e) for c in "rgb" for e in range(4)]
    raw = {f"{c}{e}r": _gathered(f"{c}{e}_runs") for c, e in ends}
    first = {f"{c}{e}f": f"{c}{e}r" if e == 0 and not signed else _extended(f"{c}0r", "width") if e == 0 else _extended(f"{c}{e}r", f"delta_{c}") if signed else f"CASE WHEN direct = 1 THEN {c}{e}r ELSE {_extended(f'{c}{e}r', f'delta_{c}')} END" for c, e in ends}
    moved = {f"{c}{e}m": f"{c}0f" if e == 0 else f"CASE WHEN direct = 1 THEN {c}{e}f ELSE ({c}{e}f + {c}0f) & (shiftleft(1L, width) - 1) END" for c, e in ends}
    whole = {f"{c}{e}u": f"CASE WHEN direct = 1 THEN {c}{e}m ELSE {_extended(f'{c}{e}m', 'width')} END" if signed and e else f"{c}{e}m" for c, e in ends}
    if signed:
        size = lambda v: f"CASE WHEN abs({v}) >= shiftleft(1L, width - 1) - 1 THEN 32767L ELSE shiftright(shiftleft(abs({v}), 15) + 16384, width - 1) END"
        full = lambda v: f"CASE WHEN width >= 16 OR {v} = 0 THEN {v} WHEN {v} < 0 THEN -({size(v)}) ELSE {size(v)} END"
    else:
        full = lambda v: f"CASE WHEN width >= 15 OR {v} = 0 THEN {v} WHEN {v} = shiftleft(1L, width) - 1 THEN 65535L ELSE shiftright(shiftleft({v}, 16) + 32768, width) END"
    return [raw, first, moved, whole, {f"{c}{e}": full(f"{c}{e}u") for c, e in ends}]


def bc6h_texel(signed: bool) -> Steps:
    """From endpoints and a texel of the layout to half-float bits."""
    done = (lambda v: f"CASE WHEN {v} < 0 AND shiftright(-{v} * 31, 5) > 0 THEN 32768 ELSE 0 END + shiftright(abs({v}) * 31, 5)") if signed else (lambda v: f"shiftright({v} * 31, 6)")
    return [
        {"w1": _weight("w1_at", read("i1_at", "i1_size"))},
        {f"m_{c}": f"shiftright(CASE s WHEN 0 THEN {c}0 ELSE {c}2 END * (64 - w1) + CASE s WHEN 0 THEN {c}1 ELSE {c}3 END * w1 + 32, 6)" for c in "rgb"},
        {f"{c}16": f"CAST({done(f'm_{c}')} AS INT)" for c in "rgb"},
    ]


def decode_bc6h(blocks: DataFrame, signed: bool, column: str, keep: list[str]) -> DataFrame:
    """Rows (keep, t, r16, g16, b16) of half-float bits; a reserved mode gives zeros."""
    rows, held = _held(blocks, column, keep)
    one = ", ".join(str(code) for code in range(32) if code & 2 and code not in {m[0] for m in bptc.BC6H_MODES[:10]})
    head = [{"code": "coalesce(CAST(CASE WHEN lo & 2 <> 0 THEN lo & 31 ELSE lo & 3 END AS INT), 0)"}, {"part": f"coalesce(CAST(CASE WHEN code IN ({one}) THEN 0L ELSE {read(_PART_AT, _PART_BITS)} END AS INT), 0)"}]
    known = apply(apply(rows, head).join(F.broadcast(bc6h_layout(blocks.sparkSession)), ["code", "part"]), bc6h_ends(signed))
    texels = apply(known.select(*held, "lo", "hi", *(f"{c}{e}" for c in "rgb" for e in range(4)), F.inline("texels")), bc6h_texel(signed))
    return texels.select(*(F.col(h).alias(c) for h, c in zip(held, keep, strict=True)), "t", *(F.coalesce(f"{c}16", F.lit(0)).alias(f"{c}16") for c in "rgb"))
