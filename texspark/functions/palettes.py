"""Palettes of the S3TC and RGTC block formats, as steps over endpoint and index columns.

Column t (0 to 15) is the texel; c0, c1 are RGB565 endpoints, w the 32-bit index word,
a0, a1 alpha endpoints, aw the 48-bit alpha index word.
"""

from __future__ import annotations

from texspark.functions.expressions import Steps
from texspark.functions.pixels import UNPACK


def _rgb(column: str) -> list[str]:
    return [x.replace("w", column) for x in UNPACK["RGB565"][:3]]


def color(opaque: bool, prefix: str = "") -> Steps:
    """r, g, b, a of a colour block; opaque blocks always have four colours."""
    four = "true" if opaque else "c0 > c1"
    ends = {f"{ch}{k}": text for k in (0, 1) for ch, text in zip("rgb", _rgb(f"c{k}"), strict=True)}
    pick = lambda ch: (
        f"CASE WHEN i = 0 THEN {ch}0 WHEN i = 1 THEN {ch}1"
        f" WHEN {four} THEN (CASE WHEN i = 2 THEN (2 * {ch}0 + {ch}1 + 1) div 3 ELSE ({ch}0 + 2 * {ch}1 + 1) div 3 END)"
        f" WHEN i = 2 THEN ({ch}0 + {ch}1) div 2 ELSE 0 END"
    )
    alpha = "255" if opaque else f"CASE WHEN {four} OR i < 3 THEN 255 ELSE 0 END"
    return [ends | {"i": "(w >> (2 * CAST(t AS INT))) & 3"}, {ch: pick(ch) for ch in "rgb"} | {"a": alpha}]


def alpha(name: str, a0: str, a1: str, word: str) -> Steps:
    """An interpolated 8-bit alpha block as a column."""
    i = f"{name}_i"
    seven = f"((8 - {i}) * {a0} + ({i} - 1) * {a1} + 3) div 7"
    five = f"((6 - {i}) * {a0} + ({i} - 1) * {a1} + 2) div 5"
    return [
        {i: f"({word} >> (3 * CAST(t AS INT))) & 7"},
        {name: f"CASE WHEN {i} = 0 THEN {a0} WHEN {i} = 1 THEN {a1} WHEN {a0} > {a1} THEN {seven} WHEN {i} < 6 THEN {five} WHEN {i} = 6 THEN 0 ELSE 255 END"},
    ]


# 16.16 weights of the signed palette (first and second endpoint).
SIGNED_SEVEN = {2: (56173, 9363), 3: (46812, 18724), 4: (37450, 28086), 5: (28086, 37450), 6: (18724, 46812), 7: (9363, 56173)}
SIGNED_FIVE = {2: (52429, 13107), 3: (39321, 26215), 4: (26215, 39321), 5: (13107, 52429)}


def signed_alpha(name: str, a0: str, a1: str, word: str) -> Steps:
    """A signed alpha block as a column of 0..255; endpoints come as bytes of 0..255."""
    i, s0, s1, v = f"{name}_i", f"{name}_s0", f"{name}_s1", f"{name}_v"
    signed = lambda x: f"greatest({x} - (CASE WHEN {x} >= 128 THEN 256 ELSE 0 END), -127)"
    cases = lambda rows: " ".join(f"WHEN {i} = {k} THEN ({p} * {s0} + {q} * {s1} + 32768) >> 16" for k, (p, q) in rows.items())
    return [
        {i: f"({word} >> (3 * CAST(t AS INT))) & 7", s0: signed(a0), s1: signed(a1)},
        {v: f"CASE WHEN {i} = 0 THEN {s0} WHEN {i} = 1 THEN {s1} WHEN {s0} > {s1} THEN (CASE {cases(SIGNED_SEVEN)} END) ELSE (CASE {cases(SIGNED_FIVE)} WHEN {i} = 6 THEN -127 ELSE 127 END) END + 127"},
        {name: f"{v} + (({v} + 129) >> 8)"},
    ]


#: For each format: where its words stand in a block (name, offset, bytes), and the steps to r, g, b, a.
LAYOUTS: dict[str, tuple[list[tuple[str, int, int]], Steps]] = {
    "BC1": ([("c0", 0, 2), ("c1", 2, 2), ("w", 4, 4)], color(False)),
    "BC2": ([("alo", 0, 4), ("ahi", 4, 4), ("c0", 8, 2), ("c1", 10, 2), ("w", 12, 4)], [*color(True)[:1], color(True)[1] | {"a": "((CASE WHEN t < 8 THEN alo ELSE ahi END >> (4 * (CAST(t AS INT) % 8))) & 15) * 17"}]),
    "BC3": ([("a0", 0, 1), ("a1", 1, 1), ("aw", 2, 6), ("c0", 8, 2), ("c1", 10, 2), ("w", 12, 4)], [*alpha("al", "a0", "a1", "aw"), *color(True)[:1], color(True)[1] | {"a": "al"}]),
    "BC4": ([("a0", 0, 1), ("a1", 1, 1), ("aw", 2, 6)], [*alpha("r", "a0", "a1", "aw"), {"g": "r", "b": "r", "a": "255"}]),
    "BC5": ([("a0", 0, 1), ("a1", 1, 1), ("aw", 2, 6), ("b0", 8, 1), ("b1", 9, 1), ("bw", 10, 6)], [*alpha("r", "a0", "a1", "aw"), *alpha("g", "b0", "b1", "bw"), {"b": "0", "a": "255"}]),
    "BC4S": ([("a0", 0, 1), ("a1", 1, 1), ("aw", 2, 6)], [*signed_alpha("r", "a0", "a1", "aw"), {"g": "r", "b": "r", "a": "255"}]),
    "BC5S": ([("a0", 0, 1), ("a1", 1, 1), ("aw", 2, 6), ("b0", 8, 1), ("b1", 9, 1), ("bw", 10, 6)], [*signed_alpha("r", "a0", "a1", "aw"), *signed_alpha("g", "b0", "b1", "bw"), {"b": "0", "a": "255"}]),
}
