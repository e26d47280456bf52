"""DuckDB SQL of the encoders at their fastest level, of PSNR, and of BC7 and BC6H blocks.

The encoders and decoders under test work on arrays; here the same public formats are
written as rows: texels joined to their blocks' endpoints, layouts as inline tables.
"""

from __future__ import annotations

import re

from texspark.functions.expressions import duckdb
from texspark.functions.palettes import alpha, color, signed_alpha
from texspark.functions.pixels import to_snorm
from texspark.operators import bptc
from texspark.operators.encode import BALANCED, WEIGHTS

CELL = 'texture_id, bx, "by"'


def _sql(text: str) -> str:
    return text.replace(" div ", " // ")


def _le_hex(value: str, size: int) -> str:
    """An unsigned integer as little-endian bytes in upper-case hex."""
    return " || ".join(f"printf('%02X', (({value}) >> {8 * k}) & 255)" for k in range(size))


def _cells(texels: str, opaque: bool) -> str:
    alpha_ = "255" if opaque else "a::BIGINT"
    return f'(SELECT texture_id, x // 4 AS bx, y // 4 AS "by", y % 4 * 4 + x % 4 AS t, r::BIGINT AS r, g::BIGINT AS g, b::BIGINT AS b, {alpha_} AS a FROM {texels})'


def color_words(texels: str, clear: bool, flat: bool) -> str:
    """Colour blocks (texture_id, bx, by, c0, c1, w): the shrunk bounding box, and each texel's nearest entry."""
    cells = _cells(texels, not clear)
    box = f"(SELECT {CELL}, min(a) AS a_least, " + ", ".join(f"min({c}) AS {c}_least, max({c}) AS {c}_most" for c in "rgb") + f" FROM {cells} GROUP BY ALL)"
    shrunk = [{f"{c}_lo": f"least({c}_least + (({c}_most - {c}_least) >> 4), 255)" for c in "rgb"} | {f"{c}_hi": f"greatest({c}_most - (({c}_most - {c}_least) >> 4), 0)" for c in "rgb"}]
    shrunk += [{f"e_{n}": f"((r_{n} >> 3) << 11) + ((g_{n} >> 2) << 5) + (b_{n} >> 3)" for n in ("hi", "lo")}]
    shrunk += [{"clear": f"{clear} AND a_least < 128", "flat": f"{flat} AND r_least = r_most"}, {"c0": "CASE WHEN clear THEN least(e_hi, e_lo) ELSE greatest(e_hi, e_lo) END", "c1": "CASE WHEN clear THEN greatest(e_hi, e_lo) ELSE least(e_hi, e_lo) END"}]
    rows = f"(SELECT {CELL}, t, r AS p_r, g AS p_g, b AS p_b, a, c0, c1, clear, flat, 0 AS w FROM {cells} JOIN (SELECT {CELL}, c0, c1, clear, flat FROM {duckdb(box, shrunk)}) USING ({CELL}))"
    steps = color(False)
    entry = lambda k, c: f"(p_{c} - ({steps[1][c].replace('i = ', f'{k} = ')}))"
    weight = {c: f"CASE WHEN flat THEN {b} ELSE {a} END" for c, a, b in zip("rgb", WEIGHTS, BALANCED, strict=True)}
    errors = {f"e{k}": " + ".join(f"({weight[c]}) * {entry(k, c)} * {entry(k, c)}" for c in "rgb") for k in range(4)}
    index = "CASE WHEN clear AND a < 128 THEN 3 WHEN e0 <= e1 AND e0 <= e2 AND (clear OR e0 <= e3) THEN 0 WHEN e1 <= e2 AND (clear OR e1 <= e3) THEN 1 WHEN clear OR e2 <= e3 THEN 2 ELSE 3 END"
    return f"(SELECT {CELL}, c0, c1, sum(({index})::BIGINT << (2 * t)::INT)::BIGINT AS w FROM {duckdb(rows, [steps[0], errors])} GROUP BY {CELL}, c0, c1)"


def alpha_words(texels: str, channel: str, signed: bool = False, apart: bool = True) -> str:
    """Blocks of one channel (texture_id, bx, by, a0, a1, aw): largest and least value, and each texel's nearest entry."""
    value = f"({_sql(to_snorm(channel))})" if signed else channel
    value = f"CASE WHEN {value} >= 128 THEN {value} - 256 ELSE {value} END" if signed else value
    cells = f"(SELECT {CELL}, t, {value} AS v FROM {_cells(texels, False)})"
    ends = f"(SELECT {CELL}, max(v) AS hi, min(v) AS lo FROM {cells} GROUP BY ALL)"
    if signed:
        parted = {"hi_": "CASE WHEN hi = lo AND hi = -127 THEN -126 ELSE hi END", "lo_": "CASE WHEN hi = lo AND hi > -127 THEN lo - 1 ELSE lo END"}
    else:
        parted = {"hi_": "hi", "lo_": "CASE WHEN hi = lo THEN (CASE WHEN hi > 0 THEN hi - 1 ELSE 1 END) ELSE lo END" if apart else "lo"}
    ends = f"(SELECT {CELL}, hi_ & 255 AS a0, lo_ & 255 AS a1 FROM {duckdb(ends, [parted])})"
    steps = (signed_alpha if signed else alpha)("x", "a0", "a1", "aw")
    rows = duckdb(f"(SELECT {CELL}, t, v, a0, a1, 0 AS aw FROM {cells} JOIN {ends} USING ({CELL}))", steps[:1])
    entry = lambda k: f"(v - ({steps[1]['x_v' if signed else 'x'].replace('x_i', str(k))}){' + 127' if signed else ''})"
    rows = duckdb(rows, [{f"q{k}": f"{entry(k)} * {entry(k)}" for k in range(8)}, {"best": "least(" + ", ".join(f"q{k}" for k in range(8)) + ")"}])
    index = "CASE " + " ".join(f"WHEN q{k} = best THEN {k}" for k in range(8)) + " END"
    return f"(SELECT {CELL}, a0, a1, sum(({index})::BIGINT << (3 * t)::INT)::BIGINT AS aw FROM {rows} GROUP BY {CELL}, a0, a1)"


def encoded(name: str, texels: str) -> str:
    """Blocks (texture_id, bx, by, block in hex) of a format."""
    color_hex = " || ".join([_le_hex("c0", 2), _le_hex("c1", 2), _le_hex("w", 4)])
    alpha_hex = lambda s="": " || ".join([_le_hex(f"a0{s}", 1), _le_hex(f"a1{s}", 1), _le_hex(f"aw{s}", 6)])
    out = 'SELECT texture_id, bx::INT AS bx, "by"::INT AS "by", {} AS block FROM {}'
    if name == "BC1":
        return out.format(color_hex, color_words(texels, True, True))
    if name == "BC2":
        halves = f"(SELECT {CELL}, " + ", ".join(f"sum(CASE WHEN t {c} 8 THEN ((a + 8) // 17) << (4 * (t % 8))::INT ELSE 0 END)::BIGINT AS {n}" for n, c in (("alo", "<"), ("ahi", ">="))) + f" FROM {_cells(texels, False)} GROUP BY ALL)"
        return out.format(" || ".join([_le_hex("alo", 4), _le_hex("ahi", 4), color_hex]), f"{halves} JOIN {color_words(texels, False, False)} USING ({CELL})")
    if name == "BC3":
        return out.format(f"{alpha_hex()} || {color_hex}", f"{alpha_words(texels, 'a', apart=False)} JOIN {color_words(texels, False, True)} USING ({CELL})")
    signed = name.endswith("S")
    red = alpha_words(texels, "r", signed)
    if name.startswith("BC4"):
        return out.format(alpha_hex(), red)
    green = f"(SELECT {CELL}, a0 AS a0_g, a1 AS a1_g, aw AS aw_g FROM {alpha_words(texels, 'g', signed)})"
    return out.format(f"{alpha_hex()} || {alpha_hex('_g')}", f"{red} JOIN {green} USING ({CELL})")


def psnr_bc1(texels: str) -> str:
    """PSNR of BC1 blocks, decoded, against the texels, by the last digit of texture_id."""
    again = duckdb(f"(SELECT {CELL}, c0, c1, w, CAST(p AS INT) AS t FROM {color_words(texels, True, True)}, range(16) r(p))", color(False))
    square = " + ".join(f"(s.{c} - d.{c}) * (s.{c} - d.{c})" for c in "rgb")
    sums = f"(SELECT s.texture_id % 10 AS \"group\", sum({square})::DOUBLE AS s, count(*) AS n FROM {_cells(texels, False)} s JOIN {again} d USING ({CELL}, t) GROUP BY ALL)"
    return f"SELECT \"group\", round(10 * log10(65025.0::DOUBLE / (s / (3 * n))), 4) AS psnr FROM {sums}"


def _bits(words: list[tuple[str, int]]) -> str:
    """A block's bits as text of zeros and ones, the first bit first, and some zeros after them."""
    return " || ".join(f"reverse(lpad(bin(({value})::UBIGINT), {8 * size}, '0'))" for value, size in words) + " || '00000000'"


def _field(at: str, size: str) -> str:
    """The integer of `size` bits of the column bits from `at` on."""
    return f"(CASE WHEN {size} > 0 THEN ('0b' || reverse(substr(bits, ({at})::INT + 1, ({size})::INT)))::BIGINT ELSE 0 END)"


def _weights(size: str, index: str) -> str:
    return "CASE " + " ".join(f"WHEN {size} = {n} THEN [{', '.join(map(str, w.tolist()))}][{index} + 1]" for n, w in bptc.WEIGHTS.items()) + " END"


def _partitions() -> str:
    """Rows (subsets, partition, places, second anchor, third anchor) of all partitions; an anchor that is none is 99."""
    rows = [(1, 0, "0" * 16, 99, 99)]
    rows += [(2, k, p, a, 99) for k, (p, a) in enumerate(zip(bptc.TWO_SUBSETS, bptc.ANCHOR_OF_TWO, strict=True))]
    rows += [(3, k, p, a, b) for k, (p, a, b) in enumerate(zip(bptc.THREE_SUBSETS, bptc.ANCHOR_1_OF_THREE, bptc.ANCHOR_2_OF_THREE, strict=True))]
    return "(VALUES " + ", ".join(f"({s}, {k}, '{p}', {a}, {b})" for s, k, p, a, b in rows) + ") parts(subsets, part, places, second, third)"


#: An index's place before texel t, and whether the texel is an anchor.
_BEFORE, _ANCHOR = "((t > 0)::INT + (second < t)::INT + (third < t)::INT)", "(t = 0 OR t = second OR t = third)::INT"


def bc7_texels(keys: str, words: list[tuple[str, int]]) -> str:
    """Texels (k, t, r, g, b, a) of BC7 blocks with a mode, made from words over keys (k, c)."""
    modes = ", ".join(f"({m}, {s}, {p}, {r}, {i}, {cb}, {ab}, {0 if not pk else 2 * s if pk == 'endpoint' else s}, {n}, {n2})" for m, (s, p, r, i, cb, ab, pk, n, n2) in enumerate(bptc.BC7_MODES))
    blocks = f"(SELECT k, {_bits(words)} AS bits FROM {keys})"
    steps = [
        {"p_at": "mode + 1", "r_at": "mode + 1 + part_bits", "s_at": "mode + 1 + part_bits + turn_bits", "e_at": "mode + 1 + part_bits + turn_bits + pick_bits", "n": "2 * subsets"},
        {"part": _field("p_at", "part_bits"), "turn": _field("r_at", "turn_bits"), "pick": _field("s_at", "pick_bits"), "b_at": "e_at + 3 * n * color_bits + n * alpha_bits"},
        {"i_at": "b_at + n_p"},
    ]
    placed = f"(SELECT *, substr(places, t + 1, 1)::INT AS s FROM (SELECT blocks.*, places, second, third, CAST(p AS INT) AS t FROM {duckdb(f'(SELECT * FROM {blocks} JOIN (VALUES {modes}) m(mode, subsets, part_bits, turn_bits, pick_bits, color_bits, alpha_bits, n_p, size, size2) ON mode = instr(bits, chr(49)) - 1)', steps)} blocks JOIN {_partitions()} USING (subsets, part), range(16) r(p)))"
    ends: dict[str, str] = {}
    for e in (0, 1):
        p_bit = _field(f"b_at + (CASE WHEN n_p = n THEN 2 * s + {e} ELSE s END)", "(n_p > 0)::INT")
        for c, ch in enumerate("rgba"):
            width, at = ("color_bits", f"e_at + {c} * n * color_bits") if c < 3 else ("alpha_bits", "e_at + 3 * n * color_bits")
            ends[f"{ch}{e}_"] = f"({_field(f'{at} + (2 * s + {e}) * {width}', width)} << (n_p > 0)::INT) + {p_bit}"
    wide = {f"{ch}{e}": f"CASE WHEN {w} = 0 THEN 255 ELSE (({ch}{e}_ << (8 - {w} - (n_p > 0)::INT)) | (({ch}{e}_ << (8 - {w} - (n_p > 0)::INT)) >> ({w} + (n_p > 0)::INT))) END" for ch, w in (("r", "color_bits"), ("g", "color_bits"), ("b", "color_bits"), ("a", "alpha_bits")) for e in (0, 1)}
    index = {"i1": _field(f"i_at + size * t - {_BEFORE}", f"size - {_ANCHOR}"), "i2": _field("i_at + 16 * size - 1 + size2 * t - (t > 0)::INT", "CASE WHEN size2 > 0 THEN size2 - (t = 0)::INT ELSE 0 END")}
    weights = [{"w1": _weights("size", "i1"), "w2": f"CASE WHEN size2 > 0 THEN {_weights('size2', 'i2')} END"}, {"wc": "CASE WHEN size2 > 0 AND pick = 1 THEN w2 ELSE w1 END", "wa": "CASE WHEN size2 > 0 AND pick = 0 THEN w2 ELSE w1 END"}]
    mixed = {f"m_{ch}": f"({ch}0 * (64 - {w}) + {ch}1 * {w} + 32) >> 6" for ch, w in zip("rgba", ("wc", "wc", "wc", "wa"), strict=True)}
    out = ", ".join(f"CAST(CASE WHEN turn = {k} THEN m_a ELSE m_{ch} END AS INT) AS {ch}" for k, ch in enumerate("rgb", 1))
    return f"SELECT k, t, {out}, CAST(CASE turn WHEN 1 THEN m_r WHEN 2 THEN m_g WHEN 3 THEN m_b ELSE m_a END AS INT) AS a FROM {duckdb(placed, [ends, wide, index, *weights, mixed])}"


def bc6h_texels(keys: str, words: list[tuple[str, int]], signed: bool) -> str:
    """Texels (k, t, r16, g16, b16) of BC6H blocks, made from words over keys (k, c); reserved modes are zeros."""
    stored = ", ".join(f"({m}, {at}, '{name[0]}', {name[1:] or 0}, {bit})" for m, fields in enumerate(bptc.bc6h_fields()) for at, (name, bit) in enumerate(fields, bptc.BC6H_MODES[m][1]))
    modes = ", ".join(f"({m}, {code}, {2 if m < 10 else 1}, {width}, {dr}, {dg}, {db}, {str(m in bptc.BC6H_DIRECT).lower()}, {n + len(bptc.bc6h_fields()[m])}, {3 if m < 10 else 4})" for m, (code, n, width, (dr, dg, db), _) in enumerate(bptc.BC6H_MODES))
    blocks = f"(SELECT *, CASE WHEN low & 2 <> 0 THEN low & 31 ELSE low & 3 END AS code FROM (SELECT k, ({words[0][0]}) AS low, {_bits(words)} AS bits FROM {keys}))"
    known = f"(SELECT * FROM {blocks} JOIN (VALUES {modes}) m(mode, code, subsets, width, d_r, d_g, d_b, direct, i_at, size) USING (code))"
    names = [(f"{ch}{e}", ch.upper(), e) for ch in "rgb" for e in range(4)] + [("part", "P", 0)]
    sums = ", ".join(f"sum(CASE WHEN name = '{n}' AND e = {e} THEN v ELSE 0 END)::BIGINT AS {out}" for out, n, e in names)
    fields = f"(SELECT k, {sums} FROM (SELECT k, name, e, substr(bits, pos + 1, 1)::BIGINT << bit AS v FROM {known} JOIN (VALUES {stored}) f(mode, pos, name, e, bit) USING (mode)) GROUP BY k)"
    extend = lambda v, bits: f"(xor(({v}), 1::BIGINT << ({bits} - 1)) - (1::BIGINT << ({bits} - 1)))"
    first = {f"{ch}0_": extend(f"{ch}0", "width") if signed else f"{ch}0" for ch in "rgb"}
    delta = {f"{ch}{e}_": f"CASE WHEN direct AND NOT {str(signed).lower()} THEN {ch}{e} ELSE {extend(f'{ch}{e}', f'd_{ch}')} END" for ch in "rgb" for e in (1, 2, 3)}
    whole = {f"{ch}{e}__": f"(({ch}{e}_ + {ch}0_) & ((1::BIGINT << width) - 1))" for ch in "rgb" for e in (1, 2, 3)}
    summed = {f"{ch}{e}u": f"CASE WHEN direct THEN {ch}{e}_ ELSE {extend(f'{ch}{e}__', 'width') if signed else f'{ch}{e}__'} END" for ch in "rgb" for e in (1, 2, 3)} | {f"{ch}0u": f"{ch}0_" for ch in "rgb"}
    if signed:
        magnitude = lambda v: f"CASE WHEN abs({v}) >= (1::BIGINT << (width - 1)) - 1 THEN 32767 ELSE ((abs({v}) << 15) + 16384) >> (width - 1) END"
        quantised = lambda v: f"CASE WHEN width >= 16 OR {v} = 0 THEN {v} ELSE sign({v})::BIGINT * ({magnitude(v)}) END"
    else:
        quantised = lambda v: f"CASE WHEN width >= 15 OR {v} = 0 THEN {v} WHEN {v} = (1::BIGINT << width) - 1 THEN 65535 ELSE (({v} << 16) + 32768) >> width END"
    values = {f"{ch}{e}q": quantised(f"{ch}{e}u") for ch in "rgb" for e in range(4)}
    joined = duckdb(f"(SELECT * FROM {known} JOIN {fields} USING (k))", [first | delta, whole, summed, values])
    placed = f"(SELECT *, substr(places, t + 1, 1)::INT AS s FROM (SELECT b.*, places, second, third, CAST(p AS INT) AS t FROM {joined} b JOIN {_partitions()} USING (subsets, part), range(16) r(p)))"
    steps = [{"i1": _field(f"i_at + size * t - {_BEFORE}", f"size - {_ANCHOR}")}, {"w1": _weights("size", "i1")}]
    between = {f"m_{ch}": f"((CASE s WHEN 0 THEN {ch}0q ELSE {ch}2q END) * (64 - w1) + (CASE s WHEN 0 THEN {ch}1q ELSE {ch}3q END) * w1 + 32) >> 6" for ch in "rgb"}
    done = (lambda v: f"CASE WHEN (abs({v}) * 31) >> 5 > 0 AND {v} < 0 THEN 32768 ELSE 0 END + ((abs({v}) * 31) >> 5)") if signed else (lambda v: f"(({v}) * 31) >> 6")
    rows = duckdb(placed, [*steps, between])
    out = ", ".join(f"CAST({done(f'm_{ch}')} AS INT) AS {ch}16" for ch in "rgb")
    none = f"SELECT k, CAST(p AS INT) AS t, 0 AS r16, 0 AS g16, 0 AS b16 FROM {blocks}, range(16) r(p) WHERE code NOT IN ({', '.join(str(code) for code, *_ in bptc.BC6H_MODES)})"
    return f"SELECT k, t, {out} FROM {rows} UNION ALL {none}"


def farthest(texels: str, channels: str) -> str:
    """Each block's most distant texels: all pairs, the first of the largest."""
    square = " + ".join(f"(x.{c} - y.{c}) * (x.{c} - y.{c})" for c in channels)
    cells = _cells(texels, False)
    pairs = f'SELECT x.texture_id, x.bx, x."by", x.t AS i, y.t AS j, ({square})::BIGINT AS distance FROM {cells} x JOIN {cells} y ON x.texture_id = y.texture_id AND x.bx = y.bx AND x."by" = y."by" AND x.t < y.t'
    return f'SELECT texture_id, bx::INT AS bx, "by"::INT AS "by", i::INT AS i, j::INT AS j, distance FROM ({pairs}) QUALIFY row_number() OVER (PARTITION BY {CELL} ORDER BY distance DESC, i, j) = 1'


def ranked(texels: str, subsets: int, limit: int, partitions: int) -> str:
    """Each block's best partitions: distances to the cut mean, summed in a second pass over the texels."""
    channels = "rgba" if subsets == 2 else "rgb"
    rows = ", ".join(f"({k}, '{p}')" for k, p in enumerate((bptc.TWO_SUBSETS if subsets == 2 else bptc.THREE_SUBSETS)[:partitions]))
    member = f"(SELECT {CELL}, part, {', '.join(channels)}, substr(places, t + 1, 1) AS s FROM {_cells(texels, False)}, (VALUES {rows}) p(part, places))"
    means = f"(SELECT {CELL}, part, s, {', '.join(f'sum({c})::BIGINT // count(*) AS m_{c}' for c in channels)} FROM {member} GROUP BY ALL)"
    score = " + ".join(f"({c} - m_{c}) * ({c} - m_{c})" for c in channels)
    scored = f"(SELECT {CELL}, part, sum({score})::BIGINT AS score FROM {member} JOIN {means} USING ({CELL}, part, s) GROUP BY ALL)"
    return f'SELECT texture_id, bx::INT AS bx, "by"::INT AS "by", (row_number() OVER (PARTITION BY {CELL} ORDER BY score, part))::INT AS rank, part::INT AS part, score FROM {scored} QUALIFY rank <= {limit}'


def principal_ends(texels: str) -> str:
    """Extreme texels along the principal axis; the eight steps of the iteration one below the other."""
    cells = _cells(texels, False)
    mean = f"(SELECT {CELL}, {', '.join(f'avg({c}) AS m_{c}' for c in 'rgb')} FROM {cells} GROUP BY ALL)"
    pairs = ("rr", "rg", "rb", "gg", "gb", "bb")
    axis = f"(SELECT {CELL}, {', '.join(f'sum(({a} - m_{a}) * ({b} - m_{b})) AS {a}{b}' for a, b in pairs)}, 1.0::DOUBLE AS x0, 1.0::DOUBLE AS y0, 1.0::DOUBLE AS z0 FROM {cells} JOIN {mean} USING ({CELL}) GROUP BY ALL)"
    rows = dict(x=("rr", "rg", "rb"), y=("rg", "gg", "gb"), z=("rb", "gb", "bb"))
    steps = []
    for k in range(8):
        steps.append({f"v{n}{k}": f"{p} * x{k} + {q} * y{k} + {r} * z{k}" for n, (p, q, r) in rows.items()})
        steps.append({f"len{k}": f"sqrt(vx{k} * vx{k} + vy{k} * vy{k} + vz{k} * vz{k})"})
        steps.append({f"{n}{k + 1}": f"CASE WHEN len{k} < 1e-5 THEN {n}{k} ELSE v{n}{k} / len{k} END" for n in "xyz"})
    along = f"(SELECT {CELL}, t, r, g, b, r * x8 + g * y8 + b * z8 AS along FROM {cells} JOIN {duckdb(axis, steps)} USING ({CELL}))"
    first = lambda n, order: f"(SELECT {CELL}, t AS {n}_t, {', '.join(f'{c} AS {n}_{c}' for c in 'rgb')} FROM {along} QUALIFY row_number() OVER (PARTITION BY {CELL} ORDER BY along {order}, t) = 1)"
    both = f"(SELECT * FROM {first('lo', '')} JOIN {first('hi', 'DESC')} USING ({CELL}))"
    drawn = [{f"in_{c}": f"floor((hi_{c} - lo_{c}) / 16.0)::BIGINT" for c in "rgb"}, {f"l_{c}": f"greatest(0, least(255, lo_{c} + in_{c}))" for c in "rgb"} | {f"h_{c}": f"greatest(0, least(255, hi_{c} - in_{c}))" for c in "rgb"}]
    ends = duckdb(both, drawn)
    word = lambda n: f"({n}_r // 8 * 2048 + {n}_g // 4 * 32 + {n}_b // 8)::INT"
    return f'SELECT texture_id, bx::INT AS bx, "by"::INT AS "by", lo_t::INT AS lo_t, hi_t::INT AS hi_t, {word("h")} AS c0, {word("l")} AS c1 FROM {ends}'


def _seeds(transparent: bool) -> str:
    """Table seed (block, flat, clear, c0, c1) over cells: the shrunk bounding box; blocks with clear texels have the smaller word first."""
    word = lambda ends: f"({ends[0]} // 8 * 2048 + {ends[1]} // 4 * 32 + {ends[2]} // 8)::BIGINT"
    lo, hi = ([f"(min({c}) + (max({c}) - min({c})) // 16)" for c in "rgb"], [f"(max({c}) - (max({c}) - min({c})) // 16)" for c in "rgb"])
    clear = "min(a) < 128" if transparent else "false"
    return f"seed AS (SELECT {CELL}, flat, clear, CASE WHEN clear THEN least(h, l) ELSE greatest(h, l) END AS c0, CASE WHEN clear THEN greatest(h, l) ELSE least(h, l) END AS c1 FROM (SELECT {CELL}, min(r) = max(r) AS flat, {clear} AS clear, {word(hi)} AS h, {word(lo)} AS l FROM cells GROUP BY {CELL}))"


def _nearest(source: str, more: str = "") -> str:
    """Texels of cells beside the endpoints of a table (block, flat, clear, c0, c1): the nearest entry i and its error e, none for texels that are cut out."""
    palette = color(False)
    rows = f"(SELECT {CELL}, t, r AS p_r, g AS p_g, b AS p_b, clear AND a < 128 AS below, flat, clear, c0, c1{more}, 0 AS w FROM cells JOIN {source} USING ({CELL}) WHERE c0 IS NOT NULL)"
    entry = lambda i, c: f"(p_{c} - ({palette[1][c].replace('i = ', f'{i} = ')}))"
    errors = {f"e{i}": " + ".join(f"(CASE WHEN flat THEN {b} ELSE {a} END) * {entry(i, c)} * {entry(i, c)}" for c, a, b in zip("rgb", WEIGHTS, BALANCED, strict=True)) for i in range(4)}
    best = {"near": "CASE WHEN clear THEN least(e0, e1, e2) ELSE least(e0, e1, e2, e3) END"}
    return duckdb(rows, [{k: v for k, v in palette[0].items() if k != "i"}, errors, best, {"pick": "CASE WHEN below THEN 3 WHEN e0 = near THEN 0 WHEN e1 = near THEN 1 WHEN e2 = near THEN 2 ELSE 3 END", "e": "CASE WHEN below THEN 0 ELSE near END"}])


def _grid(tries: int) -> str:
    """Table grid: the best of the seeds and the first pairs of their neighbours by one level."""
    offsets = ", ".join(f"({k}, {k // 9 - 1}, {k // 3 % 3 - 1}, {k % 3 - 1})" for k in range(27))
    near = lambda c: f"(SELECT {CELL}, row_number() OVER (PARTITION BY {CELL} ORDER BY k) - 1 AS at, count(*) OVER (PARTITION BY {CELL}) AS wide, (({c} >> 11) + dr) * 2048 + ((({c} >> 5) & 63) + dg) * 32 + ({c} & 31) + db AS v FROM seed, (VALUES {offsets}) o(k, dr, dg, db) WHERE ({c} >> 11) + dr BETWEEN 0 AND 31 AND (({c} >> 5) & 63) + dg BETWEEN 0 AND 63 AND ({c} & 31) + db BETWEEN 0 AND 31)"
    pairs = f"SELECT {CELL}, x.at * y.wide + y.at AS p, x.v AS x, y.v AS y FROM {near('c0')} x JOIN {near('c1')} y USING ({CELL}) WHERE x.at * y.wide + y.at < {tries}"
    ordered = f"SELECT {CELL}, flat, clear, p, CASE WHEN clear THEN least(x, y) ELSE greatest(x, y) END AS c0, CASE WHEN clear THEN greatest(x, y) ELSE least(x, y) END AS c1 FROM ({pairs}) JOIN (SELECT {CELL}, flat, clear FROM seed) USING ({CELL})"
    tried = f"tried AS (SELECT {CELL}, flat, clear, -1 AS p, c0, c1 FROM seed UNION ALL {ordered})"
    scores = f"scores AS (SELECT {CELL}, flat, clear, p, c0, c1, sum(e) AS error FROM {_nearest('tried', ', p')} GROUP BY ALL)"
    return f"{tried}, {scores}, grid AS (SELECT {CELL}, flat, clear, c0, c1 FROM scores QUALIFY row_number() OVER (PARTITION BY {CELL} ORDER BY error, p) = 1)"


def _fitted(source: str, rounds: int) -> tuple[list[str], str]:
    """Tables of the rounds of least squares over a table of endpoints, and the last one: (block, flat, clear, best0, best1, best)."""
    word = lambda r, g, b: f"(({r}) // 8 * 2048 + ({g}) // 4 * 32 + ({b}) // 8)::BIGINT"
    parts = [f"round0 AS (SELECT {CELL}, flat, clear, c0, c1, NULL::BIGINT AS best0, NULL::BIGINT AS best1, NULL::BIGINT AS best FROM {source})"]
    for k in range(rounds + 1):
        shares = [{"y": "(CASE WHEN below OR pick = 0 THEN 0 WHEN pick = 1 THEN CASE WHEN clear THEN 2 ELSE 3 END WHEN pick = 2 THEN 1 ELSE 2 END)::BIGINT"}, {"x": "CASE WHEN below THEN 0 WHEN clear THEN 2 - y ELSE 3 - y END"}]
        sums = ", ".join([f"sum({a} * {b})::HUGEINT AS {a}{b}" for a, b in ("xx", "yy", "xy")] + [f"sum({a} * p_{c})::HUGEINT AS {a}{c}" for a in "xy" for c in "rgb"])
        parts.append(f"fit{k} AS (SELECT {CELL}, sum(e)::BIGINT AS error, {sums} FROM {duckdb(_nearest(f'round{k}'), shares)} GROUP BY {CELL})")
        parts.append(f"kept{k} AS (SELECT *, error IS NOT NULL AND (best IS NULL OR error < best) AS better, xx * yy - xy * xy AS det, CASE WHEN clear THEN 2 ELSE 3 END AS d FROM round{k} LEFT JOIN fit{k} USING ({CELL}))")
        solved = lambda own, other, c: f"d * ({own}{c} * {other}{other} - {other}{c} * xy)"
        near = lambda v: f"greatest(0, least(255, sign({v}) * ((abs({v}) + det // 2) // det)))::BIGINT"
        ends = [word(*(near(solved(own, other, c)) for c in "rgb")) for own, other in (("x", "y"), ("y", "x"))]
        parts.append(f"next{k} AS (SELECT {CELL}, flat, clear, CASE WHEN better THEN c0 ELSE best0 END AS best0, CASE WHEN better THEN c1 ELSE best1 END AS best1, CASE WHEN better THEN error ELSE best END AS best, CASE WHEN better AND error > 0 AND det <> 0 THEN {ends[0]} END AS q0, CASE WHEN better AND error > 0 AND det <> 0 THEN {ends[1]} END AS q1 FROM kept{k})")
        parts.append(f"order{k} AS (SELECT *, CASE WHEN clear THEN least(q0, q1) ELSE greatest(q0, q1) END AS o0, CASE WHEN clear THEN greatest(q0, q1) ELSE least(q0, q1) END AS o1 FROM next{k})")
        parts.append(f"round{k + 1} AS (SELECT {CELL}, flat, clear, best0, best1, best, CASE WHEN o0 <> best0 OR o1 <> best1 THEN o0 END AS c0, o1 AS c1 FROM order{k})")
    return parts, f"next{rounds}"


def _once(sql: str) -> str:
    """The text with its tables made once each, however often they are read."""
    return re.sub(r"\b(cells|seed|tried|scores|grid|(?:round|fit|kept|next|order)\d) AS \(SELECT", r"\1 AS MATERIALIZED (SELECT", sql)


def least_squares(texels: str, rounds: int = 2) -> str:
    """Endpoints of the shrunk bounding box, fitted again and again: a table of blocks for each round."""
    parts, last = _fitted("seed", rounds)
    return _once(f'WITH cells AS (SELECT * FROM {_cells(texels, False)}), {_seeds(False)}, {", ".join(parts)} SELECT texture_id, bx::INT AS bx, "by"::INT AS "by", best0::INT AS c0, best1::INT AS c1, best AS error FROM {last}')


def searched_bc1(texels: str, tries: int, rounds: int) -> str:
    """BC1 blocks (texture_id, bx, by, block in hex): the bounding box, its neighbours by one level, least squares."""
    parts, last = _fitted("grid", rounds)
    ends = f"(SELECT {CELL}, flat, clear, best0 AS c0, best1 AS c1 FROM {last})"
    words = f"(SELECT {CELL}, c0, c1, sum(pick::BIGINT << (2 * t)::INT)::BIGINT AS w FROM {_nearest(ends)} GROUP BY ALL)"
    block = " || ".join([_le_hex("c0", 2), _le_hex("c1", 2), _le_hex("w", 4)])
    return _once(f'WITH cells AS (SELECT * FROM {_cells(texels, False)}), {_seeds(True)}, {_grid(tries)}, {", ".join(parts)} SELECT texture_id, bx::INT AS bx, "by"::INT AS "by", {block} AS block FROM {words}')


def searched_payloads(texels: str, tries: int, rounds: int) -> str:
    """The same as payloads of surfaces: their bytes and digests."""
    return f'SELECT texture_id, (octet_length(unhex(string_agg(block, \'\' ORDER BY "by", bx))))::BIGINT AS bytes, sha256(unhex(string_agg(block, \'\' ORDER BY "by", bx))) AS digest FROM ({searched_bc1(texels, tries, rounds)}) GROUP BY texture_id'
