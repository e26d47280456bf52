"""Encode 4x4 blocks at the fastest level: bounding-box endpoints and nearest palette entries.

Blocks come as sixteen texel rows (keys, t, r, g, b, a). Endpoints are a grouped minimum
and maximum; indices are the first nearest palette entry of each texel, summed into the
index word by bit position. Two partial aggregations by block, no Python.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from texspark.formats import format_of
from texspark.functions.expressions import apply, to_bytes
from texspark.functions.palettes import alpha, color, signed_alpha
from texspark.functions.pixels import PACK, to_snorm

#: Error weights of red, green and blue, in 1,024ths: of a block in general, and of one whose red is constant.
WEIGHTS, BALANCED = (307, 614, 102), (341, 341, 341)


def _inset(texels: DataFrame, keys: list[str]) -> DataFrame:
    """Each block's packed endpoints: the bounding box, shrunk on each side by a sixteenth of its range."""
    box = texels.groupBy(*keys).agg(*(f(c).alias(f"{c}_{n}") for c in "rgb" for n, f in (("least", F.min), ("most", F.max))), F.min("a").alias("a_least"), F.max("a").alias("a_most"))
    step = [{f"{c}_in": f"({c}_most - {c}_least) >> 4" for c in "rgb"}, {f"{c}_lo": f"least({c}_least + {c}_in, 255)" for c in "rgb"} | {f"{c}_hi": f"greatest({c}_most - {c}_in, 0)" for c in "rgb"}]
    truncated = lambda n: f"((({'r_' + n} >> 3) << 11) | (({'g_' + n} >> 2) << 5) | ({'b_' + n} >> 3))"
    return apply(box, [*step, {"e_hi": truncated("hi"), "e_lo": truncated("lo")}])


def encode_bc1(texels: DataFrame, keys: list[str], threshold: int = 128, flat_weights: bool = True) -> DataFrame:
    """BC1 blocks (keys, block); a block with a texel of less alpha than the threshold has three colours and transparency."""
    ends = _inset(texels, keys).withColumn("clear", F.col("a_least") < threshold)
    larger, smaller = F.greatest("e_hi", "e_lo"), F.least("e_hi", "e_lo")
    ends = ends.select(*keys, "clear", F.when(F.col("clear"), smaller).otherwise(larger).cast("long").alias("c0"), F.when(F.col("clear"), larger).otherwise(smaller).cast("long").alias("c1"), F.expr("r_least = r_most" if flat_weights else "false").alias("flat"))
    return _with_indices(texels, ends, keys, threshold)


def _with_indices(texels: DataFrame, ends: DataFrame, keys: list[str], threshold: int) -> DataFrame:
    """Colour blocks from endpoints: for every texel the palette entry with least error, the first of equals.

    Blocks with transparency use three entries, and the fourth for texels below the threshold.
    """
    rows = texels.join(ends, keys).select(*keys, "t", "c0", "c1", "clear", "flat", "a", *(F.col(c).alias(f"p_{c}") for c in "rgb"))
    steps = color(False)
    rows = apply(rows.withColumn("w", F.lit(0).cast("long")), steps[:1])
    weights = (f"CASE WHEN flat THEN {b} ELSE {a} END" for a, b in zip(WEIGHTS, BALANCED, strict=True))
    rows = apply(rows, [dict(zip(("wr", "wg", "wb"), weights, strict=True))])
    for k in range(4):
        of = {c: steps[1][c].replace("i = ", f"{k} = ") for c in "rgb"}
        rows = apply(rows, [{f"d_{c}": f"p_{c} - ({of[c]})" for c in "rgb"}, {f"err{k}": "wr * d_r * d_r + wg * d_g * d_g + wb * d_b * d_b"}]).drop("d_r", "d_g", "d_b")
    best = f"CASE WHEN clear AND a < {threshold} THEN 3 WHEN err0 <= err1 AND err0 <= err2 AND (clear OR err0 <= err3) THEN 0 WHEN err1 <= err2 AND (clear OR err1 <= err3) THEN 1 WHEN clear OR err2 <= err3 THEN 2 ELSE 3 END"
    words = apply(rows, [{"_bits": f"CAST(({best}) AS BIGINT) << (2 * CAST(t AS INT))"}]).groupBy(*keys, "c0", "c1").agg(F.sum("_bits").alias("word"))
    return words.select(*keys, F.concat(to_bytes(F.col("c0"), 2), to_bytes(F.col("c1"), 2), to_bytes(F.col("word"), 4)).alias("block"))


def encode_bc2(texels: DataFrame, keys: list[str]) -> DataFrame:
    """BC2 blocks: four bits of alpha a texel, then a colour block without transparency, weighted by the default weights."""
    nibble = F.expr("CAST((a + 8) div 17 AS BIGINT) << (4 * (t % 8))")
    halves = texels.groupBy(*keys).agg(*(F.sum(F.when(part, nibble).otherwise(F.lit(0).cast("long"))).alias(n) for n, part in (("alo", F.col("t") < 8), ("ahi", F.col("t") >= 8))))
    colors = encode_bc1(texels.withColumn("a", F.lit(255)), keys, flat_weights=False).withColumnRenamed("block", "_color")
    return halves.join(colors, keys).select(*keys, F.concat(to_bytes(F.col("alo"), 4), to_bytes(F.col("ahi"), 4), F.col("_color")).alias("block"))


def encode_bc3(texels: DataFrame, keys: list[str]) -> DataFrame:
    """BC3 blocks: an interpolated alpha block, then a colour block without transparency."""
    colors = encode_bc1(texels.withColumn("a", F.lit(255)), keys).withColumnRenamed("block", "_color")
    return encode_alpha(texels, keys, part_of_bc3=True).join(colors, keys).select(*keys, F.concat("block", "_color").alias("block"))


def encode_bc5(texels: DataFrame, keys: list[str], signed: bool = False) -> DataFrame:
    """BC5 blocks: red, then green."""
    green = encode_alpha(texels, keys, "g", signed).withColumnRenamed("block", "_green")
    return encode_alpha(texels, keys, "r", signed).join(green, keys).select(*keys, F.concat("block", "_green").alias("block"))


def encode_blocks(texels: DataFrame, fmt: str, keys: list[str], threshold: int = 128) -> DataFrame:
    """Blocks (keys, block) of a format from sixteen texel rows each."""
    name = format_of(fmt).name
    makers = {
        "BC1": lambda: encode_bc1(texels, keys, threshold),
        "BC2": lambda: encode_bc2(texels, keys),
        "BC3": lambda: encode_bc3(texels, keys),
        "BC4": lambda: encode_alpha(texels, keys, "r"),
        "BC5": lambda: encode_bc5(texels, keys),
        "BC4S": lambda: encode_alpha(texels, keys, "r", True),
        "BC5S": lambda: encode_bc5(texels, keys, True),
    }
    if name not in makers:
        raise ValueError(f"no encoder for {name} yet")
    return makers[name]()


def encode_alpha(texels: DataFrame, keys: list[str], channel: str = "a", signed: bool = False, part_of_bc3: bool = False) -> DataFrame:
    """RGTC blocks (keys, block) of one channel: the largest and least value as endpoints, then indices.

    Equal endpoints are told apart by one, but not in the alpha of BC3.
    """
    value = F.expr(to_snorm(channel)) if signed else F.col(channel)
    value = F.when(value >= 128, value - 256).otherwise(value) if signed else value
    rows = texels.select(*keys, "t", value.alias("v"))
    ends = rows.groupBy(*keys).agg(F.max("v").alias("hi"), F.min("v").alias("lo"))
    if part_of_bc3:
        pass
    elif signed:
        ends = ends.selectExpr(*keys, "CASE WHEN hi = lo AND hi = -127 THEN -126 ELSE hi END AS hi", "CASE WHEN hi = lo AND hi > -127 THEN lo - 1 ELSE lo END AS lo")
    else:
        ends = ends.selectExpr(*keys, "hi", "CASE WHEN hi = lo THEN (CASE WHEN hi > 0 THEN hi - 1 ELSE 1 END) ELSE lo END AS lo")
    ends = ends.select(*keys, F.col("hi").bitwiseAND(255).alias("a0"), F.col("lo").bitwiseAND(255).alias("a1"))
    rows = rows.join(ends, keys).withColumn("aw", F.lit(0).cast("long"))
    steps = (signed_alpha if signed else alpha)("x", "a0", "a1", "aw")
    rows = apply(rows, steps[:1])
    for k in range(8):
        text = steps[1]["x_v" if signed else "x"].replace("x_i", str(k))
        rows = apply(rows, [{f"p{k}": f"v - ({text})" + (" + 127" if signed else "")}, {f"q{k}": f"p{k} * p{k}"}]).drop(f"p{k}")
    least = "least(" + ", ".join(f"q{k}" for k in range(8)) + ")"
    index = "CASE " + " ".join(f"WHEN q{k} = best THEN {k}" for k in range(8)) + " END"
    words = apply(rows, [{"best": least}, {"_bits": f"CAST(({index}) AS BIGINT) << (3 * CAST(t AS INT))"}]).groupBy(*keys, "a0", "a1").agg(F.sum("_bits").alias("word"))
    return words.select(*keys, F.concat(to_bytes(F.col("a0"), 1), to_bytes(F.col("a1"), 1), to_bytes(F.col("word"), 6)).alias("block"))


def pack_pixels(texels: DataFrame, fmt: str) -> DataFrame:
    """texels with w, the pixel's little-endian word in an uncompressed layout."""
    wide = texels.select(*(c for c in texels.columns if c not in "rgba"), *(F.col(c).cast("long").alias(c) for c in "rgba"))
    return apply(wide, [{"w": f"CAST({PACK[fmt]} AS BIGINT)"}])
