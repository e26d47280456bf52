"""Mip levels: a 2x2 grouped average of texel rows."""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from texspark.formats import mip_count

KEYS = ["texture_id", "face"]
#: Entries of the table from linear light back to sRGB.
SRGB_STEPS = 4096


def to_linear(v: int) -> float:
    """An sRGB byte as linear light, rounded to single precision."""
    c = v / 255
    return float(np.float32(c / 12.92 if c <= 0.04045 else ((c + 0.055) / 1.055) ** 2.4))


def from_linear(step: int) -> int:
    """Linear light (step / 4095) as an sRGB byte, halves away from zero."""
    c = step / (SRGB_STEPS - 1)
    return int((12.92 * c if c <= 0.0031308 else 1.055 * c ** (1 / 2.4) - 0.055) * 255 + 0.5)


def _table(values: Iterable[str]) -> Column:
    """An array of literals, as one expression."""
    return F.expr(f"array({', '.join(values)})")


def downscaled(texels: DataFrame, srgb: bool = False) -> DataFrame:
    """The next level of texels (texture_id, face, mip, width, height, x, y, r, g, b, a).

    An odd last row or column is dropped, unless it is the only one, which then counts
    twice. Alpha is always averaged as it is; with srgb the colours are averaged in
    linear light, looked up in two tables of 256 and 4,096 rows.
    """
    inside = texels.where("(width = 1 or x < 2 * (width div 2)) and (height = 1 or y < 2 * (height div 2))")
    weight = F.expr("CASE WHEN width = 1 THEN 2 ELSE 1 END * CASE WHEN height = 1 THEN 2 ELSE 1 END")
    values = {c: F.col(c).cast("double") for c in "rgb"}
    if srgb:
        inside = inside.withColumn("_linear", _table(f"{to_linear(v)!r}D" for v in range(256)))
        values = {c: F.get("_linear", F.col(c)) for c in "rgb"}
    keys = [*KEYS, (F.col("mip") + 1).alias("mip"), F.expr("greatest(1, width div 2)").cast("int").alias("width"), F.expr("greatest(1, height div 2)").cast("int").alias("height"), F.expr("x div 2").cast("int").alias("x"), F.expr("y div 2").cast("int").alias("y")]
    sums = inside.groupBy(*keys).agg(*(F.sum(values[c] * weight).alias(c) for c in "rgb"), F.sum(F.col("a") * weight).alias("a"))
    alpha = F.expr("CAST((a + 2) >> 2 AS INT)").alias("a")
    names = [*KEYS, "mip", "width", "height", "x", "y"]
    if not srgb:
        return sums.select(*names, *(F.expr(f"CAST((CAST({c} AS BIGINT) + 2) >> 2 AS INT)").alias(c) for c in "rgb"), alpha)
    back = _table(str(from_linear(k)) for k in range(SRGB_STEPS))
    step = lambda c: F.least(F.greatest(F.floor(F.col(c) * 0.25 * (SRGB_STEPS - 1) + 0.5).cast("int"), F.lit(0)), F.lit(SRGB_STEPS - 1))
    return sums.withColumn("_back", back).select(*names, *(F.get("_back", step(c)).alias(c) for c in "rgb"), alpha)


def mip_chain(texels: DataFrame, levels: int, srgb: bool = False) -> DataFrame:
    """texels of level 0 and the levels below it, `levels` in all at most (0 or less: the full chain).

    Textures that are down to one texel make no further level. Each level is a grouped
    average of the one before; their number is the logarithm of the largest side.
    """
    largest = texels.agg(F.max(F.greatest("width", "height")).alias("n")).first().n or 1
    full = mip_count(largest, largest)
    out, last = texels, texels
    for _ in range(1, min(full, levels) if levels > 0 else full):
        last = downscaled(last.where("width > 1 or height > 1"), srgb)
        out = out.unionByName(last)
    return out
