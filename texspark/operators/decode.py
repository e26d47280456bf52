"""Decode blocks and pixels to texel rows.

BC1 to BC5 and the uncompressed layouts are expressions in generated code: each block
makes its sixteen texels by a generator, and no row is shuffled. BC7 and BC6H join the
layout tables of texspark.operators.bptc_plans.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from texspark.formats import format_of
from texspark.functions import halves
from texspark.functions.expressions import apply, little_endian
from texspark.functions.palettes import LAYOUTS
from texspark.functions.pixels import UNPACK
from texspark.operators import bptc_plans


def decode_blocks(blocks: DataFrame, fmt: str, column: str = "block") -> DataFrame:
    """blocks with sixteen rows for each: t (0 to 15) and r, g, b, a, or for BC6H the half-float bits r16, g16, b16.

    A null block gives no rows; one of the wrong length raises an error.
    """
    name = format_of(fmt).name
    if not format_of(fmt).compressed:
        raise ValueError(f"{name} has no blocks")
    size = format_of(fmt).size
    keep = [c for c in blocks.columns if c != column]
    sound = blocks.where(F.col(column).isNotNull()).withColumn(column, F.when(F.length(column) == size, F.col(column)).otherwise(F.raise_error(F.lit(f"a {name} block has {size} bytes"))))
    if name not in LAYOUTS:
        return bptc_plans.decode_bc7(sound, column, keep) if name == "BC7" else bptc_plans.decode_bc6h(sound, name == "BC6HS", column, keep)
    words, steps = LAYOUTS[name]
    rows = sound.select(*keep, *(little_endian(F.col(column), at, n).alias(w) for w, at, n in words)).withColumn("t", F.explode(F.sequence(F.lit(0), F.lit(15))))
    return apply(rows, steps).select(*keep, "t", *(F.col(c).cast("int").alias(c) for c in "rgba"))


def decode_floats(blocks: DataFrame, fmt: str, column: str = "block") -> DataFrame:
    """BC6H blocks with sixteen rows for each: t and r, g, b as doubles."""
    texels = decode_blocks(blocks, fmt, column)
    return texels.select(*(c for c in texels.columns if c not in ("r16", "g16", "b16")), *(F.expr(halves.to_double(f"{c}16")).alias(c) for c in "rgb"))


def unpack_pixels(pixels: DataFrame, fmt: str, column: str = "w") -> DataFrame:
    """pixels with r, g, b, a from a little-endian word of an uncompressed layout."""
    return apply(pixels.withColumnRenamed(column, "w"), [dict(zip("rgba", (f"CAST({x} AS INT)" for x in UNPACK[format_of(fmt).name]), strict=True))]).withColumnRenamed("w", column)
