"""Between surfaces (one payload per face and mip level), blocks and texels."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from texspark.formats import format_of
from texspark.functions.expressions import little_endian

SURFACE = ["texture_id", "face", "mip", "width", "height"]


def level_extent(extent: Column, mip: Column) -> Column:
    """Width or height of a mip level: halved for each level, never below 1."""
    return F.greatest(F.lit(1), F.floor(extent / F.pow(F.lit(2), mip)).cast("int"))


def to_blocks(surfaces: DataFrame, fmt: str) -> DataFrame:
    """Rows (texture_id, face, mip, width, height, block_id, bx, by, block) of compressed surfaces (… payload).

    block_id counts row by row. Bytes after the last block are ignored; a payload that is
    too short raises an error.
    """
    size = format_of(fmt).size
    wide, high = F.ceil(F.col("width") / 4).cast("int"), F.ceil(F.col("height") / 4).cast("int")
    sized = surfaces.withColumn("_n", wide * high).withColumn("_wide", wide)
    sized = sized.where(F.when(F.length("payload") >= F.col("_n") * size, True).otherwise(F.raise_error(F.lit(f"payload is shorter than its {fmt} blocks"))))
    rows = sized.select(*SURFACE, "payload", "_wide", F.explode(F.sequence(F.lit(0), F.col("_n") - 1)).alias("block_id"))
    return rows.select(*SURFACE, "block_id", (F.col("block_id") % F.col("_wide")).alias("bx"), F.floor(F.col("block_id") / F.col("_wide")).cast("int").alias("by"), F.substring(F.col("payload"), F.col("block_id") * size + 1, F.lit(size)).alias("block"))


def to_pixels(surfaces: DataFrame, fmt: str) -> DataFrame:
    """Rows (texture_id, face, mip, width, height, x, y, w) of uncompressed surfaces; w is the pixel's word."""
    size = format_of(fmt).size
    rows = surfaces.select(*SURFACE, "payload", F.explode(F.sequence(F.lit(0), F.col("width") * F.col("height") - 1)).alias("_p"))
    pixel = F.substring(F.col("payload"), F.col("_p") * size + 1, F.lit(size))
    return rows.select(*SURFACE, (F.col("_p") % F.col("width")).alias("x"), F.floor(F.col("_p") / F.col("width")).cast("int").alias("y"), little_endian(pixel, 0, size).alias("w"))


def placed(texels: DataFrame) -> DataFrame:
    """Texels of blocks (bx, by, t) at their x and y; those beyond the edge are dropped."""
    x, y = F.col("bx") * 4 + F.col("t") % 4, F.col("by") * 4 + F.floor(F.col("t") / 4).cast("int")
    return texels.withColumn("x", x).withColumn("y", y).where("x < width and y < height").drop("bx", "by", "t", "block_id")


def blocks_of_texels(texels: DataFrame) -> DataFrame:
    """Sixteen rows (t, r, g, b, a) for each 4x4 block of texels; blocks at the edge repeat the last column and row.

    Each texel goes to the places it fills, so edges cost no join.
    """
    wide, high = F.ceil(F.col("width") / 4) * 4, F.ceil(F.col("height") / 4) * 4
    xs = F.when(F.col("x") == F.col("width") - 1, F.sequence(F.col("x"), (wide - 1).cast("int"))).otherwise(F.array("x"))
    ys = F.when(F.col("y") == F.col("height") - 1, F.sequence(F.col("y"), (high - 1).cast("int"))).otherwise(F.array("y"))
    rows = texels.withColumn("_x", F.explode(xs)).withColumn("_y", F.explode(ys))
    bx, by = F.floor(F.col("_x") / 4).cast("int"), F.floor(F.col("_y") / 4).cast("int")
    return rows.withColumn("bx", bx).withColumn("by", by).withColumn("block_id", by * F.ceil(F.col("width") / 4).cast("int") + bx).withColumn("t", F.col("_y") % 4 * 4 + F.col("_x") % 4).drop("_x", "_y", "x", "y")


def joined(pieces: DataFrame, keys: list[str], row: str, place: str, value: str) -> DataFrame:
    """(keys, value) with the binary values put together in order: first by row, then the rows, so no group holds more than a row's pieces or a surface's rows."""
    in_order = lambda by: F.expr(f"listagg({value}) WITHIN GROUP (ORDER BY {by})").alias(value)
    return pieces.groupBy(*keys, row).agg(in_order(place)).groupBy(*keys).agg(in_order(row))


def payloads(blocks: DataFrame) -> DataFrame:
    """Surfaces with a payload, from blocks; shuffled by block row, then by surface."""
    wide = F.ceil(F.col("width") / 4).cast("int")
    rows = blocks.select(*SURFACE, "block_id", F.floor(F.col("block_id") / wide).cast("int").alias("_by"), F.col("block").alias("payload"))
    return joined(rows, SURFACE, "_by", "block_id", "payload")


def _pixel() -> Column:
    return F.unhex(F.concat(*(F.lpad(F.hex(F.col(c).cast("long")), 2, "0") for c in "rgba")))


def rasters(texels: DataFrame) -> DataFrame:
    """Surfaces with tight RGBA bytes, from texel rows (x, y, r, g, b, a); shuffled by row, then by surface."""
    return joined(texels.select(*SURFACE, "x", "y", _pixel().alias("rgba")), SURFACE, "y", "x", "rgba")


def block_rasters(texels: DataFrame, name: str = "rgba", pixel: Column | None = None) -> DataFrame:
    """Rows (texture_id, face, mip, width, height, block_id, and under `name` the texels' bytes in order) of 4x4 blocks, from texel rows; one shuffle by block."""
    cells = blocks_of_texels(texels).select(*SURFACE, "block_id", "t", (_pixel() if pixel is None else pixel).alias(name))
    return cells.groupBy(*SURFACE, "block_id").agg(F.expr(f"listagg({name}) WITHIN GROUP (ORDER BY t)").alias(name))


def encoded_by_block(blocks: DataFrame, encode: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Surfaces with a payload, from block_rasters() and a function that encodes them as surfaces of 4 by 4."""
    alone = blocks.withColumnsRenamed({"width": "_width", "height": "_height"}).withColumns({"width": F.lit(4), "height": F.lit(4)})
    return payloads(encode(alone).drop("width", "height").withColumnsRenamed({"_width": "width", "_height": "height", "payload": "block"}))
