"""Test images and blocks as DataFrames, from their formulas."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# The formulas of the 64x64 images.
_RED, _GREEN, _BLUE, _ALPHA = "(13 * x + 7 * y + 11) % 256", "(3 * x + 11 * y + 29) % 256", "(17 * x + 5 * y + 71) % 256", "(5 * x + 9 * y + 101) % 256"
IMAGES = {"opaque": (_RED, _GREEN, _BLUE, "255"), "translucent": (_RED, _GREEN, _BLUE, _ALPHA), "nohq": ("0", _GREEN, _BLUE, _ALPHA)}


def image(spark: SparkSession, name: str, width: int = 64, height: int = 64) -> DataFrame:
    """Texel rows of one of IMAGES as surface 0."""
    at = spark.range(width * height).selectExpr(f"CAST(id % {width} AS INT) AS x", f"CAST(id div {width} AS INT) AS y")
    channels = (F.expr(text).cast("int").alias(c) for c, text in zip("rgba", IMAGES[name], strict=True))
    return at.select(F.lit(0).alias("texture_id"), F.lit(0).alias("face"), F.lit(0).alias("mip"), F.lit(width).alias("width"), F.lit(height).alias("height"), "x", "y", *channels)


# The generator, blocks and bytes of each format, and the codes that BC6H blocks begin with.
SEED, FACTOR, SUMMAND = 0x4D595DF4, 1664525, 1013904223
COUNTS = [("BC1", 24, 8), ("BC2", 24, 16), ("BC3", 24, 16), ("BC4", 24, 8), ("BC5", 24, 16), ("BC6H", 38, 16), ("BC7", 32, 16)]
BC6H_CODES = (0, 1, 2, 6, 10, 14, 18, 22, 26, 30, 3, 7, 11, 15)


def generated_blocks(seed: int = SEED) -> dict[str, list[bytes]]:
    """Blocks of each format: zeros, ones, two ramps, a checker, then bytes of one linear congruential generator."""
    state = seed

    def byte() -> int:
        nonlocal state
        state = (state * FACTOR + SUMMAND) % (1 << 32)
        return state >> 24

    out = {}
    for name, count, size in COUNTS:
        plain = [bytes(size), b"\xff" * size, bytes(range(size)), bytes(255 - k for k in range(size)), b"\xaa\x55" * (size // 2)]
        blocks = [bytearray(plain[i]) if i < 5 else bytearray(byte() for _ in range(size)) for i in range(count)]
        if name == "BC6H":
            for block, code in zip(blocks, BC6H_CODES, strict=False):
                block[0] = code
        if name == "BC7":
            for i in range(8):
                blocks[i][0] = 1 << i
        out[name] = [bytes(b) for b in blocks]
    return out
