"""Whole textures: images to containers and containers to images."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from texspark.formats import FORMATS, format_of
from texspark.functions.expressions import to_bytes
from texspark.operators import bc6h, decode, encode, mips, search, surfaces
from texspark.sources import containers
from texspark.sources.shared import scratch

TEXELS = [*surfaces.SURFACE, "x", "y", "r", "g", "b", "a"]


def encode_textures(texels: DataFrame, fmt: str, container: str = "dds", level: int = 6, mipmaps: int = 1, srgb: bool = False, threshold: int = 128, weights: tuple[float, float, float] | None = None) -> DataFrame:
    """Containers (texture_id, content) of texture images.

    texels: TEXELS of level 0, of one or six faces a texture with equal sizes. mipmaps:
    levels in all, 0 for the full chain. level (1 to 10, or a search.Level that says what
    is searched), threshold and weights: as in search.encode_array. BC6H takes floats, so
    encode_hdr_textures() encodes it.
    """
    chain = texels.select(*TEXELS) if mipmaps == 1 else mips.mip_chain(texels.select(*TEXELS), mipmaps, srgb)
    if format_of(fmt).compressed:
        encoded = search.encode_texels(chain, fmt, level, threshold, weights)
    else:
        size = format_of(fmt).size
        packed = encode.pack_pixels(chain, format_of(fmt).name)
        words = packed.select(*surfaces.SURFACE, "x", "y", to_bytes(F.col("w"), size).alias("payload"))
        encoded = surfaces.joined(words, surfaces.SURFACE, "y", "x", "payload").withColumn("format", F.lit(format_of(fmt).name))
    return containers.build_files(encoded, container)


def encode_hdr_textures(texels: DataFrame, signed: bool, container: str = "dds", level: int = 6) -> DataFrame:
    """Containers (texture_id, content) of BC6H textures, from texels with r, g, b as floats and any mip levels."""
    return containers.build_files(bc6h.encode_hdr_texels(texels, signed, level), container)


def decode_hdr_textures(found: DataFrame) -> DataFrame:
    """Texels (path, format, face, mip, width, height, x, y, and r, g, b as doubles) of the BC6H surfaces of parsed files."""
    wanted, parts = found.where("error is null").withColumnRenamed("path", "texture_id"), []
    for name in ("BC6HU", "BC6HS"):
        blocks = surfaces.to_blocks(wanted.where(F.col("format") == name), name)
        texels = surfaces.placed(decode.decode_floats(blocks, name))
        parts.append(texels.select(F.col("texture_id").alias("path"), F.lit(name).alias("format"), *TEXELS[1:-1]))
    return parts[0].unionByName(parts[1])


def decode_textures(found: DataFrame, every_level: bool = False, formats: list[str] | None = None) -> DataFrame:
    """Texels (path, format, face, mip, width, height, x, y, r, g, b, a) of parsed surfaces: the first face and level, or all.

    BC6H surfaces and rows with an error are left out; decode_hdr_textures() gives BC6H.
    formats: those that are wanted; if not told, all that occur. Unless it is one, the
    surfaces are parsed once and written to the job's folder by format, so that each
    format's branch reads its own. None is shuffled.
    """
    spark = found.sparkSession
    wanted = found.where("error is null") if every_level else found.where("error is null and face = 0 and mip = 0")
    wanted = wanted.select(F.col("path").alias("texture_id"), *surfaces.SURFACE[1:], "payload", "format")
    if formats is None or len(formats) > 1:
        folder = scratch(spark, "surfaces")
        wanted.write.partitionBy("format").parquet(folder)
        wanted = spark.read.schema(wanted.schema).parquet(folder)
    names = [r.format for r in wanted.select("format").distinct().collect()] if formats is None else formats  # 24 at most
    parts = []
    for f in (f for f in FORMATS.values() if f.name in names and not f.name.startswith("BC6H")):
        own = wanted.where(F.col("format") == f.name)
        texels = surfaces.placed(decode.decode_blocks(surfaces.to_blocks(own, f.name), f.name)) if f.compressed else decode.unpack_pixels(surfaces.to_pixels(own, f.name), f.name)
        parts.append(texels.select(F.col("texture_id").alias("path"), F.lit(f.name).alias("format"), *TEXELS[1:]))
    if not parts:
        return spark.createDataFrame([], "path string, format string, face int, mip int, width int, height int, x int, y int, r int, g int, b int, a int")
    return reduce(DataFrame.unionByName, parts)
