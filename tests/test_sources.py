"""File sinks, image files, headers and floats."""

import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from texspark.operators import search
from texspark.plans import textures
from texspark.sources import containers, images


def png(width, height, kind, rows):
    """A PNG file of raw rows; kind 0 is grey, 2 RGB, 6 RGBA."""
    chunk = lambda name, data: struct.pack(">I", len(data)) + name + data + struct.pack(">I", zlib.crc32(name + data))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, kind, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(b"".join(b"\0" + r for r in rows))) + chunk(b"IEND", b"")


def test_images_to_surfaces(spark, tmp_path):
    rng = np.random.default_rng(1)
    want = {}
    for name, kind, channels in (("grey", 0, 1), ("rgb", 2, 3), ("rgba", 6, 4)):
        image = rng.integers(0, 256, (3, 5, channels), dtype=np.uint8)
        (tmp_path / f"{name}.png").write_bytes(png(5, 3, kind, [row.tobytes() for row in image]))
        full = np.full((3, 5, 4), 255, dtype=np.uint8)
        full[:, :, :3] = image[:, :, :3]
        if channels == 4:
            full[:, :, 3] = image[:, :, 3]
        want[name] = full.tobytes()
    (tmp_path / "none.png").write_bytes(b"no image")
    found = images.read_images(spark, str(tmp_path)).cache()
    got = {r.texture_id.rpartition("/")[2][:-4]: r for r in found.collect()}
    assert {n: bytes(r.rgba) for n, r in got.items() if r.rgba is not None} == want and got["none"].width is None
    assert (got["rgb"].width, got["rgb"].height) == (5, 3)
    encoded = search.encode_surfaces(found.where("rgba is not null"), "BC1", 1)
    assert {len(r.payload) for r in encoded.collect()} == {16}
    assert images.solid(spark, 5, 3, (1, 2, 3, 4)).distinct().count() == 15


def test_files_are_written_and_read_again(spark, tmp_path):
    texels = images.solid(spark, 6, 5, (10, 200, 30, 255))
    files = textures.encode_textures(texels, "BC3", "ktx", level=1, mipmaps=0, threshold=0, weights=(1.0, 1.0, 1.0))
    named = files.select(F.concat(F.lit("a b/t"), F.col("texture_id").cast("string"), F.lit(".ktx")).alias("path"), "content")
    n, size = containers.write_files(named, f"file://{tmp_path}/out")
    assert (n, size) == (1, (tmp_path / "out/a b/t0.ktx").stat().st_size) and containers.write_files(named, f"file://{tmp_path}/out") == (n, size)
    found = containers.read_textures(spark, f"{tmp_path}/out")
    assert [(r.format, r.n_mips, r.error) for r in found.collect()] == [("BC3", 3, None)] * 3
    (header,) = containers.ktx_headers(files).collect()
    assert (header.width, header.height, header.mips, header.gl_internal_format) == (6, 5, 3, 0x83F3)
    assert containers.dds_headers(files).count() == 0
    with pytest.raises(Exception, match="no relative path"):
        containers.write_files(spark.createDataFrame([("../x", b"")], "path string, content binary"), f"file://{tmp_path}/out")


@pytest.mark.parametrize("signed", [False, True])
def test_float_textures(spark, signed):
    at = spark.range(96).selectExpr("0 AS texture_id", "0 AS face", "0 AS mip", "12 AS width", "8 AS height", "CAST(id % 12 AS INT) AS x", "CAST(id div 12 AS INT) AS y")
    sign = -1 if signed else 1
    texels = at.selectExpr("*", f"CAST({sign} * (1 + x % 4 * 0.125D) AS FLOAT) AS r", "CAST(2 + x % 4 * 0.25D AS FLOAT) AS g", "CAST(NULL AS FLOAT) AS b")
    files = textures.encode_hdr_textures(texels, signed, level=6).selectExpr("CAST(texture_id AS STRING) AS path", "content")
    found = {(r.x, r.y): r for r in textures.decode_hdr_textures(containers.parse_files(files, strict=True)).collect()}
    assert len(found) == 96 and {r.format for r in found.values()} == {"BC6HS" if signed else "BC6HU"}
    assert all(abs(r.r - sign * (1 + x % 4 * 0.125)) < 0.1 and abs(r.g - 2 - x % 4 * 0.25) < 0.2 and abs(r.b) < 0.05 for (x, _), r in found.items())
