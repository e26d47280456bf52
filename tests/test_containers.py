import struct

import pytest

from texspark.formats import FORMATS, format_of, level_size
from texspark.sources import containers
from texspark.streaming.ingest import stream_textures

SURFACES = "texture_id int, format string, face int, mip int, width int, height int, payload binary"


def payload(fmt, w, h, seed):
    return containers._opaque(fmt, bytes((seed * 31 + k * 7) % 256 for k in range(level_size(fmt, w, h))))


def texture(number, name, width, height, faces, levels):
    return [(number, name, f, m, max(1, width >> m), max(1, height >> m), payload(format_of(name), max(1, width >> m), max(1, height >> m), 7 * f + m)) for f in range(faces) for m in range(levels)]


@pytest.mark.parametrize("container", ["dds", "ktx"])
def test_every_format_comes_back(spark, container):
    names = [n for n, f in FORMATS.items() if container == "dds" or f.ktx]
    rows = [r for k, n in enumerate(names) for r in texture(k, n, 5, 3, 6 if k % 2 else 1, 1 + k % 3)]
    files = containers.build_files(spark.createDataFrame(rows, SURFACES), container)
    parsed = containers.parse_files(files.selectExpr("CAST(texture_id AS STRING) AS path", "content"), strict=True)
    got = sorted((int(r.path), r.format, r.face, r.mip, r.width, r.height, bytes(r.payload)) for r in parsed.collect())
    assert got == sorted(rows)
    assert {(r.container, r.width, r.height) for r in containers.header_of(files).collect()} == {(container, 5, 3)}


def test_files_are_read_from_a_folder_and_a_stream(spark, tmp_path):
    (row,) = texture(0, "BC7", 16, 16, 1, 1)
    fmt = format_of("BC7")
    for name, content in (("a.dds", containers.build_dds(fmt, 16, 16, [[row[-1]]])), ("b.ktx", containers.build_ktx(fmt, 16, 16, [[row[-1]]])), ("c.dds", b"DDS "), ("d.txt", b"no texture")):
        (tmp_path / name).write_bytes(content)
    rows = containers.read_textures(spark, str(tmp_path)).orderBy("path").collect()
    assert [(r.container, r.format, r.error) for r in rows] == [("dds", "BC7", None), ("ktx", "BC7", None), ("dds", None, "DDS header is cut short")]
    assert bytes(rows[0].payload) == bytes(rows[1].payload) == row[-1]
    query = stream_textures(spark, str(tmp_path)).writeStream.format("memory").queryName("textures").trigger(availableNow=True).start()
    query.awaitTermination(60)
    assert spark.table("textures").where("error is null").count() == 2


@pytest.mark.parametrize(
    ("data", "error"),
    [
        (b"", "magic"),
        (b"DDS " + bytes(124), "header size"),
        (containers.KTX_MAGIC + bytes(20), "cut short"),
        (containers.KTX_MAGIC + struct.pack("<13I", 1, *[0] * 12), "endianness"),
        (containers.KTX_MAGIC + struct.pack("<13I", containers.ENDIAN, 0, 1, 0, 0x8E8C, 0, 4, 4, 0, 2, 1, 1, 0), "arrays"),
        (containers.KTX_MAGIC + struct.pack("<13I", containers.ENDIAN, 0, 1, 0, 0x8E8C, 0, 4, 4, 9, 0, 1, 1, 0), "volumes"),
        (containers.KTX_MAGIC + struct.pack("<13I", containers.ENDIAN, 0, 1, 0, 0x8E8C, 0, 1 << 30, 4, 0, 0, 1, 1, 0), "range"),
        (containers.build_dds(format_of("BC1"), 8, 8, [[bytes(32)]])[:-1], "cut short"),
        (containers.build_ktx(format_of("RGB8"), 3, 2, [[bytes(18)]])[:-3], "cut short"),
    ],
)
def test_broken_files_are_told(data, error):
    with pytest.raises(containers.ContainerError, match=error):
        (containers.parse_ktx if data[:4] == containers.KTX_MAGIC[:4] else containers.parse_dds)(data)


def test_odd_textures_are_refused(spark):
    rows = texture(0, "R8", 4, 4, 2, 1)
    with pytest.raises(Exception, match="one or six faces"):
        containers.build_files(spark.createDataFrame(rows, SURFACES), "dds").collect()
    with pytest.raises(Exception, match="wrong size"):
        containers.build_files(spark.createDataFrame([(0, "R8", 0, 0, 4, 4, b"x")], SURFACES), "ktx").collect()
    with pytest.raises(Exception, match="BGRX8"):
        containers.build_files(spark.createDataFrame(texture(0, "BGRX8", 4, 4, 1, 1), SURFACES), "ktx").collect()
    with pytest.raises(ValueError, match="container"):
        containers.build_files(spark.createDataFrame(rows, SURFACES), "png")
