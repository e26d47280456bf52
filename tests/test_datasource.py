import os

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F
from test_containers import payload, texture

from texspark.formats import FORMATS, format_of
from texspark.sources import containers, datasource

COLUMNS = "path string, format string, n_faces int, n_mips int, face int, mip int, width int, height int, payload binary"


def rows_of(container):
    names = [n for n, f in FORMATS.items() if container == "dds" or f.ktx]
    rows = [(k, n, 6 if k % 2 else 1, 1 + k % 3, r) for k, n in enumerate(names) for r in texture(k, n, 5, 3, 6 if k % 2 else 1, 1 + k % 3)]
    return [(f"sub/t{k}" if k % 3 else f"t{k}", n, faces, mips, r[2], r[3], r[4], r[5], r[6]) for k, n, faces, mips, r in rows]


def left(folder):
    return sorted(os.path.relpath(f"{d}/{n}", folder) for d, _, names in os.walk(folder) for n in names)


@pytest.mark.parametrize("kind", ["dds", "ktx"])
def test_every_format_is_written_and_read(spark, tmp_path, kind):
    rows = rows_of(kind)
    datasource.write_textures(spark.createDataFrame(rows, COLUMNS).repartition(7), kind, f"{tmp_path}/out")
    assert left(f"{tmp_path}/out") == sorted({f"{r[0]}.{kind}" for r in rows})
    back = datasource.read_textures(spark, kind, f"file://{tmp_path}/out", maxPartitionBytes="9000", strict="true")
    name = F.expr(f"substring(path, {len(f'{tmp_path}/out/') + 1}, length(path) - {len(f'{tmp_path}/out/') + 4})")
    got = [(*tuple(r)[:-1], bytes(r.payload)) for r in back.select(name.alias("path"), "format", "n_faces", "n_mips", "face", "mip", "width", "height", "payload").collect()]
    assert sorted(got) == sorted(rows)
    heads = datasource.read_textures(spark, kind, f"{tmp_path}/out", headers="true").collect()
    assert len(heads) == len({r[0] for r in rows}) and all((r.width, r.height, r.error, r.length) == (5, 3, None, os.path.getsize(r.path)) for r in heads)
    # The other reader of the library agrees, byte by byte.
    files = containers.build_files(spark.createDataFrame(rows, COLUMNS).withColumnRenamed("path", "texture_id"), kind)
    for r in files.collect():
        with open(f"{tmp_path}/out/{r.texture_id}.{kind}", "rb") as f:
            assert f.read() == bytes(r.content)


def test_filters_choose_the_ranges_that_are_read(spark, tmp_path):
    rows = rows_of("dds")
    datasource.write_textures(spark.createDataFrame(rows, COLUMNS), "dds", str(tmp_path))
    back = datasource.read_textures(spark, "dds", str(tmp_path)).where("mip = 1 AND face IN (0, 5)")
    assert back.count() == sum(r[5] == 1 and r[4] in (0, 5) for r in rows)
    asked = datasource.TextureReader(datasource._Options("dds", {"path": str(tmp_path)}))
    kept = list(asked.pushFilters([datasource.EqualTo(("mip",), 1), datasource.In(("face",), (0, 5)), datasource.EqualTo(("format",), "BC1")]))
    assert len(kept) == 3 and asked.options.mips == {1} and asked.options.faces == {0, 5}
    got = [r for p in asked.partitions() for b in asked.read(p) for r in b.to_pylist()]
    assert {(r["face"], r["mip"]) for r in got} == {(0, 1), (5, 1)}


def test_headers_need_no_payload(spark, tmp_path):
    whole = containers.build_dds(format_of("BC7"), 64, 64, [[bytes(16 * 256)]])
    (tmp_path / "cut.dds").write_bytes(whole[:150])
    (tmp_path / "none.dds").write_bytes(b"DDS ")
    (tmp_path / "_hidden.dds").write_bytes(whole)
    heads = {os.path.basename(r.path): r for r in datasource.read_textures(spark, "dds", str(tmp_path), headers="true").collect()}
    assert heads.keys() == {"cut.dds", "none.dds"} and heads["cut.dds"].format == "BC7" and heads["none.dds"].error == "DDS header is cut short"
    errors = sorted(r.error for r in datasource.read_textures(spark, "dds", str(tmp_path)).collect())
    assert errors == ["DDS header is cut short", "payload is cut short"]
    with pytest.raises(PySparkException):
        datasource.read_textures(spark, "dds", str(tmp_path), strict="true").collect()


@pytest.mark.parametrize("fault", ["level", "size", "user", "name"])
def test_a_job_that_fails_leaves_no_file(spark, tmp_path, fault):
    rows = [r for r in rows_of("dds") if r[1] in ("BC1", "BC7", "RGBA8", "R8")]
    df = spark.createDataFrame(rows, COLUMNS)
    if fault == "level":
        df = df.where("NOT (format = 'BC7' AND face = 0 AND mip = 0)")
    elif fault == "size":
        df = df.withColumn("payload", F.expr("CASE WHEN format = 'BC7' THEN substring(payload, 2) ELSE payload END"))
    elif fault == "user":
        df = df.withColumn("payload", F.expr("CASE WHEN format = 'R8' THEN raise_error('no') ELSE payload END"))
    else:
        df = df.withColumn("path", F.expr("CASE WHEN format = 'R8' THEN '../x' ELSE path END"))
    with pytest.raises(PySparkException):
        datasource.write_textures(df, "dds", f"{tmp_path}/out")
    assert left(tmp_path) == []


def test_overwrite_replaces_and_append_adds(spark, tmp_path):
    one = lambda name, seed: spark.createDataFrame([(name, "R8", 1, 1, 0, 0, 4, 4, payload(format_of("R8"), 4, 4, seed))], COLUMNS)
    datasource.write_textures(one("a", 1), "dds", str(tmp_path))
    datasource.write_textures(one("b", 2), "dds", str(tmp_path))
    assert left(tmp_path) == ["a.dds", "b.dds"]
    datasource.write_textures(one("b", 3), "dds", str(tmp_path), mode="overwrite")
    assert left(tmp_path) == ["b.dds"]
    assert bytes(datasource.read_textures(spark, "dds", str(tmp_path)).first().payload) == payload(format_of("R8"), 4, 4, 3)


def test_new_files_stream_from_one_format_to_the_other(spark, tmp_path):
    datasource.register(spark)
    made = lambda name, seed: (tmp_path / f"{name}.dds").write_bytes(containers.build_dds(format_of("R8"), 4, 4, [[payload(format_of("R8"), 4, 4, seed)]]))
    made("a", 1)

    def step():
        found = spark.readStream.format("dds").load(str(tmp_path))
        named = found.withColumn("path", F.regexp_extract("path", r"([^/]+)\.dds$", 1)).drop("container", "is_srgb", "error")
        query = named.writeStream.format("ktx").option("checkpointLocation", f"{tmp_path}/_state").trigger(availableNow=True).start(f"{tmp_path}/ktx")
        query.awaitTermination(60)
        assert query.exception() is None

    step()
    made("b", 2)
    step()
    assert left(f"{tmp_path}/ktx") == ["a.ktx", "b.ktx"]
    back = {os.path.basename(r.path): bytes(r.payload) for r in datasource.read_textures(spark, "ktx", f"{tmp_path}/ktx").collect()}
    assert back == {"a.ktx": payload(format_of("R8"), 4, 4, 1), "b.ktx": payload(format_of("R8"), 4, 4, 2)}
