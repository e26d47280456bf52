import pytest
from pyspark.sql import functions as F

from texspark.operators import metrics, search, surfaces
import fixtures
from texspark.plans import textures
from texspark.sources import containers


@pytest.mark.parametrize(("fmt", "container", "least"), [("BC1", "dds", 15), ("RGBA8", "ktx", float("inf"))])
def test_images_come_back_from_containers(spark, fmt, container, least):
    texels = fixtures.image(spark, "opaque", 20, 12)
    cube = texels.withColumn("texture_id", F.lit(1)).crossJoin(spark.range(6).selectExpr("CAST(id AS INT) AS f")).withColumn("face", F.col("f")).drop("f")
    files = textures.encode_textures(texels.unionByName(cube), fmt, container, mipmaps=3)
    parsed = containers.parse_files(files.selectExpr("CAST(texture_id AS STRING) AS path", "content"), strict=True).cache()
    assert {(r.path, r.n_faces, r.n_mips) for r in parsed.collect()} == {("0", 1, 3), ("1", 6, 3)}
    first = textures.decode_textures(parsed, formats=[fmt]).cache()
    assert first.where("path = '0'").count() == 240 == first.where("path = '1'").count()
    both = [texels.withColumn("path", F.lit("0")), first.where("path = '0'")]
    assert metrics.psnr(*both, ["path"], ["x", "y"]).first().psnr >= least
    every = textures.decode_textures(parsed, every_level=True)
    assert textures.decode_textures(parsed.limit(0)).count() == 0
    assert every.groupBy("path", "face", "mip").count().count() == 7 * 3


def test_each_format_is_decoded_from_surfaces_that_are_parsed_once(spark):
    texels = fixtures.image(spark, "opaque", 8, 8)
    names = ["RGBA8", "BC1", "BC7", "R8"]
    files = [textures.encode_textures(texels.withColumn("texture_id", F.lit(k)), name, level=1).selectExpr("CAST(texture_id AS STRING) AS path", "content") for k, name in enumerate(names)]
    parsed = containers.parse_files(files[0].union(files[1]).union(files[2]).union(files[3]), strict=True)
    out = textures.decode_textures(parsed)
    assert "mapInArrow" not in out._jdf.queryExecution().toString() and "MapInArrow" not in out._jdf.queryExecution().toString()
    assert {(r.path, r.format): r["count"] for r in out.groupBy("path", "format").count().collect()} == {(str(k), name): 64 for k, name in enumerate(names)}
    assert {r.format for r in textures.decode_textures(parsed, formats=["R8", "BC7"]).select("format").distinct().collect()} == {"R8", "BC7"}


def test_levels_out_of_range_count_as_the_nearest():
    assert search.Level(False, -5, 0, -1, -2) == search.Level(False, 0, 1, 0, 0)


def test_a_surface_is_encoded_by_many_tasks(spark):
    """Blocks of one surface are spread over tasks, and give what the whole surface gives."""
    texels = fixtures.image(spark, "opaque", 130, 70)
    spread = surfaces.block_rasters(texels)
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        assert spread.groupBy(F.spark_partition_id()).count().count() > 1 and spread.count() == 33 * 18
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)
    for fmt in ("BC1", "BC5"):
        (one,) = search.encode_texels(texels, fmt, 2).collect()
        (whole,) = search.encode_surfaces(surfaces.rasters(texels), fmt, 2).collect()
        assert bytes(one.payload) == bytes(whole.payload) and len(one.payload) == 33 * 18 * (8 if fmt == "BC1" else 16)
        assert (one.width, one.height, one.format) == (130, 70, fmt)
