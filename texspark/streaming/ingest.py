"""Texture files as a stream: new files of a folder become surfaces."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from texspark.sources.containers import parse_files

FILES = "path string, modificationTime timestamp, length long, content binary"


def stream_textures(spark: SparkSession, path: str, files_per_trigger: int = 100) -> DataFrame:
    """A streaming DataFrame of the surfaces of .dds and .ktx files that arrive under a path; no state is kept between files."""
    files = spark.readStream.format("binaryFile").schema(FILES).option("pathGlobFilter", "*.{dds,ktx,DDS,KTX}").option("maxFilesPerTrigger", files_per_trigger).load(path)
    return parse_files(files.select("path", "content"))
