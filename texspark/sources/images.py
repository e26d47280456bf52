"""Image files (PNG, JPEG and others that Spark's image source reads) as surfaces."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SURFACES = "texture_id string, face int, mip int, width int, height int, rgba binary"


def rgba_of(data: bytes, width: int, height: int, channels: int) -> bytes:
    """Rows of grey, BGR or BGRA bytes as RGBA bytes."""
    image = np.frombuffer(data, dtype=np.uint8).reshape(height * width, channels)
    out = np.full((len(image), 4), 255, dtype=np.uint8)
    out[:, :3] = image[:, :3][:, ::-1] if channels >= 3 else image[:, :1]
    if channels == 4:
        out[:, 3] = image[:, 3]
    return out.tobytes()


def read_images(spark: SparkSession, path: str) -> DataFrame:
    """Surfaces of the image files of a path, for search.encode_surfaces(); files that are no images have a null rgba and no size."""

    def convert(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                known = r["width"] > 0 and r["nChannels"] in (1, 3, 4)
                row = {"texture_id": r["origin"], "face": 0, "mip": 0, "width": r["width"] if known else None, "height": r["height"] if known else None, "rgba": rgba_of(r["data"], r["width"], r["height"], r["nChannels"]) if known else None}
                yield pa.RecordBatch.from_pylist([row], schema=arrow)

    arrow = pa.schema([("texture_id", pa.string()), ("face", pa.int32()), ("mip", pa.int32()), ("width", pa.int32()), ("height", pa.int32()), ("rgba", pa.binary())])
    return spark.read.format("image").load(path).select("image.*").mapInArrow(convert, SURFACES)


def solid(spark: SparkSession, width: int, height: int, color: tuple[int, int, int, int]) -> DataFrame:
    """Texels of one surface of one colour."""
    at = spark.range(width * height).selectExpr(f"CAST(id % {width} AS INT) AS x", f"CAST(id div {width} AS INT) AS y")
    sizes = {"texture_id": 0, "face": 0, "mip": 0, "width": width, "height": height}
    return at.select(*(F.lit(v).alias(n) for n, v in sizes.items()), "x", "y", *(F.lit(v).alias(c) for c, v in zip("rgba", color, strict=True)))
