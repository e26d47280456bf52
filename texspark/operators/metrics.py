"""Quality of decoded texels against their source."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def psnr(a: DataFrame, b: DataFrame, by: list[str], at: list[str], peak: float = 255.0) -> DataFrame:
    """Peak signal-to-noise ratio over r, g, b in decibels, for each value of `by`.

    Rows of a and b meet at `by` and `at`; equal images have an infinite ratio.
    """
    left = a.select(*by, *at, *(F.col(c).alias(f"{c}_a") for c in "rgb"))
    right = b.select(*by, *at, *(F.col(c).alias(f"{c}_b") for c in "rgb"))
    square = sum(((F.col(f"{c}_a") - F.col(f"{c}_b")).cast("long") * (F.col(f"{c}_a") - F.col(f"{c}_b")) for c in "rgb"), F.lit(0))
    return _ratio(left.join(right, [*by, *at]).groupBy(*by).agg(F.sum(square).alias("_s"), F.count("*").alias("_n")), by, peak)


def block_psnr(texels: DataFrame, by: list[str], peak: float = 255.0, source: str = "px[t].{}") -> DataFrame:
    """The same from decoded texels (t, r, g, b) that bear their source: only sums are shuffled.

    source: SQL of its value in a channel; by default px is the source block, an array of
    sixteen texels in order.
    """
    square = " + ".join(f"({source.format(c)} - {c}) * ({source.format(c)} - {c})" for c in "rgb")
    return _ratio(texels.groupBy(*by).agg(F.sum(F.expr(f"CAST({square} AS BIGINT)")).alias("_s"), F.count("*").alias("_n")), by, peak)


def _ratio(sums: DataFrame, by: list[str], peak: float) -> DataFrame:
    mean = F.col("_s") / (3 * F.col("_n"))
    return sums.select(*by, F.when(F.col("_s") == 0, F.lit(float("inf"))).otherwise(10 * F.log10(F.lit(peak * peak) / mean)).alias("psnr"))
