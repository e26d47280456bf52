"""Column expressions as SQL text in steps, for Spark and, for checks, for DuckDB.

A step is a dict of new columns computed from those before it. The text uses integer
operators only, with `div` for truncating division.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Steps = list[dict[str, str]]


def apply(df: DataFrame, steps: Steps) -> DataFrame:
    """df with the steps' columns; narrow projections that stay in generated code."""
    for step in steps:
        df = df.selectExpr("*", *(f"{text} AS {name}" for name, text in step.items()))
    return df


def duckdb(source: str, steps: Steps) -> str:
    """The same steps over a DuckDB source."""
    for step in steps:
        source = "(SELECT *, " + ", ".join(f"{text.replace(' div ', ' // ')} AS {name}" for name, text in step.items()) + f" FROM {source})"
    return source


def little_endian(data: Column, at: int, size: int) -> Column:
    """The unsigned integer of `size` bytes (up to 7) at an offset of a binary column."""
    digits = F.hex(data)
    return F.conv(F.concat(*(F.substring(digits, 2 * (at + k) + 1, 2) for k in reversed(range(size)))), 16, 10).cast("long")


def to_bytes(value: Column, size: int) -> Column:
    """An unsigned integer as `size` little-endian bytes."""
    digits = F.lpad(F.hex(value.cast("long")), 2 * size, "0")
    return F.unhex(F.concat(*(F.substring(digits, 2 * k + 1, 2) for k in reversed(range(size)))))
