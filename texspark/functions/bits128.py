"""128-bit little-endian words as two BIGINT columns, in expression text for generated code.

Bits are counted from the least significant one of the low half. A field may lie across
bit 64. Places and sizes are numbers or column names.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def halves(block: Column) -> tuple[Column, Column]:
    """The low and the high half of 16 bytes, as signed 64-bit integers."""
    digits = F.hex(block)

    def half(first: int) -> Column:
        return F.conv(F.concat(*(F.substring(digits, 2 * (first + k) + 1, 2) for k in reversed(range(8)))), 16, -10).cast("long")

    return half(0), half(8)


def to_block(lo: Column, hi: Column) -> Column:
    """16 bytes from both halves."""
    digits = [F.lpad(F.hex(half), 16, "0") for half in (lo, hi)]
    return F.unhex(F.concat(*(F.substring(d, 2 * k + 1, 2) for d in digits for k in reversed(range(8)))))


def _at(value: int | str) -> str:
    return str(value) if isinstance(value, int) else f"CAST({value} AS INT)"


def read(at: int | str, size: int | str, lo: str = "lo", hi: str = "hi") -> str:
    """The unsigned field of `size` bits (0 to 62) at bit `at`."""
    mask = str((1 << size) - 1) if isinstance(size, int) else f"(shiftleft(1L, {_at(size)}) - 1L)"
    low, high = f"shiftrightunsigned({lo}, {_at(at)})", f"shiftrightunsigned({hi}, {_at(at)} - 64)"
    both = f"({low} | shiftleft({hi}, 64 - {_at(at)}))"
    if isinstance(at, int) and isinstance(size, int):
        value = high if at >= 64 else low if at + size <= 64 else both
    else:
        value = f"CASE WHEN {_at(at)} >= 64 THEN {high} WHEN {_at(at)} + {_at(size)} <= 64 THEN {low} ELSE {both} END"
    return f"(({value}) & {mask})"


def put(value: str, at: int | str, size: int | str) -> tuple[str, str]:
    """What a field adds to the low and to the high half: to be joined by |. Bits of the value beyond `size` are cut off."""
    mask = str((1 << size) - 1) if isinstance(size, int) else f"(shiftleft(1L, {_at(size)}) - 1L)"
    cut = f"(CAST({value} AS BIGINT) & {mask})"
    low, high, over = f"shiftleft({cut}, {_at(at)})", f"shiftleft({cut}, {_at(at)} - 64)", f"shiftrightunsigned({cut}, 64 - {_at(at)})"
    if isinstance(at, int) and isinstance(size, int):
        return ("0L", high) if at >= 64 else (low, "0L") if at + size <= 64 else (low, over)
    return f"CASE WHEN {_at(at)} < 64 THEN {low} ELSE 0L END", f"CASE WHEN {_at(at)} >= 64 THEN {high} WHEN {_at(at)} + {_at(size)} > 64 THEN {over} ELSE 0L END"


def written(fields: list[tuple[str, int | str, int | str]]) -> tuple[str, str]:
    """Both halves of a word that is written from fields (value, place, size)."""
    low, high = zip(*(put(*f) for f in fields), strict=True)
    return " | ".join(low), " | ".join(high)
