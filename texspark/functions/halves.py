"""Half-float bits as doubles, in expression text."""

from __future__ import annotations


def to_double(bits: str) -> str:
    """The value of half-float bits (0 to 65535); infinities and NaN included, the sign of zero not."""
    sign, exponent, fraction = f"(1 - 2 * (({bits}) >> 15))", f"((({bits}) >> 10) & 31)", f"(({bits}) & 1023)"
    return (
        f"CASE WHEN {exponent} = 31 AND {fraction} > 0 THEN CAST('NaN' AS DOUBLE) WHEN {exponent} = 31 THEN {sign} * CAST('Infinity' AS DOUBLE)"
        f" WHEN {exponent} = 0 THEN {sign} * {fraction} * power(CAST(2 AS DOUBLE), -24) ELSE {sign} * (1024 + {fraction}) * power(CAST(2 AS DOUBLE), {exponent} - 25) END"
    )
