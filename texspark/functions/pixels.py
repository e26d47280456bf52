"""The fourteen uncompressed pixel layouts, as expressions over a little-endian word `w`."""

from __future__ import annotations


def _unorm(bits: str, limit: int) -> str:
    """A level of 0..limit to 0..255, to the nearest."""
    return f"((({bits}) * 255 + {limit // 2}) div {limit})"


def _level(channel: str, limit: int) -> str:
    """0..255 to the nearest level of 0..limit."""
    return f"(({channel} * {limit} + 127) div 255)"


def from_snorm(byte: str) -> str:
    """A signed byte (given as 0..255) to 0..255; -128 counts as -127."""
    v = f"(greatest(({byte}) - (CASE WHEN ({byte}) >= 128 THEN 256 ELSE 0 END), -127) + 127)"
    return f"({v} + (({v} + 129) >> 8))"


def to_snorm(channel: str) -> str:
    """0..255 to a signed byte, given as 0..255."""
    return f"((({channel} * 254 + 127) div 255 - 127) & 255)"


_B0, _B1, _B2, _B3 = "(w & 255)", "((w >> 8) & 255)", "((w >> 16) & 255)", "((w >> 24) & 255)"

#: name: r, g, b, a from the word
UNPACK: dict[str, tuple[str, str, str, str]] = {
    "RGBA8": (_B0, _B1, _B2, _B3),
    "BGRA8": (_B2, _B1, _B0, _B3),
    "BGRX8": (_B2, _B1, _B0, "255"),
    "RGB8": (_B0, _B1, _B2, "255"),
    "BGR8": (_B2, _B1, _B0, "255"),
    "R8": (_B0, _B0, _B0, "255"),
    "R8S": (from_snorm(_B0), from_snorm(_B0), from_snorm(_B0), "255"),
    "RG8": (_B0, _B1, "0", "255"),
    "RG8S": (from_snorm(_B0), from_snorm(_B1), "0", "255"),
    "A8": ("0", "0", "0", _B0),
    "RGB565": (_unorm("(w >> 11) & 31", 31), _unorm("(w >> 5) & 63", 63), _unorm("w & 31", 31), "255"),
    "RGBA5551": (_unorm("(w >> 10) & 31", 31), _unorm("(w >> 5) & 31", 31), _unorm("w & 31", 31), "(((w >> 15) & 1) * 255)"),
    "RGBA4444": (_unorm("(w >> 8) & 15", 15), _unorm("(w >> 4) & 15", 15), _unorm("w & 15", 15), _unorm("(w >> 12) & 15", 15)),
    "RGB10A2": (_unorm("w & 1023", 1023), _unorm("(w >> 10) & 1023", 1023), _unorm("(w >> 20) & 1023", 1023), _unorm("(w >> 30) & 3", 3)),
}

#: name: the word from r, g, b, a
PACK: dict[str, str] = {
    "RGBA8": "(r + (g << 8) + (b << 16) + (a << 24))",
    "BGRA8": "(b + (g << 8) + (r << 16) + (a << 24))",
    "BGRX8": "(b + (g << 8) + (r << 16) + 4278190080)",
    "RGB8": "(r + (g << 8) + (b << 16))",
    "BGR8": "(b + (g << 8) + (r << 16))",
    "R8": "(r)",
    "R8S": to_snorm("r"),
    "RG8": "(r + (g << 8))",
    "RG8S": f"({to_snorm('r')} + ({to_snorm('g')} << 8))",
    "A8": "(a)",
    "RGB565": f"(({_level('r', 31)} << 11) + ({_level('g', 63)} << 5) + {_level('b', 31)})",
    "RGBA5551": f"(({_level('a', 1)} << 15) + ({_level('r', 31)} << 10) + ({_level('g', 31)} << 5) + {_level('b', 31)})",
    "RGBA4444": f"(({_level('a', 15)} << 12) + ({_level('r', 15)} << 8) + ({_level('g', 15)} << 4) + {_level('b', 15)})",
    "RGB10A2": f"({_level('r', 1023)} + ({_level('g', 1023)} << 10) + ({_level('b', 1023)} << 20) + ({_level('a', 3)} << 30))",
}
