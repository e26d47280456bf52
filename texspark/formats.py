"""The texture formats: sizes and container codes."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Format:
    """name; bytes of a 4x4 block or of a pixel; how containers name it."""

    name: str
    size: int
    compressed: bool
    dds_write: str | int | tuple[int, int, int, int]  # FourCC, DXGI code, or masks r, g, b, a
    dxgi: tuple[int, ...]
    fourcc: tuple[str, ...]
    ktx: tuple[int, int, int, int, int] | None  # glType, glTypeSize, glFormat, glInternalFormat, glBaseInternalFormat


_RGBA, _RGB, _RG, _RED, _BGRA, _BGR, _ALPHA = 0x1908, 0x1907, 0x8227, 0x1903, 0x80E1, 0x80E0, 0x1906
_BYTE, _UBYTE = 0x1400, 0x1401

# Codes of the DDS and KTX v1 container formats.
FORMATS = {
    f.name: f
    for f in (
        Format("BC1", 8, True, "DXT1", (71, 72), ("DXT1",), (0, 1, 0, 0x83F1, _RGBA)),
        Format("BC2", 16, True, "DXT3", (74, 75), ("DXT3",), (0, 1, 0, 0x83F2, _RGBA)),
        Format("BC3", 16, True, "DXT5", (77, 78), ("DXT5",), (0, 1, 0, 0x83F3, _RGBA)),
        Format("BC4", 8, True, "ATI1", (80,), ("ATI1", "BC4U"), (0, 1, 0, 0x8DBB, _RED)),
        Format("BC4S", 8, True, 81, (81,), ("BC4S",), (0, 1, 0, 0x8DBC, _RED)),
        Format("BC5", 16, True, "ATI2", (83,), ("ATI2", "BC5U"), (0, 1, 0, 0x8DBD, _RG)),
        Format("BC5S", 16, True, 84, (84,), ("BC5S",), (0, 1, 0, 0x8DBE, _RG)),
        Format("BC6HU", 16, True, 95, (95,), (), (0, 1, 0, 0x8E8E, _RGB)),
        Format("BC6HS", 16, True, 96, (96,), (), (0, 1, 0, 0x8E8F, _RGB)),
        Format("BC7", 16, True, 98, (98, 99), (), (0, 1, 0, 0x8E8C, _RGBA)),
        Format("RGBA8", 4, False, (0xFF, 0xFF00, 0xFF0000, 0xFF000000), (28, 29), (), (_UBYTE, 1, _RGBA, 0x8058, _RGBA)),
        Format("BGRA8", 4, False, (0xFF0000, 0xFF00, 0xFF, 0xFF000000), (87, 91), (), (_UBYTE, 1, _BGRA, 0x8058, _RGBA)),
        Format("BGRX8", 4, False, 88, (88, 93), (), None),
        Format("RGB8", 3, False, (0xFF, 0xFF00, 0xFF0000, 0), (), (), (_UBYTE, 1, _RGB, 0x8051, _RGB)),
        Format("BGR8", 3, False, (0xFF0000, 0xFF00, 0xFF, 0), (), (), (_UBYTE, 1, _BGR, 0x8051, _RGB)),
        Format("R8", 1, False, 61, (61,), (), (_UBYTE, 1, _RED, 0x8229, _RED)),
        Format("R8S", 1, False, 63, (63,), (), (_BYTE, 1, _RED, 0x8F94, _RED)),
        Format("RG8", 2, False, 49, (49,), (), (_UBYTE, 1, _RG, 0x822B, _RG)),
        Format("RG8S", 2, False, 51, (51,), (), (_BYTE, 1, _RG, 0x8F95, _RG)),
        Format("A8", 1, False, 65, (65,), (), (_UBYTE, 1, _ALPHA, 0x803C, _ALPHA)),
        Format("RGB565", 2, False, 85, (85,), (), (0x8363, 2, _RGB, 0x8D62, _RGB)),
        Format("RGBA5551", 2, False, 86, (86,), (), (0x8366, 2, _RGBA, 0x8057, _RGBA)),
        Format("RGBA4444", 2, False, 115, (115,), (), (0x8365, 2, _RGBA, 0x8056, _RGBA)),
        Format("RGB10A2", 4, False, 24, (24,), (), (0x8368, 4, _RGBA, 0x8059, _RGBA)),
    )
}
ALIASES = {"DXT1": "BC1", "DXT3": "BC2", "DXT5": "BC3"}


def format_of(name: str) -> Format:
    """The format of that name; raises ValueError for others."""
    try:
        return FORMATS[ALIASES.get(name, name)]
    except KeyError:
        raise ValueError(f"unknown texture format: {name}") from None


def level_size(fmt: Format, width: int, height: int) -> int:
    """Payload bytes of one mip level."""
    width, height = max(1, width), max(1, height)
    return -(-width // 4) * -(-height // 4) * fmt.size if fmt.compressed else width * height * fmt.size


def mip_count(width: int, height: int) -> int:
    """Levels of a full chain: 1 + floor(log2(max(width, height)))."""
    return max(width, height, 1).bit_length()
