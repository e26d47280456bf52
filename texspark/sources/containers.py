"""DDS and KTX v1 containers as DataFrames.

Reading: Spark's binaryFile source finds and splits the files; a vectorised function
parses each and returns one row for each face and mip level. Writing: surfaces are
grouped by texture and each group becomes one container. A file that can't be parsed
gives one row with its error instead (or fails the query, if asked).
"""

from __future__ import annotations

import struct
import uuid
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from texspark.formats import FORMATS, Format, format_of, level_size
from texspark.functions.expressions import little_endian, to_bytes

SURFACES = "path string, container string, format string, n_faces int, n_mips int, is_srgb boolean, face int, mip int, width int, height int, payload binary, error string"
#: Largest side and level count that a header may claim.
MAX_SIDE, MAX_MIPS = 1 << 16, 17
#: Bytes of files whose surfaces are handed on together.
PARSED = 1 << 23

# Container signatures and flags.
DDS_MAGIC, DDS_HEADER = b"DDS ", 124
KTX_MAGIC = bytes.fromhex("AB4B5458203131BB0D0A1A0A")
CAPS, HEIGHT, WIDTH, PITCH, PIXEL_FORMAT, MIPS, LINEAR = 0x1, 0x2, 0x4, 0x8, 0x1000, 0x20000, 0x80000
PF_ALPHA, PF_FOURCC, PF_RGB = 0x1, 0x4, 0x40
COMPLEX, TEXTURE, MIPMAP, CUBEMAP = 0x8, 0x1000, 0x400000, 0x200
ALL_FACES = 0xFC00
SRGB_DXGI = {72, 75, 78, 29, 91, 93, 99}
ENDIAN = 0x04030201
SRGB_BPTC, RGB_BC1 = 0x8E8D, 0x83F0


class ContainerError(ValueError):
    """A container that can't be read or written."""


def _dds_format(words: tuple[int, ...], extra: bytes) -> tuple[Format, bool, int]:
    """The format of a DDS header, whether it is sRGB, and the bytes of the extra header."""
    flags, code, bits, *masks = words[19:26]
    if not flags & PF_FOURCC:
        for f in FORMATS.values():
            if isinstance(f.dds_write, tuple) and flags & PF_RGB and bits == 8 * f.size and tuple(masks) == f.dds_write and (f.size == 3 or flags & PF_ALPHA):
                return f, False, 0
        raise ContainerError("unsupported DDS pixel format")
    name = struct.pack("<I", code).decode("latin-1")
    if name == "DX10":
        if len(extra) < 20:
            raise ContainerError("DX10 header is cut short")
        dxgi, dimension, _, array, _ = struct.unpack("<5I", extra[:20])
        found = next((f for f in FORMATS.values() if dxgi in f.dxgi), None)
        if found is None:
            raise ContainerError("unsupported DX10 format")
        if dimension != 3:
            raise ContainerError("unsupported DDS resource dimension")
        if array != 1:
            raise ContainerError("DDS arrays are not supported")
        return found, dxgi in SRGB_DXGI, 20
    found = next((f for f in FORMATS.values() if name in f.fourcc), None)
    if found is None:
        raise ContainerError("unsupported DDS FourCC")
    return found, False, 0


def dds_header(data: bytes) -> dict:
    """What a DDS file's header says; raises ContainerError if it is not one."""
    if data[:4] != DDS_MAGIC:
        raise ContainerError("invalid DDS magic")
    if len(data) < 4 + DDS_HEADER:
        raise ContainerError("DDS header is cut short")
    words = struct.unpack("<31I", data[4 : 4 + DDS_HEADER])
    if words[0] != DDS_HEADER or words[18] != 32:
        raise ContainerError("invalid DDS header size")
    fmt, srgb, extra = _dds_format(words, data[4 + DDS_HEADER : 24 + DDS_HEADER])
    return {"format": fmt, "is_srgb": srgb, "height": words[2], "width": words[3], "mips": max(1, words[6]), "faces": 6 if words[27] & CUBEMAP else 1, "start": 4 + DDS_HEADER + extra}


def ktx_header(data: bytes) -> dict:
    """What a KTX v1 file's header says; raises ContainerError if it is not one."""
    if data[:12] != KTX_MAGIC:
        raise ContainerError("invalid KTX identifier")
    if len(data) < 64:
        raise ContainerError("KTX header is cut short")
    endian, gl_type, type_size, gl_format, internal, _, width, height, depth, arrays, faces, mips, pairs = struct.unpack("<13I", data[12:64])
    if endian != ENDIAN:
        raise ContainerError("unsupported KTX endianness")
    if arrays:
        raise ContainerError("KTX arrays are not supported")
    if depth > 1:
        raise ContainerError("KTX volumes are not supported")
    srgb = internal == SRGB_BPTC
    internal = {SRGB_BPTC: 0x8E8C, RGB_BC1: 0x83F1}.get(internal, internal)
    plain_bytes = gl_type == 0x1401 and type_size == 1  # the internal format then says nothing more
    for f in FORMATS.values():
        if f.ktx and (f.ktx[:4] == (gl_type, type_size, gl_format, internal) or f.compressed and gl_type == gl_format == 0 and f.ktx[3] == internal or plain_bytes and f.ktx[:3] == (gl_type, 1, gl_format)):
            return {"format": f, "is_srgb": srgb, "width": width, "height": height, "mips": max(1, mips), "faces": max(1, faces), "start": 64 + pairs}
    raise ContainerError("unsupported KTX format")


def _checked(header: dict) -> dict:
    if not (1 <= header["width"] <= MAX_SIDE and 1 <= header["height"] <= MAX_SIDE and header["mips"] <= MAX_MIPS and header["faces"] in (1, 6)):
        raise ContainerError("dimensions are out of range")
    return header


def _levels(header: dict) -> list[tuple[int, int]]:
    return [(max(1, header["width"] >> k), max(1, header["height"] >> k)) for k in range(header["mips"])]


@lru_cache(maxsize=1024)
def _layout(container: str, head: bytes) -> tuple[dict, list[tuple[int, int, int]]]:
    """What a file's first bytes say: its header, and its levels' sizes and bytes. Equal headers are read once."""
    header = _checked((ktx_header if container == "ktx" else dds_header)(head))
    return header, [(w, h, level_size(header["format"], w, h)) for w, h in _levels(header)]


def parse_dds(data: bytes) -> tuple[dict, list[tuple[int, int, int, int, bytes]]]:
    """A DDS file's header and surfaces (face, mip, width, height, payload)."""
    header, levels = _layout("dds", bytes(data[: 24 + DDS_HEADER]))
    fmt, at, out = header["format"], header["start"], []
    for face in range(header["faces"]):
        for mip, (w, h, size) in enumerate(levels):
            if at + size > len(data):
                raise ContainerError("payload is cut short")
            out.append((face, mip, w, h, _opaque(fmt, data[at : at + size])))
            at += size
    return header, out


def _opaque(fmt: Format, payload: bytes) -> bytes:
    """BGRX pixels with a full fourth byte."""
    if fmt.name != "BGRX8":
        return payload
    out = bytearray(payload)
    out[3::4] = b"\xff" * (len(out) // 4)
    return bytes(out)


def _flipped(payload: bytes, stride: int, row: int, height: int, to_stride: int) -> bytes:
    """Rows from bottom to top, each cut or padded to another stride."""
    return b"".join(payload[(height - 1 - y) * stride :][:row].ljust(to_stride, b"\0") for y in range(height))


def parse_ktx(data: bytes) -> tuple[dict, list[tuple[int, int, int, int, bytes]]]:
    """A KTX v1 file's header and surfaces; uncompressed rows come top down and without padding."""
    header, levels = _layout("ktx", bytes(data[:64]))
    fmt, at, out = header["format"], header["start"], []
    for mip, (w, h, bytes_) in enumerate(levels):
        if at + 4 > len(data):
            raise ContainerError("payload is cut short")
        (size,) = struct.unpack("<I", data[at : at + 4])
        at += 4
        row = w * fmt.size
        least = bytes_ if fmt.compressed else (row + -row % 4) * h
        size = size or least
        for face in range(header["faces"]):
            if size < least or at + size > len(data):
                raise ContainerError("payload is cut short")
            payload = data[at : at + size]
            out.append((face, mip, w, h, payload if fmt.compressed else _flipped(payload, row + -row % 4, row, h, row)))
            at += size + (-size % 4 if header["faces"] == 6 else 0)
        at += -size % 4
    return header, sorted(out)


def read_textures(spark: SparkSession, path: str, strict: bool = False) -> DataFrame:
    """Surfaces of the .dds and .ktx files of a path, each file a texture."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.{dds,ktx,DDS,KTX}").option("recursiveFileLookup", "true").load(path)
    return parse_files(files.select("path", "content"), strict)


def parse_files(files: DataFrame, strict: bool = False) -> DataFrame:
    """Surfaces of files (path, content); works on streams too."""

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, held = [], 0
            for path, content in zip(batch.column("path").to_pylist(), batch.column("content"), strict=True):
                data = content.as_py() or b""
                rows += surfaces(path, data)
                held += len(data)
                if held >= PARSED:
                    yield together(rows)
                    rows, held = [], 0
            if rows:
                yield together(rows)

    def together(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(zip(*rows, strict=True), arrow.types, strict=True)], schema=arrow)

    def surfaces(path: str, data: bytes) -> list[tuple]:
        kind = "ktx" if data[:4] == KTX_MAGIC[:4] else "dds"
        try:
            header, found = (parse_ktx if kind == "ktx" else parse_dds)(data)
        except ContainerError as e:
            if strict:
                raise
            return [(path, kind, *[None] * 9, str(e))]
        same = (path, kind, header["format"].name, header["faces"], header["mips"], header["is_srgb"])
        return [(*same, *surface, None) for surface in found]

    kinds = {"string": pa.string(), "int": pa.int32(), "boolean": pa.bool_(), "binary": pa.binary()}
    arrow = pa.schema([(n, kinds[k]) for n, k in (f.split() for f in SURFACES.split(", "))])
    return files.mapInArrow(parse, SURFACES)


def dds_head(fmt: Format, width: int, height: int, n_faces: int, mips: int) -> bytes:
    """A DDS file up to its first payload."""
    flags, caps = CAPS | HEIGHT | WIDTH | PIXEL_FORMAT, TEXTURE
    flags |= LINEAR if fmt.compressed else PITCH
    if mips > 1:
        flags, caps = flags | MIPS, caps | COMPLEX | MIPMAP
    if n_faces == 6:
        caps |= COMPLEX
    if isinstance(fmt.dds_write, tuple):
        r, g, b, a = fmt.dds_write
        pixel = (32, PF_RGB | (PF_ALPHA if a else 0), 0, 8 * fmt.size, r, g, b, a)
    else:
        code = fmt.dds_write if isinstance(fmt.dds_write, str) else "DX10"
        pixel = (32, PF_FOURCC, struct.unpack("<I", code.encode())[0], 0, 0, 0, 0, 0)
    pitch = 0 if fmt.compressed else width * fmt.size
    words = (DDS_HEADER, flags, height, width, pitch, 1, mips, *[0] * 11, *pixel, caps, CUBEMAP | ALL_FACES if n_faces == 6 else 0, 0, 0, 0)
    extra = struct.pack("<5I", fmt.dds_write, 3, 0x4 if n_faces == 6 else 0, 1, 0) if isinstance(fmt.dds_write, int) else b""
    return DDS_MAGIC + struct.pack("<31I", *words) + extra


def ktx_head(fmt: Format, width: int, height: int, n_faces: int, mips: int) -> bytes:
    """A KTX v1 file up to its first level."""
    if fmt.ktx is None:
        raise ContainerError(f"KTX can't hold {fmt.name}")
    gl_type, type_size, gl_format, internal, base = fmt.ktx
    return KTX_MAGIC + struct.pack("<13I", ENDIAN, gl_type, type_size, gl_format, internal, base, width, height, 0, 0, n_faces, mips, 0)


def stored_level(container: str, fmt: Format, width: int, height: int, payload: bytes, face: int, n_faces: int) -> bytes:
    """What a file holds for one face of a level: KTX sizes before the first face and padding included, rows in the file's order."""
    if container == "dds":
        return _opaque(fmt, payload)
    row = width * fmt.size
    stored = payload if fmt.compressed else _flipped(payload, row, row, height, row + -row % 4)
    size = struct.pack("<I", len(stored)) if face == 0 else b""
    return size + stored + bytes(-len(stored) % 4 if n_faces == 6 or face == n_faces - 1 else 0)


def build_dds(fmt: Format, width: int, height: int, faces: list[list[bytes]]) -> bytes:
    """A DDS file of faces with mip payloads."""
    return dds_head(fmt, width, height, len(faces), len(faces[0])) + b"".join(stored_level("dds", fmt, 0, 0, p, 0, 1) for face in faces for p in face)


def build_ktx(fmt: Format, width: int, height: int, faces: list[list[bytes]]) -> bytes:
    """A KTX v1 file of faces with mip payloads."""
    levels = range(len(faces[0]))
    return ktx_head(fmt, width, height, len(faces), len(levels)) + b"".join(stored_level("ktx", fmt, max(1, width >> m), max(1, height >> m), face[m], k, len(faces)) for m in levels for k, face in enumerate(faces))


@lru_cache(maxsize=1024)
def _plan(container: str, name: str, width: int, height: int, n_faces: int, n_mips: int) -> tuple[bytes, Format, list[tuple[int, int, int]]]:
    """The first bytes of a file, its format, and its levels' sizes and bytes."""
    fmt = format_of(name)
    sizes = [(max(1, width >> m), max(1, height >> m)) for m in range(n_mips)]
    return (ktx_head if container == "ktx" else dds_head)(fmt, width, height, n_faces, n_mips), fmt, [(w, h, level_size(fmt, w, h)) for w, h in sizes]


def build_files(surfaces: DataFrame, container: str) -> DataFrame:
    """Containers (texture_id, content) of surfaces (texture_id, format, face, mip, width, height, payload).

    A texture has one or six faces, each with the same levels of the right sizes; others
    fail the query. One shuffle by texture; a row is one texture then.
    """

    def content_of(faces: list[int], mips: list[int], widths: list[int], heights: list[int], name: str, payloads: list[bytes]) -> bytes:
        n_faces, n_mips = faces[-1] + 1, max(mips) + 1
        if n_faces not in (1, 6) or len(faces) != n_faces * n_mips:
            raise ContainerError(orderly)
        head, fmt, levels = _plan(container, name, widths[0], heights[0], n_faces, n_mips)
        if faces != [f for f in range(n_faces) for _ in levels] or mips != [*range(n_mips)] * n_faces:
            raise ContainerError(orderly)
        if list(zip(widths, heights, map(len, payloads), strict=True)) != levels * n_faces:
            raise ContainerError("a level has the wrong size")
        if container == "dds":
            return head + b"".join([_opaque(fmt, p) for p in payloads])
        return head + b"".join([stored_level("ktx", fmt, w, h, payloads[f * n_mips + m], f, n_faces) for m, (w, h, _) in enumerate(levels) for f in range(n_faces)])

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            surfaces_ = batch.column("surfaces")
            flat = surfaces_.flatten()
            face, mip, width, height, name, payload = (pc.struct_field(flat, n).to_pylist() for n in ("face", "mip", "width", "height", "format", "payload"))
            content, at = [], 0
            for n in pc.list_value_length(surfaces_).to_pylist():
                own = slice(at, at + n)
                content.append(content_of(face[own], mip[own], width[own], height[own], name[at], payload[own]))
                at += n
            yield pa.record_batch({"texture_id": batch.column("texture_id"), "content": pa.array(content, pa.binary())})

    orderly = "a texture has one or six faces with the same levels"
    if container not in ("dds", "ktx"):
        raise ValueError(f"unknown container: {container}")
    kind = surfaces.schema["texture_id"].dataType.simpleString()
    whole = F.sort_array(F.collect_list(F.struct("face", "mip", "width", "height", "format", "payload"))).alias("surfaces")
    return surfaces.groupBy("texture_id").agg(whole).mapInArrow(build, f"texture_id {kind}, content binary")


def header_of(files: DataFrame) -> DataFrame:
    """files with container, width and height, from the first bytes of content alone, as column expressions."""
    head = F.substring(F.col("content"), 1, 64)
    is_ktx = F.hex(F.substring(head, 1, 12)) == KTX_MAGIC.hex().upper()
    is_dds = F.hex(F.substring(head, 1, 4)) == DDS_MAGIC.hex().upper()
    pick = lambda ktx, dds: F.when(is_ktx, little_endian(head, ktx, 4)).when(is_dds, little_endian(head, dds, 4)).cast("int")
    return files.select("*", F.when(is_ktx, "ktx").when(is_dds, "dds").alias("container"), pick(36, 16).alias("width"), pick(40, 12).alias("height"))


#: Fields of the headers and their places: 32-bit little-endian words.
DDS_FIELDS = {"flags": 8, "height": 12, "width": 16, "pitch": 20, "depth": 24, "mips": 28, "pixel_flags": 80, "fourcc": 84, "bits": 88, "r_mask": 92, "g_mask": 96, "b_mask": 100, "a_mask": 104, "caps": 108, "caps2": 112}
DX10_FIELDS = {"dxgi": 128, "dimension": 132, "misc": 136, "array_size": 140, "misc2": 144}
KTX_FIELDS = {"endianness": 12, "gl_type": 16, "type_size": 20, "gl_format": 24, "gl_internal_format": 28, "gl_base_format": 32, "width": 36, "height": 40, "depth": 44, "array_elements": 48, "faces": 52, "mips": 56, "key_value_bytes": 60}


# Marks of the plain header.
PLAIN_MARK, PLAIN_MASKS = 0x31464E45, (0x00FF0000, 0x0000FF00, 0x000000FF, 0xFF000000)


def plain_dds_headers(sizes: DataFrame) -> DataFrame:
    """sizes (width, height, mips, any other columns) with header, the 124 bytes of a DDS header of 32-bit pixels by masks, as column expressions.

    mips 0 stands for a header that doesn't tell levels. Null sizes have a null header.
    """
    many = F.col("mips") > 0
    flags = F.lit(CAPS | HEIGHT | WIDTH | PITCH | PIXEL_FORMAT) + F.when(many, MIPS).otherwise(0)
    caps = F.lit(TEXTURE) + F.when(many, COMPLEX | MIPMAP).otherwise(0)
    words = [DDS_HEADER, flags, F.col("height"), F.col("width"), F.col("width").cast("long") * 4, 0, F.col("mips"), 0, PLAIN_MARK, *[0] * 9, 32, PF_RGB | PF_ALPHA, 0, 32, *PLAIN_MASKS, caps, *[0] * 4]
    return sizes.withColumn("header", F.concat(*(to_bytes(F.lit(w) if isinstance(w, int) else w, 4) for w in words)))


def dds_headers(files: DataFrame) -> DataFrame:
    """files of DDS kind with the fields of their headers, those of the DX10 header (null without one) among them, as column expressions; content is dropped."""
    head = F.substring(F.col("content"), 1, 148)
    found = files.where(F.hex(F.substring(head, 1, 4)) == DDS_MAGIC.hex().upper())
    more = F.col("fourcc") == struct.unpack("<I", b"DX10")[0]
    fields = {n: little_endian(head, at, 4) for n, at in {**DDS_FIELDS, **DX10_FIELDS}.items()}
    return found.withColumns(fields).withColumns({n: F.when(more, F.col(n)) for n in DX10_FIELDS}).drop("content")


def ktx_headers(files: DataFrame) -> DataFrame:
    """files of KTX v1 kind with the fields of their headers, as column expressions; content is dropped."""
    head = F.substring(F.col("content"), 1, 64)
    found = files.where(F.hex(F.substring(head, 1, 12)) == KTX_MAGIC.hex().upper())
    return found.withColumns({n: little_endian(head, at, 4) for n, at in KTX_FIELDS.items()}).drop("content")


def write_files(files: DataFrame, uri: str) -> tuple[int, int]:
    """Write files (path, relative and without `..`; content) below a folder that driver and executors share; how many, and their bytes.

    Tasks write to a name of their own and move it into place, so a task that runs again
    does no harm. Equal paths overwrite each other; null content writes an empty file.
    """

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = pafs.FileSystem.from_uri(uri)
        for batch in batches:
            sizes = []
            for path, content in zip(batch.column("path").to_pylist(), batch.column("content"), strict=True):
                if not path or path.startswith("/") or ".." in path.split("/"):
                    raise ContainerError(f"no relative path: {path}")
                target, data = f"{base}/{path}", content.as_py() or b""
                store.create_dir(target.rpartition("/")[0], recursive=True)
                with store.open_output_stream(part := f"{target}.{uuid.uuid4().hex}") as f:
                    f.write(data)
                store.move(part, target)
                sizes.append(len(data))
            yield pa.record_batch({"bytes": pa.array(sizes, pa.int64())})

    row = files.select("path", "content").mapInArrow(write, "bytes long").agg(F.count("*").alias("n"), F.coalesce(F.sum("bytes"), F.lit(0)).alias("bytes")).first()
    return row.n, row.bytes
