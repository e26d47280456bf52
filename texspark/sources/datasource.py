"""DDS and KTX v1 files as Spark data sources: spark.read / write / readStream / writeStream with format("dds") or format("ktx").

Reading: files are dealt to partitions by size. A header is read first, then only the
byte ranges of the faces and levels that are wanted: filters on path, face and mip are
pushed down (with spark.sql.python.filterPushdown.enabled), and with the option
headers=true no payload is read at all.

Writing: a task streams its surfaces into files in a folder of the job; the driver's
commit moves them into place, an abort removes the folder, so a job that fails leaves
nothing behind.
"""

from __future__ import annotations

import struct
import uuid
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, DataSourceStreamArrowWriter, DataSourceStreamReader, EqualTo, Filter, In, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

from texspark.formats import format_of, level_size
from texspark.sources import containers
from texspark.sources.containers import ContainerError

#: Rows of headers alone.
HEADERS = "path string, container string, format string, n_faces int, n_mips int, is_srgb boolean, width int, height int, length long, error string"
#: What a writer takes; path is the file's name without its ending.
WRITTEN = "path string, format string, n_faces int, n_mips int, face int, mip int, width int, height int, payload binary"
#: Bytes of a header that are read before anything else.
HEAD = 148
_KINDS = {"string": pa.string(), "int": pa.int32(), "long": pa.int64(), "boolean": pa.bool_(), "binary": pa.binary()}


def arrow_schema(ddl: str) -> pa.Schema:
    return pa.schema([(n, _KINDS[k]) for n, k in (f.split() for f in ddl.split(", "))])


def located(path: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a path or URI, and the path in it."""
    return pafs.FileSystem.from_uri(path) if ":" in path.split("/")[0] else (pafs.LocalFileSystem(), path)


def ranges(kind: str, header: dict) -> Iterator[tuple[int, int, int, int, int | None, int]]:
    """(face, mip, width, height, offset, size) of each surface of a file, in its order; KTX levels have offset None, as the sizes before them say where they begin."""
    levels = containers._levels(header)
    if kind == "dds":
        at = header["start"]
        for face in range(header["faces"]):
            for mip, (w, h) in enumerate(levels):
                size = level_size(header["format"], w, h)
                yield face, mip, w, h, at, size
                at += size
    else:
        for mip, (w, h) in enumerate(levels):
            row = w * header["format"].size
            size = level_size(header["format"], w, h) if header["format"].compressed else (row + -row % 4) * h
            for face in range(header["faces"]):
                yield face, mip, w, h, None, size


def surfaces_of(kind: str, file: pa.NativeFile, header: dict, wanted) -> Iterator[tuple[int, int, int, int, bytes]]:
    """Surfaces (face, mip, width, height, payload) of an open file that `wanted(face, mip)` asks for."""
    fmt, length = header["format"], file.size()

    def read(at: int, size: int) -> bytes:
        if at + size > length:
            raise ContainerError("payload is cut short")
        return file.read_at(size, at)

    at = header["start"]
    for face, mip, w, h, offset, size in ranges(kind, header):
        if kind == "dds":
            if offset + size > length:
                raise ContainerError("payload is cut short")
            if wanted(face, mip):
                yield face, mip, w, h, containers._opaque(fmt, read(offset, size))
            continue
        if face == 0:
            (told,) = struct.unpack("<I", read(at, 4))
            told, at = told or size, at + 4
            if told < size:
                raise ContainerError("payload is cut short")
        if at + told > length:
            raise ContainerError("payload is cut short")
        if wanted(face, mip):
            data = read(at, told)
            row = w * fmt.size
            yield face, mip, w, h, data if fmt.compressed else containers._flipped(data, row + -row % 4, row, h, row)
        at += told + (-told % 4 if header["faces"] == 6 or face == header["faces"] - 1 else 0)


@dataclass
class Files(InputPartition):
    """Files (path, length) of one task."""

    files: list[tuple[str, int]]


class _Options:
    """path: a file or folder; headers: true for headers alone; strict: true to fail at a broken file; maxPartitionBytes."""

    def __init__(self, kind: str, options: dict[str, str]):
        self.kind, self.path = kind, options.get("path")
        if not self.path:
            raise ValueError(f"format({kind!r}) needs a path")
        self.headers = options.get("headers", "false").lower() == "true"
        self.strict = options.get("strict", "false").lower() == "true"
        self.most = int(options.get("maxPartitionBytes", 64 << 20))
        self.faces: set[int] | None = None
        self.mips: set[int] | None = None
        self.paths: set[str] | None = None

    def found(self) -> list[tuple[str, int, int]]:
        """(path, length, time of change in nanoseconds) of the files; names that begin with _ or . are hidden."""
        store, base = located(self.path)
        info = store.get_file_info(base)
        if info.type == pafs.FileType.NotFound:
            raise FileNotFoundError(self.path)
        every = [info] if info.is_file else store.get_file_info(pafs.FileSelector(base, recursive=True))
        hidden = lambda f: any(p[0] in "_." for p in f.path[len(base) :].split("/") if p)
        return sorted((f.path, f.size, f.mtime_ns or 0) for f in every if f.is_file and f.path.lower().endswith(f".{self.kind}") and not hidden(f))

    def dealt(self, files: list[tuple[str, int]]) -> list[Files]:
        """Files in order, so many to a partition that it has maxPartitionBytes (headers count as such)."""
        out, held, size = [], [], 0
        for path, length in files:
            cost = 4096 if self.headers else length + 4096
            if held and size + cost > self.most:
                out.append(Files(held))
                held, size = [], 0
            held.append((path, length))
            size += cost
        return [*out, *([Files(held)] if held else [])]

    def rows(self, partition: Files) -> Iterator[pa.RecordBatch]:
        store, schema = located(self.path)[0], arrow_schema(HEADERS if self.headers else containers.SURFACES)
        wanted = lambda face, mip: (self.faces is None or face in self.faces) and (self.mips is None or mip in self.mips)
        for path, length in partition.files:
            known = {"path": path, "container": self.kind}
            try:
                with store.open_input_file(path) as file:
                    head = file.read_at(min(HEAD, length), 0)
                    header = containers._checked((containers.ktx_header if self.kind == "ktx" else containers.dds_header)(head))
                    known |= {"format": header["format"].name, "n_faces": header["faces"], "n_mips": header["mips"], "is_srgb": header["is_srgb"]}
                    if self.headers:
                        yield pa.RecordBatch.from_pylist([known | {"width": header["width"], "height": header["height"], "length": length, "error": None}], schema=schema)
                        continue
                    for face, mip, w, h, payload in surfaces_of(self.kind, file, header, wanted):
                        yield pa.RecordBatch.from_pylist([known | {"face": face, "mip": mip, "width": w, "height": h, "payload": payload, "error": None}], schema=schema)
            except ContainerError as e:
                if self.strict:
                    raise
                yield pa.RecordBatch.from_pylist([dict.fromkeys(schema.names) | {"path": path, "container": self.kind, "error": str(e)} | ({"length": length} if self.headers else {})], schema=schema)


class TextureReader(DataSourceReader):
    def __init__(self, options: _Options):
        self.options = options

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Equality and IN on path, face and mip choose what is read; Spark applies all others, and these again to rows with an error."""
        for f in filters:
            values = {f.value} if isinstance(f, EqualTo) else set(f.value) if isinstance(f, In) else None
            name = {"face": "faces", "mip": "mips", "path": "paths"}.get(f.attribute[0]) if values is not None and len(f.attribute) == 1 else None
            if name and not (self.options.headers and name != "paths"):
                before = getattr(self.options, name)
                setattr(self.options, name, values if before is None else before & values)
            yield f

    def partitions(self) -> list[Files]:
        return self.options.dealt([(p, n) for p, n, _ in self.options.found() if self.options.paths is None or p in self.options.paths])

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        return self.options.rows(partition)


class TextureStreamReader(DataSourceStreamReader):
    """New files by their time of change and path: one that is older than the newest that was read is not seen."""

    def __init__(self, options: _Options):
        self.options = options

    def initialOffset(self) -> dict:
        return {"time": -1, "path": ""}

    def latestOffset(self) -> dict:
        return max(({"time": t, "path": p} for p, _, t in self.options.found()), key=lambda x: (x["time"], x["path"]), default=self.initialOffset())

    def partitions(self, start: dict, end: dict) -> list[Files]:
        low, high = ((x["time"], x["path"]) for x in (start, end))
        return self.options.dealt([(p, n) for p, n, t in self.options.found() if low < (t, p) <= high])

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        return self.options.rows(partition)

    def commit(self, end: dict) -> None:
        pass


@dataclass
class Written(WriterCommitMessage):
    """A task's files: where they are, where they belong."""

    files: list[tuple[str, str]]


class _File:
    """One container that is being written, surface by surface in the file's order."""

    def __init__(self, store: pafs.FileSystem, place: str, kind: str, row: dict):
        self.row, self.kind, self.fmt, self.next = row, kind, format_of(row["format"]), 0
        faces, mips = row["n_faces"], row["n_mips"]
        if faces not in (1, 6) or not 1 <= mips <= containers.MAX_MIPS:
            raise ContainerError("a texture has one or six faces with the same levels")
        self.order = [(f, m) for f in range(faces) for m in range(mips)] if kind == "dds" else [(f, m) for m in range(mips) for f in range(faces)]
        head = (containers.dds_head if kind == "dds" else containers.ktx_head)(self.fmt, row["width"], row["height"], faces, mips)
        self.out = store.open_output_stream(place)
        self.out.write(head)

    def put(self, row: dict) -> None:
        w, h = (max(1, self.row[k] >> row["mip"]) for k in ("width", "height"))
        if self.next == len(self.order) or (row["face"], row["mip"]) != self.order[self.next]:
            raise ContainerError("a texture's faces and levels are missing, doubled or out of order")
        if (row["width"], row["height"]) != (w, h) or len(row["payload"] or b"") != level_size(self.fmt, w, h) or row["format"] != self.row["format"]:
            raise ContainerError("a level has the wrong size")
        self.out.write(containers.stored_level(self.kind, self.fmt, w, h, row["payload"], row["face"], self.row["n_faces"]))
        self.next += 1

    def close(self) -> None:
        self.out.close()
        if self.next < len(self.order):
            raise ContainerError("a texture's faces and levels are missing, doubled or out of order")


class _Writer:
    """Surfaces (see WRITTEN) to files; each texture's come together and in the file's order, as clustered() puts them."""

    def __init__(self, kind: str, path: str, overwrite: bool):
        self.kind, self.path, self.overwrite, self.job = kind, path, overwrite, uuid.uuid4().hex

    def _folder(self) -> str:
        return f"{located(self.path)[1].rstrip('/')}/_temporary-{self.job}"

    def write(self, batches: Iterator[pa.RecordBatch]) -> Written:
        store, base = located(self.path)
        own, files, seen, open_file = f"{self._folder()}/{uuid.uuid4().hex}", [], set(), None
        store.create_dir(own, recursive=True)
        try:
            for batch in batches:
                for row in batch.to_pylist():
                    name = row["path"]
                    if open_file is None or name != open_file.row["path"]:
                        if open_file:
                            open_file.close()
                        if not name or name.startswith("/") or ".." in name.split("/") or name[0] in "_." or name in seen:
                            raise ContainerError(f"no relative path, or one that comes back: {name}")
                        seen.add(name)
                        files.append((f"{own}/{len(files)}", f"{base.rstrip('/')}/{name}.{self.kind}"))
                        open_file = _File(store, files[-1][0], self.kind, row)
                    open_file.put(row)
            if open_file:
                open_file.close()
        except BaseException:
            if open_file and not open_file.out.closed:
                open_file.out.close()
            store.delete_dir(own)
            raise
        return Written(files)

    def finish(self, messages: list[Written | None]) -> None:
        """Move the files of all tasks into place."""
        store, base = located(self.path)
        moves = [move for m in messages if m for move in m.files]
        store.create_dir(base, recursive=True)
        if self.overwrite:
            kept = {to for _, to in moves}
            for f in store.get_file_info(pafs.FileSelector(base, recursive=True)):
                if f.is_file and f.path.lower().endswith(f".{self.kind}") and "/_temporary-" not in f.path and f.path not in kept:
                    store.delete_file(f.path)
        for folder in {to.rpartition("/")[0] for _, to in moves}:
            store.create_dir(folder, recursive=True)
        with ThreadPoolExecutor(16) as pool:
            list(pool.map(lambda move: store.move(*move), moves))
        self.clear()

    def clear(self) -> None:
        store = located(self.path)[0]
        if store.get_file_info(self._folder()).type != pafs.FileType.NotFound:
            store.delete_dir(self._folder())


class TextureWriter(_Writer, DataSourceArrowWriter):
    def commit(self, messages: list[Written | None]) -> None:
        self.finish(messages)

    def abort(self, messages: list[Written | None]) -> None:
        self.clear()


class TextureStreamWriter(_Writer, DataSourceStreamArrowWriter):
    def commit(self, messages: list[Written | None], batchId: int) -> None:
        self.finish(messages)

    def abort(self, messages: list[Written | None], batchId: int) -> None:
        self.clear()


class DDSSource(DataSource):
    KIND = "dds"

    @classmethod
    def name(cls) -> str:
        return cls.KIND

    def schema(self) -> str:
        return HEADERS if self.options.get("headers", "false").lower() == "true" else containers.SURFACES

    def reader(self, schema: StructType) -> TextureReader:
        return TextureReader(_Options(self.KIND, self.options))

    def streamReader(self, schema: StructType) -> TextureStreamReader:
        return TextureStreamReader(_Options(self.KIND, self.options))

    def writer(self, schema: StructType, overwrite: bool) -> TextureWriter:
        _checked_schema(schema)
        return TextureWriter(self.KIND, self.options["path"], overwrite)

    def streamWriter(self, schema: StructType, overwrite: bool) -> TextureStreamWriter:
        _checked_schema(schema)
        return TextureStreamWriter(self.KIND, self.options["path"], False)


class KTXSource(DDSSource):
    KIND = "ktx"


def _checked_schema(schema: StructType) -> None:
    missing = {f.split()[0] for f in WRITTEN.split(", ")} - set(schema.names)
    if missing:
        raise ContainerError(f"columns are missing: {', '.join(sorted(missing))}")


def register(spark: SparkSession) -> None:
    """Make format("dds") and format("ktx") known to a session."""
    spark.dataSource.register(DDSSource)
    spark.dataSource.register(KTXSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")


def clustered(surfaces: DataFrame, kind: str) -> DataFrame:
    """Surfaces (see WRITTEN) in the order in which a writer takes them: one shuffle by file, a task holds one surface at a time."""
    order = ("face", "mip") if kind == "dds" else ("mip", "face")
    return surfaces.selectExpr(*(f"CAST({n} AS {k}) AS {n}" for n, k in (f.split() for f in WRITTEN.split(", ")))).repartition("path").sortWithinPartitions("path", *order)


def write_textures(surfaces: DataFrame, kind: str, path: str, mode: str = "append") -> None:
    """Write surfaces (see WRITTEN) as files <path>/<path column>.<kind>; all of them, or none if the job fails. Equal names replace each other."""
    register(surfaces.sparkSession)
    clustered(surfaces, kind).write.format(kind).mode(mode).save(path)


def read_textures(spark: SparkSession, kind: str, path: str, **options: str) -> DataFrame:
    """Surfaces (containers.SURFACES), or with headers="true" a row for each file (HEADERS)."""
    register(spark)
    return spark.read.format(kind).options(**options).load(path)
