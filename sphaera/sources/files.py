"""Python data sources: STAR tables, SPIDER documents, MRC stacks and volumes, headerless float32 stacks.

Files are opened through pyarrow's file systems on driver and executors, by path or URI.  Text bodies are cut into byte
ranges at line ends and stacks into image ranges, so a large file is read by many tasks.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import ArrayType, DoubleType, FloatType, IntegerType, LongType, StringType, StructField, StructType

RANGE_BYTES = 64 << 20
MRC_TYPES = {0: np.dtype("i1"), 1: np.dtype("<i2"), 2: np.dtype("<f4"), 6: np.dtype("<u2")}


def locate(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path) if ":" in path.split("/", 1)[0] else (pafs.LocalFileSystem(), path)


def file_size(path: str) -> int:
    fs, inner = locate(path)
    return fs.get_file_info(inner).size


def files_of(path: str) -> list[str]:
    """The file itself, or the files of a folder by name; names that begin with a dot or an underscore are hidden."""
    fs, inner = locate(path)
    if fs.get_file_info(inner).type != pafs.FileType.Directory:
        return [path]
    names = sorted(f.base_name for f in fs.get_file_info(pafs.FileSelector(inner)) if f.type == pafs.FileType.File and f.base_name[0] not in "._" and f.size)
    return [f"{path.rstrip('/')}/{n}" for n in names]


@dataclass
class ByteRange(InputPartition):
    path: str
    start: int
    stop: int
    first: int


def lines_between(path: str, start: int, stop: int, first: int) -> Iterator[str]:
    """Lines that begin in [start, stop); first is where the body begins."""
    fs, inner = locate(path)
    with fs.open_input_file(inner) as f:
        at = start
        if start > first:
            f.seek(start - 1)
            at = start - 1
        else:
            f.seek(start)
        rest, skip = b"", start > first
        while True:
            block = f.read(1 << 20)
            rest += block
            *done, rest = rest.split(b"\n")
            if not block:
                done, rest = ([rest] if rest else []), b""
            for line in done:
                begin, at = at, at + len(line) + 1
                if skip:
                    skip = False
                    continue
                if begin >= stop:
                    return
                yield line.decode("utf-8", "replace")
            if not block:
                return


@dataclass(frozen=True)
class StarBlock:
    name: str
    columns: tuple[str, ...]
    body: int  # byte of the first row
    end: int  # byte after the last row, or -1 for the end of the file


def star_blocks(path: str) -> list[StarBlock]:
    """The loop tables of a file.  A table ends at a blank line or at the next data_ line, wherever in the file that is.

    One pass over the file, line by line; only headers are kept.
    """
    out: list[StarBlock] = []
    name, columns, at, body = "", [], 0, None
    fs, inner = locate(path)
    with fs.open_input_stream(inner, buffer_size=1 << 20) as f:
        for line in _lines(f):
            first = line[:1]
            plain = body is not None and first not in b"d \t\r\n#_"
            text = "" if plain else line.decode("utf-8", "replace").strip()
            if plain:
                pass
            elif text.startswith("data_") or (not text and body is not None):
                if body is not None:
                    out.append(StarBlock(name, tuple(columns), body, at))
                    columns, body = [], None
                if text:
                    name = text[5:]
            elif text.startswith("_") and body is None:
                columns.append(text.split()[0][1:])
            elif text and not text.startswith(("loop_", "#")) and columns and body is None:
                body = at
            at += len(line)
    if body is not None:
        out.append(StarBlock(name, tuple(columns), body, -1))
    return out


def _lines(f: pa.NativeFile) -> Iterator[bytes]:
    """Lines of a stream with their ends."""
    rest = b""
    while block := f.read(1 << 20):
        *done, rest = (rest + block).split(b"\n")
        yield from (x + b"\n" for x in done)
    if rest:
        yield rest


def _star_block(path: str, block: str | None) -> StarBlock:
    blocks = star_blocks(path)
    if not blocks:
        raise ValueError(f"{path}: no loop table")
    if block:
        named = [b for b in blocks if b.name == block]
        if not named:
            raise ValueError(f"{path}: no table {block!r}")
        return named[0]
    rest = [b for b in blocks if b.name != "optics"]
    return rest[0] if rest else blocks[0]


class StarSource(DataSource):
    """format("star").option("block", name).load(path): one row per line of a loop table, columns by its header.

    path: a file, or a folder of files with the same columns.  A column is numeric if its first value is; a later value
    that is not a number, or a row of another width, is an error.
    """

    @classmethod
    def name(cls) -> str:
        return "star"

    def schema(self) -> StructType:
        path = files_of(self.options["path"])[0]
        b = _star_block(path, self.options.get("block"))
        first = next(lines_between(path, b.body, b.body + 1, b.body)).split()
        return StructType([StructField(c, DoubleType() if _number(v) else StringType()) for c, v in zip(b.columns, first, strict=False)])

    def reader(self, schema: StructType) -> DataSourceReader:
        return StarReader(self.options["path"], self.options.get("block"), schema)


def _number(v: str) -> bool:
    try:
        float(v)
    except ValueError:
        return False
    return True


class StarReader(DataSourceReader):
    def __init__(self, path: str, block: str | None, schema: StructType):
        self.path, self.block, self.names, self.kinds = path, block, tuple(schema.fieldNames()), [isinstance(f.dataType, DoubleType) for f in schema.fields]

    def partitions(self) -> Sequence[InputPartition]:
        out = []
        for path in files_of(self.path):
            b = _star_block(path, self.block)
            if b.columns != self.names:
                raise ValueError(f"{path}: other columns than the folder's first file")
            stop = b.end if b.end >= 0 else file_size(path)
            out += [ByteRange(path, a, min(a + RANGE_BYTES, stop), b.body) for a in range(b.body, stop, RANGE_BYTES)]
        return out

    def read(self, partition: ByteRange) -> Iterator[tuple]:
        for line in lines_between(partition.path, partition.start, partition.stop, partition.first):
            v = line.split()
            if not v or v[0].startswith("#"):
                continue
            if len(v) != len(self.kinds):
                raise ValueError(f"{partition.path}: a row of {len(v)} values in a table of {len(self.kinds)} columns: {line[:80]!r}")
            yield tuple(float(x) if k else x for x, k in zip(v, self.kinds, strict=True))


class SpiderSource(DataSource):
    """format("spider").load(path): rows of numbers as key and values; comment lines and the column count are dropped.

    path: a file, or a folder of files.
    """

    @classmethod
    def name(cls) -> str:
        return "spider"

    def schema(self) -> StructType:
        return StructType([StructField("cols", ArrayType(DoubleType()))])

    def reader(self, schema: StructType) -> DataSourceReader:
        return SpiderReader(self.options["path"])


class SpiderReader(DataSourceReader):
    def __init__(self, path: str):
        self.path = path

    def partitions(self) -> Sequence[InputPartition]:
        return [ByteRange(p, a, min(a + RANGE_BYTES, n), 0) for p in files_of(self.path) for n in [file_size(p)] for a in range(0, n, RANGE_BYTES)]

    def read(self, partition: ByteRange) -> Iterator[tuple]:
        for line in lines_between(partition.path, partition.start, partition.stop, 0):
            v = line.split()
            if v and ";" not in v[0]:
                yield ([float(x) for k, x in enumerate(v) if k != 1],)


@dataclass(frozen=True)
class MrcHeader:
    nx: int
    ny: int
    nz: int
    mode: int
    data: int

    @property
    def dtype(self) -> np.dtype:
        return MRC_TYPES[self.mode]


def mrc_header(path: str) -> MrcHeader:
    fs, inner = locate(path)
    with fs.open_input_file(inner) as f:
        h = np.frombuffer(f.read(1024), "<i4")
    if h[3] not in MRC_TYPES:
        raise ValueError(f"{path}: pixel mode {h[3]} is not supported")
    return MrcHeader(int(h[0]), int(h[1]), int(h[2]), int(h[3]), 1024 + int(h[23]))


def mrc_bytes(images: np.ndarray) -> bytes:
    """An MRC file of float32 images (n x ny x nx)."""
    n, ny, nx = images.shape
    data = images.astype("<f4")
    h = np.zeros(256, "<i4")
    h[0:3], h[3], h[7:10] = (nx, ny, n), 2, (nx, ny, n)
    h[10:13].view("<f4")[:] = (nx, ny, n)
    h[13:16].view("<f4")[:] = 90.0
    h[16:19] = (1, 2, 3)
    if data.size:
        h[19:22].view("<f4")[:] = (data.min(), data.max(), data.mean())
    raw = bytearray(h.tobytes())
    raw[208:212], raw[212:216] = b"MAP ", b"\x44\x44\x00\x00"
    return bytes(raw) + data.tobytes()


def box_size(path: str, images: int) -> int:
    """Side of the square float32 images of a headerless stack."""
    return int(round((file_size(path) / (4 * images)) ** 0.5))


@dataclass
class ImageRange(InputPartition):
    start: int
    stop: int


class StackSource(DataSource):
    """format("mrcs").load(path): img_id, px (row by row).  With option("box", n) the file is headerless float32; the
    options "first" and "last" (exclusive) bound the images that are read at all."""

    @classmethod
    def name(cls) -> str:
        return "mrcs"

    def schema(self) -> StructType:
        return StructType([StructField("img_id", LongType()), StructField("px", ArrayType(FloatType()))])

    def reader(self, schema: StructType) -> DataSourceReader:
        return StackReader(self.options["path"], int(self.options.get("box", 0)), int(self.options.get("per_task", 512)), int(self.options.get("first", 0)), int(self.options.get("last", 1 << 62)))


class StackReader(DataSourceReader):
    def __init__(self, path: str, box: int, per_task: int, first: int, last: int):
        self.path, self.per_task = path, per_task
        if box:
            self.head = MrcHeader(box, box, file_size(path) // (4 * box * box), 2, 0)
        else:
            self.head = mrc_header(path)
        self.low, self.high = max(0, first), min(self.head.nz, last)

    def partitions(self) -> Sequence[InputPartition]:
        return [ImageRange(a, min(a + self.per_task, self.high)) for a in range(self.low, self.high, self.per_task)] or [ImageRange(0, 0)]

    def read(self, partition: ImageRange) -> Iterator[pa.RecordBatch]:
        h, size = self.head, self.head.nx * self.head.ny
        n = partition.stop - partition.start
        if n <= 0:
            return
        fs, inner = locate(self.path)
        with fs.open_input_file(inner) as f:
            f.seek(h.data + partition.start * size * h.dtype.itemsize)
            px = np.frombuffer(f.read(n * size * h.dtype.itemsize), h.dtype).astype(np.float32)
        rows = pa.ListArray.from_arrays(np.arange(0, n * size + 1, size, dtype=np.int32), pa.array(px))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(partition.start, partition.stop)), rows], names=["img_id", "px"])


class VolumeSource(DataSource):
    """format("mrc").load(path): one row with nx, ny, nz and vox (z slowest)."""

    @classmethod
    def name(cls) -> str:
        return "mrc"

    def schema(self) -> StructType:
        return StructType([*(StructField(c, IntegerType()) for c in ("nx", "ny", "nz")), StructField("vox", ArrayType(FloatType()))])

    def reader(self, schema: StructType) -> DataSourceReader:
        return VolumeReader(self.options["path"])


class VolumeReader(DataSourceReader):
    def __init__(self, path: str):
        self.path = path

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        h = mrc_header(self.path)
        fs, inner = locate(self.path)
        with fs.open_input_file(inner) as f:
            f.seek(h.data)
            vox = np.frombuffer(f.read(h.nx * h.ny * h.nz * h.dtype.itemsize), h.dtype).astype(np.float32)
        yield h.nx, h.ny, h.nz, vox.tolist()


def register(spark: SparkSession) -> None:
    for source in (StarSource, SpiderSource, StackSource, VolumeSource):
        spark.dataSource.register(source)
