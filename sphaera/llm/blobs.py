"""Integer arrays as small byte strings, and files and rows made of them."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard

from sphaera.llm.common import open_uri


def squeeze(*arrays: np.ndarray) -> bytes:
    """Arrays in one byte string: each in the smallest type that holds it, its byte planes one after another, compressed.

    Integers must not be negative.  Floats keep their type.
    """
    z = zstandard.ZstdCompressor(level=1)
    out = [len(arrays).to_bytes(2, "little")]
    for a in arrays:
        if a.dtype.kind != "f":
            top = int(a.max()) if len(a) else 0
            a = a.astype(next(t for t in ("<u1", "<u2", "<u4", "<u8") if top < 1 << (8 * int(t[2]))))
        a = np.ascontiguousarray(a)
        body = z.compress(np.ascontiguousarray(a.view(np.uint8).reshape(len(a), a.itemsize).T).tobytes())
        out += [a.dtype.str[1:].encode(), len(a).to_bytes(6, "little"), len(body).to_bytes(6, "little"), body]
    return b"".join(out)


def unsqueeze(raw: bytes) -> list[np.ndarray]:
    z = zstandard.ZstdDecompressor()
    at, out = 2, []
    for _ in range(int.from_bytes(raw[:2], "little")):
        kind, n, size = "<" + raw[at : at + 2].decode(), int.from_bytes(raw[at + 2 : at + 8], "little"), int.from_bytes(raw[at + 8 : at + 14], "little")
        planes = np.frombuffer(z.decompress(raw[at + 14 : at + 14 + size]), np.uint8).reshape(int(kind[2]), n)
        a = np.ascontiguousarray(planes.T).reshape(-1).view(kind)
        out.append(a if a.dtype.kind == "f" else a.astype(np.uint64 if kind[2] == "8" else np.int64))
        at += 14 + size
    return out


def steps(x: np.ndarray) -> np.ndarray:
    """First value and differences of an ascending array."""
    return np.diff(x, prepend=x.dtype.type(0))


def save(folder: str, name: str, *parts: bytes) -> str:
    """A file of byte strings under a name of its own, complete or not there at all.  Returns its place."""
    fs, root = open_uri(folder)
    fs.create_dir(root, recursive=True)
    place = f"{name}-{uuid.uuid4().hex}"
    with fs.open_output_stream(f"{root}/{place}.open") as f:
        f.write(np.array([len(parts), *map(len, parts)], "<u8").tobytes())
        for p in parts:
            f.write(p)
    fs.move(f"{root}/{place}.open", f"{root}/{place}")
    return f"{folder}/{place}"


def load(place: str, *wanted: int) -> list[bytes]:
    """The byte strings of these numbers."""
    fs, inner = open_uri(place)
    with fs.open_input_file(inner) as f:
        n = int(np.frombuffer(f.read(8), "<u8")[0])
        ends = np.cumsum(np.frombuffer(f.read(8 * n), "<u8")).astype(np.int64) + 8 + 8 * n
        out = []
        for k in wanted:
            start = int(ends[k - 1]) if k else 8 + 8 * n
            f.seek(start)
            out.append(f.read(int(ends[k]) - start))
        return out


def groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[object, list[tuple]]]:
    """(value, the other columns of its rows) for each run of equal values in the first column of sorted batches."""
    held: list[tuple] = []
    key = None
    for b in batches:
        for k, *rest in zip(*(c.to_pylist() for c in b.columns), strict=True):
            if held and k != key:
                yield key, held
                held = []
            key = k
            held.append(tuple(rest))
    if held:
        yield key, held


def table(schema: pa.Schema, rows: list[tuple]) -> pa.RecordBatch:
    cols = list(zip(*rows, strict=True)) or [()] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, schema, strict=True)], schema=schema)
