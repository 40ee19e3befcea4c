"""Concatenate and cut: documents laid end to end as token ids and cut into sequences of a fixed length.

A first pass encodes every text and writes the ids, with the number of ids before each document in its partition.  The
partitions' totals (a row per partition) are summed up in order, which gives every document its place among all ids.  A
second pass cuts at multiples of the length: a piece is the part of a document in one sequence, and the record of where the
document's boundary lies there.  All sequences are full but the last, so at most one is padded.

Documents stay in the order and the partitions they are read in: no text and no id is shuffled to pack them.  A partition's
order is fixed once by the table that the first pass writes; tasks run again read it again.  Ids take two bytes where the
vocabulary allows.

Null texts are empty: such a document is its end id alone.  Repeated rows and null ids are documents of their own.  An
empty table gives no pieces.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sphaera.llm.common import doc_texts, materialise
from sphaera.llm.pfor import _encoder, _runs

LENGTH = 1024
#: Ids of so many documents, or of so many bytes, go into one batch.
BATCH_ROWS, BATCH_BYTES = 2_000, 1 << 23


def write_ids(docs: DataFrame, tokenizer_path: str, pattern: str, end_id: int, plain_text: bool = False) -> DataFrame:
    """part, doc_id, before (ids of the partition ahead of the document), n and ids (little-endian, with the end id)."""
    schema = pa.schema([("doc_id", pa.int64()), ("before", pa.int64()), ("n", pa.int64()), ("ids", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, before = _encoder(tokenizer_path, pattern, plain_text), 0
        kind = id_type(tokenizer_path)
        end = np.array([end_id], kind)
        for b in batches:
            doc_ids, done = b.column(0).to_pylist(), 0
            held, size = [], 0
            for texts in _runs(b.column(1).to_pylist()):
                for ids in encoder.encode_run(texts):
                    held.append((doc_ids[done], before, len(ids) + 1, ids.astype(kind).tobytes() + end.tobytes()))
                    done += 1
                    before += len(ids) + 1
                    size += len(held[-1][3])
                    if len(held) >= BATCH_ROWS or size >= BATCH_BYTES:
                        yield _batch(held, schema)
                        held, size = [], 0
            if held:
                yield _batch(held, schema)

    rows = doc_texts(docs).mapInArrow(run, "doc_id long, before long, n long, ids binary")
    return materialise(rows.withColumn("part", F.spark_partition_id()), "packed-ids")


def id_type(tokenizer_path: str) -> str:
    return "<u2" if _vocabulary(tokenizer_path) <= 1 << 16 else "<u4"


def _vocabulary(tokenizer_path: str) -> int:
    from tokenizers import Tokenizer

    if tokenizer_path not in _SIZES:
        _SIZES[tokenizer_path] = Tokenizer.from_file(tokenizer_path).get_vocab_size(with_added_tokens=True)
    return _SIZES[tokenizer_path]


_SIZES: dict[str, int] = {}


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


def placed(written: DataFrame) -> DataFrame:
    """written with `at`, a document's place among all ids: the totals of the partitions before, and those before in its own."""
    totals = written.groupBy("part").agg(F.sum("n").alias("n")).orderBy("part").collect()  # a row per partition
    at, starts = 0, []
    for r in totals:
        starts.append((r["part"], at))
        at += r["n"]
    bases = written.sparkSession.createDataFrame(starts, "part int, base long")
    return written.join(F.broadcast(bases), "part").select("doc_id", (F.col("base") + F.col("before")).alias("at"), "n", "ids")  # a row per partition


def cut(start: int, n: int, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Start (within its own document) and length of each piece of n ids that lie at `start` among all ids."""
    first = length - start % length
    begins = np.concatenate([[0], np.arange(first, n, length)]) if n else np.zeros(0, np.int64)
    return begins, np.diff(np.append(begins, n))


PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def pieces(written: DataFrame, kind: str, length: int = LENGTH, with_ids: bool = False) -> DataFrame:
    """The boundary records: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, and with_ids the ids."""
    fields = [tuple(x.split()) for x in PIECES.split(", ")]
    schema = pa.schema([*((c, pa.int64()) for c, _ in fields), *([("ids", pa.binary())] if with_ids else [])])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cols: list[list] = [[] for _ in schema]
            for doc_id, at, n, raw in zip(*(c.to_pylist() for c in b.columns), strict=True):
                ids = np.frombuffer(raw, kind).astype("<u4").tobytes()
                for begin, size in zip(*(x.tolist() for x in cut(at, n, length)), strict=True):
                    part = ids[4 * begin : 4 * (begin + size)]
                    row = (doc_id, begin, size, zlib.crc32(part), n, (at + begin) // length, (at + begin) % length)
                    for c, v in zip(cols, (*row, part) if with_ids else row, strict=True):
                        c.append(v)
                if len(cols[0]) >= 20_000:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, schema, strict=True)], schema=schema)
                    cols = [[] for _ in schema]
            if cols[0]:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, schema, strict=True)], schema=schema)

    return placed(written).mapInArrow(run, PIECES + (", ids binary" if with_ids else ""))


def sequences(docs: DataFrame, tokenizer_path: str, pattern: str, end_id: int, pad_id: int, length: int = LENGTH) -> DataFrame:
    """sequence_id, ids (array of exactly `length`), used, doc_ids and starts (the boundaries, in order of their offsets).

    A group is one sequence, so its size is fixed.  The last sequence is padded to the length, or cut to a used length that is
    a power of two.
    """
    found = pieces(write_ids(docs, tokenizer_path, pattern, end_id), id_type(tokenizer_path), length, True)
    held = found.groupBy("sequence_id").agg(F.array_sort(F.collect_list(F.struct("offset", "doc_id", "ids"))).alias("p"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, used, doc_ids, starts = [], [], [], []
            for parts in b.column(1).to_pylist():
                x = np.frombuffer(b"".join(p["ids"] for p in parts), "<u4").astype(np.int64)
                size = len(x) if len(x) & (len(x) - 1) == 0 else length
                used.append(len(x))
                ids.append(np.append(x, np.full(size - len(x), pad_id, np.int64)))
                doc_ids.append([p["doc_id"] for p in parts])
                starts.append([p["offset"] for p in parts])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(ids, pa.list_(pa.int64())), pa.array(used, pa.int64()), pa.array(doc_ids, pa.list_(pa.int64())), pa.array(starts, pa.list_(pa.int64()))], names=["sequence_id", "ids", "used", "doc_ids", "starts"])

    return held.mapInArrow(run, "sequence_id long, ids array<long>, used long, doc_ids array<long>, starts array<long>")


def pack(docs: DataFrame, tokenizer_path: str, pattern: str, end_id: int, length: int = LENGTH) -> DataFrame:
    """The boundary records of all documents packed into sequences of `length` ids."""
    return pieces(write_ids(docs, tokenizer_path, pattern, end_id), id_type(tokenizer_path), length)
