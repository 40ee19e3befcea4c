"""Stage tables: one parquet table per stage, partitioned by key, written version by version."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sphaera.sources.files import file_size, locate


def write_stage(df: DataFrame, root: str, stage: str, version: int = 0, key: str = "prd") -> str:
    """Write one version of a stage; only the partitions in df are replaced."""
    path = f"{root}/{stage}/v={version}"
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(key).parquet(path)
    return path


def read_stage(spark: SparkSession, root: str, stage: str, version: int = 0, lenient: bool = False) -> DataFrame:
    """A version of a stage.  An unreadable file is an error, or, if lenient, counts as missing: pending() then names its
    keys again."""
    return spark.read.option("ignoreCorruptFiles", str(lenient).lower()).parquet(f"{root}/{stage}/v={version}")


def pending(tasks: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """Tasks whose key has no output yet: what a resumed run has to do."""
    return tasks.join(done.select(*keys).distinct(), keys, "left_anti")


def read_columns(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Tab-separated columns without a header."""
    return spark.read.csv(path, sep="\t", schema=schema)


def write_columns(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").csv(path, sep="\t")


def read_vector(spark: SparkSession, path: str, kind: str = "float32", per_task: int = 1 << 20) -> DataFrame:
    """pos, value (double) of a headerless file of little-endian numbers, read in ranges of per_task numbers."""
    width = np.dtype(kind).newbyteorder("<")
    n = file_size(path) // width.itemsize

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, inner = locate(path)
        with fs.open_input_file(inner) as f:
            for b in batches:
                for k in b.column(0).to_pylist():
                    start, stop = k * per_task, min(n, (k + 1) * per_task)
                    f.seek(start * width.itemsize)
                    values = np.frombuffer(f.read((stop - start) * width.itemsize), width)
                    yield pa.RecordBatch.from_arrays([pa.array(np.arange(start, stop)), pa.array(values.astype(float))], names=["pos", "value"])

    tasks = -(-n // per_task)
    return spark.range(0, tasks, 1, max(1, tasks)).mapInArrow(run, "pos long, value double")


def write_vector(df: DataFrame, folder: str, kind: str = "float32") -> DataFrame:
    """Raw numbers of df (pos, value) in ascending pos, a file per partition; returns file, first, n in order of first."""
    width = np.dtype(kind).newbyteorder("<")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = locate(folder)
        fs.create_dir(root, recursive=True)
        name, first, n = f"part-{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex[:12]}.raw", None, 0
        with fs.open_output_stream(f"{root}/{name}") as f:
            for b in batches:
                if b.num_rows and first is None:
                    first = b.column(0)[0].as_py()
                f.write(b.column(1).to_numpy().astype(width).tobytes())
                n += b.num_rows
        if n:
            yield pa.RecordBatch.from_pylist([{"file": name, "first": first, "n": n}], pa.schema([("file", pa.string()), ("first", pa.int64()), ("n", pa.int64())]))

    return df.select(F.col("pos").cast("long").alias("pos"), F.col("value").cast("double").alias("value")).orderBy("pos").mapInArrow(run, "file string, first long, n long")
