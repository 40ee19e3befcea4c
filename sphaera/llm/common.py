"""Helpers shared by the text operators: table access, checkpoints, bounded collection."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterable, Sequence

import pyarrow.fs as pafs
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The separators of every word definition here: space, tab, line feed, vertical tab, form feed, carriage return.
SEPARATORS = b" \t\n\x0b\x0c\r"


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def doc_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id long, text string): null texts become empty, other columns are pruned away."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))


def remainder(id_col: str | Column, modulus: int) -> Column:
    """crc32 of the decimal id, modulo modulus."""
    c = F.col(id_col) if isinstance(id_col, str) else id_col
    return F.crc32(F.coalesce(c.cast("string"), F.lit("")).cast("binary")) % F.lit(modulus)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or one of our own where it is unset (tests)."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not (spark.sparkContext.master == "local" or spark.sparkContext.master.startswith("local[")):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        at = os.path.join(tempfile.gettempdir(), "sphaera-shared")
        os.makedirs(at, exist_ok=True)
    if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        spark.sparkContext.setCheckpointDir(at)
    return at


def materialise(df: DataFrame, name: str, partition_by: Sequence[str] = ()) -> DataFrame:
    """Write df to the shared folder and read it back: lineage is cut and a lost executor costs nothing."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    w = df.write.mode("overwrite")
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    _WRITTEN.append(path)
    return out


def bucketed(df: DataFrame, name: str, key: str, buckets: int) -> DataFrame:
    """As materialise(), as a table in buckets of a key: a join on that key moves only the other side."""
    table = f"{name}_{uuid.uuid4().hex}"
    path = new_folder(df.sparkSession, name)
    df.write.bucketBy(buckets, key).option("path", path).mode("overwrite").saveAsTable(table)
    _TABLES[path] = table
    return df.sparkSession.table(table)


def new_folder(spark: SparkSession, name: str) -> str:
    """A folder of its own in the shared one, for files that tasks write themselves; drop_written() removes it too."""
    path = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    _WRITTEN.append(path)
    return path


def open_uri(uri: str) -> tuple[pafs.FileSystem, str]:
    """File system and path of a place in the shared folder."""
    return pafs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")


_WRITTEN: list[str] = []
_TABLES: dict[str, str] = {}


def written() -> list[str]:
    """What materialise() and new_folder() have made so far in this process."""
    return list(_WRITTEN)


def drop_written(spark: SparkSession, keep: Iterable[str] = ()) -> None:
    """Remove what materialise() and new_folder() made in this process, save the paths in keep."""
    hold = set(keep)
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    for path in [p for p in _WRITTEN if p not in hold]:
        if path in _TABLES:
            spark.sql(f"DROP TABLE IF EXISTS {_TABLES.pop(path)}")
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(conf).delete(p, True)
        _WRITTEN.remove(path)


def drop_table(df: DataFrame) -> None:
    """Remove a table of materialise() that nothing reads any more."""
    drop_written(df.sparkSession, [p for p in _WRITTEN if p not in written_path(df)])


def written_path(df: DataFrame) -> list[str]:
    files = df.inputFiles()
    return [p for p in _WRITTEN if any(p.rsplit("/", 1)[-1] in f for f in files)]


def spread(docs: DataFrame, per_core: int = 4) -> int:
    """Partitions for an explicit repartition of docs, a table as read: the session's shuffle setting, a few for every
    core, or as many as the table's own splits, whichever is most."""
    spark = docs.sparkSession
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), per_core * spark.sparkContext.defaultParallelism, docs.rdd.getNumPartitions())


KEEP = StorageLevel.MEMORY_AND_DISK
