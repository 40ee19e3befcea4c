"""Alignment tables in canonical form, and writers of the exchange formats."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sphaera.functions.geometry import euler_to_quaternion
from sphaera.operators.graphs import numbered
from sphaera.sources.files import StackReader, files_of, lines_between, locate, mrc_bytes, register, star_blocks

NEEDED = ("rlnDefocusU", "rlnDefocusV", "rlnAngleRot", "rlnAngleTilt", "rlnAnglePsi")
OPTICS = ("rlnVoltage", "rlnSphericalAberration", "rlnAmplitudeContrast")


def read_alignment(spark: SparkSession, path: str, flip: bool = True) -> DataFrame:
    """img_id, q0..q3, df, shift_x, shift_y and the optics of a STAR file of either layout.

    path: a file or a folder of them; the optics of the first row are those of all.  They are fetched when the plan is
    made: one small job.  Missing angles or defocus are an error, missing shifts are 0 (newer files name them in Angstrom), and the optics come
    from the table of that name or from the first row.
    """
    register(spark)
    names = {b.name for b in star_blocks(files_of(path)[0])}
    rows = spark.read.format("star").load(path)
    lost = [c for c in NEEDED if c not in rows.columns]
    if lost:
        raise ValueError(f"{path}: missing columns {', '.join(lost)}")
    first = (spark.read.format("star").option("block", "optics").load(path) if "optics" in names else rows).limit(1).first()
    optics = first.asDict() if first else {}
    if first and any(c not in optics for c in OPTICS):
        raise ValueError(f"{path}: missing optics")
    shift = lambda a: F.col(f"rlnOrigin{a}") if f"rlnOrigin{a}" in rows.columns else F.col(f"rlnOrigin{a}Angst") if f"rlnOrigin{a}Angst" in rows.columns else F.lit(0.0)
    q = euler_to_quaternion(*(F.radians(F.col(c)) for c in NEEDED[2:]), flip)
    out = rows.select(*(c.alias(f"q{k}") for k, c in enumerate(q)), ((F.col(NEEDED[0]) + F.col(NEEDED[1])) / 2).alias("df"), shift("X").alias("shift_x"), shift("Y").alias("shift_y"))
    return numbered(out, "img_id").withColumns({c[3:].lower(): F.lit(float(optics[c])) for c in OPTICS if c in optics})


def read_spider_alignment(spark: SparkSession, path: str, phi: int, theta: int, psi: int, df: list[int], flip: bool = True) -> DataFrame:
    """The same from a SPIDER document; arguments are column places from 1.  Shifts of such files are not used."""
    register(spark)
    c = lambda k: F.element_at("cols", k)
    rows = spark.read.format("spider").load(path)
    q = euler_to_quaternion(F.radians(c(phi)), F.radians(c(theta)), F.radians(c(psi)), flip)
    focus = sum((c(k) for k in df[1:]), c(df[0])) / len(df)
    return numbered(rows.select(*(x.alias(f"q{k}") for k, x in enumerate(q)), focus.alias("df"), F.lit(0.0).alias("shift_x"), F.lit(0.0).alias("shift_y")), "img_id")


STAR_COLUMNS = ("MagnificationPixel", "AngleRot", "AngleTilt", "AnglePsi", "Voltage", "ImageName")


def star_lines(rows: DataFrame, stack: Column) -> DataFrame:
    """One STAR line per row: magnification, angles in degrees, voltage and the image as number@stack."""
    image = F.format_string("%d@%s", F.col("number"), stack)
    return rows.select(F.format_string("%.1f %.6f %.6f %.6f %.1f %s", F.lit(10000.0), F.col("phi"), F.col("theta"), F.col("psi"), F.col("voltage"), image).alias("value"))


def star_header(columns: tuple[str, ...] = STAR_COLUMNS) -> str:
    return "\n".join(["", "data_", "", "loop_", *(f"_rln{c} #{k}" for k, c in enumerate(columns, 1))]) + "\n"


def export_bins(rows: DataFrame, folder: str, per_file: int = 4096) -> DataFrame:
    """Write image stacks and STAR files per bin; returns file, bin, n of every stack.

    rows: bin, img_id, px, phi, theta, psi, voltage.  Contrast is inverted.  Rows are dealt by range of (bin, img_id), a
    task writes stacks of at most per_file images, so no bin has to fit into one task.  Files get a name of their own per
    attempt and are listed only in the result.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = locate(folder)
        fs.create_dir(root, recursive=True)
        held: list[tuple] = []

        def close() -> Iterator[pa.RecordBatch]:
            b = held[0][0]
            side = int(round(len(held[0][1]) ** 0.5))
            name = f"bin_{b:03d}_{uuid.uuid4().hex[:12]}"
            with fs.open_output_stream(f"{root}/{name}.mrcs") as f:
                f.write(mrc_bytes(-np.array([h[1] for h in held], np.float32).reshape(-1, side, side)))
            lines = [f"{10000.0:.1f} {p:.6f} {t:.6f} {s:.6f} {v:.1f} {k}@{name}.mrcs" for k, (_, _, p, t, s, v) in enumerate(held, 1)]
            with fs.open_output_stream(f"{root}/{name}.star") as f:
                f.write((star_header() + "\n".join(lines) + "\n").encode())
            yield pa.RecordBatch.from_pylist([{"file": f"{name}.mrcs", "bin": b, "n": len(held)}], pa.schema([("file", pa.string()), ("bin", pa.int32()), ("n", pa.int64())]))
            held.clear()

        for batch in batches:
            for row in zip(*(batch.column(k).to_pylist() for k in range(6)), strict=True):
                if held and (row[0] != held[0][0] or len(held) >= per_file):
                    yield from close()
                held.append(row)
        if held:
            yield from close()

    slim = rows.select(F.col("bin").cast("int").alias("bin"), "px", "phi", "theta", "psi", "voltage", "img_id")
    n = max(1, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return slim.repartitionByRange(n, "bin", "img_id").sortWithinPartitions("bin", "img_id").drop("img_id").mapInArrow(run, "file string, bin int, n long")


def write_star(rows: DataFrame, folder: str, order: str) -> DataFrame:
    """STAR files of all columns of rows (numbers and texts without spaces), sorted by `order`, one per range partition;
    returns file and n.  Names ascend with the order, so reading the folder keeps it."""
    names = rows.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = locate(folder)
        fs.create_dir(root, recursive=True)
        name, n = f"part-{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex[:12]}.star", 0
        with fs.open_output_stream(f"{root}/.{name}") as f:
            f.write(star_header(tuple(names)).encode())
            for b in batches:
                f.write("".join(" ".join(map(str, r)) + "\n" for r in zip(*(c.to_pylist() for c in b.columns), strict=True)).encode())
                n += b.num_rows
        if n:
            fs.move(f"{root}/.{name}", f"{root}/{name}")
            yield pa.RecordBatch.from_pylist([{"file": name, "n": n}], pa.schema([("file", pa.string()), ("n", pa.int64())]))
        else:
            fs.delete_file(f"{root}/.{name}")

    return rows.orderBy(order).mapInArrow(run, "file string, n long")


def read_exported(written: DataFrame, folder: str) -> DataFrame:
    """bin, number, phi, theta, psi and px of the images that export_bins() wrote, from its files, a task per stack."""
    schema = pa.schema([("bin", pa.int32()), ("number", pa.int64()), *((c, pa.float64()) for c in ("phi", "theta", "psi")), ("px", pa.list_(pa.float32()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, which in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                stack = f"{folder}/{name}"
                star = stack.removesuffix(".mrcs") + ".star"
                block = star_blocks(star)[0]
                lines = [x.split() for x in lines_between(star, block.body, 1 << 62, block.body) if x.strip()]
                place = {c[3:]: k for k, c in enumerate(block.columns)}
                reader = StackReader(stack, 0, 1 << 30, 0, 1 << 62)
                px = [r for part in reader.partitions() for got in reader.read(part) for r in got.column(1).to_pylist()]
                number = [int(x[place["ImageName"]].split("@")[0]) for x in lines]
                angles = [[float(x[place[c]]) for x in lines] for c in ("AngleRot", "AngleTilt", "AnglePsi")]
                yield pa.RecordBatch.from_arrays([pa.array([which] * len(lines), pa.int32()), pa.array(number, pa.int64()), *(pa.array(a, pa.float64()) for a in angles), pa.array([px[k - 1] for k in number], pa.list_(pa.float32()))], schema=schema)

    return written.select("file", "bin").mapInArrow(run, "bin int, number long, phi double, theta double, psi double, px array<float>")


def spider_lines(rows: DataFrame) -> DataFrame:
    """key, 1, value per line."""
    return rows.select(F.format_string("%5d %2d %5d", F.col("key"), F.lit(1), F.col("value")).alias("value"))


def spider_angle_lines(rows: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    """key, the number of values and the values (in full) per line."""
    return rows.select(F.concat_ws(" ", F.col("key"), F.lit(len(columns)), *(F.col(c) for c in columns)).alias("value"))


def spectrum_lines(rows: DataFrame) -> DataFrame:
    """ordinal and eigenvalue per line, without the first."""
    return rows.select(F.posexplode("values").alias("pos", "v")).where("pos > 0").select(F.format_string("%d\t%.5f", F.col("pos"), F.col("v")).alias("value"))
