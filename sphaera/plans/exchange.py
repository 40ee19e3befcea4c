"""Queries through files: what sinks write to the shared folder, read back by the sources."""

from __future__ import annotations

import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sphaera.operators.graphs import checkpoint_dir
from sphaera.plans.base import SNAP, r6, snapshots, table
from sphaera.plans.orientation import ORACLE_SQL as ORIENTATION
from sphaera.sources import stages as stored
from sphaera.sources import tables
from sphaera.sources.files import locate, mrc_bytes, register

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(oracle: str):
    def keep(f):
        QUERIES[f.__name__] = f
        ORACLE_SQL[f.__name__] = oracle
        return f

    return keep


def new_folder(spark: SparkSession, name: str) -> str:
    """A folder of its own beside the checkpoints, which driver and executors share."""
    checkpoint_dir(spark)
    return f"{spark.sparkContext._jsc.sc().getCheckpointDir().get().rstrip('/')}/{name}-{uuid.uuid4().hex}"


def _degrees(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = snapshots(spark, sf_dir)
    return s.select("img_id", "prd", "px", (180.0 * F.element_at("px", 1)).alias("phi"), (90.0 * (1 + F.element_at("px", 2))).alias("theta"), (180.0 * F.element_at("px", 3)).alias("psi"), "df")


#: Rows are numbered from 0 in the order of the files.
_ALIGNED = ORIENTATION["geo_euler_quaternion"].replace("SELECT img_id,", "SELECT (row_number() OVER (ORDER BY img_id) - 1)::BIGINT AS img_id,").replace(" FROM yz", ", (SELECT df FROM snap WHERE snap.img_id = yz.img_id) + {0} AS df, {1} AS voltage FROM yz")


@query(_ALIGNED.format("50.0", "300.0::DOUBLE"))
def source_star(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Alignment through STAR files: quaternions, mean defocus and optics, rows numbered in file order."""
    folder = new_folder(spark, "star")
    d = _degrees(spark, sf_dir)
    optics = {"Voltage": 300.0, "SphericalAberration": 2.7, "AmplitudeContrast": 0.1}
    rows = d.select(F.col("df").alias("DefocusU"), (F.col("df") + 100).alias("DefocusV"), F.col("phi").alias("AngleRot"), F.col("theta").alias("AngleTilt"), F.col("psi").alias("AnglePsi"), *(F.lit(v).alias(k) for k, v in optics.items()), F.col("img_id").alias("ImageNumber"))
    tables.write_star(rows, folder, "ImageNumber").count()
    out = tables.read_alignment(spark, folder)
    return out.select("img_id", *(r6(F.col(f"q{k}")).alias(f"q{k}") for k in range(4)), "df", "voltage")


@query(_ALIGNED.format("50.0", "0.0::DOUBLE").replace(" AS voltage", " AS shift_x"))
def source_spider(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Alignment through SPIDER documents: the same quaternions, the mean of two defocus columns, no shifts."""
    folder = new_folder(spark, "spider")
    d = _degrees(spark, sf_dir).withColumns({"key": F.col("img_id") + 1, "du": F.col("df"), "dv": F.col("df") + 100})
    head = d.sparkSession.createDataFrame([(-1, " ; a comment line")], "k long, value string")
    lines = tables.spider_angle_lines(d.orderBy("img_id"), ("phi", "theta", "psi", "du", "dv"))
    lines.write.text(folder)
    head.select("value").coalesce(1).write.mode("append").text(folder)
    out = tables.read_spider_alignment(spark, folder, 2, 3, 4, [5, 6])
    keys = tables.numbered(spark.read.format("spider").load(folder), "n").select("n", F.element_at("cols", 1).alias("key"))
    out = out.join(keys, out["img_id"] == keys["n"])
    return out.select((F.col("key") - 1).cast("long").alias("img_id"), *(r6(F.col(f"q{k}")).alias(f"q{k}") for k in range(4)), "df", "shift_x")


@query(f"WITH {SNAP} SELECT prd AS bin, printf('%.6f', 180.0::DOUBLE*px[1])::DOUBLE + 0.0 AS phi, printf('%.6f', 90.0::DOUBLE*(1+px[2]))::DOUBLE + 0.0 AS theta, printf('%.6f', 180.0::DOUBLE*px[3])::DOUBLE + 0.0 AS psi, round(-list_sum(px), 4) + 0.0 AS total, round(-px[9], 5) + 0.0 AS ninth FROM snap")
def sink_export_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stacks and STAR files of every bin, contrast inverted, read back image by image."""
    folder = new_folder(spark, "bins")
    rows = _degrees(spark, sf_dir).select(F.col("prd").alias("bin"), "img_id", "px", "phi", "theta", "psi", F.lit(300.0).alias("voltage"))
    written = tables.export_bins(rows, folder, per_file=64).checkpoint()
    got = tables.read_exported(written, folder)
    total = F.aggregate(F.transform("px", lambda x: x.cast("double")), F.lit(0.0), lambda acc, x: acc + x)
    return got.select("bin", *((F.col(c) + 0.0).alias(c) for c in ("phi", "theta", "psi")), r6(total, 4).alias("total"), r6(F.element_at("px", 9).cast("double"), 5).alias("ninth"))


@query("SELECT (row_number() OVER (ORDER BY event_id) - 1)::BIGINT AS pos, round(value::FLOAT::DOUBLE, 4) + 0.0 AS value FROM events")
def sink_vector(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A headerless float32 vector, written over range partitions and read back in order."""
    folder = new_folder(spark, "vector")
    v = tables.numbered(table(spark, sf_dir, "events").select("event_id", "value").orderBy("event_id").checkpoint(), "pos")
    files = stored.write_vector(v, folder).checkpoint()
    out, names = None, [(r["file"], r["first"]) for r in files.orderBy("first").collect()]  # a row per file
    for name, first in names:
        part = stored.read_vector(spark, f"{folder}/{name}").select((F.col("pos") + first).alias("pos"), "value")
        out = part if out is None else out.unionByName(part)
    return out.select("pos", r6(F.col("value"), 4).alias("value"))


@query("SELECT label AS prd, count(*) AS n, min(vec_id) AS least FROM embeddings GROUP BY 1")
def sink_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tab-separated columns without a header."""
    folder = new_folder(spark, "columns")
    stored.write_columns(snapshots(spark, sf_dir).groupBy("prd").agg(F.count(F.lit(1)).alias("n"), F.min("img_id").alias("least")), folder)
    return stored.read_columns(spark, folder, "prd int, n long, least long")


@query(f"WITH {SNAP}, e AS (SELECT prd, unnest(px) AS v, generate_subscripts(px, 1)-1 AS p FROM snap), m AS (SELECT prd, p, avg(v) AS v FROM e GROUP BY 1, 2) SELECT 8 AS nx, 8 AS ny, (SELECT count(DISTINCT prd) FROM snap)::INT AS nz, ((SELECT count(DISTINCT prd) FROM snap s WHERE s.prd < m.prd)*64+p)::INT AS voxel, round(v, 4) + 0.0 AS v FROM m")
def source_volume(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A volume of the groups' mean images (a slice per bin, so it is small), written and read back voxel by voxel."""
    folder = new_folder(spark, "volume")
    e = snapshots(spark, sf_dir).select("prd", F.posexplode("px").alias("p", "v")).groupBy("prd", "p").agg(F.avg("v").alias("v"))
    rows = e.orderBy("prd", "p").select("v").toArrow().column(0).to_numpy()
    fs, root = locate(folder)
    fs.create_dir(root, recursive=True)
    with fs.open_output_stream(f"{root}/mean.mrc") as f:
        f.write(mrc_bytes(np.asarray(rows, np.float32).reshape(-1, 8, 8)))
    register(spark)
    v = spark.read.format("mrc").load(f"{folder}/mean.mrc")
    return v.select("nx", "ny", "nz", F.posexplode("vox").alias("voxel", "v")).withColumn("v", r6(F.col("v").cast("double"), 4))


@query("SELECT label AS prd, count(*) AS n FROM embeddings WHERE label % 3 = 1 OR vec_id % 2 = 0 GROUP BY 1")
def stage_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stage table whose partitions are replaced key by key: the later write wins for its keys only."""
    folder = new_folder(spark, "stage")
    s = snapshots(spark, sf_dir).select("prd", "img_id")
    stored.write_stage(s.where("img_id % 2 = 0"), folder, "counts")
    stored.write_stage(s.where("prd % 3 = 1"), folder, "counts")
    return stored.read_stage(spark, folder, "counts").groupBy(F.col("prd").cast("int").alias("prd")).agg(F.count(F.lit(1)).alias("n"))
