"""Queries over distances, kernels and embeddings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sphaera.operators import distances as dist
from sphaera.operators import graphs as gr
from sphaera.operators import sequences as seq
from sphaera.operators import tiles
from sphaera.plans.base import SNAP, r6, snapshots

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(oracle: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLE_SQL[f.__name__] = oracle
        return f

    return keep


D2 = "list_sum(list_transform(range(1, 65), lambda k: ({a}[k]-{b}[k])*({a}[k]-{b}[k])))"
PAIRS = SNAP + f", pairs AS (SELECT a.prd, a.img_id AS i, b.img_id AS j, {D2.format(a='a.px', b='b.px')} AS d2 FROM snap a JOIN snap b ON a.prd = b.prd AND a.img_id < b.img_id)"
FULL = PAIRS + ", mat AS (SELECT prd, i, j, d2 FROM pairs UNION ALL SELECT prd, j, i, d2 FROM pairs UNION ALL SELECT DISTINCT prd, img_id, img_id, 0.0::DOUBLE FROM snap)"
KNN = FULL + ", knn AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY prd, i ORDER BY (i <> j)::INT, d2, j) AS rank FROM mat) WHERE rank <= 6)"


def _pairs(rows: DataFrame) -> DataFrame:
    """prd, i, j, rounded d2 for all pairs i < j of whole groups, from tiles; pairs of a row without an image have no distance."""
    return tiles.long_distances(tiles.distance_rows(tiles.tiles(tiles.blocks(rows, None, missing=True)), digits=6))


def _alone(rows: DataFrame) -> DataFrame:
    """img_id of the rows without a group: each is its own only neighbour."""
    return rows.where("prd IS NULL").select("prd", "img_id")


def _matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """prd, i, j, rounded d2: both triangles and the diagonal of whole groups."""
    rows = snapshots(spark, sf_dir)
    found = tiles.matrix_rows(tiles.tiles(tiles.blocks(rows, None, missing=True)), 6)
    return found.unionByName(_alone(rows).select("prd", F.col("img_id").alias("i"), F.col("img_id").alias("j"), F.lit(0.0).alias("d2")))


def _nearest(spark: SparkSession, sf_dir: str, k: int = 6) -> DataFrame:
    """The k nearest of every snapshot in its whole group, from tiles."""
    return tiles.nearest(tiles.tiles(tiles.blocks(snapshots(spark, sf_dir), None)), k)


@query(f"WITH {PAIRS} SELECT prd, i, j, round(d2, 6) + 0.0 AS d2 FROM pairs")
def pair_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pairs(snapshots(spark, sf_dir))


@query(f"WITH {KNN} SELECT prd, i, j, rank::INT AS rank, round(d2, 6) + 0.0 AS d2 FROM knn")
def knn_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _nearest(spark, sf_dir).select("prd", "i", "j", "rank", r6(F.col("d2")).alias("d2"))


@query(f"WITH {KNN} SELECT prd, i, j, round(max(d2), 6) + 0.0 AS d2 FROM (SELECT prd, i, j, d2 FROM knn UNION ALL SELECT prd, j, i, d2 FROM knn) GROUP BY prd, i, j")
def knn_symmetric(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dist.symmetrise(_nearest(spark, sf_dir)).withColumn("d2", r6(F.col("d2")))


LAP = FULL + """, w AS (SELECT prd, i, j, exp(-d2/(1.5*1.5)) AS w FROM mat), dg AS (SELECT prd, i, sum(w) AS d FROM w GROUP BY prd, i),
w2 AS (SELECT w.prd, w.i, w.j, w.w/(a.d*b.d) AS w FROM w JOIN dg a ON a.prd=w.prd AND a.i=w.i JOIN dg b ON b.prd=w.prd AND b.i=w.j), dg2 AS (SELECT prd, i, sqrt(sum(w)) AS d FROM w2 GROUP BY prd, i),
lap AS (SELECT w2.prd, w2.i, w2.j, w2.w/(a.d*b.d) AS w FROM w2 JOIN dg2 a ON a.prd=w2.prd AND a.i=w2.i JOIN dg2 b ON b.prd=w2.prd AND b.i=w2.j)"""


@query(f"WITH {LAP} SELECT prd, i, j, round(w, 6) + 0.0 AS w FROM lap")
def diffusion_laplacian(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tiles.laplacian_rows(tiles.blocks(snapshots(spark, sf_dir), None, missing=True), 1.5, 6)


@query(f"WITH {FULL} SELECT prd, i, round(sum(exp(-d2/(1.5*1.5))), 6) AS degree FROM mat GROUP BY prd, i")
def kernel_degree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sums of whole rows of the kernel, added up tile by tile; a row without images to compare with is its own neighbour."""
    rows = snapshots(spark, sf_dir)
    d = tiles.degrees(tiles.tiles(tiles.blocks(rows.where("prd IS NOT NULL"), None)), 1.5)
    alone = rows.where("px IS NULL OR prd IS NULL").select("prd", F.col("img_id").alias("i"), F.lit(1.0).alias("degree"))
    return d.unionByName(alone).withColumn("degree", F.round("degree", 6))


@query(f"WITH {FULL}, g AS (SELECT k*1.0::DOUBLE AS log_eps FROM range(-5, 6) t(k)) SELECT prd, log_eps, round(ln(sum(exp(-d2/(2*exp(log_eps))))), 6) + 0.0 AS log_sum FROM mat, g GROUP BY prd, log_eps")
def kernel_bandwidth_sums(spark: SparkSession, sf_dir: str) -> DataFrame:
    grid = [float(k) for k in range(-5, 6)]
    rows = snapshots(spark, sf_dir)
    sums = tiles.bandwidth_sums(tiles.tiles(tiles.blocks(rows, None, missing=True)), grid)
    alone = _alone(rows).groupBy("prd").agg(F.count(F.lit(1)).cast("double").alias("total")).select("prd", F.explode(F.array(*map(F.lit, grid))).alias("log_eps"), "total")
    return sums.unionByName(alone).select("prd", "log_eps", r6(F.log("total")).alias("log_sum"))


@query(f"WITH {FULL}, t AS (SELECT prd, greatest(-ln(0.01*avg(exp(-d2/2))), 10) AS thr FROM mat GROUP BY prd) SELECT prd, round(thr, 6) AS thr, count(*) FILTER (WHERE d2/2 < thr) AS kept, count(*) FILTER (WHERE d2 < 1e-6) AS zeros FROM mat JOIN t USING (prd) GROUP BY prd, thr")
def kernel_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two passes over the tiles: the mean of the kernel, then the counts below what follows from it."""
    held = tiles.blocks(snapshots(spark, sf_dir), None, missing=True)
    mean = tiles.mean_kernel(tiles.tiles(held), 1.0)
    t = mean.select("prd", F.greatest(-F.log(0.01 * F.col("total") / F.col("n")), F.lit(10.0)).alias("thr"), F.lit(1e-6).alias("zero")).checkpoint()
    counts = tiles.count_below(tiles.tiles(held.join(t, "prd")), ["thr", "zero"], [0.5, 1.0], ["kept", "zeros"])
    return counts.join(t, "prd").select("prd", F.round("thr", 6).alias("thr"), "kept", "zeros")


@query(f"WITH {SNAP}, sub AS (SELECT prd, img_id FROM snap WHERE sqrt(px[1]*px[1]+px[2]*px[2]+px[3]*px[3]) < 0.2) SELECT prd, count(*) AS kept FROM sub GROUP BY prd")
def prune_radius(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = [F.element_at("px", k) for k in (1, 2, 3)]
    return snapshots(spark, sf_dir).where(F.sqrt(p[0] * p[0] + p[1] * p[1] + p[2] * p[2]) < 0.2).groupBy("prd").agg(F.count(F.lit(1)).alias("kept"))


@query(f"WITH {PAIRS}, sub AS (SELECT img_id FROM snap WHERE img_id % 3 <> 0) SELECT prd, i, j, round(d2, 6) + 0.0 AS d2 FROM pairs WHERE i IN (FROM sub) AND j IN (FROM sub)")
def sub_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pairs(snapshots(spark, sf_dir).where("img_id % 3 <> 0"))


@query(f"WITH {SNAP}, m AS (SELECT prd AS j, list(v ORDER BY p) AS c FROM (SELECT prd, p, avg(v) AS v FROM (SELECT prd, unnest(px) AS v, generate_subscripts(px, 1) AS p FROM snap) GROUP BY ALL) GROUP BY prd) SELECT s.img_id AS i, j, round(sqrt({D2.format(a='s.px', b='m.c')}), 6) + 0.0 AS d FROM snap s, m")
def rect_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distances of every snapshot to the mean image of every group, in the shape of the two sets.

    The means are one row, an array with an entry per group, so snapshots are neither shuffled nor joined by anything.
    """
    s = snapshots(spark, sf_dir)
    pixel = s.select("prd", F.posexplode("px").alias("p", "v")).groupBy("prd", "p").agg(F.avg("v").alias("v"))
    mean = pixel.groupBy("prd").agg(F.transform(F.array_sort(F.collect_list(F.struct("p", "v"))), lambda x: x["v"]).alias("c"))
    packed = mean.agg(F.collect_list(F.struct("prd", "c")).alias("m"))
    d = F.sqrt(dist.squared_distance(F.col("px"), F.col("o.c")))
    rows = s.select("img_id", "px").crossJoin(packed).select("img_id", "px", F.explode("m").alias("o"))  # one row
    return rows.select(F.col("img_id").alias("i"), F.col("o.prd").alias("j"), r6(F.when(d < 1e-8, 0.0).otherwise(d)).alias("d"))


ORDER = FULL + ", ord AS (SELECT img_id, prd, row_number() OVER (PARTITION BY prd ORDER BY px[1], img_id) AS rn FROM snap), om AS (SELECT m.prd, a.rn AS i, b.rn AS j, m.d2 FROM mat m JOIN ord a ON a.img_id=m.i JOIN ord b ON b.img_id=m.j)"


def _ordered(spark: SparkSession, sf_dir: str, digits: int, window: int = 1) -> DataFrame:
    """prd, i, j, rounded d2: matrices in the order of the first pixel, by rank, or their sums over windows along the diagonals."""
    rows = snapshots(spark, sf_dir)
    held = tiles.blocks(rows, None, order=[F.element_at("px", 1), F.col("img_id")], halo=window - 1, missing=True)
    found = tiles.matrix_rows(tiles.tiles(held), digits, window=window)
    alone = gr.numbered(_alone(rows), "rn")
    n = alone.count()
    alone = alone.where(F.col("rn") <= n - window).select("prd", (F.col("rn") + 1).alias("i"), (F.col("rn") + 1).alias("j"), F.lit(0.0).alias("d2"))
    return found.unionByName(alone).select("prd", F.col("i").cast("int").alias("i"), F.col("j").cast("int").alias("j"), "d2")


@query(f"WITH {ORDER} SELECT prd, i::INT AS i, j::INT AS j, round(d2, 6) + 0.0 AS d2 FROM om")
def order_along_psi(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ordered(spark, sf_dir, 6)


@query(f"WITH {ORDER}, c AS (SELECT prd, i, j, sum(d2) OVER w AS con, count(*) OVER w AS len FROM om WINDOW w AS (PARTITION BY prd, j-i ORDER BY i ROWS BETWEEN CURRENT ROW AND 3 FOLLOWING)) SELECT prd, i::INT AS i, j::INT AS j, round(con, 5) + 0.0 AS d2 FROM c WHERE len = 4")
def delay_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ordered(spark, sf_dir, 5, window=4)


@query(f"WITH {SNAP}, p AS (SELECT prd, sum(px[1]) AS s1, sum(px[1]*px[1]) AS s2, sum(pow(px[1],3)) AS s3, sum(pow(px[1],4)) AS s4, sum(pow(px[1],5)) AS s5, sum(pow(px[1],6)) AS s6, sum(px[3]) AS z, sum(px[1]*px[3]) AS xz, sum(px[1]*px[1]*px[3]) AS x2z, sum(pow(px[1],3)*px[3]) AS x3z FROM snap GROUP BY prd) SELECT prd, " + ", ".join(f"round({c}, 6) + 0.0 AS {c}" for c in ("s1", "s2", "s3", "s4", "s5", "s6", "z", "xz", "x2z", "x3z")) + " FROM p")
def fit_moments(spark: SparkSession, sf_dir: str) -> DataFrame:
    x, z = F.element_at("px", 1), F.element_at("px", 3)
    sums = {f"s{k}": F.sum(F.pow(x, F.lit(k))) for k in range(1, 7)} | {"z": F.sum(z), "xz": F.sum(x * z), "x2z": F.sum(x * x * z), "x3z": F.sum(F.pow(x, F.lit(3)) * z)}
    return snapshots(spark, sf_dir).groupBy("prd").agg(*(r6(c).alias(n) for n, c in sums.items()))


@query(f"WITH {SNAP}, e AS (SELECT prd, img_id, unnest(px) AS v, generate_subscripts(px, 1) AS p FROM snap) SELECT prd, p::INT AS p, round(avg(v), 6) + 0.0 AS mean, round(avg(v*v), 6) + 0.0 AS intensity, round(sum(v), 6) + 0.0 AS total FROM e GROUP BY prd, p")
def mean_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = snapshots(spark, sf_dir).select("prd", F.posexplode("px").alias("p", "v"))
    return e.groupBy("prd", (F.col("p") + 1).alias("p")).agg(r6(F.avg("v")).alias("mean"), r6(F.avg(F.col("v") * F.col("v"))).alias("intensity"), r6(F.sum("v")).alias("total"))


@query(f"WITH {SNAP}, e AS (SELECT img_id, unnest(px) AS v, generate_subscripts(px, 1)-1 AS p FROM snap), o AS (SELECT *, (p//8-3.5)*(p//8-3.5)+(p%8-3.5)*(p%8-3.5) <= 9 AS inside FROM e), s AS (SELECT img_id, avg(CASE WHEN inside THEN 0 ELSE v END) AS m, stddev_pop(CASE WHEN inside THEN 0 ELSE v END) AS sd FROM o GROUP BY img_id) SELECT img_id, p::INT AS p, round((v-m)/sd, 6) + 0.0 AS v FROM e JOIN s USING (img_id)")
def background_normalise(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Images less the mean of their background, over its deviation; pixels inside the mask count as 0 there."""

    def outside(v, p):
        y, x = F.floor(p / 8) - 3.5, p % 8 - 3.5
        return F.when(y * y + x * x <= 9, 0.0).otherwise(v)

    s = snapshots(spark, sf_dir).select("img_id", "px", F.transform("px", outside).alias("bg"))
    total = lambda c, f: F.aggregate(c, F.lit(0.0), f)
    s = s.withColumn("m", total(F.col("bg"), lambda acc, v: acc + v) / 64)
    s = s.withColumn("sd", F.sqrt(total(F.transform("bg", lambda v: (v - F.col("m")) * (v - F.col("m"))), lambda acc, v: acc + v) / 64))
    e = s.select("img_id", "m", "sd", F.posexplode("px").alias("p", "v"))
    return e.select("img_id", "p", r6((F.col("v") - F.col("m")) / F.col("sd")).alias("v"))


@query(f"WITH {SNAP}, e AS (SELECT img_id, unnest(px) AS v, generate_subscripts(px, 1)-1 AS p FROM snap) SELECT img_id, ((7-p//8)*8+p%8)::INT AS flipped, ((p%8)*8+p//8)::INT AS transposed, round(v, 6) + 0.0 AS v FROM e")
def image_flip_transpose(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = snapshots(spark, sf_dir).select("img_id", F.posexplode("px").alias("p", "v"))
    y, x = F.floor(F.col("p") / 8), F.col("p") % 8
    return e.select("img_id", ((7 - y) * 8 + x).cast("int").alias("flipped"), (x * 8 + y).cast("int").alias("transposed"), r6(F.col("v")).alias("v"))


@query(f"WITH {SNAP}, c AS (SELECT prd, df, sin(df/1000)*0.5 AS c FROM snap) SELECT prd, round(sum(c*c)+1/5.0::DOUBLE, 6) AS denominator FROM c GROUP BY prd")
def wiener_denominator(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.sin(F.col("df") / 1000) * 0.5
    return snapshots(spark, sf_dir).groupBy("prd").agg(F.round(F.sum(c * c) + 1 / 5.0, 6).alias("denominator"))


@query(f"WITH {SNAP}, o AS (SELECT prd, img_id, sin(df/1000)*0.5 AS c, row_number() OVER (PARTITION BY prd ORDER BY px[1], img_id) AS rn FROM snap), w AS (SELECT prd, rn, sum(c*c) OVER v + 0.2::DOUBLE AS den, count(*) OVER v AS len FROM o WINDOW v AS (PARTITION BY prd ORDER BY rn ROWS BETWEEN CURRENT ROW AND 3 FOLLOWING)) SELECT prd, rn::INT AS rn, round(den, 6) AS den FROM w WHERE len = 4")
def sliding_wiener(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = seq.ranked(snapshots(spark, sf_dir), "prd", [F.element_at("px", 1), "img_id"])
    c = F.sin(F.col("df") / 1000) * 0.5
    w = Window.partitionBy("prd").orderBy("rn").rowsBetween(0, 3)
    return o.select("prd", "rn", (F.sum(c * c).over(w) + 0.2).alias("den"), F.count(F.lit(1)).over(w).alias("len")).where("len = 4").select("prd", "rn", F.round("den", 6).alias("den"))


@query(f"WITH {SNAP}, o AS (SELECT prd, px, row_number() OVER (PARTITION BY prd ORDER BY px[1], img_id) AS rn FROM snap), l AS (SELECT prd, rn, px, coalesce(lag(px) OVER (PARTITION BY prd ORDER BY rn), px) AS before FROM o) SELECT prd, rn::INT AS rn, round({D2.format(a='px', b='before')}, 6) + 0.0 AS step FROM l")
def frame_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frame to frame change; the first frame is paired with itself."""
    o = seq.ranked(snapshots(spark, sf_dir), "prd", [F.element_at("px", 1), "img_id"])
    before = F.coalesce(F.lag("px").over(Window.partitionBy("prd").orderBy("rn")), F.col("px"))
    return o.withColumn("before", before).select("prd", "rn", r6(dist.squared_distance(F.col("px"), F.col("before"))).alias("step"))


@query(f"WITH {SNAP}, o AS (SELECT prd, px, row_number() OVER (PARTITION BY prd ORDER BY px[1], img_id) - 1 AS rn FROM snap), e AS (SELECT prd, rn//5 AS block, unnest(px) AS v, generate_subscripts(px, 1) AS p FROM o) SELECT prd, block::INT AS block, p::INT AS p, round(avg(v), 6) + 0.0 AS v FROM e GROUP BY prd, block, p")
def block_mean_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = seq.ranked(snapshots(spark, sf_dir), "prd", [F.element_at("px", 1), "img_id"])
    e = o.select("prd", F.floor((F.col("rn") - 1) / 5).cast("int").alias("block"), F.posexplode("px").alias("p", "v"))
    return e.groupBy("prd", "block", (F.col("p") + 1).alias("p")).agg(r6(F.avg("v")).alias("v"))
