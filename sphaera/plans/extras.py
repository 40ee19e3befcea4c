"""Queries over gradients, masks, anchors, spectra and task keys."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sphaera.kernels import mixtures
from sphaera.operators import sequences as seq
from sphaera.operators.thresholds import group_quantiles
from sphaera.plans.base import CENTRES, SNAP, r6, snapshots, table
from sphaera.plans.landscape import TAU, tau_events
from sphaera.plans.manifold import FULL, _matrix
from sphaera.plans.orientation import _members
from sphaera.sources.stages import pending

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(oracle: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLE_SQL[f.__name__] = oracle
        return f

    return keep


GRAD = SNAP + """, e AS (SELECT img_id, unnest(px) AS v, generate_subscripts(px, 1)-1 AS p FROM snap),
g AS (SELECT a.img_id, a.p, b.v-a.v AS gx, c.v-a.v AS gy FROM e a JOIN e b ON b.img_id=a.img_id AND b.p=a.p+1 AND a.p % 8 < 7 JOIN e c ON c.img_id=a.img_id AND c.p=a.p+8),
o AS (SELECT img_id, p, sqrt(gx*gx+gy*gy) AS mag, ((degrees(atan2(gy,gx)) % 360)+360) % 360 AS ang FROM g)"""


def _gradients(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Magnitude and direction of forward differences, from the pixel array itself."""
    s = snapshots(spark, sf_dir).select("img_id", "px", F.explode(F.sequence(F.lit(0), F.lit(55))).alias("p")).where("p % 8 < 7")
    at = lambda k: F.element_at("px", F.col("p") + k)
    gx, gy = at(2) - at(1), at(9) - at(1)
    return s.select("img_id", "p", F.sqrt(gx * gx + gy * gy).alias("mag"), F.pmod(F.degrees(F.atan2(gy, gx)), F.lit(360.0)).alias("ang"))


@query(f"WITH {GRAD} SELECT img_id, p::INT AS p, round(mag, 6) + 0.0 AS mag, round(ang, 5) + 0.0 AS ang FROM o")
def hog_gradients(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _gradients(spark, sf_dir).select("img_id", "p", r6(F.col("mag")).alias("mag"), r6(F.col("ang"), 5).alias("ang"))


@query(f"WITH {GRAD}, s AS (SELECT *, ang/40-0.5 AS pos FROM o), b AS (SELECT img_id, (p//8//4)*2+(p%8//4) AS cell, ((floor(pos)::INT+9) % 9)::INT AS bin, mag*(1-(pos-floor(pos))) AS w FROM s UNION ALL SELECT img_id, (p//8//4)*2+(p%8//4), ((floor(pos)::INT+10) % 9)::INT, mag*(pos-floor(pos)) FROM s) SELECT img_id, cell::INT AS cell, bin, round(sum(w), 6) + 0.0 AS w FROM b GROUP BY ALL")
def hog_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Direction histograms per 4 x 4 cell, each pixel shared between the two nearest of nine directions."""
    pos = F.col("ang") / 40 - 0.5
    low = F.floor(pos)
    share = F.explode(F.array(F.struct(F.pmod(low, F.lit(9)).cast("int").alias("bin"), (F.col("mag") * (1 - (pos - low))).alias("w")), F.struct(F.pmod(low + 1, F.lit(9)).cast("int").alias("bin"), (F.col("mag") * (pos - low)).alias("w"))))
    g = _gradients(spark, sf_dir).select("img_id", (F.floor(F.col("p") / 32) * 2 + F.floor(F.col("p") % 8 / 4)).cast("int").alias("cell"), share.alias("s"))
    return g.groupBy("img_id", "cell", F.col("s.bin").alias("bin")).agg(r6(F.sum("s.w")).alias("w"))


@query(f"WITH {GRAD}, q AS (SELECT img_id, quantile_cont(mag, 0.95) AS cut FROM o GROUP BY 1) SELECT img_id, p::INT AS p, round(CASE WHEN mag > cut THEN mag ELSE 0 END, 6) + 0.0 AS mag, CASE WHEN mag > cut THEN round(ang, 5) + 0.0 END AS ang FROM o JOIN q USING (img_id)")
def flow_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors above the 95th percentile of magnitude; the others are 0 and have no direction.

    A group is one image, so its percentile holds an image's pixels at most.
    """
    g = _gradients(spark, sf_dir)
    cut = g.groupBy("img_id").agg(F.percentile("mag", F.lit(0.95)).alias("cut"))
    keep = F.col("mag") > F.col("cut")
    return g.join(cut, "img_id").select("img_id", "p", r6(F.when(keep, F.col("mag")).otherwise(0.0)).alias("mag"), F.when(keep, r6(F.col("ang"), 5)).alias("ang"))


@query(f"WITH {SNAP}, c AS (SELECT img_id, j//8 AS y, j%8 AS x, px[j+1] AS v FROM snap, range(64) t(j)), m AS (SELECT *, (x-5)*(x-5)+(y-4)*(y-4) >= 1 AND (x-5)*(x-5)+(y-4)*(y-4) < 9 AS inside FROM c) SELECT img_id, count(*) FILTER (WHERE inside) AS n, round(avg(v) FILTER (WHERE inside), 6) + 0.0 AS inner_mean, round(avg(v) FILTER (WHERE NOT inside), 6) + 0.0 AS outer_mean FROM m GROUP BY img_id")
def annular_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Means of every image within and without a ring; its centre is one pixel to the right."""
    y, x = F.floor(F.col("j") / 8), F.col("j") % 8
    r2 = (x - 5) * (x - 5) + (y - 4) * (y - 4)
    c = snapshots(spark, sf_dir).select("img_id", F.posexplode("px").alias("j", "v")).withColumn("inside", (r2 >= 1) & (r2 < 9))
    mean = lambda here: F.avg(F.when(here, F.col("v")))
    return c.groupBy("img_id").agg(F.count_if("inside").alias("n"), r6(mean(F.col("inside"))).alias("inner_mean"), r6(mean(~F.col("inside"))).alias("outer_mean"))


@query(f"WITH {TAU}, h AS (SELECT prd, least(floor(tau*20),19)::INT AS bin, count(*) AS n FROM ev GROUP BY 1, 2), c AS (SELECT prd, bin, floor(20*sum(n) OVER (PARTITION BY prd ORDER BY bin)/sum(n) OVER (PARTITION BY prd))::BIGINT AS level FROM h) SELECT prd, bin, level FROM c")
def histogram_equalise(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = tau_events(spark, sf_dir).groupBy("prd", seq.equal_bin(F.col("tau"), 20).alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    run, whole = Window.partitionBy("prd").orderBy("bin"), Window.partitionBy("prd")
    return h.select("prd", "bin", F.floor(20 * F.sum("n").over(run) / F.sum("n").over(whole)).alias("level"))


@query("SELECT (doc_id % 50)::BIGINT AS prd, max(CASE WHEN quality = 1 THEN 1 ELSE -1 END) AS sense, min(doc_id % 8 + 1) AS psi, bool_or(toxic = 1) AS trashed FROM labels GROUP BY 1")
def anchors_and_trash(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = table(spark, sf_dir, "labels")
    return a.groupBy((F.col("doc_id") % 50).alias("prd")).agg(F.max(F.when(F.col("quality") == 1, 1).otherwise(-1)).alias("sense"), F.min(F.col("doc_id") % 8 + 1).alias("psi"), F.bool_or(F.col("toxic") == 1).alias("trashed"))


@query("WITH a AS (SELECT doc_id % 50 AS prd, doc_id % 8 AS cc1, doc_id % 5 AS cc2 FROM labels) SELECT prd, cc1, cc2, count(*) AS n FROM a WHERE cc1 <> cc2 GROUP BY ALL")
def distinct_coordinates(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("doc_id")
    a = table(spark, sf_dir, "labels").select((i % 50).alias("prd"), (i % 8).alias("cc1"), (i % 5).alias("cc2"))
    return a.where("cc1 <> cc2").groupBy("prd", "cc1", "cc2").agg(F.count(F.lit(1)).alias("n"))


@query("WITH c AS (SELECT DISTINCT n_regionkey AS component FROM nation), a AS (SELECT DISTINCT c_nationkey % 4 AS component FROM customer) SELECT count(*) AS components, count(a.component) AS anchored, count(*) = count(a.component) AS covered FROM c LEFT JOIN a USING (component)")
def anchor_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "nation").select(F.col("n_regionkey").alias("component")).distinct()
    a = table(spark, sf_dir, "customer").select((F.col("c_nationkey") % 4).alias("component")).distinct().withColumn("hit", F.lit(1))
    return c.join(a, "component", "left").agg(F.count(F.lit(1)).alias("components"), F.count("hit").alias("anchored"), (F.count(F.lit(1)) == F.count("hit")).alias("covered"))


@query("WITH r AS (SELECT s_suppkey AS id, (s_suppkey % 17)/17.0::DOUBLE AS ratio FROM supplier), v AS (SELECT k/8.0::DOUBLE AS v FROM range(9) t(k)) SELECT id, arg_min(v, (round(abs(v-ratio), 9), v)) AS closest FROM r, v GROUP BY id")
def closest_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    ratio = F.col("s_suppkey") % 17 / 17.0
    options = F.array(*(F.lit(k / 8.0) for k in range(9)))
    best = F.array_min(F.transform(options, lambda v: F.struct(F.round(F.abs(v - ratio), 9).alias("d"), v.alias("v"))))
    return table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), best["v"].alias("closest"))


@query(f"WITH {CENTRES}, b AS (SELECT img_id, bin, img_id // 100 AS block FROM member), p AS (SELECT a.block AS block_a, c.block AS block_b, count(*) AS pairs FROM b a JOIN b c ON a.bin = c.bin AND a.img_id < c.img_id GROUP BY ALL) SELECT block_a, block_b, pairs FROM p")
def blocked_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs within bins, counted by block: the unit of a blocked pairwise computation."""
    m = _members(spark, sf_dir)
    size = m.groupBy("bin", F.floor(F.col("img_id") / 100).alias("block")).agg(F.count(F.lit(1)).alias("n"))
    a, b = size.select("bin", F.col("block").alias("block_a"), F.col("n").alias("na")), size.select("bin", F.col("block").alias("block_b"), F.col("n").alias("nb"))
    same = F.col("block_a") == F.col("block_b")
    pairs = F.when(same, F.col("na") * (F.col("na") - 1) / 2).otherwise(F.col("na") * F.col("nb")).cast("long")
    return a.join(b, "bin").where("block_a <= block_b").groupBy("block_a", "block_b").agg(F.sum(pairs).alias("pairs")).where("pairs > 0")


@query("SELECT g.k::INT AS gc, p.label AS prd, (g.k*10+p.label)::BIGINT AS idx FROM range(3) g(k), (SELECT DISTINCT label FROM embeddings) p")
def index_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "embeddings").select(F.col("label").alias("prd")).distinct()
    return p.crossJoin(F.broadcast(spark.range(3).select(F.col("id").cast("int").alias("gc")))).select("gc", "prd", (F.col("gc") * 10 + F.col("prd")).cast("long").alias("idx"))


@query("WITH t AS (SELECT DISTINCT user_id, event_type FROM events), d AS (SELECT DISTINCT user_id, event_type FROM events WHERE value > 90) SELECT * FROM t EXCEPT SELECT * FROM d")
def resume_pending(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return pending(e.select("user_id", "event_type").distinct(), e.where("value > 90"), ["user_id", "event_type"])


@query(f"WITH {SNAP}, s AS (SELECT prd, count(*) FILTER (WHERE v <> 0) AS nonzero, count(*) FILTER (WHERE v > 0.1) AS large, count(*) AS n FROM (SELECT prd, unnest(px) AS v FROM snap) GROUP BY prd) SELECT prd, nonzero, large, n = nonzero AS dense FROM s")
def nonzero_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = snapshots(spark, sf_dir).select("prd", F.explode("px").alias("v"))
    return v.groupBy("prd").agg(F.count_if(F.col("v") != 0).alias("nonzero"), F.count_if(F.col("v") > 0.1).alias("large"), F.count(F.lit(1)).alias("n")).select("prd", "nonzero", "large", (F.col("n") == F.col("nonzero")).alias("dense"))


@query(f"WITH {SNAP}, f AS (SELECT prd, corr(px[1], px[2]) * count(*) AS c12, regr_r2(px[2], px[1]) AS r2 FROM snap GROUP BY prd) SELECT prd, round(c12, 6) + 0.0 AS c12, round(r2, 6) + 0.0 AS r2 FROM f")
def correlation_and_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = F.element_at("px", 1), F.element_at("px", 2)
    return snapshots(spark, sf_dir).groupBy("prd").agg(r6(F.corr(a, b) * F.count(F.lit(1))).alias("c12"), r6(F.regr_r2(b, a)).alias("r2"))


@query(f"WITH {SNAP}, p AS (SELECT prd, img_id, px, row_number() OVER (PARTITION BY prd ORDER BY img_id) AS rn FROM snap), l AS (SELECT a.prd, a.rn-2 AS frame, sum(list_sum(list_transform(range(1, 65), lambda k: b.px[k]))) AS s FROM p a JOIN p b ON b.prd=a.prd AND b.rn BETWEEN a.rn-1 AND a.rn+1 WHERE a.rn > 2 GROUP BY ALL) SELECT prd, frame::INT AS frame, round(s, 5) + 0.0 AS s FROM l")
def lag_sums(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sum over the lags of a window of three, as one rolling frame instead of a matrix of shifted copies."""
    total = F.aggregate("px", F.lit(0.0), lambda acc, v: acc + v)
    w = Window.partitionBy("prd").orderBy("img_id")
    o = snapshots(spark, sf_dir).select("prd", "img_id", total.alias("t"))
    return o.select("prd", F.row_number().over(w).alias("rn"), F.sum("t").over(w.rowsBetween(-1, 1)).alias("s")).where("rn > 2").select("prd", (F.col("rn") - 2).alias("frame"), r6(F.col("s"), 5).alias("s"))


def _thresholds(name: str):
    def run(g: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"prd": [g["prd"].iloc[0]], "threshold": [getattr(mixtures, name)(g["iqr"].to_numpy())]})

    def plan(spark: SparkSession, sf_dir: str) -> DataFrame:
        q = group_quantiles(tau_events(spark, sf_dir), "value", ["prd", "user_id"], {"q1": 0.25, "q3": 0.75})
        u = q.select("prd", (F.col("q3") - F.col("q1")).alias("iqr"))  # one value per node
        return u.select("prd", "iqr").groupBy("prd").applyInPandas(run, "prd string, threshold double")

    return plan


for _name, _kernel in (("threshold_mixture", "gaussian_threshold"), ("threshold_decay", "decay_threshold"), ("threshold_valley", "valley_threshold")):
    QUERIES[_name] = _thresholds(_kernel)


@query()
def reembed_subset(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A new embedding of a chosen subset of every group."""
    from sphaera.config import Config
    from sphaera.plans.stages import embed

    s = snapshots(spark, sf_dir)
    chosen = s.where("img_id % 5 <> 0").select("img_id")
    return embed(s.join(chosen, "img_id", "left_semi"), Config()).select("prd", "img_id", "kept", F.round("mu", 6).alias("mu"))


@query(f"WITH {FULL} SELECT prd, i, j, round(d2, 6) + 0.0 AS d2 FROM mat")
def reduced_distance_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Full distance matrix of every group, for display."""
    return _matrix(spark, sf_dir)
