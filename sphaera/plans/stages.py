"""The stages of a run as grouped plans: distances, embeddings, filtered sequences, flows, labels."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sphaera.config import Config
from sphaera.functions.geometry import wavelength
from sphaera.kernels import diffusion, flow, images, sequence
from sphaera.operators import graphs as gr
from sphaera.operators import messages as bp
from sphaera.operators import spectrum, tiles
from sphaera.operators.tessellation import cap_members, mean_directions
from sphaera.operators.thresholds import tau_quality
from sphaera.plans.base import SNAP, r6, snapshots

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(f: Callable) -> Callable:
    QUERIES[f.__name__] = f
    return f


def oracle(sql: str) -> Callable:
    def keep(f: Callable) -> Callable:
        ORACLE_SQL[f.__name__] = sql
        return f

    return keep


def _capped(rows: DataFrame, cfg: Config) -> DataFrame:
    """Groups are cut to the configured size before a grouped kernel, so a task holds at most high^2 distances."""
    return cap_members(rows, cfg.high, "prd")


def _dealt(rows: DataFrame, cfg: Config) -> DataFrame:
    """Capped groups, dealt out by group: they are small in bytes and long in work, so they must not be put together by size."""
    spark = rows.sparkSession
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 8 * spark.sparkContext.defaultParallelism)
    return _capped(rows, cfg).select("prd", "img_id", "px").repartition(n, "prd")


def embed(rows: DataFrame, cfg: Config) -> DataFrame:
    """prd, img_id, psi, mu, sigma, r2, kept: rows (prd, img_id, px) embedded group by group and pruned to a fixpoint."""

    def run(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("img_id")
        x = np.stack(g["px"].to_numpy())
        d2 = np.maximum(((x[:, None] - x[None]) ** 2).sum(2), 0) if len(x) <= 256 else _gram_distances(x)
        if len(x) < 6:
            return pd.DataFrame({"prd": g["prd"], "img_id": g["img_id"], "psi": [[] for _ in range(len(g))], "mu": np.nan, "sigma": np.nan, "r2": np.nan, "kept": False})
        keep, e = diffusion.trimmed_map(d2, cfg.radius, cfg.tune, cfg.num_eigs)
        out = pd.DataFrame({"prd": g["prd"].to_numpy(), "img_id": g["img_id"].to_numpy(), "psi": [[]] * len(g), "mu": np.nan, "sigma": e.sigma, "r2": e.bandwidth.r2, "kept": False})
        out["psi"] = out["psi"].astype(object)
        for k, row in zip(keep, e.psi, strict=True):
            out.at[k, "psi"] = row.tolist()
        out.loc[keep, "mu"] = e.mu
        out.loc[keep, "kept"] = True
        return out

    return _dealt(rows, cfg).groupBy("prd").applyInPandas(run, "prd int, img_id long, psi array<double>, mu double, sigma double, r2 double, kept boolean")


def _gram_distances(x: np.ndarray) -> np.ndarray:
    s = (x * x).sum(1)
    d = np.maximum(s[:, None] + s[None, :] - 2 * x @ x.T, 0)
    np.fill_diagonal(d, 0)
    return d


@query
def stage_embedding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embed(snapshots(spark, sf_dir), Config()).select("prd", "img_id", F.size("psi").alias("n_eigs"), F.round("mu", 6).alias("mu"), F.round("sigma", 6).alias("sigma"), "kept")


@query
def stage_spectrum(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Eigenvalues per group."""

    def run(g: pd.DataFrame) -> pd.DataFrame:
        e = diffusion.diffusion_map(_gram_distances(np.stack(g.sort_values("img_id")["px"].to_numpy())), len(g), 3.0)
        return pd.DataFrame({"prd": g["prd"].iloc[0], "ordinal": np.arange(len(e.values)), "value": e.values, "leading": np.arange(len(e.values)) <= 8})

    return _dealt(snapshots(spark, sf_dir), Config()).groupBy("prd").applyInPandas(run, "prd int, ordinal int, value double, leading boolean").where("ordinal > 0 AND value > 0")


@query
def stage_neighbour_spectrum(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spectra of whole groups, of any size, over the graph of 64 nearest neighbours: no cap and no dense matrix."""
    cfg = Config()
    _, values = spectrum.embed(snapshots(spark, sf_dir), 64, cfg.tune, cfg.num_psi, tolerance=1e-6)
    return values.select("prd", "ordinal", F.round("value", 6).alias("value"), F.round("sigma", 6).alias("sigma"), F.round("r2", 6).alias("r2"))


@query
def stage_bandwidth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fitted kernel sums per group: slope, best bandwidth and R2."""

    def run(g: pd.DataFrame) -> pd.DataFrame:
        b = diffusion.fit_bandwidth(_gram_distances(np.stack(g["px"].to_numpy())))
        return pd.DataFrame({"prd": [g["prd"].iloc[0]], "slope": [b.slope], "log_eps": [b.best], "r2": [b.r2]})

    return _dealt(snapshots(spark, sf_dir), Config()).groupBy("prd").applyInPandas(run, "prd int, slope double, log_eps double, r2 double")


def filtered(rows: DataFrame, cfg: Config, psis: int = 2) -> DataFrame:
    """prd, psi, frame, tau, px: filtered sequences along each of the first coordinates of a group.

    Images are dealt out once per group, and distances and embedding are worked out once for all its coordinates.
    """

    def run(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("img_id")
        x = np.stack(g["px"].to_numpy())
        d2 = _gram_distances(x)
        e = diffusion.diffusion_map(d2, len(x), cfg.tune, cfg.num_eigs)
        window = cfg.con_order(len(x))
        out = []
        for psi in range(psis):
            order = np.argsort(e.psi[:, psi], kind="stable")
            f = sequence.filter_sequence(d2[np.ix_(order, order)], x[order], window, cfg.tune, cfg.psi_trunc)
            tau = (f.tau - f.tau.min()) / max(np.ptp(f.tau), 1e-300)
            out.append(pd.DataFrame({"prd": g["prd"].iloc[0], "psi": psi, "frame": np.arange(len(tau)), "tau": tau, "px": list(f.frames.T)}))
        return pd.concat(out)

    return _dealt(rows, cfg).groupBy("prd").applyInPandas(run, "prd int, psi int, frame int, tau double, px array<double>")


SMALL = Config(con_order_range=12, psi_trunc=8, bp_damping=0.5)


@query
def stage_filtered_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filtered(snapshots(spark, sf_dir), SMALL).select("prd", "psi", "frame", F.round("tau", 6).alias("tau"), F.size("px").alias("pixels"))


@query
def stage_sequence_energy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Energy of the pooled coordinate of all filtered sequences."""
    from sphaera.functions.geometry import thermal_energy
    from sphaera.operators import sequences as seq

    return seq.energy(seq.histogram(filtered(snapshots(spark, sf_dir), SMALL, 1), "tau", 50), thermal_energy())


def flows(movies: DataFrame) -> DataFrame:
    """prd, psi, vx, vy: summed flow of each movie (prd, psi, frame, tau, px), polynomial flow refined by Horn and Schunck's."""

    def run(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values(["tau", "frame"])
        x = np.stack(g["px"].to_numpy())
        side = int(round(x.shape[1] ** 0.5))
        movie = images.smooth_movie(-x[sequence.class_frames(g["tau"].to_numpy(), 20)].reshape(-1, side, side))
        u, v = images.movie_flow(movie, start=flow.polynomial_flow)
        return pd.DataFrame({"prd": [g["prd"].iloc[0]], "psi": [g["psi"].iloc[0]], "vx": [u.ravel()], "vy": [v.ravel()]})

    return movies.groupBy("prd", "psi").applyInPandas(run, "prd int, psi int, vx array<double>, vy array<double>")


def edge_measures(edges: DataFrame, field: DataFrame, norm: str = "l2") -> DataFrame:
    """edge, src, dst, psi_a, psi_b, sense, dist: all pairs of coordinates of the two ends, in both senses.

    The flow fields are checkpointed, for both ends of an edge read them.
    """
    gr.checkpoint_dir(field.sparkSession)
    field = field.checkpoint()
    a = field.select(F.col("prd").alias("src"), F.col("psi").alias("psi_a"), F.col("vx").alias("ax"), F.col("vy").alias("ay"))
    b = field.select(F.col("prd").alias("dst"), F.col("psi").alias("psi_b"), F.col("vx").alias("bx"), F.col("vy").alias("by_"))
    met = edges.join(a, "src").join(b, "dst").select("edge", "src", "dst", "psi_a", "psi_b", F.explode(F.array(F.lit(1), F.lit(-1))).alias("sense"), "ax", "ay", "bx", "by_")

    def run(batches):
        for g in batches:
            d = []
            for s, ax, ay, bx, by in zip(g["sense"], g["ax"], g["ay"], g["bx"], g["by_"], strict=True):
                side = int(round(len(ax) ** 0.5))
                d.append(images.flow_distance((s * ax.reshape(side, side), s * ay.reshape(side, side)), (bx.reshape(side, side), by.reshape(side, side)), norm))
            yield g[["edge", "src", "dst", "psi_a", "psi_b", "sense"]].assign(dist=d)

    return met.mapInPandas(run, "edge int, src int, dst int, psi_a int, psi_b int, sense int, dist double")


def label_nodes(measures: DataFrame, nodes: DataFrame, anchors: DataFrame, psis: int, cfg: Config, bad: DataFrame | None = None, trash: DataFrame | None = None) -> DataFrame:
    """prd, psi, sense, belief by belief propagation on the cluster.

    measures: edge, src, dst, psi_a, psi_b, sense, dist; nodes: prd; anchors: prd, state; bad: prd, psi that are shut out;
    trash: prd.  Trashed nodes get no label and pass nothing on.  If every node is an anchor or trashed, the anchors are the
    labels.  Distances are mapped to 5 to 45 by the largest one.
    """
    ids = nodes.select(F.col("prd").cast("long").alias("id")).distinct()
    at = anchors.select(F.col("prd").cast("long").alias("id"), "state")
    if trash is not None:
        out = trash.select(F.col("prd").cast("long").alias("id"))
        ids, at = ids.join(out, "id", "left_anti"), at.join(out, "id", "left_anti")
        measures = measures.join(out.withColumnRenamed("id", "src"), "src", "left_anti").join(out.withColumnRenamed("id", "dst"), "dst", "left_anti")
    if not ids.join(at, "id", "left_anti").limit(1).count():  # labelled by hand throughout: nothing to propagate
        s = F.col("state")
        return at.select(F.col("id").cast("int").alias("prd"), (s % psis).cast("int").alias("psi"), F.when(s < psis, 1).otherwise(-1).alias("sense"), F.lit(1.0).alias("belief"))
    top = measures.agg(F.when(F.max("dist") > 0, F.max("dist")).otherwise(1.0).alias("top"))
    scaled = measures.crossJoin(F.broadcast(top)).withColumn("v", 5 + 40 * F.col("dist") / F.col("top"))  # one row
    pots = bp.node_potentials(ids, psis, at, None if bad is None else bad.withColumnRenamed("prd", "id"))
    held, _ = bp.propagate(pots, bp.edge_potentials(scaled, psis), 2 * psis, cfg.bp_tolerance, cfg.bp_rounds, cfg.bp_damping, cfg.bp_max_product)
    return bp.decode(bp.beliefs(pots, held, 2 * psis), psis).select(F.col("id").cast("int").alias("prd"), "psi", "sense", "belief")


@query
def stage_flow(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = flows(filtered(snapshots(spark, sf_dir), SMALL))
    size = F.aggregate(F.zip_with("vx", "vy", lambda a, b: F.sqrt(a * a + b * b)), F.lit(0.0), lambda acc, x: acc + x)
    return f.select("prd", "psi", F.size("vx").alias("pixels"), F.round(size, 6).alias("flow"))


@query
def stage_edge_measures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _measured(spark, sf_dir).withColumn("dist", F.round("dist", 6))


def direction_graph(members: DataFrame, eps: float) -> DataFrame:
    """edge, src, dst: groups of members (prd, q0..q3) whose mean directions lie at most eps apart, numbered in order."""
    q0, q1, q2, q3 = (F.col(f"q{k}") for k in range(4))
    s = members.select("prd", (2 * (q1 * q3 - q0 * q2)).alias("sx"), (2 * (q0 * q1 + q2 * q3)).alias("sy"), (2 * (q0 * q0 + q3 * q3 - 0.5)).alias("sz"))
    m = mean_directions(s, "prd").select("prd", F.col("mx").alias("x"), F.col("my").alias("y"), F.col("mz").alias("z"))
    gr.checkpoint_dir(members.sparkSession)
    edges = gr.neighbourhood(m, eps, "prd").select("src", "dst").orderBy("src", "dst").checkpoint()
    return gr.numbered(edges, "edge").select(F.col("edge").cast("int").alias("edge"), "src", "dst")


def group_graph(spark: SparkSession, sf_dir: str, eps: float) -> DataFrame:
    return direction_graph(snapshots(spark, sf_dir), eps)


def _sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The filtered sequences of all groups, checkpointed: several steps read them."""
    gr.checkpoint_dir(spark)
    return filtered(snapshots(spark, sf_dir), SMALL).checkpoint()


def _measured(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edge_measures(group_graph(spark, sf_dir, 1.2), flows(_sequences(spark, sf_dir)))


@query
def stage_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels of all groups from the first one's anchor; coordinates of poor quality are shut out."""
    seqs = _sequences(spark, sf_dir)
    nodes = snapshots(spark, sf_dir).select("prd").distinct()
    bad = tau_quality(seqs, "tau", ["prd", "psi"]).where("bad").select("prd", "psi")
    measures = edge_measures(group_graph(spark, sf_dir, 1.2), flows(seqs)).checkpoint()
    anchor = nodes.agg(F.min("prd").alias("prd")).select("prd", F.lit(0).alias("state"))
    return label_nodes(measures, nodes, anchor, 2, SMALL, bad).withColumn("belief", F.round("belief", 6))


OPTICS, FRONT = tiles.Optics(), tiles.Front(outer=3.0, kind="Butter", cutoff=0.5, order=8)
_W = wavelength(300.0)
#: Images less their background, low-passed (a convolution with the filter's kernel), masked; their spectra by the plain sum
#: over all pixels, and the transfer function of each defocus.
_SPECTRA = f"""{SNAP}, g AS (SELECT a.k AS ky, b.k AS kx, (2.0::DOUBLE/8)*sqrt(power(CASE WHEN a.k < 4 THEN a.k ELSE a.k-8 END, 2)+power(CASE WHEN b.k < 4 THEN b.k ELSE b.k-8 END, 2)) AS q FROM range(8) a(k), range(8) b(k)),
h AS (SELECT a.d AS dy, b.d AS dx, sum(sqrt(1/(1+pow(q/0.5, 16)))*cos(2*pi()*(ky*a.d+kx*b.d)/8.0))/64 AS h FROM g, range(8) a(d), range(8) b(d) GROUP BY 1, 2),
pix AS (SELECT img_id, prd, df, j//8 AS y, j%8 AS x, px[j+1] AS v, (j%8-5)*(j%8-5)+(j//8-4)*(j//8-4) < 9 AS inside FROM snap, range(64) t(j)),
bk AS (SELECT img_id, avg(CASE WHEN inside THEN 0 ELSE v END) AS m, stddev_pop(CASE WHEN inside THEN 0 ELSE v END) AS s FROM pix GROUP BY 1),
nrm AS (SELECT pix.*, (v-m)/s AS z FROM pix JOIN bk USING (img_id)),
flt AS (SELECT img_id, any_value(prd) AS prd, any_value(df) AS df, (y+dy)%8 AS y, (x+dx)%8 AS x, sum(z*h) AS v FROM nrm, h GROUP BY img_id, (y+dy)%8, (x+dx)%8),
msk AS (SELECT * FROM flt WHERE (x-5)*(x-5)+(y-4)*(y-4) < 9),
sp AS (SELECT img_id, any_value(prd) AS prd, any_value(df) AS df, ky, kx, sum(v*cos(2*pi()*(ky*y+kx*x)/8.0)) AS re, -sum(v*sin(2*pi()*(ky*y+kx*x)/8.0)) AS im FROM msk, g GROUP BY img_id, ky, kx),
gam AS (SELECT df, ky, kx, q*q/4 AS k2, (0.5*pi()*2.7*1e7*{_W!r}*{_W!r}*{_W!r}*q*q/4-pi()*{_W!r}*df)*q*q/4 AS gam FROM (SELECT DISTINCT df FROM snap), g),
ctf AS (SELECT df, ky, kx, (sin(gam)-0.1*cos(gam))*exp(-k2/(2*pow(0.5/sqrt(2*ln(2.0)), 2))) AS c FROM gam),
fc AS (SELECT sp.*, c FROM sp JOIN ctf USING (df, ky, kx))"""


def _prepared(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tiles.prepare(snapshots(spark, sf_dir), FRONT)


@oracle(f"WITH {_SPECTRA} SELECT a.prd, a.img_id AS i, b.img_id AS j, round(sum(power(a.c*b.re-b.c*a.re, 2)+power(a.c*b.im-b.c*a.im, 2))/64, 4) + 0.0 AS d2 FROM fc a JOIN fc b ON a.prd = b.prd AND a.img_id < b.img_id AND a.ky = b.ky AND a.kx = b.kx GROUP BY 1, 2, 3")
@query
def stage_ctf_distances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distances that compare prepared images under each other's transfer function, tile by tile, whole groups."""
    return tiles.long_distances(tiles.distance_rows(tiles.tiles(tiles.blocks(_prepared(spark, sf_dir), OPTICS)), digits=4))


@oracle(f"""WITH {_SPECTRA}, t AS (SELECT prd, ky, kx, sum(re*c)/(sum(c*c)+0.2)/count(*) AS wr, sum(im*c)/(sum(c*c)+0.2)/count(*) AS wi, sum(re*sign(c))/count(*) AS fr, sum(im*sign(c))/count(*) AS fi FROM fc GROUP BY 1, 2, 3)
SELECT prd, (y.k*8+x.k)::INT AS pixel, round(sum(wr*cos(2*pi()*(ky*y.k+kx*x.k)/8.0)-wi*sin(2*pi()*(ky*y.k+kx*x.k)/8.0))/64, 5) + 0.0 AS restored, round(sum(fr*cos(2*pi()*(ky*y.k+kx*x.k)/8.0)-fi*sin(2*pi()*(ky*y.k+kx*x.k)/8.0))/64, 5) + 0.0 AS flipped FROM t, range(8) y(k), range(8) x(k) GROUP BY 1, 2""")
@query
def stage_average_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Wiener-restored and phase-flipped mean image of each group."""
    avg = tiles.average_images(_prepared(spark, sf_dir), OPTICS)
    cells = avg.select("prd", F.posexplode(F.arrays_zip("restored", "flipped")).alias("pixel", "e"))
    return cells.select("prd", "pixel", r6(F.col("e.restored"), 5).alias("restored"), r6(F.col("e.flipped"), 5).alias("flipped"))


@query
def stage_prepared_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Images low-passed, turned in plane and shifted, in Arrow batches without a shuffle."""

    def run(batches):
        w = images.transfer(images.radial_frequency(8), "Butter", 0.5, 8)
        for g in batches:
            out = [images.shift_wrapped(images.rotate_fill(images.fourier_filter(np.reshape(x, (8, 8)), w), float(i % 360)), 0.5, -0.5).ravel() for i, x in zip(g["img_id"], g["px"], strict=True)]
            yield g[["img_id"]].assign(px=out)

    rows = snapshots(spark, sf_dir).select("img_id", "px").mapInPandas(run, "img_id long, px array<double>")
    return rows.select("img_id", F.posexplode("px").alias("pixel", "v")).withColumn("v", F.round("v", 6))


@query
def stage_volume_modes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mode filter over a stack: the Gram matrix is a distributed sum of outer products of voxel rows, the map back too.

    rows: voxel, values over the volumes.  Only the Gram matrix (volumes x volumes, 10 x 10 here) reaches the driver.
    """
    e = snapshots(spark, sf_dir).select("prd", F.posexplode("px").alias("voxel", "v")).groupBy("voxel", "prd").agg(F.avg("v").alias("v"))
    rows = e.groupBy("voxel").agg(F.transform(F.array_sort(F.collect_list(F.struct("prd", "v"))), lambda s: s["v"]).alias("v"))
    gram = rows.select(F.posexplode("v").alias("i", "a"), "v").select("i", "a", F.posexplode("v").alias("j", "b")).groupBy("i", "j").agg(F.sum(F.col("a") * F.col("b")).alias("g")).collect()
    n = max(r["i"] for r in gram) + 1
    m = np.zeros((n, n))
    for r in gram:
        m[r["i"], r["j"]] = r["g"]
    _, vectors = np.linalg.eigh(m)
    basis = vectors[:, ::-1][:, :2]
    project = (basis @ basis.T).tolist()
    at = [F.aggregate(F.zip_with("v", F.array(*(F.lit(float(x)) for x in row)), lambda a, b: a * b), F.lit(0.0), lambda acc, x: acc + x) for row in project]
    return rows.select("voxel", F.posexplode(F.array(*at)).alias("volume", "v")).withColumn("v", F.round("v", 6) + 0.0)


@query
def stage_gradient_histograms(spark: SparkSession, sf_dir: str) -> DataFrame:
    def run(batches):
        for g in batches:
            out = []
            for x in g["px"]:
                gy, gx = np.gradient(np.reshape(x, (8, 8)))
                out.append(images.gradient_histogram(gx, gy))
            yield g[["img_id"]].assign(hog=out)

    rows = snapshots(spark, sf_dir).select("img_id", "px").mapInPandas(run, "img_id long, hog array<double>")
    return rows.select("img_id", F.posexplode("hog").alias("k", "v")).withColumn("v", F.round("v", 6))
