"""Queries over coordinates: histograms, energies, distribution matching, thresholds, landscapes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sphaera.functions.geometry import thermal_energy
from sphaera.operators import sequences as seq
from sphaera.operators import tessellation as tess
from sphaera.operators import thresholds as thr
from sphaera.plans.base import CENTRES, K, r6, table
from sphaera.plans.orientation import _members

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(oracle: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLE_SQL[f.__name__] = oracle
        return f

    return keep


#: tau of events per event_type (prd), of lineitem per l_returnflag.
TAU = "ev AS (SELECT event_id, ts, event_type AS prd, user_id, value, (value-min(value) OVER w)/(max(value) OVER w-min(value) OVER w) AS tau FROM events WINDOW w AS (PARTITION BY event_type))"
BIG = "li AS (SELECT l_orderkey, l_linenumber, l_returnflag AS prd, (l_extendedprice-min(l_extendedprice) OVER w)/(max(l_extendedprice) OVER w-min(l_extendedprice) OVER w) AS tau FROM lineitem WINDOW w AS (PARTITION BY l_returnflag))"


def tau_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("event_id", "ts", F.col("event_type").alias("prd"), "user_id", "value")
    return _unit(e, "value")


def _unit(rows: DataFrame, value: str) -> DataFrame:
    """Min-max per prd.  The range is a partial aggregate of a row per group and task, not a window over whole groups."""
    ends = rows.groupBy("prd").agg(F.min(value).alias("lo"), F.max(value).alias("hi"))
    return rows.join(ends, "prd").withColumn("tau", F.when(F.col("hi") > F.col("lo"), (F.col(value) - F.col("lo")) / (F.col("hi") - F.col("lo"))).otherwise(0.0)).drop("lo", "hi")


def tau_lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_returnflag").alias("prd"), "l_extendedprice")
    return _unit(li, "l_extendedprice")


KT = thermal_energy()
_HIST = "h AS (SELECT b.bin::INT AS bin, coalesce(c.n, 0) AS occupancy FROM range(50) b(bin) LEFT JOIN (SELECT least(floor(tau*50), 49)::INT AS bin, count(*) AS n FROM {0} GROUP BY 1) c USING (bin))"


@query(f"WITH {BIG}, {_HIST.format('li')} SELECT bin, occupancy, round(-{KT!r}*ln(greatest(occupancy, 1)) - min(-{KT!r}*ln(greatest(occupancy, 1))) OVER (), 6) + 0.0 AS energy FROM h")
def energy_1d(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = seq.histogram(tau_lineitem(spark, sf_dir), "tau", 50)
    return seq.energy(counts, KT).withColumn("energy", r6(F.col("energy")))


@query(f"WITH {TAU}, {_HIST.format('ev')} SELECT bin, occupancy FROM h")
def tau_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return seq.histogram(tau_events(spark, sf_dir), "tau", 50)


@query(f"WITH {TAU} SELECT event_id, round(tau, 6) AS tau FROM ev")
def tau_min_max(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tau_events(spark, sf_dir).select("event_id", F.round("tau", 6).alias("tau"))


@query("""WITH t AS (SELECT l_returnflag AS prd, l_linestatus AS psi, l_extendedprice AS v FROM lineitem), trash(prd) AS (VALUES ('A')), u AS (SELECT prd, (v-min(v) OVER w)/(max(v) OVER w-min(v) OVER w) AS tau FROM t WHERE psi IS NOT NULL AND prd NOT IN (SELECT prd FROM trash) WINDOW w AS (PARTITION BY prd))
SELECT least(floor(tau*50), 49)::INT AS bin, count(*) AS occupancy FROM u GROUP BY 1""")
def energy_without_trash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Occupancy without trashed and unassigned groups: an anti-join on the trash list."""
    li = table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("prd"), F.col("l_linestatus").alias("psi"), F.col("l_extendedprice").alias("v"))
    trash = spark.range(1).select(F.lit("A").alias("prd"))
    kept = _unit(li.where("psi IS NOT NULL").join(trash, "prd", "left_anti"), "v")
    return kept.groupBy(seq.equal_bin(F.col("tau"), 50).alias("bin")).agg(F.count(F.lit(1)).alias("occupancy"))


@query("""WITH d AS (SELECT least(floor(a*20),19)::INT AS bx, least(floor(b*20),19)::INT AS by_ FROM (SELECT (l_extendedprice-min(l_extendedprice) OVER ())/(max(l_extendedprice) OVER ()-min(l_extendedprice) OVER ()) AS a, (l_quantity-min(l_quantity) OVER ())/(max(l_quantity) OVER ()-min(l_quantity) OVER ()) AS b FROM lineitem)),
h AS (SELECT x.i::INT AS bx, y.i::INT AS by_, count(d.bx) AS occupancy FROM range(20) x(i) CROSS JOIN range(20) y(i) LEFT JOIN d ON d.bx=x.i AND d.by_=y.i GROUP BY ALL)
SELECT bx, by_, occupancy, round(-0.5925*ln(greatest(occupancy,1))-min(-0.5925*ln(greatest(occupancy,1))) OVER (), 6) + 0.0 AS energy FROM h""")
def energy_2d(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem").select("l_extendedprice", "l_quantity")
    e = li.agg(*(f(c).alias(f"{n}_{c}") for c in li.columns for n, f in (("lo", F.min), ("hi", F.max))))
    unit = lambda c: (F.col(c) - F.col(f"lo_{c}")) / (F.col(f"hi_{c}") - F.col(f"lo_{c}"))
    c = li.crossJoin(F.broadcast(e)).groupBy(seq.equal_bin(unit("l_extendedprice"), 20).alias("bx"), seq.equal_bin(unit("l_quantity"), 20).alias("by_")).agg(F.count(F.lit(1)).alias("n"))  # e: one row
    axis = spark.range(20).select(F.col("id").cast("int").alias("bx"))
    grid = axis.crossJoin(F.broadcast(axis.withColumnRenamed("bx", "by_")))
    h = grid.join(c, ["bx", "by_"], "left").select("bx", "by_", F.coalesce("n", F.lit(0)).cast("long").alias("occupancy"))
    v = F.lit(-0.5925) * F.log(F.greatest(F.col("occupancy"), F.lit(1)).cast("double"))
    return h.crossJoin(F.broadcast(h.agg(F.min(v).alias("low")))).select("bx", "by_", "occupancy", r6(v - F.col("low")).alias("energy"))


@query(f"WITH {TAU} SELECT event_id, b::INT AS bin FROM (SELECT event_id, unnest(generate_series(greatest(least(floor(tau*50),49)::INT-2, 0), least(least(floor(tau*50),49)::INT, 47))) AS b FROM ev)")
def sliding_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tau_events(spark, sf_dir).select("event_id", F.explode(seq.overlapping_bins(F.col("tau"), 50, 3)).alias("bin"))


@query(f"WITH {TAU}, r AS (SELECT event_id, prd, tau, row_number() OVER (PARTITION BY prd ORDER BY ts, event_id) AS rn, count(*) OVER (PARTITION BY prd) AS n FROM ev) SELECT event_id, prd, rn::INT AS rn FROM r WHERE rn > 11 AND rn <= n - 12")
def trim_sequence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return seq.trimmed(seq.ranked(tau_events(spark, sf_dir), "prd", ["ts", "event_id"]), "prd", 12).select("event_id", "prd", "rn")


@query(f"WITH {TAU}, r AS (SELECT prd, event_id, tau, row_number() OVER (PARTITION BY prd ORDER BY ts, event_id) AS rn FROM ev) SELECT prd, least(floor(tau*50),49)::INT AS cls, arg_min(event_id, rn) AS first_event FROM r GROUP BY 1, 2")
def class_representatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = seq.ranked(tau_events(spark, sf_dir), "prd", ["ts", "event_id"])
    return r.groupBy("prd", seq.equal_bin(F.col("tau"), 50).alias("cls")).agg(F.min_by("event_id", "rn").alias("first_event"))


@query(f"WITH {TAU}, w AS (SELECT prd, user_id, value, avg(value) OVER v AS m, stddev_pop(value) OVER v AS s, event_id FROM ev WINDOW v AS (PARTITION BY prd, user_id)) SELECT event_id, round((value-m)/s, 6) + 0.0 AS z FROM w WHERE s > 0")
def frame_z_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("prd", "user_id")
    t = tau_events(spark, sf_dir).withColumn("m", F.avg("value").over(w)).withColumn("s", F.stddev_pop("value").over(w)).where("s > 0")
    return t.select("event_id", r6((F.col("value") - F.col("m")) / F.col("s")).alias("z"))


_CDF = TAU + """, s0 AS (SELECT prd, round(value, 1) AS v, count(*) AS n FROM ev GROUP BY 1, 2), cdf AS (SELECT prd, v, sum(n) OVER (PARTITION BY prd ORDER BY v)/sum(n) OVER (PARTITION BY prd)::DOUBLE AS q FROM s0)"""


def _rounded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tau_events(spark, sf_dir).withColumn("v", F.round("value", 1))


@query(f"WITH {_CDF} SELECT prd, v, round(q, 6) AS q FROM cdf")
def empirical_cdf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return seq.ecdf(_rounded(spark, sf_dir), "v", ["prd"]).withColumn("q", F.round("q", 6))


@query(f"""WITH {_CDF}, s AS (SELECT * FROM cdf WHERE prd = (SELECT min(prd) FROM ev)), t AS (SELECT * FROM cdf WHERE prd = (SELECT max(prd) FROM ev)),
b AS (SELECT s.v, s.q, (SELECT max(q) FROM t WHERE t.q <= s.q) AS ql, (SELECT min(q) FROM t WHERE t.q >= s.q) AS qh FROM s),
c AS (SELECT b.*, l.v AS vl, h.v AS vh FROM b LEFT JOIN t l ON l.q = b.ql LEFT JOIN t h ON h.q = b.qh)
SELECT v AS value, round(CASE WHEN ql IS NULL THEN vh WHEN qh IS NULL OR qh = ql THEN vl ELSE vl+(vh-vl)*(q-ql)/(qh-ql) END, 5) + 0.0 AS matched FROM c""")
def histogram_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = seq.ecdf(_rounded(spark, sf_dir), "v", ["prd"]).withColumnRenamed("v", "value")
    ends = c.agg(F.min("prd").alias("a"), F.max("prd").alias("z"))
    c = c.crossJoin(F.broadcast(ends))  # one row
    m = seq.match_histograms(c.where("prd = a").select("value", "q"), c.where("prd = z").select("value", "q"))
    return m.select("value", r6(F.col("matched"), 5).alias("matched"))


@query(f"WITH {TAU}, k AS (SELECT prd, user_id, value, (value-min(value) OVER w)/nullif(max(value) OVER w-min(value) OVER w, 0) AS t FROM ev WINDOW w AS (PARTITION BY prd, user_id)), s AS (SELECT prd, user_id, quantile_cont(value, 0.75)-quantile_cont(value, 0.25) AS iqr, count(DISTINCT least(floor(coalesce(t, 0.5)*50),49))/50.0 AS occ FROM k GROUP BY 1, 2) SELECT prd, user_id, round(iqr, 6) AS iqr, round(occ, 6)::DOUBLE AS occ, iqr < 0.02 OR occ <= 0.35 AS bad FROM s")
def tau_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = thr.tau_quality(tau_events(spark, sf_dir).drop("tau"), "value", ["prd", "user_id"])
    return q.select("prd", "user_id", F.round("iqr", 6).alias("iqr"), F.round("occ", 6).alias("occ"), "bad")


@query(f"""WITH {TAU}, u AS (SELECT prd, user_id, quantile_cont(value, 0.75)-quantile_cont(value, 0.25) AS iqr FROM ev GROUP BY 1, 2), c AS (SELECT prd, median(iqr) AS cutoff FROM u WHERE NOT isnan(iqr) GROUP BY 1), f AS (SELECT user_id, count(*) AS n, count(*) FILTER (WHERE iqr < cutoff) AS bad FROM u JOIN c USING (prd) GROUP BY 1)
SELECT user_id, n, bad, n = bad AS trash FROM f""")
def bad_coordinates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Coordinates below their type's median spread; users with none left are trash."""
    q = thr.group_quantiles(tau_events(spark, sf_dir), "value", ["prd", "user_id"], {"q1": 0.25, "q3": 0.75})
    u = q.select("prd", "user_id", (F.col("q3") - F.col("q1")).alias("iqr"))
    c = thr.group_quantiles(u.where(~F.isnan("iqr")), "iqr", ["prd"], {"cutoff": 0.5}).select("prd", "cutoff")
    f = u.join(c, "prd").groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("iqr") < F.col("cutoff")).alias("bad"))
    return f.withColumn("trash", F.col("n") == F.col("bad"))


@query(f"""WITH {TAU}, c AS (SELECT prd, least(floor(tau*50),49)::INT AS bin, count(*)::DOUBLE AS n FROM ev GROUP BY 1, 2), r AS (SELECT prd, bin, sum(n) OVER w AS w0, sum(n*bin) OVER w AS m0, sum(n) OVER p AS w, sum(n*bin) OVER p AS m FROM c WINDOW w AS (PARTITION BY prd ORDER BY bin), p AS (PARTITION BY prd)),
v AS (SELECT prd, bin, round(CASE WHEN w0 > 0 AND w-w0 > 0 THEN w0*(w-w0)*pow(m0/w0-(m-m0)/(w-w0), 2) ELSE -1 END, 6) AS v FROM r)
SELECT prd, bin AS threshold FROM (SELECT *, row_number() OVER (PARTITION BY prd ORDER BY v DESC, bin) AS rn FROM v) WHERE rn = 1""")
def threshold_otsu(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = tau_events(spark, sf_dir).groupBy("prd", seq.equal_bin(F.col("tau"), 50).alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    return thr.otsu(c, ["prd"])


@query(f"""WITH {TAU}, d AS (SELECT prd, value AS v, count(*)::DOUBLE AS n FROM ev GROUP BY 1, 2), r AS (SELECT prd, v, sum(n) OVER w AS n0, sum(n*v) OVER w AS s0, sum(n) OVER p AS nn, sum(n*v) OVER p AS ss FROM d WINDOW w AS (PARTITION BY prd ORDER BY v), p AS (PARTITION BY prd)),
g AS (SELECT prd, v, round(s0*s0/n0+(ss-s0)*(ss-s0)/(nn-n0), 6) AS gain FROM r WHERE nn-n0 > 0) SELECT prd, v AS threshold FROM (SELECT *, row_number() OVER (PARTITION BY prd ORDER BY gain DESC, v) AS rn FROM g) WHERE rn = 1""")
def threshold_two_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    return thr.split_in_two(tau_events(spark, sf_dir), "value", ["prd"])


@query("""WITH q AS (SELECT quantile_cont(l_extendedprice, 0.25) AS q1, quantile_cont(l_extendedprice, 0.75) AS q3 FROM lineitem), c AS (SELECT l_orderkey, l_linenumber, least(l_extendedprice, q3+1.5*(q3-q1)) AS v FROM lineitem, q)
SELECT l_orderkey, l_linenumber, round(5+40*(v-min(v) OVER ())/(max(v) OVER ()-min(v) OVER ()), 6) AS scaled FROM c""")
def edge_rescale(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice")
    return thr.rescale(li, "l_extendedprice", 5.0, 45.0).select("l_orderkey", "l_linenumber", F.round("scaled", 6).alias("scaled"))


SMOOTH = "h0 AS (SELECT prd, b.bin::INT AS bin, coalesce(n, 0)::DOUBLE AS n FROM (SELECT DISTINCT prd FROM ev) p CROSS JOIN range(50) b(bin) LEFT JOIN (SELECT prd, least(floor(tau*50),49)::INT AS bin, count(*) AS n FROM ev GROUP BY 1, 2) c USING (prd, bin))"


def _dense(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = tau_events(spark, sf_dir)
    c = t.groupBy("prd", seq.equal_bin(F.col("tau"), 50).alias("bin")).agg(F.count(F.lit(1)).cast("double").alias("n"))
    bins = spark.range(50).select(F.col("id").cast("int").alias("bin"))
    return t.select("prd").distinct().crossJoin(F.broadcast(bins)).join(c, ["prd", "bin"], "left").fillna(0.0, ["n"])


@query(f"WITH {TAU}, {SMOOTH}, s AS (SELECT prd, bin, (-2*lag(n,3) OVER w+3*lag(n,2) OVER w+6*lag(n) OVER w+7*n+6*lead(n) OVER w+3*lead(n,2) OVER w-2*lead(n,3) OVER w)/21 AS sg FROM h0 WINDOW w AS (PARTITION BY prd ORDER BY bin)), x AS (SELECT *, sg < lag(sg) OVER w AND sg < lead(sg) OVER w AS valley, sg > lag(sg) OVER w AND sg > lead(sg) OVER w AS peak FROM s WHERE sg IS NOT NULL WINDOW w AS (PARTITION BY prd ORDER BY bin)) SELECT prd, bin, round(sg, 6) + 0.0 AS sg, coalesce(valley, false) AS valley, coalesce(peak, false) AS peak FROM x")
def smooth_valleys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Savitzky-Golay (7, 2) smoothing of each histogram, with its local extrema."""
    w = Window.partitionBy("prd").orderBy("bin")
    n = lambda k: F.lag("n", k).over(w) if k > 0 else F.lead("n", -k).over(w) if k else F.col("n")
    sg = sum((F.lit(float(c)) * n(k) for c, k in zip((3, 6, 7, 6, 3, -2), (2, 1, 0, -1, -2, -3), strict=True)), F.lit(-2.0) * n(3)) / 21
    s = _dense(spark, sf_dir).withColumn("sg", sg).where("sg IS NOT NULL")
    lo, hi = F.lag("sg").over(w), F.lead("sg").over(w)
    return s.select("prd", "bin", r6(F.col("sg")).alias("sg"), F.coalesce((F.col("sg") < lo) & (F.col("sg") < hi), F.lit(False)).alias("valley"), F.coalesce((F.col("sg") > lo) & (F.col("sg") > hi), F.lit(False)).alias("peak"))


@query(f"WITH {TAU}, {SMOOTH}, e AS (SELECT prd, bin, n, avg(n) OVER (PARTITION BY prd ORDER BY bin ROWS BETWEEN 2 PRECEDING AND 1 FOLLOWING) AS a FROM h0) SELECT prd, bin, round(a, 6) AS a FROM e")
def moving_average(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("prd").orderBy("bin").rowsBetween(-2, 1)
    return _dense(spark, sf_dir).select("prd", "bin", F.round(F.avg("n").over(w), 6).alias("a"))


@query(f"WITH {TAU}, b AS (SELECT k::INT AS block, k*0.2::DOUBLE AS lo, k*0.2::DOUBLE+0.3 AS hi FROM range(5) t(k)) SELECT prd, block, count(*) AS n, round(avg(value), 6) AS mean FROM ev JOIN b ON tau >= lo AND tau < hi GROUP BY 1, 2")
def overlapping_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = spark.range(5).select(F.col("id").cast("int").alias("block"), (F.col("id") * 0.2).alias("lo"), (F.col("id") * 0.2 + 0.3).alias("hi"))
    return tau_events(spark, sf_dir).join(F.broadcast(b), (F.col("tau") >= F.col("lo")) & (F.col("tau") < F.col("hi"))).groupBy("prd", "block").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("value"), 6).alias("mean"))  # 5 blocks


POLYGON = ((0.2, 10.0), (0.9, 25.0), (0.7, 80.0), (0.3, 95.0), (0.05, 50.0))
_EDGES = ", ".join(f"({a[0]}, {a[1]}, {b[0]}, {b[1]})" for a, b in zip(POLYGON, (*POLYGON[1:], POLYGON[0]), strict=True))


@query(f"WITH {TAU}, e(x1, y1, x2, y2) AS (VALUES {_EDGES}) SELECT event_id, count(*) FILTER (WHERE (y1 > value) <> (y2 > value) AND tau < (x2-x1)*(value-y1)/(y2-y1)+x1) % 2 = 1 AS inside FROM ev, e GROUP BY event_id")
def lasso(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Even-odd rule; the polygon's edges are literals in one expression, so no row is multiplied."""
    crossings = F.lit(0)
    x, y = F.col("tau"), F.col("value")
    for (x1, y1), (x2, y2) in zip(POLYGON, (*POLYGON[1:], POLYGON[0]), strict=True):
        crosses = ((F.lit(y1) > y) != (F.lit(y2) > y)) & (x < (x2 - x1) * (y - y1) / (y2 - y1) + x1)
        crossings = crossings + crosses.cast("int")
    return tau_events(spark, sf_dir).select("event_id", (crossings % 2 == 1).alias("inside"))


@query(f"WITH {CENTRES}, o AS (SELECT c.bin, any_value(x) AS x, any_value(y) AS y, any_value(z) AS z, count(m.img_id) AS n FROM centres c LEFT JOIN member m USING (bin) GROUP BY c.bin), k AS (SELECT a.bin, sum(b.n*exp(-0.5*((a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y)+(a.z-b.z)*(a.z-b.z))/(0.5*0.5))) AS d FROM o a, o b GROUP BY 1) SELECT bin, round(d/max(d) OVER (), 6) AS density FROM k")
def point_density(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Relative Gaussian density, at every bin's direction, of all snapshots at theirs: pairs of bins, weighted by members."""
    bins = tess.centres(spark, K)
    o = tess.occupancy(_members(spark, sf_dir), bins).join(bins, "bin")
    q = o.select(F.col("n").alias("n2"), *(F.col(c).alias(f"{c}2") for c in "xyz"))
    d2 = sum(((F.col(c) - F.col(f"{c}2")) * (F.col(c) - F.col(f"{c}2")) for c in "xyz"), F.lit(0.0))
    k = o.crossJoin(F.broadcast(q)).groupBy("bin").agg(F.sum(F.col("n2") * F.exp(-0.5 * d2 / (0.5 * 0.5))).alias("d"))  # K rows
    return k.crossJoin(F.broadcast(k.agg(F.max("d").alias("m")))).select("bin", F.round(F.col("d") / F.col("m"), 6).alias("density"))


_LINE = "s AS (SELECT s_suppkey AS id, s_suppkey*7 % 20 AS x0, s_suppkey*11 % 20 AS y0, s_suppkey*13 % 20 AS x1, s_suppkey*17 % 20 AS y1 FROM supplier), n AS (SELECT *, greatest(abs(x1-x0), abs(y1-y0)) AS n FROM s), ln AS (SELECT id, n, unnest(generate_series(0, n)) AS k, x0, y0, x1, y1 FROM n), pts AS (SELECT id, k, n, CASE WHEN n = 0 THEN x0 ELSE x0 + CASE WHEN x1 >= x0 THEN 1 ELSE -1 END * ((2*abs(x1-x0)*k + n) // (2*n)) END AS x, CASE WHEN n = 0 THEN y0 ELSE y0 + CASE WHEN y1 >= y0 THEN 1 ELSE -1 END * ((2*abs(y1-y0)*k + n) // (2*n)) END AS y FROM ln)"


def grid_lines(rows: DataFrame) -> DataFrame:
    """id, k, n, x, y: the grid points of the integer line from (x0, y0) to (x1, y1), one per step of the longer axis."""
    dx, dy = F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")
    n = F.greatest(F.abs(dx), F.abs(dy))
    k = rows.select("id", "x0", "y0", dx.alias("dx"), dy.alias("dy"), n.alias("n"), F.explode(F.sequence(F.lit(0).cast("long"), n)).alias("k"))
    step = lambda d: F.when(F.col("n") == 0, F.lit(0)).otherwise(F.when(F.col(d) >= 0, 1).otherwise(-1) * F.floor((2 * F.abs(F.col(d)) * F.col("k") + F.col("n")) / F.greatest(2 * F.col("n"), F.lit(1))))
    return k.select("id", "k", "n", (F.col("x0") + step("dx")).cast("long").alias("x"), (F.col("y0") + step("dy")).cast("long").alias("y"))


def _segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("s_suppkey")
    return table(spark, sf_dir, "supplier").select(k.alias("id"), (k * 7 % 20).alias("x0"), (k * 11 % 20).alias("y0"), (k * 13 % 20).alias("x1"), (k * 17 % 20).alias("y1"))


@query(f"WITH {_LINE} SELECT id, k, x, y FROM pts")
def line_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grid_lines(_segments(spark, sf_dir)).select("id", "k", "x", "y")


@query(ORACLE_SQL["energy_2d"].replace("SELECT bx, by_, occupancy, round(", "SELECT bx, by_, (").replace(", 6) + 0.0 AS energy FROM h", ") AS energy FROM h").replace("WITH d AS", f"WITH {_LINE}, d AS").replace("SELECT bx, by_, (", ", g AS (SELECT bx, by_, (") + ") SELECT id, count(*) AS points, round(sum(energy), 5) + 0.0 AS path_energy FROM pts JOIN g ON g.bx=x AND g.by_=y WHERE k > 0 GROUP BY id")
def path_energy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Energy along each segment; its first point belongs to the segment before."""
    g = energy_2d(spark, sf_dir).select(F.col("bx").cast("long").alias("x"), F.col("by_").cast("long").alias("y"), "energy")
    return grid_lines(_segments(spark, sf_dir)).where("k > 0").join(g, ["x", "y"]).groupBy("id").agg(F.count(F.lit(1)).alias("points"), r6(F.sum("energy"), 4).alias("path_energy"))


ORACLE_SQL["path_energy"] = ORACLE_SQL["path_energy"].replace("round(sum(energy), 5)", "round(sum(round(energy, 6)), 4)")


@query(f"WITH {TAU}, c AS (SELECT prd, corr(value, epoch(ts)::DOUBLE) * count(*) AS c FROM ev GROUP BY 1) SELECT event_id, round(CASE WHEN c < 0 THEN 1-tau ELSE tau END, 6) + 0.0 AS tau FROM ev JOIN c USING (prd)")
def sense_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """tau turned round where the coordinate and the frame order disagree."""
    t = tau_events(spark, sf_dir)
    c = t.groupBy("prd").agg((F.corr("value", F.col("ts").cast("timestamp").cast("double")) * F.count(F.lit(1))).alias("c"))
    return t.join(F.broadcast(c), "prd").select("event_id", r6(F.when(F.col("c") < 0, 1 - F.col("tau")).otherwise(F.col("tau"))).alias("tau"))  # a row per group


@query("SELECT event_id, printf('prD_%d_psi_%d', user_id, event_id % 8) AS key, split_part(printf('prD_%d_psi_%d', user_id, event_id % 8), '_', 2)::BIGINT AS prd, printf('%.4f', value) AS fixed, strftime(ts, '%Y-%m-%d %H:%M:%S') AS stamp, contains(event_type, 'i') AS has_i, starts_with(event_type, 'c') AS is_c, upper(trim(event_type)) AS name FROM events")
def key_formats(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    key = F.format_string("prD_%d_psi_%d", F.col("user_id"), F.col("event_id") % 8)
    return e.select("event_id", key.alias("key"), F.split_part(key, F.lit("_"), F.lit(2)).cast("long").alias("prd"), F.format_string("%.4f", "value").alias("fixed"), F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("stamp"), F.col("event_type").contains("i").alias("has_i"), F.col("event_type").startswith("c").alias("is_c"), F.upper(F.trim("event_type")).alias("name"))


@query("SELECT event_id, value FROM events WHERE event_id % 10 = 0")
def stride_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every tenth row, as for a display."""
    return table(spark, sf_dir, "events").where("event_id % 10 = 0").select("event_id", "value")
