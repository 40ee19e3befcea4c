"""Queries over orientations: quaternions, directions, optics, tessellation."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sphaera.functions import geometry as g
from sphaera.operators import tessellation as tess
from sphaera.plans.base import CENTRES, K, SNAP, TWINS, quaternion, r6, snapshots, table

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(oracle: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLE_SQL[f.__name__] = oracle
        return f

    return keep


PMOD = "((({0}) % 6.283185307179586) + 6.283185307179586) % 6.283185307179586 * 57.29577951308232"
R = "round({0}, 6) + 0.0"


def _angles(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = snapshots(spark, sf_dir)
    deg = [F.lit(180.0) * F.element_at("px", 1), F.lit(90.0) * (1 + F.element_at("px", 2)), F.lit(180.0) * F.element_at("px", 3)]
    return s.select("img_id", *(F.radians(a).alias(n) for a, n in zip(deg, ("phi", "theta", "psi"), strict=True)))


ANGLES = SNAP + ", ang AS (SELECT img_id, radians(180.0::DOUBLE*px[1]) AS phi, radians(90.0::DOUBLE*(1+px[2])) AS theta, radians(180.0::DOUBLE*px[3]) AS psi FROM snap)"


@query(f"""WITH {ANGLES}, h AS (SELECT img_id, cos(phi/2) AS a0, -sin(phi/2) AS a3, cos(theta/2) AS b0, -sin(theta/2) AS b2, cos(psi/2) AS c0, -sin(psi/2) AS c3 FROM ang),
yz AS (SELECT *, b0*a0 AS m0, b2*a3 AS m1, b2*a0 AS m2, b0*a3 AS m3 FROM h)
SELECT img_id, {R.format('c0*m0-c3*m3')} AS q0, {R.format('c0*m1-c3*m2')} AS q1, {R.format('c0*m2+c3*m1')} AS q2, {R.format('c0*m3+c3*m0')} AS q3 FROM yz""")
def geo_euler_quaternion(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = _angles(spark, sf_dir)
    q = g.euler_to_quaternion(F.col("phi"), F.col("theta"), F.col("psi"))
    return a.select("img_id", *(r6(c).alias(f"q{k}") for k, c in enumerate(q)))


@query(f"WITH {TWINS} SELECT img_id, conj, {R.format('q0')} AS q0, {R.format('q1')} AS q1, {R.format('q2')} AS q2, {R.format('q3')} AS q3 FROM twin")
def geo_conjugates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _twins(spark, sf_dir).select("img_id", "conj", *(r6(F.col(f"q{k}")).alias(f"q{k}") for k in range(4)))


def _twins(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = snapshots(spark, sf_dir).drop("px")
    return g.with_conjugates(s, table(spark, sf_dir, "embeddings").count())


def _directions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _twins(spark, sf_dir).withColumns(dict(zip(("sx", "sy", "sz"), g.direction(quaternion()), strict=True)))


@query(f"WITH {TWINS} SELECT img_id, {R.format('sx')} AS sx, {R.format('sy')} AS sy, {R.format('sz')} AS sz, {R.format('df')} AS df FROM dirs")
def geo_directions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _directions(spark, sf_dir).select("img_id", *(r6(F.col(c)).alias(c) for c in ("sx", "sy", "sz", "df")))


_DQ = "dq AS (SELECT *, sqrt((1+sz)*(1+sz)+sy*sy+sx*sx) AS w FROM dirs), de AS (SELECT img_id, (1+sz)/w AS a, sy/w AS b, -sx/w AS c FROM dq), eu AS (SELECT img_id, atan2(-0.0::DOUBLE, a)+atan2(b, -c) AS phi, 2*atan2(sqrt(b*b+c*c), sqrt(a*a)) AS theta FROM de)"


@query(f"WITH {TWINS}, {_DQ} SELECT img_id, round({PMOD.format('phi')}, 6) + 0.0 AS phi, round({PMOD.format('theta')}, 6) + 0.0 AS theta FROM eu")
def geo_direction_euler(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _directions(spark, sf_dir)
    phi, theta, _ = g.direction_to_euler((F.col("sx"), F.col("sy"), F.col("sz")))
    return d.select("img_id", r6(g.wrap_degrees(phi)).alias("phi"), r6(g.wrap_degrees(theta)).alias("theta"))


@query(f"WITH {SNAP} SELECT img_id, {R.format('atan2(-q3,q0)+atan2(q1,-q2)')} AS phi, {R.format('2*atan2(sqrt(q1*q1+q2*q2), sqrt(q0*q0+q3*q3))')} AS theta, {R.format('atan2(-q3,q0)-atan2(q1,-q2)')} AS psi FROM snap")
def geo_quaternion_euler(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = snapshots(spark, sf_dir)
    return s.select("img_id", *(r6(c).alias(n) for n, c in zip(("phi", "theta", "psi"), g.quaternion_to_euler(quaternion()), strict=True)))


_MEAN = "mean0 AS (SELECT prd, sum(sx) AS ax, sum(sy) AS ay, sum(sz) AS az FROM dirs WHERE NOT conj GROUP BY prd), mean AS (SELECT prd, ax/sqrt(ax*ax+ay*ay+az*az) AS mx, ay/sqrt(ax*ax+ay*ay+az*az) AS my, az/sqrt(ax*ax+ay*ay+az*az) AS mz FROM mean0)"


def _means(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tess.mean_directions(_directions(spark, sf_dir).where("NOT conj"), "prd")


@query(f"WITH {TWINS}, {_MEAN} SELECT prd, {R.format('mx')} AS mx, {R.format('my')} AS my, {R.format('mz')} AS mz FROM mean")
def agg_mean_direction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _means(spark, sf_dir).select("prd", *(r6(F.col(c)).alias(c) for c in ("mx", "my", "mz")))


@query(f"""WITH {TWINS}, {_MEAN}, w AS (SELECT prd, (1+mz)/sqrt((1+mz)*(1+mz)+my*my+mx*mx) AS a, my/sqrt((1+mz)*(1+mz)+my*my+mx*mx) AS b, -mx/sqrt((1+mz)*(1+mz)+my*my+mx*mx) AS c FROM mean)
SELECT prd, round({PMOD.format('atan2(-0.0::DOUBLE,a)-atan2(b,-c)')}, 6) + 0.0 AS psi FROM w""")
def geo_mean_in_plane(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, _, psi = g.direction_to_euler((F.col("mx"), F.col("my"), F.col("mz")))
    return _means(spark, sf_dir).select("prd", r6(g.wrap_degrees(psi)).alias("psi"))


@query(f"""WITH {TWINS}, {_MEAN}, sc AS (SELECT img_id, -(1+mz)*q3-mx*q1-my*q2 AS s, (1+mz)*q0+my*q1-mx*q2 AS c FROM dirs JOIN mean USING (prd) WHERE NOT conj)
SELECT img_id, {R.format('2*atan(s/c)')} AS psi FROM sc""")
def geo_in_plane(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = snapshots(spark, sf_dir).drop("px").join(F.broadcast(_means(spark, sf_dir)), "prd")  # one row per direction
    return d.select("img_id", r6(g.in_plane(quaternion(), (F.col("mx"), F.col("my"), F.col("mz")))).alias("psi"))


@query(f"""WITH {TWINS}, sp AS (SELECT img_id, sqrt(sx*sx+sy*sy+sz*sz) AS r, degrees(atan2(sy,sx)) AS phi, degrees(acos(sz/sqrt(sx*sx+sy*sy+sz*sz))) AS theta FROM dirs)
SELECT img_id, {R.format('r')} AS r, {R.format('phi')} AS phi, {R.format('theta')} AS theta, {R.format('10.0::DOUBLE*sin(radians(theta))*cos(radians(phi))')} AS x, {R.format('10.0::DOUBLE*sin(radians(theta))*sin(radians(phi))')} AS y, {R.format('10.0::DOUBLE*cos(radians(theta))')} AS z FROM sp""")
def geo_spherical(spark: SparkSession, sf_dir: str) -> DataFrame:
    r, phi, theta = g.to_spherical((F.col("sx"), F.col("sy"), F.col("sz")))
    d = _directions(spark, sf_dir).select("img_id", r.alias("r"), phi.alias("phi"), theta.alias("theta"))
    return d.select("img_id", *(r6(F.col(c)).alias(c) for c in ("r", "phi", "theta")), *(r6(c).alias(n) for n, c in zip("xyz", g.from_spherical(F.col("phi"), F.col("theta")), strict=True)))


_ROT = ["cos(psi)*cos(theta)*cos(phi)-sin(psi)*sin(phi)", "cos(psi)*cos(theta)*sin(phi)+sin(psi)*cos(phi)", "-cos(psi)*sin(theta)", "-sin(psi)*cos(theta)*cos(phi)-cos(psi)*sin(phi)", "-sin(psi)*cos(theta)*sin(phi)+cos(psi)*cos(phi)", "sin(psi)*sin(theta)", "sin(theta)*cos(phi)", "sin(theta)*sin(phi)", "cos(theta)"]


@query(f"WITH {ANGLES} SELECT img_id, " + ", ".join(f"{R.format(x)} AS m{k}" for k, x in enumerate(_ROT)) + " FROM ang")
def geo_rotation_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = g.rotation_matrix(F.col("phi"), F.col("theta"), F.col("psi"))
    return _angles(spark, sf_dir).select("img_id", *(r6(c).alias(f"m{k}") for k, c in enumerate(m)))


_W = g.wavelength(300.0)


@query(f"""WITH {SNAP}, d AS (SELECT DISTINCT df FROM snap), k AS (SELECT k, k*0.02::DOUBLE AS s FROM range(1, 11) t(k)),
p AS (SELECT df, k, s*s AS k2, (0.5*pi()*2.7*1e7*{_W!r}*{_W!r}*{_W!r}*s*s-pi()*{_W!r}*df)*s*s AS gam FROM d, k)
SELECT df, k, round((sin(gam)-0.1*cos(gam))*exp(-k2/(2*pow(0.5/sqrt(2*ln(2.0)), 2))), 5) + 0.0 AS ctf FROM p""")
def geo_ctf(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = snapshots(spark, sf_dir).select("df").distinct()
    k = spark.range(1, 11).select(F.col("id").alias("k"), (F.col("id") * 0.02).alias("s"))
    return d.crossJoin(F.broadcast(k)).select("df", "k", r6(g.contrast_transfer(F.col("s"), F.col("df"), 2.7, 300.0, 0.5, 0.1), 5).alias("ctf"))


@query(f"""WITH {SNAP}, c AS (SELECT prd, j//8-4 AS y, j%8-4 AS x, avg(px[j+1]) AS mean FROM snap, range(64) t(j) GROUP BY ALL), g AS (SELECT *, (2.0/8)*sqrt((x*x+y*y)::DOUBLE) AS q FROM c),
w AS (SELECT *, exp(-(ln(2.0)/2)*pow(q/0.5, 2)) AS ga, sqrt(1/(1+pow(q/0.5, 16))) AS bu FROM g)
SELECT prd, y, x, {R.format('q')} AS q, {R.format('ga')} AS gauss, {R.format('bu')} AS butter, {R.format('ga*mean')} AS by_gauss, {R.format('bu*mean')} AS by_butter FROM w""")
def geo_frequency_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Low-pass weights of every cell of the groups' images, and their mean weighted so; the grid has the images' size."""
    j = F.col("j")
    cells = snapshots(spark, sf_dir).select("prd", F.posexplode("px").alias("j", "v")).groupBy("prd", "j").agg(F.avg("v").alias("mean"))
    c = cells.select("prd", (F.floor(j / 8) - 4).alias("y"), (j % 8 - 4).cast("long").alias("x"), "mean")
    q = g.frequency(F.col("x"), F.col("y"), 8)
    ga, bu = g.transfer(q, "Gauss", 0.5), g.transfer(q, "Butter", 0.5)
    return c.select("prd", "y", "x", r6(q).alias("q"), r6(ga).alias("gauss"), r6(bu).alias("butter"), r6(ga * F.col("mean")).alias("by_gauss"), r6(bu * F.col("mean")).alias("by_butter"))


@query("""WITH w AS (SELECT s_suppkey AS id, 1+(s_suppkey % 5) AS aperture, 3.0+(s_suppkey % 7) AS res, 100.0+(s_suppkey % 150) AS diam FROM supplier), a AS (SELECT id, res/diam AS shannon, least(aperture*res/diam, sqrt(4*pi())) AS width FROM w)
SELECT id, round(shannon, 6) AS shannon, round(width, 6) AS width, floor(4*pi()/(width*width))::BIGINT AS bins FROM a""")
def geo_bin_width(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("s_suppkey")
    w = table(spark, sf_dir, "supplier").select(k.alias("id"), (1 + k % 5).alias("aperture"), (3.0 + k % 7).alias("res"), (100.0 + k % 150).alias("diam"))
    w = w.withColumn("shannon", F.col("res") / F.col("diam")).withColumn("width", F.least(F.col("aperture") * F.col("shannon"), F.lit(math.sqrt(4 * math.pi))))
    return w.select("id", F.round("shannon", 6).alias("shannon"), F.round("width", 6).alias("width"), F.floor(F.lit(4 * math.pi) / (F.col("width") * F.col("width"))).alias("bins"))


def _members(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tess.assign(_directions(spark, sf_dir), tess.centres(spark, K), K)


@query(f"WITH {CENTRES} SELECT img_id, bin FROM member")
def tess_assign(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _members(spark, sf_dir)


@query(f"WITH {CENTRES} SELECT c.bin, count(m.img_id) AS n FROM centres c LEFT JOIN member m USING (bin) GROUP BY c.bin")
def tess_occupancy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tess.occupancy(_members(spark, sf_dir), tess.centres(spark, K))


@query(f"WITH {CENTRES} SELECT bin, array_to_string(list_sort(list(img_id)), ',') AS members FROM member GROUP BY bin")
def tess_member_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tess.member_lists(_members(spark, sf_dir)).select("bin", F.array_join("members", ",").alias("members"))


_OCC = "occ AS (SELECT c.bin, count(m.img_id) AS n FROM centres c LEFT JOIN member m USING (bin) GROUP BY c.bin)"


@query(f"WITH {CENTRES}, {_OCC} SELECT bin, n, (row_number() OVER (ORDER BY bin) - 1)::INT AS prd FROM occ WHERE bin < 12 AND n >= 20")
def tess_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tess.threshold_bins(tess.occupancy(_members(spark, sf_dir), tess.centres(spark, K)), K, 20)


@query(f"WITH {CENTRES} SELECT img_id, bin, rn::INT AS rank FROM (SELECT *, row_number() OVER (PARTITION BY bin ORDER BY img_id) - 1 AS rn FROM member) WHERE rn < 30")
def tess_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tess.cap_members(_members(spark, sf_dir), 30)


@query(f"""WITH {CENTRES}, b AS (SELECT bin, img_id % (SELECT n FROM nn) AS base FROM member), p AS (SELECT x.bin, y.bin AS partner, count(*) AS shared FROM b x JOIN b y USING (base) WHERE x.bin <> y.bin GROUP BY ALL)
SELECT bin, partner, shared FROM (SELECT *, row_number() OVER (PARTITION BY bin ORDER BY shared DESC, partner) AS rn FROM p) WHERE rn = 1""")
def tess_partner_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tess.best_partner_bins(_members(spark, sf_dir), table(spark, sf_dir, "embeddings").count())


@query(f"""WITH {CENTRES}, cam AS (SELECT v.*, sin(radians(theta))*cos(radians(phi)) AS vx, sin(radians(theta))*sin(radians(phi)) AS vy, cos(radians(theta)) AS vz FROM (SELECT s_suppkey AS cam, (s_suppkey*37 % 360)::DOUBLE AS phi, (s_suppkey*13 % 180)::DOUBLE AS theta FROM supplier) v)
SELECT cam, arg_min(bin, (d, bin)) AS bin, round(sqrt(min(d)), 6) AS dist FROM (SELECT cam, bin, (x-vx)*(x-vx)+(y-vy)*(y-vy)+(z-vz)*(z-vz) AS d FROM cam, centres) GROUP BY cam""")
def tess_nearest_camera(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("s_suppkey")
    cam = table(spark, sf_dir, "supplier").select(k.alias("cam"), F.radians((k * 37 % 360).cast("double")).alias("p"), F.radians((k * 13 % 180).cast("double")).alias("t"))
    cam = cam.select("cam", (F.sin("t") * F.cos("p")).alias("sx"), (F.sin("t") * F.sin("p")).alias("sy"), F.cos("t").alias("sz"))
    bins = tess.centres(spark, K)
    near = tess.assign(cam, bins, K, "cam").join(cam, "cam").join(F.broadcast(bins), "bin")  # K rows
    d = sum(((F.col(a) - F.col(b)) * (F.col(a) - F.col(b)) for a, b in (("x", "sx"), ("y", "sy"), ("z", "sz"))), F.lit(0.0))
    return near.select("cam", "bin", F.round(F.sqrt(d), 6).alias("dist"))


@query(f"""WITH {CENTRES}, {_OCC}, o AS (SELECT row_number() OVER (ORDER BY bin) AS prd, bin FROM occ WHERE bin < 12 AND n >= 20)
SELECT prd, printf('%.2f', degrees(acos(z/sqrt(x*x+y*y+z*z)))) AS theta, printf('%.2f', degrees(atan2(y,x))) AS phi, printf('%.4f', x) AS x, printf('%.4f', y) AS y, printf('%.4f', z) AS z FROM o JOIN centres USING (bin)""")
def sink_direction_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    bins = tess.centres(spark, K)
    kept = tess.threshold_bins(tess.occupancy(_members(spark, sf_dir), bins), K, 20).join(F.broadcast(bins), "bin")  # K rows
    _, phi, theta = g.to_spherical((F.col("x"), F.col("y"), F.col("z")))
    text = lambda f, c: F.format_string(f, c)
    return kept.select((F.row_number().over(Window.orderBy("bin"))).cast("long").alias("prd"), text("%.2f", theta).alias("theta"), text("%.2f", phi).alias("phi"), *(text("%.4f", F.col(c)).alias(c) for c in "xyz"))


@query(f"""WITH {CENTRES}, {_OCC} SELECT bin, n, least(n, 30) AS used, n >= 20 AS inside, round((degrees(atan2(y,x))-180)*pi()/180, 6) + 0.0 AS angle, round(degrees(acos(z)), 6) + 0.0 AS radius FROM occ JOIN centres USING (bin) WHERE n >= 20""")
def ui_polar_occupancy(spark: SparkSession, sf_dir: str) -> DataFrame:
    bins = tess.centres(spark, K)
    o = tess.occupancy(_members(spark, sf_dir), bins).join(F.broadcast(bins), "bin").where("n >= 20")  # K rows
    angle = (F.degrees(F.atan2("y", "x")) - 180) * math.pi / 180
    return o.select("bin", "n", F.least("n", F.lit(30)).cast("long").alias("used"), (F.col("n") >= 20).alias("inside"), r6(angle).alias("angle"), r6(F.degrees(F.acos("z"))).alias("radius"))


@query(f"WITH {CENTRES}, {_OCC} SELECT count(*) FILTER (WHERE n >= 20) AS inside, count(*) FILTER (WHERE n < 20) AS outside, sum(CASE WHEN n >= 20 THEN least(n, 30) ELSE 0 END)::BIGINT AS snapshots FROM occ")
def ui_threshold_preview(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = tess.occupancy(_members(spark, sf_dir), tess.centres(spark, K))
    return o.agg(F.count_if(F.col("n") >= 20).alias("inside"), F.count_if(F.col("n") < 20).alias("outside"), F.sum(F.when(F.col("n") >= 20, F.least("n", F.lit(30))).otherwise(0)).cast("long").alias("snapshots"))


@query(f"WITH {CENTRES} SELECT bin, n FROM (SELECT bin, count(*) AS n FROM member GROUP BY bin) ORDER BY n DESC, bin")
def ui_occupancy_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _members(spark, sf_dir).groupBy("bin").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "bin")
