"""Queries over the graph of groups and its labelling."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sphaera.operators import graphs as gr
from sphaera.operators import messages as bp
from sphaera.operators.distances import squared_distance
from sphaera.operators.tessellation import mean_directions
from sphaera.plans.base import CENTRES, K, r6, snapshots, table
from sphaera.plans.orientation import _directions, _members

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(oracle: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLE_SQL[f.__name__] = oracle
        return f

    return keep


EPS = 0.9
#: The occupied bins with the mean direction of their members, and the edges of those at most EPS apart.
NODES = CENTRES + """, nsum AS (SELECT bin, sum(sx) AS x, sum(sy) AS y, sum(sz) AS z FROM member JOIN dirs USING (img_id) GROUP BY bin),
node AS (SELECT bin, x/sqrt(x*x+y*y+z*z) AS x, y/sqrt(x*x+y*y+z*z) AS y, z/sqrt(x*x+y*y+z*z) AS z FROM nsum)"""
EDGES = NODES + f", edge AS (SELECT a.bin AS src, b.bin AS dst, sqrt((a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y)+(a.z-b.z)*(a.z-b.z)) AS dist FROM node a JOIN node b ON a.bin < b.bin WHERE sqrt((a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y)+(a.z-b.z)*(a.z-b.z)) <= {EPS})"


def _nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """bin, x, y, z: the occupied bins, at the mean direction of their members."""
    met = _members(spark, sf_dir).join(_directions(spark, sf_dir), "img_id")
    return mean_directions(met, "bin").select("bin", F.col("mx").alias("x"), F.col("my").alias("y"), F.col("mz").alias("z"))


def _edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gr.neighbourhood(_nodes(spark, sf_dir), EPS)


@query(f"WITH {EDGES} SELECT src, dst, round(dist, 6) AS dist FROM edge")
def graph_epsilon(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _edges(spark, sf_dir).withColumn("dist", F.round("dist", 6))


@query(f"WITH {NODES}, d AS (SELECT a.bin AS i, b.bin AS j, a.x*b.x+a.y*b.y+a.z*b.z AS dot, (a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y)+(a.z-b.z)*(a.z-b.z) AS d2 FROM node a, node b) SELECT i, j, round(dot, 6) + 0.0 AS dot, round(sqrt(CASE WHEN d2 < 1e-6 THEN 0 ELSE d2 END), 6) + 0.0 AS dist FROM d")
def graph_all_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dot products and distances of all pairs of nodes: the answer itself has a row per pair of the K bins."""
    c = _nodes(spark, sf_dir)
    a, b = (c.select(F.col("bin").alias(n), *(F.col(x).alias(f"{n}{x}") for x in "xyz")) for n in "ij")
    dot = sum((F.col(f"i{x}") * F.col(f"j{x}") for x in "xyz"), F.lit(0.0))
    d2 = sum(((F.col(f"i{x}") - F.col(f"j{x}")) * (F.col(f"i{x}") - F.col(f"j{x}")) for x in "xyz"), F.lit(0.0))
    return a.crossJoin(F.broadcast(b)).select("i", "j", r6(dot).alias("dot"), r6(F.sqrt(F.when(d2 < 1e-6, 0.0).otherwise(d2))).alias("dist"))  # K nodes


@query(f"WITH {NODES}, m AS (SELECT min(sqrt((a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y)+(a.z-b.z)*(a.z-b.z))) AS m FROM node a JOIN node b ON a.bin < b.bin), k AS (SELECT count(*)::DOUBLE AS n FROM centres), o AS (SELECT count(*)::DOUBLE AS n FROM node) SELECT round(m, 6) AS least_distance, round(least(greatest(m+1e-10, m*k.n/o.n), 2*sqrt(2.0)*m+1e-10), 6) AS eps FROM m, k, o")
def graph_epsilon_rule(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The neighbourhood radius by the least distance and the share of the K bins that are occupied."""
    n = _nodes(spark, sf_dir)
    m = gr.neighbourhood(n, 2.0).agg(F.min("dist").alias("m")).crossJoin(n.agg(F.count(F.lit(1)).alias("n")))  # one row each
    return m.select(F.round("m", 6).alias("least_distance"), F.round(gr.epsilon_rule(F.col("m"), F.lit(K), F.col("n").cast("double")), 6).alias("eps"))


@query(f"WITH {EDGES}, n AS (SELECT row_number() OVER (ORDER BY src, dst) AS edge, src, dst FROM edge) SELECT edge, src, dst FROM n UNION ALL SELECT edge+(SELECT count(*) FROM n), dst, src FROM n")
def graph_directed_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gr.directed(_edges(spark, sf_dir).select("src", "dst")).select("edge", "src", "dst")


@query(f"WITH {EDGES}, n AS (SELECT src, dst FROM edge UNION ALL SELECT dst, src FROM edge) SELECT src AS node, count(*) AS degree, array_to_string(list_sort(list(dst)), ',') AS neighbours FROM n GROUP BY src")
def graph_incident(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = gr.directed(_edges(spark, sf_dir).select("src", "dst"))
    return d.groupBy(F.col("src").alias("node")).agg(F.count(F.lit(1)).alias("degree"), F.array_join(F.sort_array(F.collect_list("dst")), ",").alias("neighbours"))


#: Least labels spread along edges; a node's row is replaced when a lesser label reaches it.
_REACH = "RECURSIVE {0}, sym AS (SELECT src, dst FROM {1} UNION SELECT dst, src FROM {1}), nodes AS (SELECT DISTINCT src AS id FROM sym), reach(id, component) USING KEY (id) AS (SELECT id, id FROM nodes UNION SELECT s.dst, min(w.component) FROM reach w JOIN sym s ON s.src = w.id JOIN recurring.reach r ON r.id = s.dst WHERE w.component < r.component GROUP BY s.dst)"
_CC_BASE = "e AS (SELECT DISTINCT o_custkey AS src, 1000000 + l_suppkey AS dst FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"


def _bipartite(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Nodes and distinct edges, the edges written once; all is dealt out by the number of lines."""
    li, o = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey"), table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    n = gr.parts_of(spark, max(li.count(), o.count()))
    li, o = li.repartition(n, "l_orderkey"), o.repartition(n, "o_orderkey")
    e = li.join(o, li["l_orderkey"] == o["o_orderkey"]).select(F.col("o_custkey").alias("src"), (F.col("l_suppkey") + 1000000).alias("dst")).repartition(n, "src", "dst").distinct()
    e = gr.Rounds(e, "bipartite").keep(e, "edges")
    return e.select(F.col("src").alias("id")).union(e.select("dst")).distinct(), e


@query(f"WITH {_REACH.format(_CC_BASE, 'e')} SELECT id, component FROM reach")
def graph_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gr.components(*_bipartite(spark, sf_dir))


@query(f"WITH {_REACH.format(_CC_BASE, 'e')}, c AS (SELECT id, component FROM reach), anchored AS (SELECT DISTINCT component FROM c WHERE id % 97 = 3), s AS (SELECT component, count(*) AS n FROM c GROUP BY 1) SELECT s.component, n, a.component IS NOT NULL AS anchored FROM s LEFT JOIN anchored a USING (component)")
def graph_anchored_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components with their size, and whether one of their nodes is an anchor."""
    c = gr.components(*_bipartite(spark, sf_dir))
    return c.groupBy("component").agg(F.count(F.lit(1)).alias("n"), F.bool_or(F.col("id") % 97 == 3).alias("anchored"))


@query(f"WITH RECURSIVE {_CC_BASE}, sym AS (SELECT src, dst FROM e UNION SELECT dst, src FROM e), nodes AS (SELECT DISTINCT src AS id FROM sym), b(id, level) AS (SELECT id, 0 FROM nodes WHERE id % 97 = 3 UNION SELECT s.dst, b.level+1 FROM b JOIN sym s ON s.src=b.id WHERE b.level < 30), l AS (SELECT id, min(level) AS level FROM b GROUP BY id) SELECT n.id, l.level FROM nodes n LEFT JOIN l USING (id)")
def graph_search_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes, e = _bipartite(spark, sf_dir)
    return gr.search_levels(nodes, e, nodes.where("id % 97 = 3"))


#: A component of each occupied bin at a radius under which some lie alone.
_NEAR = EDGES.replace(f"<= {EPS})", "<= 0.55)")


@query(f"WITH {_REACH.format(_NEAR, 'edge')}, r AS (SELECT id, component FROM reach) SELECT bin AS id, coalesce(component, bin) AS component FROM node LEFT JOIN r ON r.id = node.bin")
def stage_graph_labels_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of the graph of occupied bins, nodes without an edge included."""
    n = _nodes(spark, sf_dir)
    return gr.components(n.select(F.col("bin").alias("id")), gr.neighbourhood(n, 0.55))


def _flag(flag: str) -> str:
    return f", flagged AS (SELECT bin FROM (SELECT bin, avg(px[1]) AS m FROM member JOIN snap ON snap.img_id = member.img_id % (SELECT n FROM nn) GROUP BY bin) WHERE {flag})"


def _flagged(spark: SparkSession, sf_dir: str, flag: str) -> DataFrame:
    """id: bins whose members' mean first pixel meets a condition on m."""
    m = _with_images(spark, sf_dir).groupBy("bin").agg(F.avg(F.element_at("px", 1)).alias("m"))
    return m.where(flag).select(F.col("bin").alias("id"))


@query(f"WITH {EDGES}{_flag('m < 0')} SELECT src, dst FROM edge WHERE src NOT IN (SELECT bin FROM flagged) AND dst NOT IN (SELECT bin FROM flagged)")
def graph_prune(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gr.prune(_edges(spark, sf_dir), _flagged(spark, sf_dir, "m < 0"))


@query(f"WITH {EDGES}{_flag('m > 0.01')} SELECT src, dst FROM edge WHERE src IN (SELECT bin FROM flagged) OR dst IN (SELECT bin FROM flagged)")
def graph_touching(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gr.touching(_edges(spark, sf_dir), _flagged(spark, sf_dir, "m > 0.01"))


@query(f"WITH {EDGES}{_flag('m < 0')} SELECT bin AS id FROM node EXCEPT SELECT src FROM edge WHERE src IN (SELECT bin FROM flagged) ORDER BY 1")
def set_remaining_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes left over once the flagged ones that begin an edge are taken, in order."""
    taken = _edges(spark, sf_dir).select(F.col("src").alias("id")).join(_flagged(spark, sf_dir, "m < 0"), "id", "left_semi")
    return _nodes(spark, sf_dir).select(F.col("bin").alias("id")).join(taken, "id", "left_anti").orderBy("id")


@query(f"WITH {CENTRES}, m AS (SELECT bin, img_id FROM member WHERE img_id % 2 = 0 UNION SELECT bin, img_id FROM member WHERE img_id % 3 = 0) SELECT bin, count(*) AS n FROM m GROUP BY bin")
def set_union_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = _members(spark, sf_dir)
    return m.where("img_id % 2 = 0").union(m.where("img_id % 3 = 0")).distinct().groupBy("bin").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT r.vec_id AS img_id, r.label AS prd FROM embeddings r WHERE EXISTS (SELECT 1 FROM embeddings n WHERE n.vec_id = r.vec_id AND n.vec_id % 4 = 1)")
def semi_join_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = snapshots(spark, sf_dir)
    return s.join(s.where("img_id % 4 = 1").select("img_id"), "img_id", "left_semi").select("img_id", "prd")


@query("SELECT a.prd AS done_prd, b.psi::INT AS psi FROM (SELECT DISTINCT label AS prd FROM embeddings) a CROSS JOIN range(8) b(psi) WHERE NOT EXISTS (SELECT 1 FROM embeddings e WHERE e.label = a.prd AND e.vec_id % 8 = b.psi AND e.embedding[1] > 0.15)")
def job_missing_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Task keys without output: the grid of keys less the finished ones."""
    s = snapshots(spark, sf_dir)
    grid = s.select("prd").distinct().crossJoin(F.broadcast(spark.range(8).select(F.col("id").cast("int").alias("psi"))))
    done = s.where(F.element_at("px", 1) > F.lit(0.15).cast("float")).select("prd", (F.col("img_id") % 8).cast("int").alias("psi"))
    return grid.join(done, ["prd", "psi"], "left_anti").select(F.col("prd").alias("done_prd"), "psi")


@query("WITH st AS (SELECT doc_id AS node, (1 + (doc_id % 8 + CASE WHEN quality = 1 THEN 0 ELSE 8 END))::INT AS state FROM labels) SELECT node, state, CASE WHEN state % 8 = 0 THEN 8 ELSE state % 8 END AS psi, CASE WHEN state <= 8 THEN 1 ELSE -1 END AS sense FROM st")
def label_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Coordinate and sense of numbered states, from 1."""
    shift = F.when(F.col("quality") == 1, 0).otherwise(8)
    s = F.col("state")
    st = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("node"), (1 + F.col("doc_id") % 8 + shift).cast("int").alias("state"))
    return st.select("node", "state", F.when(s % 8 == 0, 8).otherwise(s % 8).alias("psi"), F.when(s <= 8, 1).otherwise(-1).alias("sense"))


@query("WITH a AS (SELECT doc_id AS node, (doc_id % 8)::INT AS psi, CASE WHEN quality = 1 THEN 1 ELSE -1 END AS sense FROM labels) SELECT node, s::INT AS state, CASE WHEN s = psi + CASE WHEN sense = 1 THEN 0 ELSE 8 END THEN 110 ELSE 0 END AS weight FROM a CROSS JOIN range(16) t(s)")
def label_encode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Anchors as one-hot node weights over 16 states: the coordinate, and 8 more for the reverse sense."""
    a = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("node"), (F.col("doc_id") % 8).cast("int").alias("psi"), F.when(F.col("quality") == 1, 0).otherwise(8).alias("shift"))
    return a.select("node", "psi", "shift", F.explode(F.sequence(F.lit(0), F.lit(15))).alias("state")).select("node", "state", F.when(F.col("state") == F.col("psi") + F.col("shift"), 110).otherwise(0).alias("weight"))


PSIS, STATES, WIDTH = 4, 8, 1.2
#: Profiles of a bin's coordinates are the means of four bands of 16 pixels; a measure is the distance of two profiles,
#: the second one's sign turned for the reversed sense, as a share of the largest one, times ten.
_POT = """prof AS (SELECT bin, (j-1)//16 AS psi, (j-1)%16 AS k, avg(px[j]) AS v FROM member JOIN snap ON snap.img_id = member.img_id % (SELECT n FROM nn), range(1, 65) t(j) GROUP BY ALL),
d AS (SELECT e.src, e.dst, a.psi AS psi_a, b.psi AS psi_b, s.sense, sqrt(sum((a.v-s.sense*b.v)*(a.v-s.sense*b.v))) AS dist FROM edge e JOIN prof a ON a.bin = e.src JOIN prof b ON b.bin = e.dst AND b.k = a.k, (VALUES (1), (-1)) s(sense) GROUP BY ALL),
m AS (SELECT src, dst, a.i AS si, b.i AS sj, 10*dist/(SELECT max(dist) FROM d) AS v FROM d, range(8) a(i), range(8) b(i) WHERE psi_a = a.i % 4 AND psi_b = b.i % 4 AND sense = CASE WHEN (a.i < 4) = (b.i < 4) THEN 1 ELSE -1 END)"""


def _with_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """bin and px of every member; a twin has its original's image."""
    s = snapshots(spark, sf_dir).select(F.col("img_id").alias("base"), "px")
    n = table(spark, sf_dir, "embeddings").agg(F.count(F.lit(1)).alias("n"))
    m = _members(spark, sf_dir).crossJoin(F.broadcast(n))  # one row
    return m.select("bin", (F.col("img_id") % F.col("n")).alias("base")).join(s, "base").select("bin", "px")


def profiles(images: DataFrame, key: str, psis: int, length: int) -> DataFrame:
    """key, psi, profile: the mean image of each group (key, px), cut into psis bands of `length` pixels."""
    means = images.groupBy(key).agg(*(F.avg(F.element_at("px", k + 1)).alias(f"p{k}") for k in range(psis * length)))
    bands = F.array(*(F.struct(F.lit(i).alias("psi"), F.array(*(F.col(f"p{i * length + k}") for k in range(length))).alias("profile")) for i in range(psis)))
    return means.select(key, F.explode(bands).alias("b")).select(key, "b.psi", "b.profile")


def profile_measures(edges: DataFrame, bands: DataFrame, key: str) -> DataFrame:
    """edge, src, dst, psi_a, psi_b, sense, v: distances of all pairs of profiles of an edge's ends, in both senses."""
    a, b = (bands.select(F.col(key).alias(end), F.col("psi").alias(f"psi_{x}"), F.col("profile").alias(x)) for end, x in (("src", "a"), ("dst", "b")))
    met = edges.join(a, "src").join(b, "dst").withColumn("sense", F.explode(F.array(F.lit(1), F.lit(-1))))
    d = met.withColumn("dist", F.sqrt(squared_distance(F.col("a"), F.transform("b", lambda x: x * F.col("sense")))))
    return d.crossJoin(F.broadcast(d.agg(F.max("dist").alias("top")))).select("edge", "src", "dst", "psi_a", "psi_b", "sense", (10 * F.col("dist") / F.col("top")).alias("v"))  # one row


def _graph(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(nodes, edges, measures): log potentials over the graph of occupied bins; every sixth bin is an anchor."""
    gr.checkpoint_dir(spark)
    placed = _nodes(spark, sf_dir).checkpoint()
    edges = gr.numbered(gr.neighbourhood(placed, EPS).select("src", "dst").orderBy("src", "dst").checkpoint(), "edge")
    measures = profile_measures(edges, profiles(_with_images(spark, sf_dir), "bin", PSIS, 16), "bin").checkpoint()
    ids = placed.select(F.col("bin").cast("long").alias("id"))
    anchors = ids.where("id % 6 = 0").select("id", F.lit(2).alias("state"))
    return bp.node_potentials(ids, PSIS, anchors, weight=4.0), bp.edge_potentials(measures, PSIS, WIDTH), measures


@query(f"WITH {EDGES}, {_POT} SELECT src, dst, si::INT AS si, sj::INT AS sj, round(exp(-v/(2*1.2*1.2)), 6) + 0.0 AS pot FROM m")
def edge_potentials(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, e, _ = _graph(spark, sf_dir)
    return e.select("src", "dst", F.posexplode("pot").alias("k", "p")).select("src", "dst", F.floor(F.col("k") / STATES).cast("int").alias("si"), (F.col("k") % STATES).cast("int").alias("sj"), r6(F.exp("p")).alias("pot"))


#: nodepot, directed potentials and uniform first messages; then rounds of all messages at once.
_START = f"""{EDGES}, {_POT}, st AS (SELECT s AS state FROM range(8) t(s)),
np AS (SELECT bin AS node, state, CASE WHEN bin % 6 = 0 AND state = 2 THEN exp(4.0) ELSE 1 END AS w FROM node, st),
p AS (SELECT src, dst, si, sj, exp(-v/(2*1.2*1.2)) AS pot FROM m UNION ALL SELECT dst, src, sj, si, exp(-v/(2*1.2*1.2)) FROM m),
m0 AS (SELECT DISTINCT src, dst, sj AS state, 0.125::DOUBLE AS v FROM p)"""


def _rounds(n: int, damping: float) -> str:
    out = _START
    for k in range(1, n + 1):
        out += f""", t{k} AS (SELECT np.node, np.state, any_value(np.w)*coalesce(product(i.v), 1) AS w FROM np LEFT JOIN m{k-1} i ON i.dst = np.node AND i.state = np.state GROUP BY 1, 2),
r{k} AS (SELECT p.src, p.dst, p.sj AS state, sum(p.pot*t.w/b.v) AS r FROM p JOIN t{k} t ON t.node = p.src AND t.state = p.si JOIN m{k-1} b ON b.src = p.dst AND b.dst = p.src AND b.state = p.si GROUP BY 1, 2, 3),
m{k} AS (SELECT r.src, r.dst, r.state, {damping}*r.r/sum(r.r) OVER (PARTITION BY r.src, r.dst)+{1 - damping}*o.v AS v FROM r{k} r JOIN m{k-1} o ON o.src = r.src AND o.dst = r.dst AND o.state = r.state)"""
    return out


def _belief(n: int) -> str:
    return f", bb AS (SELECT np.node, np.state, any_value(np.w)*coalesce(product(i.v), 1) AS b FROM np LEFT JOIN m{n} i ON i.dst = np.node AND i.state = np.state GROUP BY 1, 2), bn AS (SELECT node, state, b/sum(b) OVER (PARTITION BY node) AS belief FROM bb)"


def _after(spark: SparkSession, sf_dir: str, rounds: int, damping: float) -> tuple[DataFrame, DataFrame]:
    nodes, edges, _ = _graph(spark, sf_dir)
    messages, _ = bp.propagate(nodes, edges, STATES, 0.0, rounds, damping)
    return nodes, messages


def _directed_messages(messages: DataFrame) -> DataFrame:
    both = F.array(F.struct("src", "dst", F.col("ahead").alias("m")), F.struct(F.col("dst").alias("src"), F.col("src").alias("dst"), F.col("back").alias("m")))
    return messages.select(F.explode(both).alias("e")).select(F.col("e.src").cast("int").alias("src"), F.col("e.dst").cast("int").alias("dst"), F.posexplode("e.m").alias("state", "m"))


@query(f"WITH {_rounds(1, 1.0)} SELECT src::INT AS src, dst::INT AS dst, state::INT AS state, round(v, 6) AS message FROM m1")
def bp_first_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One sum-product round from uniform messages, normalised per directed edge."""
    return _directed_messages(_after(spark, sf_dir, 1, 1.0)[1]).select("src", "dst", "state", F.round(F.exp("m"), 6).alias("message"))


@query(f"WITH {_rounds(4, 0.5)} SELECT src::INT AS src, dst::INT AS dst, state::INT AS state, round(v, 6) AS message FROM m4")
def bp_rounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four rounds of all messages, half damped."""
    return _directed_messages(_after(spark, sf_dir, 4, 0.5)[1]).select("src", "dst", "state", F.round(F.exp("m"), 6).alias("message"))


@query(f"WITH {_rounds(4, 0.5)}{_belief(4)} SELECT node::INT AS node, state::INT AS state, round(belief, 6) AS belief, row_number() OVER (PARTITION BY node ORDER BY round(belief, 9) DESC, state) = 1 AS chosen FROM bn")
def bp_beliefs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Normalised products of potential and incoming messages after four rounds, and the chosen state of every node."""
    nodes, messages = _after(spark, sf_dir, 4, 0.5)
    b = bp.beliefs(nodes, messages, STATES).withColumn("belief", F.transform("belief", lambda x: F.round(x, 9)))
    chosen = F.array_position("belief", F.array_max("belief")) - 1
    return b.select(F.col("id").cast("int").alias("node"), F.posexplode("belief").alias("state", "belief"), chosen.alias("top")).select("node", "state", F.round("belief", 6).alias("belief"), (F.col("state") == F.col("top")).alias("chosen"))


@query(f"WITH {_rounds(4, 0.5)}{_belief(4)}, f AS (SELECT m.src, m.dst, m.si, m.sj, exp(-m.v/(2*1.2*1.2))*a.b/x.v*b.b/y.v AS w FROM m JOIN bb a ON a.node = m.src AND a.state = m.si JOIN bb b ON b.node = m.dst AND b.state = m.sj JOIN m4 x ON x.src = m.dst AND x.dst = m.src AND x.state = m.si JOIN m4 y ON y.src = m.src AND y.dst = m.dst AND y.state = m.sj) SELECT src::INT AS src, dst::INT AS dst, si::INT AS si, sj::INT AS sj, round(w/sum(w) OVER (PARTITION BY src, dst), 6) AS belief FROM f")
def bp_edge_beliefs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Joint beliefs of the two ends of every edge after four rounds."""
    b = bp.edge_beliefs(*_after(spark, sf_dir, 4, 0.5), STATES)
    k = F.col("k")
    return b.select(F.col("src").cast("int").alias("src"), F.col("dst").cast("int").alias("dst"), F.posexplode("belief").alias("k", "b")).select("src", "dst", F.floor(k / STATES).cast("int").alias("si"), (k % STATES).cast("int").alias("sj"), F.round("b", 6).alias("belief"))


@query(f"WITH {_rounds(2, 1.0)} SELECT round(sum(abs(m2.v-m1.v)), 4) AS residual, sum(abs(m2.v-m1.v)) < 1e-4 AS settled FROM m2 JOIN m1 USING (src, dst, state)")
def bp_residual(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the second round changes."""
    d = F.sum("change")
    return _after(spark, sf_dir, 2, 1.0)[1].agg(F.round(d, 4).alias("residual"), (d < 1e-4).alias("settled"))


@query(f"WITH {EDGES}, {_POT}, f AS (SELECT src, dst, (si % 4)::INT AS psi, sqrt(sum(v*v)/2) AS l2, sum(v)/2 AS l1, count(*) FILTER (WHERE v > 5) // 2 AS nz FROM m GROUP BY ALL) SELECT src, dst, psi, round(l2, 6) AS l2, round(l1, 6) AS l1, nz FROM f")
def edge_norms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Norms of an edge's measures by coordinate of its source."""
    v = F.col("v")
    f = _graph(spark, sf_dir)[2].groupBy("src", "dst", F.col("psi_a").alias("psi")).agg(F.sqrt(F.sum(v * v)).alias("l2"), F.sum(F.abs(v)).alias("l1"), F.count_if(v > 5).alias("nz"))
    return f.select("src", "dst", "psi", F.round("l2", 6).alias("l2"), F.round("l1", 6).alias("l1"), "nz")


@query("SELECT coalesce(a.doc_id, b.doc_id) AS doc_id, a.toxic AS manual, b.n_lang AS predicted, a.toxic = b.n_lang AS agree FROM labels a FULL JOIN (SELECT doc_id, (lang = 'de')::INT AS n_lang FROM documents) b ON a.doc_id = b.doc_id")
def label_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = table(spark, sf_dir, "labels").select("doc_id", F.col("toxic").cast("int").alias("manual"))
    b = table(spark, sf_dir, "documents").select("doc_id", (F.col("lang") == "de").cast("int").alias("predicted"))
    return a.join(b, "doc_id", "full").withColumn("agree", F.col("manual") == F.col("predicted"))
