"""Graph queries on the trade graph and on meshes built from the tables."""

from pyspark.sql import functions as F

from ondula.operators import graph as G
from ondula.operators import ranking as R
from ondula.operators import sets as S
from ondula.plans import adapters as ad
from ondula.plans.adapters import with_
from ondula.plans.registry import query
from ondula.plans.windows import FACES, faces
from ondula.session import cut


def adjacency(spark, sf):
    """Strongest 30 % of the symmetrised trade graph."""
    return cut(R.density_threshold(S.symmetrise(ad.trade(spark, sf)), 0.3).select("graph", "src", "dst"))


def nodes(spark, sf):
    return ad.trade_nodes(spark, sf)


@query("gra_01_degree", "node:l degree:l",
       with_("trade", "nodes") + "SELECT node, (SELECT count(*) FROM trade WHERE src = node AND weight > 0.5) AS degree FROM nodes")
def _(spark, sf):
    return G.degree(ad.trade(spark, sf), nodes(spark, sf), 0.5)


@query("gra_02_strength", "node:l strength:7",
       with_("trade", "nodes") + "SELECT node, coalesce((SELECT sum(weight) FROM trade WHERE src = node), 0) AS strength FROM nodes")
def _(spark, sf):
    return G.strength(ad.trade(spark, sf), nodes(spark, sf))


CC = with_("adj", "nodes") + (
    ", k AS (SELECT src, count(*) AS k FROM adj GROUP BY 1), tri AS (SELECT a.src, count(*) AS n FROM adj a JOIN adj b ON a.src = b.src AND a.dst <> b.dst "
    "JOIN adj c ON c.src = a.dst AND c.dst = b.dst GROUP BY 1), "
    "cc AS (SELECT node, CASE WHEN k >= 2 THEN coalesce(n, 0) / (k * (k - 1)) ELSE 0 END AS clustering FROM nodes LEFT JOIN k ON k.src = node LEFT JOIN tri ON tri.src = node) ")


@query("gra_03_clustering", "node:l clustering:6", CC + "SELECT * FROM cc")
def _(spark, sf):
    return G.clustering(adjacency(spark, sf), nodes(spark, sf))


@query("gra_04_global_clustering", "graph clustering:6", CC + "SELECT 'trade' AS graph, avg(clustering) AS clustering FROM cc")
def _(spark, sf):
    return G.global_clustering(adjacency(spark, sf), nodes(spark, sf))


@query("gra_05_path_length", "graph path_length:6",
       with_("adj", "nodes").replace("WITH ", "WITH RECURSIVE ", 1) + ", b AS (SELECT node AS s, node AS v, 0 AS d FROM nodes UNION SELECT b.s, adj.dst, b.d + 1 FROM b JOIN adj ON adj.src = b.v WHERE b.d < 12), "
       "m AS (SELECT s, v, min(d) AS d FROM b GROUP BY 1, 2) SELECT 'trade' AS graph, coalesce(avg(d) FILTER (d > 0), 'infinity') AS path_length FROM m")
def _(spark, sf):
    return G.path_length(adjacency(spark, sf), nodes(spark, sf))


@query("gra_06_betweenness", "node:l betweenness:6",
       with_("adj", "nodes").replace("WITH ", "WITH RECURSIVE ", 1) + ", b AS (SELECT node AS s, node AS v, 0 AS d FROM nodes UNION SELECT b.s, adj.dst, b.d + 1 FROM b JOIN adj ON adj.src = b.v WHERE b.d < 12), "
       "m AS (SELECT s, v, min(d) AS d FROM b GROUP BY 1, 2), "
       "p AS (SELECT node AS s, node AS v, 0 AS d, 1.0 AS one, CAST(node AS VARCHAR) AS path FROM nodes UNION ALL SELECT p.s, adj.dst, p.d + 1, 1.0, path || '>' || adj.dst FROM p JOIN adj ON adj.src = p.v JOIN m ON m.s = p.s AND m.v = adj.dst AND m.d = p.d + 1), "
       "sg AS (SELECT s, v, count(*) AS sigma FROM p GROUP BY 1, 2) "
       "SELECT node, coalesce(sum(x.sigma * y.sigma / z.sigma), 0) / (24 * 23) AS betweenness FROM nodes LEFT JOIN (m mx JOIN m my ON my.s = mx.v AND my.d > 0 AND mx.d > 0 JOIN m mz ON mz.s = mx.s AND mz.v = my.v AND mz.d = mx.d + my.d AND mz.d > 0 "
       "JOIN sg x ON x.s = mx.s AND x.v = mx.v JOIN sg y ON y.s = my.s AND y.v = my.v JOIN sg z ON z.s = mz.s AND z.v = mz.v) ON mx.v = node GROUP BY 1")
def _(spark, sf):
    return G.betweenness(adjacency(spark, sf), nodes(spark, sf))


@query("gra_07_small_world", "graph small_world:6")
def _(spark, sf):
    return G.small_world(adjacency(spark, sf), nodes(spark, sf), 5, seed=7)


@query("gra_08_laplacian", "i:l j:l v:1",
       with_("adj") + "SELECT src AS i, dst AS j, -1 AS v FROM adj UNION ALL SELECT src, src, count(*) FROM adj GROUP BY 1, 2")
def _(spark, sf):
    return G.laplacian(adjacency(spark, sf))


NODE_VALUES = "nv AS (SELECT c_nationkey AS node, c_custkey % 5 AS t, sum(c_acctbal) AS value FROM customer GROUP BY 1, 2)"


def node_values(spark, sf):
    c = ad.table(spark, sf, "customer")
    return c.groupBy(F.lit("trade").alias("graph"), F.col("c_nationkey").alias("node"), (F.col("c_custkey") % 5).alias("t")).agg(F.sum("c_acctbal").alias("value"))


@query("gra_09_smoothing", "node:l t:l value:3",
       with_("adj") + f", {NODE_VALUES}, d AS (SELECT src AS node, count(*) AS d FROM adj GROUP BY 1), s AS (SELECT dst AS node, t, sum(value) AS s FROM adj JOIN nv ON nv.node = src GROUP BY 1, 2) "
       "SELECT node, t, value - 0.1 * (coalesce(d, 0) * value - coalesce(s, 0)) AS value FROM nv LEFT JOIN d USING (node) LEFT JOIN s USING (node, t)")
def _(spark, sf):
    return G.smooth(node_values(spark, sf), adjacency(spark, sf), 0.1)


@query("gra_10_neighbour_sum", "node:l t:l value:3",
       with_("adj") + f", {NODE_VALUES}, s AS (SELECT dst AS node, t, sum(value) AS s FROM adj JOIN nv ON nv.node = src GROUP BY 1, 2) SELECT node, t, value + coalesce(s, 0) AS value FROM nv LEFT JOIN s USING (node, t)")
def _(spark, sf):
    return G.neighbour_sum(node_values(spark, sf), adjacency(spark, sf))


POINTS = "pt AS (SELECT p_partkey AS v, p_size * 1.0 AS x, p_partkey % 100 * 1.0 AS y, p_retailprice / 20 AS z FROM part)"


def points(spark, sf):
    return ad.table(spark, sf, "part").select(F.lit("m").alias("mesh"), F.col("p_partkey").alias("v"), (F.col("p_size") * 1.0).alias("x"),
                                              (F.col("p_partkey") % 100 * 1.0).alias("y"), (F.col("p_retailprice") / 20).alias("z"))


@query("gra_11_distance_adjacency", "src:l dst:l length:6",
       f"WITH {POINTS}, d AS (SELECT a.v AS src, b.v AS dst, (a.x-b.x)**2 + (a.y-b.y)**2 + (a.z-b.z)**2 AS d2 FROM pt a JOIN pt b ON a.v <> b.v AND abs(a.x-b.x) < 3 AND abs(a.y-b.y) < 3) SELECT src, dst, sqrt(d2) AS length FROM d WHERE d2 < 9", many=True)
def _(spark, sf):
    return G.within_distance(points(spark, sf), 3.0)


def mesh(spark, sf):
    p = points(spark, sf).where("v < 300")
    return p, faces(spark, sf)


NORMALS = (f"WITH {POINTS}, f AS ({FACES}), c AS (SELECT v0, v1, v2, b.x-a.x AS ax, b.y-a.y AS ay, b.z-a.z AS az, c.x-a.x AS bx, c.y-a.y AS \"by\", c.z-a.z AS bz FROM f JOIN pt a ON a.v = v0 JOIN pt b ON b.v = v1 JOIN pt c ON c.v = v2), "
           "n AS (SELECT v0, v1, v2, ay*bz-az*\"by\" AS nx, az*bx-ax*bz AS ny, ax*\"by\"-ay*bx AS nz FROM c), "
           "s AS (SELECT v, sum(nx) AS nx, sum(ny) AS ny, sum(nz) AS nz FROM (SELECT unnest([v0, v1, v2]) AS v, nx, ny, nz FROM n) GROUP BY 1), "
           "u AS (SELECT v, nx / greatest(sqrt(nx*nx+ny*ny+nz*nz), 1e-10) AS nx, ny / greatest(sqrt(nx*nx+ny*ny+nz*nz), 1e-10) AS ny, nz / greatest(sqrt(nx*nx+ny*ny+nz*nz), 1e-10) AS nz FROM s) ")


@query("gra_12_vertex_normals", "v:l nx:6 ny:6 nz:6", NORMALS + "SELECT * FROM u")
def _(spark, sf):
    return G.vertex_normals(points(spark, sf), faces(spark, sf))


@query("gra_13_vertex_features", "v:l nx:6 depth:4 myelin:4", NORMALS + "SELECT v, nx, p_size AS depth, CASE WHEN p_size > 20 THEN p_retailprice END AS myelin FROM u JOIN part ON p_partkey = v")
def _(spark, sf):
    p = ad.table(spark, sf, "part").select(F.lit("m").alias("mesh"), F.col("p_partkey").alias("v"), F.col("p_size").alias("depth"), "p_retailprice")
    return G.vertex_features(G.vertex_normals(points(spark, sf), faces(spark, sf)), p.select("mesh", "v", "depth"),
                             p.where("depth > 20").select("mesh", "v", F.col("p_retailprice").alias("myelin")))


@query("gra_14_orientation", "v:l fixed0:6 free4:6 loose1:6 loose8:6",
       NORMALS + "SELECT v, nx AS fixed0, 1.0 AS free4, 0.75 * nx * ny AS loose1, nz * nz + 0.25 * (1 - nz * nz) AS loose8 FROM u")
def _(spark, sf):
    n = cut(G.vertex_normals(points(spark, sf), faces(spark, sf)))
    get = lambda m, k, name: G.orientation(n, m).select("v", F.get("o", F.lit(k)).alias(name))
    return get("fixed", 0, "fixed0").join(get("free", 4, "free4"), "v").join(
        G.orientation(n, "loose").select("v", F.get("o", F.lit(1)).alias("loose1"), F.get("o", F.lit(8)).alias("loose8")), "v")


@query("gra_15_inverse_distance", "i:l j:l v:8",
       "WITH s AS (SELECT s_suppkey AS v, s_nationkey * 1.0 AS x, s_acctbal / 100 AS y, s_suppkey % 10 * 1.0 AS z FROM supplier), w AS (SELECT a.v AS i, b.v AS j, power(sqrt((a.x-b.x)**2 + (a.y-b.y)**2 + (a.z-b.z)**2 + 1e-6), -3) AS w FROM s a JOIN s b ON a.v <> b.v) "
       "SELECT i, j, w / greatest(sum(w) OVER (PARTITION BY i), 1e-10) AS v FROM w", many=True)
def _(spark, sf):
    s = ad.table(spark, sf, "supplier").select(F.lit("m").alias("mesh"), F.col("s_suppkey").alias("v"), (F.col("s_nationkey") * 1.0).alias("x"),
                                               (F.col("s_acctbal") / 100).alias("y"), (F.col("s_suppkey") % 10 * 1.0).alias("z"))
    return G.inverse_distance(s)


def two_step_flow(edges, keys):
    """A small linear graph function: strength after one and two steps."""
    one = edges.groupBy(*keys, F.col("src").alias("region")).agg(F.sum("weight").alias("value"))
    ahead = edges.join(one.withColumnRenamed("region", "dst"), [*keys, "dst"], "left")
    two = ahead.groupBy(*keys, F.col("src").alias("region")).agg(F.sum(F.col("weight") * F.coalesce("value", F.lit(0.0))).alias("value"))
    return one.withColumn("t", F.lit(0)).unionByName(two.withColumn("t", F.lit(1)))


def _sweep(spark, sf):
    lesions = ad.trade_nodes(spark, sf).select("graph", F.col("node").alias("lesion"), F.col("node").alias("region"))
    return G.lesion_sweep(ad.trade(spark, sf), lesions, two_step_flow)


LESION = with_("trade", "nodes") + (
    ", les AS (SELECT node AS lesion, src, dst, CASE WHEN src = node OR dst = node THEN 0 ELSE weight END AS w FROM nodes, trade UNION ALL SELECT -1, src, dst, weight FROM trade), "
    "one AS (SELECT lesion, src AS region, 0 AS t, sum(w) AS value FROM les GROUP BY 1, 2), "
    "two AS (SELECT l.lesion, src AS region, 1 AS t, sum(w * coalesce(o.value, 0)) AS value FROM les l LEFT JOIN one o ON o.lesion = l.lesion AND o.region = l.dst GROUP BY 1, 2), "
    "a AS (SELECT * FROM one UNION ALL SELECT * FROM two), "
    "d AS (SELECT x.lesion, x.region, x.t, i.value AS intact, x.value AS lesioned, abs(i.value - x.value) AS difference FROM a x JOIN a i ON i.lesion = -1 AND i.region = x.region AND i.t = x.t WHERE x.lesion >= 0) ")


@query("gra_16_lesion_sweep", "lesion:l region:l t:l intact:6 lesioned:6 difference:6", LESION + "SELECT * FROM d")
def _(spark, sf):
    return _sweep(spark, sf)


@query("gra_17_contribution_matrix", "region:l t:l value:6", LESION + "SELECT lesion AS region, t, avg(difference) AS value FROM d GROUP BY 1, 2")
def _(spark, sf):
    return G.contribution_matrix(_sweep(spark, sf))
