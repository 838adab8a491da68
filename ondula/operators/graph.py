"""Graph measures on edge tables keyed by graph."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from functools import reduce
from itertools import product

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ondula.operators import ordered
from ondula.operators.attach import attach
from ondula.operators.quantiles import quantiles
from ondula.operators.sets import symmetrise
from ondula.operators.tiles import MOST, ROWS, Chunk, compared
from ondula.session import cut

SIDES, SIDE_POINTS = 16, 1024  # sides of the square of all pairs at most, points a side at least
PACKED = 1024  # points in a row
REGION, REGION_POINTS = 4, 1 << 14  # cells of a region along an axis, points of it in a task
STRONG = 0.5  # fixed: an edge counts in the binary measures above this weight


def binary(edges: DataFrame, level: float = STRONG) -> DataFrame:
    return edges.where((F.col("src") != F.col("dst")) & (F.col("weight") > level)).select("graph", "src", "dst")


def above_median(edges: DataFrame) -> DataFrame:
    """Edges above the median positive weight of their graph."""
    e = edges.where("src <> dst")
    return e.join(quantiles(e.where("weight > 0"), ["graph"], "weight", {"_m": 0.5}), "graph").where(
        F.col("weight") > F.col("_m")).select("graph", "src", "dst")


def degree(edges: DataFrame, nodes: DataFrame, level: float | None = None) -> DataFrame:
    """Number of off-diagonal edges above the level (or non-zero) per node."""
    w = F.abs("weight")
    e = edges.where((F.col("src") != F.col("dst")) & ((w > level) if level is not None else (w > 0)))
    d = e.groupBy("graph", F.col("src").alias("node")).agg(F.count("*").alias("degree"))
    return nodes.join(d, ["graph", "node"], "left").select("graph", "node", F.coalesce("degree", F.lit(0)).alias("degree"))


def strength(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    s = edges.where("src <> dst").groupBy("graph", F.col("src").alias("node")).agg(F.sum("weight").alias("strength"))
    return nodes.join(s, ["graph", "node"], "left").select("graph", "node", F.coalesce("strength", F.lit(0.0)).alias("strength"))


def clustering(adjacency: DataFrame, nodes: DataFrame) -> DataFrame:
    """Share of linked neighbour pairs per node; fewer than two neighbours give 0.

    Triangles are found once each: every undirected edge points to its end of
    higher degree, so a hub opens no more than about sqrt(2E) wedges. Each
    triangle then carries its six direction flags to the three corners, which
    also covers graphs that are not symmetric.
    """
    adjacency = cut(adjacency)
    lo, hi = F.least("src", "dst"), F.greatest("src", "dst")
    und = adjacency.where("src <> dst").groupBy("graph", lo.alias("a"), hi.alias("b")).agg(
        F.max((F.col("src") == lo).cast("int")).alias("ab"), F.max((F.col("src") == hi).cast("int")).alias("ba"))
    ends = und.select("graph", F.explode(F.array("a", "b")).alias("node"))
    deg = ends.groupBy("graph", "node").agg(F.count("*").alias("d"))
    e = und.join(deg.select("graph", F.col("node").alias("a"), F.col("d").alias("da")), ["graph", "a"]).join(
        deg.select("graph", F.col("node").alias("b"), F.col("d").alias("db")), ["graph", "b"])
    up = (F.col("da") < F.col("db")) | ((F.col("da") == F.col("db")) & (F.col("a") < F.col("b")))
    pick = lambda x, y, n: F.when(up, F.col(x)).otherwise(F.col(y)).alias(n)
    o = e.select("graph", pick("a", "b", "u"), pick("b", "a", "v"), pick("ab", "ba", "uv"), pick("ba", "ab", "vu"),
                 F.greatest("da", "db").alias("dv"))
    o = cut(o)  # each oriented edge is read three times
    w1 = o.select("graph", "u", "v", "uv", "vu", "dv")
    w2 = o.select("graph", "u", F.col("v").alias("w"), F.col("uv").alias("uw"), F.col("vu").alias("wu"), F.col("dv").alias("dw"))
    later = (F.col("dv") < F.col("dw")) | ((F.col("dv") == F.col("dw")) & (F.col("v") < F.col("w")))
    wedge = w1.join(w2, ["graph", "u"]).where(later)
    close = o.select("graph", F.col("u").alias("v"), F.col("v").alias("w"), F.col("uv").alias("vw"), F.col("vu").alias("wv"))
    tri = wedge.join(close, ["graph", "v", "w"])
    corner = lambda n, x, y, z, zr: F.struct(F.col(n).alias("node"), (F.col(x) * F.col(y) * (F.col(z) + F.col(zr))).alias("links"))
    corners = F.array(corner("u", "uv", "uw", "vw", "wv"), corner("v", "vu", "vw", "uw", "wu"), corner("w", "wu", "wv", "uv", "vu"))
    links = tri.select("graph", F.inline(corners)).groupBy("graph", "node").agg(F.sum("links").alias("links"))
    out = adjacency.where("src <> dst").groupBy("graph", F.col("src").alias("node")).agg(F.count("*").alias("k"))
    full = nodes.join(out, ["graph", "node"], "left").join(links, ["graph", "node"], "left")
    k = F.col("k")
    return full.select("graph", "node", F.when(k >= 2, F.coalesce("links", F.lit(0)) / (k * (k - 1))).otherwise(0.0).alias("clustering"))


def global_clustering(adjacency: DataFrame, nodes: DataFrame) -> DataFrame:
    return clustering(adjacency, nodes).groupBy("graph").agg(F.avg("clustering").alias("clustering"))


#: Words of 64 sources in a batch of searches, and sources in a batch of path counts.
WORDS, SOURCES = 64, 1024


def _numbered(nodes: DataFrame) -> tuple[DataFrame, int]:
    """(nodes with ``_i``, their number from 0 in each graph; the largest number)."""
    idx = cut(ordered.running(nodes.select("graph", "node").distinct(), ["graph"], "node", F.lit(1), "_n").select("graph", "node", (F.col("_n") - 1).alias("_i")))
    last = idx.agg(F.max("_i")).first()[0]
    return idx, -1 if last is None else int(last)


def _bit(i: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("bigint"), F.pmod(i, F.lit(64)).cast("int"))


def _word(i: Column) -> Column:
    return F.floor(i / 64).cast("bigint")


def hop_counts(adjacency: DataFrame, nodes: DataFrame, words: int = WORDS) -> DataFrame:
    """Ordered pairs of nodes by distance: ``graph, depth, n``, for depths from 1.

    The search runs from all nodes of a batch at once. A row per node and 64 sources holds two words, the sources that have
    reached the node and those that just did; a hop is an OR over the neighbours' words. Only counts are kept from hop to hop and batch to batch.
    """
    e = cut(adjacency.select("graph", F.col("src").alias("node"), F.col("dst").alias("next")).distinct())
    idx, last = _numbered(nodes)
    key = ["graph", "word", "node"]
    counts = [idx.select("graph", F.lit(0).alias("depth"), F.lit(0).cast("bigint").alias("n")).where("false")]
    for first in range(0, last + 1, 64 * words):
        own = idx.where(F.col("_i").between(first, first + 64 * words - 1))
        state = own.select("graph", _word(F.col("_i")).alias("word"), "node", _bit(F.col("_i")).alias("front"), _bit(F.col("_i")).alias("seen"))
        depth = 0
        while True:
            depth += 1
            come = state.where("front <> 0").join(e, ["graph", "node"]).groupBy("graph", "word", F.col("next").alias("node")).agg(F.bit_or("front").alias("come"))
            none = F.lit(0).cast("bigint")
            both = state.select(*key, "seen", none.alias("come")).unionByName(come.select(*key, none.alias("seen"), "come"))
            merged = both.groupBy(*key).agg(F.bit_or("seen").alias("_s"), F.bit_or("come").alias("_c"))
            state = cut(merged.select(*key, F.col("_c").bitwiseAND(F.bitwise_not("_s")).alias("front"), F.col("_s").bitwiseOR(F.col("_c")).alias("seen")))
            new = cut(state.where("front <> 0").groupBy("graph").agg(F.sum(F.bit_count("front")).cast("bigint").alias("n")))
            if new.isEmpty():
                break
            counts.append(new.select("graph", F.lit(depth).alias("depth"), "n"))
    return reduce(DataFrame.unionByName, counts).groupBy("graph", "depth").agg(F.sum("n").alias("n"))


def path_length(adjacency: DataFrame, nodes: DataFrame) -> DataFrame:
    """Mean finite, non-zero hop distance over ordered pairs; infinite without any edge."""
    mean = hop_counts(adjacency, nodes).groupBy("graph").agg((F.sum(F.col("depth") * F.col("n")) / F.sum("n")).alias("path_length"))
    return nodes.select("graph").distinct().join(mean, "graph", "left").fillna(float("inf"), ["path_length"])


def path_counts(edges: DataFrame, sources: DataFrame) -> list[DataFrame]:
    """Levels of the search from numbered ``sources`` over ``edges(graph, node, next)``: ``graph, source, node, sigma``.

    ``sigma`` counts the shortest paths. The nodes that were reached are kept as words of 64 sources. One level is written per hop.
    """
    i = F.col("source")
    levels = [cut(sources.select("graph", F.col("_i").alias("source"), "node", F.lit(1.0).alias("sigma")))]
    key = ["graph", "word", "node"]
    seen = None
    while True:
        words = levels[-1].groupBy("graph", _word(i).alias("word"), "node").agg(F.bit_or(_bit(i)).alias("seen"))
        seen = cut(words if seen is None else seen.unionByName(words).groupBy(*key).agg(F.bit_or("seen").alias("seen")))
        step = levels[-1].join(edges, ["graph", "node"]).groupBy("graph", "source", F.col("next").alias("node")).agg(F.sum("sigma").alias("sigma"))
        step = step.withColumn("word", _word(i)).join(seen, key, "left")
        new = cut(step.where(F.coalesce("seen", F.lit(0)).bitwiseAND(_bit(i)) == 0).select("graph", "source", "node", "sigma"))
        if new.isEmpty():
            return levels
        levels.append(new)


def betweenness(adjacency: DataFrame, nodes: DataFrame, sources: int = SOURCES) -> DataFrame:
    """Share of shortest paths through each node over both directions of each pair, / ((N-1)(N-2)).

    Sources are taken in batches; of each batch the sums per node are kept.
    """
    e = cut(adjacency.select("graph", F.col("src").alias("node"), F.col("dst").alias("next")))
    into = e.select("graph", F.col("node").alias("prev"), F.col("next").alias("node"))
    idx, last = _numbered(nodes)
    key = ["graph", "source", "node"]
    sums = [idx.select("graph", "node", F.lit(0.0).alias("delta")).where("false")]
    for first in range(0, last + 1, sources):
        levels = path_counts(e, idx.where(F.col("_i").between(first, first + sources - 1)))
        parts, delta = [], None
        for d in range(len(levels) - 1, 0, -1):
            here = levels[d]
            here = here.withColumn("delta", F.lit(0.0)) if delta is None else here.join(delta, key, "left").fillna(0.0, ["delta"])
            parts.append(here.select("graph", "node", "delta"))
            back = here.join(into, ["graph", "node"]).select(
                "graph", "source", F.col("prev").alias("node"), ((1 + F.col("delta")) / F.col("sigma")).alias("_g"))
            up = levels[d - 1].select(*key, F.col("sigma").alias("_s"))
            delta = cut(back.join(up, key).groupBy(*key).agg(F.sum(F.col("_g") * F.col("_s")).alias("delta")))
        if parts:
            sums.append(cut(reduce(DataFrame.unionByName, parts).groupBy("graph", "node").agg(F.sum("delta").alias("delta"))))
    n = nodes.groupBy("graph").agg(F.count("*").alias("_n"))
    every = reduce(DataFrame.unionByName, sums).groupBy("graph", "node").agg(F.sum("delta").alias("_b"))
    total = nodes.join(n, "graph").join(every, ["graph", "node"], "left")
    b, nn = F.coalesce("_b", F.lit(0.0)), F.col("_n")
    return total.select("graph", "node", F.when(nn > 2, b / ((nn - 1) * (nn - 2))).otherwise(b).alias("betweenness"))


def random_graphs(sizes: DataFrame, n_random: int, seed: int = 0) -> DataFrame:
    """Undirected random graphs with the node and edge counts of ``sizes`` (``graph, n, m``).

    Hash draws of node pairs are numbered and the first ``m`` distinct pairs
    are kept. Beyond half of all pairs the missing pairs are drawn instead, so
    the number of draws stays near the number of edges. Nodes are 0 .. n-1.
    """
    pairs = F.col("n") * (F.col("n") - 1) / 2
    dense = F.col("m") > pairs / 2
    s = sizes.withColumn("_dense", dense).withColumn("_want", F.when(dense, pairs - F.col("m")).otherwise(F.col("m")))
    s = s.withColumn("trial", F.explode(F.sequence(F.lit(0), F.lit(n_random - 1))))
    h = lambda salt: F.pmod(F.xxhash64(F.lit(seed), "graph", "trial", "draw", F.lit(salt)), F.col("n"))

    def distinct_pairs(times: int) -> DataFrame:
        draws = (F.col("_want") * times + 64).cast("bigint")
        d = s.withColumn("draw", F.explode(F.sequence(F.lit(0).cast("bigint"), draws)))
        d = d.withColumn("_i", h(1)).withColumn("_j", h(2)).where("_i <> _j")
        return cut(d.groupBy("graph", "trial", "n", "_dense", "_want", F.least("_i", "_j").alias("i"), F.greatest("_i", "_j").alias("j")).agg(
            F.min("draw").alias("draw")))

    # a draw gives a new pair with probability of at least 1/2 * (n-1)/n >= 1/4; where eight times do not suffice, draw on
    times, first = 8, distinct_pairs(8)
    while not first.groupBy("graph", "trial", "_want").count().where("count < _want").isEmpty():
        times *= 2
        first = distinct_pairs(times)
    ranked = ordered.running(first, ["graph", "trial"], "draw", F.lit(1), "_rank")
    chosen = ranked.where(F.col("_rank") <= F.col("_want"))
    sparse_part = chosen.where(~F.col("_dense")).select("graph", "trial", "i", "j")
    full = s.where("_dense").withColumn("i", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("n") - 2))).withColumn(
        "j", F.explode(F.sequence(F.col("i") + 1, F.col("n") - 1)))
    dense_part = full.join(chosen.where("_dense"), ["graph", "trial", "i", "j"], "left_anti").select("graph", "trial", "i", "j")
    both = sparse_part.unionByName(dense_part)
    name = F.concat_ws("#", "graph", "trial").alias("graph")
    return both.select(name, F.col("i").alias("src"), F.col("j").alias("dst")).unionByName(
        both.select(name, F.col("j").alias("src"), F.col("i").alias("dst")))


def small_world(adjacency: DataFrame, nodes: DataFrame, n_random: int = 10, seed: int = 0) -> DataFrame:
    """(C / C_rand) / (L / L_rand) against random graphs with as many edges; 0 when degenerate."""
    m = adjacency.groupBy("graph").agg((F.count("*") / 2).cast("bigint").alias("m"))
    sizes = nodes.groupBy("graph").agg(F.count("*").alias("n")).join(m, "graph")
    rand = cut(random_graphs(sizes, n_random, seed))
    rnodes = sizes.withColumn("trial", F.explode(F.sequence(F.lit(0), F.lit(n_random - 1)))).select(
        F.concat_ws("#", "graph", "trial").alias("graph"), F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("n") - 1)).alias("node"))
    base = F.regexp_extract("graph", r"^(.*)#\d+$", 1).alias("graph")
    c_rand = global_clustering(rand, rnodes).groupBy(base).agg(F.avg("clustering").alias("_cr"))
    l_rand = path_length(rand, rnodes).groupBy(base).agg(F.avg("path_length").alias("_lr"))
    real = global_clustering(adjacency, nodes).join(path_length(adjacency, nodes), "graph")
    j = real.join(c_rand, "graph").join(l_rand, "graph")
    bad = (F.col("path_length") == float("inf")) | (F.col("path_length") == 0) | (F.col("_cr") == 0) | (F.col("_lr") == 0)
    return j.select("graph", F.when(bad, 0.0).otherwise(
        (F.col("clustering") / F.col("_cr")) / (F.col("path_length") / F.col("_lr"))).alias("small_world"))


def laplacian(edges: DataFrame) -> DataFrame:
    """D - A of the symmetrised binary graph as cells; absent cells are 0."""
    a = symmetrise(edges.where("src <> dst").withColumn("weight", F.lit(1.0)))
    diag = a.groupBy("graph", F.col("src").alias("i")).agg(F.sum("weight").alias("v"))
    return a.select("graph", F.col("src").alias("i"), F.col("dst").alias("j"), (-F.col("weight")).alias("v")).unionByName(
        diag.select("graph", "i", F.col("i").alias("j"), "v"))


def smooth(values: DataFrame, edges: DataFrame, alpha: float = 0.5) -> DataFrame:
    """x - alpha L x for ``values(graph, node, t, value)``."""
    a = symmetrise(edges.where("src <> dst").withColumn("weight", F.lit(1.0)))
    deg = a.groupBy("graph", F.col("src").alias("node")).agg(F.count("*").alias("_d"))
    near = a.select("graph", F.col("dst").alias("node"), F.col("src").alias("to")).join(values, ["graph", "node"]).groupBy(
        "graph", F.col("to").alias("node"), "t").agg(F.sum("value").alias("_near"))
    j = values.join(deg, ["graph", "node"], "left").join(near, ["graph", "node", "t"], "left")
    lx = F.coalesce("_d", F.lit(0)) * F.col("value") - F.coalesce("_near", F.lit(0.0))
    return j.select("graph", "node", "t", (F.col("value") - alpha * lx).alias("value"))


def neighbour_sum(values: DataFrame, edges: DataFrame) -> DataFrame:
    """x plus the sum over incoming neighbours."""
    inc = edges.select("graph", F.col("src").alias("node"), "dst").join(values, ["graph", "node"]).groupBy(
        "graph", F.col("dst").alias("node"), "t").agg(F.sum("value").alias("_in"))
    return values.join(inc, ["graph", "node", "t"], "left").select(
        "graph", "node", "t", (F.col("value") + F.coalesce("_in", F.lit(0.0))).alias("value"))


def within_distance(points: DataFrame, radius: float, key: str = "mesh", id: str = "v") -> DataFrame:
    """Ordered pairs of points closer than ``radius``; candidates share a grid cell or touch it.

    A cell meets itself and the half of its neighbours that follow it, so a pair is found once and given both ways. Points meet cells that are rows of up to
    ``PACKED`` points, in regions of ``REGION`` cells along each axis: a cell is copied to the regions that it touches, not to each neighbour, and a crowded region is
    dealt to up to ``SIDES`` tasks. The planner would take the copies for the points themselves, which it may broadcast; they are shuffled whatever their number.
    """
    axes, home = ("cx", "cy", "cz"), ("sx", "sy", "sz")
    region = lambda c: F.floor(c / REGION).cast("bigint")
    placed = points.select(key, F.col(id).alias("v"), "x", "y", "z", *[F.floor(F.col(c) / radius).cast("bigint").alias(a) for c, a in zip("xyz", axes)]).dropna(subset=[key, "v", *axes])
    counts = cut(placed.groupBy(key, *axes).agg(F.count("*").alias("_n")))
    regions, most = counts.groupBy(key, *[region(F.col(a)).alias(s) for a, s in zip(axes, home)]).agg(F.sum("_n").alias("_n")).agg(F.count("*"), F.max("_n")).first()
    salts = max(1, min(SIDES, -(-(most or 0) // REGION_POINTS)))
    parts = counts.select(key, *axes, F.ceil(F.col("_n") / PACKED).alias("_parts"))
    packed = placed.join(parts.hint("merge"), [key, *axes]).groupBy(key, *axes, F.pmod(F.hash("v", "x", "y", "z"), F.col("_parts")).alias("_part")).agg(
        F.collect_list(F.struct("v", "x", "y", "z")).alias("_points"))

    number = min(MOST, 3 * max(1, regions) * salts)
    own = placed.select(key, *[region(F.col(a)).alias(s) for a, s in zip(axes, home)], F.pmod(F.hash("v", "x", "y", "z"), F.lit(salts)).alias("_salt"),
                        F.col("v").alias("_v"), *[F.col(c).alias(f"_{c}") for c in "xyz"], *[F.col(a).alias(f"_{a}") for a in axes])
    ahead = [o for o in product((0, 1, -1), repeat=3) if o >= (0, 0, 0)]
    touched = F.array_distinct(F.array(*[F.struct(*[region(F.col(a) - o).alias(s) for a, s, o in zip(axes, home, step)]) for step in ahead]))
    near = packed.select(key, *axes, F.col("_points").alias("_near"), F.inline(touched)).withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    # by number: a region is much work in few bytes, which adaptive execution would put into one task
    at = F.concat_ws("/", F.col(key).cast("string"), *home, "_salt")
    own = own.withColumn("_at", at).drop(*home, "_salt").repartition(number, "_at")
    near = near.withColumn("_at", at).drop(key, *home, "_salt").repartition(number, "_at")
    j = own.join(near.hint("merge"), "_at")
    dx, dy, dz = (F.col(a) - F.col(f"_{a}") for a in axes)
    follows = (dx > 0) | ((dx == 0) & ((dy > 0) | ((dy == 0) & (dz >= 0))))
    j = j.where((F.abs(dx) <= 1) & (F.abs(dy) <= 1) & (F.abs(dz) <= 1) & follows)
    same = (dx == 0) & (dy == 0) & (dz == 0)
    j = j.select(F.col(key).alias("graph"), same.alias("_same"), "_v", "_x", "_y", "_z", F.inline("_near"))
    d2 = sum((F.col(c) - F.col(f"_{c}")) * (F.col(c) - F.col(f"_{c}")) for c in "xyz")
    once = F.when(F.col("_same"), F.col("_v") < F.col("v")).otherwise(F.col("_v") != F.col("v"))
    j = j.where(once & (d2 < radius * radius)).select("graph", "_v", "v", F.sqrt(d2).alias("length"), F.explode(F.array(F.lit(False), F.lit(True))).alias("_back"))
    return j.select("graph", F.when(F.col("_back"), F.col("v")).otherwise(F.col("_v")).alias("src"), F.when(F.col("_back"), F.col("_v")).otherwise(F.col("v")).alias("dst"), "length")


def vertex_normals(vertices: DataFrame, faces: DataFrame, key: str = "mesh") -> DataFrame:
    """Unit sum of the face cross products at each vertex."""
    f = faces
    for n in ("0", "1", "2"):
        f = f.join(vertices.select(key, F.col("v").alias(f"v{n}"), *[F.col(c).alias(f"{c}{n}") for c in "xyz"]), [key, f"v{n}"])
    a = {c: F.col(f"{c}1") - F.col(f"{c}0") for c in "xyz"}
    b = {c: F.col(f"{c}2") - F.col(f"{c}0") for c in "xyz"}
    cross = {"nx": a["y"] * b["z"] - a["z"] * b["y"], "ny": a["z"] * b["x"] - a["x"] * b["z"], "nz": a["x"] * b["y"] - a["y"] * b["x"]}
    per = f.select(key, F.explode(F.array("v0", "v1", "v2")).alias("v"), *[c.alias(n) for n, c in cross.items()])
    s = per.groupBy(key, "v").agg(*[F.sum(n).alias(n) for n in cross])
    norm = F.greatest(F.sqrt(sum(F.col(n) ** 2 for n in cross)), F.lit(1e-10))
    return s.select(key, "v", *[(F.col(n) / norm).alias(n) for n in cross])


def vertex_features(normals: DataFrame, *extra: DataFrame, key: str = "mesh") -> DataFrame:
    """Normals with optional per-vertex measures beside them."""
    out = normals
    for e in extra:
        out = out.join(e, [key, "v"], "left")
    return out


def orientation(normals: DataFrame, mode: str = "fixed", key: str = "mesh") -> DataFrame:
    """Orientation constraint per vertex: the normal, the identity, or n n^T + 0.25 (I - n n^T)."""
    n = [F.col(c) for c in ("nx", "ny", "nz")]
    norm = F.greatest(F.sqrt(sum(c * c for c in n)), F.lit(1e-10))
    u = [c / norm for c in n]
    if mode == "fixed":
        o = F.array(*u)
    elif mode == "free":
        o = F.array(*[F.lit(float(i == j)) for i in range(3) for j in range(3)])
    elif mode == "loose":
        o = F.array(*[u[i] * u[j] + 0.25 * (float(i == j) - u[i] * u[j]) for i in range(3) for j in range(3)])
    else:
        raise ValueError(f"unknown orientation mode: {mode}")
    return normals.select(key, "v", o.alias("o"))


def _powers(r, exponent: float, pow_: Callable):
    """``r`` to the exponent, small whole ones as products; for columns and for arrays."""
    return reduce(lambda u, v: u * v, [r] * int(exponent)) if exponent in range(1, 9) else pow_(r, exponent)


def inverse_distance(points: DataFrame, exponent: float = 3.0, floor: float = 1e-3, key: str = "mesh") -> DataFrame:
    """Row-normalised 1 / sqrt(d^2 + floor^2)^exponent between all points of a mesh, zero diagonal.

    The result itself has one cell per pair of points. The pairs are made twice and never shuffled or written: chunks of points give the row sums, both ways at
    once; the cells are made from rows of up to ``PACKED`` points, dealt to up to ``SIDES`` rows and columns, whose squares are tasks of their own.
    """
    most = points.groupBy(key).count().agg(F.max("count")).first()[0] or 0
    sides = max(1, min(SIDES, -(-most // SIDE_POINTS)))
    parts = max(1, -(-most // (sides * PACKED)))

    def work(held: list[Chunk], b: Chunk, own: bool) -> Iterator[list[np.ndarray]]:
        def weights(x: np.ndarray) -> np.ndarray:
            d2 = np.full((len(x), len(b.x)), floor ** 2)
            for u, v in zip(x.T, b.x.T):
                diff = u[:, None] - v[None, :]
                d2 += diff * diff
            return 1 / _powers(np.sqrt(d2, out=d2), exponent, np.power)

        total = np.zeros(len(b.t))
        for a in [*held, b] if own else held:
            ahead = np.zeros(len(a.t))
            for lo in range(0, len(a.t), ROWS):
                w = weights(a.x[lo:lo + ROWS])
                if a is b:
                    w[a.t[lo:lo + ROWS, None] == b.t[None, :]] = 0.0
                else:
                    ahead[lo:lo + ROWS] = w.sum(axis=1)
                total += w.sum(axis=0)
            if a is not b:
                yield [a.t, ahead]
        yield [b.t, total]

    named = points.where(F.col(key).isNotNull() & F.col("v").isNotNull())
    whole = isinstance(points.schema["v"].dataType, T.IntegralType)
    ids = None if whole else cut(named.select(key, "v").distinct().withColumn("t", F.monotonically_increasing_id()))
    numbers = named.withColumn("t", F.col("v").cast("bigint")) if whole else named.join(ids, [key, "v"])
    usable = numbers.where("x IS NOT NULL AND y IS NOT NULL AND z IS NOT NULL")
    found = compared(usable.select(key, "t", F.array(*[F.col(c).cast("double") for c in "xyz"]).alias("x")), key, PACKED // 8, work, "t bigint, _w double")
    every_point = numbers.select(key, "t", F.lit(0.0).alias("_w"))
    sums = found.unionByName(every_point).groupBy(key, "t").agg(F.greatest(F.sum("_w"), F.lit(1e-10)).alias("_s"))
    sums = cut(sums.withColumnRenamed("t", "v") if whole else sums.join(ids, [key, "t"]).drop("t"))

    own, every = F.pmod(F.xxhash64("v"), F.lit(sides)), F.explode(F.sequence(F.lit(0), F.lit(sides - 1)))
    a = points.join(sums, [key, "v"]).select(key, F.col("v").alias("i"), *[F.col(c).alias(f"_{c}") for c in "xyz"], "_s", own.alias("_row")).withColumn("_col", every)
    packed = points.where(F.col("v").isNotNull()).groupBy(key, own.alias("_col"), F.pmod(F.hash("v", "x", "y", "z"), F.lit(parts)).alias("_part")).agg(
        F.collect_list(F.struct(F.col("v").alias("j"), "x", "y", "z")).alias("_points"))
    b = packed.select(key, "_col", "_points", every.alias("_row"))

    def dealt(rows: DataFrame) -> DataFrame:
        # by number: a square is much work in few bytes, which adaptive execution would put into one task
        at = F.concat_ws("/", F.col(key).cast("string"), "_row", "_col")
        return rows.where(F.col(key).isNotNull()).withColumn("_at", at).drop("_row", "_col").repartition(sides * sides, "_at")

    met = dealt(a).join(dealt(b).drop(key).hint("shuffle_hash"), "_at")
    cells = met.select(key, "i", *[f"_{c}" for c in "xyz"], "_s", F.inline("_points")).where("i <> j")
    d2 = sum((F.col(c) - F.col(f"_{c}")) * (F.col(c) - F.col(f"_{c}")) for c in "xyz")
    w = 1 / _powers(F.sqrt(d2 + floor ** 2), exponent, F.pow)
    return cells.select(key, "i", "j", (w / F.col("_s")).alias("v"))


# ----------------------------------------------------------------------- lesions


GraphFunction = Callable[[DataFrame, Sequence[str]], DataFrame]


def lesioned_edges(edges: DataFrame, lesions: DataFrame, strength: float = 0.0) -> DataFrame:
    """The edges of every lesioned graph: ``graph, lesion, src, dst, weight``; each end inside a lesion scales the weight by ``strength``.

    ``lesions`` has rows ``lesion, region``, or ``graph, lesion, region`` where graphs have lesions of their own.
    """
    own = ["graph"] if "graph" in lesions.columns else []
    sets = lesions.groupBy(*own, "lesion").agg(F.collect_set("region").alias("regions")).groupBy(*own).agg(
        F.sort_array(F.collect_list(F.struct("lesion", "regions"))).alias("_l"))
    if not own:
        sets = edges.select("graph").distinct().join(F.broadcast(sets), how="inner")
    each = attach(edges, sets, ["graph"], ["src", "dst"]).select("graph", "src", "dst", "weight", F.explode("_l").alias("_l"))
    hit = lambda c: F.when(F.array_contains("_l.regions", F.col(c)), F.lit(float(strength))).otherwise(1.0)
    return each.select("graph", F.col("_l.lesion").alias("lesion"), "src", "dst", (F.col("weight") * hit("src") * hit("dst")).alias("weight"))


def lesion_sweep(edges: DataFrame, lesions: DataFrame, graph_function: GraphFunction, strength: float = 0.0) -> DataFrame:
    """Apply a user function of graphs once to the intact ones and once to all lesioned ones.

    The function gets ``keys, src, dst, weight`` and the names of the keys of a graph, and returns ``keys, region, t, value``;
    all lesions are rows of one plan. The output carries the absolute ``difference`` to the intact result.
    """
    intact = graph_function(edges.select("graph", "src", "dst", "weight"), ["graph"]).select("graph", "region", "t", F.col("value").alias("intact"))
    done = graph_function(lesioned_edges(edges, lesions, strength), ["graph", "lesion"])
    # all lesions of a region meet its intact value, so that value is attached rather than joined by its key
    return attach(done, intact, ["graph", "region", "t"], ["lesion"]).select(
        "graph", "lesion", "region", "t", "intact", F.col("value").alias("lesioned"), F.abs(F.col("intact") - F.col("value")).alias("difference"))


def contribution_matrix(effects: DataFrame, metric: str = "mean_abs") -> DataFrame:
    """Effect of each lesion per time: mean or largest difference, or the deviation across regions."""
    agg = {"mean_abs": F.avg("difference"), "max_abs": F.max("difference"),
           "gfp": F.stddev_pop(F.col("intact") - F.col("lesioned"))}
    if metric not in agg:
        raise ValueError(f"unknown metric: {metric}")
    return effects.groupBy("graph", F.col("lesion").alias("region"), "t").agg(agg[metric].alias("value"))
