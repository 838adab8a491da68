"""Merkle manifest of a dataset: a tree of hashes per group, a tree over the groups, and a proof for every row.

Nodes carry nested-interval labels: the range of leaf ranks that they cover. Ranks run over all trees, so a label is unique on its level, and
what a label contains follows from numbers alone. The labels of a tree are cut into bands of levels; a node that ends a band and the
ranks below it are a bucket. Buckets are hashed side by side, band after band. Above the first band every bucket finds its
ancestors by a containment join on (level, start of the interval); the interval of a parent less that of a child is the
interval of the child's sibling. Within a bucket the same arithmetic finds the siblings of each leaf.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ondula.llm.common import look_up, source_key, written
from ondula.llm.embeddings import _bounds, _runs

#: Levels of a band: a bucket has up to 2^12 members.
BAND = 12
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
_STEPS = "array<struct<left: boolean, digest: string>>"
_NODES = "start long, n long, level int, lo long, hi long, digest string"


def field(value: Column) -> Column:
    """``-`` for null, else the number of UTF-8 bytes, ``:`` and the value."""
    s = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(s).cast("string"), F.lit(":"), s), F.lit("-"))


def digest_of(*values: Column) -> Column:
    """The digest of a leaf with these values."""
    return F.sha2(F.concat(*[field(v) for v in values]).cast("binary"), 256)


def folded(leaf: Column, proof: Column) -> Column:
    """The root to which a leaf's digest and a proof lead."""
    def step(own: Column, s: Column) -> Column:
        return F.sha2(F.when(s["left"], F.concat(s["digest"], own)).otherwise(F.concat(own, s["digest"])).cast("binary"), 256)

    return F.aggregate(proof, leaf, step)


def _h(s: str) -> str:
    return hashlib.sha256(s.encode()).hexdigest()


def _height(n: Column) -> Column:
    """Levels above the leaves of a tree of ``n``."""
    return F.when(n > 1, F.length(F.bin(n - 1))).otherwise(0)


def _begin(position: Column, start: Column, level) -> Column:
    """The start of the interval on ``level`` that holds ``position`` of the tree that begins at ``start``."""
    width = F.call_function("shiftleft", F.lit(1).cast("long"), level if isinstance(level, Column) else F.lit(level))
    return start + (position - start) - F.pmod(position - start, width)


def ranked(rows: DataFrame, tree: str, order: list[str]) -> DataFrame:
    """``rows`` with ``pos`` (rank over all trees in the order of ``tree`` and ``order``), ``start`` (the first rank of the row's tree) and ``n`` (rows of the tree).

    Rows are sorted in ranges that are written once; ranks are places in a range plus the rows of earlier ranges. A tree may span ranges.
    """
    dealt = rows.withColumn("__salt", F.monotonically_increasing_id())
    keys = [tree, *order, "__salt"]
    dealt = written(dealt.repartitionByRange(*keys).sortWithinPartitions(*keys).drop("__salt").withColumn("__id", F.monotonically_increasing_id()))
    dealt = dealt.withColumn("__part", F.shiftright("__id", 33)).withColumn("__at", F.col("__id").bitwiseAND((1 << 33) - 1))
    counts = written(dealt.groupBy("__part", tree).agg(F.count("*").alias("m"), F.min("__at").alias("first")))
    sizes = written(counts.groupBy("__part").agg(F.sum("m").alias("m")))
    before = F.sum("m").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1))  # one row per range
    offsets = written(sizes.select("__part", F.coalesce(before, F.lit(0)).cast("long").alias("__offset")))
    begun = look_up(counts, offsets, ["__part"], 16)
    trees = written(begun.groupBy(tree).agg(F.min(F.col("__offset") + F.col("first")).alias("start"), F.sum("m").alias("n")))
    out = look_up(look_up(dealt, offsets, ["__part"], 16), trees, [tree], 128)
    return out.withColumn("pos", F.col("__offset") + F.col("__at")).drop("__id", "__part", "__at", "__offset")


def _levels(digests: list[str], steps: int) -> list[list[str]]:
    """The digests of ``steps`` levels from given ones upward, themselves first."""
    out = [digests]
    for _ in range(steps):
        low = out[-1]
        out.append([_h("".join(low[i:i + 2])) for i in range(0, len(low), 2)])
    return out


def _hashed(base: int, band: int, whole: bool):
    """Nodes above the members of each bucket; members stand on level ``base``. The top ones only, unless ``whole``."""
    def emit(table: pa.Table):
        first, size = _bounds(table.column("unit").to_numpy())
        unit, start, n = (table.column(c).to_numpy() for c in ("unit", "start", "n"))
        digest = table.column("digest").to_pylist()
        rows: list[tuple] = []
        for a, m in zip(first.tolist(), size.tolist()):
            lo, begin, count = int(unit[a]), int(start[a]), int(n[a])
            steps = min(band, (count - 1).bit_length() - base)
            for s, level in enumerate(_levels(digest[a:a + m], steps)):
                if s == steps or whole and s:
                    width = 1 << base + s
                    rows.extend((begin, count, base + s, lo + j * width, min(lo + (j + 1) * width, begin + count), d) for j, d in enumerate(level))
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(
            zip(*rows), (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.string()))], names=["start", "n", "level", "lo", "hi", "digest"])

    return lambda batches: _runs(batches, emit, 5)


def _banded(members: DataFrame, base: int, band: int, whole: bool) -> DataFrame:
    """The nodes of the band above ``members`` (lo, start, n, digest), which stand on level ``base``."""
    unit = _begin(F.col("lo"), F.col("start"), base + band)
    dealt = members.select(unit.alias("unit"), "lo", "start", "n", "digest")
    return dealt.repartition("unit").sortWithinPartitions("unit", "lo").mapInArrow(_hashed(base, band, whole), _NODES)


def forest(leaves: DataFrame, band: int = BAND) -> tuple[DataFrame, DataFrame]:
    """(paths, roots) of trees with leaves (pos, start, n, digest).

    ``paths`` has for each bucket of the first band its first rank ``unit``, ``start`` and the steps from the bucket's top to the root; ``roots`` has
    (start, n, digest) of each tree.
    """
    tall = leaves.agg(F.max(_height(F.col("n")))).first()[0] or 0
    tops = written(_banded(leaves.withColumnRenamed("pos", "lo"), 0, band, False))
    roots = tops.where("level = 0 or lo = start and hi = start + n")
    buckets = tops
    nodes = open_ = tops.where("not (level = 0 or lo = start and hi = start + n)")
    for base in range(band, tall, band):
        above = written(_banded(open_, base, band, True))
        is_root = F.expr("lo = start and hi = start + n")
        roots = roots.unionByName(above.where(is_root))
        nodes = nodes.unionByName(above.where(~is_root))
        open_ = above.where(~is_root & (F.col("level") == base + band))
    paths = _paths(buckets, _with_kin(nodes), band)
    return written(paths), written(roots.select("start", "n", "digest"))


def _with_kin(nodes: DataFrame) -> DataFrame:
    """Every node that is not a root with its sibling's digest ('' if the parent covers no more) and whether that stands to the left."""
    nodes = written(nodes)
    parent = _begin(F.col("lo"), F.col("start"), F.col("level") + 1)
    end = F.least(parent + F.call_function("shiftleft", F.lit(1).cast("long"), F.col("level") + 1), F.col("start") + F.col("n"))
    left = F.col("lo") > parent
    rest = F.when(left, parent).when(F.col("hi") < end, F.col("hi"))
    other = nodes.select(F.col("level"), F.col("lo").alias("__rest"), F.col("digest").alias("kin"))
    own = nodes.select("level", "lo", "hi", left.alias("left"), rest.alias("__rest"))
    return written(own.join(other, ["level", "__rest"], "left").select("level", "lo", "hi", "left", F.coalesce("kin", F.lit("")).alias("kin")))


def _paths(buckets: DataFrame, nodes: DataFrame, band: int) -> DataFrame:
    """For each bucket: ``unit``, ``start`` and the siblings of its ancestors, itself included, from below, by containment of intervals."""
    height = _height(F.col("n"))
    levels = F.when(height > band, F.sequence(F.lit(band), height - 1)).otherwise(F.array().cast("array<int>"))
    inner = buckets.select(F.col("lo").alias("unit"), F.col("hi").alias("__hi"), "start", F.explode(levels).alias("level"))
    inner = inner.withColumn("lo", _begin(F.col("unit"), F.col("start"), F.col("level")))
    met = inner.join(nodes, ["level", "lo"]).where((F.col("lo") <= F.col("unit")) & (F.col("__hi") <= F.col("hi")))
    step = F.struct("level", "left", F.col("kin").alias("digest"))
    found = met.groupBy("unit").agg(F.array_sort(F.collect_list(step)).alias("steps"))  # one step per level
    path = F.transform(F.coalesce("steps", F.array()), lambda s: F.struct(s["left"].alias("left"), s["digest"].alias("digest")))
    return buckets.select(F.col("lo").alias("unit"), "start").join(found, "unit", "left").select("unit", "start", path.cast(_STEPS).alias("path"))


def _climbed(carried: list[str], band: int):
    """Leaves with their proofs. The first row of each bucket holds the path of its top, the others are its leaves."""
    def emit(table: pa.Table):
        first, size = _bounds(table.column("unit").to_numpy())
        n = table.column("n").to_numpy()
        digest = table.column("digest").to_pylist()
        path = table.column("path")
        left: list[bool] = []
        kin: list[str] = []
        ends = [0]
        for a, m in zip(first.tolist(), size.tolist()):
            upper = path[a].as_py()
            up_left, up_kin = [s["left"] for s in upper], [s["digest"] for s in upper]
            levels = _levels(digest[a + 1:a + m], min(band, (int(n[a + 1]) - 1).bit_length()) if m > 1 else 0)[:-1]
            for i in range(m - 1):
                for s, low in enumerate(levels):
                    own = i >> s
                    other = own - 1 if own & 1 else own + 1
                    left.append(bool(own & 1))
                    kin.append(low[other] if other < len(low) else "")
                left.extend(up_left)
                kin.extend(up_kin)
                ends.append(len(kin))
        leaf = np.ones(table.num_rows, bool)
        leaf[first] = False
        rows = table.filter(pa.array(leaf)).combine_chunks()
        steps = pa.StructArray.from_arrays([pa.array(left, pa.bool_()), pa.array(kin, pa.string())], names=["left", "digest"])
        proof = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), steps)
        yield from pa.table([*[rows.column(c) for c in carried], rows.column("digest"), rows.column("start"), proof],
                            names=[*carried, "digest", "start", "proof"]).to_batches()

    return lambda batches: _runs(batches, emit, 0)


def climbed(leaves: DataFrame, paths: DataFrame, carried: list[str], band: int = BAND) -> DataFrame:
    """(carried columns, digest, start, proof) of leaves (pos, start, n, digest, carried columns): the steps to the root, from below."""
    unit = _begin(F.col("pos"), F.col("start"), band)
    rows = leaves.select(unit.alias("unit"), "pos", "n", "digest", "start", F.lit(None).cast(_STEPS).alias("path"), *carried)
    blank = {f.name: f.dataType for f in rows.schema}
    tops = paths.select(*[F.col(c) if c in ("unit", "path") else F.lit(-1).cast("long").alias(c) if c == "pos" else F.lit(None).cast(blank[c]).alias(c) for c in rows.columns])
    both = rows.unionByName(tops).repartition("unit").sortWithinPartitions("unit", "pos")
    out = leaves.select(*carried, "digest", "start").schema.add("proof", blank["path"])
    return both.mapInArrow(_climbed(carried, band), out)


def manifest(docs: DataFrame, key: str = "doc_id", tree: str = "lang", fields: tuple[str, ...] = FIELDS, keep: tuple[str, ...] = (),
             band: int = BAND) -> DataFrame:
    """(key, kept columns, leaf, subroot, root, proof) of every row.

    A leaf is the digest of the row's ``fields``. Rows with the same ``tree`` value (null is one) make a tree in the order of ``key``, rows without one first and
    rows of equal keys by their leaves. Each two consecutive nodes, and a last one alone, become the digest of theirs until one is left, the
    subroot; a lone leaf is its own. The subroots make a tree in the same way, in the order of the values' UTF-8 bytes, null first; its top is the root. ``proof`` has a
    step for each level from the leaf to the root: the sibling's digest, '' where the node has none, and whether that stands to the left;
    ``folded(leaf, proof)`` gives the root. Rows may repeat; each copy is a leaf. An empty table gives an empty result. Columns of ``docs`` that are not named are
    not read. ``band`` levels are hashed in one bucket, so a task holds 2^``band`` digests at a time.
    """
    leaf = digest_of(*[F.col(f) for f in fields])
    rows = docs.select(F.col(key).alias("__key"), source_key(tree).alias("__tree"), leaf.alias("digest"), *[F.col(c).alias(f"__keep_{c}") for c in keep])
    carried = ["__key", *[f"__keep_{c}" for c in keep]]
    leaves = written(ranked(written(rows), "__tree", ["__key", "digest"]).select("pos", "start", "n", "digest", *carried))
    paths, roots = forest(leaves, band)
    tops = written(ranked(roots.select(F.lit(0).alias("__one"), F.col("start").alias("__start"), "digest"), "__one", ["__start"]))
    upper, root = forest(tops.select("pos", "start", "n", "digest"), band)
    tails = written(climbed(tops, upper, ["__start"], band).select(F.col("__start").alias("start"), F.col("digest").alias("subroot"), F.col("proof").alias("tail")))
    paths = look_up(paths, tails, ["start"], 4096).select("unit", F.concat("path", "tail").alias("path"))
    out = climbed(leaves, paths, carried, band)
    out = look_up(out, tails.select("start", "subroot"), ["start"], 128)
    (top,) = [r[0] for r in root.select("digest").collect()] or [None]
    return out.select(F.col("__key").alias(key), *[F.col(f"__keep_{c}").alias(c) for c in keep], F.col("digest").alias("leaf"), "subroot",
                      F.lit(top).cast("string").alias("root"), "proof")
