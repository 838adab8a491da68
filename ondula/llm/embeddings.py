"""Embedding near-duplicates: iterative quantisation, multi-index Hamming tables, exact rerank.

A rotation of the principal components is learnt so that the signs of the rotated vectors lose as little as possible; the signs are the code.
The code is cut into tables of b bits. In each table a vector stands under its own code and all codes one bit away, so two vectors meet there
if their codes differ in at most two bits. Vectors that meet, and whose whole codes are near, are compared by their original components.

b follows the number of vectors (a bucket holds about as many at every size). The number of tables follows b and the angle that a pair at the
threshold has where the codes see it, so that it meets with probability ``RECALL`` or more; pairs above the threshold meet more surely. That
angle is not the one of the vectors: codes are signs of vectors less their mean, and where vectors share a direction, all of them or a large
group, little is left beside it and the same distance is a wider angle. It is taken from the sample, for the vectors to which that happens most.
Where so little is left that the tables would be too many, the mean stays in and the angle is that of the vectors.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ondula.llm.common import components, smallest_labels, units, written

#: Vectors that the rotation is learnt from, the first by a hash, and a bound of their components.
SAMPLE_ROWS, SAMPLE_VALUES = 10_000, 1 << 22
#: Leading components that are turned together, and directions in which the sample is probed.
WIDTH, DIRECTIONS = 64, 4
ITERATIONS = 30
RECALL = 0.97
#: Words of code in a batch of places.
PLACED_VALUES = 1 << 22
#: Members of a bucket that one comparison takes.
CROWD = 4096
#: Standard deviations beyond its mean that the number of differing bits of a pair at the threshold may have.
SLACK = 3.5


def _meeting(p, b: int):
    """The probability that two codes of ``b`` bits, each of which differs with probability ``p``, meet in a table."""
    return sum(math.comb(b, k) * p**k * (1 - p) ** (b - k) for k in range(3))


def layout(n: int, p: float) -> tuple[int, int, int]:
    """(bits of a table, tables, most differing bits of a whole code) for n vectors and a share ``p`` of differing bits in a pair at the threshold."""
    b = min(28, max(8, round(math.log2(max(n, 2)))))
    tables = max(1, math.ceil(math.log(1 - RECALL) / math.log(max(1e-12, 1 - _meeting(p, b)))))
    bits = b * tables
    return b, tables, math.ceil(bits * p + SLACK * math.sqrt(bits * p * (1 - p)))


def geometry(x: np.ndarray, mean: np.ndarray, cosine: float) -> tuple[np.ndarray, float]:
    """(principal components of ``x - mean``, share of differing bits in a pair at ``cosine``) for the sample ``x``.

    A pair at the threshold is a unit vector of the sample and the vector at ``cosine`` from it towards the difference of two others. What
    is left of their distance where the bits are, less the mean and in the leading components, gives an angle between vectors as far from the
    mean as the first. The share is that of the tenth of the sample with the widest angles, but for a twentieth of it, and a half at most.
    """
    rng = np.random.default_rng(0)
    vectors = np.linalg.eigh((x - mean).T @ (x - mean))[1][:, ::-1][:, : min(x.shape[1], WIDTH)]
    z = (x - mean) @ vectors
    plain = math.acos(min(1.0, cosine)) / math.pi
    angles = []
    for _ in range(DIRECTIONS):
        w = x[rng.permutation(len(x))] - x[rng.permutation(len(x))]
        w -= (w * x).sum(1, keepdims=True) * x
        length = np.linalg.norm(w, axis=1, keepdims=True)
        step = (cosine - 1) * x + math.sqrt(max(0.0, 1 - cosine**2)) * w / np.where(length > 0, length, 1)
        turn = 1 - ((step @ vectors) ** 2).sum(1) / np.maximum(2 * (z**2).sum(1), 1e-12)
        angles.append(np.where(length[:, 0] > 1e-9, np.arccos(np.clip(turn, 0, 1)) / math.pi, plain))
    widest = np.sort(np.mean(angles, 0))[::-1]
    tenth = widest[len(widest) // 200 : max(1, len(widest) // 10) + len(widest) // 200]
    return vectors, max(plain, float(tenth.mean()))


def turned(v: np.ndarray, start: int) -> np.ndarray:
    """The rotation of ``v`` by iterative quantisation from a numbered start."""
    rotation = np.linalg.qr(np.random.default_rng(start).standard_normal((v.shape[1], v.shape[1])))[0]
    for _ in range(ITERATIONS):
        u, _, w = np.linalg.svd(np.where(v @ rotation > 0, 1.0, -1.0).T @ v)
        rotation = (u @ w).T
    return rotation


def learn(sample: np.ndarray, n: int, cosine: float) -> tuple[tuple[int, int, int], np.ndarray, np.ndarray]:
    """(layout for ``n`` vectors, mean, projection to signs): principal components turned by iterative quantisation, from as many starts as the bits need.

    Of codes without and with the mean those are taken that need the fewer words of code, counted over the places of a vector and the others
    that it meets there.
    """
    x = sample / np.linalg.norm(sample, axis=1, keepdims=True)
    plans = []
    for mean in (x.mean(0), np.zeros(x.shape[1])):
        main, p = geometry(x, mean, cosine)
        shape = b, tables, _ = layout(n, p)
        v = (x - mean) @ main
        rotation = turned(v, 0)
        bits = v @ rotation[:, :b] > 0
        met = (np.sum(bits != bits[np.random.default_rng(0).permutation(len(bits))], 1) <= 2).mean()
        plans.append((tables**2 * (b + 1 + n * float(met)), shape, mean, main, v, rotation))
    _, shape, mean, main, v, rotation = min(plans, key=lambda plan: plan[0])
    parts = [main @ rotation]
    while sum(p.shape[1] for p in parts) < shape[0] * shape[1]:
        parts.append(main @ turned(v, len(parts)))
    return shape, mean, np.concatenate(parts, 1)[:, : shape[0] * shape[1]]


def _matrix(column: pa.Array) -> np.ndarray:
    return np.asarray(column.flatten(), dtype=np.float64).reshape(len(column), -1)


def _codes(x: np.ndarray, mean: np.ndarray, projection: np.ndarray, b: int) -> np.ndarray:
    signs = (x / np.linalg.norm(x, axis=1, keepdims=True) - mean) @ projection > 0
    return (signs.reshape(len(x), -1, b) << np.arange(b)).sum(2).astype(np.int64)


def _placed(model, b: int):
    def place(batches):
        mean, projection = model.value
        flips = np.concatenate([[0], 1 << np.arange(b)])
        tables = projection.shape[1] // b
        step = max(1, PLACED_VALUES // (tables * tables * len(flips)))
        for batch in (whole.slice(k, step) for whole in batches for k in range(0, max(1, whole.num_rows), step)):
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            codes = _codes(_matrix(batch.column(1)), mean, projection, b) if len(ids) else np.empty((0, tables), np.int64)
            key = (codes[:, :, None] ^ flips | (np.arange(tables) << 32)[:, None]).reshape(-1)
            row = np.repeat(np.arange(len(ids)), tables * len(flips))
            own = codes[row].astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(row) + 1, dtype=np.int32) * tables), pa.array(own.reshape(-1)))
            yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(ids[row]), lists], names=["key", "id", "codes"])

    return place


def _canonical(a: np.ndarray, b: np.ndarray, key: int) -> np.ndarray:
    """Of pairs that meet in bucket ``key``: those for which it is the first place, of all that they share."""
    table, place = key >> 32, key & 0xFFFFFFFF
    differ = np.bitwise_count((a ^ b).astype(np.uint32))
    near = differ <= 2
    x, y = a[..., table], b[..., table]
    d = x ^ y
    low = d & -d
    first = np.where(d == 0, x, np.where(differ[..., table] == 1, np.minimum(x, y), np.minimum(x ^ low, y ^ low)))
    return near[..., table] & ~near[..., :table].any(-1) & (first == place)


def _runs(batches, emit, columns: int):
    """``emit`` for each run of equal units in rows that are sorted by unit, whatever the batches."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        unit = batch.column(0).to_numpy(zero_copy_only=False)
        edges = np.flatnonzero(np.diff(unit)) + 1
        if not len(edges) and held and held[-1].column(0)[0].as_py() == unit[0]:
            held.append(batch)
            continue
        last = int(edges[-1]) if len(edges) else 0
        done = pa.Table.from_batches([*held, batch.slice(0, last)]) if held or last else None
        if done is not None and done.num_rows:
            yield from emit(done.combine_chunks())
        held = [batch.slice(last)]
    if held:
        yield from emit(pa.Table.from_batches(held).combine_chunks())


def _bounds(unit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    first = np.flatnonzero(np.concatenate([[True], unit[1:] != unit[:-1]]))
    return first, np.diff(np.append(first, len(unit)))


def _column(table: pa.Table, name: str) -> np.ndarray:
    return table.column(name).to_numpy()


def _lists(table: pa.Table, name: str, kind) -> np.ndarray:
    return np.asarray(table.column(name).combine_chunks().flatten(), dtype=kind).reshape(table.num_rows, -1)


def _members(limit: int):
    """Rows of members that have a partner within ``limit`` differing bits in their unit."""
    def emit(table: pa.Table):
        first, size = _bounds(_column(table, "unit"))
        codes = _lists(table, "codes", np.int32)
        keep = np.zeros(table.num_rows, bool)
        small = (size > 1) & (size <= 64)
        start, length = first[small], size[small]
        seeds = np.concatenate([np.arange(s, s + n) for s, n in zip(start, length)]) if len(start) else np.empty(0, np.int64)
        s, n = np.repeat(start, length), np.repeat(length, length)
        for part in np.array_split(np.arange(len(seeds)), max(1, int(n.sum()) // (1 << 20))):
            i = np.repeat(seeds[part], n[part])
            j = np.arange(len(i)) - np.repeat(np.cumsum(n[part]) - n[part], n[part]) + np.repeat(s[part], n[part])
            hit = (np.bitwise_count((codes[i] ^ codes[j]).view(np.uint32)).sum(1) <= limit) & (i != j)
            keep[i[hit]] = True
        for a, m in zip(first[size > 64].tolist(), size[size > 64].tolist()):
            own = codes[a:a + m]
            for k in range(0, m, 256):
                far = np.bitwise_count((own[k:k + 256, None] ^ own[None]).view(np.uint32)).sum(2)
                keep[a + k:a + min(k + 256, m)] = (far <= limit).sum(1) > 1
        yield from table.filter(pa.array(keep)).to_batches()

    return lambda batches: _runs(batches, emit, 5)


def _linked(cosine: float):
    """For each unit: (id, number of links counted here) and (id, smallest linked id of its component within the unit)."""
    def emit(table: pa.Table):
        first, size = _bounds(_column(table, "unit"))
        key, own, other, ids, copies = (_column(table, c) for c in ("key", "own", "other", "id", "copies"))
        codes, x = _lists(table, "codes", np.int64), _lists(table, "embedding", np.float64)
        norm = np.linalg.norm(x, axis=1)
        who, root, links = [], [], []
        for a, m in zip(first[size > 1].tolist(), size[size > 1].tolist()):
            at = slice(a, a + m)
            tiles = own[at]
            mixed = own[a] != other[a]
            left, right = [], []
            for k in range(a, a + m, 256):
                rows = slice(k, min(k + 256, a + m))
                near = (x[rows] @ x[at].T) / (norm[rows, None] * norm[None, at]) >= cosine
                if mixed:
                    near &= own[rows, None] != tiles[None]
                i, j = np.nonzero(near)
                i, j = i + k, j + a
                ok = (i != j) & _canonical(codes[i], codes[j], int(key[a]))
                left.append(i[ok])
                right.append(j[ok])
            i, j = np.concatenate(left) - a, np.concatenate(right) - a
            if not len(i):
                continue
            label = smallest_labels(m, i, j)
            low = np.full(m, np.iinfo(np.int64).max)
            np.minimum.at(low, label, ids[at])
            count = np.bincount(i, copies[at][j], m).astype(np.int64)
            some = np.flatnonzero(count)
            who.append(ids[at][some])
            root.append(low[label[some]])
            links.append(count[some])
        if who:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(p)) for p in (who, root, links)], names=["u", "v", "links"])

    return lambda batches: _runs(batches, emit, 7)


def _valid(c: Column) -> Column:
    finite = F.forall(c, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))
    return F.coalesce(finite & F.exists(c, lambda v: v != 0), F.lit(False))


def near_duplicates(vectors: DataFrame, cosine: float = 0.9, key: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """(key, n_links, component_id, kept) of every row: the number of other vectors at ``cosine`` or more, the smallest key reachable.

    Vectors that are null, empty or zero, or hold null or non-finite components, and rows without a key link with nothing; so do vectors of
    different lengths. Equal vectors are compared once and counted as often as they occur. A pair is counted only at the first of the places where
    it meets, so counts need no list of pairs; what leaves a bucket is a count and one link per vector. Crowded buckets are dealt to tiles. No link
    below ``cosine`` is reported; of those above, the share that never meets is at most 1 - ``RECALL`` for codes of independent bits. An empty table gives
    an empty result; other columns are not read.
    """
    e = F.col(embedding)
    rows = written(vectors.select(key, e, _valid(e).alias("__ok"), F.xxhash64(e).alias("__a"), F.xxhash64(F.lit(1), e).alias("__b")))
    good = rows.where(F.col("__ok") & F.col(key).isNotNull())
    classes = written(good.groupBy("__a", "__b").agg(F.min(key).cast("long").alias("id"), F.count("*").alias("copies"), F.first(e).alias("embedding")))
    found = None
    for (size,) in classes.select(F.size("embedding").alias("n")).distinct().orderBy("n").collect():
        part = _links(classes.where(F.size("embedding") == size), size, cosine)
        found = part if found is None else found.unionByName(part)
    if found is None:
        nothing = rows.withColumn("n_links", F.lit(0).cast("long")).withColumn("component_id", F.col(key))
    else:
        found = written(found)
        roots = components(found.select("u", "v")).withColumnRenamed("node", "id")
        counts = found.groupBy(F.col("u").alias("id")).agg(F.sum("links").alias("links"))
        whole = classes.drop("embedding").join(counts, "id", "left").join(roots, "id", "left")
        whole = written(whole.select("__a", "__b", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n"), F.coalesce("root", "id").alias("root")))
        joined = rows.select(key, "__ok", "__a", "__b").join(whole, ["__a", "__b"], "left")
        linked = F.col("__ok") & F.col(key).isNotNull()
        nothing = joined.withColumn("n_links", F.when(linked, F.col("n")).otherwise(0).cast("long")).withColumn(
            "component_id", F.when(linked, F.col("root")).otherwise(F.col(key)).cast("long"))
    return nothing.select(key, "n_links", "component_id", F.coalesce(F.col(key) == F.col("component_id"), F.lit(False)).alias("kept"))


def _links(classes: DataFrame, size: int, cosine: float) -> DataFrame:
    sample = classes.orderBy("__a", "__b").limit(max(1, min(SAMPLE_ROWS, SAMPLE_VALUES // size))).select("embedding").collect()
    (b, _, limit), mean, projection = learn(np.array([r[0] for r in sample], float), classes.count(), cosine)
    model = classes.sparkSession.sparkContext.broadcast((mean, projection))
    placed = classes.select("id", "embedding").mapInArrow(_placed(model, b), "key long, id long, codes array<int>")
    met = units(placed, "key", "id", CROWD).select("unit", "key", "own", "other", "id", "codes")
    met = met.repartition("unit").sortWithinPartitions("unit").mapInArrow(
        _members(limit), "unit long, key long, own int, other int, id long, codes array<int>")
    full = met.join(classes.select("id", "copies", "embedding"), "id").select("unit", "key", "own", "other", "id", "copies", "codes", "embedding")
    return full.repartition("unit").sortWithinPartitions("unit").mapInArrow(_linked(cosine), "u long, v long, links long")
