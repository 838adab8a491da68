"""Joins: lookups, intervals, as-of, overlaps and spatial filters."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ondula.operators import ordered
from ondula.operators.gram import collect_matrix, matrix_of

SMALL = 5_000_000  # cells; a block of weights of this size (40 MB) is sent to every executor at a time


def map_with_labels(voxels: DataFrame, seg: DataFrame, on: Sequence[str]) -> DataFrame:
    """Parameter value and label at the same voxel."""
    return voxels.join(seg, list(on), "inner")


def shape_mismatch(voxels: DataFrame, seg: DataFrame, on: Sequence[str]) -> DataFrame:
    """Count of voxel positions that only one side has; both 0 when the shapes agree."""
    a = voxels.select(*on).distinct().withColumn("_a", F.lit(1))
    b = seg.select(*on).distinct().withColumn("_b", F.lit(1))
    j = a.join(b, list(on), "full_outer")
    return j.agg(F.count(F.when(F.col("_b").isNull(), 1)).alias("only_map"),
                 F.count(F.when(F.col("_a").isNull(), 1)).alias("only_labels"))


def label_lookup(labels: DataFrame, dim: DataFrame, key: str = "label_id", value: str = "sigma") -> DataFrame:
    """Value of the label, 0 for an unknown one. Catalyst broadcasts the dimension when it is small."""
    return labels.join(dim.select(key, value), key, "left").withColumn(value, F.coalesce(value, F.lit(0.0)))


def with_label_in(voxels: DataFrame, members: DataFrame, key: str = "label_id") -> DataFrame:
    return voxels.join(members.select(key).distinct(), key, "left_semi")


def without(all_rows: DataFrame, bad: DataFrame, on: Sequence[str]) -> DataFrame:
    return all_rows.join(bad.select(*on), list(on), "left_anti")


def merge_features(*sets: DataFrame) -> DataFrame:
    """Long feature tables of one subject side by side; modality names joined with ``+``."""
    whole = sets[0]
    for s in sets[1:]:
        whole = whole.unionByName(s)
    modality = F.array_join(F.array_sort(F.collect_set("modality")), "+").alias("modality")
    return whole.groupBy("subject", "name").agg(F.first("value").alias("value"), modality)


def wide_features(*sets: DataFrame, names: Sequence[str]) -> DataFrame:
    whole = sets[0].select("subject", "name", "value")
    for s in sets[1:]:
        whole = whole.unionByName(s.select("subject", "name", "value"))
    return whole.groupBy("subject").pivot("name", list(names)).agg(F.first("value"))


def interval_join(points: DataFrame, spans: DataFrame, keys: Sequence[str], time: str, start: str, end: str,
                  width: float, closed: bool = True) -> DataFrame:
    """Points inside ``[start, end]`` of the spans with equal ``keys``.

    A span is copied to each coarse bucket of ``width`` it touches and a point
    has one bucket, so the join is an equi-join that meets every pair once.
    """
    b = lambda c: F.floor(F.col(c) / F.lit(width)).cast("bigint")
    left = points.withColumn("_b", b(time))
    right = spans.withColumn("_b", F.explode(F.sequence(b(start), b(end))))
    inside = (F.col(time) >= F.col(start)) & ((F.col(time) <= F.col(end)) if closed else (F.col(time) < F.col(end)))
    return left.join(right, [*keys, "_b"]).where(inside).drop("_b")


def epochs(samples: DataFrame, events: DataFrame, tmin: float, tmax: float, keys: Sequence[str] = ("recording",),
           time: str = "time") -> DataFrame:
    """Samples from onset + tmin to onset + tmax, with the relative time ``rel``."""
    spans = events.withColumn("_a", F.col("onset") + tmin).withColumn("_z", F.col("onset") + tmax)
    out = interval_join(samples, spans, keys, time, "_a", "_z", max(tmax - tmin, 1e-9))
    return out.withColumn("rel", F.col(time) - F.col("onset")).drop("_a", "_z")


def evoked_window(frames: DataFrame, onset: float, dt: float, pre: float, post: float, order: str = "t") -> DataFrame:
    """Frames [int((onset - pre) / dt), int((onset + post) / dt)), clamped to the recording."""
    a, z = max(0, int((onset - pre) / dt)), int((onset + post) / dt)
    return frames.where((F.col(order) >= a) & (F.col(order) < z))


def boxcar(events: DataFrame, n_volumes: int, tr: float) -> DataFrame:
    """Volumes inside [int(onset / TR), int((onset + duration) / TR)) of any event; ``baseline`` is skipped."""
    a = (F.col("onset") / tr).cast("bigint")
    z = F.least(((F.col("onset") + F.col("duration")) / tr).cast("bigint"), F.lit(n_volumes)) - 1
    on = events.where("trial_type <> 'baseline'").where(z >= a).select(
        F.col("trial_type").alias("condition"), F.explode(F.sequence(a, z)).alias("t")).distinct()
    grid = events.where("trial_type <> 'baseline'").select(F.col("trial_type").alias("condition")).distinct().withColumn(
        "t", F.explode(F.sequence(F.lit(0), F.lit(n_volumes - 1)).cast("array<bigint>")))
    return grid.join(on.withColumn("value", F.lit(1.0)), ["condition", "t"], "left").fillna(0.0, ["value"])


def design_regressors(events: DataFrame, kernel: Sequence[float], n_volumes: int, tr: float) -> DataFrame:
    """Event boxcars convolved with a kernel, cut to the run and demeaned."""
    taps = F.array(*[F.struct(F.lit(i).alias("lag"), F.lit(float(h)).alias("h")) for i, h in enumerate(kernel)])
    box = boxcar(events, n_volumes, tr).select("condition", "t", "value", F.inline(taps))
    conv = box.groupBy("condition", (F.col("t") + F.col("lag")).alias("t")).agg(F.sum(F.col("value") * F.col("h")).alias("value"))
    conv = conv.where(F.col("t") < n_volumes)
    mean = conv.groupBy("condition").agg(F.avg("value").alias("_m"))
    return conv.join(mean, "condition").select("condition", "t", (F.col("value") - F.col("_m")).alias("value"))


def nearest_distance(points: DataFrame, targets: DataFrame, keys: Sequence[str], order: str = "t",
                     block: int = ordered.BLOCK) -> DataFrame:
    """Distance from each point to the nearest target; an as-of join in both directions."""
    keys = list(keys)
    both = points.select(*keys, order, F.lit(None).cast("bigint").alias("_t"), F.lit(1).alias("_p")).unionByName(
        targets.select(*keys, order, F.col(order).cast("bigint").alias("_t"), F.lit(0).alias("_p")))
    # targets sort before points of the same time, so an exact hit is found looking back
    back = ordered.fill(both, keys, order, "_t", "_before", tie=["_p"], block=block)
    both = ordered.fill(back, keys, order, "_t", "_after", ahead=True, tie=["_p"], block=block)
    gap = F.least(F.col(order) - F.col("_before"), F.col("_after") - F.col(order))
    return both.where("_p = 1").select(*keys, order, gap.alias("distance"))


def apply_weights(samples: DataFrame, weights: DataFrame, keys: Sequence[str] = ("recording", "t")) -> DataFrame:
    """S = W X on long samples: ``weights`` has cells (source i, channel j, v)."""
    w = weights.select(F.col("i").alias("source"), F.col("j").alias("channel"), "v")
    return samples.join(w, "channel").groupBy(*keys, "source").agg(F.sum(F.col("v") * F.col("value")).alias("value"))


def project_frames(frames: DataFrame, weights: DataFrame | np.ndarray, offset: np.ndarray | None = None,
                   x: str = "x") -> DataFrame:
    """S = W (x - offset) on array frames, one matrix product per Arrow batch.

    A table of weights is sent in blocks of sources of at most ``SMALL`` cells;
    each block appends its sources to the frames.
    """
    if isinstance(weights, DataFrame):
        size = weights.agg(F.count("*"), F.max("i"), F.max("j")).first()
        if size[0] > SMALL:
            step = max(1, SMALL // (size[2] + 1))
            out = frames.withColumn("_s", F.array().cast("array<double>"))
            for lo in range(0, size[1] + 1, step):
                rows = min(step, size[1] + 1 - lo)
                part = weights.where(F.col("i").between(lo, lo + rows - 1)).withColumn("i", F.col("i") - lo)
                w = collect_matrix(part, "v", rows, size[2] + 1)
                out = project_frames(out.withColumn("_p", F.col(x)), w, offset, "_p").withColumn("_s", F.concat("_s", "_p")).drop("_p")
            return out.withColumn(x, F.col("_s")).drop("_s")
        w = collect_matrix(weights, "v")
    else:
        w = np.asarray(weights, dtype=float)
    mu = np.zeros(w.shape[1]) if offset is None else np.asarray(offset, dtype=float)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            s = (matrix_of(b.column(pos)) - mu) @ w.T
            out = pa.ListArray.from_arrays(np.arange(len(s) + 1, dtype=np.int32) * s.shape[1], pa.array(s.ravel()))
            cols = [out if n == x else b.column(k) for k, n in enumerate(names)]
            yield pa.RecordBatch.from_arrays(cols, names=names)

    names = frames.columns
    pos = names.index(x)
    return frames.mapInArrow(run, frames.schema)


def mask_overlap(a: DataFrame, b: DataFrame, on: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """Dice, Jaccard, intersection and sizes of two voxel sets."""
    on, keys = list(on), list(keys)
    j = a.select(*keys, *on).distinct().withColumn("_a", F.lit(1)).join(
        b.select(*keys, *on).distinct().withColumn("_b", F.lit(1)), [*keys, *on], "full_outer")
    both = F.count(F.when(F.col("_a").isNotNull() & F.col("_b").isNotNull(), 1))
    out = j.groupBy(*keys).agg(both.alias("intersection"), F.count("_a").alias("n_a"), F.count("_b").alias("n_b"))
    total = F.col("n_a") + F.col("n_b")
    union = total - F.col("intersection")
    return out.withColumn("dice", F.when(total > 0, 2 * F.col("intersection") / total).otherwise(0.0)).withColumn(
        "jaccard", F.when(union > 0, F.col("intersection") / union).otherwise(0.0))


def region_overlap(nuclei: DataFrame, function_of: DataFrame, parcels: DataFrame, on: Sequence[str]) -> DataFrame:
    """Dice per hemisphere and functional group; nuclei labels map many-to-one to a group."""
    a = nuclei.join(function_of, ["hemi", "label_id"]).select("hemi", "region", *on)
    out = mask_overlap(a, parcels.select("hemi", "region", *on), on, ["hemi", "region"])
    return out.withColumn("dice", 2 * F.col("intersection") / (F.col("n_a") + F.col("n_b") + 1e-10)).drop("jaccard")


def match_components(a: DataFrame, b: DataFrame) -> list[tuple[int, int, float]]:
    """Greedy one-to-one match of mixing columns by absolute cosine.

    ``a`` and ``b`` have cells (channel i, component j, v). Only used ``b``
    columns are removed, so an ``a`` column may match twice. The scores are a
    components-by-components table; the greedy choice over it runs on the driver.
    """
    unit = lambda d, n: d.join(d.groupBy("j").agg((F.sqrt(F.sum(F.col("v") ** 2)) + 1e-10).alias("_n")), "j").select(
        "i", F.col("j").alias(n), (F.col("v") / F.col("_n")).alias(f"_{n}"))
    cos = unit(a, "ja").join(unit(b, "jb"), "i").groupBy("ja", "jb").agg(
        F.abs(F.sum(F.col("_ja") * F.col("_jb"))).alias("c"))
    cells = cos.select(F.col("ja").alias("i"), F.col("jb").alias("j"), "c")
    score = collect_matrix(cells, "c")
    pairs, left = [], score.copy()
    for _ in range(min(score.shape)):
        p = np.unravel_index(np.argmax(left), left.shape)
        pairs.append((int(p[0]), int(p[1]), float(score[p])))
        left[:, p[1]] = 0.0
    return pairs


def correct_pairs(fids: DataFrame, shifts: DataFrame, keys: Sequence[str], dwell: float) -> DataFrame:
    """Apply the correction estimated on the OFF transient of a pair to both edits of the same dynamic."""
    from ondula.functions.complex import shift_phase
    return fids.join(shifts.select(*keys, "dyn", "df", "dp"), [*keys, "dyn"]).withColumn(
        "s", shift_phase(F.col("s"), F.col("df"), F.col("dp"), F.col("n") * dwell)).drop("df", "dp")
