"""SimHash near-duplicates by anchor-point covering.

Anchors are the words of a covering code: the product of two perfect Golay codes over bits 0-22 and 23-45 of a 64-bit fingerprint (every
23-bit word lies within 3 bits of exactly one code word; the other 18 bits are free, the code ignores them). Fingerprints at 3 or fewer
differing bits have a point between them, one bit from the one and two bits from the other; that point has an anchor within the covering
radius. So a fingerprint goes to every anchor within covering radius plus 2 of it, is marked as near where covering radius plus 1 suffices,
and each anchor compares its near fingerprints with all of its own. No pair is missed, and none is found that the exact comparison
of all 64 bits does not confirm.
"""

from __future__ import annotations

from functools import cache
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from ondula.llm.common import components, smallest_labels, units, written

SHINGLE = 3
SEED = 42
THRESHOLD = 3
BITS, CHECK = 23, 11
#: Fixed value: the generator polynomial of the [23, 12] Golay code.
GENERATOR = 0b110001110101
#: Members of an anchor that one comparison takes.
CROWD = 20000
#: Members up to which all near pairs of an anchor are listed at once; beyond, they are walked from pivot to pivot.
LISTED = 128


def fingerprint_of(text: str | None) -> int:
    """The signed 64-bit fingerprint of a text: a bit is set if it is set in over half of its shingles' hashes."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    k = min(SHINGLE, len(words))
    h = xxhash.xxh64_intdigest
    hashes = np.array([h(joined[a:b], SEED) for a, b in zip(starts[: len(words) - k + 1].tolist(), ends[k - 1:].tolist())], dtype="<u8")
    ones = np.zeros(64, np.int64)
    for part in np.array_split(hashes, max(1, len(hashes) // 65536)):
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<i8")[0])


@F.pandas_udf(LongType())
def _fingerprint(text: pd.Series) -> pd.Series:
    return pd.Series([fingerprint_of(t) for t in text], dtype="int64")


def fingerprints(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with ``fingerprint`` (signed long); ASCII letters are lowered, null and empty texts have 0."""
    return docs.withColumn("fingerprint", _fingerprint(F.col(text)))


def _remainders(words: np.ndarray) -> np.ndarray:
    """The 11-bit remainders of 23-bit words by the generator: 0 for words of the code."""
    r = words.copy()
    for bit in range(BITS - 1, CHECK - 1, -1):
        r ^= np.where((r >> bit) & 1, GENERATOR << (bit - CHECK), 0).astype(r.dtype)
    return r


@cache
def _cosets() -> tuple:
    """For e = 0, 1, 2 flips: start and length per remainder in the list of vectors with which a word reaches the anchors that e flips reach,
    and fewer do not. The first list has one vector each: the code is perfect."""
    out = []
    for weights in ((0, 1, 2, 3), (4,), (5,)):
        v = np.array([sum(1 << b for b in c) for w in weights for c in combinations(range(BITS), w)], np.int64)
        r = _remainders(v)
        order = np.argsort(r, kind="stable")
        count = np.bincount(r, minlength=1 << CHECK)
        out.append((np.cumsum(count) - count, count, v[order]))
    return tuple(out)


def _spread(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Anchors of each fingerprint: (anchor, row, near)."""
    bits = fps.view(np.uint64)
    lo, hi = (bits & np.uint64((1 << BITS) - 1)).astype(np.int64), ((bits >> np.uint64(BITS)) & np.uint64((1 << BITS) - 1)).astype(np.int64)
    rl, rh = _remainders(lo), _remainders(hi)
    sets = _cosets()
    anchors, rows, near = [], [], []
    for e in range(3):
        for f in range(3 - e):
            (s1, n1, v1), (s2, n2, v2) = sets[e], sets[f]
            a, b = n1[rl], n2[rh]
            row = np.repeat(np.arange(len(fps)), a * b)
            k = np.arange(len(row)) - np.repeat(np.cumsum(a * b) - a * b, a * b)
            one = lo[row] ^ v1[s1[rl[row]] + k // b[row]]
            two = hi[row] ^ v2[s2[rh[row]] + k % b[row]]
            anchors.append((one >> CHECK) << (BITS - CHECK) | (two >> CHECK))
            rows.append(row)
            near.append(np.full(len(row), e + f <= 1))
    return np.concatenate(anchors), np.concatenate(rows), np.concatenate(near)


def _anchored(batches):
    for batch in batches:
        fps = batch.column(0).to_numpy(zero_copy_only=False)
        for part in np.array_split(fps, max(1, len(fps) // 2048)):
            anchor, row, near = _spread(np.ascontiguousarray(part))
            yield pa.RecordBatch.from_arrays([pa.array(anchor.astype(np.int32)), pa.array(part[row]), pa.array(near)],
                                             names=["anchor", "fp", "near"])


def _differ(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count((a ^ b).view(np.uint64))


def _compare(batches):
    """Links per anchor from rows (unit, fp, near) that are sorted by unit: for each linked fingerprint one link to the smallest of its
    component within the unit. A unit may span batches; it is held until it ends."""
    unit, fp, near = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, bool)
    for batch in batches:
        unit = np.concatenate([unit, batch.column(0).to_numpy(zero_copy_only=False)])
        fp = np.concatenate([fp, batch.column(1).to_numpy(zero_copy_only=False)])
        near = np.concatenate([near, batch.column(2).to_numpy(zero_copy_only=False)])
        if not len(unit):
            continue
        end = np.searchsorted(unit, unit[-1])
        if end:
            yield _links(unit[:end], fp[:end], near[:end])
            unit, fp, near = unit[end:], fp[end:], near[end:]
    if len(unit):
        yield _links(unit, fp, near)


def _links(unit: np.ndarray, fp: np.ndarray, near: np.ndarray) -> pa.RecordBatch:
    first = np.flatnonzero(np.concatenate([[True], unit[1:] != unit[:-1]]))
    size = np.diff(np.append(first, len(unit)))
    start, length = np.repeat(first, size), np.repeat(size, size)
    a, b = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    seeds = np.flatnonzero(near & (length > 1) & (length <= LISTED))
    for part in np.array_split(seeds, max(1, int(length[seeds].sum()) // (1 << 21))):
        i = np.repeat(part, length[part])
        j = np.arange(len(i)) - np.repeat(np.cumsum(length[part]) - length[part], length[part]) + start[i]
        hit = (_differ(fp[i], fp[j]) <= THRESHOLD) & (i != j)
        a.append(i[hit])
        b.append(j[hit])
    for s, n in zip(first[size > LISTED].tolist(), size[size > LISTED].tolist()):
        for i, j in _walk(fp[s:s + n]):
            a.append(i + s)
            b.append(j + s)
    a, b = np.concatenate(a), np.concatenate(b)
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    label = smallest_labels(len(nodes), at[: len(a)], at[len(a):])
    pairs = np.unique(np.stack([fp[nodes], fp[nodes[label]]], 1), axis=0) if len(nodes) else np.empty((0, 2), np.int64)
    pairs = pairs[pairs[:, 0] != pairs[:, 1]]
    return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0], pa.int64()), pa.array(pairs[:, 1], pa.int64())], names=["u", "v"])


def _walk(fps: np.ndarray):
    """Links that join every component of a crowded anchor: each point meets only those that no earlier point has reached."""
    left = np.arange(1, len(fps))
    queue = [0]
    while queue:
        i = queue.pop()
        hit = _differ(fps[left], fps[i]) <= THRESHOLD
        found, left = left[hit], left[~hit]
        if len(found):
            yield np.full(len(found), i), found
            queue.extend(found.tolist())
        if not queue and len(left):
            queue, left = [int(left[0])], left[1:]


def links(fps: DataFrame) -> DataFrame:
    """Links (u, v) that connect all fingerprints of ``fps(fp)`` (distinct longs) at ``THRESHOLD`` or fewer differing bits."""
    placed = fps.mapInArrow(_anchored, "anchor int, fp long, near boolean")
    met = units(placed, "anchor", "fp", CROWD).select("unit", "fp", "near")
    return met.repartition("unit").sortWithinPartitions("unit").mapInArrow(_compare, "u long, v long")


def _classes(own: DataFrame, key: str) -> DataFrame:
    """(fingerprint, root, component_id) of the fingerprints of rows with a key: ``root`` names the class, ``component_id`` is its smallest key."""
    classes = written(own.where(F.col(key).isNotNull()).groupBy("fingerprint").agg(F.min(key).alias("rep")))
    linked = components(links(classes.select(F.col("fingerprint").alias("fp"))))
    linked = written(classes.join(linked, F.col("node") == F.col("fingerprint")).select("fingerprint", "rep", "root"))
    smallest = linked.groupBy("root").agg(F.min("rep").alias("component_id"))
    joined = written(linked.join(written(smallest), "root").select("fingerprint", "root", "component_id"))
    return written(classes.join(joined, "fingerprint", "left").select(
        "fingerprint", F.coalesce("root", "fingerprint").alias("root"), F.coalesce("component_id", "rep").alias("component_id")))


def near_duplicates(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, fingerprint, component_id) of every row: the smallest key reachable by links, its own included.

    Copies have one fingerprint and are compared once, however many there are. Null and empty texts have fingerprint zero and are linked
    like any other. Rows without a key get a fingerprint and a null component and link nothing. Rows that repeat a key are given back
    each with the class of its own text. An empty table gives an empty result; other columns are not read.
    """
    own = written(fingerprints(docs.select(key, text), text).select(key, "fingerprint"))
    return own.join(_classes(own, key).drop("root"), "fingerprint", "left").select(
        key, "fingerprint", F.when(F.col(key).isNotNull(), F.col("component_id")).alias("component_id"))


def deduplicated(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """One document of each class, the one with the smallest key, its columns as they were; rows without a key stay.

    Texts of different classes stay, whether they share a key or not. Of rows of a class that share the smallest key one is kept, the first by
    fingerprint, by the digest of the text and by a hash of all columns, so reruns agree.
    """
    digest = F.md5(F.coalesce(F.col(text), F.lit("")).cast("binary"))
    own = written(fingerprints(docs.select(key, text), text).select(key, digest.alias("__digest"), "fingerprint"))
    classes = own.where(F.col(key).isNotNull()).join(_classes(own, key), "fingerprint").where(F.col(key) == F.col("component_id"))
    kept = classes.groupBy("root").agg(F.min(F.struct("fingerprint", "__digest", key)).alias("__first"))
    kept = written(kept.select(F.col("__first")[key].alias(key), F.col("__first.__digest").alias("__digest")))
    found = docs.withColumn("__digest", digest).join(kept, [key, "__digest"], "left_semi")
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    one = found.groupBy(key, "__digest").agg(F.min_by(row, F.xxhash64(*[F.col(f"`{c}`") for c in docs.columns])).alias("__row")).select("__row.*")
    return one.unionByName(docs.where(F.col(key).isNull()))
