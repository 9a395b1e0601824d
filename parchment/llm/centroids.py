"""Centroid clustering of integer vectors: float32 products screen the centroids, exact integers settle what is close."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored

#: Components up to this size have squared distances that 64-bit integers hold (for 64 components).
NARROW = 1 << 26
#: Components up to this size have products that float32 holds.
SCREENED = 1 << 60
#: Half a unit in the last place of float32.
UNIT = 2.0**-24
#: Sums leave the tasks in limbs of so many bits.
LIMB = 32


@dataclass(frozen=True)
class Centroids:
    """Whole-number centroids, exact (`rows`), and as float32 and with squared lengths for the screening."""

    rows: list[list[int]]

    def __post_init__(self) -> None:
        most = [max(map(abs, c), default=0) for c in self.rows]
        set_ = lambda k, v: object.__setattr__(self, k, v)
        set_("wide", max(most, default=0) >= NARROW)
        set_("screened", np.array([m < SCREENED for m in most]))
        set_("floats", np.array([[float(x) if m < SCREENED else 0.0 for x in c] for c, m in zip(self.rows, most)], np.float32))
        set_("square", np.array([float(sum(x * x for x in c)) if m < SCREENED else 0.0 for c, m in zip(self.rows, most)]))
        set_("exact", np.array(self.rows, object if self.wide else np.int64))


def whole(values: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale * x) of doubles as whole numbers: int64 where all are narrow, else Python's own."""
    with np.errstate(over="ignore"):
        scaled = np.floor(values * scale)
    if not scaled.size or np.abs(scaled).max() < NARROW:
        return scaled.astype(np.int64)
    return np.array([[int(y) if np.isfinite(y) else int(x) * scale for x, y in zip(a, b)] for a, b in zip(values.tolist(), scaled.tolist())], object).reshape(values.shape)


def intervals(vectors: np.ndarray, centroids: Centroids) -> tuple[np.ndarray, np.ndarray]:
    """Bounds, a vector and centroid each, that enclose |c|^2 - 2 v.c, the squared distance but for |v|^2.

    v.c is a float32 product of n components, each rounded to float32 first: whatever the order of summation, its error is
    at most g * sum |v_i c_i| with g = m u / (1 - m u), m = n + 2 and u = UNIT, and that sum is at most |v| |c|. Whole
    numbers below SCREENED neither overflow nor underflow. What the doubles round here is within the last term.
    """
    m = (vectors.shape[1] + 2) * UNIT
    product = (vectors.astype(np.float32) @ centroids.floats.T).astype(np.float64)
    lengths = np.sqrt((vectors.astype(np.float64) ** 2).sum(1))[:, None] * np.sqrt(centroids.square)[None]
    error = 2 * m / (1 - m) * lengths
    error = error * (1 + 2.0**-30) + 2.0**-48 * (centroids.square + 2 * np.abs(product)) + 2.0**-30
    middle = centroids.square - 2 * product
    return middle - error, middle + error


def nearest(vectors: np.ndarray, centroids: Centroids) -> tuple[np.ndarray, np.ndarray]:
    """(number of the nearest centroid, squared distance): exact, the smaller number of equals."""
    n, k = len(vectors), len(centroids.rows)
    if vectors.dtype == object and n and max(map(abs, vectors.ravel())) >= SCREENED:
        close = np.ones((n, k), bool)
    else:
        low, high = intervals(vectors, centroids)
        low[:, ~centroids.screened], high[:, ~centroids.screened] = -np.inf, np.inf
        close = low <= high.min(1, keepdims=True)
    found = close.argmax(1)
    of = lambda v, c: ((v - centroids.exact[c]) ** 2).sum(1)
    best = of(vectors, found)
    several = close.sum(1) > 1
    for c in range(k):  # in order of numbers: only a smaller distance replaces
        at = np.flatnonzero(several & close[:, c] & (found != c))
        if len(at):
            d = of(vectors[at], np.full(len(at), c))
            less = (d < best[at]).astype(bool)
            found[at[less]], best[at[less]] = c, d[less]
    return found, best


def limbs(value: int) -> list[int]:
    """value as numbers of LIMB bits from the lowest, the last of which has the sign."""
    out = []
    while not -(1 << LIMB) <= value < 1 << LIMB:
        out.append(value & ((1 << LIMB) - 1))
        value >>= LIMB
    return [*out, value]


def _batches(batch, dims: int, scale: int):
    """(where, vectors) of a batch of (id, vector), the narrow ones in one, wide ones in another."""
    values = batch.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dims)
    with np.errstate(over="ignore"):
        narrow = np.abs(values * scale).max(1, initial=0) < NARROW - 1
    for at in (np.flatnonzero(narrow), np.flatnonzero(~narrow)):
        if len(at):
            yield at, whole(values[at], scale)


def kept_vectors(vectors: DataFrame, dims: int, id_col: str, vec_col: str) -> DataFrame:
    """(id, v) of the vectors of exactly `dims` components, none of them null, infinite or not a number."""
    good = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    v = F.col(vec_col)
    # the size is tested first; a null condition keeps nothing
    return vectors.select(F.col(id_col).alias("id"), v.alias("v")).where(F.when(F.size("v") == dims, F.forall("v", good)))


def first_centroids(kept: DataFrame, k: int, seed: int, scale: int) -> Centroids:
    """The k vectors of the least SHA-256 of `seed:id` in ascending order of it; equal ids by their components."""
    h = F.sha2(F.concat_ws(":", F.lit(str(seed)), F.coalesce(F.col("id").cast("string"), F.lit(""))), 256)
    rows = kept.select(h.alias("h"), "v").orderBy("h", "v").limit(k).collect()
    return Centroids([list(map(int, x)) for x in (whole(np.array([r["v"]], np.float64), scale)[0] for r in rows)])


def moved(kept: DataFrame, centroids: Centroids, dims: int, scale: int) -> Centroids:
    """Each centroid as the floors of its vectors' exact means; one without vectors stays.

    A task sums what it assigns and gives one number a centroid and component (in limbs of 32 bits, so that no sum
    overflows); these are summed over the tasks, and the driver gets k * (dims + 1) sums.
    """

    def sums(batches):
        import pyarrow as pa

        k = len(centroids.rows)
        total, wide, count = np.zeros((k, dims), np.int64), {}, np.zeros(k, np.int64)
        for batch in batches:
            for _, v in _batches(batch, dims, scale):
                found, _ = nearest(v, centroids)
                count += np.bincount(found, minlength=k)
                for c in np.unique(found).tolist():
                    s = v[found == c].sum(0)
                    if v.dtype == object:
                        wide[c] = wide.get(c, 0) + s
                    else:
                        total[c] += s
        out = []
        for c in np.flatnonzero(count).tolist():
            exact = [int(t) for t in total[c].astype(object) + wide.get(c, 0)]
            out += [(c, i, place, part) for i, x in enumerate([*exact, int(count[c])]) for place, part in enumerate(limbs(x))]
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out), (pa.int32(), pa.int32(), pa.int32(), pa.int64()))], names=["c", "i", "place", "part"])

    parts = kept.mapInArrow(sums, "c int, i int, place int, part long").groupBy("c", "i", "place").agg(F.sum("part").alias("part"))
    found: dict[tuple[int, int], int] = {}
    for r in parts.collect():
        found[r["c"], r["i"]] = found.get((r["c"], r["i"]), 0) + (r["part"] << (LIMB * r["place"]))
    return Centroids([[found[c, i] // found[c, dims] for i in range(dims)] if (c, dims) in found else old for c, old in enumerate(centroids.rows)])


def assigned(kept: DataFrame, centroids: Centroids, dims: int, scale: int) -> DataFrame:
    """id, cluster, distance (decimal; null beyond 38 digits) of each vector."""

    def assign(batches):
        import pyarrow as pa

        most = 10**38
        for batch in batches:
            cluster, distance = np.zeros(batch.num_rows, np.int32), [None] * batch.num_rows
            for at, v in _batches(batch, dims, scale):
                found, best = nearest(v, centroids)
                cluster[at] = found
                for i, d in zip(at.tolist(), best.tolist()):
                    distance[i] = str(d) if d < most else None
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(cluster), pa.array(distance, pa.string())], names=["id", "cluster", "distance"])

    kind = kept.schema["id"].dataType.simpleString()
    return kept.mapInArrow(assign, f"id {kind}, cluster int, distance string").withColumn("distance", F.col("distance").cast("decimal(38,0)"))


def fit(kept: DataFrame, k: int, rounds: int, dims: int, scale: int, seed: int) -> Centroids:
    """The centroids after `rounds` passes over kept."""
    centroids = first_centroids(kept, k, seed, scale)
    for _ in range(rounds if centroids.rows else 0):
        centroids = moved(kept, centroids, dims, scale)
    return centroids


def cluster(vectors: DataFrame, k: int = 8, rounds: int = 10, dims: int = 64, scale: int = 1024, seed: int = 3, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """One row a kept vector: id_col, cluster, distance (squared), cluster_inertia, inertia, centroid_sha256.

    Components become floor(scale * x); all that follows is exact. Vectors of another length, null ones and those with a
    null, infinite or not-a-number component are left out. Centroids are k * dims whole numbers, sent to the tasks; each
    round is one pass without a shuffle of vectors, over a table written once. With fewer vectors than k there are as many
    centroids; equal vectors give equal centroids, of which the smaller number gets the vectors; repeated rows count each;
    a null id is hashed as an empty text; an empty table gives an empty result; other columns are ignored. A distance or
    inertia beyond 64 bits, which takes components of 2^26 and more, is null; the assignment is exact even then.
    """
    kept = stored(kept_vectors(vectors, dims, id_col, vec_col), "vectors")
    centroids = fit(kept, k, rounds, dims, scale, seed)
    return with_inertia(kept, centroids, dims, scale).withColumnRenamed("id", id_col)


def with_inertia(kept: DataFrame, centroids: Centroids, dims: int, scale: int) -> DataFrame:
    """Each vector's cluster and distance, the sums of distances, and a digest of its centroid."""
    from hashlib import sha256

    spark = kept.sparkSession
    rows = stored(assigned(kept, centroids, dims, scale), "assigned")
    # a sum with a missing distance is missing
    total = lambda c: F.when(F.count(c) == F.count("*"), F.try_sum(c))
    sums = rows.groupBy("cluster").agg(F.count("*").alias("n"), total("distance").alias("s")).collect()  # k rows at most
    whole_sum = None if any(r["s"] is None for r in sums) else sum(int(r["s"]) for r in sums)
    fits = lambda x: None if x is None or x >= 2**63 else int(x)
    table = [(r["cluster"], fits(r["s"]), fits(whole_sum), sha256(",".join(map(str, centroids.rows[r["cluster"]])).encode()).hexdigest()) for r in sums]
    found = spark.createDataFrame(table, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return rows.join(F.broadcast(found), "cluster").select("id", "cluster", F.col("distance").try_cast("long").alias("distance"), "cluster_inertia", "inertia", "centroid_sha256")
