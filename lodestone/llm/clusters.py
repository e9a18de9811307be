"""Centroid clustering with Hamerly's bounds, in exact integers.

Each vector carries its centroid, an upper bound of the distance to it, and a lower bound of the distance to the second nearest; the table of
vectors is written anew each round, and only the last two are kept. When the centroids have moved, the upper bound grows by the drift of the own
centroid and the lower one shrinks by the greatest drift of any other. A vector whose upper bound is below its lower one, or below half the
way from its centroid to the next, stays without a scan; else the upper bound is made exact, and if that is not enough either the vector is
ambiguous and meets all centroids in integers. Bounds are doubles, widened by more than rounding can take; vectors at equal distance are
always ambiguous, so ties are decided by the scan, for the smaller number. Sums change only by the vectors that moved: these are added
and taken away in partial aggregates, so a cluster of a third of all vectors is no hot key. The driver holds the centroids and their sums.

Vectors that are null, of another length, or hold null or non-finite components take no part. A component x becomes floor(scale * x), held within
2^27 on either side, beyond which no squared distance fits 64 bits. Rows that repeat a vec_id are vectors of their own; a null vec_id never
starts a centroid while others are left. With fewer vectors than centroids each starts one; an empty table gives no rows. Other columns are ignored.
"""

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_stored, stored

LIMIT, SMALL = 1 << 27, 1 << 20  # below SMALL all sums of products of 2,048 components are exact in doubles
WIDER = 1e-9


def squares(v: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Squared distances of integer vectors, row against row, exact: by a product of matrices where doubles hold every sum, else in 64-bit integers."""
    if v.shape[1] <= 2048 and max(np.abs(v).max(initial=0), np.abs(c).max(initial=0)) <= SMALL:
        x, y = v.astype(np.float64), c.astype(np.float64)
        return ((x * x).sum(axis=1)[:, None] - 2 * (x @ y.T) + (y * y).sum(axis=1)).astype(np.int64)
    return np.stack([((v - row) ** 2).sum(axis=1) for row in c], axis=1)


def own_squares(v: np.ndarray, c: np.ndarray, of: np.ndarray) -> np.ndarray:
    return ((v - c[of]) ** 2).sum(axis=1)


def assign(v: np.ndarray, of: np.ndarray, upper: np.ndarray, lower: np.ndarray, centers: np.ndarray, drift: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """The nearest centroid of each vector and its bounds, from those of the round before (-1: none), and how many vectors met all centroids."""
    k = len(centers)
    of, upper, lower = of.copy(), upper.copy(), lower.copy()
    between = squares(centers, centers).astype(np.float64)
    np.fill_diagonal(between, np.inf)
    half = np.sqrt(between.min(axis=1)) / 2 * (1 - WIDER)
    most = np.argsort(drift)[::-1]
    others = np.full(k, drift[most[0]])
    others[most[0]] = drift[most[1]] if k > 1 else 0.0
    old = np.flatnonzero(of >= 0)
    upper[old] = (upper[old] + drift[of[old]]) * (1 + WIDER)
    lower[old] = (lower[old] - others[of[old]]) * (1 - WIDER)
    enough = np.full(len(v), -np.inf)
    enough[old] = np.maximum(half[of[old]], lower[old])
    near = np.flatnonzero((of >= 0) & ~(upper < enough))
    upper[near] = np.sqrt(own_squares(v[near], centers, of[near])) * (1 + WIDER)
    scan = np.flatnonzero(~(upper < enough))
    d = squares(v[scan], centers)
    best = d.argmin(axis=1)  # of equal ones the first
    of[scan] = best
    upper[scan] = np.sqrt(d[np.arange(len(scan)), best]) * (1 + WIDER)
    if k > 1:
        d[np.arange(len(scan)), best] = np.iinfo(np.int64).max
        lower[scan] = np.sqrt(d.min(axis=1)) * (1 - WIDER)
    else:
        lower[scan] = np.inf
    return of, upper, lower, len(scan)


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy().astype(np.int64).reshape(-1, dim)


def _round(centers: np.ndarray, drift: np.ndarray):
    """Of (vec_id, v, cluster, upper, lower): the same after a round, with the cluster before as `was`."""

    def run(batches):
        for b in batches:
            of, upper, lower, _ = assign(_matrix(b.column(1), centers.shape[1]), *(b.column(i).to_numpy() for i in (2, 3, 4)), centers, drift)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(of.astype(np.int32)), pa.array(upper), pa.array(lower), b.column(2)], ["vec_id", "v", "cluster", "upper", "lower", "was"])

    return run


def _last(centers: np.ndarray, drift: np.ndarray):
    """Of (vec_id, v, cluster, upper, lower): vec_id, cluster, distance."""

    def run(batches):
        for b in batches:
            v = _matrix(b.column(1), centers.shape[1])
            of, _, _, _ = assign(v, *(b.column(i).to_numpy() for i in (2, 3, 4)), centers, drift)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(of.astype(np.int32)), pa.array(own_squares(v, centers, of))], ["vec_id", "cluster", "distance"])

    return run


def _moved(state: DataFrame) -> list:
    """For each cluster and component: the change of the sum and of the number of vectors."""
    sides = F.explode(F.array(F.struct(F.col("cluster").alias("c"), F.lit(1).cast("long").alias("sign")), F.struct(F.col("was").alias("c"), F.lit(-1).cast("long").alias("sign"))))
    each = state.filter("cluster <> was").select("v", sides.alias("m")).filter("m.c >= 0").select("m.c", "m.sign", F.posexplode("v").alias("i", "x"))
    return each.groupBy("c", "i").agg(F.sum("sign").alias("n"), F.sum(F.col("sign") * F.col("x")).alias("s")).collect()


def cluster(table: DataFrame, dim: int = 64, k: int = 40, rounds: int = 5, scale: int = 256, seed: str = "2") -> tuple[DataFrame, list[list[int]]]:
    """vec_id, cluster, distance (squared) of every vector, as a stored table, and the final centroids. Centroids start as the k vectors with the smallest
    sha256 of `<seed>:<vec_id>`; each of the rounds assigns all vectors and sets every centroid that has some to the floor of their mean."""
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) != float("inf")))
    whole = F.transform("embedding", lambda x: F.floor(F.greatest(F.lit(float(-LIMIT)), F.least(F.lit(float(LIMIT)), F.lit(float(scale)) * x.cast("double")))).cast("int"))
    kept = table.filter((F.size("embedding") == dim) & finite).select("vec_id", whole.alias("v"))
    state = stored(kept.select("vec_id", "v", F.lit(-1).alias("cluster"), F.lit(float("inf")).alias("upper"), F.lit(0.0).alias("lower")), "clusters")
    kind = dict(state.dtypes)["vec_id"]
    rank = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")).cast("binary"), 256)
    centers = [r["v"] for r in state.select("v", rank.alias("h")).orderBy(F.col("h").asc_nulls_last(), "v").limit(k).collect()]
    if not centers:
        return state.select("vec_id", "cluster", F.lit(0).cast("long").alias("distance")), []
    counts, sums = [0] * len(centers), [[0] * dim for _ in centers]
    drift = np.zeros(len(centers))
    for _ in range(rounds):
        now = stored(state.select("vec_id", "v", "cluster", "upper", "lower").mapInArrow(_round(np.array(centers, np.int64), drift), f"vec_id {kind}, v array<int>, cluster int, upper double, lower double, was int"), "clusters")
        drop_stored(state)
        state = now
        for r in _moved(state):  # k * dim rows at most
            sums[r["c"]][r["i"]] += r["s"]
            counts[r["c"]] += r["n"] if r["i"] == 0 else 0
        new = [[s // n for s in total] if n else old for total, n, old in zip(sums, counts, centers)]
        step = np.array(new, np.int64) - np.array(centers, np.int64)
        drift, centers = np.sqrt((step * step).sum(axis=1)) * (1 + WIDER), new
    out = stored(state.select("vec_id", "v", "cluster", "upper", "lower").mapInArrow(_last(np.array(centers, np.int64), drift), f"vec_id {kind}, cluster int, distance long"), "clustered")
    drop_stored(state)
    return out, centers


def report(table: DataFrame, **options) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256 of cluster()'s result; an inertia beyond 64 bits is null."""
    found, centers = cluster(table, **options)
    spark = table.sparkSession
    digests = [(i, hashlib.sha256(",".join(map(str, c)).encode()).hexdigest()) for i, c in enumerate(centers)]
    names = spark.createDataFrame(digests, "cluster int, centroid_sha256 string")  # k rows
    totals = found.groupBy("cluster").agg(F.expr("try_sum(distance)").alias("cluster_inertia"))  # k rows
    whole = found.agg(F.expr("try_sum(distance)").alias("inertia"))  # one row
    return found.join(F.broadcast(totals), "cluster").join(F.broadcast(names), "cluster").crossJoin(F.broadcast(whole)).select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
