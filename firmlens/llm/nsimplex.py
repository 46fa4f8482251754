"""K-means over integer vectors with an n-simplex filter.

Each vector's distances to a few pivots are taken once. Pivots and distances make a simplex: the vector becomes its apex, a point with one coordinate for
each pivot but the first, and its height over the base as the last one. For two apexes x and y the Euclidean distance of x and y is a lower bound of the
distance of the vectors, and the distance of x and of y mirrored at the base an upper bound. Apexes are written with the vectors; in each round a centroid whose
lower bound is above the least upper bound of a vector can't be its nearest, and only the others are compared, with exact integers.

Pivots are the first centroids and those that the rounds give on a bounded sample (the first `SAMPLE` vectors by hash), as far as `PIVOTS` goes: the base then lies
close to the centroids of every round, their heights are small, and the two bounds close. They are picked by greatest height, so that no coordinate of a pivot is above the height that it is divided by, and one that lies (almost) in the base of
those before it is left out. Bounds are widened by `slack`, far above what the rounding of 64-bit numbers changes, so that the filter never drops
the nearest centroid or one that ties with it.

Rounds are a pass over the written table: each task adds its vectors up by cluster, and a row for each cluster and component and task is summed up.

Defined results: vectors that are null, of another length than `DIMS`, or with a null, infinite or NaN component are left out; a null key is hashed as an
empty string; rows with equal keys are vectors each, and where they tie for a first centroid their components as bytes decide; a component
beyond 2**27 in size after scaling counts as that, so that every distance fits a long; sums of distances beyond the largest long count as that; with fewer vectors than centroids there are as many centroids as vectors; an empty table gives an
empty result; other columns are dropped.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from firmlens.llm.common import cut

DIMS = 64
SCALE = 64
LIMIT = 1 << 27
PIVOTS = 48
#: Vectors on which the rounds are tried for pivots: the first ones by hash.
SAMPLE = 2048
#: A pivot's least height over the base of those before it, as a share of its distance to the first one.
LEAST_HEIGHT = 1e-2
ROWS = 4096


def squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact squared distances of all rows of a and b."""
    return np.stack([((a - c) ** 2).sum(1) for c in b], 1) if len(b) else np.zeros((len(a), 0), np.int64)


@dataclass
class Base:
    """The simplex of the pivots: points is pivots x components, root the lower triangle that turns products into coordinates."""

    points: np.ndarray
    root: np.ndarray

    def apexes(self, vectors: np.ndarray) -> np.ndarray:
        """A row for each vector: its coordinates over the base, then its height."""
        return self.raised(squared(vectors, self.points))

    def raised(self, d2: np.ndarray) -> np.ndarray:
        """Apexes from squared distances to the pivots."""
        own = (self.points[1:] - self.points[0]) ** 2
        products = (d2[:, :1] + own.sum(1)[None, :] - d2[:, 1:]) / 2.0
        x = np.linalg.solve(self.root, products.T).T if len(self.root) else products
        height = np.sqrt(np.maximum(d2[:, 0] - (x * x).sum(1), 0.0))
        return np.concatenate([x, height[:, None]], 1)


def base_of(sample: np.ndarray, pivots: int = PIVOTS) -> Base:
    """Picks pivots among the rows of sample, each the one with the greatest height over the base so far."""
    chosen = sample[:1].astype(np.int64)
    base = Base(chosen, np.zeros((0, 0)))
    while len(chosen) < pivots:
        x = base.apexes(sample)
        best = int(x[:, -1].argmax())
        reach = float(np.sqrt(squared(sample[best : best + 1], chosen[:1])[0, 0]))
        if not reach or x[best, -1] < LEAST_HEIGHT * reach:
            break
        k = len(base.root)
        root = np.zeros((k + 1, k + 1))
        root[:k, :k], root[k] = base.root, x[best]
        chosen = np.concatenate([chosen, sample[best : best + 1]])
        base = Base(chosen, root)
    return base


def tried(sample: np.ndarray, n_clusters: int, rounds: int) -> np.ndarray:
    """The centroids of all rounds on the sample, the first ones first."""
    out = [sample[:n_clusters]]
    for _ in range(rounds):
        at = squared(sample, out[-1]).argmin(1)
        out.append(np.array([sample[at == c].sum(0) // max(1, (at == c).sum()) if (at == c).any() else x for c, x in enumerate(out[-1])]))
    return np.concatenate(out)


def bounds(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lower and upper bounds of the squared distances of the vectors behind apexes a and b."""
    x, y = a[:, :-1].astype(np.float64), b[:, :-1]
    flat = np.maximum((x * x).sum(1)[:, None] + (y * y).sum(1)[None, :] - 2 * (x @ y.T), 0.0)
    return flat + (a[:, None, -1] - b[None, :, -1]) ** 2, flat + (a[:, None, -1] + b[None, :, -1]) ** 2


def slack(apex: np.ndarray, root: np.ndarray) -> np.ndarray:
    """How far rounding may move each apex: a share of its distance to the first pivot, which grows with that distance over the least height of a pivot."""
    far = np.sqrt((apex.astype(np.float64) ** 2).sum(1)) + 1.0
    least = np.diag(root).min() if len(root) else 1.0
    return 2 * far * np.sqrt(1e-12 + 1e-13 * far / least)


def nearest(v: np.ndarray, apex: np.ndarray, centroids: np.ndarray, base: Base) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(nearest centroid, the smaller number among equals; squared distance; how many centroids the filter left) of each vector."""
    heads = base.apexes(centroids)
    low, up = bounds(apex, heads)
    wide = slack(apex, base.root)[:, None] + slack(heads, base.root)[None, :]
    open_ = np.sqrt(low) - wide <= (np.sqrt(up) + wide).min(1, keepdims=True)
    row, col = np.nonzero(open_)
    d = np.full(open_.shape, np.iinfo(np.int64).max)
    for x in range(0, len(row), ROWS):
        r, c = row[x : x + ROWS], col[x : x + ROWS]
        d[r, c] = ((v[r].astype(np.int64) - centroids[c]) ** 2).sum(1)
    best = d.argmin(1)
    return best, d[np.arange(len(v)), best], open_.sum(1)


def integers(rows: pa.Array, dims: int = DIMS) -> tuple[np.ndarray, np.ndarray]:
    """(positions of vectors that are kept, their components as integers)."""
    rows = rows.cast(pa.large_list(pa.float64()))
    off = np.asarray(rows.offsets)
    flat = rows.values
    bad = np.append(0, np.cumsum(~np.isfinite(np.asarray(flat.fill_null(np.nan)))))
    keep = np.flatnonzero((np.diff(off) == dims) & np.asarray(rows.is_valid()) & (bad[off[1:]] == bad[off[:-1]]))
    x = np.asarray(flat.fill_null(0.0))[(off[keep][:, None] + np.arange(dims)).ravel()].reshape(len(keep), dims)
    return keep, np.clip(np.floor(SCALE * x), -LIMIT, LIMIT).astype(np.int64)


def _packed(x: np.ndarray) -> pa.Array:
    x = np.ascontiguousarray(x)
    step = x.shape[1] * x.itemsize
    return pa.Array.from_buffers(pa.binary(), len(x), [None, pa.py_buffer(np.arange(len(x) + 1, dtype=np.int32) * step), pa.py_buffer(x)])


def _loose(col: pa.Array, kind, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(col.to_pylist()), kind).reshape(-1, width)


def vectors(df: DataFrame, key: str, column: str, seed: int = 1) -> DataFrame:
    """k, h (hash of the seed and the key), v (32-bit integers) of the vectors that are kept."""
    kind = df.schema[key].dataType.simpleString()

    def run(batches):
        for b in batches:
            keep, v = integers(b.column(1))
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(keep)), _packed(v.astype("<i4"))], ["k", "v"])

    rows = df.select(F.col(key), F.col(column).cast("array<double>").alias("_v")).mapInArrow(run, f"k {kind}, v binary")
    return rows.withColumn("h", F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("k").cast("string"), F.lit(""))), 256))


def raised(rows: DataFrame, base: Base) -> DataFrame:
    """k, v and apex (32-bit floats): the distances to the pivots are taken here, once."""
    kind = rows.schema["k"].dataType.simpleString()
    shared = rows.sparkSession.sparkContext.broadcast(base)  # PIVOTS vectors

    def run(batches):
        for b in batches:
            for i in range(0, b.num_rows, ROWS):
                part = b.slice(i, ROWS)
                v = _loose(part.column(1), "<i4", DIMS).astype(np.int64)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), _packed(shared.value.apexes(v).astype("<f4"))], ["k", "v", "apex"])

    return rows.select("k", "v").mapInArrow(run, f"k {kind}, v binary, apex binary")


def _assigned(part, base: Base, centroids: np.ndarray):
    v = _loose(part.column("v"), "<i4", DIMS)
    apex = _loose(part.column("apex"), "<f4", len(base.points))
    return v, *nearest(v, apex, centroids, base)


def moved(rows: DataFrame, base: Base, centroids: np.ndarray) -> np.ndarray:
    """The centroids after a round: the floored mean of their vectors; empty ones stay."""
    k = len(centroids)

    def run(batches):
        total, count = np.zeros((k, DIMS), np.int64), np.zeros(k, np.int64)
        for b in batches:
            for i in range(0, b.num_rows, ROWS):
                v, best, _, _ = _assigned(b.slice(i, ROWS), base, centroids)
                count += np.bincount(best, minlength=k)
                order = np.argsort(best, kind="stable")
                some, first = np.unique(best[order], return_index=True)
                if len(some):
                    total[some] += np.add.reduceat(v[order].astype(np.int64), first, 0)
        for c in np.flatnonzero(count):
            yield pa.RecordBatch.from_arrays([pa.array(np.full(DIMS, c)), pa.array(np.arange(DIMS)), pa.array(total[c]), pa.array(np.full(DIMS, count[c]))], ["c", "d", "total", "n"])

    sums = rows.mapInArrow(run, "c long, d long, total long, n long").groupBy("c", "d").agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total"), F.sum("n").alias("n"))
    out = centroids.copy()
    for r in sums.collect():  # a row for each centroid and component
        out[r["c"], r["d"]] = int(r["total"]) // r["n"]
    return out


def placed(rows: DataFrame, base: Base, centroids: np.ndarray) -> DataFrame:
    """k, cluster, distance, n_exact (centroids that were compared exactly)."""
    kind = rows.schema["k"].dataType.simpleString()

    def run(batches):
        for b in batches:
            for i in range(0, b.num_rows, ROWS):
                part = b.slice(i, ROWS)
                _, best, d, n = _assigned(part, base, centroids)
                yield pa.RecordBatch.from_arrays([part.column("k"), pa.array(best.astype(np.int32)), pa.array(d), pa.array(n.astype(np.int32))], ["k", "cluster", "distance", "n_exact"])

    return rows.mapInArrow(run, f"k {kind}, cluster int, distance long, n_exact int")


def cluster(df: DataFrame, n_clusters: int = 16, rounds: int = 3, key: str = "vec_id", column: str = "embedding", seed: int = 1) -> DataFrame:
    """key, cluster, distance, cluster_inertia, inertia, centroid_sha256 and n_exact of every vector that is kept."""
    spark = df.sparkSession
    read = vectors(df, key, column, seed)
    kind = read.schema["k"].dataType.simpleString()
    first = read.select("h", "v").orderBy("h", "v").limit(max(SAMPLE, n_clusters)).collect()
    if not first:
        return spark.createDataFrame([], f"{key} {kind}, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string, n_exact int")
    sample = np.array([np.frombuffer(r["v"], "<i4") for r in first], np.int64)
    base = base_of(tried(sample, n_clusters, rounds))
    rows = cut(raised(read, base), "apexes", "zstd")
    centroids = sample[:n_clusters]
    for _ in range(rounds):
        centroids = moved(rows, base, centroids)
    out = cut(placed(rows, base, centroids), "clusters")
    sums = {r["cluster"]: int(r["s"]) for r in out.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()}  # a row for each centroid
    most = 2**63 - 1
    side = [(c, min(s, most), min(sum(sums.values()), most), hashlib.sha256(",".join(map(str, centroids[c].tolist())).encode()).hexdigest()) for c, s in sums.items()]
    facts = spark.createDataFrame(side, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return out.join(F.broadcast(facts), "cluster").select(F.col("k").alias(key), "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256", "n_exact")
