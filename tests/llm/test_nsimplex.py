import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from firmlens.llm import nsimplex
from firmlens.llm.nsimplex import Base, base_of, bounds, nearest, slack, squared

RNG = np.random.default_rng(11)


def sets():
    spread = RNG.integers(-300, 300, (400, 64))
    far = spread.copy()
    far[::7] += 1 << 26
    flat = RNG.integers(-300, 300, (400, 3)) @ RNG.integers(-3, 4, (3, 64))  # in few dimensions
    groups = RNG.integers(-300, 300, (9, 64))[RNG.integers(0, 9, 400)] + RNG.integers(-5, 6, (400, 64))
    return {"spread": spread, "far": far, "flat": flat, "groups": groups, "equal": np.ones((50, 64), np.int64), "two": np.repeat(RNG.integers(-9, 9, (2, 64)), 30, 0)}


@pytest.mark.parametrize("name", sets())
@pytest.mark.parametrize("pivots", [1, 2, 12, 48])
def test_bounds_hold_and_the_nearest_stays(name, pivots):
    v = sets()[name].astype(np.int64)
    base = base_of(v[:64], pivots)
    assert 1 <= len(base.points) <= pivots
    c = v[::25]
    a, b = base.apexes(v).astype(np.float32), base.apexes(c)
    low, up = map(np.sqrt, bounds(a, b))
    true = np.sqrt(squared(v, c))
    wide = slack(a, base.root)[:, None] + slack(b, base.root)[None]
    assert (low <= true + wide).all() and (true <= up + wide).all()
    best, d, n = nearest(v, a, c, base)
    all_ = squared(v, c)
    assert (best == all_.argmin(1)).all() and (d == all_.min(1)).all()
    assert (n >= 1).all()


def test_apexes_keep_the_distances_to_the_pivots():
    v = RNG.integers(-99, 99, (50, 64))
    base = base_of(v, 12)
    assert len(base.points) == 12
    assert np.allclose(np.sqrt((base.apexes(v) ** 2).sum(1)), np.sqrt(squared(v, base.points[:1]))[:, 0])
    assert np.allclose(base.apexes(base.points)[1:, :-1], base.root, atol=1e-4)


def test_the_filter_leaves_few_centroids():
    v = sets()["groups"].astype(np.int64)
    seen = nsimplex.tried(v[:200], 16, 3)
    base = base_of(seen)
    c = np.concatenate([nsimplex.tried(v, 16, r)[-16:] for r in range(4)])
    for k in range(0, 64, 16):
        _, _, n = nearest(v, base.apexes(v), c[k : k + 16], base)
        assert n.mean() < 3  # of 16


def brute(rows, k=16, rounds=3):
    kept = [(i, np.clip(np.floor(64 * np.array(e, float)), -(1 << 27), 1 << 27).astype(np.int64)) for i, e in rows if e is not None and len(e) == 64 and all(x is not None and np.isfinite(x) for x in e)]
    if not kept:
        return []
    order = sorted(kept, key=lambda r: (hashlib.sha256(f"1:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1].astype("<i4").tobytes()))
    c = np.array([v for _, v in order[:k]])
    v = np.array([x for _, x in kept])
    for _ in range(rounds):
        at = squared(v, c).argmin(1)
        c = np.array([[int(s) // int((at == j).sum()) for s in v[at == j].sum(0)] if (at == j).any() else c[j] for j in range(len(c))])
    d = squared(v, c)
    at, d = d.argmin(1), d.min(1)
    sha = [hashlib.sha256(",".join(map(str, x)).encode()).hexdigest() for x in c.tolist()]
    return sorted(((i, int(j), int(x), int(d[at == j].sum()), int(d.sum()), sha[j]) for (i, _), j, x in zip(kept, at, d)), key=str)


def rows_of(df):
    return sorted((tuple(r[c] for c in ("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")) for r in df.collect()), key=str)


def test_equals_brute_force_on_odd_tables(spark):
    good = [(i, (RNG.normal(0, 1, 64) + 3 * (i % 5)).tolist()) for i in range(200)]
    bad = [(900, None), (901, []), (902, [1.0] * 63), (903, [1.0] * 65), (904, [None] + [1.0] * 63), (905, [float("nan")] + [1.0] * 63), (906, [float("inf")] + [1.0] * 63)]
    odd = [(907, [1e300] + [0.0] * 63), (908, [-1e300] + [0.0] * 63), (None, [0.5] * 64), (None, [0.25] * 64), (3, [9.0] * 64), *good[:20], *good[:20]]
    for some in (good + bad + odd, good[:5], bad, good[:1] * 40, []):
        df = spark.createDataFrame(some, "vec_id long, embedding array<double>").withColumns({"k": F.lit(1), "v": F.lit("x"), "cluster": F.lit(0)}).repartition(3)
        got = nsimplex.cluster(df)
        assert rows_of(got) == brute(some)


def test_query_equals_brute_force(spark):
    from firmlens.llm import queries

    sf = "/root/testdata/sf0.001"
    some = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    assert rows_of(queries.op11_nsimplex_clusters(spark, sf)) == brute(some)


def test_pivots_in_one_point():
    v = np.ones((5, 64), np.int64)
    base = base_of(v)
    assert isinstance(base, Base) and len(base.points) == 1 and base.apexes(v).tolist() == [[0.0]] * 5
