"""Sort-means against every vector with every centroid, in Python's integers."""

import hashlib
import math
import random

import numpy as np
import pytest

from arborql.llm import centroids


def brute(rows, k, dims, scale, rounds, seed=2):
    kept = [(i, [math.floor(scale * x) for x in v]) for i, v in rows if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v)]
    order = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"{seed}:{r[0]}".encode()).hexdigest(), r[1]))
    cs = [v for _, v in order[:k]]

    def assign():
        return [min((sum((a - b) ** 2 for a, b in zip(v, c)), j) for j, c in enumerate(cs)) for _, v in kept]

    for _ in range(rounds):
        near = assign()
        for j in range(len(cs)):
            own = [v for (_, v), (_, n) in zip(kept, near) if n == j]
            if own:
                cs[j] = [sum(x) // len(own) for x in zip(*own)]
    near = assign()
    inertia = sum(d for d, _ in near)
    out = []
    for (i, _), (d, j) in zip(kept, near):
        out.append((i, j, d, sum(e for e, n in near if n == j), inertia, hashlib.sha256(",".join(map(str, cs[j])).encode()).hexdigest()))
    return out


def vectors(n=300, dims=6, seed=1):
    r = random.Random(seed)
    out = [[r.gauss(0, 1) + 3 * (k % 5) for _ in range(dims)] for k in range(n)]
    return out + out[:20] + [out[0]] * 30 + [[float(r.randrange(2)) for _ in range(dims)] for _ in range(60)]  # copies and ties


def same(spark, tables, rows, **o):
    df = spark.createDataFrame([(i, v, 1, "x", 2.0) for i, v in rows], "vec_id long, embedding array<double>, cluster int, v string, distance double").repartition(4)
    got = sorted(map(tuple, centroids.digests(df, tables, **o).collect()), key=repr)
    long = lambda x: x if x < 2 ** 63 else None
    want = []
    whole = brute(rows, o["k"], o["dims"], o["scale"], o["rounds"])
    lost = {r[1] for r in whole if r[2] >= 2 ** 63}
    for i, j, d, own, every, sha in whole:
        want.append((i, j, long(d), None if j in lost else long(own), None if lost else long(every), sha))
    assert got == sorted(want, key=repr)


@pytest.mark.parametrize("k", [1, 7, 40])
def test_clusters(spark, tables, k):
    same(spark, tables, list(enumerate(vectors())), k=k, dims=6, scale=256, rounds=3)


def test_odd_rows(spark, tables):
    rows = list(enumerate(vectors(40)))
    rows += [(900, None), (901, []), (902, [1.0] * 5), (903, [1.0] * 7), (904, [None] + [1.0] * 5), (905, [math.nan] + [1.0] * 5), (906, [-math.inf] * 6), (3, rows[3][1]), (3, [0.5] * 6)]
    rows += [(907, [-0.0] * 6), (908, [-0.001] * 6), (None, [0.25] * 6)]
    same(spark, tables, rows, k=9, dims=6, scale=256, rounds=5)


def test_large_components(spark, tables):
    """Beyond what doubles hold exactly; distances beyond a long are null."""
    rows = list(enumerate(vectors(40))) + [(500, [1e6, -3e7, 0.1, 5e5, 1.0, 2.0]), (501, [1e6, -3e7, 0.1, 5e5, 1.0, 9.0]), (502, [-4e20] * 6), (503, [1e5 + k / 7 for k in range(6)])]
    same(spark, tables, rows, k=8, dims=6, scale=256, rounds=4)


def test_few_and_none(spark, tables):
    same(spark, tables, list(enumerate(vectors(3)))[:3], k=40, dims=6, scale=256, rounds=2)
    df = spark.createDataFrame([], "vec_id long, embedding array<float>")
    out = centroids.digests(df, tables)
    assert out.count() == 0 and out.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    only_bad = spark.createDataFrame([(1, None), (2, [1.0])], "vec_id long, embedding array<float>")
    assert centroids.digests(only_bad, tables).count() == 0


def test_the_scan_stops_and_is_whole():
    """Far groups: a row looks at its own group's centroids only, and finds the nearest whatever it starts from."""
    r = np.random.default_rng(4)
    cs = [[int(x) for x in 1000 * (j // 5) + r.integers(0, 30, 4)] for j in range(40)]
    scan = centroids.Scan(cs)
    x = np.array([cs[i % 40] for i in range(400)], float) + r.integers(-5, 6, (400, 4))
    d = centroids.Scan.between(x, np.array(cs, float))
    for before in (np.zeros(400, int), d.argmin(1), r.integers(0, 40, 400)):
        best, least = scan.nearest(x, before)
        assert (best == d.argmin(1)).all() and (least == d.min(1)).all()
    looked = []
    between = centroids.Scan.between
    scan.between = lambda a, b: looked.append(len(a) * len(b)) or between(a, b)
    scan.nearest(x, d.argmin(1))
    assert sum(looked) < 400 * 40 / 2
