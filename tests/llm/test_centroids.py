"""Whole-number k-means against a plain loop, and the bounds against exact distances."""

import hashlib
import math
import random

import numpy as np

from tagloom.llm import centroids
from tests.conftest import SF_DIR


def plain(rows, k=40, rounds=5):
    """[(vec_id, components)] -> sorted result rows, by the definition."""
    kept = [
        (i, [math.floor(256 * x) for x in e]) for i, e in rows
        if e is not None and len(e) == 64 and all(x is not None and math.isfinite(x) and abs(x) < 1 << 19 for x in e)
    ]
    hashed = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"2:{r[0]}".encode()).hexdigest(), r[1]))
    c = np.array([v for _, v in hashed[:k]], dtype=object)
    if not kept:
        return []
    v = np.array([x for _, x in kept], dtype=object)
    nearest = lambda: ((v[:, None, :] - c[None]) ** 2).sum(2)
    for _ in range(rounds):
        best = nearest().argmin(1)
        for j in range(len(c)):
            if (best == j).any():
                own = v[best == j]
                c[j] = [int(s) // len(own) for s in own.sum(0)]
    d = nearest()
    best = d.argmin(1)
    far = d[range(len(v)), best]
    digest = [hashlib.sha256(",".join(map(str, x)).encode()).hexdigest() for x in c]
    own = {j: int(far[best == j].sum()) for j in set(best.tolist())}
    return sorted(
        ((i, int(b), int(f), own[int(b)], int(far.sum()), digest[int(b)]) for (i, _), b, f in zip(kept, best, far)), key=repr
    )


def found(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_whole_table(spark):
    vectors = spark.read.parquet(f"{SF_DIR}/embeddings.parquet")
    rows = [(r.vec_id, r.embedding) for r in vectors.collect()]
    assert found(centroids.cluster(vectors)) == plain(rows)


def test_odd_vectors(spark):
    rng = random.Random(1)
    some = lambda s=1.0: [rng.gauss(0, s) for _ in range(64)]
    hot = some()
    rows = [(i, some()) for i in range(90)] + [(i, hot) for i in range(90, 200)] + [(7, some()), (7, hot), (None, some()), (None, hot)]
    rows += [(300, None), (301, []), (302, some()[:63]), (303, [None, *some()[1:]]), (304, [math.nan, *some()[1:]]), (305, [math.inf, *some()[1:]])]
    rows += [(306, [5e5] * 64), (307, [-5e5] * 64), (308, [0.0] * 64), (309, [1e-9] * 64), (310, [-1e-9] * 64), (311, [6e5, *some()[1:]])]
    frame = spark.createDataFrame([(*r, 1, 2.0) for r in rows], "vec_id long, embedding array<double>, cluster int, lead double").repartition(6)
    for k in (40, 3, 400):
        assert found(centroids.cluster(frame, k=k, rounds=3)) == plain(rows, k, 3)
    assert found(centroids.cluster(frame.limit(0))) == []
    assert found(centroids.cluster(frame.filter("vec_id >= 300 and vec_id <= 305"))) == []


def test_bounds_rule_out_most_and_never_the_nearest(monkeypatch):
    rng = np.random.default_rng(3)
    v = (rng.normal(size=(2000, 8)) @ rng.normal(size=(8, 64)) * 256 + rng.normal(size=(2000, 64)) * 8).astype(np.int64)
    v = np.vstack([v, v[:50]])
    c = v[rng.choice(2000, 40, replace=False)]
    c[7] = c[3]  # ties go to the smaller number
    _, axes = np.linalg.eigh(np.cov(v.T.astype(float)))
    axes = np.ascontiguousarray(axes[:, ::-1][:, : centroids.LEADING])
    seen = []
    real = np.nonzero
    monkeypatch.setattr(np, "nonzero", lambda x: seen.append(int(x.sum())) or real(x))
    best, distance = centroids.nearest(v, *centroids.rotated(v, axes), c, axes)
    exact = ((v[:, None] - c) ** 2).sum(2)
    assert (best == exact.argmin(1)).all() and (distance == exact.min(1)).all()
    assert sum(seen) < 2 * len(v)
