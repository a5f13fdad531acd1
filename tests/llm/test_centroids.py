import hashlib

import numpy as np
import pytest

from loomspark.llm import centroids as c

from .test_embed_dedup import fixture, frame


def brute(rows, k=16, width=64, scale=64, rounds=3):
    kept = [(i, [int(np.floor(scale * float(x))) for x in v]) for i, v, _ in rows if v is not None and len(v) == width and all(x is not None and np.isfinite(x) for x in v)]
    first = sorted((hashlib.sha256(f"1:{i}".encode()).hexdigest(), v) for i, v in kept if i is not None)[:k]
    now = [v for _, v in first]

    def nearest(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, m)), n) for n, m in enumerate(now))

    for _ in range(rounds):
        groups = {}
        for _, v in kept:
            groups.setdefault(nearest(v)[1], []).append(v)
        now = [[sum(col) // len(groups[n]) for col in zip(*groups[n])] if n in groups else m for n, m in enumerate(now)]
    found = [(i, *nearest(v)) for i, v in kept] if now else []
    of = {}
    for _, d, n in found:
        of[n] = of.get(n, 0) + d
    return sorted((str(i), n, d, of[n], sum(of.values()), hashlib.sha256(",".join(map(str, now[n])).encode()).hexdigest()) for i, d, n in found)


def got(df, **options):
    return sorted((str(r.vec_id), r.cluster, r.distance, r.cluster_inertia, r.inertia, r.centroid_sha256) for r in c.cluster(df, **options).collect())


@pytest.mark.parametrize("kind", ["float", "double"])
def test_against_brute_force(spark, kind):
    rows = [*fixture(), *fixture(20)[:20], (2000, [0.0] * 64, None)]
    assert got(frame(spark, rows, kind)) == brute(rows)


def test_few_vectors_and_other_parameters(spark):
    rows = fixture(9)
    assert got(frame(spark, rows)) == brute(rows)
    rows = [(i, [float(i % 4), float(i % 3)], 0) for i in range(60)]
    assert got(frame(spark, rows), k=5, width=2, scale=3, rounds=2) == brute(rows, 5, 2, 3, 2)


def test_no_vectors(spark):
    assert got(frame(spark, fixture()).limit(0)) == []
    assert got(frame(spark, [(None, [1.0] * 64, 1)])) == []


def test_columns_stay(spark):
    df = frame(spark, fixture()).withColumnRenamed("c", "cluster")
    made = c.assign(df)
    assert made.columns == ["vec_id", "embedding", "label", "node", "cluster", "distance", "centroid_sha256"] and made.count() == len(brute(fixture()))


@pytest.mark.parametrize("size", [3, 1000, 1 << 20, 1 << 26])
def test_screening_is_exact(size, monkeypatch):
    """Also where float32 can't hold the integers, and where many centroids are equally near."""
    monkeypatch.setattr(c, "VALUES", 256)
    monkeypatch.setattr(c, "PAIRS", 7)
    r = np.random.default_rng(size)
    centres = r.integers(-size, size, (16, 64))
    centres[7], centres[3] = centres[2], centres[2] + 1
    x = np.concatenate([r.integers(-size, size, (200, 64)), centres, (centres[0] + centres[1]) // 2 + r.integers(-1, 2, (50, 64)), centres[2] + r.integers(0, 2, (50, 64))])
    nearest = c.Nearest(centres)
    number, distance = nearest(x)
    exact = ((x[:, None, :] - centres[None]) ** 2).sum(2)
    assert (distance == exact.min(1)).all() and (number == exact.argmin(1)).all()
    assert 0 < nearest.compared < x.shape[0] * 16


def test_outsized_components_are_refused(spark):
    with pytest.raises(Exception, match="too large"):
        got(frame(spark, [(1, [1e30] * 64, 1)]))
