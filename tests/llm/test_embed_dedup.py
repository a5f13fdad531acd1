import numpy as np
import pytest

from loomspark.llm import embed_dedup as e


def brute(rows, least):
    ok = {}
    for n, (i, v, label) in enumerate(rows):
        if i is not None and v is not None and label is not None and len(v) and all(x is not None and np.isfinite(x) for x in v) and any(v):
            x = np.asarray(v, np.float64)
            ok[n] = x / np.abs(x).max()
    to = list(range(len(rows)))

    def root(i):
        while to[i] != i:
            i = to[i]
        return i

    links = [0] * len(rows)
    for a in ok:
        for b in ok:
            if a < b and rows[a][2] == rows[b][2] and len(rows[a][1]) == len(rows[b][1]):
                x, y = ok[a], ok[b]
                if x @ y / np.sqrt(x @ x) / np.sqrt(y @ y) >= least:
                    links[a] += 1
                    links[b] += 1
                    to[root(b)] = root(a)
    reached = {}
    for n, (i, *_) in enumerate(rows):
        if i is not None:
            reached[root(n)] = min(i, reached.get(root(n), i))
    return sorted((str(i), links[n], str(reached[root(n)]) if i is not None else "None") for n, (i, *_) in enumerate(rows))


def fixture(n=300, width=64):
    r = np.random.default_rng(3)
    rows = []
    for i in range(n):
        centre = np.random.default_rng(i % 40).normal(size=width)
        rows.append((i, (centre + r.normal(size=width) * 0.12).astype(np.float32).tolist(), i % 3))
    same = rows[5][1]
    rows += [(1000, same, rows[5][2]), (1001, same, rows[5][2]), (1002, same, None), (1003, None, 1), (1004, [0.0] * width, 1), (1005, [float("nan")] * width, 1), (1006, [*same[:-1], None], 1), (1007, [], 1), (1008, same[:10], 1), (1009, [x * 3 for x in same], rows[5][2]), (None, same, rows[5][2]), (1010, [float("inf"), *same[1:]], 1)]
    return rows


def frame(spark, rows, kind="float"):
    return spark.createDataFrame([(*r, 1, "x") for r in rows], f"vec_id long, embedding array<{kind}>, label int, node long, c string").repartition(3)


def got(df, **options):
    return sorted((str(r.vec_id), r.n_links, str(r.component_id)) for r in e.near_duplicate_vectors(df, **options).collect())


@pytest.mark.parametrize("kind", ["float", "double"])
def test_against_brute_force(spark, kind):
    rows = fixture()
    assert got(frame(spark, rows, kind)) == brute(rows, 0.93)


def test_large_buckets_are_dealt_out(spark, monkeypatch):
    monkeypatch.setattr(e, "BLOCK", 16)
    rows = fixture(200)
    assert got(frame(spark, rows)) == brute(rows, 0.93)


def test_recall_at_the_limit():
    """Pairs at the least cosine meet in some bucket in 9 of 10 cases at least."""
    r = np.random.default_rng(0)
    a = r.normal(size=(2000, 64))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    b = r.normal(size=(2000, 64))
    b -= (a * b).sum(1, keepdims=True) * a
    b /= np.linalg.norm(b, axis=1, keepdims=True)
    near = 0.93 * a + np.sqrt(1 - 0.93**2) * b
    salt = np.zeros(2000, np.uint64)
    x, y = (e.bucket_keys(v, salt).reshape(-1, e.TABLES, 1 + e.PROBES) for v in (a, near))
    assert (x[:, :, :, None] == y[:, :, None, :]).any((1, 2, 3)).mean() >= 0.9


def test_several_vectors_of_one_id(spark):
    """Under one label and under two: each row links, and is reached, by its own vector."""
    r = np.random.default_rng(5)
    a, b = r.normal(size=64), r.normal(size=64)
    near = lambda x: (x + r.normal(size=64) * 0.01).tolist()
    rows = [(5, near(a), 1), (5, near(a), 1), (7, near(a), 1)]
    assert got(frame(spark, rows)) == brute(rows, 0.93) == [("5", 2, "5"), ("5", 2, "5"), ("7", 2, "5")]
    rows = [(5, near(a), 1), (6, near(a), 1), (5, near(b), 2), (8, near(b), 2), (4, near(b), 3), (9, a.tolist(), 4), (9, a.tolist(), 4)]
    assert got(frame(spark, rows)) == brute(rows, 0.93)
    rows = [(i % 60, v, label) for i, v, label in fixture() if i is not None] + fixture(30)
    assert got(frame(spark, rows)) == brute(rows, 0.93)


def test_empty(spark):
    assert got(frame(spark, fixture()).limit(0)) == []
