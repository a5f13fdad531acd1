import numpy as np
import pytest

from loomspark.llm import negatives as n

from .test_embed_dedup import frame


def brute(rows, scale=256, every=50, positives=5, negatives=3):
    ok = [(i, [int(np.floor(scale * float(x))) for x in v], l) for i, v, l in rows if i is not None and l is not None and v and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for a, (anchor, v, label) in enumerate(ok):
        if anchor % every:
            continue
        scored = sorted((-sum(x * y for x, y in zip(v, w)), i, l) for b, (i, w, l) in enumerate(ok) if a != b and len(v) == len(w))
        for s, p, _ in [t for t in scored if t[2] == label][:positives]:
            fits = [(-t, i) for t, i, l in scored if l != label and 50 * -s <= 100 * -t <= 95 * -s][:negatives]
            out += [(anchor, p, r, i, -s, t) for r, (t, i) in enumerate(fits, 1)]
    return sorted(out)


def fixture(count=400, width=64):
    r = np.random.default_rng(11)
    centres = r.normal(size=(12, width))
    rows = []
    for i in range(count):
        v = centres[i % 12] + r.normal(size=width) * 0.9
        rows.append((i, (v / np.linalg.norm(v)).astype(np.float32).tolist(), 7 if i % 3 == 0 else i % 10))
    same = rows[50]
    rows += [same, same, (50, rows[51][1], 3), (150, same[1], 5), (200, None, 1), (250, [float("nan")] * width, 1), (300, same[1], None), (None, same[1], 1), (350, [*same[1][:-1], None], 1), (1000, [], 1), (1050, same[1][:5], 1), (1051, same[1][:5], 1), (1052, same[1][:5], 2), (1053, [x / 2 + 0.1 for x in same[1][:5]], 2), (1100, [0.0] * width, 4), (1101, [0.0] * width, 4), (1150, [-x for x in same[1]], 99)]
    return rows


def got(df, **options):
    return sorted(tuple(r) for r in n.hard_negatives(df, **options).collect())


@pytest.mark.parametrize("kind", ["float", "double"])
def test_against_brute_force(spark, kind):
    rows = fixture()
    df = frame(spark, rows, kind)
    assert n.hard_negatives(df).columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    assert got(df) == brute(rows) and len(brute(rows)) > 60


@pytest.mark.parametrize("sent", [0, 1 << 16])
def test_many_tiles(spark, monkeypatch, sent):
    for name, value in (("ANCHORS", 3), ("ROWS", 50), ("DIMENSIONS", 24), ("SENT", sent)):
        monkeypatch.setattr(n, name, value)
    rows = fixture()
    assert got(frame(spark, rows)) == brute(rows)


def test_other_parameters(spark):
    rows = fixture(120, 6)
    assert got(frame(spark, rows), scale=10, every=4, positives=2, negatives=9) == brute(rows, 10, 4, 2, 9)


def test_exact_beyond_double_precision(spark):
    r = np.random.default_rng(4)
    rows = [(i, (r.integers(1 << 19, 1 << 20, 3) + 0.25).tolist(), i % 2) for i in range(60)]
    assert got(frame(spark, rows, "double"), scale=256) == brute(rows)
    a, b = np.array([[(1 << 29) - 1, 1]]), np.array([[(1 << 29) - 1, 2], [3, -5]])
    assert (n._product(a, b) == a.astype(object) @ b.T.astype(object)).all()


def test_numbers_are_narrowed_without_loss():
    for x in ([-(1 << 15) + 1, 5], [1 << 15], [-(1 << 31)], [1 << 31], [1 << 62, -1], []):
        assert n._wide(n._narrow(np.array(x, np.int64))).tolist() == x


def test_empty(spark):
    assert got(frame(spark, fixture()).limit(0)) == []
    assert got(frame(spark, [(50, [1.0, 2.0], 1)])) == []


def test_outsized_components_are_refused(spark):
    with pytest.raises(Exception, match="too large"):
        got(frame(spark, [(50, [1e30] * 3, 1)]))


def test_panels_are_never_broadcast(spark):
    """However small a panel's rows look before they are repeated for each block of the other side."""
    name = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(name)
    spark.conf.set(name, "1g")
    try:
        plan = n.hard_negatives(frame(spark, fixture()))._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set(name, before)
    joins = [line for line in plan.splitlines() if "Join" in line and "chunk#" in line]
    assert joins and all("SortMergeJoin" in line for line in joins)


def test_tiles_of_one_chunk_and_of_several(spark):
    """Vectors of both kinds in one table."""
    wide = n.DIMENSIONS + 9
    rows = fixture(150) + [(i + 5000, v, label) for i, v, label in fixture(150, wide) if i is not None]
    assert got(frame(spark, rows)) == brute(rows)
