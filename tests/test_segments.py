import random
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from loomspark.operators import retrieval, segments
from loomspark.operators.segments import SegmentedIndex

WORDS = ["alpha", "beta", "gamma", "delta", "POL-8841", "von", "der", "ring", "small", "red"]


def rows(spark, ids, seed):
    r = random.Random(seed)
    return spark.createDataFrame([(i, " ".join(r.choices(WORDS, k=r.randint(0, 30))), f"d{i % 7}") for i in ids], "chunk_id long, content string, document_id string")


def scores(index):
    out = {}
    for query in ("alpha ring", "pol-8841 von", "der"):
        out[query] = sorted((x.chunk_id, round(x.score, 9)) for x in retrieval.keyword(index, query, top_k=1000).collect())
    return out


def written(path):
    return sum(f.stat().st_size for f in Path(path).rglob("*.parquet"))


def test_changes_equal_a_rebuild(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(segments, "MERGE", 3)
    monkeypatch.setattr(segments, "LEAST_TERMS", 200)
    monkeypatch.setattr(segments, "DEALT", 1200)
    index = SegmentedIndex(spark, str(tmp_path / "i"))
    assert index.read() is None
    now = {}

    def add(ids, seed):
        new = rows(spark, ids, seed)
        index.add(new)
        now.update({x.chunk_id: x for x in new.collect()})

    def check():
        left = spark.createDataFrame(list(now.values()), "chunk_id long, content string, document_id string")
        assert scores(index.read()) == scores(retrieval.index(left))
        assert sorted(x.chunk_id for x in index.read().chunks.collect()) == sorted(now)

    add(range(60), 1)
    check()
    add(range(50, 90), 2)  # ten are replaced
    index.remove(spark.createDataFrame([(3,), (55,), (80,), (999,)], "chunk_id long"))
    for i in (3, 55, 80):
        del now[i]
    check()
    index.remove(spark.createDataFrame([(3,)], "chunk_id long"))
    add([3, 55, 200], 3)  # what was removed comes back
    check()
    for k in range(5):
        add(range(300 + 10 * k, 305 + 10 * k), 10 + k)
    check()
    assert len({r.name for r in index._manifest()[1] if r.kind == "segment"}) <= 5
    index.remove(rows(spark, sorted(now), 0))
    now.clear()
    assert index.read().n == 0 and index.read().mean == 0.0 and scores(index.read()) == {q: [] for q in ("alpha ring", "pol-8841 von", "der")}


def test_bytes_written_grow_with_the_change(spark, tmp_path):
    index = SegmentedIndex(spark, str(tmp_path / "i"))
    index.add(rows(spark, range(4000), 1).coalesce(1))
    whole = written(tmp_path)
    index.add(rows(spark, range(10), 2).coalesce(1))
    index.remove(rows(spark, range(20, 25), 2))
    assert written(tmp_path) - whole < 0.2 * whole


def test_a_commit_that_lost_the_race_changes_nothing(spark, tmp_path):
    index = SegmentedIndex(spark, str(tmp_path / "i"))
    index.add(rows(spark, range(5), 1))
    version, live = index._manifest()
    index.add(rows(spark, range(5, 9), 1))
    before = scores(index.read())
    with pytest.raises(Exception, match="(?i)exist"):
        index._commit(version, live)
    assert scores(index.read()) == before


def test_odd_additions(spark, tmp_path):
    index = SegmentedIndex(spark, str(tmp_path / "i"), heading="document_id", language="lang")
    odd = spark.createDataFrame([(1, None, None, "english"), (2, "", "Rings", "english"), (3, "ringing 東京都 a.b", None, None)], "chunk_id long, content string, document_id string, lang string")
    index.add(odd)
    index.add(odd.limit(0))
    found = index.read()
    assert index.version() == 1 and found.n == 2 and found.languages == ("english",) and found.chunks.count() == 3
    assert [r.chunk_id for r in retrieval.keyword(found, "ring").collect()] == [2]
    with pytest.raises(ValueError):
        index.add(odd.union(odd))
    with pytest.raises(ValueError):
        index.add(odd.withColumn("chunk_id", F.when(F.col("chunk_id") > 1, F.col("chunk_id"))))
