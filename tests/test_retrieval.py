import math

import pytest
from pyspark.sql import functions as F

from loomspark.functions import terms
from loomspark.operators import retrieval as r


@pytest.fixture(scope="module")
def chunks(spark):
    rows = [(1, "The policy POL-8841 covers running", "en", [1.0, 0.0]), (2, "A policy of the  house", "en", [0.8, 0.6]), (3, "", "en", None), (4, "東京都の天気", "ja", [0.0, 1.0]), (5, "runs and runs", "en", [-1.0, 0.0]), (6, "the house policy the house", "en", [0.0, 0.0])]
    return spark.createDataFrame(rows, "chunk_id long, content string, lang string, embedding array<double>")


def test_terms(spark):
    got = spark.createDataFrame([("POL-8841 v1.2 Foo_bar- x 東京都 a東京 é",)], "t string").select(terms.terms(F.col("t"))).first()[0]
    assert got == ["pol", "8841", "pol8841", "v1", "2", "v12", "foo", "bar", "foobar", "x", "東京", "京都", "a", "東京", "é"]


def test_terms_for_counting(spark):
    texts = ["POL-8841 v1.2 Foo_bar- x 東京都 a東京 é", "a-東京-b c:d", "plain words Only", "", None, "İX-y ÀB/c", "--", "東"]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select(terms.terms(F.col("t")).alias("a"), F.transform(terms.cased_terms(F.col("t")), F.lower).alias("b"))
    assert all(sorted(r.a) == sorted(r.b) for r in df.collect())


def test_written_index_searches_like_one_in_flight(spark, chunks, tmp_path):
    r.write_index(chunks, str(tmp_path / "i"))
    stored, flying = r.read_index(spark, str(tmp_path / "i")), r.index(chunks)
    for query in ("policy house", "pol-8841", "東京", "nothing here", ""):
        a, b = ([(x.chunk_id, round(x.score, 9)) for x in r.keyword(i, query).collect()] for i in (stored, flying))
        assert a == b
    (best, score), *_ = [(x.chunk_id, x.score) for x in r.keyword(stored, "POL-8841").collect()]
    assert best == 1
    n, mean = 5, flying.mean
    dl = {x.chunk_id: x.token_count for x in flying.chunks.collect()}
    one = math.log(1 + (n - 1 + 0.5) / 1.5) * 2.2 / (1 + 1.2 * (0.25 + 0.75 * dl[1] / mean))
    assert math.isclose(score, 3 * one)


def test_stems(spark, chunks):
    i = r.index(chunks.withColumn("language", F.when(F.col("lang") == "en", "english")), language="language")
    assert {x.chunk_id for x in r.keyword(i, "run").collect()} == {1, 5}


def test_phrases_modes_scope_and_rerank(spark, chunks):
    i = r.index(chunks)
    assert [x.chunk_id for x in r.search(i, '"of the house"', mode="keyword").collect()] == [2]
    assert r.search(i, '"no such phrase" policy', mode="keyword").collect() == []
    assert r.phrases('a "b  C" d') == ["b c"] and r.phrases('a "b') == [] and r.fetch_size(8, ["x"]) == 64 and r.fetch_size(8, []) == 8
    with pytest.raises(ValueError, match="vector"):
        r.search(i, "policy", mode="vector")
    assert {x.chunk_id for x in r.keyword(i, "policy", scope=chunks.where("chunk_id = 2")).collect()} == {2}
    near = r.search(i, "", vector_of=[1.0, 0.0], mode="vector", top_k=2).collect()
    assert [x.chunk_id for x in near] == [1, 2]
    assert [(x.chunk_id, round(x.score, 6)) for x in r.vector(chunks, [2.0, 0.0]).collect()] == [(1, 1.0), (2, round(1 / 1.2, 6)), (4, 0.5), (5, round(1 / 3, 6))]
    both = [x.chunk_id for x in r.search(i, "policy house", vector_of=[1.0, 0.0], top_k=3).collect()]
    assert both[:2] == [1, 2] and len(both) == 3  # 1/61 + 1/63 is just over 2/62
    order = r.search(i, "policy house", mode="keyword", reranker=lambda q, t: [2, 2, 9]).orderBy("place").collect()
    plain = r.search(i, "policy house", mode="keyword").collect()
    assert [x.chunk_id for x in order] == [plain[2].chunk_id, plain[0].chunk_id, plain[1].chunk_id]


def test_batches_equal_single_searches(spark, chunks):
    i = r.index(chunks)
    queries = [(1, "policy house"), (2, "runs"), (3, "nothing")]
    got = r.keyword_batch(i, queries, top_k=2).collect()
    for n, q in queries:
        assert [(x.chunk_id, round(x.score, 9)) for x in sorted((x for x in got if x.query_id == n), key=lambda x: x.rank)] == [(x.chunk_id, round(x.score, 9)) for x in r.keyword(i, q, top_k=2).collect()]
    wanted = [(7, [1.0, 0.0]), (8, [0.0, 2.0])]
    got = r.vector_batch(chunks, wanted, top_k=3).collect()
    for n, q in wanted:
        assert [(x.chunk_id, round(x.score, 9)) for x in sorted((x for x in got if x.query_id == n), key=lambda x: x.rank)] == [(x.chunk_id, round(x.score, 9)) for x in r.vector(chunks, q, top_k=3).collect()]


def test_many_languages_leave_the_stemmer_in(spark):
    rows = [(f"c{i}", "running dogs", f"a{i:03}") for i in range(200)] + [("e", "running dogs", "english"), ("n", "running", None)]
    many = spark.createDataFrame(rows, "chunk_id string, content string, lang string").repartition(5)
    assert r.index(many, language="lang").languages == ("english",)


def test_explain_shows_both_legs(spark, chunks):
    i = r.index(chunks)
    ask = {"vector_of": [1.0, 0.0], "top_k": 3}
    rows = r.explain(i, "policy house", **ask).collect()
    assert [(x.chunk_id, x.score) for x in rows if x.rank] == [(x.chunk_id, x.score) for x in r.search(i, "policy house", **ask).collect()]
    words, near = r.keyword(i, "policy house", top_k=3).collect(), r.vector(chunks, [1.0, 0.0], top_k=3).collect()
    assert {(x.chunk_id, x.keyword_rank, x.keyword_score) for x in rows if x.keyword_rank} == {(x.chunk_id, n, x.score) for n, x in enumerate(words, 1)}
    assert {(x.chunk_id, x.vector_rank, x.vector_score) for x in rows if x.vector_rank} == {(x.chunk_id, n, x.score) for n, x in enumerate(near, 1)}
    for x in rows:
        if x.rank:
            assert math.isclose(x.score, sum(1 / (60 + n) for n in (x.keyword_rank, x.vector_rank) if n))
    quoted = r.explain(i, '"of the house" policy', **ask).collect()
    assert [(x.chunk_id, x.rank) for x in quoted][0] == (2, 1) and all(x.rank is None for x in quoted[1:]) and len(quoted) > 1
    assert all(x.vector_rank is None for x in r.explain(i, "policy", mode="keyword").collect())
    assert r.explain(i, "nothing here", mode="keyword").collect() == []
    with pytest.raises(ValueError, match="vector"):
        r.explain(i, "policy", mode="vector")
