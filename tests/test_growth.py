"""What work grows with: how often texts are read, and what one task holds."""

import pytest
from pyspark.sql import functions as F

from loomspark.operators import retrieval as r


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_terms_are_counted_where_the_text_is_read(spark):
    rows = spark.createDataFrame([(1, "Runs runs a-b", "english"), (2, None, None), (3, "runs", None)], "chunk_id long, content string, lang string")
    counted = r._counted(rows, "content", None, "lang")
    assert sorted(map(tuple, counted.collect())) == [(1, 5, "a", 1), (1, 5, "ab", 1), (1, 5, "b", 1), (1, 5, "run", 2), (3, 1, "runs", 1)]
    assert "Exchange" not in plan(counted) and "Aggregate" not in plan(counted)


def test_trigrams_are_counted_where_the_text_is_read(spark, monkeypatch):
    from loomspark.operators import languages

    monkeypatch.setattr(languages, "AT_ONCE", 7)
    rows = spark.createDataFrame([(1, "Aa aa 1 aa"), (1, "aa"), (2, None), (3, "\U00010400é東")], "id long, text string")
    counted = languages._counted(rows, "id", "text")
    assert "Generate" not in plan(counted) and "Exchange" not in plan(counted)
    got = {}
    for x in counted.collect():
        gram = "".join(chr(x.gram >> s & 0x1FFFFF) for s in (42, 21, 0))
        got[x.id, gram] = got.get((x.id, gram), 0) + x.n
    assert got == {(1, " aa"): 4, (1, "aa "): 4, (1, "a a"): 2, (3, " \U00010428é"): 1, (3, "\U00010428é東"): 1, (3, "é東 "): 1}
    from types import SimpleNamespace  # codes of groups and grams that don't fit one long

    import numpy as np

    big = SimpleNamespace(points=np.arange(1, 1001, dtype=np.uint32))
    group, gram, n = languages._tally(np.array([0, 1 << 40]), np.array([500, 500]), big.points)
    assert len(group) == 996 and set(n) == {1} and gram[0] == (1 << 42) | (2 << 21) | 3 and (group == 1 << 40).sum() == 498


def test_a_task_sorts_few_postings(spark, monkeypatch):
    from loomspark.operators import grams

    monkeypatch.setattr(grams, "SORTED", 500)
    rows = spark.range(4000).select(F.col("id"), F.lit("a").alias("x"), F.concat(F.lit("abc"), (F.col("id") % 7).cast("string")).alias("gram"))
    # With the rebalance, tasks held as much as Spark's advisory size: here all of a bucket.
    sizes = [x["count"] for x in grams._bucketed(rows, 4000).groupBy(F.spark_partition_id()).count().collect()]
    assert sum(sizes) == 4000 and len(sizes) >= 4 and max(sizes) <= 2000


def test_classes_of_few_and_of_many_entities_together(spark, monkeypatch):
    from loomspark.operators import induction

    rows = [(f"e{i}", c) for i in range(40) for c in ("all", "half" if i < 20 else "rest", "tenth" if i < 4 else None, "most" if i < 33 else None) if c]
    rows.append(("e0", "all"))
    seen = spark.createDataFrame(rows, "entity string, class string")
    want = {("half", "all", 20, 20), ("rest", "all", 20, 20), ("tenth", "all", 4, 4), ("most", "all", 33, 33)}
    monkeypatch.setattr(induction, "LISTED", 2)  # most entities here are of three or four classes
    assert {tuple(x) for x in induction.hierarchy(seen).select("child", "parent", "shared", "entities").collect()} == want


def test_admission_by_bands_is_that_of_all_pairs(spark, monkeypatch):
    from loomspark.operators import graph
    from tests.test_induction import sequential_admission

    monkeypatch.setattr(graph, "BAND", 40)
    pairs = {(a, b): (a * 7 + b * 13) % 30 / 30 for a in range(20) for b in range(a + 1, 20)}
    df = spark.createDataFrame([(a, b, d) for (a, b), d in pairs.items()], "a long, b long, distance double")
    bands = graph._bands(df)
    assert len(bands) >= 2 and sum(df.where(x).count() for x in bands) == len(pairs) and df.where(bands[0]).count() < 80
    again = df.union(df.select("a", "b", F.col("distance") + 1))  # further rows of the same pairs are later than all
    got = [(x.a, x.b) for x in graph.admitted(again, most=2)[0].collect()]
    assert len(got) == len(set(got)) and set(got) == sequential_admission([(a, b, d) for (a, b), d in pairs.items()], 2)


def test_near_pairs_are_admitted_without_a_table_of_them(spark, monkeypatch):
    import numpy as np

    from loomspark.operators import graph
    from tests.test_induction import sequential_admission

    for name, value in (("BAND", 50), ("PER_NODE", 2), ("BAND_GROWTH", 4), ("SAMPLED", 32), ("BLOCK", 64), ("BLOCK_ROWS", 100)):
        monkeypatch.setattr(graph, name, value)
    x = np.random.default_rng(5).normal(size=(240, 6))
    x[200:220] = x[:20]  # ties
    rows = [(i, None if i == 7 else "ab"[i % 3 == 0], None if i == 8 else [float(v) for v in x[i]], i % 5 == 0) for i in range(240)]
    u = x / np.sqrt((x * x).sum(1, keepdims=True))
    d = np.round(1 - u @ u.T, 6)
    near = [(a, b, d[a, b] + 0.0) for a in range(240) for b in range(a + 1, 240) if d[a, b] <= 0.6 and not {7, 8} & {a, b} and rows[a][1] == rows[b][1] and not (rows[a][3] and rows[b][3])]
    compared, candidates = [], graph.merge_candidates

    def spied(*args, **options):
        compared.append(candidates(*args, **options))
        return compared[-1]

    monkeypatch.setattr(graph, "merge_candidates", spied)
    vectors = spark.createDataFrame(rows, "id long, class_id string, embedding array<double>, keyed boolean").repartition(3)
    got = [(r.a, r.b) for r in graph.admitted_near(vectors, distance=0.6, most=2)[0].collect()]
    assert len(got) == len(set(got)) and set(got) == sequential_admission(near, 2)
    sizes = [c.count() for c in compared]
    assert len(sizes) >= 2 and sum(sizes) < len(near) / 2
    assert graph.admitted_near(vectors.limit(0), distance=0.6)[0].collect() == []
    assert sorted((r.a, r.b) for r in candidates(vectors, distance=0.6).collect()) == sorted((a, b) for a, b, _ in near)


@pytest.fixture
def counted_texts(spark):
    """Chunks whose texts count how often they are read."""
    reads = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def text(i):
        reads.add(1)
        return f"of the house {i} running"

    chunks = spark.range(20).select(F.col("id").alias("chunk_id"), text("id").alias("content"), F.lit("english").alias("lang"))
    return chunks, reads


def test_a_stemmed_search_reads_texts_once(counted_texts):
    chunks, reads = counted_texts
    assert len(r.keyword(r.index(chunks, language="lang"), "runs", top_k=3).collect()) == 3
    assert reads.value == 20


def test_a_phrase_is_looked_for_in_what_was_fetched(counted_texts):
    chunks, reads = counted_texts
    assert len(r.search(r.index(chunks), '"of the"', mode="keyword", top_k=1).collect()) == 1
    assert reads.value <= 20 + 2 * r.fetch_size(1, ["of the"])


def test_a_search_in_a_scope_reads_texts_once(spark, counted_texts):
    chunks, reads = counted_texts
    assert {x.chunk_id for x in r.keyword(r.index(chunks), "house", scope=spark.range(5, 7).toDF("chunk_id")).collect()} == {5, 6}
    assert reads.value == 20


def test_a_search_reads_texts_once_and_rows_of_one_id_are_one_chunk(spark, counted_texts):
    chunks, reads = counted_texts
    assert len(r.keyword(r.index(chunks), "house 7").collect()) == 8
    assert reads.value == 20
    rows = [(1, "ring a"), (1, "ring"), (2, "b c")]
    index = r.index(spark.createDataFrame(rows, "chunk_id long, content string"))
    assert index.n == 2 and index.mean == 2.5
    assert [(x.tf, x.df, x.token_count) for x in index.of(["ring"]).postings.collect()] == [(2, 1, 3)]


def test_a_fused_search_reads_texts_once(spark, counted_texts):
    chunks, reads = counted_texts
    leg = spark.createDataFrame([(3, 0.9)], "chunk_id long, score double")
    assert r.fuse([r.keyword(r.index(chunks), "house", top_k=2), leg]).first().chunk_id in (0, 3)
    assert reads.value == 20


def test_a_batch_of_searches_reads_texts_once(counted_texts):
    chunks, reads = counted_texts
    assert len(r.keyword_batch(r.index(chunks), [(1, "house"), (2, "of 7")], top_k=2).collect()) == 4
    assert reads.value == 20


def test_ascii_texts_are_put_into_lower_case_whole(spark):
    from loomspark.functions import terms

    texts = ["POL-8841 The.end _a__b_ -x- I/O:2 .5", "", None, "Ünder-Été ΣΑΣ.İx K-9 Ⅷ", "日本語-A B_c", "a..b c-", "x" * 40 + "-" * 40 + "Y"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for got in df.select(terms.lowered_terms(F.col("t")).alias("a"), F.transform(terms.cased_terms(F.col("t")), F.lower).alias("b"), terms.terms(F.col("t")).alias("c")).collect():
        assert got.a == got.b and sorted(got.a) == sorted(got.c)


def test_stems_of_several_languages_in_one_batch():
    import pyarrow as pa

    from loomspark.functions import terms
    from loomspark.functions.stemmer import stem

    words, spoken = [["runs", "running", "häuser", "x"], None, ["runs", "häuser"], [], ["runs"]], ["english", "de", "de", "english", None]
    got = terms._tally(pa.array(words, pa.list_(pa.string())), pa.array(spoken), None).to_pylist()
    for ws, lang, row in zip(words, spoken, got):
        want = {}
        for w in ws or []:
            want[stem(w, lang)] = want.get(stem(w, lang), 0) + 1
        assert {x["term"]: x["tf"] for x in row} == want


def test_few_terms_are_counted_in_their_row_and_many_are_summed(spark):
    rows = spark.createDataFrame([(1, "the " * 500 + "END-end"), (2, None), (1, "The x")], "chunk_id long, content string")
    index = r.index(rows)
    assert [len(x.loom_terms) for x in index._rows(["the", "end"]).collect()] == [2, 0, 1]
    many = ["the", "end", "endend", *(f"w{i}" for i in range(r.COUNTED))]
    listed = lambda wanted: sorted((x.chunk_id, x.term, x.tf, x.token_count, x.df) for x in index.of(wanted).postings.collect())
    assert listed(["the", "end", "endend"]) == listed(many) == [(1, "end", 2, 505, 1), (1, "endend", 1, 505, 1), (1, "the", 501, 505, 1)]


def test_a_task_has_few_rows_of_a_search(spark, monkeypatch):
    monkeypatch.setattr(r, "DEALT", 100)
    chunks = spark.range(2000).select(F.col("id").alias("chunk_id"), F.lit("of the house").alias("content"))
    # Shuffled by size, all rows were in one task.
    found = r.index(chunks).of(["house"]).postings.groupBy(F.spark_partition_id()).count().collect()
    assert sum(x["count"] for x in found) == 2000 and len(found) == 20 and max(x["count"] for x in found) <= 200


@pytest.fixture
def no_words(monkeypatch):
    """Texts that are taken apart into words raise an error, as a list of all words costs far more than the search."""
    monkeypatch.setattr(r, "lowered_terms", lambda text: F.split(F.raise_error(F.concat(F.lit("taken apart: "), text)).cast("string"), " "))


HOUSES = [(1, "Of the house, of THE-m"), (2, "of the\n café"), (3, "nothing"), (4, None), (5, "the of")]


def test_a_phrase_search_makes_no_list_of_words(spark, no_words):
    chunks = spark.createDataFrame(HOUSES, "chunk_id long, content string")
    assert {x.chunk_id for x in r.search(r.index(chunks), '"of the"', mode="keyword").collect()} == {1, 2}


def test_a_search_in_a_scope_makes_no_list_of_words(spark, no_words):
    chunks = spark.createDataFrame(HOUSES, "chunk_id long, content string")
    assert [x.chunk_id for x in r.keyword(r.index(chunks), "of the", scope=spark.range(2, 6).toDF("chunk_id")).collect()] == [5, 2]


def test_a_hybrid_search_makes_no_list_of_words(spark, no_words):
    chunks = spark.createDataFrame([(*x, [1.0, 0.1 * x[0]]) for x in HOUSES], "chunk_id long, content string, embedding array<double>")
    # By BM25 5, 1, 2 (twice 1.187, 1.038 and 1.032 times the same idf), by vectors 5, 4, 3, 2, 1.
    assert [x.chunk_id for x in r.search(r.index(chunks), "of the", vector_of=[1.0, 0.5]).collect()] == [5, 1, 2, 4, 3]


def test_wanted_terms_found_in_bytes_are_those_of_the_lists(spark, monkeypatch):
    from loomspark.functions import terms as t

    texts = [x for _, x in HOUSES] + ["", "-", "a", "a-", "-b", "POL-8841 v1.2 a_b:c/d", "aé a a²b aʯ", "aʰ b", "İ a-İ-b", "東京 a", "a\u2019b", "A\U00010400 a", "K k", "x-a--b", "AB a.-b", "it's 3.5"]
    texts += [f"a{chr(c)}b a-{chr(c)} {chr(c)}" for c in range(0x80, 0x300)]
    wanted = ["a", "ab", "b", "the", "them", "k", "v12", "8841"]
    monkeypatch.setattr(t, "SLICE", 16)
    find = t.found_terms(wanted)
    rows = spark.createDataFrame([(x,) for x in texts], "x string").repartition(2).select("x", find("x").alias("f"), t.lowered_terms(F.col("x")).alias("w")).collect()
    for row in rows:
        if any(ord(c) >= 0x280 for c in row.x or ""):
            assert row.f is None
        else:
            assert (row.f.n, {y.term: y.tf for y in row.f.terms}) == (len(row.w), {w: row.w.count(w) for w in wanted if w in row.w}), row.x
    # Bytes that aren't UTF-8 are left to the lists.
    bad = spark.sql("select cast(x as string) x from values (unhex('61C3')), (unhex('61A9')), (unhex('C3C3A9')), (unhex('C3A9A9')), (unhex('C061')), (unhex('C3A961')) t(x)")
    assert [y.f is None for y in bad.coalesce(1).select(find("x").alias("f")).collect()] == [True] * 5 + [False]


def test_a_search_in_flight_equals_a_written_one_in_any_script(spark, tmp_path):
    rows = [*HOUSES, (6, "東京 the"), (7, "ﬁ the the-m"), (8, "thé the")]
    chunks = spark.createDataFrame([(*x, h) for x, h in zip(rows, ["the", None, "house", "of", "東京", "m", "-the", "x"])], "chunk_id long, content string, heading string")
    for heading in (None, "heading"):
        r.write_index(chunks, str(tmp_path / str(heading)), heading=heading)
        stored, flying = r.read_index(spark, str(tmp_path / str(heading))), r.index(chunks, heading=heading)
        for query in ("the of house", "them 東京", "nothing"):
            a, b = ([(x.chunk_id, round(x.score, 9)) for x in r.keyword(i, query).collect()] for i in (stored, flying))
            assert a == b and a
