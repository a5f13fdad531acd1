import random
from pathlib import Path

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from loomspark import workspace
from loomspark.operators import grams, graph
from loomspark.operators.strings import jaro_winkler

from .test_induction import made_names


@pytest.fixture(scope="module")
def messages(spark):
    r = random.Random(1)
    words = made_names(21, 300)
    rows = [(i // 9, i % 9, r.choice(["user", "assistant", "tool"]), " ".join(r.choices(words, k=r.randint(0, 25))), i % 50) for i in range(1500)]
    rows += [(500, 0, "user", None, 1), (500, 1, "user", "", 2), (501, 0, "user", "100%_Sure  İstanbul ΑΣ\n end", 3), (501, 1, "assistant", "🙂🙂 ok 🙂ab", 4), (502, 0, "user", "long " * 40000 + "Needle", 5)]
    return spark.createDataFrame(rows, "session_id long, seq long, role string, content string, created_at long").repartition(3)


@pytest.fixture(scope="module")
def index(messages, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("m") / "i")
    workspace.index_messages(messages, path)
    return path


@pytest.mark.parametrize("text", ["100%_s", "%", "_", "needle", "αΣ", "İstanbul", "🙂ab", "🙂", "no such text here", "  ", "a", "ORS", "aeilnorst"])
def test_message_search_is_that_of_a_scan(messages, index, text):
    rows = messages.select("*", F.lower("content").alias("low"), F.lower(F.lit(text.strip())).alias("want")).where("role != 'tool' and contains(low, want)").collect() if text.strip() else []
    want = [(r.session_id, r.seq) for r in sorted(rows, key=lambda r: (-r.created_at, -r.seq, r.session_id))][:50]
    for i in (index, None):
        assert [(r.session_id, r.seq) for r in workspace.message_search(messages, f" {text} ", index=i).collect()] == want


def test_snippets_and_sessions(spark, messages, index):
    got = workspace.message_search(messages, "sure", index=index).collect()
    assert [r.snippet for r in got] == ["100%_Sure İstanbul ΑΣ end"]
    (got,) = workspace.message_search(messages, "NEEDLE", index=index, around=4).collect()
    assert got.snippet == "ng Needle"[1:] or got.snippet.endswith("ng Needle")
    visible = spark.createDataFrame([(501,), (501,)], "session_id long")
    assert {r.session_id for r in workspace.message_search(messages, "o", index=index, visible=visible).collect()} == {501}
    assert len(workspace.message_search(messages, "a", limit=7).collect()) == 7


def test_few_row_groups_are_read(spark, messages, tmp_path):
    """A search for a rare string touches the row groups of its grams only."""
    path = str(tmp_path / "i")
    spark.conf.set("spark.hadoop.parquet.block.size", "4096")
    block = spark.sparkContext._jsc.hadoopConfiguration()
    block.set("parquet.block.size", "8192")
    try:
        workspace.index_messages(messages, path)
    finally:
        block.unset("parquet.block.size")
        spark.conf.unset("spark.hadoop.parquet.block.size")
    rare = spark.read.parquet(f"{path}/counts").orderBy("n", "gram").limit(grams.LISTS)
    wanted = {(r.gram, r.bucket) for r in rare.withColumn("bucket", F.pmod(F.xxhash64("gram"), F.lit(grams.BUCKETS))).collect()}
    touched = total = 0
    for f in Path(path, "postings").rglob("*.parquet"):
        meta, bucket = pq.ParquetFile(f).metadata, int(f.parent.name.split("=")[1])
        column = next(i for i in range(meta.num_columns) if meta.schema.column(i).path == "gram")
        for g in range(meta.num_row_groups):
            stats = meta.row_group(g).column(column).statistics
            total += 1
            touched += any(b == bucket and stats.min <= w <= stats.max for w, b in wanted)
    assert touched <= 2 * grams.LISTS and total > 5 * touched


@pytest.fixture(scope="module")
def labels(spark, tmp_path_factory):
    names = [*made_names(31, 900), *made_names(32, 300, "abcdefghijklmnop qrstuvwxyz"), "a", "ab", "abc", "tor", "é", "éa", "東京", "x" * 40]
    df = spark.createDataFrame([(f"n{i}", "ab"[i % 2], n.title(), n) for i, n in enumerate(sorted({n.strip() for n in names} - {""}))] + [("none", "a", None, None), ("blank", "a", "", "")], "id string, class_id string, label string, normalized_label string").repartition(3)
    path = str(tmp_path_factory.mktemp("l") / "i")
    grams.write_label_index(df, path)
    return df, path, df.where("normalized_label != ''").collect()


@pytest.mark.parametrize("text", ["aeilnor", "torsenal", "ab", "a", "é", "東", "storlinea", "abcdefgh", "x" * 37, "zzzzzz", "aeil nors tone line"])
@pytest.mark.parametrize("cls", [None, {"b"}])
def test_suggestions_are_those_of_a_full_scan(spark, labels, text, cls):
    df, path, rows = labels
    fits = [(jaro_winkler(r.normalized_label, text), r) for r in rows if cls is None or r.class_id in cls]
    fits = [(s, r) for s, r in fits if text in r.normalized_label or r.normalized_label in text or s >= 0.88]
    want = [(r.id, round(s, 9)) for s, r in sorted(fits, key=lambda x: (-x[0], len(x[1].label), x[1].label))[:8]]
    got = graph.indexed_suggestions(spark, path, text.title(), most=8, cls=cls).collect()
    assert sorted((r.id, round(r.similarity, 9)) for r in got) == sorted(want) and [round(r.similarity, 9) for r in got] == [s for _, s in want]
    scan = graph.suggestions(df.where("normalized_label != ''"), text.title(), most=8, cls=cls).collect()
    assert [round(r.similarity, 9) for r in scan] == [s for _, s in want]


def test_few_labels_are_scored(spark, labels):
    df, path, rows = labels
    texts = ("torsenali", "storlinea", "abcdefgh", "quiz show")
    met = [grams.candidates(spark, path, t) for t in texts]
    assert sum(m.count() for m in met) < 0.25 * len(texts) * len(rows)
    assert sum(grams.scored(m, t).where("similarity is not null").count() for m, t in zip(met, texts, strict=True)) < 0.1 * len(texts) * len(rows)
    assert graph.indexed_suggestions(spark, path, "  ").collect() == []
