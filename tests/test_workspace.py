from datetime import datetime

import pytest

from loomspark import workspace as w
from loomspark.functions.citations import renumbered
from loomspark.functions.language import detect
from loomspark.plans import gate


@pytest.fixture(scope="module")
def ws(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("ws")
    (folder / "sites.csv").write_text("site,n\na,1\nb,2\nc,\n")
    space = w.Workspace(spark, str(folder / "space"))
    assert space.load(str(folder / "sites.csv")) == ["sites"]
    return space


def test_statements(spark, ws):
    assert [tuple(r) for r in ws.query("FROM sites WHERE n > 1").rows] == [("b", 2)]
    with pytest.raises(gate.Refused):
        ws.query("DELETE FROM sites")
    run = lambda text: ws.query(text, may_write=True)
    run("CREATE TABLE big AS FROM sites WHERE n IS NOT NULL")
    run("INSERT INTO big BY NAME SELECT 9 AS n, 'z' AS site")
    run("INSERT INTO big SELECT 'y', 8")
    run("UPDATE big SET n = n + 1 WHERE site = 'a'")
    run("DELETE FROM big WHERE site = 'b'")
    assert sorted(map(tuple, ws.query("SELECT site, n FROM big").rows)) == [("a", 2), ("y", 8), ("z", 9)]
    run("ALTER TABLE big ALTER COLUMN n SET DATA TYPE VARCHAR")
    assert ws.table("big").dtypes == [("site", "string"), ("n", "string")]
    ws.upsert("big", spark.createDataFrame([("a", "5")], "site string, n string"), ["site"])
    assert ws.query("SELECT n FROM big WHERE site = 'a'").rows[0][0] == "5"
    with pytest.raises(ValueError, match="already"):
        run("CREATE TABLE big AS SELECT 1 AS a")
    with pytest.raises(gate.Refused, match="internal"):
        run("CREATE TABLE _loom_x AS SELECT 1 AS a")
    assert ws.measure("total", "sum(n)", "sites").first()[0] == 3
    answer = ws.query("SELECT site FROM sites", order=[("site", True)], rows=2)
    assert [r[0] for r in answer.rows] == ["c", "b"] and answer.total == 3 and answer.total_is_exact
    run("DROP TABLE big")
    assert ws.tables() == ["sites"]


def test_keys_upserts_and_updates(spark, ws):
    run = lambda text: ws.query(text, may_write=True)
    rows = lambda: sorted(map(tuple, ws.query("SELECT k, a, b FROM kept").rows))
    run("CREATE TABLE kept (k BIGINT PRIMARY KEY, a BIGINT, b VARCHAR)")
    run("INSERT INTO kept VALUES (1, 10, 'x'), (2, 20, 'y, z')")
    with pytest.raises(ValueError, match="repeat the key"):
        run("INSERT INTO kept VALUES (2, 0, 'no')")
    run("INSERT OR IGNORE INTO kept VALUES (2, 0, 'no'), (3, 30, 'new')")
    run("INSERT INTO kept VALUES (1, 0, 'no') ON CONFLICT (k) DO NOTHING")
    run("INSERT OR REPLACE INTO kept VALUES (3, 31, 'newer'), (4, 40, 'q')")
    assert rows() == [(1, 10, "x"), (2, 20, "y, z"), (3, 31, "newer"), (4, 40, "q")]
    run("UPDATE kept SET a = a + 1, b = concat(b, ',', CAST(a AS STRING)) WHERE k <= 2")
    assert rows()[:2] == [(1, 11, "x,10"), (2, 21, "y, z,20")]
    run("CREATE TABLE news AS SELECT * FROM (VALUES (3, 300), (4, 400), (4, 401), (9, 900)) AS t(id, v)")
    run("UPDATE kept SET a = n.v, b = 'from' FROM news n WHERE n.id = kept.k AND n.v > 300")
    assert rows() == [(1, 11, "x,10"), (2, 21, "y, z,20"), (3, 31, "newer"), (4, 400, "from")]
    with pytest.raises(ValueError, match="no key"):
        run("INSERT OR REPLACE INTO news SELECT 1, 2")
    with pytest.raises(ValueError, match="no column"):
        run("UPDATE kept SET nothing = 1")
    run("DROP TABLE kept")
    run("DROP TABLE news")
    assert ws.tables() == ["sites"] and ws.keys("kept") == []


def test_profiles_and_copies(spark, ws, tmp_path):
    first = ws.profiles()
    assert {r["column_name"]: r["distinct_values"] for r in first["sites"]} == {"site": 3, "n": 2}
    ws.snapshot(str(tmp_path / "copy"))
    ws.query("DELETE FROM sites WHERE site = 'a'", may_write=True)
    assert {r["n_rows"] for r in ws.profiles()["sites"]} == {2}
    ws.restore(str(tmp_path / "copy"))
    assert ws.query("SELECT count(*) AS n FROM sites").rows[0][0] == 3 and ws.tables() == ["sites"]


def test_documents(spark):
    docs = spark.createDataFrame([("1", "a.txt", "s1", w.READY)], "document_id string, filename string, sha256 string, status string").withColumn("superseded_by", w.F.lit(None).cast("string"))
    new = spark.createDataFrame([("2", "a.txt", "s2"), ("3", "b.txt", "s1")], "document_id string, filename string, sha256 string")
    got = w.register(docs, new)
    assert {r.document_id: r.status for r in got.collect()} == {"1": w.READY, "2": w.PENDING}
    done = {r.document_id: (r.status, r.superseded_by) for r in w.finish(got, "2").collect()}
    assert done == {"1": (w.SUPERSEDED, "2"), "2": (w.READY, None)}
    chunks = spark.createDataFrame([("c1", "1"), ("c2", "2")], "chunk_id string, document_id string")
    assert [r.chunk_id for r in w.searchable(chunks, w.finish(got, "2")).collect()] == ["c2"]
    assert w.searchable(chunks, docs, scope=docs.limit(0)).collect() == []
    messages = spark.createDataFrame([("s", datetime(2024, 1, 1), "say Hello there"), ("s", datetime(2024, 1, 2), "no")], "session_id string, at timestamp, content string")
    assert [r.snippet for r in w.message_search(messages, "hello", around=3).collect()] == ["ay Hello th"]


def test_embeddings(spark):
    chunks = spark.createDataFrame([(1, "a", None, None), (2, "bb", [1.0, 1.0], "old"), (3, "c", [2.0, 2.0], "new")], "chunk_id int, content string, embedding array<double>, embedding_profile string")
    assert tuple(w.embedding_status(chunks, "new").first()) == (3, 1, 1)
    got = w.refresh_embeddings(chunks, lambda texts: [[float(len(t))] * 2 for t in texts], "new", 2)
    assert {r.chunk_id: list(r.embedding) for r in got.collect()} == {1: [1.0, 1.0], 2: [2.0, 2.0], 3: [2.0, 2.0]}
    assert tuple(w.embedding_status(got, "new").first()) == (3, 0, 0)


def test_citations_and_language():
    text, order = renumbered("A【2†x】 b [^1] c [2, 3] d [9] e [7, 8] <|end|>f", {1: "p", 2: "q", 3: "p"})
    assert text == "A[1] b [2] c [1][2] d  e [7, 8] f" and order == ["q", "p"]
    assert detect("der Hund und die Katze ist nicht da") == "german" and detect("これはペンです") == "japanese" and detect("") == "english" and detect("xyz qq") == "english"
