import time

import pytest

from loomspark.plans import gate, saved


@pytest.mark.parametrize("text", ["SET spark.x = 1", "ADD JAR 'x.jar'", "SELECT * FROM parquet.`/etc/x`", "SELECT * FROM _loom_runs", "INSERT INTO graph_nation SELECT 1", "CACHE TABLE x", "SELECT 1; DROP TABLE x", "SUMMARIZE parquet.`/etc/x`", "SUMMARIZE SELECT * FROM _loom_runs", "PIVOT csv.`/etc/x` ON a USING sum(b)", "PIVOT _loom_runs ON a USING sum(b)", "UPDATE x SET a = 1 FROM _loom_runs r WHERE r.a = x.a",
    "INSERT OR REPLACE INTO graph_nation SELECT 1", "CREATE TEMPORARY VIEW v AS SELECT 1"])
def test_refused_whatever_the_rights(spark, text):
    with pytest.raises(gate.Refused):
        gate.check(spark, text, may_write=True)


def test_writes_need_the_right(spark):
    with pytest.raises(gate.Refused):
        gate.check(spark, "DROP TABLE x")
    assert gate.check(spark, "DROP TABLE x", may_write=True) == gate.WRITE
    assert gate.check(spark, "SELECT * FROM x WHERE y IN (SELECT z FROM w)") == gate.READ
    assert gate.check(spark, "SUMMARIZE x") == gate.READ and gate.check(spark, "PIVOT x ON a USING sum(b)") == gate.READ
    for text in ("INSERT OR IGNORE INTO x SELECT 1", "INSERT INTO x SELECT 1 ON CONFLICT DO NOTHING", "UPDATE x SET a = y.a, b = 2 FROM y WHERE x.k = y.k"):
        assert gate.check(spark, text, may_write=True) == gate.WRITE
        with pytest.raises(gate.Refused):
            gate.check(spark, text)
    assert gate.table_refs(spark, "UPDATE x SET a = y.a FROM y WHERE x.k = y.k") == ["x", "y"]


def test_digest_limbs_and_nulls(spark):
    a = spark.createDataFrame([(1, None), (2, "x")], "a int, b string")
    b = spark.createDataFrame([(1, "null"), (2, "x")], "a int, b string")
    assert gate.result_digest(a) != gate.result_digest(b)
    assert gate.result_digest(a) == gate.result_digest(a.orderBy("b"))
    assert gate.result_digest(a.limit(0)) != gate.result_digest(a)


def test_shape_blanks_constants():
    assert gate.shape("select 1 from t where a = 'x'") == gate.shape("SELECT 2 FROM t WHERE a = 'y';")
    assert gate.shape("select a from t") != gate.shape("select b from t")


def test_timeout_cancels(spark):
    began = time.time()
    with pytest.raises(Exception):  # noqa: B017
        gate.with_timeout(spark, 1.0, lambda: spark.range(0, 1 << 40, 1, 2).selectExpr("sum(hash(id) * hash(id + 1))").collect())
    assert time.time() - began < 60


def test_saved_run_that_fails_is_kept(spark):
    runs = saved.run_saved(spark, saved.SavedQuestion("q", ["SELECT * FROM not_there"]), spark.createDataFrame([], saved.RUNS_SCHEMA))
    row = runs.first()
    assert row.ok is False and row.error and row.changed is None
