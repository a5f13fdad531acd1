"""Statement classes, tables, filters, digests, saved questions and charts."""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import charts
from ..plans import gate, saved
from .common import table

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}

#: Statements and what each is.
_STATEMENTS = [
    ("SELECT 1", "read"), ("FROM orders WHERE o_orderkey = 1", "read"), ("WITH t AS (SELECT 1 AS a) SELECT * FROM t", "read"), ("SUMMARIZE orders", "read"), ("DESCRIBE orders", "read"), ("SHOW TABLES", "read"),
    ("EXPLAIN SELECT 1", "read"), ("SELECT 1 UNION ALL SELECT 2", "read"), ("SELECT * EXCLUDE (a) FROM t QUALIFY row_number() OVER (ORDER BY a) = 1", "read"), ("CREATE TABLE x AS SELECT 1 AS a", "write"), ("INSERT INTO x SELECT 1", "write"),
    ("DROP TABLE x", "write"), ("SET a = 1", "write"), ("DELETE FROM x WHERE a = 1", "write"), ("SELEC 1", "invalid"), ("SELECT 1; SELECT 2", "invalid"),
]


def frame(name: str, duck_sql: str | None = None):
    def put(f):
        QUERIES[name] = f
        if duck_sql:
            ORACLE_SQL[name] = duck_sql
        return f

    return put


def _quoted(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


@frame("statement_classes", "SELECT * FROM (VALUES " + ", ".join(f"({_quoted(s)}, '{k}')" for s, k in _STATEMENTS) + ") t(statement, class)")
def statement_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame([(s, gate.classify(spark, s)) for s, _ in _STATEMENTS], "statement string, class string")


@frame("table_refs", "SELECT * FROM (VALUES ('customer'), ('nation'), ('orders')) t(name)")
def table_refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = "WITH big AS (SELECT * FROM orders WHERE o_totalprice > 1) SELECT * FROM big JOIN customer ON o_custkey = c_custkey WHERE c_nationkey IN (SELECT n_nationkey FROM nation)"
    return spark.createDataFrame([(x,) for x in gate.table_refs(spark, text)], "name string")


@frame("filter_extract", "SELECT * FROM (VALUES ('o_orderpriority', '1-URGENT,2-HIGH', false), ('o_orderstatus', 'f', true)) t(column_name, held, folded)")
def filter_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = gate.filters(spark, "SELECT count(*) FROM orders WHERE lower(o_orderstatus) = 'f' AND o_orderpriority IN ('1-URGENT', '2-HIGH') AND o_totalprice > 10")
    return spark.createDataFrame([(f.column, ",".join(f.values), f.folded) for f in found], "column_name string, held string, folded boolean")


@frame("value_grounding", "SELECT 'o_orderstatus' AS column_name, 'X' AS held, 'not held' AS reason WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_orderstatus = 'X') UNION ALL SELECT 'o_orderpriority', '2-HIGH', 'not named' WHERE EXISTS (SELECT 1 FROM orders WHERE o_orderpriority = '2-HIGH') AND EXISTS (SELECT 1 FROM orders WHERE o_orderpriority = '1-URGENT')")
def value_grounding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators import profile

    rows = profile.profile(table(spark, sf_dir, "orders").select("o_orderstatus", "o_orderpriority")).collect()
    held = {r["column_name"]: profile.listed_values(r) for r in rows}
    found = gate.filters(spark, "SELECT 1 FROM orders WHERE o_orderstatus = 'X' AND o_orderpriority = '2-HIGH'")
    got = gate.ground(found, held, "how many 1-URGENT orders are there?")
    return spark.createDataFrame([(u.column, u.value, u.reason) for u in got], "column_name string, held string, reason string")


@frame("statement_shape", "SELECT 'SELECT a FROM t WHERE b = ? AND c IN ( ? )' AS shape")
def statement_shape(spark: SparkSession, sf_dir: str) -> DataFrame:
    one, two = (gate.shape(s) for s in ("select a from t where b = 'x' and c in (1, 2, 3)", "SELECT a FROM t WHERE b = 'y' AND c IN (4)"))
    return spark.createDataFrame([(x,) for x in {one, two}], "shape string")


@frame(
    "result_digest",
    """WITH b AS (SELECT sum(hash(n)) AS h FROM nation n)
SELECT (SELECT h FROM b) = (SELECT sum(hash(n)) FROM (SELECT * FROM nation ORDER BY n_name DESC) n) AS same_in_any_order, (SELECT h FROM b) != (SELECT sum(hash(n)) FROM (SELECT * FROM nation UNION ALL (SELECT * FROM nation LIMIT 1)) n) AS repeats_count,
(SELECT string_agg(column_name, ',') FROM (DESCRIBE nation)) != (SELECT string_agg(column_name, ',') FROM (DESCRIBE SELECT * RENAME (n_name AS name) FROM nation)) AS names_count""",
)
def result_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "nation")
    base = gate.result_digest(df)
    row = (base == gate.result_digest(df.orderBy(F.desc("n_name")).repartition(3)), base != gate.result_digest(df.union(df.limit(1))), base != gate.result_digest(df.withColumnRenamed("n_name", "name")))
    return spark.createDataFrame([row], "same_in_any_order boolean, repeats_count boolean, names_count boolean")


@frame(
    "saved_runs",
    """WITH a AS (SELECT r_name, count(*) AS n FROM region GROUP BY 1), c AS (SELECT r_name, count(*) AS n FROM (SELECT * FROM region UNION ALL (SELECT * FROM region LIMIT 1)) x GROUP BY 1)
SELECT 1 AS run, true AS ok, NULL::BOOLEAN AS changed UNION ALL SELECT 2, true, EXISTS (SELECT * FROM a EXCEPT SELECT * FROM a) UNION ALL SELECT 3, true, EXISTS (SELECT * FROM c EXCEPT SELECT * FROM a)""",
)
def saved_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = spark.createDataFrame([], saved.RUNS_SCHEMA)
    question = saved.SavedQuestion("regions", ["SELECT r_name, count(*) AS n FROM loom_saved GROUP BY r_name"])
    regions = table(spark, sf_dir, "region")
    for day, rows in ((1, regions), (2, regions), (3, regions.union(regions.limit(1)))):
        rows.createOrReplaceTempView("loom_saved")
        runs = saved.run_saved(spark, question, runs, datetime(2024, 1, day, tzinfo=timezone.utc))
    return runs.select(F.dayofmonth("at").alias("run"), "ok", "changed")


@frame("chart_series", "SELECT label, coalesce(sum(n) FILTER (WHERE status = 'F'), 0) AS f, coalesce(sum(n) FILTER (WHERE status = 'O'), 0) AS o FROM (SELECT o_orderpriority AS label, o_orderstatus AS status, CAST(count(*) AS DOUBLE) AS n FROM orders WHERE o_orderstatus IN ('F', 'O') GROUP BY 1, 2) t GROUP BY label")
def chart_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").where("o_orderstatus in ('F', 'O')").groupBy("o_orderpriority", "o_orderstatus").agg(F.count("*").alias("n")).orderBy("o_orderpriority", "o_orderstatus")
    chart = charts.from_rows(rows, x="o_orderpriority", y="n", series="o_orderstatus", title="orders")
    by = dict(chart["series"])
    return spark.createDataFrame([(label, by["F"][i], by["O"][i]) for i, label in enumerate(chart["labels"])], "label string, f double, o double")
