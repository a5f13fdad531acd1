"""Profiles, warnings, keys, retyping, type inference."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import profile as p
from .common import STAR, table

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def frame(name: str, duck_sql: str | None = None):
    def put(f):
        QUERIES[name] = f
        if duck_sql:
            ORACLE_SQL[name] = duck_sql
        return f

    return put


_EVENTS = {"event_id": "numeric", "ts": "temporal", "user_id": "numeric", "event_type": "text", "value": "numeric", "props": "text"}


def _profile_sql(name: str, kinds: dict[str, str]) -> str:
    number = "count(*) FILTER (WHERE TRY_CAST({c} AS DOUBLE) IS NOT NULL) / nullif(count({c}), 0)"
    date = "count(*) FILTER (WHERE TRY_CAST({c} AS DATE) IS NOT NULL) / nullif(count({c}), 0)"
    return " UNION ALL ".join(
        f"SELECT '{c}' AS column_name, '{k}' AS kind, count(*) AS n_rows, count({c}) AS non_null, count(DISTINCT {c}) AS distinct_values, "
        f"CAST({number.format(c=c) if k == 'text' else 'NULL'} AS DOUBLE) AS number_share, CAST({date.format(c=c) if k == 'text' else 'NULL'} AS DOUBLE) AS date_share FROM {name}"
        for c, k in kinds.items()
    )


@frame("profile_columns", _profile_sql("events", _EVENTS))
def profile_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p.profile(table(spark, sf_dir, "events")).drop("min", "max", "top")


@frame("profile_ranges", "SELECT 'o_orderkey' AS column_name, CAST(min(o_orderkey) AS VARCHAR) AS min, CAST(max(o_orderkey) AS VARCHAR) AS max FROM orders UNION ALL SELECT 'o_custkey', CAST(min(o_custkey) AS VARCHAR), CAST(max(o_custkey) AS VARCHAR) FROM orders UNION ALL SELECT 'o_orderdate', CAST(min(o_orderdate) AS VARCHAR), CAST(max(o_orderdate) AS VARCHAR) FROM orders")
def profile_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p.profile(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate")).select("column_name", "min", "max")


@frame("profile_top_values", "SELECT column_name, value, n FROM (SELECT *, row_number() OVER (PARTITION BY column_name ORDER BY n DESC, value) AS r FROM (SELECT 'p_brand' AS column_name, p_brand AS value, count(*) AS n FROM part GROUP BY 2 UNION ALL SELECT 'p_type', p_type, count(*) FROM part GROUP BY 2) t) u WHERE r <= 50")
def profile_top_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = p.profile(table(spark, sf_dir, "part").select("p_brand", "p_type"))
    return got.select("column_name", F.explode("top").alias("t")).select("column_name", "t.value", "t.n")


def _warnings_sql() -> str:
    """The warnings over all of lineitem, from the shares of each made column."""
    odd = """(SELECT l_partkey AS part_id, CAST(l_quantity AS VARCHAR) AS weight, CASE WHEN l_orderkey = (SELECT max(l_orderkey) FROM lineitem) THEN 'on hold' ELSE strftime(l_shipdate, '%Y-%m-%d') END AS sent,
      CAST(NULL AS VARCHAR) AS discarded, CASE WHEN l_returnflag = 'R' THEN l_linestatus END AS returned FROM lineitem)"""
    parts = [f"SELECT 'part_id' AS column_name, 'repeated key' AS what, NULL AS fix FROM {odd} t HAVING count(DISTINCT part_id) < count(part_id)"]
    for c in ("part_id", "weight", "sent", "discarded", "returned"):
        parts.append(f"SELECT '{c}', CASE WHEN count({c}) = 0 THEN 'all null' ELSE 'half or more null' END, NULL FROM {odd} t HAVING (count(*) - count({c})) * 2 >= count(*)")
    for c in ("weight", "sent", "returned"):
        number, date = (f"count(TRY_CAST({c} AS {k})) / nullif(count({c}), 0)" for k in ("DOUBLE", "DATE"))
        parts.append(f"SELECT '{c}', 'numbers as text', CASE WHEN {number} = 1 THEN 'DOUBLE' END FROM {odd} t HAVING {number} >= 0.9")
        parts.append(f"SELECT '{c}', 'dates as text', CASE WHEN {date} = 1 THEN 'DATE' END FROM {odd} t HAVING {number} < 0.9 AND {date} >= 0.9")
    return " UNION ALL ".join(parts)


@frame("profile_warnings", _warnings_sql())
def profile_warnings(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem")
    odd = rows.select(
        F.col("l_partkey").alias("part_id"), F.col("l_quantity").cast("string").alias("weight"),
        F.when(F.col("l_orderkey") == rows.agg(F.max("l_orderkey")).first()[0], "on hold").otherwise(F.date_format("l_shipdate", "yyyy-MM-dd")).alias("sent"),
        F.lit(None).cast("string").alias("discarded"), F.when(F.col("l_returnflag") == "R", F.col("l_linestatus")).alias("returned"),
    )
    got = p.warnings(p.profile(odd).collect())
    return spark.createDataFrame([(w.column, w.what, w.fix) for w in got], "column_name string, what string, fix string")


#: The whole-number columns of each table, those that end in id first.
_WHOLE = {
    "region": ("r_regionkey",), "nation": ("n_nationkey", "n_regionkey"), "customer": ("c_custkey", "c_nationkey"), "supplier": ("s_suppkey", "s_nationkey"), "part": ("p_partkey", "p_size"), "orders": ("o_orderkey", "o_custkey"),
    "lineitem": ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber"), "events": ("event_id", "user_id"),
}


def _keys_sql() -> str:
    one = lambda t, c: f"WHEN count({c}) = count(*) AND count(DISTINCT {c}) = count(*) THEN '{c}'"
    return " UNION ALL ".join(f"SELECT '{t}' AS name, CASE {' '.join(one(t, c) for c in cs)} END AS key FROM {t}" for t, cs in _WHOLE.items())


@frame("key_columns", _keys_sql())
def key_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = []
    for t in STAR:
        df = table(spark, sf_dir, t)
        whole = [c for c, kind in df.dtypes if kind in ("int", "bigint")]
        found.append((t, p.key_column(sorted(p.profile(df.select(*whole)).collect(), key=lambda r: whole.index(r["column_name"])))))
    return spark.createDataFrame(found, "name string, key string")


@frame("strict_retype", "SELECT event_id, CAST(user_id AS VARCHAR) AS user_id, CAST(ts AS DATE) AS ts FROM events")
def strict_retype(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p.retype(table(spark, sf_dir, "events").select("event_id", "user_id", "ts"), p.parse_retypes("user_id=VARCHAR, ts=DATE"))


_DOCUMENTS = {"doc_id": "numeric", "text": "text", "lang": "text", "source": "text", "n_chars": "numeric"}


@frame("text_candidates", f"""SELECT column_name FROM ({_profile_sql("documents", _DOCUMENTS)}) p WHERE kind = 'text' AND non_null * 2 >= n_rows AND distinct_values >= 2 AND coalesce(number_share, 0) < 0.9 AND coalesce(date_share, 0) < 0.9
  AND distinct_values < n_rows AND column_name NOT LIKE '%id'""")
def text_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = p.profile(table(spark, sf_dir, "documents")).collect()
    return spark.createDataFrame([(c,) for c in p.text_candidates(rows)], "column_name string")


@frame("find_tables", "SELECT 'orders' AS name")
def find_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    cards = {t: p.card(t, table(spark, sf_dir, t).columns) for t in STAR} | {f"filler_{i}": f"filler number {i}" for i in range(30)}
    return spark.createDataFrame([(t,) for t in p.rank_tables("total price of orders by o_orderdate", cards)[:1]], "name string")


def _types_sql() -> str:
    """The types of the made text columns of all orders, cell by cell."""
    cells = {
        "whole": "CAST(o_orderkey AS VARCHAR)", "mixed": "CASE WHEN o_orderkey % 2 = 0 THEN CAST(o_orderkey AS VARCHAR) ELSE CAST(o_totalprice AS VARCHAR) END", "day": "strftime(o_orderdate, '%Y-%m-%d')",
        "moment": "CASE WHEN o_orderkey % 2 = 0 THEN strftime(o_orderdate, '%Y-%m-%d') ELSE strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') END", "flag": "CASE WHEN o_orderkey % 2 = 0 THEN 'true' ELSE 'False' END",
        "words": "CASE WHEN o_orderkey % 9 = 0 THEN 'none' ELSE CAST(o_orderkey AS VARCHAR) END", "nothing": "''",
    }
    kind = """CASE WHEN trim(x) = '' THEN NULL WHEN regexp_full_match(x, '[+-]?[0-9]{1,19}') AND TRY_CAST(x AS BIGINT) IS NOT NULL THEN 'BIGINT' WHEN TRY_CAST(x AS DOUBLE) IS NOT NULL THEN 'DOUBLE'
      WHEN lower(x) IN ('true', 'false') THEN 'BOOLEAN' WHEN length(x) = 10 AND TRY_CAST(x AS DATE) IS NOT NULL THEN 'DATE' WHEN TRY_CAST(x AS TIMESTAMP) IS NOT NULL THEN 'TIMESTAMP' ELSE 'VARCHAR' END"""
    listed = " UNION ALL ".join(f"SELECT '{c}' AS column_name, {x} AS x FROM orders" for c, x in cells.items())
    has = "count(*) FILTER (WHERE k = '{}')"
    n, all_ = "count(k)", lambda *kinds: " + ".join(has.format(k) for k in kinds)
    cases = " ".join(f"WHEN {all_(k)} = {n} THEN '{k}'" for k in ("BIGINT", "DOUBLE", "BOOLEAN", "DATE", "TIMESTAMP"))
    return f"SELECT column_name, CASE WHEN {n} = 0 THEN 'VARCHAR' {cases} WHEN {all_('BIGINT', 'DOUBLE')} = {n} THEN 'DOUBLE' WHEN {all_('DATE', 'TIMESTAMP')} = {n} THEN 'TIMESTAMP' ELSE 'VARCHAR' END AS type FROM (SELECT column_name, {kind} AS k FROM ({listed}) c) t GROUP BY 1"


@frame("infer_types", _types_sql())
def infer_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..sources.infer import infer_types as infer

    o = table(spark, sf_dir, "orders")
    text = o.select(
        F.col("o_orderkey").cast("string").alias("whole"), F.when(F.col("o_orderkey") % 2 == 0, F.col("o_orderkey").cast("string")).otherwise(F.col("o_totalprice").cast("string")).alias("mixed"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("day"),
        F.when(F.col("o_orderkey") % 2 == 0, F.date_format("o_orderdate", "yyyy-MM-dd")).otherwise(F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss")).alias("moment"), F.when(F.col("o_orderkey") % 2 == 0, "true").otherwise("False").alias("flag"),
        F.when(F.col("o_orderkey") % 9 == 0, "none").otherwise(F.col("o_orderkey").cast("string")).alias("words"), F.lit("").alias("nothing"),
    )
    return spark.createDataFrame(list(infer(text).items()), "column_name string, type string")
