"""Sections, chunks, captions, term counts, labelling."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import terms
from ..operators import caps, chunking, labelling, languages
from ..sources import documents as parsers
from ..sources import embedded
from ..steps import shared_folder
from .common import table

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def frame(name: str, duck_sql: str | None = None):
    def put(f):
        QUERIES[name] = f
        if duck_sql:
            ORACLE_SQL[name] = duck_sql
        return f

    return put


@frame("html_sections")
def html_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parsers.sections(table(spark, sf_dir, "pages").withColumn("name", F.lit("page.html")), "page_id", "html", "name")


_TOKENS = r"regexp_extract_all(text, '[\p{L}\p{N}]+|[^\s\p{L}\p{N}]')"


@frame(
    "token_chunks",
    f"WITH t AS (SELECT doc_id, {_TOKENS} AS w FROM documents), s AS (SELECT doc_id, w, unnest(CASE WHEN len(w) <= 512 THEN [0] ELSE range(0, len(w), 448) END) AS i FROM t) "
    "SELECT doc_id, CAST(i // 448 AS INTEGER) AS chunk_index, array_to_string(w[i + 1:i + 512], ' ') AS content, CAST(least(512, len(w) - i) AS INTEGER) AS token_count FROM s WHERE regexp_matches(array_to_string(w[i + 1:i + 512], ' '), '[\\p{L}\\p{N}]')",
)
def token_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunking.chunks(table(spark, sf_dir, "documents"), "doc_id", "text")


#: Terms in SQL: the parts of runs joined by - . _ / :, and joined runs without punctuation.
TERMS_SQL = (
    "(SELECT doc_id, unnest(list_concat(list_transform(flatten(list_transform(runs, lambda r: regexp_split_to_array(r, '[-._/:]+'))), lambda x: lower(x)), "
    "list_transform(list_filter(runs, lambda r: regexp_matches(r, '[-._/:]')), lambda r: lower(regexp_replace(r, '[-._/:]+', '', 'g'))))) AS term "
    r"FROM (SELECT doc_id, regexp_extract_all(text, '[\p{L}\p{N}]+(?:[-._/:]+[\p{L}\p{N}]+)*') AS runs FROM documents) x)"
)


@frame("term_frequencies", f"SELECT doc_id, term, count(*) AS tf FROM {TERMS_SQL} t GROUP BY 1, 2")
def term_frequencies(spark: SparkSession, sf_dir: str) -> DataFrame:
    listed = table(spark, sf_dir, "documents").select("doc_id", F.explode(terms.cased_terms(F.col("text"))).alias("term")).withColumn("term", F.lower("term"))
    return listed.groupBy("doc_id", "term").agg(F.count("*").alias("tf"))


@frame("caption_runs", "SELECT * FROM (VALUES (1, '0:00', 'a' || chr(10) || 'b'), (1, '0:30', 'c'), (2, '1:01:05', repeat('x', 700)), (2, '1:01:09', 'y')) t(file, locator, content)")
def caption_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    cues = [(1, 0.0, 2.0, "a"), (1, 3.0, 5.0, "b"), (1, 30.0, 31.0, "c"), (2, 3665.0, 3668.0, "x" * 700), (2, 3669.0, 3670.0, "y"), (2, 3671.0, 3672.0, " ")]
    return chunking.merged_captions(spark.createDataFrame(cues, "file int, start double, end double, text string"), "file")


@frame("label_keys", """SELECT (SELECT CASE WHEN count(DISTINCT doc_id) = count(*) THEN 'doc_id' END FROM documents) AS documents, (SELECT CASE WHEN count(DISTINCT event_id) = count(*) THEN 'event_id' END FROM events) AS events,
(SELECT CASE WHEN count(DISTINCT conv_id) < count(*) THEN 'conv_id' END FROM conversations) AS refused""")
def label_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    try:
        refused = labelling.pick_key(table(spark, sf_dir, "conversations").select("conv_id"))
    except ValueError as e:
        refused = str(e).split(": ")[1].split(" (")[0]
    row = labelling.pick_key(table(spark, sf_dir, "documents")), labelling.pick_key(table(spark, sf_dir, "events")), refused
    return spark.createDataFrame([row], "documents string, events string, refused string")


def _lengths(texts: list[str]) -> list[dict]:
    """A stand-in decision model: whether a text is long."""
    return [{"long": float(len(t) > 2000)} for t in texts]


@frame("label_incremental", "SELECT doc_id, CASE WHEN doc_id IN (SELECT doc_id FROM labels) THEN -1.0 WHEN trim(text) = '' THEN NULL ELSE CAST(length(text) > 2000 AS INTEGER) * 1.0 END AS long, CASE WHEN doc_id IN (SELECT doc_id FROM labels) THEN false ELSE length(text) > 20000 END AS truncated FROM documents")
def label_incremental(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    there = docs.join(table(spark, sf_dir, "labels").select("doc_id"), "doc_id", "left_semi").select("doc_id", F.lit(-1.0).alias("long"), F.lit(False).alias("truncated"))
    return labelling.incremental(docs, "doc_id", ["text"], [labelling.Question("long", "probability")], _lengths, there)


@frame("pinned_documents", "SELECT * FROM (VALUES ('new'), ('old')) t(document_id)")
def pinned_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators.retrieval import pinned

    docs = spark.createDataFrame([("new", "x" * 400, 3, True), ("big", "x" * 4000, 2, True), ("old", "x" * 100, 1, True), ("loose", "x", 4, False)], "document_id string, content string, ingested_at int, pinned boolean")
    return spark.createDataFrame([(d,) for d in pinned(docs, 200)], "document_id string")


_GRAMS = "(SELECT doc_id, lang, unnest(list_transform(range(1, length(t) - 1), lambda i: substr(t, i, 3))) AS gram FROM (SELECT doc_id, lang, ' ' || trim(regexp_replace(lower(coalesce(text, '')), '[^\\p{L}]+', ' ', 'g')) || ' ' AS t FROM documents) x)"


@frame(
    "languages",
    f"""WITH g AS {_GRAMS}, c AS (SELECT gram, lang, count(*) AS n FROM g WHERE lang IS NOT NULL GROUP BY ALL), t AS (SELECT lang, sum(n) AS total FROM c GROUP BY 1), v AS (SELECT count(DISTINCT gram) AS v FROM c),
p AS (SELECT k.gram, t.lang, ln((coalesce(n, 0) + 0.5) / (total + 0.5 * v)) AS share FROM (SELECT DISTINCT gram FROM c) k CROSS JOIN t CROSS JOIN v LEFT JOIN c ON c.gram = k.gram AND c.lang = t.lang),
s AS (SELECT doc_id, p.lang, count(*) AS n_grams, sum(share) AS s FROM g JOIN p USING (gram) GROUP BY ALL),
r AS (SELECT doc_id, lang AS language, n_grams, (s - lead(s) OVER w) / n_grams AS advantage FROM s WINDOW w AS (PARTITION BY doc_id ORDER BY s DESC, lang) QUALIFY row_number() OVER w = 1)
SELECT doc_id, language, coalesce(n_grams, 0) AS n_grams, round(advantage, 6) AS advantage, coalesce(n_grams >= 20 AND advantage >= 0.05, false) AS reliable FROM (SELECT DISTINCT doc_id FROM documents) d LEFT JOIN r USING (doc_id)""",
)
def language_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return languages.detect(docs, languages.profiles(docs), key="doc_id").withColumn("advantage", F.round("advantage", 6))


@frame(
    "byte_budget",
    """WITH c AS (SELECT doc_id, CASE WHEN length(text) > 300 THEN substr(text, 1, 300) || '…(+' || (length(text) - 300) || ' chars)' ELSE text END AS text, lang, source, n_chars, CASE WHEN length(text) > 300 THEN 1 ELSE 0 END AS cut_cells FROM documents),
s AS (SELECT *, sum(strlen('[' || doc_id || ',' || coalesce(to_json(text)::VARCHAR, 'null') || ',' || coalesce(to_json(lang)::VARCHAR, 'null') || ',' || coalesce(to_json(source)::VARCHAR, 'null') || ',' || coalesce(n_chars::VARCHAR, 'null') || ']')) OVER (ORDER BY doc_id) AS upto FROM c)
SELECT doc_id, text, lang, source, n_chars, cut_cells FROM s WHERE upto <= 100000""",
)
def byte_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    return caps.byte_budget(table(spark, sf_dir, "documents"), 100_000, 300)


@frame("first_rows", "SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem LIMIT 5000")
def first_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return caps.first_rows(table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey"), 5000)


@frame(
    "embedded_tables",
    """WITH r AS (SELECT 'nation_' || n_nationkey AS stem, 'c_custkey BIGINT, c_name VARCHAR, c_acctbal DOUBLE' AS columns, count(*) AS n, sum(c_acctbal) AS total FROM customer JOIN nation ON n_nationkey = c_nationkey GROUP BY 1
UNION ALL SELECT 'nation_' || n_nationkey, 's_suppkey BIGINT, s_name VARCHAR, s_acctbal DOUBLE', count(*), sum(s_acctbal) FROM supplier JOIN nation ON n_nationkey = s_nationkey GROUP BY 1)
SELECT stem || '_table' || row_number() OVER (PARTITION BY stem ORDER BY columns) AS table_name, columns, n, round(total, 2) AS total FROM r WHERE n >= 20""",
)
def embedded_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page for each nation, with its customers and its suppliers as tables; those of 20 rows or more become tables, which are then read by their types."""

    def listed(name: str, mark: str, own: str) -> DataFrame:
        names = [f"{mark}_{own}", f"{mark}_name", f"{mark}_acctbal"]
        cells = F.concat(*(F.concat(F.lit("<td>"), F.col(c).cast("string"), F.lit("</td>")) for c in names))
        line = F.concat(F.lit("<tr>"), cells, F.lit("</tr>"))
        head = "<table><tr>" + "".join(f"<th>{c}</th>" for c in names) + "</tr>"
        return table(spark, sf_dir, name).groupBy(F.col(f"{mark}_nationkey").alias("n_nationkey")).agg(F.concat(F.lit(head), F.array_join(F.collect_list(line), ""), F.lit("</table>")).alias(name))

    pages = table(spark, sf_dir, "nation").join(listed("customer", "c", "custkey"), "n_nationkey", "left").join(listed("supplier", "s", "suppkey"), "n_nationkey", "left")
    html = pages.select(F.concat(F.lit("nation_"), "n_nationkey").alias("stem"), F.concat(F.lit("<p>Nation</p>"), F.coalesce("customer", F.lit("")), F.lit("<p>and</p>"), F.coalesce("supplier", F.lit(""))).alias("html"), F.lit("page.html").alias("name"))
    path = f"{shared_folder(spark)}/loomspark-{os.getpid()}/{uuid.uuid4().hex}"
    columns = embedded.load_tables(embedded.find_tables(parsers.sections(html, "stem", "html", "name"), "stem", F.col("stem")), path)
    described = columns.groupBy("table_name").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("position", F.concat_ws(" ", "column_name", "data_type").alias("c")))), lambda x: x["c"]), ", ").alias("columns"))
    rows = spark.read.schema("row int, cells array<string>, table_name string").parquet(f"{path}/rows")
    return rows.groupBy("table_name").agg(F.count("*").alias("n"), F.round(F.sum(F.col("cells")[2].cast("double")), 2).alias("total")).join(described, "table_name")
