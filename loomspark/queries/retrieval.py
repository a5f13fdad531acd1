"""Keyword, vector and hybrid search. Documents are the chunks; scores are rounded to 6 places, as sums differ in their order."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import workspace
from ..operators import graph, grams, retrieval, segments
from ..steps import shared_folder
from .common import table
from .documents import TERMS_SQL

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}
QUERY = "the tion and her"
TOP = 8


def frame(name: str, duck_sql: str | None = None):
    def put(f):
        QUERIES[name] = f
        if duck_sql:
            ORACLE_SQL[name] = duck_sql
        return f

    return put


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("chunk_id"), F.col("text").alias("content"), "source", "lang")


def _folder(spark: SparkSession) -> str:
    """A new folder for an index, where driver and executors share one."""
    return f"{shared_folder(spark)}/loomspark-{os.getpid()}/{uuid.uuid4().hex}"


def _bm25_sql(words: list[str], where: str = "true", limit: int = TOP) -> str:
    listed = ", ".join(f"'{w}'" for w in words)
    return (
        f"(WITH p AS (SELECT doc_id, term, count(*) AS tf FROM {TERMS_SQL} t GROUP BY 1, 2), c AS (SELECT doc_id, sum(tf) AS dl FROM p GROUP BY 1), s AS (SELECT count(*) AS n, avg(dl) AS mean FROM c), d AS (SELECT term, count(*) AS df FROM p GROUP BY 1) "
        "SELECT p.doc_id AS chunk_id, sum(ln(1 + (s.n - d.df + 0.5) / (d.df + 0.5)) * p.tf * 2.2 / (p.tf + 1.2 * (1 - 0.75 + 0.75 * c.dl / s.mean))) AS score "
        f"FROM p JOIN d USING (term) JOIN c USING (doc_id) CROSS JOIN s WHERE p.term IN ({listed}) AND p.doc_id IN (SELECT doc_id FROM documents WHERE {where}) GROUP BY 1 ORDER BY score DESC, chunk_id LIMIT {limit})"
    )


_VECTOR_SQL = (
    "(SELECT vec_id AS chunk_id, 1 / (2 - list_cosine_similarity(embedding::DOUBLE[], (SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = 0))) AS score FROM embeddings ORDER BY score DESC, vec_id LIMIT 8)"
)


def _rounded(found: DataFrame) -> DataFrame:
    return found.select("chunk_id", F.round("score", 6).alias("score"))


@frame("bm25_topk", f"SELECT chunk_id, round(score, 6) AS score FROM {_bm25_sql(['the', 'tion', 'and', 'her'])} x")
def bm25_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(retrieval.keyword(retrieval.index(chunks(spark, sf_dir)), QUERY, top_k=TOP))


@frame("bm25_stemmed")
def bm25_stemmed(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = chunks(spark, sf_dir).withColumn("language", F.when(F.col("lang") == "en", "english").otherwise(F.col("lang")))
    return _rounded(retrieval.keyword(retrieval.index(rows, language="language"), QUERY, top_k=TOP))


@frame("filtered_search", f"SELECT chunk_id, round(score, 6) AS score FROM {_bm25_sql(['the', 'tion', 'and', 'her'], where=chr(115) + 'ource = ' + chr(39) + 'src0' + chr(39))} x")
def filtered_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = chunks(spark, sf_dir)
    return _rounded(retrieval.keyword(retrieval.index(rows), QUERY, top_k=TOP, scope=rows.where("source = 'src0'")))


@frame("phrase_search", f"SELECT chunk_id, round(1.0 / (60 + r), 6) AS score FROM (SELECT chunk_id, row_number() OVER (ORDER BY score DESC, chunk_id) AS r FROM {_bm25_sql(['the', 'of'], limit=64)} x) y WHERE chunk_id IN (SELECT doc_id FROM documents WHERE contains(lower(regexp_replace(text, '\\s+', ' ', 'g')), 'of the')) ORDER BY score DESC, chunk_id LIMIT 8")
def phrase_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(retrieval.search(retrieval.index(chunks(spark, sf_dir)), '"of the"', mode="keyword", top_k=TOP))


def _vectors(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, list[float]]:
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("chunk_id"), "embedding")
    return e, list(e.where("chunk_id = 0").first()["embedding"])


@frame("vector_topk", f"SELECT chunk_id, round(score, 6) AS score FROM {_VECTOR_SQL} x")
def vector_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, query = _vectors(spark, sf_dir)
    return _rounded(retrieval.vector(rows, query, top_k=TOP))


@frame(
    "hybrid_rrf",
    f"WITH l AS (SELECT chunk_id, row_number() OVER (ORDER BY score DESC, chunk_id) AS r FROM {_bm25_sql(['the', 'tion', 'and', 'her'])} x UNION ALL SELECT chunk_id, row_number() OVER (ORDER BY score DESC, chunk_id) FROM {_VECTOR_SQL} y) "
    "SELECT chunk_id, round(sum(1.0 / (60 + r)), 6) AS score FROM l GROUP BY 1 ORDER BY sum(1.0 / (60 + r)) DESC, chunk_id LIMIT 8",
)
def hybrid_rrf(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, query = _vectors(spark, sf_dir)
    legs = [retrieval.keyword(retrieval.index(chunks(spark, sf_dir)), QUERY, top_k=TOP), retrieval.vector(rows, query, top_k=TOP)]
    return _rounded(retrieval.fuse(legs, top_k=TOP))


@frame("keyword_batch", f"SELECT 1 AS query_id, chunk_id, round(score, 6) AS score FROM {_bm25_sql(['the', 'tion', 'and', 'her'])} x UNION ALL SELECT 2, chunk_id, round(score, 6) FROM {_bm25_sql(['ing', 'of'])} y")
def keyword_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = retrieval.keyword_batch(retrieval.index(chunks(spark, sf_dir)), [(1, QUERY), (2, "ing of")], top_k=TOP)
    return found.select("query_id", "chunk_id", F.round("score", 6).alias("score"))


@frame("vector_batch", f"SELECT 0 AS query_id, chunk_id, round(score, 6) AS score FROM {_VECTOR_SQL} x UNION ALL SELECT 3, chunk_id, round(score, 6) FROM {_VECTOR_SQL.replace('vec_id = 0', 'vec_id = 3')} y")
def vector_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("chunk_id"), "embedding")
    wanted = [(r["chunk_id"], list(r["embedding"])) for r in rows.where("chunk_id in (0, 3)").collect()]
    return retrieval.vector_batch(rows, wanted, top_k=TOP).select("query_id", "chunk_id", F.round("score", 6).alias("score"))


_EDITED = "(SELECT doc_id, CASE WHEN lang = 'de' THEN 'the ring ' || coalesce(text, '') ELSE text END AS text FROM documents WHERE source IS DISTINCT FROM 'src3')"


@frame("index_upkeep", f"SELECT chunk_id, round(score, 6) AS score FROM {_bm25_sql(['the', 'tion', 'and', 'her'], limit=50).replace('FROM documents)', 'FROM ' + _EDITED + ' e)')} x")
def index_upkeep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An index in three additions by language, in which German documents are then replaced and those of one source removed."""
    rows = chunks(spark, sf_dir)
    index = segments.SegmentedIndex(spark, _folder(spark))
    for part in (F.col("lang") == "en", F.col("lang").isin("fr", "es"), ~F.coalesce(F.col("lang").isin("en", "fr", "es"), F.lit(False))):
        index.add(rows.where(part))
    index.add(rows.where("lang = 'de'").withColumn("content", F.concat(F.lit("the ring "), F.coalesce("content", F.lit("")))))
    index.remove(rows.where("source = 'src3'"))
    return _rounded(retrieval.keyword(index.read(), QUERY, top_k=50))


@frame("message_search", """SELECT conv_id AS session_id, turn AS seq, role, trim(regexp_replace(substr(text, greatest(1, instr(lower(text), 'tion the') - 60), 128), '\\s+', ' ', 'g')) AS snippet
FROM conversations WHERE role IN ('user', 'assistant') AND contains(lower(text), 'tion the') ORDER BY conv_id DESC, turn DESC LIMIT 200""")
def message_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("session_id"), F.col("turn").alias("seq"), "role", F.col("text").alias("content"), F.timestamp_seconds("conv_id").alias("created_at"))
    index = _folder(spark)
    workspace.index_messages(said, index)
    return workspace.message_search(said, " Tion the ", index=index, limit=200).select("session_id", "seq", "role", "snippet")


@frame("label_suggestions", """WITH l AS (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[a-z]+')) AS label FROM conversations)
SELECT label, round(jaro_winkler_similarity(label, 'therention'), 9) AS similarity FROM l
WHERE contains(label, 'therention') OR contains('therention', label) OR jaro_winkler_similarity(label, 'therention') >= 0.88 ORDER BY jaro_winkler_similarity(label, 'therention') DESC, length(label), label LIMIT 25""")
def label_suggestions(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = table(spark, sf_dir, "conversations").select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), F.lit(0))).alias("label")).distinct()
    index = _folder(spark)
    grams.write_label_index(words.select(F.col("label").alias("id"), F.lit("word").alias("class_id"), "label", F.col("label").alias("normalized_label")), index)
    found = graph.indexed_suggestions(spark, index, "Therention", most=25)
    return found.select("label", F.round("similarity", 9).alias("similarity"))
