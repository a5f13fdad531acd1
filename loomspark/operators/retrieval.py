"""Keyword, vector and hybrid search over chunks.

The keyword index is two tables: chunks with their number of terms, and postings (term, chunk, tf) with the number of terms of the chunk and the
document frequency of the term beside each, so that a search reads postings only. Postings are written in ``BUCKETS`` folders by hash of the term and sorted in them, so a search reads a folder for each
of its few terms and in it only the row groups that hold them. A search is a filter, a partial sum and a top k.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

try:
    import xxhash
except ImportError:
    xxhash = None

from ..functions.stemmer import STEMMERS, stem
from ..functions.terms import ascii_terms, found_terms, lowered_terms, tallied, tally_rows, terms
from ..steps import Steps
from . import vectors

K1, B = 1.2, 0.75
RRF_K = 60
BUCKETS = 64
#: Up to so many terms of a search are counted within each row.
COUNTED = 16
#: Rows that a task has of a search in flight, about.
DEALT = 100_000
PHRASE_FACTOR, PHRASE_MOST = 4, 500


@dataclass
class Index:
    """chunks: chunk columns and token_count; postings: term, chunk_id, tf, token_count, df, bucket (-1 where they aren't dealt into buckets); n, mean: chunks with terms, and their mean number."""

    chunks: DataFrame
    postings: DataFrame
    n: int
    mean: float
    languages: tuple[str, ...] = ()

    def of(self, wanted: Sequence[str]) -> Index:
        """The index as a search for these terms takes it."""
        return self


def _words(content: str, heading: str | None) -> Column:
    """All terms of a chunk, unstemmed."""
    return lowered_terms(F.col(content)) if heading is None else F.concat(lowered_terms(F.col(content)), lowered_terms(F.col(heading)))


def _tallied(chunks: DataFrame, content: str, heading: str | None, language: str | None) -> DataFrame:
    """Chunks with token_count and loom_terms, [(term, tf)]. With a language column words are stemmed in that language."""
    spoken = F.lit(None).cast("string") if language is None else F.col(language)
    listed = chunks.select("*", _words(content, heading).alias("loom_words"), spoken.alias("loom_language"))
    return listed.select(*chunks.columns, F.size("loom_words").cast("long").alias("token_count"), tallied()("loom_words", "loom_language").alias("loom_terms"))


def _listed(tallies: DataFrame) -> DataFrame:
    """chunk_id, token_count, term, tf. (An explode that isn't outer would be preceded by a filter that counts everything once more.)"""
    return tallies.select("chunk_id", "token_count", F.inline_outer("loom_terms")).where("term is not null")


def _counted(chunks: DataFrame, content: str, heading: str | None, language: str | None) -> DataFrame:
    """chunk_id, token_count, term, tf of chunks, each counted where it is read. Each chunk_id is there once."""
    spoken = F.lit(None).cast("string") if language is None else F.col(language)
    listed = chunks.select("chunk_id", _words(content, heading).alias("w"), spoken.alias("l")).select("chunk_id", F.size("w").cast("long").alias("token_count"), "w", "l")
    kind = dict(chunks.dtypes)["chunk_id"]
    return listed.mapInArrow(tally_rows, f"chunk_id {kind}, token_count long, term string, tf long")


def _postings(counted: DataFrame, frequency: DataFrame) -> DataFrame:
    return counted.join(frequency, "term").withColumn("bucket", F.pmod(F.xxhash64("term"), F.lit(BUCKETS)).cast("int"))


def _frequency(counted: DataFrame) -> DataFrame:
    return counted.groupBy("term").agg(F.count("*").alias("df"))


def build_index(chunks: DataFrame, *, content: str = "content", heading: str | None = None, language: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(chunks with token_count, postings) of chunks with chunk_id."""
    counted = _counted(chunks, content, heading, language)
    return chunks.withColumn("token_count", F.size(_words(content, heading)).cast("long")), _postings(counted, _frequency(counted))


class Flying(Index):
    """An index that is computed as it is used: each search reads the texts once, for its own terms."""

    def __init__(self, chunks: DataFrame, content: str = "content", heading: str | None = None, language: str | None = None) -> None:
        self.chunks, self.postings = build_index(chunks, content=content, heading=heading, language=language)
        self.languages = _languages(chunks, language)
        self._texts, self._options = chunks, (content, heading, language)

    def _rows(self, wanted: Sequence[str]) -> DataFrame:
        """chunk_id, token_count and loom_terms of every chunk, with the wanted terms only."""
        content, heading, language = self._options
        listed = self._texts.select("chunk_id", _words(content, heading).alias("w"), *([F.col(language).alias("l")] if self.languages else []))
        length = F.size("w").cast("long").alias("token_count")
        if self.languages:
            return listed.select("chunk_id", length, tallied(tuple(wanted))("w", "l").alias("loom_terms"))
        hits = F.filter("w", lambda w: w.isin(list(wanted))).alias("h")
        if len(wanted) > COUNTED:  # hits are summed later
            return listed.select("chunk_id", length, hits).select("chunk_id", "token_count", F.transform("h", lambda t: F.struct(t.alias("term"), F.lit(1).cast("long").alias("tf"))).alias("loom_terms"))
        counted = F.transform(F.array_distinct("h"), lambda t: F.struct(t.alias("term"), F.size(F.filter("h", lambda x: x == t)).cast("long").alias("tf")))
        if not all(w.isascii() for w in wanted):
            return listed.select("chunk_id", length, hits).select("chunk_id", "token_count", counted.alias("loom_terms"))
        # Latin texts are looked through as bytes; only others are taken apart into words.
        text = F.col(content) if heading is None else F.concat_ws("\n", content, heading)
        looked = self._texts.select("chunk_id", text.alias("t")).select("chunk_id", "t", found_terms(wanted)("t").alias("f"))
        others = looked.select("chunk_id", "f", F.when(F.col("f").isNull(), lowered_terms(F.col("t"))).alias("w")).select("chunk_id", "f", length, hits)
        return others.select("chunk_id", F.coalesce("f.n", "token_count").alias("token_count"), F.coalesce("f.terms", counted).alias("loom_terms"))

    def of(self, wanted: Sequence[str]) -> Index:
        """The postings of some terms in a table. Rows of one chunk_id are one chunk."""
        rows = Steps(self._texts.sparkSession).write(self._rows(wanted))
        # Dealt once, by number and not by size, as rows pack very well; all that follows for a chunk is in the task that has it.
        rows = rows.repartition(max(1, -(-rows.count() // DEALT)), "chunk_id")
        lengths = rows.groupBy("chunk_id").agg(F.sum("token_count").alias("token_count")).where("token_count > 0")
        n, mean = lengths.agg(F.count("*"), F.coalesce(F.avg("token_count"), F.lit(0.0))).first()
        counted = _listed(rows).groupBy("chunk_id", "term").agg(F.sum("tf").alias("tf"))
        # As many rows as the search has terms.
        frequency = rows.sparkSession.createDataFrame([(r["term"], r["df"]) for r in _frequency(counted).collect()], "term string, df long")
        return Index(self.chunks, counted.join(lengths, "chunk_id").join(F.broadcast(frequency), "term").withColumn("bucket", F.lit(-1)), n, mean, self.languages)

    @functools.cached_property
    def _size(self) -> tuple[int, float]:
        found = self.of([])
        return found.n, found.mean

    n = property(lambda self: self._size[0])
    mean = property(lambda self: self._size[1])


def index(chunks: DataFrame, **options) -> Index:
    """An index that is computed as it is used."""
    return Flying(chunks, **options)


def _languages(chunks: DataFrame, column: str | None) -> tuple[str, ...]:
    """The languages of chunks that have a stemmer; no others change a query's terms."""
    return tuple(sorted(r[0] for r in chunks.select(column).where(F.col(column).isin(*STEMMERS)).distinct().collect())) if column else ()


def write_index(chunks: DataFrame, path: str, *, content: str = "content", heading: str | None = None, language: str | None = None) -> None:
    """Write an index below path: postings by bucket, sorted by term.

    The counts are written first. Document frequencies are a table of their own, so that the join on the term is
    between plain shuffles, whose hot terms adaptive execution splits; and a bucket with a hot term is rebalanced over several files.
    """
    spark = chunks.sparkSession
    _counted(chunks, content, heading, language).write.mode("overwrite").parquet(f"{path}/counted")
    counted = spark.read.parquet(f"{path}/counted")
    _frequency(counted).write.mode("overwrite").parquet(f"{path}/frequency")
    chunks.withColumn("token_count", F.size(_words(content, heading)).cast("long")).write.mode("overwrite").parquet(f"{path}/chunks")
    _postings(counted, spark.read.parquet(f"{path}/frequency")).hint("rebalance", "bucket").sortWithinPartitions("bucket", "term").write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/postings")
    found = spark.read.parquet(f"{path}/chunks").where("token_count > 0").agg(F.count("*").alias("n"), F.coalesce(F.avg("token_count"), F.lit(0.0)).alias("mean"))
    found.withColumn("languages", F.array(*map(F.lit, _languages(chunks, language))).cast("array<string>")).write.mode("overwrite").parquet(f"{path}/size")


def read_index(spark: SparkSession, path: str) -> Index:
    size = spark.read.parquet(f"{path}/size").first()
    return Index(spark.read.parquet(f"{path}/chunks"), spark.read.parquet(f"{path}/postings"), size["n"], size["mean"], tuple(size["languages"]))


def query_terms(spark: SparkSession, text: str, languages: Sequence[str] = ()) -> list[str]:
    """Distinct terms of a query, stemmed under every language of the index; unstemmed without one."""
    words = ascii_terms(text) if text.isascii() else spark.range(1).select(terms(F.lit(text))).first()[0]
    known = [x for x in languages if x in STEMMERS]
    return sorted({stem(w, x) for w in words for x in (known or [""])} | (set(words) if not languages else set()))


def bm25(index: Index, wanted: Sequence[str]) -> DataFrame:
    """(chunk_id, score) of the chunks that hold any term. All statistics are of the whole index, whatever is filtered afterwards."""
    index = index.of(wanted)
    places = sorted({_bucket(index.postings.sparkSession, t) for t in wanted}) if wanted else []
    hits = index.postings.where(F.col("bucket").isin([-1, *places]) & F.col("term").isin(list(wanted)))
    idf = F.log(1 + (F.lit(float(index.n)) - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weight = idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("token_count") / (index.mean or 1.0)))
    return hits.groupBy("chunk_id").agg(F.sum(weight).alias("score")).where("score > 0")


_BUCKET: dict[str, int] = {}


def _bucket(spark: SparkSession, term: str) -> int:
    """The folder of a term, by the hash that wrote it (64-bit xxHash of the bytes, seed 42); without the library a job of Spark tells."""
    if xxhash is not None:
        h = xxhash.xxh64(term.encode(), seed=42).intdigest()
        return (h - (1 << 64) if h >> 63 else h) % BUCKETS
    if term not in _BUCKET:
        _BUCKET[term] = spark.range(1).select(F.pmod(F.xxhash64(F.lit(term)), F.lit(BUCKETS)).cast("int")).first()[0]
    return _BUCKET[term]


def phrases(query: str) -> list[str]:
    """Quoted phrases of a query, white space collapsed, in lower case; none if the quotes don't pair."""
    parts = query.split('"')
    return [] if len(parts) % 2 == 0 else [" ".join(p.split()).lower() for p in parts[1::2] if p.strip()]


def fetch_size(top_k: int, quoted: Sequence[str]) -> int:
    """How many a leg fetches: top_k, or with phrases PHRASE_FACTOR times twice that, PHRASE_MOST at most but top_k at least."""
    return top_k if not quoted else max(top_k, min(2 * top_k * PHRASE_FACTOR, PHRASE_MOST))


def holds_phrases(text: Column, quoted: Sequence[str]) -> Column:
    """Whether a text holds every phrase, whatever its white space (of any kind) and case."""
    flat = F.lower(F.regexp_replace(text, r"(?U)\s+", " "))
    ok = F.lit(True)
    for p in quoted:
        ok = ok & flat.contains(p)
    return ok


def top(scored: DataFrame, k: int, *ties: str) -> DataFrame:
    return scored.orderBy(F.desc("score"), *ties).limit(k)


def keyword(index: Index, query: str, *, top_k: int = 8, scope: DataFrame | None = None, order: str = "chunk_id") -> DataFrame:
    """The best chunks for a query by BM25: chunk_id and score, best first, ties by ``order``. scope: chunk_ids that may be found."""
    scored = bm25(index, query_terms(index.postings.sparkSession, query, index.languages))
    if scope is not None:
        scored = scored.join(scope.select("chunk_id"), "chunk_id", "left_semi")
    if order != "chunk_id":
        scored = scored.join(index.chunks.select("chunk_id", order), "chunk_id")
    return top(scored, fetch_size(top_k, phrases(query)), order)


def vector(chunks: DataFrame, query: Sequence[float], *, top_k: int = 8, embedding: str = "embedding", scope: DataFrame | None = None, profile: tuple[str, str] | None = None) -> DataFrame:
    """The nearest chunks by an exact scan: chunk_id and score = 1 / (1 + cosine distance). profile: (column, value) that vectors must have."""
    if profile:
        chunks = chunks.where(F.col(profile[0]) == profile[1])
    if scope is not None:
        chunks = chunks.join(scope.select("chunk_id"), "chunk_id", "left_semi")
    scored = chunks.select("chunk_id", vectors.cosine(query)(embedding).alias("cosine")).where("cosine is not null")
    return top(scored.select("chunk_id", (1 / (2 - F.col("cosine"))).alias("score")), top_k, "chunk_id")


def keyword_batch(index: Index, queries: Sequence[tuple[int, str]], *, top_k: int = 8) -> DataFrame:
    """(query_id, chunk_id, score, rank): the best chunks of many queries in one job. Postings are read once for all their terms; the
    queries' terms are a driver-side list, so the broadcast side is as small as what was passed in."""
    spark = index.postings.sparkSession
    listed = spark.createDataFrame(list(queries), "query_id long, text string").select("query_id", F.explode(F.array_distinct(terms(F.col("text")))).alias("term"))
    wanted = [(r["query_id"], s) for r in listed.collect() for s in ({stem(r["term"], x) for x in index.languages if x in STEMMERS} or {r["term"]})]
    asked = spark.createDataFrame(sorted(set(wanted)), "query_id long, term string")
    index = index.of(sorted({term for _, term in wanted}))
    places = sorted({_bucket(spark, term) for _, term in wanted})
    hits = index.postings.where(F.col("bucket").isin([-1, *places])).join(F.broadcast(asked), "term")
    idf = F.log(1 + (F.lit(float(index.n)) - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weight = idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("token_count") / (index.mean or 1.0)))
    return _ranked(hits.groupBy("query_id", "chunk_id").agg(F.sum(weight).alias("score")).where("score > 0"), top_k)


def vector_batch(chunks: DataFrame, queries: Sequence[tuple[int, Sequence[float]]], *, top_k: int = 8, embedding: str = "embedding") -> DataFrame:
    """(query_id, chunk_id, score, rank): the nearest chunks of many queries in one exact scan. Each batch of vectors is one matrix product
    and passes on top_k rows a query."""
    ids = np.array([i for i, _ in queries])
    wanted = np.array([q for _, q in queries], np.float64)
    wanted = wanted / np.sqrt((wanted * wanted).sum(1, keepdims=True))

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows, x = vectors._matrix(pdf["embedding"], wanted.shape[1])
            if len(rows):
                cosine = x @ wanted.T
                k = min(top_k, len(rows))
                best = np.argpartition(-cosine, k - 1, axis=0)[:k] if k < len(rows) else np.tile(np.arange(len(rows))[:, None], (1, len(ids)))
                yield pd.DataFrame({"query_id": np.tile(ids, k), "chunk_id": pdf["chunk_id"].to_numpy()[rows[best.ravel()]], "score": 1 / (2 - np.take_along_axis(cosine, best, 0).ravel())})

    scored = chunks.select("chunk_id", F.col(embedding).alias("embedding")).mapInPandas(scan, "query_id long, chunk_id long, score double")
    return _ranked(scored, top_k)


def _ranked(scored: DataFrame, top_k: int) -> DataFrame:
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "chunk_id")
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top_k)


def fuse_batch(legs: Sequence[DataFrame], *, top_k: int = 8, rrf_k: int = RRF_K) -> DataFrame:
    """Reciprocal rank fusion of batch legs."""
    both = functools.reduce(DataFrame.unionByName, (leg.select("query_id", "chunk_id", (1 / (rrf_k + F.col("rank"))).alias("s")) for leg in legs))
    return _ranked(both.groupBy("query_id", "chunk_id").agg(F.sum("s").alias("score")), top_k)


def fuse(legs: Sequence[DataFrame], *, top_k: int = 8, rrf_k: int = RRF_K) -> DataFrame:
    """Reciprocal rank fusion of legs (chunk_id, score) of a few rows each: chunk_id and score, the sum of 1 / (rrf_k + rank + 1) over the legs with ranks
    from 0, ties by chunk_id. Legs are top-k results, so their ranks are numbered on the driver in their own order."""
    spark = legs[0].sparkSession
    scores: dict = {}
    for leg in legs:
        for rank, r in enumerate(leg.collect()):
            scores[r["chunk_id"]] = scores.get(r["chunk_id"], 0.0) + 1 / (rrf_k + rank + 1)
    best = sorted(scores.items(), key=lambda x: (-x[1], x[0]))[:top_k]
    return spark.createDataFrame(pd.DataFrame(best, columns=["chunk_id", "score"]), "chunk_id long, score double") if best else spark.createDataFrame([], "chunk_id long, score double")


def _legs(index: Index, query: str, vector_of: Sequence[float] | None, mode: str, top_k: int, scope: DataFrame | None) -> dict[str, DataFrame]:
    """The legs of a mode by name, each of as many rows as fusion takes."""
    if mode == "vector" and vector_of is None:
        raise ValueError("vector search needs a vector")
    legs = {}
    if mode in ("hybrid", "keyword"):
        legs["keyword"] = keyword(index, query, top_k=top_k, scope=scope)
    if mode != "keyword" and vector_of is not None:
        legs["vector"] = vector(index.chunks, vector_of, top_k=fetch_size(top_k, phrases(query)), scope=scope)
    return legs


def _holding(index: Index, found: DataFrame, quoted: Sequence[str], content: str, heading: str | None) -> DataFrame:
    if not quoted:
        return found
    either = holds_phrases(F.col(content), quoted) if heading is None else holds_phrases(F.col(content), quoted) | holds_phrases(F.col(heading), quoted)
    # What legs fetched are PHRASE_MOST rows or top_k at most; only their texts are looked at.
    few = [r["chunk_id"] for r in found.select("chunk_id").collect()]
    return found.join(index.chunks.where(F.col("chunk_id").isin(few)).where(either).select("chunk_id"), "chunk_id", "left_semi")


def search(index: Index, query: str, *, vector_of: Sequence[float] | None = None, mode: str = "hybrid", top_k: int = 8, content: str = "content", heading: str | None = None, scope: DataFrame | None = None, reranker=None) -> DataFrame:
    """Search in mode hybrid, keyword or vector. hybrid without a vector is keyword; vector without one is an error. Quoted phrases filter what the
    legs fetched. reranker: (query, [texts]) -> order of places; what it leaves out follows in the fused order."""
    quoted = phrases(query)
    legs = _legs(index, query, vector_of, mode, top_k, scope)
    found = _holding(index, fuse(list(legs.values()), top_k=fetch_size(top_k, quoted)), quoted, content, heading)
    found = top(found, top_k, "chunk_id")
    return found if reranker is None else rerank(index, found, query, reranker, content)


def explain(index: Index, query: str, *, vector_of: Sequence[float] | None = None, mode: str = "hybrid", top_k: int = 8, content: str = "content", heading: str | None = None, scope: DataFrame | None = None) -> DataFrame:
    """How ``search`` came to its result: chunk_id, keyword_rank, keyword_score, vector_rank, vector_score, rank and score of every chunk that a leg found.

    Ranks count from 1; a leg that didn't find a chunk, or isn't in the mode, leaves its two columns null, and rank and score are null for chunks that
    the quoted phrases or top_k leave out. Each leg runs once; its rows, fetch_size many at most, come to the driver to be numbered.
    """
    spark = index.postings.sparkSession
    found = {name: [(r["chunk_id"], r["score"]) for r in leg.collect()] for name, leg in _legs(index, query, vector_of, mode, top_k, scope).items()}
    legs = [spark.createDataFrame(rows, "chunk_id long, score double") for rows in found.values()]
    quoted = phrases(query)
    kept = _holding(index, fuse(legs, top_k=fetch_size(top_k, quoted)), quoted, content, heading)
    found["kept"] = [(r["chunk_id"], r["score"]) for r in top(kept, top_k, "chunk_id").collect()]
    place = {name: {c: (n, s) for n, (c, s) in enumerate(rows, 1)} for name, rows in found.items()}
    rows = [(c, *(x for name in ("keyword", "vector", "kept") for x in place.get(name, {}).get(c, (None, None)))) for c in sorted(set().union(*place.values()))]
    schema = "chunk_id long, keyword_rank int, keyword_score double, vector_rank int, vector_score double, rank int, score double"
    return spark.createDataFrame(rows, schema).orderBy(F.col("rank").asc_nulls_last(), "chunk_id")


def rerank(index: Index, found: DataFrame, query: str, reranker, content: str = "content") -> DataFrame:
    """Candidates in a reranker's order; unknown and repeated places are ignored, a failure keeps the order, one candidate isn't reranked."""
    rows = found.join(index.chunks.select("chunk_id", content), "chunk_id").orderBy(F.desc("score"), "chunk_id").collect()
    order: list[int] = []
    if len(rows) > 1:
        try:
            for i in reranker(query, [r[content] for r in rows]):
                if 0 <= i < len(rows) and i not in order:
                    order.append(i)
        except Exception:  # noqa: BLE001  a reranker that fails changes nothing
            order = []
    order += [i for i in range(len(rows)) if i not in order]
    return found.sparkSession.createDataFrame([(rows[i]["chunk_id"], rows[i]["score"], n) for n, i in enumerate(order)], "chunk_id long, score double, place int")


def document_filter(documents: DataFrame, *, types: Sequence[str] = (), sources: Sequence[str] = (), tags: Sequence[str] = (), since=None, until=None, author: str | None = None) -> DataFrame:
    """Documents that fit every given field: any of the types, sources and tags (in any case); authored, else ingested, between the dates; author as a part."""
    out = documents
    if types:
        out = out.where(F.col("mime").isin(list(types)))
    if sources:
        out = out.where(F.col("source").isin(list(sources)))
    if tags:
        out = out.where(F.arrays_overlap(F.transform("tags", F.lower), F.array(*(F.lit(t.lower()) for t in tags))))
    day = F.coalesce("authored_at", "ingested_at") if since or until else None
    if since:
        out = out.where(day >= F.lit(since))
    if until:
        out = out.where(day <= F.lit(until))
    return out.where(F.lower("author").contains(author.lower())) if author else out


def pinned(documents: DataFrame, budget: int) -> list:
    """Pinned documents, newest first, as long as they fit the token budget (characters / 4 each); a later smaller one may still fit."""
    out, left = [], budget
    for r in documents.where("pinned").select("document_id", F.ceil(F.length("content") / 4).alias("tokens"), "ingested_at").orderBy(F.desc("ingested_at"), "document_id").toLocalIterator():
        if r["tokens"] <= left:
            out.append(r["document_id"])
            left -= r["tokens"]
    return out
