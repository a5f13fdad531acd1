"""The queries of this subpackage, with the contract columns, and the SQL that gives the same rows where SQL can.

Each query is thin: it calls its operator on the whole table with production parameters.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op3_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .minhash import near_duplicates

    return near_duplicates(_table(spark, sf_dir, "documents"), words=3, least_percent=85)


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import toxicity

    docs = _table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.fit(docs, _table(spark, sf_dir, "labels")))


def op2_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .suffix_dedup import removal_digests

    return removal_digests(_table(spark, sf_dir, "documents"))


def op4_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .embed_dedup import near_duplicate_vectors

    return near_duplicate_vectors(_table(spark, sf_dir, "embeddings"))


def op5_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .ppm import score

    return score(_table(spark, sf_dir, "documents"))


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .warc import archive_round_trip

    return archive_round_trip(_table(spark, sf_dir, "pages"))


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .url_filter import judge

    return judge(_table(spark, sf_dir, "pages")).drop("score")


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import quality_fm

    docs = _table(spark, sf_dir, "documents")
    return quality_fm.score(docs, quality_fm.fit(docs, _table(spark, sf_dir, "labels")))


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .decontam import leaks

    return leaks(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


#: The vocabulary file that op10 and the pipeline read.
PIECES_MODEL = "/opt/tokenizers/piece_bpe_32k.model"


def op10_sentencepiece(spark: SparkSession, sf_dir: str, model: str = PIECES_MODEL) -> DataFrame:
    from .pieces import encoding_digests

    return encoding_digests(_table(spark, sf_dir, "documents"), model)


def op11_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .centroids import cluster

    return cluster(_table(spark, sf_dir, "embeddings"))


#: The vocabulary file that op12 reads.
BPE_FILE = "/opt/tokenizers/word_bpe_49k.json"


def op12_bpe(spark: SparkSession, sf_dir: str, path: str = BPE_FILE) -> DataFrame:
    from .bpe import token_digests

    return token_digests(_table(spark, sf_dir, "documents"), path)


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .negatives import hard_negatives

    rows = _table(spark, sf_dir, "embeddings")
    return hard_negatives(rows.withColumn("label", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_toxicity": op1_toxicity,
    "op2_suffix_array_dedup": op2_suffix_array_dedup,
    "op3_minhash_near_dedup": op3_minhash_near_dedup,
    "op4_embedding_near_dedup": op4_embedding_near_dedup,
    "op5_lm_scoring": op5_lm_scoring,
    "op6_warc": op6_warc,
    "op7_url_filter": op7_url_filter,
    "op8_quality": op8_quality,
    "op9_decontamination": op9_decontamination,
    "op10_sentencepiece": op10_sentencepiece,
    "op11_centroids": op11_centroids,
    "op12_bpe": op12_bpe,
    "op13_hard_negatives": op13_hard_negatives,
}

#: A-Z in lower case only, as the contracts say; DuckDB's lower() would change other letters too.
_LOWER = "translate(coalesce({0}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = rf"regexp_extract_all({_LOWER}, '[^\x20\x09-\x0D]+')"


def shingle_components_sql(source: str, words: int, least_percent: int) -> str:
    """The CTEs ``sets`` (doc_id, n_shingles) and ``comp`` (doc_id, component_id) over a table with doc_id and text."""
    joined = " || ' ' || ".join(f"w[i + {j}]" if j else "w[i]" for j in range(words))
    return f"""
words AS (SELECT doc_id, {_WORDS.format("text")} AS w FROM {source}),
grams AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < {words} THEN [array_to_string(w, ' ')]
  ELSE list_distinct([{joined} for i in range(1, len(w) - {words - 2})]) END AS g FROM words),
sets AS (SELECT doc_id, g, len(g) AS n_shingles FROM grams),
rows AS (SELECT doc_id, n_shingles, unnest(g) AS s FROM sets),
pairs AS (SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS both_n, any_value(a.n_shingles) AS n, any_value(b.n_shingles) AS m
  FROM rows a JOIN rows b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2),
links AS (SELECT u, v FROM pairs WHERE 100 * both_n >= {least_percent} * (n + m - both_n)),
both_ways AS (SELECT u, v FROM links UNION ALL SELECT v, u FROM links),
reach AS (SELECT doc_id AS node, doc_id AS seen FROM sets UNION SELECT r.node, b.v FROM reach r JOIN both_ways b ON r.seen = b.u),
comp AS (SELECT node AS doc_id, min(seen) AS component_id FROM reach GROUP BY 1)"""


def leaks_sql(words: int = 5, least: float = 0.8) -> str:
    """Best windows of items in documents, for items of ``words`` words or more."""
    gram = " || ' ' || ".join(f"w[i + {j}]" if j else "w[i]" for j in range(words))
    return f"""WITH
d AS (SELECT doc_id, {_WORDS.format("text")} AS w FROM documents), b AS (SELECT DISTINCT item_id, {_WORDS.format("text")} AS w FROM benchmark),
dg AS (SELECT doc_id, len(w) AS n, i, {gram} AS s FROM (SELECT doc_id, w, unnest(range(1, len(w) - {words - 2})) AS i FROM d) x),
bg AS (SELECT item_id, len(w) AS n, {gram} AS s FROM (SELECT item_id, w, unnest(range(1, len(w) - {words - 2})) AS i FROM b) x),
bc AS (SELECT item_id, n, s, count(*) AS c FROM bg GROUP BY ALL),
hits AS (SELECT doc_id, item_id, dg.i AS i, s, c, dg.n AS dn, least(bc.n, dg.n) AS nw, bc.n - {words - 1} AS mi FROM dg JOIN bc USING (s)),
starts AS (SELECT DISTINCT doc_id, item_id, nw, mi, x AS pos FROM (SELECT *, unnest(range(greatest(1, i - nw + {words}), least(i, dn - nw + 1) + 1)) AS x FROM hits) y),
bags AS (SELECT t.doc_id, t.item_id, t.nw, t.mi, t.pos, h.s, least(count(*), any_value(h.c)) AS both_n
  FROM starts t JOIN hits h ON t.doc_id = h.doc_id AND t.item_id = h.item_id AND h.i BETWEEN t.pos AND t.pos + t.nw - {words} GROUP BY ALL),
sims AS (SELECT doc_id, item_id, nw, pos, sum(both_n) / (nw - {words - 1} + mi - sum(both_n)) AS similarity FROM bags GROUP BY doc_id, item_id, nw, mi, pos)
SELECT doc_id, item_id, similarity, pos - 1 AS start_word, nw AS n_words FROM
  (SELECT *, row_number() OVER (PARTITION BY doc_id, item_id ORDER BY similarity DESC, pos) AS r FROM sims WHERE similarity >= {least}) x WHERE r = 1"""


def url_sql() -> str:
    """The URL filter with its models, level by level."""
    from .url_filter import ALPHABET, LONGEST, MASS, RULES

    ordered = sorted(RULES, key=lambda r: -len(r[1] + r[2]))
    fits = [f"(host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}')" for _, h, p in ordered]
    rule = "CASE " + " ".join(f"WHEN {f} THEN '{h}{p}'" for f, (_, h, p) in zip(fits, ordered, strict=True)) + " END"
    listed = "CASE " + " ".join(f"WHEN {f} THEN '{v}'" for f, (v, _, _) in zip(fits, ordered, strict=True)) + " END"
    levels = [f"l1 AS (SELECT gram, (a + {MASS / ALPHABET}) / (ca + {MASS}) AS pa, (r + {MASS / ALPHABET}) / (cr + {MASS}) AS pr, 0.0 AS below FROM c WHERE k = 1)"]
    for k in range(2, LONGEST + 1):
        levels.append(f"l{k} AS (SELECT c.gram, (a + {MASS} * pa) / (ca + {MASS}) AS pa, (r + {MASS} * pr) / (cr + {MASS}) AS pr, ln(pa / pr) AS below FROM c JOIN l{k - 1} m ON m.gram = substr(c.gram, 2) WHERE k = {k})")
    levels[1:] = [x.replace("(a + 4.0 * pa)", "(c.a + 4.0 * m.pa)").replace("(r + 4.0 * pr)", "(c.r + 4.0 * m.pr)").replace("ln(pa / pr)", "ln(m.pa / m.pr)") for x in levels[1:]]
    added = " UNION ALL ".join(f"SELECT gram, ln(pa / pr) - below AS added FROM l{k}" for k in range(1, LONGEST + 1))
    grams = f"(SELECT *, substr(chars, i - k + 1, k) AS gram FROM (SELECT *, unnest(range(1, least(i, {LONGEST}) + 1)) AS k FROM (SELECT *, unnest(range(2, length(chars) + 1)) AS i FROM {{0}}) x) y)"
    return f"""WITH u AS (SELECT page_id, url, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) END AS rest FROM pages),
p AS (SELECT page_id, chr(2) || coalesce(url, '') || chr(3) AS chars, coalesce(translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host, coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') AS path FROM u),
j AS (SELECT *, {rule} AS rule, {listed} AS listed FROM p),
d AS (SELECT chars, listed, count(*) AS times FROM j GROUP BY ALL),
n AS (SELECT gram, length(gram) AS k, coalesce(sum(times) FILTER (WHERE listed = 'allow'), 0) AS a, coalesce(sum(times) FILTER (WHERE listed = 'block'), 0) AS r FROM {grams.format("d")} g WHERE listed IS NOT NULL GROUP BY 1),
ctx AS (SELECT substr(gram, 1, k - 1) AS context, k, sum(a) AS ca, sum(r) AS cr FROM n GROUP BY 1, 2),
c AS (SELECT n.*, ca, cr FROM n JOIN ctx ON ctx.context = substr(n.gram, 1, n.k - 1) AND ctx.k = n.k),
{", ".join(levels)},
inc AS ({added}),
s AS (SELECT chars, listed, times, sum(added) / (length(chars) - 1) AS score FROM {grams.format("d")} g JOIN inc USING (gram) GROUP BY chars, listed, times),
m AS (SELECT listed, sum(score * times) / sum(times) AS mean, sqrt(greatest(0, sum(score * score * times) / sum(times) - (sum(score * times) / sum(times)) ** 2)) AS sd FROM s WHERE listed IS NOT NULL GROUP BY 1),
t AS (SELECT (a.mean * r.sd + r.mean * a.sd) / (a.sd + r.sd) AS threshold FROM m a, m r WHERE a.listed = 'allow' AND r.listed = 'block')
SELECT page_id, j.host, j.path, rule, coalesce(j.listed, CASE WHEN s.score < (SELECT threshold FROM t) THEN 'block' ELSE 'allow' END) AS verdict
FROM j LEFT JOIN s ON j.chars = s.chars AND s.listed IS NULL"""


def centroids_sql(k: int = 16, rounds: int = 3) -> str:
    """Rounds of exact assignments and floored means, a component a row."""
    steps = []
    for r in range(rounds + 1):
        steps.append(f"""a{r} AS (SELECT n, number, d FROM (SELECT n, number, sum((x - c) * (x - c)) AS d FROM v JOIN c{r} USING (pos) GROUP BY ALL) y
  QUALIFY row_number() OVER (PARTITION BY n ORDER BY d, number) = 1)""")
        if r < rounds:
            steps.append(f"""m{r} AS (SELECT number, pos, sum(x) AS s, count(*) AS n FROM v JOIN a{r} USING (n) GROUP BY ALL),
c{r + 1} AS (SELECT c{r}.number, c{r}.pos, CASE WHEN n IS NULL THEN c ELSE (s - ((s % n) + n) % n) // n END AS c FROM c{r} LEFT JOIN m{r} ON m{r}.number = c{r}.number AND m{r}.pos = c{r}.pos)""")
    return f"""WITH e AS (SELECT row_number() OVER () AS n, vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings),
kept AS (SELECT n, vec_id, list_transform(e, lambda x: floor(64 * x)::BIGINT) AS i FROM e WHERE len(e) = 64 AND len(list_filter(e, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
v AS (SELECT n, unnest(i)::HUGEINT AS x, unnest(range(1, 65)) AS pos FROM kept),
f AS (SELECT n, row_number() OVER (ORDER BY sha256('1:' || vec_id), i) - 1 AS number FROM kept WHERE vec_id IS NOT NULL QUALIFY number < {k}),
c0 AS (SELECT number, pos, x AS c FROM v JOIN f USING (n)),
{", ".join(steps)},
h AS (SELECT number, sha256(string_agg(c::VARCHAR, ',' ORDER BY pos)) AS centroid_sha256 FROM c{rounds} GROUP BY 1)
SELECT vec_id, number::INTEGER AS cluster, d::BIGINT AS distance, (sum(d) OVER (PARTITION BY number))::BIGINT AS cluster_inertia, (sum(d) OVER ())::BIGINT AS inertia, centroid_sha256
FROM kept JOIN a{rounds} USING (n) JOIN h USING (number)"""


NEGATIVES_SQL = """WITH e AS (SELECT row_number() OVER () AS n, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings),
v AS (SELECT n, vec_id, label, list_transform(e, lambda x: floor(256 * x)::BIGINT) AS i FROM e
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND len(e) > 0 AND len(list_filter(e, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
s AS (SELECT a.n AS a, a.vec_id AS anchor_id, b.vec_id AS id, a.label = b.label AS same, list_sum(list_transform(range(1, len(a.i) + 1), lambda k: a.i[k] * b.i[k]))::BIGINT AS score
  FROM v a JOIN v b ON a.n != b.n AND len(a.i) = len(b.i) WHERE a.vec_id % 50 = 0),
p AS (SELECT a, anchor_id, id AS positive_id, score AS positive_score, row_number() OVER (PARTITION BY a ORDER BY score DESC, id) AS pr FROM s WHERE same QUALIFY pr <= 5)
SELECT p.anchor_id, positive_id, row_number() OVER (PARTITION BY p.a, pr ORDER BY score DESC, id)::INTEGER AS rank, id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s ON p.a = s.a AND NOT same AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score QUALIFY rank <= 3"""

ORACLE_SQL: dict[str, str] = {
    "op11_centroids": centroids_sql(),
    "op13_hard_negatives": NEGATIVES_SQL,
    "op7_url_filter": url_sql(),
    "op9_decontamination": leaks_sql(),
    "op3_minhash_near_dedup": f"""WITH RECURSIVE {shingle_components_sql("documents", 3, 85)}
SELECT doc_id, n_shingles, component_id, doc_id = component_id AS kept FROM sets JOIN comp USING (doc_id)""",
    "op4_embedding_near_dedup": """WITH RECURSIVE
v AS (SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings),
ok AS (SELECT vec_id, label, e FROM v WHERE label IS NOT NULL AND e IS NOT NULL AND len(list_filter(e, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
  AND len(list_filter(e, lambda x: x != 0)) > 0),
links AS (SELECT a.vec_id AS u, b.vec_id AS v FROM ok a JOIN ok b ON a.label = b.label AND len(a.e) = len(b.e) AND a.vec_id != b.vec_id
  WHERE list_cosine_similarity(a.e, b.e) >= 0.93),
reach AS (SELECT vec_id AS node, vec_id AS seen FROM v UNION SELECT r.node, l.v FROM reach r JOIN links l ON r.seen = l.u),
comp AS (SELECT node AS vec_id, min(seen) AS component_id FROM reach GROUP BY 1),
n AS (SELECT u AS vec_id, count(*) AS n_links FROM links GROUP BY 1)
SELECT vec_id, coalesce(n_links, 0) AS n_links, component_id, vec_id = component_id AS kept FROM comp LEFT JOIN n USING (vec_id)""",
    "op6_warc": """WITH p AS (SELECT page_id, coalesce(html, '') AS body, regexp_replace(coalesce(url, ''), '^[A-Za-z][A-Za-z0-9+.\\-]*://', '') AS rest FROM pages),
d AS (SELECT page_id, strlen(body) AS payload_bytes, sha256(body) AS payload_digest, rest FROM p),
f AS (SELECT payload_digest, min(page_id) AS first FROM d WHERE payload_bytes >= 100 GROUP BY 1),
k AS (SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id > first THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN page_id > first THEN first END AS refers_to,
  array_to_string(list_reverse(string_split(lower(regexp_extract(rest, '^([^/?#]*)', 1)), '.')), ',') || ')' || regexp_extract(rest, '^[^/?#]*(.*)$', 1, 's') AS url_key,
  strftime(TIMESTAMP '2000-01-01 00:00:00' + to_seconds(page_id), '%Y-%m-%dT%H:%M:%SZ') AS captured
FROM d LEFT JOIN f USING (payload_digest))
SELECT *, row_number() OVER (ORDER BY url_key, captured, page_id) AS position, row_number() OVER w AS capture_no, lag(page_id) OVER w AS previous_page
FROM k WINDOW w AS (PARTITION BY url_key ORDER BY captured, page_id)""",
}
