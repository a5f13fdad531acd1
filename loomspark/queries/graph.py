"""Induction of an ontology from tables, and the graph that it makes of them."""

from __future__ import annotations

import os
import uuid
from itertools import product

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import graph, induction, ontology, standing
from ..operators.ontology import Class, Mapping, Ontology, Property, Relation
from ..operators.profile import profile
from ..steps import shared_folder
from .common import STAR, table

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}
KEYS = {"region": "r_regionkey", "nation": "n_nationkey", "customer": "c_custkey", "supplier": "s_suppkey", "part": "p_partkey", "orders": "o_orderkey", "lineitem": None, "events": "event_id"}
_COLUMNS = {
    "region": "r_name", "nation": "n_name n_regionkey", "customer": "c_name c_nationkey c_acctbal c_mktsegment", "supplier": "s_name s_nationkey s_acctbal", "part": "p_name p_brand p_type p_size p_retailprice", "orders": "o_custkey o_orderstatus o_totalprice o_orderdate o_orderpriority",
    "lineitem": "l_orderkey l_partkey l_suppkey l_linenumber l_quantity l_extendedprice l_discount l_tax l_returnflag l_linestatus l_shipdate", "events": "ts user_id event_type value props",
}


def frame(name: str, duck_sql: str | None = None):
    def put(f):
        QUERIES[name] = f
        if duck_sql:
            ORACLE_SQL[name] = duck_sql
        return f

    return put


def world() -> Ontology:
    """Regions, nations and customers, with their tables."""
    place = Class("place", properties=(Property("name"),))
    customer = Class("customer", properties=(Property("name"), Property("balance", "number"), Property("segment", "enum")))
    return Ontology(
        {"place": place, "region": Class("region", "place"), "nation": Class("nation", "place"), "customer": customer},
        {"has_region": Relation("has_region", "nation", "region"), "has_nation": Relation("has_nation", "customer", "nation")},
        [
            Mapping("region", "region", "r_regionkey", (("r_name", "name"),)), Mapping("nation", "nation", "n_nationkey", (("n_name", "name"),), (("n_regionkey", "has_region", "region"),)),
            Mapping("customer", "customer", "c_custkey", (("c_name", "name"), ("c_acctbal", "balance"), ("c_mktsegment", "segment")), (("c_nationkey", "has_nation", "nation"),)),
        ],
    )


def build(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    return graph.build({t: table(spark, sf_dir, t) for t in ("region", "nation", "customer")}, world())


_NODES = "(SELECT 'region' AS class_id, CAST(r_regionkey AS VARCHAR) AS label, r_name AS name FROM region UNION ALL SELECT 'nation', CAST(n_nationkey AS VARCHAR), n_name FROM nation UNION ALL SELECT 'customer', CAST(c_custkey AS VARCHAR), c_name FROM customer)"
_EDGES = "(SELECT 'has_region' AS relation_id, 'nation' AS sc, CAST(n_nationkey AS VARCHAR) AS src, 'region' AS dc, CAST(n_regionkey AS VARCHAR) AS dst FROM nation UNION ALL SELECT 'has_nation', 'customer', CAST(c_custkey AS VARCHAR), 'nation', CAST(c_nationkey AS VARCHAR) FROM customer)"


def _id(cls: str, label: str) -> str:
    return f"sha256({cls} || chr(31) || {label})"


def _overlap_sql() -> str:
    parts = []
    for t, (k, key) in product(_COLUMNS, KEYS.items()):
        if key and k != t:
            for c in _COLUMNS[t].split():
                parts.append(f"SELECT '{t}' AS table_name, '{c}' AS column_name, '{k}' AS key_table, (SELECT count(*) FROM (SELECT DISTINCT CAST({c} AS VARCHAR) AS v FROM {t} WHERE {c} IS NOT NULL) a WHERE v IN (SELECT CAST({key} AS VARCHAR) FROM {k})) / (SELECT count(DISTINCT CAST({c} AS VARCHAR)) FROM {t}) AS overlap")
    return f"SELECT * FROM ({' UNION ALL '.join(parts)}) o WHERE overlap >= 0.8"


@frame("induce_key_overlap", _overlap_sql())
def induce_key_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ontology.key_overlaps({t: table(spark, sf_dir, t) for t in STAR}, KEYS)


def _kinds_sql(name: str, columns: str) -> str:
    """(column_name, kind) of a table's columns, from their types and values."""
    return " UNION ALL ".join(
        f"""SELECT '{c}' AS column_name, CASE WHEN any_value(typeof({c})) IN ('BIGINT', 'INTEGER', 'DOUBLE') THEN 'number' WHEN any_value(typeof({c})) IN ('DATE', 'TIMESTAMP') OR count(*) FILTER (WHERE TRY_CAST({c} AS DATE) IS NOT NULL) >= 0.9 * count({c}) THEN 'date'
    WHEN count(*) >= 20 AND count(DISTINCT {c}) BETWEEN 2 AND 12 THEN 'enum' ELSE 'string' END AS kind FROM {name}"""
        for c in columns.split()
    )


@frame("induce_types", _kinds_sql("orders", "o_orderkey o_custkey o_orderstatus o_totalprice o_orderdate o_orderpriority"))
def induce_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = profile(table(spark, sf_dir, "orders")).collect()
    return spark.createDataFrame([(r["column_name"], ontology.property_kind(r)) for r in rows], "column_name string, kind string")


def _classes_sql(tables: dict[str, str]) -> str:
    parts = [f"SELECT 'class' AS kind, '{t}' AS name, '' AS owner, '' AS detail, 1.0::DOUBLE AS confidence" for t in tables]
    parts += [f"SELECT 'property', column_name, '{t}', kind, CASE WHEN column_name = '{KEYS[t]}' THEN 1.0 WHEN kind = 'enum' THEN 0.8 ELSE 0.9 END FROM ({_kinds_sql(t, f'{KEYS[t]} {columns}')}) k" for t, columns in tables.items()]
    return " UNION ALL ".join(parts)


@frame("induce_classes", _classes_sql({t: _COLUMNS[t] for t in ("nation", "region")}))
def induce_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    profiles = {t: profile(table(spark, sf_dir, t)).collect() for t in ("nation", "region")}
    got = ontology.induce_classes(profiles, KEYS)
    return spark.createDataFrame([(c.kind, c.name, c.owner, c.detail, c.confidence) for c in got], "kind string, name string, owner string, detail string, confidence double")


@frame("induce_relations", f"SELECT 'has_' || column_name AS name, 'order' AS domain, key_table AS range FROM ({_overlap_sql()}) x WHERE table_name = 'orders' AND column_name = 'o_custkey' AND key_table = 'customer'")
def induce_relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = ontology.key_overlaps({t: table(spark, sf_dir, t) for t in ("customer", "orders")}, KEYS).where("table_name = 'orders' and column_name = 'o_custkey'").collect()
    return spark.createDataFrame([(c.name, c.owner, c.detail) for c in ontology.induce_relations(found)], "name string, domain string, range string")


@frame("graph_nodes", f"SELECT {_id('class_id', 'label')} AS id, class_id, label, name FROM {_NODES} n")
def graph_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return build(spark, sf_dir)[0].select("id", "class_id", "label", F.col("properties")["name"].alias("name"))


@frame("graph_edges", f"SELECT relation_id, {_id('sc', 'src')} AS src, {_id('dc', 'dst')} AS dst FROM {_EDGES} e")
def graph_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return build(spark, sf_dir)[1].select("relation_id", "src", "dst")


@frame("graph_provenance", f"SELECT table_name, count(*) AS n FROM (SELECT class_id AS table_name FROM {_NODES} n UNION ALL SELECT sc FROM {_EDGES} e) x GROUP BY 1")
def graph_provenance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return build(spark, sf_dir)[2].groupBy("table_name").agg(F.count("*").alias("n"))


@frame("graph_class_view", "SELECT CAST(c_custkey AS VARCHAR) AS label, c_name AS name, c_acctbal AS balance, c_mktsegment AS segment FROM customer")
def graph_class_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.class_view(build(spark, sf_dir)[0], world(), "customer").select("label", "name", "balance", "segment")


@frame("graph_class_listing", "SELECT class_id, label FROM (SELECT 'nation' AS class_id, CAST(n_nationkey AS VARCHAR) AS label FROM nation UNION ALL SELECT 'region', CAST(r_regionkey AS VARCHAR) FROM region) x")
def graph_class_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.class_listing(build(spark, sf_dir)[0], world(), "place")[0].select("class_id", "label")


@frame("graph_entity_lookup", "SELECT 'nation' AS class_id, CAST(n_nationkey AS VARCHAR) AS label FROM nation WHERE n_nationkey = 7")
def graph_entity_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.lookup(build(spark, sf_dir)[0], "  7 ", cls=world().descendants("nation")).select("class_id", "label")


@frame("graph_neighborhood", f"SELECT 'region' AS class_id, '1' AS label UNION ALL SELECT 'nation', CAST(n_nationkey AS VARCHAR) FROM nation WHERE n_regionkey = 1")
def graph_neighborhood(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes, edges, _ = build(spark, sf_dir)
    start = graph.lookup(nodes, "1", cls={"region"}).first()["id"]
    adjacency = f"{shared_folder(spark)}/loomspark-{os.getpid()}/{uuid.uuid4().hex}"
    graph.write_adjacency(edges, adjacency)
    return graph.neighborhood(nodes, edges, start, hops=1, adjacency=adjacency)[0].select("class_id", "label")


@frame("graph_path", "SELECT step, relation_id FROM customer JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey, (VALUES (0, 'has_nation'), (1, 'has_region')) t(step, relation_id) WHERE c_custkey = 1")
def graph_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes, edges, _ = build(spark, sf_dir)
    start = graph.lookup(nodes, "1", cls={"customer"}).first()["id"]
    nation = edges.where(F.col("src") == start).first()["dst"]
    goal = edges.where(F.col("src") == nation).first()["dst"]
    path = graph.shortest_path(edges, start, goal)
    by = {r["id"]: r["relation_id"] for r in edges.where(F.col("id").isin([e for e, _, _ in path])).collect()}
    return spark.createDataFrame([(i, by[e]) for i, (e, _, _) in enumerate(path)], "step int, relation_id string")


@frame("graph_revalidate", "SELECT 'edge' AS what, 'has_nation' AS name, (SELECT count(*) FROM customer) AS n UNION ALL SELECT 'node', 'customer', (SELECT count(*) FROM customer)")
def graph_revalidate(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes, edges, _ = build(spark, sf_dir)
    o = world()
    del o.classes["customer"]
    return graph.revalidate(nodes, edges, o)[2]


@frame("graph_status", f"SELECT 'class' AS what, class_id AS name, count(*) AS n FROM {_NODES} a GROUP BY 2 UNION ALL SELECT 'relation', relation_id, count(*) FROM {_EDGES} b GROUP BY 2")
def graph_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes, edges, _ = build(spark, sf_dir)
    return graph.status(nodes, edges)


@frame("graph_fingerprint", "SELECT (SELECT sum(hash(n)) FROM nation n) = (SELECT sum(hash(n)) FROM (SELECT * FROM nation ORDER BY n_name) n) AS stable, (SELECT sum(hash(n)) FROM nation n) != (SELECT sum(hash(n)) FROM nation n WHERE n_nationkey > 0) AS sees_change")
def graph_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "nation")
    one, two, three = (graph.fingerprint(x, "nation").first() for x in (df, df.repartition(4).orderBy("n_name"), df.where("n_nationkey > 0")))
    return spark.createDataFrame([(one == two, one != three)], "stable boolean, sees_change boolean")


@frame("graph_merge", f"SELECT (SELECT count(*) FROM {_NODES} a) - 1 AS nodes, (SELECT count(*) FROM {_EDGES} b) AS edges, (SELECT count(*) FROM customer WHERE c_nationkey IN (1, 2)) AS customers")
def graph_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes, edges, seen = build(spark, sf_dir)
    kept, gone = (graph.lookup(nodes, x, cls={"nation"}).first()["id"] for x in ("1", "2"))
    merges = spark.createDataFrame([(gone, kept)], "gone string, kept string")
    new_nodes, new_edges, _ = graph.merge_nodes(nodes, edges, seen, merges)
    counts = new_nodes.agg(F.count("*").alias("nodes")), new_edges.agg(F.count("*").alias("edges")), new_edges.where((F.col("dst") == kept) & (F.col("relation_id") == "has_nation")).agg(F.count("*").alias("customers"))
    row = tuple(c.first()[0] for c in counts)
    return spark.createDataFrame([row], "nodes long, edges long, customers long")


ORACLE_SQL["graph_merge"] = (
    f"SELECT (SELECT count(*) FROM {_NODES} a) - 1 AS nodes, (SELECT count(*) FROM customer) + (SELECT count(*) FROM (SELECT DISTINCT CASE n_nationkey WHEN 2 THEN 1 ELSE n_nationkey END AS n, n_regionkey FROM nation) x) AS edges, (SELECT count(*) FROM customer WHERE c_nationkey IN (1, 2)) AS customers"
)


@frame("merge_candidates", "SELECT a.vec_id AS a, b.vec_id AS b, round(1 - list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS distance FROM embeddings a JOIN embeddings b ON a.label = b.label AND a.vec_id < b.vec_id WHERE 1 - list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) <= 0.7")
def merge_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("label").cast("string").alias("class_id"), "embedding", F.lit(False).alias("keyed"))
    return graph.merge_candidates(e, distance=0.7).withColumn("distance", F.round("distance", 6))


_PLAIN = "translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = "unnest(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+'))"


def _words(df: DataFrame) -> DataFrame:
    return df.withColumn("word", F.explode(F.regexp_extract_all("text", F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))))


_SNAKE = "regexp_replace(regexp_replace(lower(name), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g')"


@frame("induce_vocabulary", f"""WITH RECURSIVE n AS (SELECT name, count(*) AS n FROM (SELECT {_WORDS} AS name FROM benchmark) w GROUP BY 1),
s AS (SELECT name, n, CASE WHEN {_SNAKE} = '' THEN 'unnamed' WHEN regexp_matches({_SNAKE}, '^[0-9]') THEN 't_' || {_SNAKE} ELSE {_SNAKE} END AS s FROM n),
f AS (SELECT name, n, CASE WHEN s LIKE '%ies' THEN s[:-4] || 'y' WHEN s LIKE '%ss' OR length(s) < 4 OR s NOT LIKE '%s' THEN s ELSE s[:-2] END AS form FROM s),
o AS (SELECT form, row_number() OVER (ORDER BY min(name)) AS i FROM f GROUP BY 1),
r AS (SELECT 0 AS step, form, i, min(i) OVER () AS head FROM o UNION ALL SELECT step + 1, x.form, x.i, min(x.i) OVER () FROM (SELECT r.*, h.form AS hf FROM r JOIN o h ON h.i = r.head) x
  WHERE NOT (x.form = x.hf OR jaro_winkler_similarity(x.hf, x.form) >= 0.92 - 1e-9)),
g AS (SELECT form, arg_max(head, step) AS head FROM r GROUP BY 1),
b AS (SELECT head, arg_max(form, (n, name)) AS id FROM f JOIN g USING (form) GROUP BY 1)
SELECT name, id FROM f JOIN g USING (form) JOIN b USING (head)""")
def induce_vocabulary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return induction.vocabulary(_words(table(spark, sf_dir, "benchmark")).groupBy(F.col("word").alias("name")).agg(F.count("*").alias("n")))


@frame("induce_hierarchy", f"""WITH w AS (SELECT {_PLAIN.format("w")} AS entity, lang, source FROM (SELECT {_WORDS} AS w, lang, source FROM documents) x),
o AS (SELECT entity, lang AS class FROM w UNION ALL SELECT entity, source FROM w UNION ALL SELECT entity, lang || '/' || source FROM w),
m AS (SELECT class, entity, count(*) AS n FROM o WHERE class IS NOT NULL GROUP BY ALL), z AS (SELECT class, sum(n) AS size, count(*) AS entities FROM m GROUP BY 1),
p AS (SELECT a.class AS child, b.class AS parent, count(*) AS shared FROM m a JOIN m b ON a.entity = b.entity AND a.class != b.class GROUP BY ALL)
SELECT child, parent, shared, x.entities FROM p JOIN z x ON x.class = child JOIN z y ON y.class = parent WHERE x.size < y.size AND shared >= 0.8 * x.entities
QUALIFY row_number() OVER (PARTITION BY child ORDER BY y.size DESC, parent) = 1""")
def induce_hierarchy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Languages, sources and both together as classes of the words that documents mention."""
    words = _words(table(spark, sf_dir, "documents")).withColumn("class", F.explode(F.array("lang", "source", F.concat("lang", F.lit("/"), "source"))))
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return induction.hierarchy(words.select(F.translate("word", letters, letters.lower()).alias("entity"), "class"))


@frame("merge_proposals", """WITH RECURSIVE d AS (SELECT a.vec_id AS a, b.vec_id AS b, round(1 - list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS distance
  FROM embeddings a JOIN embeddings b ON a.label = b.label AND a.vec_id < b.vec_id WHERE 1 - list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) <= 0.8),
p AS (SELECT *, row_number() OVER (ORDER BY distance, a, b) AS i FROM d),
r AS (SELECT 0::BIGINT AS i, NULL::BIGINT AS a, NULL::BIGINT AS b, NULL::DOUBLE AS distance, false AS ok, []::BIGINT[] AS used
  UNION ALL SELECT i, a, b, distance, ok, CASE WHEN ok THEN used || [a, b] ELSE used END FROM (SELECT p.i, p.a, p.b, p.distance, r.used, len(list_filter(r.used, lambda x: x = p.a)) < 3 AND len(list_filter(r.used, lambda x: x = p.b)) < 3 AS ok
  FROM r JOIN p ON p.i = r.i + 1) x)
SELECT a, b, distance FROM r WHERE ok AND a % 4 = b % 4""")
def merge_proposals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of near vectors of one label, the pairs that are worth a look, three for each vector; labels share a token in one case of four."""
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("label").cast("string").alias("class_id"), "embedding", F.lit(False).alias("keyed"))
    kinds = F.element_at(F.array(*map(F.lit, ("alpha", "beta", "gamma", "delta"))), (F.col("id") % 4 + 1).cast("int"))
    return graph.near_proposals(e, e.select("id", F.concat(kinds, F.lit(" "), "id").alias("label")), distance=0.8, most=3)


_CHANGES = """e AS (SELECT event_id AS t, 'u' || user_id AS id, event_type AS act, 'k' || (json_extract(props, '$.k')::INTEGER % 7) AS key, value::VARCHAR AS v FROM events WHERE event_type != 'signup' OR value >= 1),
r AS (SELECT event_id AS t FROM events WHERE event_type = 'signup' AND value < 1),
d AS (SELECT id, coalesce(max(t) FILTER (WHERE act = 'error'), -1) AS d FROM e GROUP BY 1), a AS (SELECT id, min(t) AS a FROM e JOIN d USING (id) WHERE act = 'purchase' AND t > d GROUP BY 1),
x AS (SELECT id, greatest(d, coalesce((SELECT max(r.t) FROM r WHERE a IS NULL OR r.t < a), -1)) AS ended FROM d LEFT JOIN a USING (id)),
l AS (SELECT e.* FROM e JOIN x USING (id) WHERE t > ended AND act != 'error')"""


@frame("graph_standing", f"""WITH {_CHANGES},
p AS (SELECT id, key, coalesce(arg_max(v, t) FILTER (WHERE act = 'purchase'), arg_min(v, t)) AS v FROM l GROUP BY ALL)
SELECT id, bool_and(act = 'view') AS provisional, bool_or(act = 'purchase') AS asserted, (SELECT string_agg(key || '=' || v, ';' ORDER BY key) FROM p WHERE p.id = l.id) AS properties FROM l GROUP BY id""")
def graph_standing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as changes of users: views propose, clicks and sign-ups find, purchases assert, errors delete, and cheap sign-ups reset all that isn't asserted."""
    e = table(spark, sf_dir, "events")
    cheap = (F.col("event_type") == "signup") & (F.col("value") < 1)
    acts = {"view": standing.PROPOSED, "click": standing.FOUND, "signup": standing.FOUND, "purchase": standing.ASSERTED, "error": standing.DELETED}
    action = F.when(cheap, standing.RESET).otherwise(F.element_at(F.create_map(*(F.lit(x) for kv in acts.items() for x in kv)), F.col("event_type")))
    key = F.concat(F.lit("k"), F.get_json_object("props", "$.k").cast("int") % 7)
    none = F.lit(None).cast("string")
    changes = e.select(
        F.col("event_id").alias("at"), action.alias("action"), F.lit("node").alias("kind"), F.concat(F.lit("u"), "user_id").alias("id"), F.lit("user").alias("class_id"), F.concat(F.lit("u"), "user_id").alias("label"), none.alias("src"), none.alias("dst"),
        F.create_map(key, F.col("value").cast("string")).alias("properties"), F.lit(None).cast("array<string>").alias("removed"), F.lit("someone").alias("author"), none.alias("note"),
    )
    pairs = F.array_sort(F.transform(F.map_entries("properties"), lambda x: F.concat(x["key"], F.lit("="), x["value"])))
    return standing.fold(changes).nodes.select("id", "provisional", "asserted", F.array_join(pairs, ";").alias("properties"))
