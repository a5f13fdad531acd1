"""A workspace: a folder of tables and documents, and the statements and loads that it takes.

Below the folder: ``tables/<name>`` for user tables and ``tables/_loom_<name>`` for its own, all Parquet. A table is replaced by writing it
beside the old one and renaming, so readers see one or the other.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .functions.names import INTERNAL_PREFIX, check_reserved
from .operators import dialect, grams, profile, relational
from .plans import gate
from .sources import readers, sinks

TIMEOUT = 30.0
DOCUMENTS = "document_id string, filename string, mime string, sha256 string, source string, status string, pinned boolean, tags array<string>, author string, authored_at timestamp, ingested_at timestamp, language string, superseded_by string"
READY, PENDING, SUPERSEDED = "ready", "pending", "superseded"


@dataclass
class Answer:
    """The rows shown, how many there are, and whether that number is exact."""

    columns: list[str]
    rows: list
    total: int
    total_is_exact: bool


class Workspace:
    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")
        for name in self._stored():
            self._register(name)

    # Tables

    def _fs(self):
        jvm = self.spark.sparkContext._jvm
        root = jvm.org.apache.hadoop.fs.Path(self.path)
        return root.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), jvm.org.apache.hadoop.fs.Path

    def _stored(self) -> list[str]:
        fs, path = self._fs()
        folder = path(f"{self.path}/tables")
        return sorted(s.getPath().getName() for s in fs.listStatus(folder) if s.isDirectory() and "." not in s.getPath().getName()) if fs.exists(folder) else []

    def _register(self, name: str) -> None:
        self.spark.read.parquet(self._at(name)).createOrReplaceTempView(name)

    def _at(self, name: str) -> str:
        return f"{self.path}/tables/{name}"

    def tables(self) -> list[str]:
        """User tables; internal ones aren't listed."""
        return [n for n in self._stored() if not n.startswith(INTERNAL_PREFIX)]

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(self._at(name))

    def save(self, name: str, df: DataFrame) -> None:
        sinks.replace_table(df, self._at(name))
        self._register(name)

    def load(self, path: str, name: str | None = None, retypes: str = "") -> list[str]:
        """A file's tables: one, or one for each sheet of a workbook."""
        found = readers.read_workbook(self.spark, path) if path.lower().endswith((".xlsx", ".xlsm", ".ods")) else {name or readers.table_for(path): readers.read_table(self.spark, path)}
        if retypes:
            found = profile.retype_tables(found, profile.parse_retypes(retypes))
        for n, df in found.items():
            check_reserved(n)
            self.save(n, df)
        return list(found)

    def drop(self, name: str) -> None:
        fs, path = self._fs()
        fs.delete(path(self._at(name)), True)
        self.spark.catalog.dropTempView(name)
        if not name.startswith(INTERNAL_PREFIX) and self.keys(name):
            self._set_keys(name, [])

    # Statements

    def query(self, text: str, *, may_write: bool = False, rows: int = 1000, order: list[tuple[str, bool]] | None = None, timeout: float = TIMEOUT) -> Answer:
        """Run a statement through the gate: a read gives its first rows and their number, a write changes a table and gives none."""
        if gate.check(self.spark, text, may_write=may_write) == gate.WRITE:
            gate.with_timeout(self.spark, timeout, lambda: self._write(text))
            return Answer([], [], 0, True)
        df = dialect.resorted(self.spark, text, order) if order else dialect.run(self.spark, text)
        shown, total, exact = gate.with_timeout(self.spark, timeout, lambda: relational.capped(df, rows=rows))
        return Answer(df.columns, shown, total, exact)

    def _write(self, text: str) -> None:
        """CREATE [OR REPLACE] TABLE AS, or with columns and a PRIMARY KEY; INSERT [OR REPLACE | OR IGNORE] INTO [BY NAME] [ON CONFLICT DO NOTHING]; UPDATE
        [FROM]; DELETE FROM; DROP TABLE; ALTER TABLE SET DATA TYPE, over stored tables. A table's key is kept: rows that repeat one are refused."""
        t = text.strip().rstrip(";")
        flags = re.I | re.S
        if m := re.match(r"CREATE\s+(OR\s+REPLACE\s+)?TABLE\s+(IF\s+NOT\s+EXISTS\s+)?(\w+)\s+AS\s+(.*)", t, flags):
            check_reserved(m[3])
            if m[3] in self._stored() and not m[1]:
                if m[2]:
                    return
                raise ValueError(f"table {m[3]} is there already")
            self.save(m[3], dialect.run(self.spark, m[4]))
        elif m := re.match(r"CREATE\s+TABLE\s+(\w+)\s*\((.*)\)$", t, flags):
            self._create(m[1], m[2])
        elif m := re.match(r"INSERT\s+(?:OR\s+(REPLACE|IGNORE)\s+)?INTO\s+(\w+)(\s+BY\s+NAME)?\s+(.*)", t, flags):
            text = re.sub(r"\s+ON\s+CONFLICT\s*(\([^)]*\))?\s*DO\s+NOTHING$", "", m[4], flags=flags)
            self._insert(m[2], dialect.run(self.spark, text), by_name=bool(m[3]), on_conflict="IGNORE" if text != m[4] else (m[1] or "").upper())
        elif m := re.match(r"DELETE\s+FROM\s+(\w+)(?:\s+WHERE\s+(.*))?$", t, flags):
            old = self.table(m[1])
            self.save(m[1], old.where(~F.coalesce(F.expr(m[2]), F.lit(False))) if m[2] else old.limit(0))
        elif m := gate.UPDATE_FROM.match(t):
            self._update_from(m[1], _assignments(m[2]), m[3], m[4])
        elif m := re.match(r"UPDATE\s+(\w+)\s+SET\s+(.*?)(?:\s+WHERE\s+(.*))?$", t, flags):
            old, new = self.table(m[1]), _assignments(m[2])
            hit = F.coalesce(F.expr(m[3]), F.lit(False)) if m[3] else F.lit(True)
            unknown = new.keys() - set(old.columns)
            if unknown:
                raise ValueError(f"no column {sorted(unknown)[0]}")
            # All columns change at once, from the values before.
            self.save(m[1], old.select(*(F.when(hit, F.expr(new[c])).otherwise(F.col(c)).cast(k).alias(c) if c in new else F.col(c) for c, k in old.dtypes)))
        elif m := re.match(r"DROP\s+TABLE\s+(IF\s+EXISTS\s+)?(\w+)$", t, flags):
            if m[2] not in self._stored() and not m[1]:
                raise ValueError(f"no table {m[2]}")
            self.drop(m[2])
        elif m := re.match(r"ALTER\s+TABLE\s+(\w+)\s+ALTER\s+(?:COLUMN\s+)?(\w+)\s+(?:SET\s+DATA\s+)?TYPE\s+(\w+)$", t, flags):
            self.save(m[1], profile.retype(self.table(m[1]), [(m[2], m[3].upper())]))
        else:
            raise gate.Refused("this kind of write isn't supported")

    def keys(self, name: str) -> list[str]:
        """The columns of a table's primary key; none without one."""
        own = f"{INTERNAL_PREFIX}keys"
        got = self.table(own).where(F.col("table_name") == name).first() if own in self._stored() else None
        return list(got["columns"]) if got else []

    def _set_keys(self, name: str, columns: list[str]) -> None:
        own = f"{INTERNAL_PREFIX}keys"
        schema = "table_name string, columns array<string>"
        kept = self.table(own).where(F.col("table_name") != name) if own in self._stored() else self.spark.createDataFrame([], schema)
        self.save(own, kept.unionByName(self.spark.createDataFrame([(name, columns)] if columns else [], schema)))

    def _create(self, name: str, definition: str) -> None:
        """An empty table from ``column type [PRIMARY KEY | NOT NULL | UNIQUE]`` and ``PRIMARY KEY (columns)``."""
        check_reserved(name)
        if name in self._stored():
            raise ValueError(f"table {name} is there already")
        columns, key = [], []
        for part in _split(definition):
            if m := re.match(r"(?:PRIMARY\s+KEY|UNIQUE)\s*\(([^)]*)\)$", part, re.I):
                key = [c.strip() for c in m[1].split(",")]
            elif m := re.match(r"(\w+)\s+(.+?)((?:\s+PRIMARY\s+KEY|\s+UNIQUE|\s+NOT\s+NULL)*)$", part, re.I | re.S):
                kind = {"VARCHAR": "string", "TEXT": "string", "INTEGER": "int", "HUGEINT": "decimal(38,0)", "TIMESTAMP": "timestamp_ntz"}.get(m[2].upper(), m[2])
                columns.append((m[1], kind))
                key = [m[1]] if re.search(r"PRIMARY|UNIQUE", m[3], re.I) else key
            else:
                raise ValueError(f"not a column: {part}")
        self.save(name, self.spark.createDataFrame([], ", ".join(f"`{c}` {k}" for c, k in columns)))
        self._set_keys(name, key)

    def _insert(self, name: str, new: DataFrame, *, by_name: bool, on_conflict: str) -> None:
        old, keys = self.table(name), self.keys(name)
        new = new if by_name else new.toDF(*old.columns)
        new = new.select(*(F.col(c).cast(k).alias(c) if c in new.columns else F.lit(None).cast(k).alias(c) for c, k in old.dtypes))
        if on_conflict and not keys:
            raise ValueError(f"table {name} has no key that rows could conflict on")
        if on_conflict == "REPLACE":
            self.save(name, relational.upsert(old, new, keys))
        elif on_conflict == "IGNORE":
            self.save(name, relational.insert_ignore(old, new, keys))
        else:
            both = old.unionByName(new)
            if keys and not both.groupBy(*keys).agg(F.count("*").alias("loom_n")).where("loom_n > 1").isEmpty():
                raise ValueError(f"rows repeat the key of {name}")
            self.save(name, both)

    def _update_from(self, name: str, new: dict[str, str], source: str, condition: str) -> None:
        """Rows of a table that meet rows of a source change; where several meet one row, the least of the new values is taken."""
        old = self.table(name)
        marked = old.withColumn("loom_row", F.monotonically_increasing_id())
        sinks.replace_table(marked, self._at(f"{INTERNAL_PREFIX}update"))
        self._register(f"{INTERNAL_PREFIX}update")
        try:
            listed = ", ".join(f"{e} AS loom_{c}" for c, e in new.items())
            met = dialect.run(self.spark, f"SELECT {name}.loom_row, {listed} FROM {INTERNAL_PREFIX}update AS {name}, {source} WHERE {condition}")
            changes = met.groupBy("loom_row").agg(F.min(F.struct(*(f"loom_{c}" for c in new))).alias("loom_new"))
            out = self.table(f"{INTERNAL_PREFIX}update").join(changes, "loom_row", "left")
            self.save(name, out.select(*(F.when(F.col("loom_new").isNotNull(), F.col(f"loom_new.loom_{c}")).otherwise(F.col(c)).cast(k).alias(c) if c in new else F.col(c) for c, k in old.dtypes)))
        finally:
            self.drop(f"{INTERNAL_PREFIX}update")

    def upsert(self, name: str, rows: DataFrame, keys: list[str], *, replace: bool = True) -> None:
        """INSERT OR REPLACE, or with replace=False INSERT OR IGNORE."""
        self.save(name, (relational.upsert if replace else relational.insert_ignore)(self.table(name), rows, keys))

    def measure(self, name: str, expression: str, table: str) -> DataFrame:
        """A named measure: one read of an expression over a table."""
        text = f"SELECT {expression} AS `{name}` FROM {table}"
        if gate.check(self.spark, text) != gate.READ:
            raise gate.Refused("a measure is one read")
        return dialect.run(self.spark, text)

    def profiles(self) -> dict[str, list]:
        """Profiles of all tables; those of tables whose number of rows changed, or that are new, are made again, those of dropped ones forgotten."""
        own = f"{INTERNAL_PREFIX}profiles"
        counts = {r["name"]: r["n"] for r in relational.row_counts({n: self.table(n) for n in self.tables()}).collect()} if self.tables() else {}
        kept = self.table(own) if own in self._stored() else None
        had = {r["table_name"]: r["n_rows"] for r in kept.select("table_name", "n_rows").distinct().collect()} if kept is not None else {}
        again, gone = profile.stale(had, counts)
        if again or gone:
            parts = [profile.profile(self.table(n)).withColumn("table_name", F.lit(n)) for n in again]
            out = kept.where(~F.col("table_name").isin([*again, *gone])) if kept is not None else None
            for p in parts:
                out = p if out is None else out.unionByName(p)
            if out is not None:
                self.save(own, out)
        rows: dict[str, list] = {}
        for r in self.table(own).collect() if own in self._stored() else []:
            rows.setdefault(r["table_name"], []).append(r)
        return rows

    # Copies

    def snapshot(self, target: str) -> None:
        """A copy of the folder; it can be opened as a workspace, or restored."""
        self._copy(self.path, target)

    def restore(self, source: str) -> None:
        fs, path = self._fs()
        for name in self._stored():
            self.spark.catalog.dropTempView(name)
        fs.delete(path(self.path), True)
        self._copy(source, self.path)
        for name in self._stored():
            self._register(name)

    def _copy(self, source: str, target: str) -> None:
        jvm, conf = self.spark.sparkContext._jvm, self.spark.sparkContext._jsc.hadoopConfiguration()
        a, b = jvm.org.apache.hadoop.fs.Path(source), jvm.org.apache.hadoop.fs.Path(target)
        jvm.org.apache.hadoop.fs.FileUtil.copy(a.getFileSystem(conf), a, b.getFileSystem(conf), b, False, conf)


def _split(text: str) -> list[str]:
    """The parts of a list between its commas, outside brackets and quotes."""
    parts, depth = [[]], 0
    for token in re.findall(r"'(?:[^']|'')*'|\"(?:[^\"]|\"\")*\"|.", text, re.S):
        depth += (token in "([{") - (token in ")]}") if len(token) == 1 else 0
        if token == "," and not depth:
            parts.append([])
        else:
            parts[-1].append(token)
    return [s for s in ("".join(p).strip() for p in parts) if s]


def _assignments(text: str) -> dict[str, str]:
    """column -> expression of ``a = 1, b = f(c, d)``."""
    out = {}
    for part in _split(text):
        name, equals, value = part.partition("=")
        if not equals or not re.fullmatch(r"\w+", name.strip()):
            raise ValueError(f"not an assignment: {part}")
        out[name.strip()] = value.strip()
    return out


# Documents


def register(documents: DataFrame, new: DataFrame) -> DataFrame:
    """The registry with new documents (document_id, filename, sha256 ...) as pending ones. Bytes that are known are no news; a file
    of a name that is known is pending beside the old one, which serves until the new one is ready."""
    fresh = new.dropDuplicates(["sha256"]).join(documents.where(F.col("status") != SUPERSEDED).select("sha256"), "sha256", "left_anti")
    return documents.unionByName(fresh.withColumn("status", F.lit(PENDING)), allowMissingColumns=True)


def finish(documents: DataFrame, document_id: str) -> DataFrame:
    """A pending document becomes ready, and those of its file name that were ready are superseded by it."""
    name = documents.where(F.col("document_id") == document_id).select(F.col("filename").alias("loom_name"))
    out = documents.join(F.broadcast(name), F.col("filename") == F.col("loom_name"), "left")
    old = F.col("loom_name").isNotNull() & (F.col("document_id") != document_id) & (F.col("status") == READY)
    status = F.when(F.col("document_id") == document_id, READY).when(old, SUPERSEDED).otherwise(F.col("status"))
    return out.withColumn("superseded_by", F.when(old, document_id).otherwise(F.col("superseded_by"))).withColumn("status", status).drop("loom_name")


def delete(documents: DataFrame, chunks: DataFrame, document_id: str) -> tuple[DataFrame, DataFrame]:
    return documents.where(F.col("document_id") != document_id), chunks.where(F.col("document_id") != document_id)


def searchable(chunks: DataFrame, documents: DataFrame, scope: DataFrame | None = None, entity: DataFrame | None = None) -> DataFrame:
    """chunk_ids of ready documents, of those in scope (document_id) and of the chunks that speak of an entity (chunk_id). An empty scope finds nothing."""
    out = chunks.join(documents.where(F.col("status") == READY).select("document_id"), "document_id", "left_semi")
    if scope is not None:
        out = out.join(scope.select("document_id"), "document_id", "left_semi")
    if entity is not None:
        out = out.join(entity.select("chunk_id"), "chunk_id", "left_semi")
    return out.select("chunk_id")


def embedding_status(chunks: DataFrame, current: str) -> DataFrame:
    """(n, missing, stale): chunks, those without a vector, and those with one of another profile."""
    return chunks.agg(F.count("*").alias("n"), F.count(F.when(F.col("embedding").isNull(), 1)).alias("missing"), F.count(F.when(F.col("embedding").isNotNull() & ~F.col("embedding_profile").eqNullSafe(current), 1)).alias("stale"))


def refresh_embeddings(chunks: DataFrame, model: Callable[[list[str]], list[list[float]]], current: str, width: int) -> DataFrame:
    """chunks with vectors of the current profile; model is called on executors with the texts of a batch that need one."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            old = pdf["embedding"].isna() | (pdf["embedding_profile"] != current)
            if old.any():
                made = iter(model(pdf.loc[old, "content"].fillna("").tolist()))
                pdf["embedding"] = [next(made) if o else v for o, v in zip(old, pdf["embedding"], strict=True)]
                if any(len(v) != width for v in pdf["embedding"]):
                    raise ValueError(f"a vector isn't {width} wide")
                pdf["embedding_profile"] = current
            yield pdf

    return chunks.mapInPandas(run, chunks.schema)


def index_messages(messages: DataFrame, path: str) -> None:
    """Write the trigram postings of messages (session_id, seq, content) that ``message_search`` takes."""
    grams.write_text_index(messages.withColumn("loom_id", F.struct("session_id", "seq")), path, key="loom_id", text="content")


def message_search(messages: DataFrame, text: str, *, index: str | None = None, visible: DataFrame | None = None, limit: int = 50, around: int = 60) -> DataFrame:
    """Questions and answers that hold a text in any case, newest first: session_id, seq, role, created_at and snippet, the text around its first place.

    messages: session_id, seq, role, content, created_at (or at); without roles all messages are searched, and without seq there is no index. index: postings of ``index_messages``, by which only messages that may hold the text are read.
    visible: the session_ids that may be found. Blanks around the text don't count; a blank text finds nothing; null contents hold nothing.
    """
    text = text.strip()
    said = messages.where(F.col("role").isin("user", "assistant")) if "role" in messages.columns else messages
    when = "created_at" if "created_at" in messages.columns else "at"
    if visible is not None:
        said = said.join(visible.select("session_id").distinct(), "session_id", "left_semi")
    if not text:
        said = said.limit(0)
    elif index is not None:
        said = grams.holding(said.withColumn("loom_id", F.struct("session_id", "seq")), text, index, key="loom_id", text="content")
    wanted = F.lower(F.lit(text))
    at = F.instr(F.lower("content"), wanted)
    snippet = F.substring("content", F.greatest(F.lit(1), at - around), F.lit(len(text) + 2 * around))
    found = said.where(at > 0).withColumn("snippet", F.trim(F.regexp_replace(snippet, r"(?U)\s+", " ")))
    places = [c for c in ("seq", "session_id") if c in messages.columns]
    order = [F.desc(when), *(F.desc(c) if c == "seq" else F.col(c) for c in places)]
    return found.orderBy(*order).limit(limit).select(*(c for c in ("session_id", "seq", "role", when) if c in messages.columns), "snippet")


def newest(documents: DataFrame) -> DataFrame:
    """The newest document of each file name."""
    w = Window.partitionBy("filename").orderBy(F.desc("ingested_at"), "document_id")
    return documents.withColumn("r", F.row_number().over(w)).where("r = 1").drop("r")
