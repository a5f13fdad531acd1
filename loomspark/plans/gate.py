"""What a statement is and touches, decided on the parsed plan before anything runs.

Spark has no sandbox inside a session, so confinement is this gate: one statement, read or write by the class of its plan,
tables by the relations in it, no file paths, no settings, jars or other sessions. The parser is the only private API used.
"""

from __future__ import annotations

import hashlib
import json
import re
import threading
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.errors import ParseException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.names import INTERNAL_PREFIX
from ..operators import dialect

READ, WRITE, INVALID = "read", "write", "invalid"
#: Commands that only tell: plan classes of the parser.
_TELLING = ("DescribeRelation", "DescribeColumn", "DescribeQueryCommand", "DescribeTableCommand", "ShowTables", "ShowColumns", "ShowViews", "ShowFunctions", "ExplainCommand")
#: Statements that no caller may run, whatever its rights.
_REFUSED = ("SetCommand", "ResetCommand", "AddJarsCommand", "AddFilesCommand", "AddArchivesCommand", "SetCatalogCommand", "SetNamespaceCommand", "LoadData", "CacheTable", "UncacheTable", "CreateFunction", "RefreshFunction", "CreateView", "CreateViewCommand", "CreateTempViewUsing", "InsertIntoDir")
#: Words that read although they aren't Spark statements.
_DIALECT_READS = ("SUMMARIZE", "PIVOT", "FROM")


class Refused(ValueError):
    """The gate doesn't let a statement through."""


def _items(seq) -> Iterator:
    it = seq.iterator()
    while it.hasNext():
        yield it.next()


def parse(spark: SparkSession, text: str):
    """The parsed, unresolved plan of one statement in Spark SQL or the reference dialect."""
    parser = spark._jsparkSession.sessionState().sqlParser()
    try:
        return parser.parsePlan(dialect.translate(text))
    except (ParseException, ValueError, IndexError):
        return parser.parsePlan(text)


def walk(node) -> Iterator:
    """All plans and expressions below a plan, subqueries included."""
    yield node
    for child in _items(node.children()):
        yield from walk(child)
    kinds = _kinds(node)
    if "QueryPlan" in kinds:
        for e in _items(node.expressions()):
            yield from walk(e)
    if "PlanExpression" in kinds:
        yield from walk(node.plan())
    if _kind(node) == "InsertIntoStatement":  # its target is no child
        yield from walk(node.table())
    if _kind(node) == "UnresolvedWith":
        for pair in _items(node.cteRelations()):
            yield from walk(pair._2())


def _kind(node) -> str:
    return node.getClass().getSimpleName()


def classify(spark: SparkSession, text: str) -> str:
    """read, write or invalid. Only a single statement whose plan has no command is a read, or one that only tells."""
    first = text.strip().split(None, 1)[0].upper() if text.strip() else ""
    try:
        if first in _DIALECT_READS and ";" not in text.strip().rstrip(";"):
            dialect.tree(dialect.tokens(text))
            return READ if all(classify(spark, x) == READ for x in plain(text) if x != text.strip().rstrip(";").strip()) else INVALID
        plan, *more = (parse(spark, x) for x in plain(text))
    except (ParseException, ValueError, IndexError):
        return INVALID
    if _kind(plan) in _TELLING:
        return READ
    for node in (node for p in (plan, *more) for node in walk(p)):
        if _is_command(node):
            return WRITE
    return READ


_COMMANDS = {"Command", "ParsedStatement", "UnaryCommand", "LeafCommand", "BinaryCommand", "V2WriteCommand", "LeafRunnableCommand"}
_KINDS: dict[str, frozenset[str]] = {}


def _is_command(node) -> bool:
    return bool(_kinds(node) & _COMMANDS)


def _kinds(node) -> frozenset[str]:
    """Simple names of a node's class and of all that it extends."""
    cls = node.getClass()
    name = cls.getName()
    if name not in _KINDS:
        _KINDS[name] = frozenset(c.getSimpleName() for c in _lineage(cls))
    return _KINDS[name]


def _lineage(cls) -> Iterator:
    while cls is not None:
        yield cls
        for i in cls.getInterfaces():
            yield from _lineage(i)
        cls = cls.getSuperclass()


def plain(text: str) -> list[str]:
    """Statements that the parser knows and that together touch what ``text`` does, and as it does: the operand of SUMMARIZE and PIVOT as
    a read, INSERT without what it says of conflicts, CREATE TABLE without its columns, and UPDATE ... FROM as an update and a read."""
    t, flags = text.strip().rstrip(";").strip(), re.I | re.S
    if m := re.match(r"SUMMARIZE\s+(.*)$", t, flags):
        operand = m[1].strip()
        return [operand if re.match(r"(SELECT|WITH|FROM)\b", operand, re.I) else operand[1:-1] if operand.startswith("(") and operand.endswith(")") else f"SELECT * FROM {operand}"]
    if m := re.match(r"PIVOT\s+(.*?)\s+ON\b", t, flags):
        operand = m[1].strip()
        return [operand[1:-1] if operand.startswith("(") and operand.endswith(")") else f"SELECT * FROM {operand}"]
    if m := re.match(r"CREATE\s+TABLE\s+(\w+)\s*\(\s*\w+\s.*\)$", t, flags):  # column types and keys have a grammar of their own
        return [f"CREATE TABLE {m[1]} (a INT)"]
    if m := re.match(r"INSERT\s+OR\s+(?:REPLACE|IGNORE)\s+INTO\b(.*)$", t, flags):
        t = f"INSERT INTO{m[1]}"
    t = re.sub(r"\s+ON\s+CONFLICT\s*(\([^)]*\))?\s*DO\s+NOTHING$", "", t, flags=flags)
    if m := UPDATE_FROM.match(t):
        return [f"UPDATE {m[1]} SET {m[2]}", f"SELECT * FROM {m[1]}, {m[3]} WHERE {m[4]}"]
    return [t]


#: table, assignments, source, condition
UPDATE_FROM = re.compile(r"UPDATE\s+(\w+)\s+SET\s+(.*?)\s+FROM\s+(.*?)\s+WHERE\s+(.*)$", re.I | re.S)


def table_refs(spark: SparkSession, text: str) -> list[str]:
    """Names of the tables that a statement reads or writes, without those of its own CTEs, sorted."""
    return sorted(set().union(*(_refs(spark, x) for x in plain(text))))


def _refs(spark: SparkSession, text: str) -> set[str]:
    found, own = set(), set()
    for node in walk(parse(spark, text)):
        kind = _kind(node)
        if kind in ("UnresolvedRelation", "UnresolvedIdentifier", "UnresolvedTable", "UnresolvedTableOrView"):
            parts = node.nameParts() if kind == "UnresolvedIdentifier" else node.multipartIdentifier()
            found.add(".".join(_items(parts)))
        elif kind == "UnresolvedWith":
            own |= {pair._1() for pair in _items(node.cteRelations())}
    return found - own


def check(spark: SparkSession, text: str, *, may_write: bool = False) -> str:
    """Classify a statement and raise Refused where it may not run. Returns read or write."""
    kind = classify(spark, text)
    if kind == INVALID:
        raise Refused("the statement can't be parsed, or is more than one")
    if text.strip().split(None, 1)[0].upper() not in _DIALECT_READS:
        for plan in (parse(spark, x) for x in plain(text)):
            if _kind(plan) in _REFUSED:
                raise Refused(f"{_kind(plan)} isn't allowed")
    for name in table_refs(spark, text):
        if name.split(".")[-1].lower().startswith(INTERNAL_PREFIX):
            raise Refused(f"{name} is internal")
        if "/" in name or name.split(".")[0].lower() in ("parquet", "csv", "json", "orc", "text", "binaryfile", "avro"):
            raise Refused(f"{name} is a path")
        if kind == WRITE and name.split(".")[-1].lower().startswith("graph_"):
            raise Refused(f"{name} is made from the graph")
    if kind == WRITE and not may_write:
        raise Refused("the statement writes")
    return kind


@dataclass(frozen=True)
class Filter:
    """column = value, or column IN values; folded: compared through lower, upper or trim."""

    column: str
    values: tuple[str, ...]
    folded: bool


def filters(spark: SparkSession, text: str) -> list[Filter]:
    """The equality and IN filters on text literals anywhere in a statement."""
    out = []
    for node in walk(parse(spark, text)):
        kind = _kind(node)
        if kind == "EqualTo":
            a, b = _items(node.children())
            for x, y in ((a, b), (b, a)):
                column, value = _column(x), _literal(y)
                if column and value is not None:
                    out.append(Filter(column[0], (value,), column[1]))
        elif kind == "In":
            first, *rest = _items(node.children())
            column, values = _column(first), [_literal(x) for x in rest]
            if column and values and all(v is not None for v in values):
                out.append(Filter(column[0], tuple(values), column[1]))
    return sorted(set(out), key=lambda f: (f.column, f.values))


def _column(e) -> tuple[str, bool] | None:
    folded = False
    while _kind(e) == "UnresolvedFunction" and next(_items(e.nameParts())).lower() in ("lower", "upper", "trim"):
        folded, e = True, next(_items(e.children()))
    return (list(_items(e.nameParts()))[-1], folded) if _kind(e) == "UnresolvedAttribute" else None


def _literal(e) -> str | None:
    while _kind(e) == "UnresolvedFunction" and next(_items(e.nameParts())).lower() in ("lower", "upper", "trim"):
        e = next(_items(e.children()))
    return str(e.value()) if _kind(e) == "Literal" and e.dataType().typeName() == "string" else None


def shape(text: str) -> str:
    """A statement with its constants blanked, to tell repeated questions."""
    out: list[str] = []
    for t in dialect.tokens(text.strip().rstrip(";")):
        t = "?" if t[0] == "'" or t[0].isdigit() else t.upper() if t.isidentifier() and t.upper() in dialect._KEYWORDS | dialect._CLAUSES else t
        if t == "?" and out[-2:] == ["?", ","]:  # lists of constants are one
            out.pop()
            continue
        out.append(t)
    return " ".join(out)


@dataclass(frozen=True)
class Ungrounded:
    column: str
    value: str
    reason: str


def ground(found: list[Filter], held: dict[str, list[str]], question: str = "") -> list[Ungrounded]:
    """Filter values that a column with listed values doesn't hold, or, where the question names other values of that column, doesn't name.

    held: the listed values of text columns. A value counts as named if it is a whole word of the question, in any case, has 3
    characters or more and a letter.
    """
    words = lambda v: len(v) >= 3 and any(c.isalpha() for c in v) and re.search(rf"(?<!\w){re.escape(v.lower())}(?!\w)", question.lower())
    out = []
    for f in found:
        values = held.get(f.column)
        if not values:
            continue
        fold = (lambda v: v.strip().lower()) if f.folded else (lambda v: v)
        named = {v for v in values if words(v)}
        for value in f.values:
            same = [v for v in values if fold(v) == fold(value)]
            if not same:
                out.append(Ungrounded(f.column, value, "not held"))
            elif named and not named & set(same):
                out.append(Ungrounded(f.column, value, "not named"))
    return out


def result_digest(df: DataFrame) -> str:
    """A digest of a result that doesn't depend on the order of its rows; repeated rows count.

    SHA-256 of the column names and of the sum, modulo 2**256, of the rows' SHA-256. The sum is taken in eight limbs of 32
    bits, which combine in any order on the executors; only eight numbers come to the driver.
    """
    row = F.sha2(F.to_json(F.struct(*(F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(df.columns))), {"ignoreNullFields": "false"}), 256)
    hashed = df.select(row.alias("h"))
    limbs = [F.coalesce(F.sum(F.conv(F.substring("h", 8 * i + 1, 8), 16, 10).cast("decimal(20,0)")), F.lit(0).cast("decimal(30,0)")).alias(f"l{i}") for i in range(8)]
    sums = hashed.agg(*limbs).first()
    total = sum(int(sums[i]) << 32 * (7 - i) for i in range(8)) % (1 << 256)
    return hashlib.sha256(json.dumps(df.columns).encode() + total.to_bytes(32, "big")).hexdigest()


def with_timeout(spark: SparkSession, seconds: float, action):
    """The value of action(), whose jobs are cancelled after ``seconds``."""
    group = f"loom-{uuid.uuid4().hex}"
    spark.sparkContext.setJobGroup(group, "with_timeout", interruptOnCancel=True)
    timer = threading.Timer(seconds, spark.sparkContext.cancelJobGroup, [group])
    timer.start()
    try:
        return action()
    finally:
        timer.cancel()
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
