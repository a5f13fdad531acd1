"""Tables from files, workbooks, SQLite and addresses; folders kept in step with a registry."""

from __future__ import annotations

import csv
import io
import json
import re
import sqlite3
import urllib.request
import zipfile
from datetime import date, datetime, timedelta
from xml.etree import ElementTree

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.names import check_reserved, header_names, sheet_names, table_name
from .infer import SPARK_TYPES, agreed, infer_types, typed, whole_floats

_HEAD = 1 << 16
_SEPARATORS = {"csv": ",", "tsv": "\t", "tab": "\t", "psv": "|"}


class OneColumn(ValueError):
    """A delimited file that reads as one column with its own separator too."""


def _head(spark: SparkSession, path: str, size: int = _HEAD) -> bytes:
    """The first bytes of a file in any store that Spark reads; all of them with size -1."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    stream = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).open(p)
    try:
        # A text line at a time would need the encoding; a short read of bytes doesn't.
        return bytes(jvm.org.apache.commons.io.IOUtils.toByteArray(jvm.org.apache.commons.io.input.BoundedInputStream(stream, size)))
    finally:
        stream.close()


def sniff(head: bytes) -> str:
    """parquet, json or csv by the first bytes."""
    if head.startswith(b"PAR1"):
        return "parquet"
    return "json" if head.lstrip()[:1] in (b"{", b"[") else "csv"


def read_parquet(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def read_json(spark: SparkSession, path: str) -> DataFrame:
    """An array of records, or one record a line."""
    return spark.read.json(path, multiLine=_head(spark, path, 4096).lstrip()[:1] == b"[")


def dialect_of(head: str, extension: str = "csv") -> str:
    """The separator of delimited text."""
    try:
        return csv.Sniffer().sniff(head, delimiters=",;\t|").delimiter
    except csv.Error:
        return _SEPARATORS.get(extension, ",")


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """Delimited text with a header: the separator is sniffed, names made unique and types inferred over the whole file. A file that
    sniffs to one column is read strictly with its extension's separator, and refused if it has one column then too."""
    extension = path.rpartition(".")[2].lower()
    head = _head(spark, path).decode("utf-8-sig", "replace")
    sep = dialect_of(head[: head.rfind("\n") + 1] or head, extension)
    first = next(csv.reader(io.StringIO(head), delimiter=sep), [])
    options = {"header": True, "inferSchema": False, "multiLine": '"' in head, "escape": '"'}
    if len(first) < 2 and _SEPARATORS.get(extension, ",") in head:
        sep = _SEPARATORS.get(extension, ",")
        first = next(csv.reader(io.StringIO(head), delimiter=sep, strict=True), [])
        options["mode"] = "FAILFAST"
        if len(first) < 2:
            raise OneColumn(path)
    raw = spark.read.csv(path, sep=sep, **options)
    raw = raw.toDF(*header_names([c if not re.fullmatch(r"_c\d+", c) else "" for c in first][: len(raw.columns)] or raw.columns))
    return typed(raw)


def yaml_records(text: str) -> list[dict] | None:
    """The records of a YAML file: a list of mappings, or a mapping of one key to such a list; else it is text, and None."""
    import yaml

    data = yaml.safe_load(text)
    if isinstance(data, dict) and len(data) == 1:
        data = next(iter(data.values()))
    return data if isinstance(data, list) and data and all(isinstance(x, dict) for x in data) else None


def records(spark: SparkSession, rows: list[dict]) -> DataFrame:
    """Records with any keys as a table; keys in the order they come, nested values as JSON."""
    names = list(dict.fromkeys(k for r in rows for k in r))
    lines = [json.dumps({str(k): v for k, v in r.items()}, default=str) for r in rows]
    schema = spark.read.json(spark.sparkContext.parallelize(lines)).schema if lines else "empty string"
    return spark.read.schema(schema).json(spark.sparkContext.parallelize(lines)).select(*(F.col(f"`{n}`") for n in names))


def read_yaml(spark: SparkSession, path: str) -> DataFrame | None:
    found = yaml_records(_head(spark, path, -1).decode("utf-8-sig"))
    return None if found is None else records(spark, found)


# Workbooks

_EPOCH = datetime(1899, 12, 30)
_DATE_FORMATS = {14, 15, 16, 17, 18, 19, 20, 21, 22, 45, 46, 47}


def _local(e: ElementTree.Element) -> str:
    return e.tag.rpartition("}")[2]


def _column(ref: str) -> int:
    n = 0
    for c in re.match(r"[A-Z]+", ref)[0]:
        n = n * 26 + ord(c) - 64
    return n - 1


def xlsx_sheets(data: bytes) -> dict[str, list[list]]:
    """Cells of every sheet of an xlsx or xlsm workbook, as numbers, booleans, dates, times and text."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        parse = lambda n: ElementTree.fromstring(z.read(n))
        names = set(z.namelist())
        shared = ["".join(t.text or "" for t in s.iter() if _local(t) == "t") for s in parse("xl/sharedStrings.xml")] if "xl/sharedStrings.xml" in names else []
        dated: list[bool] = []
        if "xl/styles.xml" in names:
            styles = parse("xl/styles.xml")
            custom = {int(e.attrib["numFmtId"]): e.attrib["formatCode"] for e in styles.iter() if _local(e) == "numFmt"}
            is_date = lambda i: i in _DATE_FORMATS or bool(re.search(r"[ymdhs]", re.sub(r'"[^"]*"|\[[^\]]*\]|\\.', "", custom.get(i, "")), re.I))
            xfs = next((e for e in styles if _local(e) == "cellXfs"), [])
            dated = [is_date(int(x.attrib.get("numFmtId", 0))) for x in xfs]
        targets = {r.attrib["Id"]: r.attrib["Target"] for r in parse("xl/_rels/workbook.xml.rels")}
        out: dict[str, list[list]] = {}
        for s in (e for e in parse("xl/workbook.xml").iter() if _local(e) == "sheet"):
            target = targets[next(v for k, v in s.attrib.items() if k.endswith("}id"))].lstrip("/")
            rows: list[list] = []
            for r in (e for e in parse(target if target.startswith("xl/") else f"xl/{target}").iter() if _local(e) == "row"):
                cells: list = []
                for c in (e for e in r if _local(e) == "c"):
                    at = _column(c.attrib["r"]) if "r" in c.attrib else len(cells)
                    cells += [None] * (at + 1 - len(cells))
                    kind, v = c.attrib.get("t", "n"), next((e.text for e in c if _local(e) == "v"), None)
                    if kind == "inlineStr":
                        cells[at] = "".join(t.text or "" for t in c.iter() if _local(t) == "t")
                    elif v is None:
                        continue
                    elif kind == "s":
                        cells[at] = shared[int(v)]
                    elif kind == "b":
                        cells[at] = v == "1"
                    elif kind == "n":
                        style = int(c.attrib.get("s", 0))
                        if style < len(dated) and dated[style]:
                            moment = _EPOCH + timedelta(days=float(v))
                            cells[at] = moment.date() if float(v) == int(float(v)) else moment
                        else:
                            cells[at] = whole_floats(float(v))
                    elif kind != "e":
                        cells[at] = v
                rows.append(cells)
            out[s.attrib["name"]] = rows
    return out


def ods_sheets(data: bytes) -> dict[str, list[list]]:
    """Cells of every sheet of an OpenDocument spreadsheet."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        root = ElementTree.fromstring(z.read("content.xml"))
    attr = lambda e, name: next((v for k, v in e.attrib.items() if k.rpartition("}")[2] == name), None)
    out: dict[str, list[list]] = {}
    for t in (e for e in root.iter() if _local(e) == "table"):
        rows: list[list] = []
        for r in (e for e in t.iter() if _local(e) == "table-row"):
            cells: list = []
            for c in (e for e in r if _local(e) in ("table-cell", "covered-table-cell")):
                kind, value = attr(c, "value-type"), attr(c, "value")
                text = "\n".join("".join(p.itertext()) for p in c if _local(p) == "p") or None
                cell = whole_floats(float(value)) if kind in ("float", "currency", "percentage") else attr(c, "boolean-value") == "true" if kind == "boolean" else text
                if kind == "date":
                    moment = datetime.fromisoformat(attr(c, "date-value"))
                    cell = moment.date() if len(attr(c, "date-value")) <= 10 else moment
                times = int(attr(c, "number-columns-repeated") or 1)
                cells += [cell] * (times if cell is not None else min(times, 64))
            while cells and cells[-1] is None:
                cells.pop()
            rows += [cells] * min(int(attr(r, "number-rows-repeated") or 1), 1 if not cells else 1 << 20)
        out[attr(t, "name")] = rows
    return out


def _cell_kind(x) -> str | None:
    if x is None or (isinstance(x, str) and not x.strip()):
        return None
    if isinstance(x, bool):
        return "BOOLEAN"
    if isinstance(x, datetime):
        return "TIMESTAMP"
    return {int: "BIGINT", float: "DOUBLE", date: "DATE"}.get(type(x), "VARCHAR")


def sheet_frame(spark: SparkSession, rows: list[list]) -> DataFrame:
    """A sheet with its first row as header; each column has the one type its cells agree on, text if they don't."""
    rows = [r for r in rows if any(_cell_kind(c) for c in r)]
    header = header_names([None if c is None else str(c) for c in rows[0]]) if rows else []
    body = [(r + [None] * len(header))[: len(header)] for r in rows[1:]]
    kinds = [agreed({k for r in body if (k := _cell_kind(r[i]))} or {"VARCHAR"}) for i in range(len(header))]
    put = {"DOUBLE": float, "VARCHAR": lambda x: x if isinstance(x, str) else str(x), "TIMESTAMP": lambda x: x if isinstance(x, datetime) else datetime(x.year, x.month, x.day)}
    made = [tuple(None if _cell_kind(c) is None else put.get(k, lambda x: x)(c) for c, k in zip(r, kinds, strict=True)) for r in body]
    return spark.createDataFrame(made, ", ".join(f"`{h}` {SPARK_TYPES[k]}" for h, k in zip(header, kinds, strict=True)) or "empty string")


def read_workbook(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """A table for each sheet with a header."""
    data = _head(spark, path, 256 << 20)
    sheets = {n: r for n, r in (ods_sheets if path.lower().endswith(".ods") else xlsx_sheets)(data).items() if r}
    names = sheet_names(path, list(sheets))
    return {n: sheet_frame(spark, rows) for n, rows in zip(names, sheets.values(), strict=True)}


# Databases and addresses


def read_sqlite(spark: SparkSession, path: str, query: str, *, limit: int | None = None) -> DataFrame:
    """The rows of a read on a SQLite file, which is opened read-only; the limit is part of the query."""
    con = sqlite3.connect(f"file:{path}?mode=ro", uri=True)
    try:
        con.execute("PRAGMA query_only = 1")
        cur = con.execute(f"SELECT * FROM ({query.strip().rstrip(';')}) LIMIT {int(limit)}" if limit is not None else query)
        names = header_names([d[0] for d in cur.description])
        rows = [[x.hex() if isinstance(x, bytes) else x for x in r] for r in cur]
    finally:
        con.close()
    return sheet_frame(spark, [names, *rows])


def json_pointer(data, pointer: str):
    """The value at an RFC 6901 pointer."""
    if pointer and not pointer.startswith("/"):
        raise ValueError(f"not a JSON pointer: {pointer}")
    for part in pointer.split("/")[1:]:
        part = part.replace("~1", "/").replace("~0", "~")
        data = data[int(part)] if isinstance(data, list) else data[part]
    return data


def read_address(spark: SparkSession, url: str, *, pointer: str = "", limit: int | None = None) -> DataFrame:
    """Records of JSON at an http(s) or file address, at a pointer into it."""
    with urllib.request.urlopen(url, timeout=30) as response:  # noqa: S310  the caller names the address
        rows = json_pointer(json.load(response), pointer)
    rows = [rows] if isinstance(rows, dict) else rows
    return records(spark, rows if limit is None else rows[:limit])


def read_object(spark: SparkSession, uri: str) -> DataFrame:
    """A file in an object store that Spark is set up for (s3a:// and others)."""
    return read_table(spark, uri)


# One door


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """A table from a file, by its extension, else by its first bytes."""
    extension = path.rpartition(".")[2].lower()
    kind = {"parquet": "parquet", "pq": "parquet", "csv": "csv", "tsv": "csv", "tab": "csv", "psv": "csv", "json": "json", "jsonl": "json", "ndjson": "json"}.get(extension) or sniff(_head(spark, path, 512))
    return {"parquet": read_parquet, "csv": read_csv, "json": read_json}[kind](spark, path)


def first_rows(df: DataFrame, order: str, limit: int) -> DataFrame:
    """A file's row cap with a defined result: the first rows by a column."""
    return df.orderBy(order).limit(limit)


def table_for(path: str) -> str:
    name = table_name(path)
    check_reserved(name)
    return name


def folder(spark: SparkSession, path: str, registry: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(files to take in: path, content, sha256; paths to drop) of a folder against a registry (path, sha256). A file whose bytes are
    known under any path isn't taken in again; a changed one is; one that is gone is dropped."""
    now = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "content", F.sha2("content", 256).alias("sha256"))
    first = now.groupBy("sha256").agg(F.min("path").alias("path"))
    if registry is None:
        registry = spark.createDataFrame([], "path string, sha256 string")
    new = now.join(first, ["sha256", "path"], "left_semi").join(registry.select("sha256"), "sha256", "left_anti")
    return new.select("path", "content", "sha256"), registry.select("path").join(now.select("path"), "path", "left_anti")


__all__ = ["OneColumn", "folder", "infer_types", "read_address", "read_csv", "read_json", "read_object", "read_parquet", "read_sqlite", "read_table", "read_workbook", "read_yaml", "sniff", "table_for", "typed"]
