"""WARC archives of pages, and one globally ordered index of their captures.

Writing: every task writes its rows into archives of ``ARCHIVE_BYTES`` at most, each record a gzip member of its own, and beside
each archive a run: its index lines, sorted by URL key, time and page. Archives carry the task attempt in their name and are
listed only by the attempt that succeeds, so a lost executor leaves no half-written archive in use.

Reading: archives are read back record by record, with bounded memory, and every record is checked against its digests.

Index: the runs are merged as external merges are: the key space is cut at sampled keys, and the task of a range
merges its part of every run with a loser tree, k-way. A key holds time and page as well, so captures of one hot URL
fall into as many ranges as any others. The merged order gives each capture its place in the whole index and in the
history of its URL key, and the capture before it; where a history runs on into the next ranges, a summary of
one row for each range carries its count.
"""

from __future__ import annotations

import gzip
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from datetime import datetime, timezone

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scratch import Scratch, new_path, tasks_for

#: Payloads under this many bytes are stored even if they occur elsewhere.
LEAST_REVISIT = 100
ARCHIVE_BYTES = 32 << 20
#: Index rows that one merge task gets, about.
RANGE_ROWS = 200_000
#: Bytes of archives that one task reads, at most, and at least if there are cores for more tasks.
MOST_READ, LEAST_READ = 32 << 20, 1 << 20
_NO_PAGE = -(1 << 63)  # nulls come first
_EPOCH = datetime(2000, 1, 1, tzinfo=timezone.utc)

_RECORD = "page_id long, url string, url_key string, captured string, record_type string, refers_to long, payload_digest string, payload_bytes long, position long, capture_no long, previous_page long"


def url_key(url: Column) -> Column:
    """Sort key of a URL: the labels of its host from the right, joined by commas, then ``)`` and the rest, without scheme; '' for null."""
    rest = F.regexp_replace(F.coalesce(url, F.lit("")), r"(?s)^[A-Za-z][A-Za-z0-9+.\-]*://", "")
    host_part = F.lower(F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1))
    tail = F.regexp_extract(rest, r"(?s)^[^/?#]*(.*)$", 1)
    return F.concat(F.array_join(F.reverse(F.split(host_part, r"\.")), ","), F.lit(")"), tail)


def planned(pages: DataFrame) -> DataFrame:
    """page_id, url, payload, and how each is stored: payload_digest, payload_bytes, record_type, refers_to, url_key, captured."""
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary").alias("payload"))
    rows = rows.withColumns({"payload_digest": F.sha2("payload", 256), "payload_bytes": F.octet_length("payload").cast("long"), "url_key": url_key(F.col("url"))})
    # The first page of a payload; only payloads that occur again are joined.
    firsts = rows.where((F.col("payload_bytes") >= LEAST_REVISIT) & F.col("page_id").isNotNull()).groupBy("payload_digest").agg(F.min("page_id").alias("first"), F.max("page_id").alias("last")).where("first < last").drop("last")
    rows = rows.join(firsts, "payload_digest", "left")
    again = F.col("first").isNotNull() & (F.col("page_id") > F.col("first"))
    captured = F.date_format(F.timestamp_seconds(F.lit(int(_EPOCH.timestamp())) + F.pmod(F.coalesce("page_id", F.lit(0)), F.lit(1 << 31))), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    return rows.select("page_id", "url", "payload", "payload_digest", "payload_bytes", "url_key", captured.alias("captured"), F.when(again, "revisit").otherwise("response").alias("record_type"), F.when(again, F.col("first")).alias("refers_to"))


def record_id(page_id: int | None) -> str:
    """The record's URN, made from its page, so that a revisit can name the record that it refers to."""
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_OID, f'page:{page_id}')}>"


def _header_safe(text: str) -> str:
    """A header value on one line: control characters and % are percent-encoded."""
    return "".join(f"%{b:02X}" for b in text.encode()) if not text.isprintable() else text.replace("%", "%25")


def _header_back(text: str) -> str:
    from urllib.parse import unquote

    return unquote(text)


def record_bytes(row: dict) -> bytes:
    """A gzip member with one WARC/1.1 record: an HTTP response, or a revisit with its head only."""
    stored = row["record_type"] == "response"
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n" + (row["payload"] if stored else b"")
    head = [
        "WARC/1.1", f"WARC-Type: {row['record_type']}", f"WARC-Record-ID: {record_id(row['page_id'])}", f"WARC-Date: {row['captured']}",
        f"WARC-Payload-Digest: sha256:{row['payload_digest']}", f"WARC-Block-Digest: sha256:{hashlib.sha256(block).hexdigest()}", f"X-Payload-Length: {row['payload_bytes']}", f"X-Page: {'' if row['page_id'] is None else row['page_id']}",
    ]
    if row["url"] is not None:
        head.append(f"WARC-Target-URI: {_header_safe(row['url'])}")
    if not stored:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {record_id(row['refers_to'])}", f"X-Refers-To-Page: {row['refers_to']}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return gzip.compress("\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n", 1, mtime=0)


def _open(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri)


def write_archives(pages: DataFrame, folder: str, scratch: Scratch) -> DataFrame:
    """Write pages below the URI ``folder``. Returns the index runs, unmerged: run, position in it, url_key, captured, page_id, offset, length."""
    fields = pa.schema([("run", pa.string()), ("place", pa.int32()), ("url_key", pa.string()), ("captured", pa.string()), ("page_id", pa.int64()), ("offset", pa.int64()), ("length", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, base = _open(folder)
        files.create_dir(base, recursive=True)
        out = name = None
        lines: list[tuple] = []
        size = 0

        def closed() -> pa.RecordBatch:
            nonlocal out, lines
            out.close()
            lines.sort(key=lambda x: (x[1].encode(), x[2], _NO_PAGE if x[3] is None else x[3]))
            got, lines, out = lines, [], None
            return pa.RecordBatch.from_pylist([dict(zip(fields.names, (x[0], i, *x[1:]), strict=True)) for i, x in enumerate(got)], schema=fields)

        for batch in batches:
            for row in batch.to_pylist():
                if out is None:
                    name = f"{uuid.uuid4().hex}.warc.gz"
                    out, size = files.open_output_stream(f"{base}/{name}", compression=None), 0
                data = record_bytes(row)
                out.write(data)
                lines.append((name, row["url_key"], row["captured"], row["page_id"], size, len(data)))
                size += len(data)
                if size >= ARCHIVE_BYTES:
                    yield closed()
        if out is not None:
            yield closed()

    return scratch.write(planned(pages).mapInArrow(run, "run string, place int, url_key string, captured string, page_id long, offset long, length long"), "runs")


def read_record(data: bytes) -> dict:
    """The fields of the one record in a gzip member; a wrong length or digest is an error."""
    raw = zlib.decompress(data, 31)
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if lines[0] != "WARC/1.1":
        raise ValueError("not a WARC record")
    f = dict(x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in lines[1:])
    block = rest[: int(f["Content-Length"])]
    if len(rest) != len(block) + 4 or f["WARC-Block-Digest"] != f"sha256:{hashlib.sha256(block).hexdigest()}":
        raise ValueError(f"damaged record {f.get('WARC-Record-ID')}")
    payload = block.partition(b"\r\n\r\n")[2]
    kind, digest = f["WARC-Type"], f["WARC-Payload-Digest"].removeprefix("sha256:")
    if kind == "response" and digest != hashlib.sha256(payload).hexdigest():
        raise ValueError(f"damaged payload {f['WARC-Record-ID']}")
    return {
        "page_id": int(f["X-Page"]) if f["X-Page"] else None, "url": _header_back(f["WARC-Target-URI"]) if "WARC-Target-URI" in f else None, "captured": f["WARC-Date"], "record_type": kind,
        "refers_to": int(f["X-Refers-To-Page"]) if "X-Refers-To-Page" in f else None, "payload_digest": digest, "payload_bytes": int(f["X-Payload-Length"]), "payload": payload if kind == "response" else None,
    }


class LoserTree:
    """Merges sorted iterators of (key, value): the root holds the least head, every inner node the loser of its match, so
    each value taken costs one match a level."""

    def __init__(self, runs: list[Iterator[tuple]]) -> None:
        self.runs, k = runs, len(runs)
        self.heads = [next(r, None) for r in runs]
        self.losers = [-1] * max(1, k)
        winners = [-1] * k + list(range(k))
        for node in range(k - 1, 0, -1):
            a, b = winners[2 * node], winners[2 * node + 1]
            winners[node], self.losers[node] = (a, b) if self._wins(a, b) else (b, a)
        self.best = winners[1] if k > 1 else 0 if k else -1

    def _wins(self, a: int, b: int) -> bool:
        x, y = self.heads[a], self.heads[b]
        if x is None or y is None:
            return y is None and (x is not None or a < b)
        return (x[0], a) < (y[0], b)

    def __iter__(self) -> Iterator[tuple]:
        k = len(self.runs)
        while self.best >= 0 and (head := self.heads[self.best]) is not None:
            yield head
            self.heads[self.best] = next(self.runs[self.best], None)
            node, winner = (self.best + k) // 2, self.best
            while node:
                if self._wins(self.losers[node], winner):
                    self.losers[node], winner = winner, self.losers[node]
                node //= 2
            self.best = winner


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows of one key range, from any runs -> the same rows in key order, with their number in the range (at), the number
    among those of their URL key there (nth) and the page of the one before of that key (previous_page)."""
    table = [b for b in batches if b.num_rows]
    if not table:
        return
    rows = pa.Table.from_batches(table)
    keys = list(zip((x.encode() for x in rows["url_key"].to_pylist()), rows["captured"].to_pylist(), (_NO_PAGE if x is None else x for x in rows["page_id"].to_pylist()), strict=True))
    runs: dict[str, list[int]] = {}
    for i, (name, place) in enumerate(zip(rows["run"].to_pylist(), rows["place"].to_pylist(), strict=True)):
        runs.setdefault(name, []).append((place, i))
    order = [i for _, i in LoserTree([iter([(keys[i], i) for _, i in sorted(runs[n])]) for n in sorted(runs)])]
    rows = rows.take(pa.array(order, pa.int64())).drop_columns(["place"])
    nth, previous, n = [], [], 0
    for i, (a, b) in enumerate(zip([-1, *order], order, strict=False)):
        n = n + 1 if i and keys[a][0] == keys[b][0] else 1
        nth.append(n)
        previous.append(keys[a][2] if n > 1 and keys[a][2] != _NO_PAGE else None)
    for name, x in (("at", pa.array(range(1, len(order) + 1), pa.int64())), ("nth", pa.array(nth, pa.int64())), ("previous_page", pa.array(previous, pa.int64()))):
        rows = rows.append_column(name, x)
    yield from rows.combine_chunks().to_batches()


def merged_index(runs: DataFrame, scratch: Scratch) -> DataFrame:
    """The captures of all runs in global order: url_key, captured, page_id, run, offset, length; ``part`` numbers the key ranges.

    position counts the captures of the index from 1, capture_no those of one url_key, and previous_page is the page of the one
    before in that history (null for the first).
    """
    order = ["url_key", "captured", "page_id"]
    n = runs.count()
    ranges = max(1, -(-n // RANGE_ROWS))
    dealt = runs.repartitionByRange(ranges, *(F.col(c).asc_nulls_first() for c in order)) if ranges > 1 else runs.coalesce(1)
    schema = "run string, url_key string, captured string, page_id long, offset long, length long, at long, nth long, previous_page long"
    merged = scratch.write(dealt.mapInArrow(_merge, schema).withColumn("part", F.spark_partition_id()), "merged")
    # A row for each range: how many captures it has, and the history that it ends with.
    ends = merged.groupBy("part").agg(F.max("at").alias("n"), F.min_by("url_key", "at").alias("first"), F.max_by("url_key", "at").alias("last"), F.max_by("nth", "at").alias("nth"), F.max_by("page_id", "at").alias("page"))
    ends = scratch.write(ends, "ranges")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = ends.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    borders = ends.select("part", F.lit(1).alias("ends"), F.col("last").alias("key"), "nth", F.struct("page").alias("page"))
    borders = borders.unionByName(ends.select("part", F.lit(0).alias("ends"), F.col("first").alias("key"), F.lit(0).alias("nth"), F.lit(None).cast("struct<page: long>").alias("page")))
    history = Window.partitionBy("key").orderBy("part", "ends").rowsBetween(Window.unboundedPreceding, -1)
    carried = borders.select("part", "ends", "key", F.sum("nth").over(history).alias("more"), F.last("page", True).over(history).alias("page")).where("ends = 0 and more > 0")
    carried = carried.select("part", F.col("key").alias("url_key"), "more", F.col("page.page").alias("page"))
    out = merged.join(starts, "part").join(carried, ["part", "url_key"], "left")
    out = out.select(
        "run", "url_key", "captured", "page_id", "offset", "length", "part", (F.col("start") + F.col("at")).alias("position"), (F.col("nth") + F.coalesce("more", F.lit(0))).alias("capture_no"),
        F.when(F.col("nth") > 1, F.col("previous_page")).otherwise(F.col("page")).alias("previous_page"),
    )
    out = scratch.write(out, "index")
    scratch.drop(merged)
    return out


def read_archives(index: DataFrame, folder: str) -> DataFrame:
    """The records that index rows point to, read from the archives below ``folder``, each archive in file order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, base = _open(folder)
        name, file = None, None
        for batch in batches:
            out = []
            for x in batch.to_pylist():
                if x["run"] != name:
                    if file:
                        file.close()
                    name, file = x["run"], files.open_input_file(f"{base}/{x['run']}")
                file.seek(x["offset"])
                got = read_record(file.read(x["length"]))
                got.pop("payload")
                out.append(got | {c: x[c] for c in ("url_key", "position", "capture_no", "previous_page")})
            kinds = {"long": pa.int64(), "string": pa.string()}
            fields = pa.schema([(c, kinds[k]) for c, k in (x.split() for x in _RECORD.split(", "))])
            yield pa.RecordBatch.from_pylist(out, schema=fields)
        if file:
            file.close()

    # A task reads neighbouring records, each archive that it needs from front to back; tasks are as many as the bytes call for.
    spark = index.sparkSession
    size = int(index.agg(F.coalesce(F.sum("length"), F.lit(0))).first()[0])
    places = index.select("run", "offset", "length", "url_key", "position", "capture_no", "previous_page")
    places = places.repartitionByRange(tasks_for(spark, size, MOST_READ, LEAST_READ), "run", "offset").sortWithinPartitions("run", "offset")
    return places.mapInArrow(run, _RECORD)


def archive_round_trip(pages: DataFrame) -> DataFrame:
    """Write every page as a WARC record, merge the index runs, and return what reading the archives back gives.

    One row per row of pages: page_id, payload_bytes, payload_digest, record_type, refers_to, url_key and captured, and
    from the merged index position, capture_no and previous_page (see merged_index; captures of one URL key are in the order of
    captured and page_id, nulls first, and captures equal in those in any order). Of records with equal payloads of LEAST_REVISIT bytes or more, the one with the least page_id is a response and the
    others revisit it; smaller ones are all responses.
    Defined cases: a null html is an empty payload; a null url gives a record without a target and the key ``)``; a row
    without a page_id is a response; rows that repeat the least page_id of a payload are all responses; an empty
    table gives an empty one; other columns are left aside.
    """
    scratch = Scratch(pages.sparkSession)
    folder = new_path(pages.sparkSession, "warc")
    scratch.paths.append(folder)
    index = merged_index(write_archives(pages, folder, scratch), scratch)
    return read_archives(index, folder).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url_key", "captured", "position", "capture_no", "previous_page")

