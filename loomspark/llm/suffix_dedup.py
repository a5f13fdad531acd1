"""Repeated byte strings of a corpus, by a depth-limited radix sort of its suffixes.

Suffixes are compared on their first ``SPAN`` bytes only, by most-significant-digit passes: a pass groups the
suffixes by one more digit and closes every group of one, which can't hold a repeat. What is left after the last
digit are groups of equal windows of SPAN bytes, that is the repeated strings, so no full suffix array is built.

The order in which a window's bytes serve as digits is free as long as equal windows use the same order. The
first digit is therefore chosen by content: the window's anchor, which is its gram of ``GRAM`` bytes with the
least hash. Up to WIDTH windows on end share one anchor, so the first passes move one row for about 85 suffixes:

1. digit: the anchor's gram. Anchors whose gram occurs once in the corpus are closed.
2. digit: the bytes of the whole run of windows at an anchor. A run that occurs twice is repeated as a whole.
3. digit: for runs that occur once, the bytes that are common to STEP windows on end.
4. digit: all SPAN bytes of each window that is left.

Digits are compared as hashes, each pass within the groups of the passes before; those that decide, the second and the
fourth, as two independent hashes of 64 bits, so that at 10**13 windows two different ones are taken for equal with
probability 10**-12. Digits that only close groups have one hash: there a collision costs work, never a byte.

Every pass is a counting aggregation, written, followed by an equi-join. As the counts are a table of their own, both sides
of the join are plain shuffles, which adaptive execution splits where one digit holds very many suffixes; a group is never
gathered in a task. Runs that make up at least 1/``FREQUENT`` of the runs are at most FREQUENT by their definition, so
they are broadcast and looked up where the runs lie in the order of the text: a passage that a third of all documents
share costs a row for each stretch of it, not one for each run. Rows with equal doc_id and text are one row from the
start; as they repeat each other, nothing else has to be known of them.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import Scratch
from .textkernels import U64, column_bytes, mix, powers, prefix_hash, range_hash, seeds, slices

SPAN, GRAM = 200, 32
WIDTH = SPAN - GRAM + 1
STEP = 43
#: Runs whose bytes make up 1/FREQUENT of all runs or more are broadcast.
FREQUENT = 1 << 16
#: Bytes of runs in one batch, about.
_BATCH = 4 << 20
_NO_ID = -(1 << 63)
_ALL = (1 << 31) - 1


def _second(data: np.ndarray) -> np.ndarray:
    """Prefix sums of the second hash."""
    return prefix_hash(seeds(256, 19)[data], 1)


def _sliding_least(x: np.ndarray, width: int) -> np.ndarray:
    """Least of each ``width`` values on end, by doubling."""
    have = 1
    while have * 2 <= width:
        x = np.minimum(x[:-have], x[have:])
        have *= 2
    if have < width:
        x = np.minimum(x[: len(x) - (width - have)], x[width - have :])
    return x


def _gram_hashes(prefix: np.ndarray) -> np.ndarray:
    _, down = powers(len(prefix))
    return mix((prefix[GRAM:] - prefix[:-GRAM]) * down[: len(prefix) - GRAM])


def anchor_runs(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(first window, end window, gram hash, two hashes of the run's bytes) of the runs of windows that share an anchor.

    A window starts at a byte of data and lies within one text. Its anchor is the first gram with the least hash
    among its WIDTH grams.
    """
    n = len(data)
    if n < SPAN:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), *(np.zeros(0, U64) for _ in range(3))
    prefix = prefix_hash(seeds(256, 7)[data])
    gram = _gram_hashes(prefix)
    least = _sliding_least(gram, WIDTH)
    edge = np.zeros(len(least) + 1, np.int32)  # +1 where windows of a text begin, -1 where they end
    long = np.flatnonzero(np.diff(offsets) >= SPAN)
    edge[offsets[long]] += 1
    edge[offsets[long + 1] - SPAN + 1] -= 1
    inside = np.cumsum(edge[:-1]) > 0
    cut = np.ones(len(least) + 1, bool)
    np.not_equal(least[1:], least[:-1], out=cut[1:-1])
    cut[1:-1] |= gram[: len(least) - 1] == least[:-1]  # the anchor itself is left behind
    cut[1:-1] |= inside[1:] != inside[:-1]
    cut[offsets[long]] = True
    borders = np.flatnonzero(cut)
    first, end = borders[:-1], borders[1:]
    ok = inside[first]
    first, end = first[ok], end[ok]
    grams = least[first]
    return first, end, grams, mix(range_hash(prefix, first, end - 1 + SPAN) ^ grams), range_hash(_second(data), first, end - 1 + SPAN, 1)


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """d, r, text -> one row for each run, in the order of the text: d, r, s (first window), n (windows), h (gram), f and g (bytes of the run)."""
    for batch in batches:
        d, r = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        for a, _, data, offsets in slices(batch.column(2)):
            with np.errstate(over="ignore"):
                first, end, *hashes = anchor_runs(data, offsets)
            row = np.searchsorted(offsets, first, "right") - 1
            arrays = [d[a + row], r[a + row], (first - offsets[row]).astype(np.int32), (end - first).astype(np.int32), *(x.view(np.int64) for x in hashes)]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in arrays], names=["d", "r", "s", "n", "h", "f", "g"])


def _stretches(f: np.ndarray, g: np.ndarray):
    """Of runs in the order of the text, those whose hashes are among f (sorted) and g: d, r, a, b, with runs on end as one row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = batch.column("f").to_numpy(), batch.column("g").to_numpy()
            lo, hi = np.searchsorted(f, x), np.searchsorted(f, x, "right")
            hit = np.zeros(len(x), bool)
            for step in range(int((hi - lo).max(initial=0))):  # more than 1 only if two runs' first hashes are equal
                at = lo + step
                hit |= (at < hi) & (g[np.minimum(at, len(g) - 1)] == y)
            d, r, s, n = (batch.column(c).to_numpy()[hit] for c in ("d", "r", "s", "n"))
            new = np.ones(len(d), bool)
            new[1:] = (d[1:] != d[:-1]) | (r[1:] != r[:-1]) | (s[1:] != s[:-1] + n[:-1])
            at = np.flatnonzero(new)
            last = np.append(at[1:], len(d)) - 1 if len(at) else at
            yield pa.RecordBatch.from_arrays([pa.array(v) for v in (d[at], r[at], s[at], s[last] + n[last])], names=["d", "r", "a", "b"])

    return run


def _gather(data: np.ndarray, start: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all [start, start + length) on end, and their offsets."""
    ends = np.cumsum(length)
    offsets = np.concatenate([[0], ends]).astype(np.int64)
    index = np.arange(offsets[-1]) + np.repeat(start - offsets[:-1], length)
    return data[index], offsets


def _cut_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """d, r, text, runs -> one row for each run with its bytes."""
    for batch in batches:
        for a, b, data, offsets in slices(batch.column("text")):
            lists = batch.column("runs").slice(a, b - a)
            counts = np.diff(lists.offsets.to_numpy())
            x = lists.flatten()
            s, n = x.field("s").to_numpy().astype(np.int64), x.field("n").to_numpy().astype(np.int64)
            row = np.repeat(np.arange(b - a), counts)
            for i in range(0, len(s), _BATCH // (2 * SPAN)):
                j = min(len(s), i + _BATCH // (2 * SPAN))
                text, ends = _gather(data, offsets[row[i:j]] + s[i:j], n[i:j] - 1 + SPAN)
                bytes_ = pa.Array.from_buffers(pa.binary(), j - i, [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(text))])
                take, part = pa.array(a + row[i:j]), x.slice(i, j - i)
                yield pa.RecordBatch.from_arrays([batch.column("d").take(take), batch.column("r").take(take), part.field("s"), part.field("n"), part.field("h"), part.field("once"), bytes_], names=["d", "r", "s", "n", "h", "once", "bytes"])


def _anchors_in(data: np.ndarray, offsets: np.ndarray, grams: np.ndarray, n: np.ndarray, prefix: np.ndarray) -> np.ndarray:
    """Place of the anchor of each run's windows: the first gram with hash grams at or after the run's last window."""
    hashes = np.append(_gram_hashes(prefix), U64(0))
    out, last = np.empty(len(grams), np.int64), offsets[:-1] + n - 1
    for a in range(0, len(grams), 4096):
        at = last[a : a + 4096, None] + np.arange(WIDTH)[None, :]
        out[a : a + 4096] = last[a : a + 4096] + (hashes[np.minimum(at, len(hashes) - 1)] == grams[a : a + 4096, None]).argmax(1)
    return out


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each run and each block of STEP distances from the anchor: the hash of the bytes that its windows share."""
    for batch in batches:
        for a, b, data, offsets in slices(batch.column("bytes")):
            n = batch.column("n").to_numpy()[a:b].astype(np.int64)
            h = batch.column("h").to_numpy()[a:b].view(U64)
            with np.errstate(over="ignore"):
                prefix = prefix_hash(seeds(256, 7)[data])
                anchor = _anchors_in(data, offsets, h, n, prefix)
                far = anchor - offsets[:-1]  # distance of the first window from the anchor; the last is at far - n + 1
                rows, blocks = [], []
                for j in range(-(-WIDTH // STEP)):
                    at = np.flatnonzero((far >= STEP * j) & (far - n + 1 < STEP * (j + 1)))
                    rows.append(at)
                    blocks.append(np.full(len(at), j))
                row, block = np.concatenate(rows), np.concatenate(blocks)
                start = anchor[row] - STEP * block
                key = mix(range_hash(prefix, start, start + SPAN - STEP + 1) ^ mix(h[row] + block.astype(U64)))
            take = pa.array(a + row)
            lo = np.maximum(0, far[row] - (STEP * (block + 1) - 1))  # first and last window of the run in the block
            hi = np.minimum(n[row] - 1, far[row] - STEP * block)
            yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), *(batch.column(c).take(take) for c in ("d", "r", "s", "once")), pa.array(lo.astype(np.int32)), pa.array(hi.astype(np.int32))], names=["k", "d", "r", "s", "once", "lo", "hi"])


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs with their open blocks -> a row for each window: two hashes of all its bytes."""
    for batch in batches:
        for a, b, data, offsets in slices(batch.column("bytes")):
            lists = batch.column("blocks").slice(a, b - a)
            counts, x = np.diff(lists.offsets.to_numpy()), lists.flatten()
            lo, hi = x.field("lo").to_numpy().astype(np.int64), x.field("hi").to_numpy().astype(np.int64)
            row = np.repeat(np.arange(b - a), counts)
            size = hi - lo + 1
            ends = np.concatenate([[0], np.cumsum(size)])
            window = np.arange(ends[-1]) + np.repeat(lo - ends[:-1], size)
            row = np.repeat(row, size)
            start = offsets[row] + window
            with np.errstate(over="ignore"):
                h = batch.column("h").to_numpy()[a:b].view(U64)
                key = mix(range_hash(prefix_hash(seeds(256, 7)[data]), start, start + SPAN) ^ h[row])
                second = range_hash(_second(data), start, start + SPAN, 1)
            once = batch.column("once").to_numpy(zero_copy_only=False)[a:b][row]
            take = pa.array(a + row)
            s = batch.column("s").to_numpy()[a:b][row] + window
            yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(second.view(np.int64)), batch.column("d").take(take), batch.column("r").take(take), pa.array(s.astype(np.int32)), pa.array(once)], names=["w", "v", "d", "r", "s", "once"])


def _named(docs: DataFrame) -> DataFrame:
    """Rows named by d (doc_id) and r (a hash of the row); equal rows share a name and have equal results."""
    return docs.withColumns({"d": F.coalesce(F.col("doc_id").cast("long"), F.lit(_NO_ID)), "r": F.xxhash64("doc_id", "text")})


def repeated_spans(docs: DataFrame, scratch: Scratch) -> DataFrame:
    """(d, r, spans array<struct<a int, b int>>), one row for each name: windows that start at a ... b - 1 occur elsewhere too. Rows without any are missing."""
    named = _named(docs.select("doc_id", "text")).select("d", "r", F.coalesce("text", F.lit("")).alias("text"))
    # Of rows with one name the first stands for all of them; each is wholly repeated by the others.
    equal = scratch.write(named.groupBy("d", "r").agg(F.count("*").alias("c")).where("c > 1").select("d", "r"), "equal")
    texts, names = named, ["d", "r"]
    if not equal.isEmpty():
        texts = named.join(equal, names, "left_anti").unionByName(named.join(equal, names, "left_semi").groupBy(*names).agg(F.first("text").alias("text")))
    copies = equal.select("d", "r", F.lit(0).alias("a"), F.lit(_ALL).alias("b"))

    runs = scratch.write(texts.mapInArrow(_runs, "d long, r long, s int, n int, h long, f long, g long"), "runs")
    total = runs.count()
    shared = scratch.write(runs.groupBy("h").agg(F.count("*").alias("c")).where("c > 1").select("h"), "shared")
    alive = scratch.write(runs.join(shared, "h", "left_semi"), "alive")
    scratch.drop(shared)

    bytes_ = ["h", "f", "g"]
    classes = scratch.write(alive.groupBy(*bytes_).agg(F.count("*").alias("c"), F.min(F.struct("d", "r", "s", "n")).alias("x")), "classes")
    often = F.col("c") * FREQUENT >= total
    frequent = classes.where("c > 1").where(often).select("f", "g").orderBy("f").toArrow()
    keys = [frequent[k].to_numpy() for k in ("f", "g")]
    whole = runs.select("d", "r", "s", "n", "f", "g").mapInArrow(_stretches(*keys), "d long, r long, a int, b int")
    rare = alive.join(classes.where("c > 1").where(~often).select(*bytes_), bytes_, "left_semi").select("d", "r", F.col("s").alias("a"), (F.col("s") + F.col("n")).alias("b"))
    whole = scratch.write(whole.unionByName(rare).unionByName(copies), "whole")
    scratch.drop(alive, runs)

    mixed = scratch.write(classes.groupBy("h").agg(F.count("*").alias("m"), F.min("c").alias("least")).where("m > 1 and least = 1").select("h"), "mixed")
    open_runs = classes.join(mixed, "h").select("x.*", "h", (F.col("c") == 1).alias("once"))
    by_row = open_runs.groupBy("d", "r").agg(F.collect_list(F.struct("s", "n", "h", "once")).alias("runs"))
    cut = texts.join(by_row.hint("shuffle_hash"), ["d", "r"]).select("d", "r", "text", "runs")
    cut = scratch.write(cut.mapInArrow(_cut_runs, "d long, r long, s int, n int, h long, once boolean, bytes binary"), "cut")
    scratch.drop(classes, mixed, equal)

    blocks = scratch.write(cut.mapInArrow(_blocks, "k long, d long, r long, s int, once boolean, lo int, hi int"), "blocks")
    met = scratch.write(blocks.groupBy("k").agg(F.count("*").alias("c"), F.max("once").alias("some")).where("c > 1 and some").select("k"), "met")
    left = blocks.join(met, "k", "left_semi").groupBy("d", "r", "s").agg(F.collect_list(F.struct("lo", "hi")).alias("blocks"))
    windows = cut.join(left, ["d", "r", "s"]).select("d", "r", "s", "h", "once", "bytes", "blocks")
    windows = scratch.write(windows.mapInArrow(_windows, "w long, v long, d long, r long, s int, once boolean"), "windows")
    scratch.drop(cut, blocks, met)

    again = scratch.write(windows.groupBy("w", "v").agg(F.count("*").alias("c"), F.max("once").alias("some")).where("c > 1 and some").select("w", "v"), "again")
    single = windows.where("once").join(again, ["w", "v"], "left_semi").select("d", "r", F.col("s").alias("a"), (F.col("s") + 1).alias("b"))
    spans = whole.unionByName(single).groupBy("d", "r").agg(F.collect_list(F.struct("a", "b")).alias("spans"))
    spans = scratch.write(spans, "spans")
    scratch.drop(whole, windows, again)
    return spans


def covered(a: np.ndarray, b: np.ndarray) -> list[tuple[int, int]]:
    """Maximal byte ranges covered by windows of SPAN bytes that start in any [a, b)."""
    order = np.argsort(a, kind="stable")
    start, end = a[order].astype(np.int64), np.maximum.accumulate(b[order].astype(np.int64)) - 1 + SPAN
    first = np.flatnonzero(np.append(True, start[1:] > end[:-1]))
    return list(zip(start[first].tolist(), end[np.append(first[1:], len(start)) - 1].tolist(), strict=True))


def _with_spans(docs: DataFrame, scratch: Scratch) -> DataFrame:
    return _named(docs).join(repeated_spans(docs, scratch).hint("shuffle_hash"), ["d", "r"], "left")


def _kept(batch: pa.RecordBatch) -> Iterator[tuple[int, list[tuple[int, int]], bytes]]:
    """(bytes, removed ranges, what remains) of each row of a batch with text and spans."""
    data, offsets = column_bytes(batch.column("text"))
    lists = batch.column("spans")
    at = lists.offsets.to_numpy()
    a, b = (lists.values.field(c).to_numpy() for c in ("a", "b"))
    for i, (x, y) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)):
        text = data[x:y].tobytes()
        gone = [(p, min(q, y - x)) for p, q in covered(a[at[i] : at[i + 1]], b[at[i] : at[i + 1]])] if at[i + 1] > at[i] and y - x >= SPAN else []
        place, parts = 0, []
        for p, q in gone:
            parts.append(text[place:p])
            place = q
        yield y - x, gone, b"".join([*parts, text[place:]]) if gone else text


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        n, removed, spans, digest = [], [], [], []
        for size, gone, rest in _kept(batch):
            n.append(size)
            removed.append(size - len(rest))
            spans.append(len(gone))
            digest.append(hashlib.sha256(rest).hexdigest())
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(spans, pa.int64()), pa.array(digest, pa.string())], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])


def removal_digests(docs: DataFrame) -> DataFrame:
    """What the removal of repeated strings leaves of each document.

    Each byte that a string of SPAN bytes covers which also starts anywhere else, in this or another document, is
    removed; overlaps count, and strings are judged on the input. Returns one row per row of docs: doc_id, n_bytes,
    n_removed, n_spans (maximal removed runs) and kept_sha256 of the remaining bytes.

    Defined cases: a null text is empty; texts shorter than SPAN bytes lose nothing; a row that occurs twice has all
    its windows elsewhere, and so loses its whole text if that has SPAN bytes; a null doc_id stays null; an empty
    table gives an empty one; other columns are left aside.
    """
    joined = _with_spans(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), Scratch(docs.sparkSession))
    return joined.select("doc_id", "text", "spans").mapInArrow(_digests, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def without_repeats(docs: DataFrame) -> DataFrame:
    """docs with its repeated strings cut out of text, all other columns as they are (n_chars, if there, is set anew).

    Where a cut splits a UTF-8 character, the rest of that character goes too. A text that is repeated as a whole becomes
    empty; its row stays.
    Defined cases: a null text stays null; texts shorter than SPAN bytes, empty and blank ones stay as they are; rows that
    repeat a doc_id and its text lose the whole text if that has SPAN bytes, whatever their other columns hold; a null
    doc_id stays null; an empty table gives an empty one; a column named like one used inside stays as it is.
    """
    others = [c for c in docs.columns if c != "text"]
    inner = docs.select(F.struct(*others).alias("row"), F.col("doc_id").cast("long").alias("doc_id"), "text")
    schema = f"row {docs.select(*others).schema.simpleString()}, had boolean, kept string"

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [rest.decode("utf-8", "ignore") for _, _, rest in _kept(batch)]
            yield pa.RecordBatch.from_arrays([batch.column("row"), batch.column("text").is_valid(), pa.array(texts, pa.string())], names=["row", "had", "kept"])

    joined = _with_spans(inner, Scratch(docs.sparkSession)).select("row", "text", "spans").mapInArrow(cut, schema)
    new = {"text": F.when(F.col("had"), F.col("kept")).alias("text"), "n_chars": F.length("kept").cast("long").alias("n_chars")}
    return joined.select(*(new.get(c, F.col(f"row.`{c}`")) for c in docs.columns))
