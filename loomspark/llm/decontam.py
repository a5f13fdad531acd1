"""Passages of benchmark items in documents: SimHash windows, multi-index Hamming search, exact verification.

An item of n words is compared with the windows of n words of each document (with the whole document if that is
shorter). Windows and items are bags of word shingles; a window's SimHash is the sign of the sum of its shingles'
random +-1 vectors, each as often as it occurs, and windows of one size are slid by prefix sums. The fingerprints
of the items are indexed by BLOCKS blocks of 16 bits: two fingerprints within RADIUS bits have a block within RADIUS //
BLOCKS bits, so looking up each block of a window, and all values so close to it, finds every item within RADIUS.
What the index returns is verified by the weighted Jaccard similarity of the bags, sum of least over sum of greatest counts.

A window can reach the least similarity only if enough of its shingles belong to items at all, whichever they are; a
prefix sum tells, and only such windows get a fingerprint. That test is exact and names no item: the candidates come from the
Hamming index. Memory doesn't depend on the length of an item: fingerprints are summed in steps, and the similarity of all
windows with an item follows from one difference array over the places of its shingles.

Documents are scanned once. If the items need several blocks, that scan keeps the texts with a shingle of any item, by a bitmap of
fixed size, and each block looks at those only; what is broadcast is the bitmap or one block, whose size is fixed.

RADIUS is four standard deviations beyond the mean distance at similarity 0.8: the bags' cosine is 2 * 0.8 / 1.8
there, so a bit differs with probability acos(0.889) / pi = 0.151, and 64 bits by 9.7 +- 2.9.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import Scratch
from .textkernels import U64, mix, shingle_hashes, slices, word_hashes

SHINGLE = 5
BLOCKS = 4
RADIUS = 21
#: Items and bytes of their texts that one block holds, about.
BLOCK_ITEMS, BLOCK_BYTES = 1024, 4 << 20
#: Bits of the bitmap of all items' shingles, as a power of 2.
BITMAP = 27
_FILTER_BITS = 20
#: Shingles that fingerprints sum at a time, and windows.
_STEP = 1 << 14


@dataclass
class Items:
    """A block of items with words: ids, word counts, and their shingles in one array."""

    ids: np.ndarray
    words: np.ndarray
    first: np.ndarray
    shingles: np.ndarray  # of item i: sorted [first[i], first[i + 1]), with repeats
    prints: np.ndarray

    @classmethod
    def of(cls, rows: list[tuple[int, str]]) -> Items:
        texts = pa.array([t or "" for _, t in rows], pa.large_string())
        ids, sizes, bags = [], [], []
        at = 0
        for a, b, data, offsets in slices(texts):
            with np.errstate(over="ignore"):
                words, _, _, first = word_hashes(data, offsets)
                for i in range(b - a):
                    w = words[first[i] : first[i + 1]]
                    if len(w):
                        ids.append(rows[at + i][0])
                        sizes.append(len(w))
                        bags.append(np.sort(shingle_hashes(w, min(SHINGLE, len(w)))))
            at += b - a
        with np.errstate(over="ignore"):
            prints = np.array([fingerprints(x, np.array([0]), np.array([len(x)]))[0] for x in bags], U64)
        return cls(np.array(ids, np.int64), np.array(sizes, np.int64), np.cumsum([0, *map(len, bags)]), np.concatenate([*bags, np.zeros(0, U64)]), prints)


def fingerprints(shingles: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit SimHash of the shingles in each [start, end)."""
    out = np.zeros(len(start), U64)
    for i in range(0, len(start), _STEP):
        first, last = start[i : i + _STEP], end[i : i + _STEP]
        borders = np.unique(np.concatenate([first, last]))
        sums, carry = np.zeros((len(borders), 64), np.int32), np.zeros(64, np.int32)
        for a in range(int(borders[0]), int(borders[-1]) + 1, _STEP):
            part = mix(shingles[a : a + _STEP])
            so_far = np.zeros((len(part) + 1, 64), np.int32)
            np.cumsum(2 * np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1).astype(np.int32) - 1, axis=0, out=so_far[1:])
            so_far += carry
            lo, hi = np.searchsorted(borders, [a, a + _STEP])
            sums[lo:hi] = so_far[borders[lo:hi] - a]
            carry = so_far[-1]
        inside = sums[np.searchsorted(borders, last)] - sums[np.searchsorted(borders, first)]
        out[i : i + _STEP] = np.packbits(inside > 0, axis=1).view(U64)[:, 0]
    return out


class HammingIndex:
    """A bitmap of items for each value of each 16-bit block: those whose block is within RADIUS // BLOCKS bits of it."""

    def __init__(self, prints: np.ndarray) -> None:
        self.prints = prints
        flips = np.array([sum(1 << i for i in c) for n in range(RADIUS // BLOCKS + 1) for c in combinations(range(16), n)], np.uint16)
        self.tables = np.zeros((BLOCKS, 1 << 16, -(-len(prints) // 8)), np.uint8)
        for b, values in enumerate(prints.view(np.uint16).reshape(-1, BLOCKS).T):
            for i, v in enumerate(values):
                self.tables[b, flips ^ v, i >> 3] |= np.uint8(128 >> (i & 7))

    def search(self, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(query, item) of all pairs within RADIUS, in order."""
        parts = prints.view(np.uint16).reshape(-1, BLOCKS)
        near = self.tables[0, parts[:, 0]]
        for b in range(1, BLOCKS):
            near |= self.tables[b, parts[:, b]]
        query, item = np.nonzero(np.unpackbits(near, axis=1)[:, : len(self.prints)])
        ok = np.bitwise_count(prints[query] ^ self.prints[item]) <= RADIUS
        return query[ok], item[ok]


def overlaps(places: np.ndarray, shingles: np.ndarray, bag: np.ndarray, m: int, starts: np.ndarray) -> np.ndarray:
    """How many shingles each window [start, start + m) shares with a bag, counted as often as both have them.

    places (rising) and shingles: those of a text that may be in the bag. The bag is given sorted with repeats. A place counts for the
    windows that hold it and fewer places of its shingle before it than the bag has.
    """
    keys, counts = np.unique(bag, return_counts=True)
    at = np.minimum(np.searchsorted(keys, shingles), len(keys) - 1)
    own = keys[at] == shingles
    places, at = places[own], at[own]
    order = np.argsort(at, kind="stable")
    places, at = places[order], at[order]
    nth = np.arange(len(at)) - np.searchsorted(at, at)
    earlier = np.where(nth >= counts[at], places[np.maximum(0, np.arange(len(at)) - counts[at])], -1)
    first = np.sort(np.maximum(earlier + 1, places - m + 1))
    return np.searchsorted(first, starts, "right") - np.searchsorted(np.sort(places), starts - 1, "right")


class Scanner:
    """Finds the items of a block in texts."""

    def __init__(self, items: Items, least: float) -> None:
        self.items, self.least = items, least
        #: Items and their index by number of words.
        self.of = {int(n): np.flatnonzero(items.words == n) for n in np.unique(items.words)}
        self.index = {n: HammingIndex(items.prints[x]) for n, x in self.of.items()}
        self.key = np.unique(items.shingles)
        self.seen = np.zeros(1 << _FILTER_BITS, bool)
        self.seen[self.key >> U64(64 - _FILTER_BITS)] = True
        sizes = np.unique(items.words)
        #: Numbers of words of items that are one shingle each, and of the others with the shingles that a window must share with items.
        self.short = sizes[sizes < SHINGLE]
        self.sizes = sizes[sizes >= SHINGLE]
        self.needed = self._needed(self.sizes - SHINGLE + 1, self.sizes - SHINGLE + 1)

    def _needed(self, m: np.ndarray, n: np.ndarray) -> np.ndarray:
        """The least overlap of windows of m shingles with items of n."""
        return np.ceil(self.least * (m + n) / (1 + self.least) - 1e-9).astype(np.int64)

    def _places(self, shingles: np.ndarray) -> np.ndarray:
        """The places of shingles that any item has."""
        place = np.flatnonzero(self.seen[shingles >> U64(64 - _FILTER_BITS)])
        if not len(place):
            return place
        at = np.minimum(np.searchsorted(self.key, shingles[place]), len(self.key) - 1)
        return place[self.key[at] == shingles[place]]

    def _windows(self, every: np.ndarray, place: np.ndarray, size: int) -> Iterator[tuple[int, np.ndarray]]:
        """(words, starts) of the windows of a text of ``size`` words that may be alike to an item; place: of the shingles that items have."""
        for n, needed in zip(self.sizes[self.needed <= len(place)].tolist(), self.needed[self.needed <= len(place)].tolist(), strict=True):
            if n > size:
                break
            m = n - SHINGLE + 1
            # A window with so many places begins at most m before the last of some run of them.
            full = np.flatnonzero(place[needed - 1 :] - place[: len(place) - needed + 1] < m)
            if len(full):
                lo, hi = np.maximum(0, place[full + needed - 1] - m + 1), np.minimum(place[full], size - n)
                edge = np.zeros(size - n + 2, np.int32)
                ok = lo <= hi
                np.add.at(edge, lo[ok], 1)
                np.add.at(edge, hi[ok] + 1, -1)
                starts = np.flatnonzero(np.cumsum(edge[:-1]) > 0)
                if len(starts):
                    yield n, starts
        if len(self.sizes) and SHINGLE <= size < self.sizes[-1] and len(place):
            yield size, np.zeros(1, np.int64)  # the whole text, against longer items

    def scan(self, data: np.ndarray, offsets: np.ndarray) -> list[tuple[int, int, float, int, int]]:
        """(text, item, greatest similarity, first word of the first such window, its words) of each item found in a text."""
        if not self.index:
            return []
        with np.errstate(over="ignore"):
            words, _, _, first = word_hashes(data, offsets)
            texts: dict[tuple[int, int], tuple[np.ndarray, np.ndarray]] = {}  # (text, words of a shingle): shingles and their places
            asked = []  # text, words of a shingle, words and start of a window, fingerprint
            for k in [*self.short.tolist(), *([SHINGLE] if len(self.sizes) else [])]:
                every = shingle_hashes(words, k)
                place = self._places(every)
                text = np.searchsorted(first, place, "right") - 1
                ok = place + k <= first[text + 1]
                place, text = place[ok], text[ok]
                for at in np.split(np.arange(len(text)), np.flatnonzero(np.diff(text)) + 1) if len(text) else ():
                    i = int(text[at[0]])
                    begin, size = int(first[i]), int(first[i + 1] - first[i])
                    own, own_places = every[begin : begin + size - k + 1], place[at] - begin
                    texts[i, k] = own, own_places
                    for n, starts in self._windows(own, own_places, size) if k == SHINGLE else [(k, own_places)]:
                        prints = fingerprints(own, starts, starts + n - k + 1)
                        asked.append((np.full(len(starts), i), np.full(len(starts), k), np.full(len(starts), n), starts, prints))
            if not asked:
                return []
            i, k, n, start, prints = map(np.concatenate, zip(*asked, strict=True))
            # A window is looked for among the items of its size, a whole text also among longer ones that it may be alike to.
            whole = np.flatnonzero((n == (first[i + 1] - first[i])) & (k == SHINGLE))
            pairs = []
            for size in self.of:
                m = size - SHINGLE + 1
                longer = whole[(n[whole] < size) & (n[whole] - SHINGLE + 1 >= self.least * m - 1e-9)] if size >= SHINGLE else whole[:0]
                those = np.concatenate([np.flatnonzero((n == size) & (k == min(size, SHINGLE))), longer])
                if len(those):
                    distinct, which = np.unique(prints[those], return_inverse=True)
                    query, x = self.index[size].search(distinct)
                    lo, hi = np.searchsorted(query, which), np.searchsorted(query, which, "right")
                    window = np.repeat(np.arange(len(which)), hi - lo)
                    pairs.append((those[window], self.of[size][x[np.arange(len(window)) + np.repeat(lo - np.cumsum(hi - lo) + hi - lo, hi - lo)]]))
            window, item = (np.concatenate(x) for x in zip(*pairs, strict=True)) if pairs else (np.zeros(0, int),) * 2
            if not len(window):
                return []
            order = np.lexsort((start[window], n[window], item, i[window]))
            window, item = window[order], item[order]
            found = []
            new = np.flatnonzero(np.append(True, (i[window][1:] != i[window][:-1]) | (item[1:] != item[:-1])))
            for a, b in zip(new, np.append(new[1:], len(window)), strict=True):
                at, x = window[a:b], int(item[a])
                best = self._best(*texts[int(i[at[0]]), int(k[at[0]])], int(k[at[0]]), int(n[at[0]]), start[at], x)
                if best:
                    found.append((int(i[at[0]]), x, *best, int(n[at[0]])))
        return found

    def _best(self, every: np.ndarray, place: np.ndarray, k: int, n: int, starts: np.ndarray, item: int) -> tuple[float, int] | None:
        """The best of the windows of n words from ``starts`` (rising) for item, if one is alike."""
        bag = self.items.shingles[self.items.first[item] : self.items.first[item + 1]]
        m = n - k + 1
        both = overlaps(place, every[place], bag, m, starts)
        alike = both / (m + len(bag) - both)
        best = int(alike.argmax())
        return (float(alike[best]), int(starts[best])) if alike[best] >= self.least else None


def _rows(benchmark: DataFrame) -> DataFrame:
    return benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).where("item_id is not null")


def _n_blocks(benchmark: DataFrame) -> int:
    n, size = _rows(benchmark).agg(F.count("*"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    return max(1, -(-n // BLOCK_ITEMS), -(-size // BLOCK_BYTES))


def item_blocks(benchmark: DataFrame, blocks: int) -> Iterator[Items]:
    """The items in blocks of bounded size, each brought to the driver by itself. Items without an id or words are left out."""
    rows = _rows(benchmark)
    for k in range(blocks):
        part = rows.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == k) if blocks > 1 else rows
        got = sorted({(int(x["item_id"]), x["text"] or "") for x in part.collect()})
        for i in range(0, max(1, len(got)), BLOCK_ITEMS):
            yield Items.of(got[i : i + BLOCK_ITEMS])


def _hit(texts: pa.Array, bitmap: np.ndarray, sizes: list[int]) -> np.ndarray:
    """Whether each text has a shingle whose bit is set."""
    hit = np.zeros(len(texts), bool)
    for a, _, data, offsets in slices(texts):
        with np.errstate(over="ignore"):
            words, _, _, first = word_hashes(data, offsets)
            for k in sizes:
                bit = shingle_hashes(words, k) >> U64(64 - BITMAP)
                place = np.flatnonzero(bitmap[(bit >> U64(3)).astype(np.int64)] >> (bit & U64(7)).astype(np.uint8) & 1)
                text = np.searchsorted(first, place, "right") - 1
                hit[a + text[place + k <= first[text + 1]]] = True
    return hit


def _bitmap(benchmark: DataFrame, blocks: int) -> tuple[np.ndarray, list[int]]:
    """A bit for each shingle of any item, and the shingles' numbers of words."""
    bitmap, sizes = np.zeros(1 << BITMAP - 3, np.uint8), set()
    for items in item_blocks(benchmark, blocks):
        bit = np.unique(items.shingles >> U64(64 - BITMAP))
        np.bitwise_or.at(bitmap, (bit >> U64(3)).astype(np.int64), (1 << (bit & U64(7)).astype(np.int64)).astype(np.uint8))
        sizes |= {min(SHINGLE, int(n)) for n in np.unique(items.words)}
    return bitmap, sorted(sizes)


def _with_hits(rows: DataFrame, benchmark: DataFrame, blocks: int, hits: bool = True) -> DataFrame:
    """The rows (row, text) whose text has a shingle of any item (or those without one)."""
    shared = rows.sparkSession.sparkContext.broadcast(_bitmap(benchmark, blocks))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(_hit(batch.column("text"), *shared.value) == hits))

    return rows.mapInArrow(run, rows.schema)


_MATCH = "doc_id long, item_id long, similarity double, start_word long, n_words long"


def leaks(docs: DataFrame, benchmark: DataFrame, *, least: float = 0.8) -> DataFrame:
    """(doc_id, item_id, similarity, start_word, n_words): the items that documents hold, with the best window of each.

    docs: doc_id, text; benchmark: item_id, text; other columns are left aside. One row for each row of docs and item
    with a window of similarity ``least`` or more; start_word counts from 0, the first window of several equal ones.
    Defined cases: null, empty and blank texts hold nothing and are held nowhere; an item with fewer words than a shingle is
    one shingle, found only whole; a document shorter than an item is one window; a repeated row of docs gives its
    rows again, a repeated item counts once, and two texts with one item_id are both looked for; a null doc_id
    stays null, an item without an id is left out; an empty table on either side gives an empty one.
    """
    rows, blocks = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), _n_blocks(benchmark)
    if blocks > 1:
        rows = Scratch(docs.sparkSession).write(_with_hits(rows, benchmark, blocks), "with_hits")
    out: DataFrame | None = None
    for items in item_blocks(benchmark, blocks):
        shared = docs.sparkSession.sparkContext.broadcast(items)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            scanner = Scanner(shared.value, least)
            for batch in batches:
                for a, _, data, offsets in slices(batch.column("text")):
                    found = scanner.scan(data, offsets)
                    text, item, alike, start, n = zip(*found, strict=True) if found else ((),) * 5
                    ids = scanner.items.ids[list(item)] if found else []
                    yield pa.RecordBatch.from_arrays(
                        [batch.column("doc_id").take(pa.array([a + t for t in text], pa.int64())), pa.array(ids, pa.int64()), pa.array(alike, pa.float64()), pa.array(start, pa.int64()), pa.array(n, pa.int64())],
                        names=["doc_id", "item_id", "similarity", "start_word", "n_words"],
                    )

        part = rows.mapInArrow(run, _MATCH)
        out = part if out is None else out.unionByName(part)
    return out


def without_leaks(docs: DataFrame, benchmark: DataFrame, *, least: float = 0.8) -> DataFrame:
    """The rows of docs that hold no item of similarity ``least`` or more, with all their columns.

    Defined cases: rows with a null, empty or blank text stay; repeated rows stay or go together; rows without a doc_id
    are judged as others are; an empty benchmark, or one without an item that has an id and words, keeps all rows; an empty table
    gives an empty one.
    """
    rows, blocks = docs.select(F.struct(*docs.columns).alias("row")), _n_blocks(benchmark)
    schema, scratch = f"row {docs.schema.simpleString()}", Scratch(docs.sparkSession)
    clean = None
    if blocks > 1:
        texts = docs.select(F.struct(*docs.columns).alias("row"), "text")
        clean = _with_hits(texts, benchmark, blocks, False).select("row")
        rows = scratch.write(_with_hits(texts, benchmark, blocks).select("row"), "with_hits")
    for items in item_blocks(benchmark, blocks):
        shared = docs.sparkSession.sparkContext.broadcast(items)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            scanner = Scanner(shared.value, least)
            for batch in batches:
                row, keep = batch.column("row"), np.ones(batch.num_rows, bool)
                for a, _, data, offsets in slices(row.field("text")):
                    keep[[a + t for t, *_ in scanner.scan(data, offsets)]] = False
                yield pa.RecordBatch.from_arrays([row.filter(pa.array(keep))], names=["row"])

        before, rows = rows, rows.mapInArrow(run, schema)
        if blocks > 1:
            rows = scratch.write(rows, "without_block")
            scratch.drop(before)
    rows = rows if clean is None else rows.unionByName(clean)
    return rows.select(*(F.col(f"row.`{c}`") for c in docs.columns))
