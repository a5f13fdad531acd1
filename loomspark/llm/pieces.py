"""SentencePiece encoding and decoding as a weighted finite-state transducer.

A model file is compiled into one transducer T = normaliser o pieces: the normaliser replaces the longest of its sequences of
characters at each place by what its character map has for it, squeezes blanks and puts one before a text; the pieces form a machine whose arcs read the characters of a piece, write its id
and carry a weight, and characters outside the vocabulary have arcs that write the ids of their bytes. A text is
composed with T, which gives an acyclic lattice over its characters, and its encoding is the shortest path in the
tropical semiring (least sum of weights).

* Unigram models: an arc weighs minus the piece's score.
* BPE models: a state also keeps the last piece, and an arc exists only between two pieces that BPE leaves side by
  side; all weights are 0. A sequence of pieces is the BPE encoding of its text just when each two neighbours are
  (Berglund and van der Merwe, 2023), so the lattice has one path, which is what merging by rank gives.
* User-defined pieces are read whole wherever they stand, the longest from the left first, and the normaliser doesn't see them.

No piece holds a blank after another character, so the shortest path of a text is that of its segments (a word with
the blanks before it, or one character outside the vocabulary). A batch's distinct segments are solved together,
one array pass for each character place and arc length, and each is solved once in a task.
"""

from __future__ import annotations

import hashlib
import heapq
import re
import struct
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textkernels import U64, mix, prefix_hash, range_hash, slices

BLANK = 0x2581
#: Values of SentencePiece's model format: piece types and model types.
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNIGRAM, BPE = 1, 2
_B = 0x2545F4914F6CDD1D
_NONE = np.iinfo(np.int64).max
#: Distinct segments that a task remembers; beyond, it starts anew.
_REMEMBERED = 400_000
#: Bytes of texts that are encoded together, about: many, as their distinct segments are solved together.
SLICE = 1 << 20


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of the fields of a protocol buffer message."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(data):
        key = varint()
        if key & 7 == 0:
            yield key >> 3, varint()
        else:
            size = {1: 8, 5: 4}.get(key & 7) or varint()
            yield key >> 3, data[at : at + size]
            at += size


@dataclass
class Transducer:
    """A compiled model. Pieces are numbered by rank: single characters first, then by falling score."""

    kind: int
    ids: np.ndarray  # id of each rank
    surfaces: list[bytes]  # bytes that each id decodes to; empty for control pieces
    weights: np.ndarray  # float64 of each rank
    lengths: np.ndarray  # characters of each rank
    keys: np.ndarray  # sorted hashes of the arcs' labels ...
    key_rank: np.ndarray  # ... and their ranks
    known: np.ndarray  # bool of each code point
    pair_keys: np.ndarray  # sorted left * n + right of BPE's merges ...
    pair_rank: np.ndarray  # ... and what they make
    left: np.ndarray  # parts that a rank was merged from; itself for characters
    right: np.ndarray
    byte_ids: np.ndarray  # id of each byte, or -1
    unknown_id: int
    unknown_weight: float
    dummy_prefix: bool
    squeeze: bool  # runs of blanks count as one, those at the ends as none
    charsmap: CharacterMap | None = None
    user: dict[str, int] = field(default_factory=dict)  # ids of user-defined pieces
    runs: dict[int, tuple[int, ...]] = field(default_factory=dict)  # ids of runs of blanks, as they come up
    blank_scores: dict[int, tuple[float, int]] = field(default_factory=dict)  # score and id of pieces of blanks only

    @property
    def longest(self) -> int:
        return int(self.lengths.max())


@dataclass
class CharacterMap:
    """The normaliser's sequences of characters and what stands for them."""

    table: dict[str, str]
    alone: np.ndarray  # bool of each code point: a sequence by itself
    begins: np.ndarray  # bool of each code point: the first of a longer sequence
    second: np.ndarray  # bool of each code point: the second of one
    longest: int

    @classmethod
    def parse(cls, blob: bytes) -> CharacterMap:
        """Read the format of model files: the size of a double array in bytes, the array, and the replacements, each ended by a zero byte."""
        size = struct.unpack_from("<I", blob)[0]
        units, rest = np.frombuffer(blob, "<u4", size // 4, 4).astype(np.int64), blob[4 + size :]
        jump = lambda unit: (unit >> 10) << ((unit & 512) >> 6)
        labels, table, open_ = np.arange(1, 256), {}, [(int(jump(units[0])), b"")]
        while open_:
            at, key = open_.pop()
            places = at ^ labels
            ok = places < len(units)
            for label in labels[ok][(units[places[ok]] & 0x800000FF) == labels[ok]].tolist():
                unit = int(units[at ^ label])
                below, text = (at ^ label) ^ jump(unit), key + bytes([label])
                if unit >> 8 & 1:
                    start = int(units[below]) & 0x7FFFFFFF
                    table[text.decode()] = rest[start : rest.index(b"\0", start)].decode()
                open_.append((below, text))
        alone, begins, second = (np.zeros(0x110000, bool) for _ in range(3))
        alone[[ord(k) for k in table if len(k) == 1]] = True
        begins[[ord(k[0]) for k in table if len(k) > 1]] = True
        second[[ord(k[1]) for k in table if len(k) > 1]] = True
        return cls(table, alone, begins, second, max(map(len, table), default=1))

    def apply(self, text: str) -> str:
        """The longest sequence at each place replaced, from the left; other characters stay."""
        points = np.frombuffer(text.encode("utf-32-le"), np.uint32)
        active = self.alone[points]
        active[:-1] |= self.begins[points[:-1]] & self.second[points[1:]]
        out, place = [], 0
        for i in np.flatnonzero(active).tolist():
            if i < place:
                continue
            for n in range(min(self.longest, len(text) - i), 0, -1):
                if (new := self.table.get(text[i : i + n])) is not None:
                    out += [text[place:i], new]
                    place = i + n
                    break
        return "".join([*out, text[place:]]) if out else text


def _hash_text(text: str) -> int:
    h = 0
    for c in text:
        h = (h * _B + ord(c) + 1) & ((1 << 64) - 1)
    return h


def _merge(parts: list[str], rank: dict[str, int], below: int) -> list[str]:
    """BPE of a few symbols with the pieces of ranks under ``below``."""
    while True:
        best = min(((rank.get(a + b, below), i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False))), default=(below, 0))
        if best[0] >= below:
            return parts
        i = best[1]
        parts[i : i + 2] = [parts[i] + parts[i + 1]]


def compile_model(path: str) -> Transducer:
    """Compile a .model file. No piece but a user-defined one may hold a blank after another character."""
    with open(path, "rb") as f:
        data = f.read()
    pieces: list[tuple[str, float, int]] = []
    kind, byte_fallback, dummy, squeeze, charsmap = UNIGRAM, False, True, True, b""
    for number, value in _fields(data):
        if number == 1:
            x = dict(_fields(value))
            pieces.append((x[1].decode(), struct.unpack("<f", x.get(2, b"\0" * 4))[0], x.get(3, NORMAL)))
        elif number == 2:
            x = dict(_fields(value))
            kind, byte_fallback = x.get(3, UNIGRAM), bool(x.get(35, 0))
        elif number == 3:
            x = dict(_fields(value))
            charsmap, dummy, squeeze = x.get(2, b""), bool(x.get(3, 1)), bool(x.get(4, 1))
    if kind not in (UNIGRAM, BPE):
        raise NotImplementedError("only unigram and BPE models are compiled")
    user = {p: i for i, (p, _, t) in enumerate(pieces) if t == USER_DEFINED}
    usable = [(p, s, i) for i, (p, s, t) in enumerate(pieces) if t == NORMAL]
    if any(a != "▁" and b == "▁" for p, _, _ in usable for a, b in zip(p, p[1:], strict=False)):
        raise NotImplementedError("a piece holds a blank after another character")
    usable.sort(key=lambda x: (len(x[0]) > 1, -x[1], x[2]))
    rank = {p: r for r, (p, _, _) in enumerate(usable)}
    n = len(usable)
    left, right = np.arange(n), np.arange(n)
    reachable = np.ones(n, bool)
    pairs: dict[int, int] = {}
    if kind == BPE:
        for p, r in rank.items():
            if len(p) > 1:
                parts = _merge(list(p), rank, r)
                reachable[r] = len(parts) == 2 and all(x in rank for x in parts)
                if reachable[r]:
                    left[r], right[r] = rank[parts[0]], rank[parts[1]]
                    pairs[int(left[r]) * n + int(right[r])] = r
    labels = np.array([_hash_text(p) for p, _, _ in usable], U64)
    arcs = np.flatnonzero(reachable)
    arcs = arcs[np.argsort(labels[arcs], kind="stable")]
    known = np.zeros(0x110000, bool)
    # BPE starts from characters, so one that no piece consists of can't be part of a longer piece either.
    known[[ord(p) for p, _, _ in usable if len(p) == 1]] = True
    bytes_ = {int(p[3:5], 16): i for i, (p, _, t) in enumerate(pieces) if t == BYTE}
    if kind == UNIGRAM:
        known[[ord(c) for p, _, _ in usable for c in p]] = True
    surface = lambda p, t: b"" if t in (CONTROL,) else bytes([int(p[3:5], 16)]) if t == BYTE else " ⁇ ".encode() if t == UNKNOWN else p.replace("▁", " ").encode()
    scores = [s for _, s, _ in usable]
    pair_keys = np.array(sorted(pairs), np.int64)
    return Transducer(
        kind=kind,
        ids=np.array([i for _, _, i in usable], np.int32),
        surfaces=[surface(p, t) for p, _, t in pieces],
        weights=-np.array(scores, np.float64) if kind == UNIGRAM else np.zeros(n),
        lengths=np.array([len(p) for p, _, _ in usable]),
        keys=labels[arcs],
        key_rank=arcs,
        known=known,
        pair_keys=pair_keys,
        pair_rank=np.array([pairs[int(k)] for k in pair_keys], np.int64),
        left=left,
        right=right,
        byte_ids=np.array([bytes_.get(b, -1) if byte_fallback else -1 for b in range(256)], np.int32),
        unknown_id=next((i for i, (_, _, t) in enumerate(pieces) if t == UNKNOWN), 0),
        unknown_weight=10.0 - min(scores, default=0.0),
        dummy_prefix=dummy,
        squeeze=squeeze,
        charsmap=CharacterMap.parse(charsmap) if charsmap else None,
        user=user,
        blank_scores={len(p): (s, i) for p, s, i in usable if set(p) == {"▁"}},
    )


def _find(keys: np.ndarray, values: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """values of the wanted keys, or -1."""
    if not len(keys):
        return np.full(len(wanted), -1, np.int64)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return np.where(keys[at] == wanted, values[at], -1)


class Encoder:
    """Shortest paths of segments, remembered."""

    def __init__(self, t: Transducer) -> None:
        self.t = t
        self.user = re.compile("|".join(re.escape(p) for p in sorted(t.user, key=len, reverse=True))) if t.user else None
        self.by_slot = self._slots(t)
        self.pair_keys, self.pair_good = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self._forget()

    def _forget(self) -> None:
        self.hashes, self.place = np.zeros(0, U64), np.zeros(0, np.int64)
        self.ids, self.ends = [np.zeros(0, np.int32)], [np.zeros(1, np.int64)]
        self.flat, self.offsets = np.zeros(0, np.int32), np.zeros(1, np.int64)

    @staticmethod
    def _slots(t: Transducer) -> np.ndarray:
        """Whether any label's hash has these top 20 bits: spares most searches for labels that no arc has."""
        out = np.zeros(1 << 20, bool)
        with np.errstate(over="ignore"):
            out[mix(t.keys) >> U64(44)] = True
        return out

    def _arcs(self, hashes: np.ndarray) -> np.ndarray:
        """Rank of the piece with each hash, or -1."""
        out = np.full(len(hashes), -1, np.int64)
        some = np.flatnonzero(self.by_slot[mix(hashes) >> U64(44)])
        out[some] = _find(self.t.keys, self.t.key_rank, hashes[some])
        return out

    def _neighbours(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether BPE leaves the pieces of ranks a and b side by side."""
        keys = a * len(self.t.ids) + b
        wanted = np.unique(keys)
        new = wanted[_find(self.pair_keys, self.pair_good, wanted) < 0]
        if len(new):
            if len(self.pair_keys) > 4_000_000:
                self.pair_keys, self.pair_good, new = np.zeros(0, np.int64), np.zeros(0, np.int64), wanted
            good = self._stay_apart(new // len(self.t.ids), new % len(self.t.ids)).astype(np.int64)
            at = np.searchsorted(self.pair_keys, new)
            self.pair_keys, self.pair_good = np.insert(self.pair_keys, at, new), np.insert(self.pair_good, at, good)
        return _find(self.pair_keys, self.pair_good, keys) == 1

    def _stay_apart(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Undo the merges inside both pieces, last first; a merge across the border that ranks before what is undone would have come first."""
        t, n = self.t, len(self.t.ids)
        good, alive = np.ones(len(a), bool), np.arange(len(a))
        before = np.full(len(a), _NONE)
        while len(alive):
            across = _find(t.pair_keys, t.pair_rank, a * n + b)
            bad = (across >= 0) & (across < before)
            good[alive[bad]] = False
            left_whole, right_whole = t.right[a] == a, t.left[b] == b
            undo_left = ~left_whole & ((a > b) | right_whole)
            undo_right = ~right_whole & ~undo_left
            # At equal rank the merge further left comes first, so the border's goes before one to its right.
            before = np.where(undo_left, a, np.where(undo_right, b + 1, before))
            go = ~bad & (undo_left | undo_right)
            a, b = np.where(undo_left, t.right[a], a)[go], np.where(undo_right, t.left[b], b)[go]
            before, alive = before[go], alive[go]
        return good

    def _paths(self, matrix: np.ndarray, size: np.ndarray) -> list[np.ndarray]:
        """Ranks along the shortest path of each row's first size[i] characters."""
        t, (n, width) = self.t, matrix.shape
        hashes = np.zeros((width + 1, n), U64)
        powers = [U64(pow(_B, d, 1 << 64)) for d in range(min(t.longest, width) + 1)]
        cost = np.full((width + 1, n), np.inf)
        cost[0] = 0
        last, back = np.full((width + 1, n), -1, np.int64), np.zeros((width + 1, n), np.int32)
        rows = np.arange(n)
        for i in range(1, width + 1):
            rows = rows[size[rows] >= i]
            if not len(rows):
                break
            hashes[i, rows] = hashes[i - 1, rows] * U64(_B) + matrix[rows, i - 1].astype(U64) + U64(1)
            for d in range(min(i, t.longest), 0, -1):
                live = rows[np.isfinite(cost[i - d, rows])]
                if t.kind == BPE:
                    live = live[~np.isfinite(cost[i, live])]  # at most one arc into a place is allowed
                piece = self._arcs(hashes[i, live] - hashes[i - d, live] * powers[d])
                live, piece = live[piece >= 0], piece[piece >= 0]
                if t.kind == BPE and i > d and len(live):
                    ok = self._neighbours(last[i - d, live], piece)
                    live, piece = live[ok], piece[ok]
                total = cost[i - d, live] + t.weights[piece]
                better = total < cost[i, live]
                live, piece = live[better], piece[better]
                cost[i, live], last[i, live], back[i, live] = total[better], piece, d
        at, out = size.copy(), []
        rows = np.arange(n)
        while len(rows):
            if not np.isfinite(cost[at[rows], rows]).all():
                raise ValueError("the transducer doesn't accept a segment")
            out.append((rows, last[at[rows], rows]))
            at[rows] -= back[at[rows], rows]
            rows = rows[at[rows] > 0]
        owner, rank = (np.concatenate(x[::-1]) for x in zip(*out, strict=True))
        order = np.argsort(owner, kind="stable")
        counts = np.bincount(owner, minlength=n)
        return np.split(rank[order], np.cumsum(counts)[:-1])

    def _blanks(self, k: int) -> tuple[int, ...]:
        """Ids of k blanks on end under BPE: all pieces of blanks may have one score, and then the leftmost pair goes first."""
        if k not in self.t.runs:
            size, alive = [1] * k, [True] * k
            nxt, prev = list(range(1, k + 1)), list(range(-1, k - 1))
            heap: list = []

            def offer(i: int) -> None:
                j = nxt[i]
                if j < k and size[i] + size[j] in self.t.blank_scores:
                    heapq.heappush(heap, (-self.t.blank_scores[size[i] + size[j]][0], i, size[i], size[j]))

            for i in range(k - 1):
                offer(i)
            while heap:
                _, i, a, b = heapq.heappop(heap)
                if not alive[i] or size[i] != a or nxt[i] >= k or size[nxt[i]] != b:
                    continue
                j = nxt[i]
                size[i], alive[j], nxt[i] = a + b, False, nxt[j]
                if nxt[j] < k:
                    prev[nxt[j]] = i
                    offer(i)
                if prev[i] >= 0:
                    offer(prev[i])
            self.t.runs[k] = tuple(self.t.blank_scores[size[i]][1] for i in range(k) if alive[i])
        return self.t.runs[k]

    def _solve(self, points: np.ndarray, start: np.ndarray, end: np.ndarray) -> list[np.ndarray]:
        """Ids of each segment."""
        t, out = self.t, [np.zeros(0, np.int32)] * len(start)
        size = end - start
        blanks = points == BLANK
        run = np.cumsum(blanks)
        lead = np.zeros(len(start), np.int64)  # blanks beyond one before a word, and whole runs of blanks
        if t.kind == BPE:
            many = np.flatnonzero((size > 1) & blanks[start] & blanks[np.minimum(start + 1, len(points) - 1)])
            for i in many.tolist():
                k = 1
                while start[i] + k < end[i] and blanks[start[i] + k]:
                    k += 1
                lead[i] = k if k == size[i] else k - 1
        del run
        given = np.zeros(len(start), bool)
        for i in range(len(start) if t.user else 0):
            whole = "".join(map(chr, points[start[i] : end[i]].tolist()))
            if whole in t.user:
                out[i], given[i] = np.array([t.user[whole]], np.int32), True
        size = np.where(given, 0, size)
        lead[given] = 0
        strange = np.flatnonzero((size == 1) & ~t.known[points[start]])
        for i in strange.tolist():
            raw = chr(points[start[i]]).encode("utf-8", "surrogatepass")
            ids = t.byte_ids[list(raw)]
            out[i] = ids if (ids >= 0).all() else np.array([t.unknown_id], np.int32)
        size = size - lead
        usual = np.setdiff1d(np.flatnonzero(size > 0), strange, assume_unique=True)
        done: dict[int, np.ndarray] = {}
        usual = usual[np.argsort(size[usual], kind="stable")]
        a = 0
        while a < len(usual):
            top = max(8, 1 << int(size[usual[a]] - 1).bit_length())
            b = int(np.searchsorted(size[usual], top, "right"))
            b = min(b, a + max(1, (1 << 20) // top))
            chosen = usual[a:b]
            width = int(size[chosen[-1]])
            index = (start[chosen] + lead[chosen])[:, None] + np.arange(width)[None, :]
            matrix = points[np.minimum(index, len(points) - 1)]
            for i, ranks in zip(chosen.tolist(), self._paths(matrix, size[chosen]), strict=True):
                done[i] = t.ids[ranks]
            a = b
        for i, ids in done.items():
            if lead[i]:
                bare = t.blank_scores[1][1]
                extra = int(ids[0] == bare)
                ids = np.concatenate([np.array(self._blanks(int(lead[i]) + extra), np.int32), ids[extra:]])
            out[i] = ids
        for i in np.flatnonzero((size == 0) & (lead > 0)).tolist():
            out[i] = np.array(self._blanks(int(lead[i])), np.int32)
        return out

    def _normalised(self, text: str) -> str:
        """The text through the character map, but for user-defined pieces in it."""
        if not self.user:
            return self.t.charsmap.apply(text)
        out, place = [], 0
        for m in self.user.finditer(text):
            out += [self.t.charsmap.apply(text[place : m.start()]), m[0]]
            place = m.end()
        return "".join([*out, self.t.charsmap.apply(text[place:])])

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts on end, first id of each text and the end)."""
        t = self.t
        text = data.tobytes().decode("utf-8")
        begins = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])[offsets]
        if t.charsmap:
            texts = [self._normalised(text[a:b]) for a, b in zip(begins[:-1].tolist(), begins[1:].tolist(), strict=True)]
            text, begins = "".join(texts), np.cumsum([0, *map(len, texts)])
        points = np.frombuffer(text.encode("utf-32-le"), np.uint32)
        points = np.where(points == 32, BLANK, points).astype(np.int64)
        row = np.repeat(np.arange(len(offsets) - 1), np.diff(begins))
        if t.squeeze and len(points):
            blank = points == BLANK
            first = np.zeros(len(points) + 1, bool)
            first[begins[:-1]] = True
            keep = ~(blank & (first[:-1] | np.append(True, blank[:-1])))
            points, row = points[keep], row[keep]
            last = np.append(row[1:] != row[:-1], True) if len(row) else np.zeros(0, bool)
            keep = ~(last & (points == BLANK))
            points, row = points[keep], row[keep]
        counts = np.bincount(row, minlength=len(offsets) - 1)
        if t.dummy_prefix:
            full = (counts > 0).astype(np.int64)
            ahead = np.cumsum(full)
            laid = np.full(len(points) + int(ahead[-1] if len(ahead) else 0), BLANK, np.int64)
            laid[np.arange(len(points)) + ahead[row]] = points
            points, row = laid, np.repeat(np.arange(len(counts)), counts + full)
        if not len(points):
            return np.zeros(0, np.int32), np.zeros(len(offsets), np.int64)
        blank, strange = points == BLANK, ~t.known[points]
        cut = np.ones(len(points), bool)
        cut[1:] = (row[1:] != row[:-1]) | (blank[1:] & ~blank[:-1]) | strange[1:] | strange[:-1]
        if self.user:
            ends = np.append(np.flatnonzero(np.append(True, row[1:] != row[:-1])), len(points))
            for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True):
                for m in self.user.finditer("".join(map(chr, points[a:b].tolist()))):
                    cut[a + m.start()] = True
                    cut[a + m.start() + 1 : a + m.end()] = False
                    if a + m.end() < len(points):
                        cut[a + m.end()] = True
        start = np.flatnonzero(cut)
        end = np.append(start[1:], len(points))
        with np.errstate(over="ignore"):
            names = range_hash(prefix_hash(mix(points.astype(U64))), start, end)
            unique, first, which = np.unique(names, return_index=True, return_inverse=True)
            if len(self.hashes) > _REMEMBERED:
                self._forget()
            place = _find(self.hashes, self.place, unique)
            new = np.flatnonzero(place < 0)
            if len(new):
                got = self._solve(points, start[first[new]], end[first[new]])
                base = len(self.offsets) - 1
                self.flat = np.concatenate([self.flat, *got])
                self.offsets = np.concatenate([self.offsets, self.offsets[-1] + np.cumsum([len(x) for x in got])])
                place[new] = base + np.arange(len(new))
                at = np.searchsorted(self.hashes, unique[new])
                self.hashes, self.place = np.insert(self.hashes, at, unique[new]), np.insert(self.place, at, place[new])
        place = place[which]
        n = self.offsets[place + 1] - self.offsets[place]
        ends = np.cumsum(n)
        ids = self.flat[np.arange(ends[-1]) + np.repeat(self.offsets[place] - ends + n, n)]
        per_text = np.bincount(row[start], weights=n, minlength=len(offsets) - 1).astype(np.int64)
        return ids, np.concatenate([[0], np.cumsum(per_text)])


class Decoder:
    """The inverse transducer: ids to the bytes they stand for, without the blank put before a text."""

    def __init__(self, t: Transducer) -> None:
        self.dummy = t.dummy_prefix
        self.size = np.array([len(s) for s in t.surfaces], np.int64)
        self.start = np.concatenate([[0], np.cumsum(self.size)[:-1]])
        self.bytes = np.frombuffer(b"".join(t.surfaces), np.uint8)

    def decode(self, ids: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(bytes of all texts on end, offsets)."""
        size, start = self.size[ids], self.start[ids].copy()
        if self.dummy:
            begin = first[:-1][np.diff(first) > 0]
            begin = begin[(size[begin] > 0) & (self.bytes[np.minimum(start[begin], len(self.bytes) - 1)] == 32)]
            start[begin] += 1
            size[begin] -= 1
        ends = np.concatenate([[0], np.cumsum(size)])
        data = self.bytes[np.arange(ends[-1]) + np.repeat(start - ends[:-1], size)]
        return data, ends[first]


def _shared(docs: DataFrame, model: str) -> Broadcast:
    """The compiled model; its size is that of the vocabulary."""
    return docs.sparkSession.sparkContext.broadcast(compile_model(model))


def encode(docs: DataFrame, model: str) -> DataFrame:
    """docs with ids array<int>, the encoding of text by the model file at path ``model``, which the driver reads.

    Defined cases: null and empty texts have no ids; characters outside the vocabulary are encoded as their bytes, or as one
    unknown id each where the model has no byte pieces; all columns of docs stay, one named ids is replaced; an empty
    table gives an empty one.
    """
    shared = _shared(docs, model)
    others = [c for c in docs.columns if c != "ids"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(shared.value)
        for batch in batches:
            for a, b, data, offsets in slices(batch.column("text"), SLICE):
                ids, first = encoder.encode(data, offsets)
                lists = pa.ListArray.from_arrays(pa.array(first.astype(np.int32)), pa.array(ids))
                yield pa.RecordBatch.from_arrays([batch.column("row").slice(a, b - a), lists], names=["row", "ids"])

    rows = docs.select(F.struct(*others).alias("row"), F.col("text").cast("string").alias("text"))
    schema = docs.select(*others).schema.simpleString()
    return rows.mapInArrow(run, f"row {schema}, ids array<int>").select(*(F.col(f"row.`{c}`") for c in others), "ids")


def decode(encoded: DataFrame, model: str) -> DataFrame:
    """encoded with decoded string, the text that its ids stand for; null ids give an empty text, broken UTF-8 gives U+FFFD."""
    shared = _shared(encoded, model)
    others = [c for c in encoded.columns if c != "decoded"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = Decoder(shared.value)
        for batch in batches:
            lists = batch.column("ids")
            lists = lists.fill_null([]) if lists.null_count else lists
            first = lists.offsets.to_numpy().astype(np.int64)
            data, offsets = decoder.decode(lists.flatten().to_numpy(), first - first[0])
            raw = data.tobytes()
            texts = [raw[a:b].decode("utf-8", "replace") for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(texts, pa.string())], names=["row", "decoded"])

    rows = encoded.select(F.struct(*others).alias("row"), F.coalesce("ids", F.array().cast("array<int>")).alias("ids"))
    schema = encoded.select(*others).schema.simpleString()
    return rows.mapInArrow(run, f"row {schema}, decoded string").select(*(F.col(f"row.`{c}`") for c in others), "decoded")


def encode_and_back(docs: DataFrame, model: str) -> DataFrame:
    """One row per row of docs: doc_id, ids and round_trip (whether the ids decode to the text). One worker does both, so the model is held once.

    Defined cases: as in encoding_digests; null and empty texts have no ids and make the round trip.
    """
    shared = _shared(docs, model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, decoder = Encoder(shared.value), Decoder(shared.value)
        for batch in batches:
            for a, b, data, offsets in slices(batch.column("text"), SLICE):
                ids, first = encoder.encode(data, offsets)
                back, at = decoder.decode(ids, first)
                same = np.array([np.array_equal(data[p:q], back[x:y]) for p, q, x, y in zip(offsets[:-1].tolist(), offsets[1:].tolist(), at[:-1].tolist(), at[1:].tolist(), strict=True)], bool)
                lists = pa.ListArray.from_arrays(pa.array(first.astype(np.int32)), pa.array(ids))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(a, b - a), lists, pa.array(same)], names=["doc_id", "ids", "round_trip"])

    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, ids array<int>, round_trip boolean")


def encoding_digests(docs: DataFrame, model: str) -> DataFrame:
    """One row per row of docs: doc_id, n_pieces, n_byte_pieces, ids_sha256 (of the ids as little-endian 32-bit numbers) and
    round_trip (whether the ids decode to the text).

    Defined cases: null and empty texts have no pieces and make the round trip; a text that the normaliser changes, or that has characters
    a model without byte pieces doesn't know, doesn't make it; a null doc_id stays null, repeated rows give their rows
    again, an empty table gives an empty one; other columns are left aside.
    """
    shared = _shared(docs, model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, decoder = Encoder(shared.value), Decoder(shared.value)
        is_byte = np.zeros(len(decoder.size), bool)
        is_byte[encoder.t.byte_ids[encoder.t.byte_ids >= 0]] = True
        for batch in batches:
            for a, b, data, offsets in slices(batch.column("text"), SLICE):
                ids, first = encoder.encode(data, offsets)
                back, at = decoder.decode(ids, first)
                raw, ends, starts = ids.astype("<i4").tobytes(), first[1:].tolist(), first[:-1].tolist()
                digest = [hashlib.sha256(raw[4 * i : 4 * j]).hexdigest() for i, j in zip(starts, ends, strict=True)]
                same = np.array([np.array_equal(data[p:q], back[x:y]) for p, q, x, y in zip(offsets[:-1].tolist(), offsets[1:].tolist(), at[:-1].tolist(), at[1:].tolist(), strict=True)], bool)
                fallback = np.concatenate([[0], np.cumsum(is_byte[ids])])
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(a, b - a), pa.array(np.diff(first)), pa.array(fallback[first[1:]] - fallback[first[:-1]]), pa.array(digest, pa.string()), pa.array(same)],
                    names=["doc_id", "n_pieces", "n_byte_pieces", "ids_sha256", "round_trip"],
                )

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_pieces long, n_byte_pieces long, ids_sha256 string, round_trip boolean")
