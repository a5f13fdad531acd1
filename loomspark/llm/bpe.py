"""Byte-pair encoding and decoding of whole texts with a vocabulary file of the tokenizers library.

A word is held as three contiguous arrays: the boundaries of its parts, the parts' ids, and the rank of each pair of
neighbours. The least rank is looked for by a scan, its boundary deleted and the two ranks beside it looked up anew,
until no pair has a rank. That is quickest for the short words that texts consist of; a word of more than SHORT bytes
goes through a heap of the same ranks instead, as the scans would cost the square of its length.

No word reaches across white space, and neither normalisation nor lower case does, so a text is a sequence of runs
without white space, each encoded on its own. A task remembers the ids of short runs that it has met, a bounded number of them.
"""

from __future__ import annotations

import json
import unicodedata
from array import array
from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bytes of the words that the rank array is used for.
SHORT = 96
#: Runs that a task remembers, and their greatest length.
REMEMBERED, RUN = 1 << 18, 48
#: Bytes of text that go through the arrays at once.
SLICE = 1 << 22
_NONE = 1 << 62
#: White space to Python that is none to the tokenizer.
_SEPARATORS = regex.compile("[\x1c-\x1f]")
_RUNS = regex.compile(r"[^\s]+")
#: Ranges that came after Unicode 16, whose tables the tokenizer has: letters and numbers to newer tables, neither to it. Fixed values.
_YOUNG = [
    (0x558, 0x558), (0x58B, 0x58C), (0x88F, 0x88F), (0xC5C, 0xC5C), (0xCDC, 0xCDC), (0x208F, 0x208F), (0x209D, 0x209F), (0xA7CE, 0xA7CF), (0xA7D2, 0xA7D2), (0xA7D4, 0xA7D4), (0xA7DD, 0xA7DD),
    (0xA7E2, 0xA7E2), (0xA7F1, 0xA7F1), (0xAB6C, 0xAB6D), (0x107BB, 0x107BF), (0x10940, 0x10959), (0x10EC5, 0x10EC7), (0x10ED9, 0x10EEE), (0x11B0A, 0x11B0A), (0x11DB0, 0x11DDB),
    (0x11DF1, 0x11DF1), (0x16EA0, 0x16EB8), (0x16EBB, 0x16ED3), (0x16FF2, 0x16FF3), (0x187F8, 0x187FF), (0x18CD6, 0x18CDA), (0x18D09, 0x18D20), (0x18D80, 0x18DF2), (0x18E00, 0x19191),
    (0x191A0, 0x191D2), (0x1B123, 0x1B128), (0x1B168, 0x1B168), (0x1D6A6, 0x1D6A6), (0x1DF1F, 0x1DF24), (0x1DF2B, 0x1DF81), (0x1DF90, 0x1DF96), (0x1DFCD, 0x1DFFF), (0x1E6C0, 0x1E6DE),
    (0x1E6E0, 0x1E6E2), (0x1E6E4, 0x1E6E5), (0x1E6E7, 0x1E6ED), (0x1E6F0, 0x1E6F4), (0x1E6FE, 0x1E6FF), (0x2B73A, 0x2B73F), (0x2B81E, 0x2B81E), (0x2CEA2, 0x2CEAD), (0x323B0, 0x33479),
    (0x3D000, 0x3FC3F),
]
#: Pairs of first and last capital and the distance to the small letter, of letters that Unicode 16 and 17 have added. Fixed values.
_NEW_CAPITALS = [(0x1C89, 0x1C89, 1), (0xA7CB, 0xA7CB, 0x264 - 0xA7CB), (0xA7CC, 0xA7CC, 1), (0xA7CE, 0xA7CE, 1), (0xA7D2, 0xA7D2, 1), (0xA7D4, 0xA7D4, 1), (0xA7DA, 0xA7DA, 1), (0xA7DC, 0xA7DC, 0x19B - 0xA7DC), (0x10D50, 0x10D65, 0x20), (0x16EA0, 0x16EB8, 0x1B)]
#: What is lowered beside Python's rules: the new capitals, and final sigma as any other.
_LOWER = {c: chr(c + by) for first, last, by in _NEW_CAPITALS for c in range(first, last + 1)} | {0x3A3: "σ"}
_LOWERED_APART = regex.compile("[" + "".join(map(chr, _LOWER)) + "]")


def _byte_letters() -> list[str]:
    """The letter that stands for each byte in byte-level vocabularies: itself if printable in Latin-1, else the next from U+0100 on."""
    shown = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    hidden = [b for b in range(256) if b not in shown]
    return [chr(b) if b in shown else chr(0x100 + hidden.index(b)) for b in range(256)]


#: The pattern that cuts texts into words. Fixed value.
_WORDS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


def _word_pattern() -> regex.Pattern:
    """_WORDS with the tables of Unicode 16."""
    young = "".join(f"{chr(a)}-{chr(b)}" for a, b in _YOUNG)
    letter, number = rf"[\p{{L}}--[{young}]]", rf"[\p{{N}}--[{young}]]"
    return regex.compile(rf"(?V1)'s|'t|'re|'ve|'m|'ll|'d|{letter}+|{number}|[[^\s\p{{L}}\p{{N}}]||[{young}]]+")


class Vocabulary:
    """What encoding and decoding need of a vocabulary file; its size is that of the vocabulary."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, kinds = spec["model"], [n["type"] for n in (spec.get("normalizer") or {}).get("normalizers", [])]
        split, *after = (spec.get("pre_tokenizer") or {}).get("pretokenizers", [{}])
        plain = model["type"] == "BPE" and not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "fuse_unk", "byte_fallback", "ignore_merges"))
        words = split.get("type") == "Split" and split.get("behavior") == "Removed" and split.get("invert") and [a["type"] for a in after] == ["ByteLevel"] and not (after[0]["use_regex"] or after[0]["add_prefix_space"])
        if not plain or not words or kinds != ["NFC", "Replace", "Lowercase"] or spec["normalizer"]["normalizers"][1] != {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "} or spec.get("decoder"):
            raise ValueError(f"{path}: only lower-case byte-level BPE over words without white space is supported")
        if any(t["normalized"] or t["lstrip"] or t["rstrip"] or t["single_word"] for t in spec["added_tokens"]):
            raise ValueError(f"{path}: added tokens must be matched as they stand")
        if split["pattern"]["Regex"] != _WORDS:
            raise ValueError(f"{path}: words are cut by another pattern")
        vocab: dict[str, int] = model["vocab"]
        end = model.get("end_of_word_suffix") or ""
        letters = _byte_letters()
        self.inner = [vocab.get(c, -1) for c in letters]
        self.last = [vocab.get(c + end, -1) for c in letters]
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        self.merges = {vocab[a] << 32 | vocab[b]: (rank, vocab[a + b]) for rank, (a, b) in enumerate(pairs)}
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.tokens: list[str | None] = [None] * (1 + max([*vocab.values(), *self.added.values()]))
        for token, i in (vocab | self.added).items():
            self.tokens[i] = token


def merge_by_rank_array(ids: list[int], merges: dict[int, tuple[int, int]]) -> list[int]:
    """The parts that are left of ``ids``: contiguous boundaries, ids and ranks, scanned for the least rank, the leftmost first."""
    bounds = list(range(len(ids) + 1))
    parts = list(ids)
    ranks = [merges.get(a << 32 | b, (_NONE,))[0] for a, b in zip(parts, parts[1:])]
    while ranks:
        least = min(ranks)
        if least == _NONE:
            break
        i = ranks.index(least)
        parts[i] = merges[parts[i] << 32 | parts[i + 1]][1]
        del bounds[i + 1], parts[i + 1], ranks[i]
        if i:
            ranks[i - 1] = merges.get(parts[i - 1] << 32 | parts[i], (_NONE,))[0]
        if i < len(ranks):
            ranks[i] = merges.get(parts[i] << 32 | parts[i + 1], (_NONE,))[0]
    return parts


def merge_by_heap(ids: list[int], merges: dict[int, tuple[int, int]]) -> list[int]:
    """The same parts for long words: pairs wait in a heap by rank and place, neighbours are linked."""
    n, parts = len(ids), list(ids)
    after, before, whole = list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n
    waiting = [(m[0], i, parts[i], parts[i + 1]) for i in range(n - 1) if (m := merges.get(parts[i] << 32 | parts[i + 1]))]
    heapify(waiting)
    while waiting:
        _, i, a, b = heappop(waiting)
        j = after[i] if whole[i] else n
        if j >= n or parts[i] != a or parts[j] != b:
            continue
        parts[i], whole[j], after[i] = merges[a << 32 | b][1], False, after[j]
        if after[i] < n:
            before[after[i]] = i
        for x, y in ((before[i], i), (i, after[i])):
            if x >= 0 and y < n and (m := merges.get(parts[x] << 32 | parts[y])):
                heappush(waiting, (m[0], x, parts[x], parts[y]))
    return [p for p, w in zip(parts, whole) if w]


class _Remembered(dict):
    """String -> ids as little-endian 32-bit numbers, the last few it was asked for: what one full generation held is looked up before it is made anew."""

    def __init__(self) -> None:
        self.before: dict[str, bytes] = {}

    def __missing__(self, text: str) -> bytes:
        ids = self.before.get(text)
        if ids is None:
            ids = self.made(text)
        if len(text) <= RUN:
            if len(self) >= REMEMBERED:
                self.before = dict(self)
                self.clear()
            self[text] = ids
        return ids

    def made(self, text: str) -> bytes:
        raise NotImplementedError


class _Words(_Remembered):
    def __init__(self, vocabulary: Vocabulary) -> None:
        super().__init__()
        self.inner, self.last, self.merges = vocabulary.inner, vocabulary.last, vocabulary.merges

    def made(self, text: str) -> bytes:
        raw = text.encode()
        ids = [self.inner[b] for b in raw[:-1]] + [self.last[raw[-1]]]
        if -1 in ids:
            ids = [i for i in ids if i >= 0]
        return array("I", merge_by_rank_array(ids, self.merges) if len(ids) <= SHORT else merge_by_heap(ids, self.merges)).tobytes()


class _Runs(_Remembered):
    """Runs without white space, each of some words."""

    def __init__(self, vocabulary: Vocabulary) -> None:
        super().__init__()
        self.pattern, self.words = _word_pattern(), _Words(vocabulary)

    def made(self, text: str) -> bytes:
        text = unicodedata.normalize("NFC", text)
        if _LOWERED_APART.search(text):
            text = text.translate(_LOWER)
        return b"".join(map(self.words.__getitem__, self.pattern.findall(text.lower())))


class Encoder:
    """Ids of texts; holds what it remembers, so one for each task."""

    def __init__(self, vocabulary: Vocabulary) -> None:
        self.added = {token: array("I", [i]).tobytes() for token, i in vocabulary.added.items()}
        longest_first = sorted(self.added, key=len, reverse=True)
        self.cut = regex.compile("(" + "|".join(map(regex.escape, longest_first)) + ")") if longest_first else None
        self.runs = _Runs(vocabulary)

    def __call__(self, text: str) -> bytes:
        """The ids of a text as little-endian 32-bit numbers. Added tokens are found as they stand before anything else."""
        pieces = self.cut.split(text) if self.cut and self.cut.search(text) else [text]
        out = []
        for n, piece in enumerate(pieces):
            if n % 2:
                out.append(self.added[piece])
            else:
                runs = _RUNS.findall(piece) if _SEPARATORS.search(piece) else piece.split()
                out.append(b"".join(map(self.runs.__getitem__, runs)))
        return b"".join(out)


def _decoded(ids: np.ndarray, first: np.ndarray, tokens: pa.Array) -> pa.Array:
    """The tokens of each list of ids, joined by blanks; ids that stand for nothing give nothing."""
    known = (ids >= 0) & (ids < len(tokens))
    known[known] = tokens.is_valid().to_numpy(zero_copy_only=False)[ids[known]]
    first = np.concatenate([[0], np.cumsum(known)])[first]
    return pc.binary_join(pa.LargeListArray.from_arrays(pa.array(first.astype(np.int64)), tokens.take(pa.array(ids[known]))), " ")


def _sliced(batch: pa.RecordBatch, column: str, width: int) -> Iterator[pa.RecordBatch]:
    """The batch in slices whose column holds about ``width`` bytes."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    group = np.cumsum(sizes) // width
    cuts = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), batch.num_rows]
    for a, b in zip(cuts, cuts[1:]):
        if b > a:
            yield batch.slice(a, b - a)


def encode_and_back(docs: DataFrame, path: str) -> DataFrame:
    """One row per row of docs: doc_id, ids (binary: little-endian unsigned 32-bit numbers) and decoded (string: the tokens that the ids stand for, joined by blanks).

    path: the vocabulary file, which the driver reads. Defined cases: null and empty texts, and those of white space only, have no ids and an
    empty decoded text; the strings of added tokens are those tokens; texts are never cut, a long word costs n log n; a
    null doc_id stays null, repeated rows give their rows again, an empty table gives an empty one; other columns are left aside.
    """
    shared = docs.sparkSession.sparkContext.broadcast(Vocabulary(path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, tokens = Encoder(shared.value), pa.array(shared.value.tokens, pa.string())
        for batch in batches:
            for part in _sliced(batch, "text", SLICE):
                ids = [encoder(text or "") for text in part.column("text").to_pylist()]
                first = np.concatenate([[0], np.cumsum([len(i) // 4 for i in ids])])
                decoded = _decoded(np.frombuffer(b"".join(ids), "<u4").astype(np.int64), first, tokens)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(ids, pa.binary()), decoded], names=["doc_id", "ids", "decoded"])

    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, ids binary, decoded string")


def encode(docs: DataFrame, path: str) -> DataFrame:
    """docs with ids array<int>; all columns of docs stay, one named ids is replaced. Defined cases as in encode_and_back."""
    shared = docs.sparkSession.sparkContext.broadcast(Vocabulary(path))
    others = [c for c in docs.columns if c != "ids"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(shared.value)
        for batch in batches:
            for part in _sliced(batch, "text", SLICE):
                ids = [encoder(text or "") for text in part.column("text").to_pylist()]
                first = np.concatenate([[0], np.cumsum([len(i) // 4 for i in ids])]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(first), pa.array(np.frombuffer(b"".join(ids), "<i4")))
                yield pa.RecordBatch.from_arrays([part.column("row"), lists], names=["row", "ids"])

    rows = docs.select(F.struct(*others).alias("row"), F.col("text").cast("string").alias("text"))
    schema = docs.select(*others).schema.simpleString()
    return rows.mapInArrow(run, f"row {schema}, ids array<int>").select(*(F.col(f"row.`{c}`") for c in others), "ids")


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """encoded with decoded string: the tokens of its ids, joined by blanks. Null lists and lists without ids give an empty text; null ids and ids outside the vocabulary give nothing."""
    shared = encoded.sparkSession.sparkContext.broadcast(Vocabulary(path))
    others = [c for c in encoded.columns if c != "decoded"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = pa.array(shared.value.tokens, pa.string())
        for batch in batches:
            lists = batch.column("ids")
            first = lists.offsets.to_numpy().astype(np.int64)
            ids = pc.fill_null(lists.flatten(), -1).to_numpy(zero_copy_only=False).astype(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("row"), _decoded(ids, first - first[0], tokens)], names=["row", "decoded"])

    rows = encoded.select(F.struct(*others).alias("row"), F.coalesce(F.col("ids").cast("array<long>"), F.array().cast("array<long>")).alias("ids"))
    schema = encoded.select(*others).schema.simpleString()
    return rows.mapInArrow(run, f"row {schema}, decoded string").select(*(F.col(f"row.`{c}`") for c in others), "decoded")


def token_digests(docs: DataFrame, path: str) -> DataFrame:
    """One row per row of docs: doc_id, n_tokens, ids_sha256 (of the little-endian ids) and decoded_sha256, from the ids and texts of encode_and_back."""
    made = encode_and_back(docs, path)
    return made.select(F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.encode("decoded", "UTF-8"), 256).alias("decoded_sha256"))
