"""Terms of the keyword index, as JVM expressions; only stems need Python."""

from __future__ import annotations

import functools
import re
from collections.abc import Collection, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

from .stemmer import STEMMERS, stem

# ASCII ranges come first, as classes are tried in order and properties are slow; the ranges are part of them.
_ALNUM = r"a-zA-Z0-9\p{IsAlphabetic}\p{N}"
_UNSPACED = r"\p{IsHan}\p{IsHiragana}\p{IsKatakana}\p{IsHangul}"


def _pieces(token: Column) -> Column:
    """Words of spaced scripts in lower case, and bigrams of runs of Han, Kana and Hangul (a single character as itself)."""
    segments = F.regexp_extract_all(token, F.lit(rf"([{_UNSPACED}]+|[^{_UNSPACED}]+)"), F.lit(1))

    def terms(s: Column) -> Column:
        pairs = F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.length(s) - 1)), lambda i: F.substring(s, i, F.lit(2)))
        return F.when(s.rlike(rf"^[{_UNSPACED}]"), pairs).otherwise(F.array(F.lower(s)))

    return F.flatten(F.transform(segments, terms))


def terms(text: Column) -> Column:
    """All terms of a text, unstemmed, in order.

    A run is letters and digits joined by ``- . _ / :``. Each of its parts is a term; a joined run without unspaced scripts
    is also one term without its punctuation, so that POL-8841 is found as such.
    """
    runs = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(rf"([{_ALNUM}]+(?:[-._/:]+[{_ALNUM}]+)*)"), F.lit(1))

    def of(run: Column) -> Column:
        parts = F.flatten(F.transform(F.split(run, r"[-._/:]+"), _pieces))
        whole = F.lower(F.regexp_replace(run, r"[-._/:]+", ""))
        joined = run.rlike(r"[-._/:]") & ~run.rlike(rf"[{_UNSPACED}]")
        # Most runs have neither joiners nor unspaced scripts; they are their own only term.
        return F.when(~run.rlike(rf"[-._/:{_UNSPACED}]"), F.array(F.lower(run))).when(joined, F.concat(parts, F.array(whole))).otherwise(parts)

    return F.flatten(F.transform(runs, of))


def cased_terms(text: Column) -> Column:
    """What ``terms`` gives, in its own case and another order, for counting: first the parts of all runs, then the joined runs. Texts without unspaced scripts or joiners take one
    expression, without a function for each word.
    """
    text = F.coalesce(text, F.lit(""))
    words = F.regexp_extract_all(text, F.lit(rf"[{_ALNUM}]++"), F.lit(0))
    # No unspaced script has characters below U+1100, and a range is looked at much faster than a script.
    parts = F.when(text.rlike(rf"[\x{{1100}}-\x{{10FFFF}}&&[{_UNSPACED}]]"), F.flatten(F.transform(words, _pieces))).otherwise(words)
    # A run is only tried where a word begins, and never with a part of the word.
    runs = F.regexp_extract_all(text, F.lit(rf"(?<![{_ALNUM}])[{_ALNUM}]++(?:[-._/:]++[{_ALNUM}]++)+"), F.lit(0))
    joined = F.transform(F.filter(runs, lambda r: ~r.rlike(f"[{_UNSPACED}]")), lambda r: F.translate(r, "-._/:", ""))
    # No joined run without a joiner before a letter or digit, and joiners are rare.
    return F.when(text.rlike(rf"[-._/:][{_ALNUM}]"), F.concat(parts, joined)).otherwise(parts)


def lowered_terms(text: Column) -> Column:
    """What ``cased_terms`` gives, in lower case. Texts of ASCII characters are put into lower case whole and looked through with single characters, which Java finds in one table."""
    text = F.coalesce(text, F.lit(""))
    low = F.lower(text)
    words = F.regexp_extract_all(low, F.lit("[abcdefghijklmnopqrstuvwxyz0123456789]+"), F.lit(0))
    runs = F.regexp_extract_all(low, F.lit("(?<![a-z0-9])[a-z0-9]++(?:[-._/:]++[a-z0-9]++)+"), F.lit(0))
    ascii_only = F.when(low.rlike("[-._/:][a-z0-9]"), F.concat(words, F.transform(runs, lambda r: F.translate(r, "-._/:", "")))).otherwise(words)
    return F.when(F.length(text) == F.octet_length(text), ascii_only).otherwise(F.transform(cased_terms(text), F.lower))


#: Bytes of texts that are looked through at once, about.
SLICE = 1 << 18
_LATIN = 0x280
_JOINERS = b"-._/:"


@functools.cache
def _tables() -> tuple[bytes, bytes, np.ndarray]:
    """Of bytes, whether they are letters or digits of ASCII and whether they are joiners; of characters below _LATIN, whether they are letters or numbers."""
    spoken = np.array([chr(i).isalnum() for i in range(_LATIN)])
    return bytes(i < 128 and bool(spoken[i]) for i in range(256)), bytes(i in _JOINERS for i in range(256)), spoken


def _marked(buf: np.ndarray, table: bytes) -> np.ndarray:
    return np.frombuffer(bytearray(buf.tobytes().translate(table)), bool)


def _latin(buf: np.ndarray, offsets: np.ndarray, word: np.ndarray) -> np.ndarray:
    """Which texts between the offsets are characters below _LATIN in good UTF-8; ``word`` gets their characters beyond ASCII."""
    high = np.flatnonzero(buf >= 0x80)
    good = np.ones(len(offsets) - 1, bool)
    if not len(high):
        return good
    byte = buf[high]
    lead, place = byte >= 0xC2, np.searchsorted(offsets, high, "right") - 1
    # Each lead has its one further byte behind it in the same text, and each further byte has a lead before it.
    pair = np.zeros(len(high), bool)
    pair[:-1] = lead[:-1] & (byte[1:] < 0xC0) & (high[1:] == high[:-1] + 1) & (place[1:] == place[:-1])
    right = pair | np.concatenate([[False], pair[:-1]])
    good[place[~right | (byte >= 0xC0 + _LATIN // 64)]] = False
    first = high[pair & good[place]]
    spoken = _tables()[2][(buf[first].astype(np.intp) & 0x1F) << 6 | buf[first + 1] & 0x3F]
    word[first] = word[first + 1] = spoken
    return good


def _scan(buf: np.ndarray, offsets: np.ndarray, wanted: Sequence[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of texts between the offsets of a buffer: which are Latin, their numbers of terms, and the text and the number in ``wanted`` of each wanted term that they hold."""
    words, joiners, _ = _tables()
    word, is_joiner = _marked(buf, words), _marked(buf, joiners)
    good = _latin(buf, offsets, word)
    inner = offsets[(offsets > 0) & (offsets < len(buf))]
    edge = np.empty(len(buf) + 1, bool)  # where one of two neighbouring bytes is in a word
    edge[0], edge[-1] = word[0], word[-1]
    np.not_equal(word[1:], word[:-1], out=edge[1:-1])
    glued = np.unique(inner[word[inner] & word[inner - 1]])  # where a text ends in a word and the next begins with one
    ends = np.flatnonzero(edge)
    if len(glued):
        ends = np.sort(np.concatenate([ends, glued, glued]))
    start, end = ends[::2], ends[1::2]
    counts = np.diff(np.searchsorted(start, offsets))
    texts, numbers = [], []
    size = end - start
    by_size: dict[int, list[tuple[int, bytes]]] = {}
    for i, w in enumerate(wanted):
        by_size.setdefault(len(w), []).append((i, w))
    for n, those in by_size.items():
        alike = start[size == n]
        for i, w in those:
            found = alike
            for k, c in enumerate(w):
                found = found[buf[found + k] | 0x20 == c]  # of words, only letters change by this
            texts.append(np.searchsorted(offsets, found, "right") - 1)
            numbers.append(np.full(len(found), i))
    # Words with joiners only between them are one more term, joined.
    near = np.flatnonzero(is_joiner[end[:-1]] & is_joiner[start[1:] - 1]) if len(start) > 1 else np.empty(0, np.intp)
    if len(near):
        gaps = np.stack([end[near], start[near + 1]], 1).ravel()
        near = near[np.add.reduceat(is_joiner, gaps, dtype=np.int64)[::2] == start[near + 1] - end[near]]
        near = near[np.searchsorted(offsets, start[near], "right") == np.searchsorted(offsets, start[near + 1], "right")]
    if len(near):
        new = np.concatenate([[True], np.diff(near) != 1])
        first, last = near[new], near[np.concatenate([new[1:], [True]])] + 1
        text = np.searchsorted(offsets, start[first], "right") - 1
        counts += np.bincount(text, minlength=len(counts))
        total = np.concatenate([[0], np.cumsum(size)])
        number = {w: i for i, w in enumerate(wanted)}
        for k in np.flatnonzero(np.isin(total[last + 1] - total[first], list(by_size))):
            joined = buf[start[first[k]] : end[last[k]]].tobytes().translate(None, _JOINERS).lower()
            if joined in number:
                texts.append(text[k : k + 1])
                numbers.append(np.array([number[joined]]))
    return good, counts, np.concatenate(texts or [np.empty(0, np.intp)]), np.concatenate(numbers or [np.empty(0, np.intp)])


def _found(texts: pa.Array, wanted: Sequence[bytes]) -> pa.Array:
    """(n, terms) of each text, null where a text isn't Latin."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
    goods, counts, keys = [], [], []
    at = 0
    while at < len(texts):
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + SLICE, "right")) - 1)
        some = offsets[at : to + 1]
        if some[-1] == some[0]:
            goods.append(np.ones(to - at, bool))
            counts.append(np.zeros(to - at, np.int64))
        else:
            good, n, text, number = _scan(data[some[0] : some[-1]], some - some[0], wanted)
            goods.append(good)
            counts.append(n)
            keys.append((text + at) * max(len(wanted), 1) + number)
        at = to
    key, tf = np.unique(np.concatenate(keys or [np.empty(0, np.int64)]), return_counts=True)
    text, number = np.divmod(key, max(len(wanted), 1))
    ends = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=len(texts)))])
    names = pa.array([w.decode() for w in wanted], pa.string())
    listed = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays([names.take(pa.array(number)), pa.array(tf, pa.int64())], names=["term", "tf"]))
    good, n = np.concatenate(goods or [np.empty(0, bool)]), np.concatenate(counts or [np.empty(0, np.int64)])
    return pa.StructArray.from_arrays([pa.array(n, pa.int64()), listed], names=["n", "terms"], mask=pa.array(~good))


def found_terms(wanted: Collection[str]):
    """A text -> (n, terms): what ``lowered_terms`` has, n of them, and [(term, tf)] of the wanted ones, which are ASCII. Null for a text with characters beyond Latin script or bad UTF-8.

    A batch of texts is looked through as bytes, without an object for each word.
    """
    asked = sorted(w.encode("ascii") for w in set(wanted))

    @F.arrow_udf("struct<n:bigint,terms:array<struct<term:string,tf:bigint>>>")
    def find(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            yield _found(texts, asked)

    return find


def ascii_terms(text: str) -> list[str]:
    """``terms`` of a text of ASCII characters, without a job."""
    out = []
    for run in re.findall(r"[A-Za-z0-9]+(?:[-._/:]+[A-Za-z0-9]+)*", text):
        parts = re.split(r"[-._/:]+", run.lower())
        out += [*parts, "".join(parts)] if len(parts) > 1 else parts
    return out


def tokens(text: Column) -> Column:
    """Tokens for windows: runs of letters and digits, and every other character that isn't white space."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(rf"([{_ALNUM}]+|[^\s{_ALNUM}])"), F.lit(1))


def _tally(words: pa.Array, languages: pa.Array, wanted: Collection[str] | None) -> pa.Array:
    """For each list of words its distinct stems with their numbers, of those in ``wanted`` where it is given."""
    sizes = pc.fill_null(pc.list_value_length(words), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    coded = words.flatten().dictionary_encode()
    codes, names = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), coded.dictionary
    known = [x if x in STEMMERS else None for x in languages.to_pylist()]
    if any(known):
        spoken = {x: i for i, x in enumerate(dict.fromkeys(known))}
        codes += np.repeat([spoken[x] for x in known], sizes) * len(names)
        there = np.zeros(len(spoken) * len(names), bool)
        there[codes] = True
        pairs, codes = np.flatnonzero(there), (np.cumsum(there) - 1)[codes]
        listed, by = names.to_pylist(), list(spoken)
        stems = pa.array([stem(listed[p % len(listed)], by[p // len(listed)]) for p in pairs.tolist()], pa.string()).dictionary_encode()
        codes, names = stems.indices.to_numpy(zero_copy_only=False).astype(np.int64)[codes], stems.dictionary
    rows = np.repeat(np.arange(len(words)), sizes)
    if wanted is not None:
        asked = pc.is_in(names, pa.array(sorted(wanted), pa.string())).to_numpy(zero_copy_only=False).astype(bool)[codes]
        rows, codes = rows[asked], codes[asked]
    found, tf = np.unique(rows * max(len(names), 1) + codes, return_counts=True)
    ends = np.cumsum(np.bincount(found // max(len(names), 1), minlength=len(words)))
    values = pa.StructArray.from_arrays([names.take(pa.array(found % max(len(names), 1))).cast(pa.string()), pa.array(tf, pa.int64())], names=["term", "tf"])
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]), pa.int32()), values)


def tallied(wanted: Collection[str] | None = None):
    """(words, language) -> the distinct stems of a list of words, each with its number: [(term, tf)]. Words of a language without a stemmer are their own stems.

    A text is counted where it is read, so no table of counts over many texts is held; of a batch each distinct word is stemmed once.
    """

    @F.arrow_udf("array<struct<term:string,tf:bigint>>")
    def tally(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for words, languages in batches:
            yield _tally(words, languages, wanted)

    return tally


def tally_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches of chunk_id, token_count, words and language as chunk_id, token_count, term, tf."""
    for chunk, token_count, words, languages in (b.columns for b in batches):
        found = _tally(words, languages, None)
        rows = pc.list_parent_indices(found)
        yield pa.RecordBatch.from_arrays([chunk.take(rows), token_count.take(rows), *found.flatten().flatten()], names=["chunk_id", "token_count", "term", "tf"])
