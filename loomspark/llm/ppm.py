"""Language-model scores by prediction by partial matching (PPM) over bytes, beside a smoothed word model.

Training counts every byte after each of its contexts of up to ``ORDER`` bytes, in all training texts, and every context
is kept. The trie is a table for each length, as large as the corpus makes it; nobody gathers it.

A byte's probability comes from the longest context before it that training saw. With count c of n there, q distinct bytes seen, it
is c / (n + q) for a byte seen, and the escape q / (n + q) goes to the next shorter context, where the bytes already
seen are excluded: what is left there is scaled to 1 (method C, Moffat 1990, with exclusion). Below the empty
context all 256 values are equal. 0xFE, which UTF-8 never has, stands before a text and 0xFF after it.

A byte seen in a context was seen in the next shorter one too, where it has c' / (n' + q'). So what exclusion leaves is
(n' + q' - the sum of c' over the bytes seen) / (n' + q'), and each gram's probability follows from those of the shorter
grams by one join a length. Grams of held-out texts are in the tables with count 0. A text's score is the sum over its grams:
those that make up at least 1/``FREQUENT_GRAMS`` of the positions are broadcast, the others are joined.

The word model needs the count of every word, which grows with the corpus. Words that make up at least 1/``FREQUENT``
of the tokens are at most FREQUENT, so they are broadcast; the others are joined, and as each of them is rare no key is hot.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .scratch import Scratch
from .textkernels import U64, slices, word_hashes
from .training import remainder

ORDER = 5
FREQUENT = 1 << 20
FREQUENT_GRAMS = 1 << 21
ALPHA = 0.1
_START, _END = 0xFE, 0xFF
_WORD, _GRAM, _TEXT, _HELD = 0, 1, 2, 3
#: Keys that a task gathers before it sums them, and passes them on if half of them are distinct.
_GATHERED = 1 << 21
#: Bytes of texts that are counted or scored together, about.
SLICE = 1 << 20


def _laid(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Texts with ORDER start bytes before and one end byte after each; the places to predict; the first of each text."""
    n, extra = len(offsets) - 1, ORDER + 1
    size = np.diff(offsets)
    row = np.repeat(np.arange(n), size)
    out = np.full(len(data) + n * extra, _START, np.uint8)
    out[np.arange(len(data)) + row * extra + ORDER] = data
    ends = offsets[1:] + np.arange(1, n + 1) * extra - 1
    out[ends] = _END
    places = np.arange(len(data) + n) + np.repeat(np.arange(1, n + 1) * ORDER, size + 1)
    return out, places, offsets[:-1] + np.arange(n)


def _summed(keys: np.ndarray, counts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys and the sums of their counts."""
    if counts is None:
        keys = np.sort(keys)
        counts = np.ones(len(keys), np.int64)
    else:
        order = np.argsort(keys)
        keys, counts = keys[order], counts[order]
    if not len(keys):
        return keys, counts
    new = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
    return keys[new], np.add.reduceat(counts, new)


def grams(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Each byte to predict with its ORDER bytes before it, as one number whose lowest byte is the one to predict."""
    laid, places, _ = _laid(data, offsets)
    out = np.zeros(len(places), U64)
    for k in range(ORDER, -1, -1):
        out = out << U64(8) | laid[places - k]
    return out


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """kind, key, n: a task's counts of words (_WORD), of grams (_GRAM) and of texts (_TEXT) to learn from, and of held-out grams (_HELD)."""
    held: dict[int, list] = {k: [] for k in (_WORD, _GRAM, _HELD)}
    texts = 0

    def summed(kind: int) -> int:
        """Sum what is held of a kind; the number of its distinct keys."""
        held[kind] = [_summed(*(np.concatenate(x) for x in zip(*held[kind], strict=True)))] if held[kind] else []
        return len(held[kind][0][0]) if held[kind] else 0

    def passed(kind: int) -> pa.RecordBatch:
        summed(kind)
        keys, counts = held[kind][0] if held[kind] else (np.zeros(0, U64), np.zeros(0, np.int64))
        held[kind] = []
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(keys), kind, np.int32)), pa.array(keys.view(np.int64)), pa.array(counts)], names=["kind", "key", "n"])

    for batch in batches:
        learnt = ~batch.column("held_out").to_numpy(zero_copy_only=False).astype(bool)
        texts += int(learnt.sum())
        for a, b, data, offsets in slices(batch.column("text"), SLICE):
            with np.errstate(over="ignore"):
                words, _, _, first = word_hashes(data, offsets)
            keys, by_byte = grams(data, offsets), np.repeat(learnt[a:b], np.diff(offsets) + 1)
            new = {_WORD: _summed(words[np.repeat(learnt[a:b], np.diff(first))]), _GRAM: _summed(keys[by_byte]), _HELD: _summed(keys[~by_byte])}
            for kind, counted in new.items():
                held[kind].append(counted)
                if sum(len(x) for x, _ in held[kind]) > _GATHERED and summed(kind) > _GATHERED // 2:
                    yield passed(kind)
    for kind in held:
        yield passed(kind)
    yield pa.RecordBatch.from_arrays([pa.array([_TEXT], pa.int32()), pa.array([0], pa.int64()), pa.array([texts], pa.int64())], names=["kind", "key", "n"])


def train(docs: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame, int]:
    """(counts of keys by kind, (key, log, times) of every gram, number of texts to learn from) of all rows of docs (text, held_out).

    log is the log10 probability of the gram's last byte after the others, and times how often the gram occurs, held out or not.
    """
    counts = scratch.write(docs.select(F.coalesce("text", F.lit("")).alias("text"), "held_out").mapInArrow(_counted, "kind int, key long, n long").groupBy("kind", "key").agg(F.sum("n").alias("n")), "counts")
    texts = int(counts.where(F.col("kind") == _TEXT).agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0])
    every = counts.where(F.col("kind").isin(_GRAM, _HELD)).groupBy("key")
    tables = [scratch.write(every.agg(F.sum(F.when(F.col("kind") == _GRAM, F.col("n")).otherwise(0)).alias("n"), F.sum("n").alias("times")), "level")]
    for k in range(ORDER - 1, -1, -1):
        level = tables[0].groupBy(F.col("key").bitwiseAND(F.lit((1 << 8 * (k + 1)) - 1)).alias("key")).agg(F.sum("n").alias("n"), F.sum("times").alias("times"))
        tables.insert(0, scratch.write(level, "level"))
    below = None
    for k, table in enumerate(tables):
        if below is None:
            x = table.withColumn("n_below", F.lit(1)).withColumn("whole_below", F.lit(256)).withColumn("log_below", F.lit(float(-np.log10(256))))
        else:
            shorter = below.select(F.col("key").alias("suffix"), F.col("n").alias("n_below"), F.col("whole").alias("whole_below"), F.col("log").alias("log_below"))
            x = table.withColumn("suffix", F.col("key").bitwiseAND(F.lit((1 << 8 * k) - 1))).join(shorter, "suffix")
        # A context is followed by 256 different bytes at most.
        context, seen = Window.partitionBy("context"), F.col("n") > 0
        x = x.withColumn("context", F.shiftright("key", 8)).select(
            "*", F.sum("n").over(context).alias("m"), F.sum(seen.cast("int")).over(context).alias("q"), F.sum(F.when(seen, F.col("n_below")).otherwise(0)).over(context).alias("excluded")
        )
        kept = F.col("m") > 0
        x = x.withColumn("escape", F.when(F.col("q") < 256, F.col("q")).otherwise(0)).withColumn("whole", F.col("m") + F.col("escape"))
        escaped = F.log10(F.col("escape") / F.col("whole")) + F.log10(F.col("whole_below") / (F.col("whole_below") - F.col("excluded"))) + F.col("log_below")
        log = F.when(kept & seen, F.log10(F.col("n") / F.col("whole"))).when(kept, escaped).otherwise(F.col("log_below"))
        now = scratch.write(x.select("key", "n", "times", "whole", log.alias("log")), "chances")
        scratch.drop(table, *([below] if below is not None else []))
        below = now
    return counts, below.select("key", "log", "times"), texts


def _pairs(keys: np.ndarray, of: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct pairs of a key and its text, by text, and how often each occurs."""
    order = np.lexsort((keys, of))
    keys, of = keys[order], of[order]
    new = np.flatnonzero(np.append(True, (keys[1:] != keys[:-1]) | (of[1:] != of[:-1]))) if len(keys) else np.zeros(0, int)
    return keys[new], of[new], np.diff(np.append(new, len(keys)))


def _gram_scores(data: np.ndarray, offsets: np.ndarray, known: np.ndarray, logs: np.ndarray) -> tuple[np.ndarray, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """The sums of the known grams' logs for each text, and the pairs of the other grams and their texts."""
    keys, owner = grams(data, offsets), np.repeat(np.arange(len(offsets) - 1), np.diff(offsets) + 1)
    order = np.argsort(keys)
    keys, owner = keys[order], owner[order]
    new = np.append(True, keys[1:] != keys[:-1])[: len(keys)]
    distinct, which = keys[new], np.cumsum(new) - 1
    at = np.minimum(np.searchsorted(known, distinct), max(0, len(known) - 1))
    hit = known[at] == distinct if len(known) else np.zeros(len(distinct), bool)
    value = np.where(hit, logs[at], 0.0) if len(known) else np.zeros(len(distinct))
    cold = ~hit[which]
    return np.bincount(owner, weights=value[which], minlength=len(offsets) - 1), _pairs(keys[cold], owner[cold])


def _sorted(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """The keys of (key, value), in order, and their values."""
    keys = table["key"].to_numpy().astype(np.int64).view(U64)
    order = np.argsort(keys)
    return keys[order], table.column(1).to_numpy().astype(np.float64)[order]


def score(docs: DataFrame, *, folds: int = 10, held_out: int = 0) -> DataFrame:
    """Score all whole texts with models learnt from those whose crc32(doc_id as text) modulo ``folds`` isn't ``held_out``.

    Returns one row per row of docs: doc_id, held_out, n_tokens (words and one end), n_known (tokens seen in training),
    train_tokens, base_score (log10 probability under the word model with additive smoothing) and score (log10
    probability of the text's bytes and its end under PPM).
    Defined cases: a null text is empty, and has one token; a null doc_id is in fold 0; repeated rows count and are scored as
    often as they occur; without training texts all words are unknown and all bytes equally likely; an empty table gives
    an empty one; other columns are left aside.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark)
    doc_id = F.col("doc_id").cast("long")
    rows = docs.select(doc_id.alias("doc_id"), (remainder(doc_id, folds) == held_out).alias("held_out"), F.coalesce("text", F.lit("")).alias("text"))
    counts, chances, texts = train(rows, scratch)

    words = counts.where(F.col("kind") == _WORD).select("key", "n")
    tokens, distinct = words.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    tokens, distinct = int(tokens) + texts, int(distinct) + (texts > 0)
    places = int(chances.agg(F.coalesce(F.sum("times"), F.lit(0))).first()[0])
    # Frequent words are at most FREQUENT and frequent grams at most FREQUENT_GRAMS by their definition, whatever the corpus.
    frequent = _sorted(words.where(F.col("n") * FREQUENT >= max(1, tokens)).toArrow())
    frequent_grams = _sorted(chances.where(F.col("times") * FREQUENT_GRAMS >= max(1, places)).select("key", "log").toArrow())
    whole = np.log10(tokens + ALPHA * (distinct + 1))
    shared = spark.sparkContext.broadcast((frequent, frequent_grams))
    unknown, end = np.log10(ALPHA) - whole, np.log10(texts + ALPHA) - whole

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row for each text (_TEXT), and one for each of its distinct words (_WORD) and grams (_GRAM) that isn't frequent."""
        (known, times), (known_grams, gram_logs) = shared.value
        logs = np.log10(times + ALPHA) - whole
        number = TaskContext.get().partitionId() << 40
        for batch in batches:
            for a, b, data, offsets in slices(batch.column("text"), SLICE):
                with np.errstate(over="ignore"):
                    hashes, _, _, first = word_hashes(data, offsets)
                n = b - a
                owner = np.repeat(np.arange(n), np.diff(first))
                at = np.minimum(np.searchsorted(known, hashes), max(0, len(known) - 1))
                hit = known[at] == hashes if len(known) else np.zeros(len(hashes), bool)
                value = np.bincount(owner[hit], weights=logs[at[hit]], minlength=n)
                n_known = np.bincount(owner[hit], minlength=n) + (texts > 0)
                rest, of, times_in = _pairs(hashes[~hit], owner[~hit])
                base = value + unknown * np.bincount(of, weights=times_in, minlength=n) + end
                score, (gram, of_gram, gram_times) = _gram_scores(data, offsets, known_grams, gram_logs)
                ids, none = number + np.arange(n), len(rest) + len(gram)
                number += n
                wide = lambda x: pa.concat_arrays([x, pa.nulls(none, x.type)])
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.concatenate([ids, ids[of], ids[of_gram]])),
                        pa.array(np.repeat(np.array([_TEXT, _WORD, _GRAM], np.int32), [n, len(rest), len(gram)])),
                        pa.concat_arrays([pa.nulls(n, pa.int64()), pa.array(rest.view(np.int64)), pa.array(gram.view(np.int64))]),
                        pa.array(np.concatenate([np.zeros(n, np.int64), times_in, gram_times])),
                        wide(batch.column("doc_id").slice(a, n)),
                        wide(batch.column("held_out").slice(a, n)),
                        wide(pa.array(np.diff(first) + 1, pa.int64())),
                        wide(pa.array(n_known, pa.int64())),
                        wide(pa.array(base)),
                        wide(pa.array(score)),
                    ],
                    names=["row", "kind", "key", "times", "doc_id", "held_out", "n_tokens", "n_known", "base", "score"],
                )

    scored = scratch.write(rows.mapInArrow(run, "row long, kind int, key long, times long, doc_id long, held_out boolean, n_tokens long, n_known long, base double, score double"), "scored")
    # A rare word adds what knowing its count is worth over not knowing it, a rare gram its whole probability.
    rare = words.where(F.col("n") * FREQUENT < max(1, tokens)).select(F.lit(_WORD).alias("kind"), "key", (F.log10(F.col("n") + ALPHA) - float(np.log10(ALPHA))).alias("adds"))
    rare = rare.unionByName(chances.where(F.col("times") * FREQUENT_GRAMS < max(1, places)).select(F.lit(_GRAM).alias("kind"), "key", F.col("log").alias("adds")))
    of_kind = lambda kind, x: F.sum(F.when(F.col("kind") == kind, x))
    adds = F.col("times") * F.col("adds")
    found = scored.where(F.col("kind") != _TEXT).select("row", "kind", "key", "times").join(rare, ["kind", "key"])
    found = found.groupBy("row").agg(of_kind(_WORD, adds).alias("gain"), of_kind(_WORD, F.col("times")).alias("more"), of_kind(_GRAM, adds).alias("rest"))
    texts_only = scored.where(F.col("kind") == _TEXT).drop("kind", "key", "times")
    out = texts_only.join(found, "row", "left")
    return out.select(
        "doc_id", "held_out", "n_tokens", (F.col("n_known") + F.coalesce("more", F.lit(0))).alias("n_known"), F.lit(tokens).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("gain", F.lit(0.0))).alias("base_score"), (F.col("score") + F.coalesce("rest", F.lit(0.0))).alias("score"),
    )
