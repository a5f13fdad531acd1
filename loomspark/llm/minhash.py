"""Near-duplicate documents by banded MinHash, odd sketches and exact verification.

1. One Arrow pass makes, for each text, the size and a 128-bit hash of its set of word shingles, BANDS keys of ROWS
   MinHash samples each, and an odd sketch: one more MinHash sample from each of BINS bins of the hash range is
   folded into a parity bitmap, where it flips the bit that its hash names (Mitzenmacher, Pagh and Pham, 2014).
   The XOR of two sketches holds only what the samples differ in, so its population count estimates high
   similarities to about 0.01, which the number of equal bands can't.
2. Texts with equal sets become one class, so a group of exact copies costs one row from here on.
3. Classes that share a band key are candidates. Candidate pairs pass the sketch test and are then confirmed
   on the full sets. Pairs aren't listed bucket by bucket: star rounds link each bucket to one centre, confirmed
   links merge components, and only members of different components meet again. The last round tests all
   pairs of a bucket across components, so nothing is lost whatever the centres were.

With 32 bands of 5 samples a pair of similarity 0.85 shares no band with probability 7e-9, one of 0.8 with 3e-6; a pair at
the limit fails the sketch test with probability 1e-4 or less.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .components import connected_components
from .scratch import Scratch
from .textkernels import U64, mix, seeds, shingle_sets, slices, word_hashes

BANDS, ROWS = 32, 5
BINS = 2048
SKETCH_LONGS = 16
SKETCH_BITS = 64 * SKETCH_LONGS
#: Standard errors that a pair of exactly the least similarity may lie beyond the expected count.
SIGMAS = 4.0
#: Star rounds before all pairs across components are tested; more rounds only save work.
STAR_ROUNDS = 3
STAR_CENTRES = 2

_SKETCH = [f"s{i}" for i in range(SKETCH_LONGS)]
_SIGNATURE = "doc_id long, n_shingles long, set_a long, set_b long, bands array<long>, " + ", ".join(f"{s} long" for s in _SKETCH)


def most_differing_bits(n: Column, m: Column, similarity: float) -> Column:
    """The XOR count that sketches of sets of n and m shingles stay within if their similarity is at least ``similarity``.

    Of the bins that the union fills, a share 1 - J differ; such a bin flips a bit for each set that has samples in
    it. Sampling adds noise only where bins hold several shingles; u flips leave n / 2 (1 - exp(-2 u / n)) ones.
    """
    union = (n + m) / (1 + similarity)
    filled = BINS * (1 - F.exp(-union / BINS))
    differing = filled * (1 - similarity)
    busy = 1 - F.exp(-(n + m) / (2 * BINS))
    flips = differing * (1 + busy)
    noise = filled * similarity * (1 - similarity) * F.greatest(F.lit(0.0), 1 - filled / union) * (1 + busy) * (1 + busy) + differing * busy * (1 - busy)
    x = 4 * flips / SKETCH_BITS
    parity = F.greatest(F.lit(0.0), SKETCH_BITS / 4 * (1 - F.exp(-x) * (1 + x)))
    # Flips meet in bits, so noise in them counts less the more there are; the two kinds of noise are independent.
    spread = F.sqrt(noise * F.exp(-x) + parity)
    return SKETCH_BITS / 2 * (1 - F.exp(-x / 2)) + SIGMAS * spread + 0.5


def signatures_of(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(set hashes n x 2, band keys n x BANDS, odd sketches n x SKETCH_LONGS) of sorted distinct shingle hashes, none of them empty."""
    flat = np.concatenate(sets)
    sizes = np.array([len(s) for s in sets])
    first = np.cumsum([0, *sizes[:-1]])
    with np.errstate(over="ignore"):
        both = np.stack([np.add.reduceat(mix(flat ^ s), first) for s in seeds(2, 11)], 1)
        bands = np.zeros((len(sets), BANDS), U64)
        for i, a in enumerate(seeds(BANDS * ROWS, 3) | U64(1)):
            bands[:, i % BANDS] = mix(bands[:, i % BANDS] + np.minimum.reduceat(flat * a, first))
        bands = mix(bands + np.arange(1, BANDS + 1, dtype=U64)[None, :])
        owner, bin_ = np.repeat(np.arange(len(sets)), sizes), (flat >> U64(64 - BINS.bit_length() + 1)).astype(np.int64)
        least = np.ones(len(flat), bool)  # sets are sorted, so the first shingle of a bin is its sample
        least[1:] = (bin_[1:] != bin_[:-1]) | (owner[1:] != owner[:-1])
        flip = owner[least] * SKETCH_BITS + (mix(flat[least] + U64(5)) % U64(SKETCH_BITS)).astype(np.int64)
    ones = (np.bincount(flip, minlength=len(sets) * SKETCH_BITS) & 1).astype(np.uint8)
    return both, bands, np.packbits(ones).view(U64).reshape(len(sets), SKETCH_LONGS)


def _signatures(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0)
            for a, b, data, offsets in slices(batch.column(1)):
                with np.errstate(over="ignore"):
                    words, _, _, first = word_hashes(data, offsets)
                    sets = list(shingle_sets(words, first, k))
                sizes = np.array([len(s) for s in sets], np.int64)
                full = np.flatnonzero(sizes)
                both, sketch = np.zeros((b - a, 2), U64), np.zeros((b - a, SKETCH_LONGS), U64)
                lists = np.zeros(b - a + 1, np.int32)
                lists[1:] = np.cumsum(np.where(sizes > 0, BANDS, 0))
                bands = np.zeros((0, BANDS), U64)
                if len(full):
                    both[full], bands, sketch[full] = signatures_of([sets[i] for i in full])
                signed = lambda x: pa.array(np.ascontiguousarray(x).view(np.int64))
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(a, b - a), pa.array(sizes), signed(both[:, 0]), signed(both[:, 1]), pa.ListArray.from_arrays(pa.array(lists), signed(bands.reshape(-1))), *(signed(sketch[:, i]) for i in range(SKETCH_LONGS))],
                    names=["doc_id", "n_shingles", "set_a", "set_b", "bands", *_SKETCH],
                )

    return run


def _sets(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, data, offsets in slices(batch.column(1)):
                with np.errstate(over="ignore"):
                    words, _, _, first = word_hashes(data, offsets)
                    sets = list(shingle_sets(words, first, k))
                ends = np.cumsum([0, *map(len, sets)]).astype(np.int32)
                flat = np.concatenate([*sets, np.zeros(0, U64)]).view(np.int64)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))], names=["doc_id", "shingles"])

    return run


def near_duplicates(docs: DataFrame, *, words: int = 5, least_percent: int = 80) -> DataFrame:
    """Components of documents whose sets of ``words``-word shingles have a Jaccard similarity of ``least_percent``/100 or more.

    docs: doc_id long, text string; other columns are left aside. Returns one row per row of docs: doc_id,
    n_shingles, component_id (the least doc_id reachable by links) and kept (doc_id = component_id).

    Defined cases: a null, empty or blank text has no shingles, links with nothing and is its own component; a text
    with fewer words than ``words`` has its whole sequence as one shingle; A-Z count as a-z; a row without a
    doc_id links with nothing and gets component_id and kept null; rows that repeat a doc_id are one node with
    the links of all of them; an empty table gives an empty one.
    """
    spark: SparkSession = docs.sparkSession
    scratch = Scratch(spark)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    signatures = scratch.write(docs.mapInArrow(_signatures(words), _SIGNATURE), "signatures")

    # Classes of equal sets, named by their least doc_id.
    full = signatures.where("n_shingles > 0 and doc_id is not null")
    classes = full.groupBy("set_a", "set_b", "n_shingles").agg(F.min("doc_id").alias("node"), F.min_by(F.struct("bands", *_SKETCH), "doc_id").alias("x"))
    classes = scratch.write(classes.select("node", "set_a", "set_b", "n_shingles", "x.*"), "classes")
    members = full.join(classes.select("set_a", "set_b", "n_shingles", "node"), ["set_a", "set_b", "n_shingles"]).select("doc_id", "node").distinct()
    same_set = members.where("doc_id != node").select(F.col("doc_id").alias("u"), F.col("node").alias("v"))

    # Buckets with two classes at least.
    keys = classes.select("node", F.posexplode("bands").alias("band", "key"))
    shared = keys.groupBy("key").agg(F.min("node").alias("least"), F.max("node").alias("most")).where("least < most").select("key")
    buckets = scratch.write(keys.join(shared, "key").select("key", "band", "node").distinct(), "buckets")
    pool = buckets.select("node").distinct()
    marks = scratch.write(classes.join(pool, "node", "left_semi").select("node", "n_shingles", "bands", *_SKETCH), "marks")
    sets = scratch.write(docs.join(pool.withColumnRenamed("node", "doc_id"), "doc_id", "left_semi").mapInArrow(_sets(words), "doc_id long, shingles array<long>"), "sets")

    links = _links(scratch, buckets, marks, sets, least_percent)
    components = connected_components(links.unionByName(same_set), scratch)
    scratch.drop(classes, buckets, marks, sets)
    nodes = signatures.select("doc_id", "n_shingles").join(components.select(F.col("node").alias("doc_id"), "component"), "doc_id", "left")
    component = F.coalesce("component", "doc_id")
    return nodes.select("doc_id", "n_shingles", component.alias("component_id"), (F.col("doc_id") == component).alias("kept"))


def without_near_duplicates(docs: DataFrame, *, words: int = 5, least_percent: int = 80) -> DataFrame:
    """docs with one document of each component, the one with the least doc_id; all columns stay.

    Defined cases: null, empty and blank texts stay, as they link with nothing; rows without a doc_id stay; of rows that repeat a doc_id and its text one
    stays, which one is open where other columns differ; an empty table gives an empty one.
    """
    gone = near_duplicates(docs, words=words, least_percent=least_percent).where("not kept").select("doc_id").distinct()
    gone = Scratch(docs.sparkSession).write(gone, "gone")
    repeated = docs.where("doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").select("doc_id")
    out = docs.join(gone, "doc_id", "left_anti")
    if not repeated.isEmpty():
        again = out.join(repeated, "doc_id", "left_semi").dropDuplicates(["doc_id", "text"])
        out = out.join(repeated, "doc_id", "left_anti").unionByName(again)
    return out.select(*docs.columns)


def _side(marks: DataFrame, side: str, *more: str) -> DataFrame:
    return marks.select(F.col("node").alias(side), *(F.col(c).alias(f"{side}_{c}") for c in ("n_shingles", *more, *_SKETCH)))


def _alike(similarity: float) -> Column:
    """Whether the sketches of u and v may belong to a pair of this similarity."""
    ones = F.bit_count(F.col("u_s0").bitwiseXOR(F.col("v_s0")))
    for s in _SKETCH[1:]:
        ones = ones + F.bit_count(F.col(f"u_{s}").bitwiseXOR(F.col(f"v_{s}")))
    return ones <= most_differing_bits(F.col("u_n_shingles"), F.col("v_n_shingles"), similarity)


def _links(scratch: Scratch, buckets: DataFrame, marks: DataFrame, sets: DataFrame, least_percent: int) -> DataFrame:
    """(u, v) confirmed links that connect all classes which any chain of links between members of the buckets connects."""
    shingles = lambda side: sets.select(F.col("doc_id").alias(side), F.col("shingles").alias(f"{side}_set"))
    found: DataFrame | None = None
    tried: DataFrame | None = None
    comps: DataFrame | None = None
    turn = 0
    while turn <= STAR_ROUNDS:
        # Members of buckets that still hold several components.
        rows = buckets.withColumn("comp", F.col("node"))
        if comps is not None:
            rows = buckets.join(comps, "node", "left").withColumn("comp", F.coalesce("component", "node")).drop("component")
            open_keys = rows.groupBy("key").agg(F.min("comp").alias("least"), F.max("comp").alias("most")).where("least < most").select("key")
            rows = rows.join(open_keys, "key", "left_semi")
        if turn < STAR_ROUNDS:
            # One centre for each bucket: the least node first, then a new pseudo-random one each round.
            order = F.col("node") if turn == 0 else F.xxhash64("node", F.lit(turn))
            centres = rows.groupBy("key").agg(F.min_by(F.struct(F.col("node").alias("u"), F.col("comp").alias("u_comp")), order).alias("c")).select("key", "c.*")
            # A node meets the centres that it shares most buckets with, so a round tests a few pairs a node.
            near = rows.join(centres, "key").where("comp != u_comp").groupBy("node", "u").agg(F.count("*").alias("shared"))
            near = near.withColumn("r", F.row_number().over(Window.partitionBy("node").orderBy(F.desc("shared"), "u"))).where(F.col("r") <= STAR_CENTRES)
            pairs = near.select(F.least("u", "node").alias("u"), F.greatest("u", "node").alias("v")).distinct()
            if tried is not None:
                pairs = pairs.join(tried, ["u", "v"], "left_anti")
            pairs = pairs.join(_side(marks, "u"), "u").join(_side(marks, "v"), "v").where(_alike(least_percent / 100)).select("u", "v")
        else:
            # Everything outside the largest component of a bucket meets every member of other components; a pair
            # is taken in the first band that it shares.
            sizes = rows.groupBy("key", "comp").agg(F.count("*").alias("n"))
            main = sizes.groupBy("key").agg(F.max_by("comp", F.struct("n", "comp")).alias("main"))
            rows = scratch.write(rows, "open")
            rest = rows.join(main, "key").where("comp != main").select("key", "band", F.col("node").alias("u"), F.col("comp").alias("u_comp")).join(_side(marks, "u", "bands"), "u")
            every = rows.select("key", F.col("node").alias("v"), F.col("comp").alias("v_comp")).join(_side(marks, "v", "bands"), "v")
            first_shared = F.array_position(F.zip_with("u_bands", "v_bands", lambda a, b: a == b), True) - 1
            pairs = rest.join(every, "key").where(F.col("u_comp") != F.col("v_comp")).where(_alike(least_percent / 100)).where(first_shared == F.col("band"))
            pairs = pairs.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct()
            if tried is not None:
                pairs = pairs.join(tried, ["u", "v"], "left_anti")
        pairs = scratch.write(pairs, "pairs")
        if pairs.isEmpty():
            if turn in (0, STAR_ROUNDS) and found is None:  # nothing alike shares a bucket's centre
                found = pairs
            if turn == STAR_ROUNDS:
                break
            turn = STAR_ROUNDS
            continue
        checked = pairs.join(shingles("u"), "u").join(shingles("v"), "v")
        both = F.size(F.array_intersect("u_set", "v_set"))
        alike = 100 * both >= least_percent * (F.size("u_set") + F.size("v_set") - both)
        good = scratch.write(checked.where(alike).select("u", "v").distinct(), "links")
        found = good if found is None else found.unionByName(good)
        tried = pairs if tried is None else tried.unionByName(pairs)
        if turn < STAR_ROUNDS:
            comps = connected_components(found, scratch)
        turn += 1
    return found
