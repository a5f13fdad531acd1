"""Near-duplicate vectors by cross-polytope hashing with multiprobe buckets, verified by cosine.

Each vector is rotated by three rounds of random signs and a fast Hadamard transform; its hash is the axis, with sign,
that it then lies nearest to (Andoni et al., 2015). A table's key joins ROTATIONS such hashes; besides its own bucket a
vector enters the PROBES next best ones, those whose axis costs the least. Vectors that share a bucket of any of
TABLES tables are candidates; each candidate pair is verified by the cosine of the whole vectors in double precision.

Equal vectors are one class with a multiplicity, so a group of copies is one row. Buckets are worked through as sorted
streams; a bucket of more than BLOCK vectors is dealt out as pairs of blocks of half that size, so no task ever holds more, and
all its pairs are still compared. Tasks give counts and spanning links, never lists of pairs: a pair that meets in
several buckets counts in the first of them only, which both sides' keys tell.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import connected_components
from .scratch import Scratch
from .textkernels import U64, mix, seeds

TABLES, ROTATIONS, PROBES = 10, 2, 1
#: Vectors of one bucket that a task compares at once.
BLOCK = 1024
_KEYS = TABLES * (1 + PROBES)


def hadamard(x: np.ndarray) -> np.ndarray:
    """Fast Walsh-Hadamard transform of rows whose length is a power of two."""
    n, d = x.shape
    h = 1
    while h < d:
        y = x.reshape(n, d // (2 * h), 2, h)
        x = np.stack([y[:, :, 0] + y[:, :, 1], y[:, :, 0] - y[:, :, 1]], 2).reshape(n, d)
        h *= 2
    return x


def bucket_keys(vectors: np.ndarray, salt: np.ndarray) -> np.ndarray:
    """Keys n x (TABLES * (1 + PROBES)) of unit vectors: for each table the own bucket, then the probed ones. salt: a hash of what must be equal besides."""
    n, d = vectors.shape
    width = max(2, 1 << (d - 1).bit_length())
    padded = np.zeros((n, width))
    padded[:, :d] = vectors
    out = np.empty((n, TABLES, 1 + PROBES), U64)
    for t in range(TABLES):
        own, costs, swaps = [], [], []
        for k in range(ROTATIONS):
            x = padded
            for r in range(3):
                signs = np.where(seeds(width, 100 + r + 3 * (k + ROTATIONS * t)) >> U64(63), 1.0, -1.0)
                x = hadamard(x * signs)
            size = np.abs(x)
            axis = np.argpartition(-size, min(PROBES + 1, width - 1), axis=1)[:, : PROBES + 1]
            axis = np.take_along_axis(axis, np.argsort(-np.take_along_axis(size, axis, 1), 1, kind="stable"), 1)
            code = axis * 2 + (np.take_along_axis(x, axis, 1) < 0)
            own.append(code[:, 0])
            for j in range(1, code.shape[1]):
                costs.append(np.take_along_axis(size, axis, 1)[:, 0] - np.take_along_axis(size, axis, 1)[:, j])
                swaps.append((k, code[:, j]))
        options = [own]
        if PROBES:
            order = np.argsort(np.stack(costs, 1), 1, kind="stable")[:, :PROBES]
            place, value = np.array([k for k, _ in swaps]), np.stack([c for _, c in swaps], 1)
            for p in range(PROBES):
                chosen = order[:, p]
                options.append([np.where(place[chosen] == k, value[np.arange(n), chosen], own[k]) for k in range(ROTATIONS)])
        with np.errstate(over="ignore"):
            for p, option in enumerate(options):
                h = salt + U64(t + 1)
                for code in option:
                    h = mix(h * U64(0x100000001B3) + code.astype(U64))
                out[:, t, p] = h
    return out.reshape(n, _KEYS)


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """node, row of the class, label hash, times, embedding -> node, row, times, unit vector (doubles), keys."""
    for batch in batches:
        lists = batch.column("embedding")
        sizes = np.diff(lists.offsets.to_numpy())
        flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
        first = np.cumsum(sizes) - sizes
        salt = batch.column("salt").to_numpy().view(U64)
        for d in np.unique(sizes):
            at = np.flatnonzero(sizes == d)
            for rows in np.array_split(at, -(-len(at) // 2048)):
                x = flat[first[rows][:, None] + np.arange(d)[None, :]]
                x /= np.abs(x).max(1, keepdims=True)
                unit = x / np.sqrt((x * x).sum(1, keepdims=True))
                keys = bucket_keys(unit, salt[rows])
                take = pa.array(rows)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("node").take(take), batch.column("c").take(take), batch.column("least").take(take), batch.column("times").take(take), pa.array([u.tobytes() for u in unit], pa.binary()), pa.array([k.tobytes() for k in keys], pa.binary()), pa.ListArray.from_arrays(pa.array(np.arange(0, len(rows) * _KEYS + 1, _KEYS, dtype=np.int32)), pa.array(keys.reshape(-1).view(np.int64)))],
                    names=["node", "c", "least", "times", "unit", "keys", "buckets"],
                )


def _first_meeting(a: np.ndarray, b: np.ndarray, key: np.ndarray) -> np.ndarray:
    """Whether ``key`` is the first bucket that each pair shares: the first table with a common key, and the least one there."""
    x, y = (k.reshape(-1, TABLES, 1 + PROBES) for k in (a, b))
    common = (x[:, :, :, None] == y[:, :, None, :]).any(3)
    table = common.any(2).argmax(1)
    row = np.arange(len(a))
    shared = np.where(common[row, table], x[row, table], U64(0xFFFFFFFFFFFFFFFF))
    return shared.min(1) == key


def _compare(least: float):
    def group(key: int, i: int, j: int, rows: dict[str, np.ndarray], out: list) -> None:
        node, times, unit, keys, block = (rows[c] for c in ("node", "times", "unit", "keys", "block"))
        if i == j:
            left = right = np.arange(len(node))
        else:
            left, right = np.flatnonzero(block == i), np.flatnonzero(block == j)
        cosine = np.einsum("id,jd->ij", unit[left], unit[right]) if len(left) * len(right) < 64 else unit[left] @ unit[right].T
        a, b = np.nonzero(cosine >= least - 1e-12)
        if i == j:
            a, b = a[a < b], b[a < b]
        a, b = left[a], right[b]
        if not len(a):
            return
        # The limit is taken on one and the same order of summation for every pair.
        exact = np.einsum("id,id->i", unit[a], unit[b])
        a, b = a[exact >= least], b[exact >= least]
        for p in range(0, len(a), 1 << 15):
            x, y = a[p : p + (1 << 15)], b[p : p + (1 << 15)]
            ok = _first_meeting(keys[x], keys[y], np.full(len(x), key, U64))
            x, y = x[ok], y[ok]
            n = np.bincount(x, weights=times[y], minlength=len(node)) + np.bincount(y, weights=times[x], minlength=len(node))
            hit = np.flatnonzero(n)
            # A spanning forest of the pairs, as links.
            root = np.arange(len(node))
            while len(x):
                low, high = np.minimum(root[x], root[y]), np.maximum(root[x], root[y])
                apart = low != high
                if not apart.any():
                    break
                np.minimum.at(root, high[apart], low[apart])
                while (root[root] != root).any():
                    root = root[root]
            out.append((node[hit], n[hit].astype(np.int64), node[root[hit]]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows sorted by (bucket, i, j) -> node, links that it has there, and a node of its component there."""
        held: list[pa.RecordBatch] = []

        def worked(table: pa.Table) -> Iterator[pa.RecordBatch]:
            if not table.num_rows:
                return
            bucket, i, j = (table[c].to_numpy() for c in ("bucket", "i", "j"))
            cut = np.flatnonzero(np.append(True, (bucket[1:] != bucket[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])))
            node, times, block = (table[c].to_numpy() for c in ("node", "times", "block"))
            units, keys = table["unit"].to_pylist(), np.frombuffer(b"".join(table["keys"].to_pylist()), U64).reshape(-1, _KEYS)
            out: list = []
            for a, b in zip(cut.tolist(), [*cut[1:].tolist(), table.num_rows], strict=True):
                if b - a > 1:
                    unit = np.frombuffer(b"".join(units[a:b])).reshape(b - a, -1)
                    group(bucket[a : a + 1].view(U64)[0], int(i[a]), int(j[a]), {"node": node[a:b], "times": times[a:b], "unit": unit, "keys": keys[a:b], "block": block[a:b]}, out)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out, strict=True)], names=["node", "n", "other"])

        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            table = pa.Table.from_batches(held)
            bucket, i, j = (table[c].to_numpy() for c in ("bucket", "i", "j"))
            last = np.flatnonzero((bucket != bucket[-1]) | (i != i[-1]) | (j != j[-1]))
            whole = int(last[-1]) + 1 if len(last) else 0
            if whole:
                yield from worked(table.slice(0, whole))
                held = table.slice(whole).combine_chunks().to_batches()
        if held:
            yield from worked(pa.Table.from_batches(held))

    return run


def near_duplicate_vectors(vectors: DataFrame, *, least: float = 0.93) -> DataFrame:
    """Links between vectors of one label whose cosine is ``least`` or more, and their components.

    vectors: vec_id long, embedding array of floats or doubles, label. Returns one row per row of vectors: vec_id, n_links (other
    vectors linked directly), component_id (the least vec_id reachable by links) and kept (vec_id = component_id).

    Defined cases: vectors that are null, empty, all 0 or hold null, NaN or infinite components, and those with a null label,
    link with nothing; so do two vectors of different length. Equal vectors always link. Rows are vectors of their own, also those that share a
    vec_id: a repeated row counts as another vector, and different vectors under one vec_id link, and are reached, by their own cosines only. A null vec_id has n_links 0 and component_id and kept null; an empty table gives an empty one; other
    columns are left aside.
    """
    scratch = Scratch(vectors.sparkSession)
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding", "label")
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    usable = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.coalesce(finite & F.exists("embedding", lambda x: x != 0), F.lit(False))
    rows = rows.withColumn("c", F.when(usable, F.sha2(F.concat_ws("|", F.col("label").cast("string"), F.hex(F.xxhash64("embedding", "label")), F.hex(F.xxhash64("label", "embedding"))), 256)))
    classes = rows.where("c is not null").groupBy("c").agg(F.min("vec_id").alias("least"), F.count("*").alias("times"), F.first("embedding").alias("embedding"), F.first("label").alias("label"))
    # A class is named by a number of its own, as a vec_id may stand for several vectors; it is written with it, so it stays.
    salted = classes.select(F.monotonically_increasing_id().alias("node"), "c", "least", "times", "embedding", F.xxhash64("label", F.size("embedding")).alias("salt"))
    hashed = scratch.write(salted.mapInArrow(_hashed, "node long, c string, least long, times long, unit binary, keys binary, buckets array<long>"), "hashed")

    # Buckets of two classes or more, large ones dealt out as pairs of blocks.
    keys = hashed.select("node", F.explode(F.array_distinct("buckets")).alias("bucket"))
    sizes = keys.groupBy("bucket").agg(F.count("*").alias("m")).where("m > 1")
    blocks = F.when(F.col("m") <= BLOCK, 1).otherwise(F.ceil(F.col("m") / (BLOCK // 2))).cast("int")
    met = keys.join(sizes, "bucket").withColumn("g", blocks).withColumn("block", F.pmod(F.xxhash64("node"), F.col("g")).cast("int"))
    met = met.withColumn("x", F.explode(F.sequence(F.lit(0), F.col("g") - 1))).select("bucket", "node", "block", F.least("block", "x").alias("i"), F.greatest("block", "x").alias("j"))
    dealt = met.join(hashed.select("node", "times", "unit", "keys"), "node").repartition("bucket", "i", "j").sortWithinPartitions("bucket", "i", "j")
    found = scratch.write(dealt.select("bucket", "i", "j", "block", "node", "times", "unit", "keys").mapInArrow(_compare(least), "node long, n long, other long"), "found")

    linked = found.groupBy("node").agg(F.sum("n").alias("n"))
    components = connected_components(found.where("node != other").select(F.col("node").alias("u"), F.col("other").alias("v")).distinct(), scratch)
    of_class = hashed.select("c", "node", "least", "times").join(linked, "node", "left").join(components, "node", "left").withColumn("component", F.coalesce("component", "node"))
    of_class = scratch.write(of_class, "classes")
    least = of_class.groupBy("component").agg(F.min("least").alias("reached"))
    out = rows.select("vec_id", "c").join(of_class.join(least, "component").select("c", "times", "n", "reached"), "c", "left")
    component = F.coalesce("reached", "vec_id")
    links = F.when(F.col("c").isNull(), 0).otherwise(F.coalesce("n", F.lit(0)) + F.col("times") - 1).cast("long")
    return out.select("vec_id", links.alias("n_links"), component.alias("component_id"), (F.col("vec_id") == component).alias("kept"))
