"""Hard negatives by a two-dimensional block matrix product over the cluster.

Scores are inner products of integer vectors, so the scores of all anchors against all rows are one matrix product, which is
worked through as tiles of ANCHORS anchors by ROWS rows. Rows and dimensions are both sharded: a panel holds a block of rows and DIMENSIONS of
their components. Panels meet by an equi-join on (anchor block, row block, dimension chunk); each meeting gives a partial tile of exact
integers; the shuffle brings the partial tiles of one (anchor block, row block) together, where they are added in 64 bits and
reduced to the few best for each anchor. Vectors of one chunk give whole tiles, which are reduced where they are made. So a task holds a tile, whatever the
numbers of rows, anchors, labels or dimensions are.

Positives come first: their tiles hold one shard of labels only, so that rows of other labels hardly meet. The positives'
scores are the windows that the tiles of all rows are then reduced by.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .integers import finite, scaled
from .scratch import Scratch

#: Anchors and rows of a tile, and dimensions of a panel.
ANCHORS, ROWS, DIMENSIONS = 256, 1024, 64
#: Counts of shards that are broadcast.
SENT = 1 << 16
_LEAST = np.iinfo(np.int64).min
_TILE = "shard long, width int, i int, j int, chunk int, anchors array<bigint>, own array<bigint>, nodes array<bigint>, ids array<bigint>, labels array<bigint>, windows array<array<bigint>>, tile binary"


def _narrow(x: np.ndarray) -> bytes:
    """Integers in as few bytes as hold them all: one byte with the size, then the values."""
    most = int(max(-x.min(), x.max())) if x.size else 0
    kind = np.int16 if most < 1 << 15 else np.int32 if most < 1 << 31 else np.int64
    return bytes([np.dtype(kind).itemsize]) + x.astype(kind).tobytes()


def _wide(raw: bytes) -> np.ndarray:
    return np.frombuffer(raw, {2: np.int16, 4: np.int32, 8: np.int64}[raw[0]], offset=1).astype(np.int64)


def _product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a @ b.T in exact integers; in double precision where no sum of products can reach 2**53."""
    if float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * a.shape[1] < 2.0**53:
        return (a.astype(np.float64) @ b.T.astype(np.float64)).astype(np.int64)
    return a @ b.T


def _listed(values: pa.Array | None) -> pa.ListArray:
    """One list of all values, or one null."""
    return pa.array([None], pa.list_(pa.int64())) if values is None else pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)


def _panel_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, dict, dict, np.ndarray]]:
    """Each pair of panels that met: (its row, the columns of either side, the product of their components)."""
    for batch in batches:
        for n in range(batch.num_rows):
            row = batch.slice(n, 1)
            left, right = ({c.name: v for c, v in zip(side.type, side.flatten())} for side in (row.column("left").flatten(), row.column("right").flatten()))
            a, b = (side["part"].flatten().to_numpy(zero_copy_only=False).reshape(len(side["part"]), -1) for side in (left, right))
            yield row, left, right, _product(a, b)


def _partial_tiles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs of panels -> partial tiles. What names a tile's rows and columns goes with the first chunk only."""
    for row, left, right, tile in _panel_pairs(batches):
        first = row.column("chunk")[0].as_py() == 0
        named = [_listed(values if first else None) for values in (left["node"], left["label"], right["node"], right["id"], right["label"])]
        windows = pa.ListArray.from_arrays(pa.array([0, len(left["windows"])], pa.int32()), left["windows"]) if first else pa.array([None], pa.list_(left["windows"].type))
        keys = [row.column(c) for c in ("shard", "width", "i", "j", "chunk")]
        yield pa.RecordBatch.from_arrays([*keys, *named, windows, pa.array([_narrow(tile)], pa.binary())], names=[f.split()[0] for f in _TILE.split(", ")])


def _by_id(tile: np.ndarray, named: dict) -> tuple[np.ndarray, dict]:
    """A whole tile with its columns in order of id, and what names its rows and columns."""
    own = {c: np.array(named[c], np.int64) for c in ("anchors", "own")}
    columns = {c: np.array(named[c], np.int64) for c in ("nodes", "ids", "labels")}
    order = np.argsort(columns["ids"], kind="stable")
    return tile.reshape(len(own["anchors"]), len(order))[:, order], own | {"windows": named["windows"]} | {c: x[order] for c, x in columns.items()}


def _summed(table: pa.Table) -> tuple[np.ndarray, dict]:
    """The whole tile of the partial tiles of one (anchor block, row block)."""
    tile = sum((_wide(t.as_py()) for t in table["tile"]), np.int64(0))
    return _by_id(tile, next(r for r in table.drop_columns(["tile"]).to_pylist() if r["chunk"] == 0))


def _of_one_chunk(reduce):
    """Pairs of panels that hold all dimensions -> what their tiles are reduced to."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, left, right, tile in _panel_pairs(batches):
            named = {"anchors": left["node"], "own": left["label"], "windows": left["windows"].to_pylist(), "nodes": right["node"], "ids": right["id"], "labels": right["label"]}
            yield from reduce(*_by_id(tile, named)).to_batches()

    return run


def _best(tile: np.ndarray, allowed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(columns by falling score, ties by column; scores in that order), those not allowed at the end as the least integer."""
    order = np.argsort(np.where(allowed, -tile, np.iinfo(np.int64).max), axis=1, kind="stable")
    return order, np.take_along_axis(np.where(allowed, tile, _LEAST), order, 1)


def _positives(most: int):
    def reduce(tile: np.ndarray, at: dict) -> pa.Table:
        """The tile of one (anchor block, row block) -> each anchor's ``most`` best rows of its label there."""
        order, scores = _best(tile, (at["own"][:, None] == at["labels"]) & (at["anchors"][:, None] != at["nodes"]))
        row, rank = np.nonzero(scores[:, :most] != _LEAST)
        found = order[row, rank]
        return pa.table({"anchor": at["anchors"][row], "id": at["ids"][found], "score": scores[row, rank]})

    return reduce


def _negatives(most: int):
    def reduce(tile: np.ndarray, at: dict) -> pa.Table:
        """The tile of one (anchor block, row block) -> the ``most`` best rows of other labels within each window of each anchor."""
        order, scores = _best(tile, at["own"][:, None] != at["labels"])
        out = []
        for rank in range(max((len(w) for w in at["windows"]), default=0)):
            has = np.array([n for n, w in enumerate(at["windows"]) if len(w) > rank])
            p = np.array([at["windows"][n][rank] for n in has], np.int64)
            # 50 p <= 100 s <= 95 p, without products that could leave 64 bits.
            low, high = -(-p // 2), p // 20 * 19 + p % 20 * 19 // 20
            start = ((scores[has] > high[:, None]) & (scores[has] != _LEAST)).sum(1)
            for step in range(most):
                column = start + step
                inside = column < scores.shape[1]
                column = np.minimum(column, scores.shape[1] - 1)
                score = scores[has, column]
                ok = np.flatnonzero(inside & (score != _LEAST) & (score >= low) & (score <= high))
                out.append((at["anchors"][has[ok]], np.full(len(ok), rank + 1, np.int32), at["ids"][order[has[ok], column[ok]]], score[ok]))
        columns = [np.concatenate(c) for c in zip(*out, strict=True)] if out else [np.zeros(0, np.int64), np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64)]
        return pa.table(dict(zip(("anchor", "positive_rank", "id", "score"), columns, strict=True)))

    return reduce


def _panels(rows: DataFrame, own: str, other: str, name: str, *extra: str) -> DataFrame:
    """Blocks of rows in chunks of their dimensions, members in one order in all chunks, each once for every block of the other side."""
    chunked = rows.withColumn("chunk", F.explode(F.sequence(F.lit(0), F.ceil(F.col("width") / DIMENSIONS).cast("int") - 1)))
    member = F.struct("node", "id", "label", F.slice("ints", F.col("chunk") * DIMENSIONS + 1, F.lit(DIMENSIONS)).alias("part"), *extra)
    packed = chunked.groupBy("shard", "width", "block", "others", "chunk").agg(F.sort_array(F.collect_list(member)).alias(name))
    return packed.withColumn(other, F.explode(F.sequence(F.lit(0), F.col("others") - 1))).select("shard", "width", F.col("block").alias(own), other, "chunk", name)


def _reduced(scratch: Scratch, anchors: DataFrame, rows: DataFrame, reduce, schema: str) -> DataFrame:
    """What ``reduce`` makes of the tiles of all anchors by all rows of the same shard and width. The blocks of a side are numbered by its count in the shard, so none is much larger than ANCHORS or ROWS.

    The counts are a row for each ROWS rows about; up to SENT of them are broadcast, so that rows aren't shuffled by shard, of which one may hold a third of them.
    Panels are much larger than what Spark takes them for, as each is there once for every block of the other side, so the hint keeps them from being broadcast.
    """
    n, m = (side.groupBy("shard", "width").agg(F.count("*").alias(c)) for side, c in ((anchors, "n"), (rows, "m")))
    blocks = n.join(m, ["shard", "width"]).select("shard", "width", F.ceil(F.col("n") / ANCHORS).cast("int").alias("ni"), F.ceil(F.col("m") / ROWS).cast("int").alias("nj"))
    blocks = scratch.write(blocks, "blocks")
    wide = not blocks.where(F.col("width") > DIMENSIONS).isEmpty()
    blocks = F.broadcast(blocks) if blocks.count() <= SENT else blocks

    def numbered(side: DataFrame, own: str, others: str) -> DataFrame:
        return side.join(blocks.select("shard", "width", F.col(own).alias("count"), F.col(others).alias("others")), ["shard", "width"]).withColumn("block", F.pmod(F.xxhash64("node", F.lit(3)), "count").cast("int"))

    left = _panels(numbered(anchors, "ni", "nj"), "i", "j", "left", "windows")
    right = _panels(numbered(rows, "nj", "ni"), "j", "i", "right")
    met = left.hint("merge").join(right, ["shard", "width", "i", "j", "chunk"])
    whole = met.where(F.col("width") <= DIMENSIONS).mapInArrow(_of_one_chunk(reduce), schema)
    if not wide:
        return whole
    partial = met.where(F.col("width") > DIMENSIONS).mapInArrow(_partial_tiles, _TILE)
    return whole.unionByName(partial.groupBy("shard", "width", "i", "j").applyInArrow(lambda table: reduce(*_summed(table)), schema))


def hard_negatives(vectors: DataFrame, *, scale: int = 256, every: int = 50, positives: int = 5, negatives: int = 3) -> DataFrame:
    """For each anchor (a row whose vec_id is divisible by ``every``) and each of its ``positives`` best rows of the same label, the ``negatives`` best rows of
    other labels whose score is from 0.50 to 0.95 of the positive's.

    vectors: vec_id long, embedding array of floats or doubles, label. Components become floor(scale * x); a score is the exact inner product; higher
    scores come first, ties by smaller vec_id. Returns anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    Defined cases: rows with a null vec_id or label, a null or empty vector, or any null, NaN or infinite component take no part; vectors of different size don't
    meet; rows that share a vec_id are rows of their own, and an anchor may have such a row as its positive; a positive without a negative in its
    window, as all with a score below 0, gives no row; an empty table gives an empty one; components too large for exact 64-bit scores raise
    an error; other columns are left aside.
    """
    scratch = Scratch(vectors.sparkSession)
    usable = vectors.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & finite("embedding") & (F.size("embedding") > 0))
    rows = usable.select(F.monotonically_increasing_id().alias("node"), F.col("vec_id").cast("long").alias("id"), F.col("label").cast("long").alias("label"), scaled("embedding", scale).alias("ints"), F.size("embedding").alias("width"))
    rows = scratch.write(rows, "rows")
    labels = max(1, -(-rows.count() // ROWS))
    anchors = rows.where(F.col("id") % every == 0)

    shard = F.pmod(F.xxhash64("label", F.lit(5)), F.lit(labels)).cast("long")
    no_windows = F.array().cast("array<bigint>").alias("windows")
    found = _reduced(scratch, anchors.withColumn("shard", shard).withColumn("windows", no_windows), rows.withColumn("shard", shard), _positives(positives), "anchor long, id long, score long")
    chosen = scratch.write(_ranked(found, ["anchor"], positives).groupBy("anchor").agg(F.sort_array(F.collect_list(F.struct("rank", "id", "score"))).alias("positives")), "positives")

    windowed = anchors.join(chosen, anchors.node == chosen.anchor).select(*anchors.columns, F.lit(0).cast("long").alias("shard"), F.col("positives.score").alias("windows"))
    found = _reduced(scratch, windowed, rows.withColumn("shard", F.lit(0).cast("long")), _negatives(negatives), "anchor long, positive_rank int, id long, score long")
    best = _ranked(found, ["anchor", "positive_rank"], negatives)
    named = chosen.join(anchors.select(F.col("node").alias("anchor"), F.col("id").alias("anchor_id")), "anchor").select("anchor", "anchor_id", F.explode("positives").alias("p"))
    named = named.select("anchor", "anchor_id", F.col("p.rank").alias("positive_rank"), F.col("p.id").alias("positive_id"), F.col("p.score").alias("positive_score"))
    return named.join(best, ["anchor", "positive_rank"]).select("anchor_id", "positive_id", "rank", F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


def _ranked(found: DataFrame, keys: list[str], most: int) -> DataFrame:
    """The ``most`` best of each key, with rank; Spark keeps that many of each task before it shuffles."""
    order = Window.partitionBy(*keys).orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most)
