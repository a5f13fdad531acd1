"""A keyword index that grows with what changes: immutable segments, removals beside them, and merging by tiers.

Adding chunks writes one segment of their postings. Removing or replacing chunks writes which chunks of which segment are gone, and by how much
that lowers the document frequencies of their terms. All statistics are sums over segments less removals, so scores are those of an index built anew
from what is left. Nothing that is written is ever changed; a commit is one small table, the manifest, that names the live parts, and readers take the latest whole one.

When MERGE segments are of one tier (each tier MERGE times as large as the one below), they become one segment, without the chunks that
are gone: each posting is rewritten once a tier at most, so the bytes written grow with the change times the logarithm of the whole.

Below the index's folder: ``chunks``, ``postings`` and ``frequency``, each by segment; ``removed`` (chunks) and ``lowered`` (frequencies), each by removal and
segment; ``manifest`` by version.
"""

from __future__ import annotations

import math
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..steps import Steps
from .retrieval import BUCKETS, Index, _counted, _languages, _listed, _tallied

#: Segments of a tier that are merged, and terms of the smallest tier.
MERGE, LEAST_TERMS = 8, 1 << 16
#: Terms from which a segment's postings are dealt into buckets; smaller ones are a file or a few, in order of terms.
DEALT = 1 << 20
_MANIFEST = "kind string, name string, segment string, n long, terms long, languages array<string>"


class SegmentedIndex:
    """chunks: chunk_id, the content column and any others, the same in all additions."""

    def __init__(self, spark: SparkSession, path: str, *, content: str = "content", heading: str | None = None, language: str | None = None) -> None:
        self.spark, self.path = spark, path.rstrip("/")
        self.options = {"content": content, "heading": heading, "language": language}

    # The manifest

    def _folder(self, name: str):
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), path

    def version(self) -> int:
        """The latest whole version; 0 if there is none."""
        files, path = self._folder("manifest")
        if not files.exists(path):
            return 0
        names = [s.getPath() for s in files.listStatus(path)]
        return max((int(p.getName()) for p in names if files.exists(p.suffix("/_SUCCESS"))), default=0)

    def _manifest(self) -> tuple[int, list]:
        version = self.version()
        return version, self.spark.read.schema(_MANIFEST).parquet(f"{self.path}/manifest/{version}").collect() if version else []

    def _commit(self, version: int, rows: list) -> None:
        """The next version. Of two writers that started from one version the second fails, and nothing of its is live."""
        self.spark.createDataFrame([tuple(r) for r in rows], _MANIFEST).coalesce(1).write.parquet(f"{self.path}/manifest/{version + 1}")

    # Parts

    def _read(self, table: str, key: str, names: list[str]) -> DataFrame:
        """A table's parts by name, with the name as column ``key``."""
        found = self.spark.read.option("basePath", f"{self.path}/{table}").parquet(*(f"{self.path}/{table}/{key}={n}" for n in sorted(set(names))))
        return found.withColumn(key, F.col(key).cast("string"))

    def _gone(self, rows: list, segments: list[str]) -> DataFrame | None:
        """(segment, chunk_id) of what was removed from segments."""
        removals = [r for r in rows if r.kind == "removal" and r.segment in segments]
        return self._read("removed", "removal", [r.name for r in removals]).where(F.col("segment").isin(sorted(segments))).select(F.col("segment").cast("string").alias("segment"), "chunk_id") if removals else None

    def _live(self, table: str, rows: list, segments: list[str]) -> DataFrame:
        found, gone = self._read(table, "segment", segments), self._gone(rows, segments)
        return found if gone is None else found.join(gone, ["segment", "chunk_id"], "left_anti")

    def _write_segment(self, name: str, chunks: DataFrame, postings: DataFrame, frequency: DataFrame) -> tuple:
        chunks.write.parquet(f"{self.path}/chunks/segment={name}")
        n, terms = self._read("chunks", "segment", [name]).where("token_count > 0").agg(F.count("*"), F.coalesce(F.sum("token_count"), F.lit(0))).first()
        dealt = F.pmod(F.xxhash64("term"), F.lit(BUCKETS)).cast("int") if terms >= DEALT else F.lit(-1)
        ordered = postings.withColumn("bucket", dealt).hint("rebalance", "bucket").sortWithinPartitions("bucket", "term")
        ordered.write.partitionBy("bucket").parquet(f"{self.path}/postings/segment={name}")
        frequency.sortWithinPartitions("term").write.parquet(f"{self.path}/frequency/segment={name}")
        return n, terms

    def _removal(self, rows: list, ids: DataFrame) -> list[tuple]:
        """Write the removal of live chunks with these ids; its rows of the manifest, one for each segment that loses some."""
        segments = [r.name for r in rows if r.kind == "segment"]
        if not segments:
            return []
        name, steps = uuid.uuid4().hex, Steps(self.spark)
        hit = steps.write(self._live("chunks", rows, segments).join(ids.select("chunk_id").distinct(), "chunk_id", "left_semi"))
        by = hit.groupBy("segment").agg(F.count(F.when(F.col("token_count") > 0, 1)).alias("n"), F.sum("token_count").alias("terms")).collect()
        if by:
            hit.select("segment", "chunk_id").write.partitionBy("segment").parquet(f"{self.path}/removed/removal={name}")
            # The content is there, so the terms that go are counted from it; the postings of the index aren't read.
            counted = _counted(hit.withColumn("chunk_id", F.struct("segment", "chunk_id")), **self.options)
            lowered = counted.groupBy(F.col("chunk_id.segment").alias("segment"), "term").agg((-F.count("*")).alias("df"))
            lowered.write.partitionBy("segment").parquet(f"{self.path}/lowered/removal={name}")
        steps.drop(hit)
        return [("removal", name, r.segment, r.n, r.terms, []) for r in by]

    # Changes

    def add(self, chunks: DataFrame) -> None:
        """Add chunks; those whose chunk_id is there already are replaced. One commit, after which larger tiers may be merged.

        Defined cases: an addition with one chunk_id twice, or a null one, is an error; chunks without terms are kept, but count for no statistics; an empty
        addition changes nothing.
        """
        version, rows = self._manifest()
        steps, name = Steps(self.spark), uuid.uuid4().hex
        new = steps.write(_tallied(chunks, **self.options))  # texts are read and counted once
        total, distinct = new.agg(F.count("*"), F.count_distinct("chunk_id")).first()
        if total != distinct:
            raise ValueError("each chunk_id must be there once in an addition")
        if not total:
            return
        counted = _listed(new)
        removal = self._removal(rows, new)
        n, terms = self._write_segment(name, new.drop("loom_terms"), counted, counted.groupBy("term").agg(F.count("*").alias("df")))
        languages = list(_languages(new, self.options["language"]))
        self._commit(version, [*rows, *removal, ("segment", name, name, n, terms, languages)])
        steps.drop(new)
        self.merge()

    def remove(self, ids: DataFrame) -> None:
        """Remove the chunks with these chunk_ids; ids that aren't there are no matter."""
        version, rows = self._manifest()
        if removal := self._removal(rows, ids):
            self._commit(version, [*rows, *removal])

    def merge(self) -> bool:
        """Merge the segments of each tier that has MERGE of them; whether there were any."""
        version, rows = self._manifest()
        left = {r.name: r.terms for r in rows if r.kind == "segment"}
        for r in rows:
            if r.kind == "removal":
                left[r.segment] -= r.terms
        tiers: dict[int, list[str]] = {}
        for name, terms in left.items():
            tiers.setdefault(max(0, math.ceil(math.log(max(terms, 1) / LEAST_TERMS, MERGE))), []).append(name)
        full = [names for names in tiers.values() if len(names) >= MERGE]
        for names in full:
            rows = self._merged(rows, names)
        if full:
            self._commit(version, rows)
        return bool(full)

    def _merged(self, rows: list, names: list[str]) -> list:
        name = uuid.uuid4().hex
        postings = self._live("postings", rows, names).drop("segment", "bucket")
        frequency = self._frequency(rows, names).groupBy("term").agg(F.sum("df").alias("df")).where("df > 0")
        n, terms = self._write_segment(name, self._live("chunks", rows, names).drop("segment"), postings, frequency)
        languages = sorted({x for r in rows if r.kind == "segment" and r.name in names for x in r.languages})
        return [*(r for r in rows if r.segment not in names), ("segment", name, name, n, terms, languages)]

    def _frequency(self, rows: list, segments: list[str]) -> DataFrame:
        """(term, df): of the segments, and what removals lower them by."""
        found = self._read("frequency", "segment", segments).select("term", "df")
        removals = [r.name for r in rows if r.kind == "removal" and r.segment in segments]
        if removals:
            lowered = self._read("lowered", "removal", removals).where(F.col("segment").isin(sorted(segments)))
            found = found.unionByName(lowered.select("term", "df"))
        return found

    # Reading

    def read(self) -> Index | None:
        """The index as ``retrieval`` searches it; None before the first addition. A search reads postings and frequencies of its terms only."""
        _, rows = self._manifest()
        segments = [r.name for r in rows if r.kind == "segment"]
        if not segments:
            return None
        sign = {"segment": 1, "removal": -1}
        n, total = (sum(sign[r.kind] * r[c] for r in rows) for c in ("n", "terms"))
        frequency = self._frequency(rows, segments).groupBy("term").agg(F.sum("df").alias("df")).where("df > 0")
        postings = self._live("postings", rows, segments).join(frequency, "term").drop("segment")
        languages = sorted({x for r in rows if r.kind == "segment" for x in r.languages})
        return Index(self._live("chunks", rows, segments).drop("segment"), postings, n, total / n if n else 0.0, tuple(languages))
