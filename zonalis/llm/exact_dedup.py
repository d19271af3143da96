"""Exact deduplication with a log-structured digest index, in DataFrame operations only.

Documents come in batches. A batch is a memtable: it is merged to one entry per digest and flushed as a run, sorted by
digest within hash buckets and with a Parquet Bloom filter. The flushed run is probed against the earlier runs; since all
runs have the same buckets, neither this nor compaction shuffles the index. Compaction merges the runs to one entry per
digest, which keeps one identifier. Hits, which the probes report, are compared byte by byte with the kept row.
"""

from __future__ import annotations

import functools
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from zonalis.llm.shared import ascii_lower, join_groups, keeps_columns, keyed, partitions, remove_folder, scratch, written

#: So many rows of one group are compared with one copy of the kept text by one task.
ROWS_A_SALT = 512
#: exact_dedup deals its tasks' shares of the documents into so many batches.
BATCHES = 4
#: A run of at most so many digests is looked up by Bloom filters and statistics instead of a join.
FEW = 256
RUN = "digest string, keep_id long, group_size long, run int"


def normal(text: str = "text") -> Column:
    """Equal for equal texts."""
    return ascii_lower(F.coalesce(text, F.lit("")))


class DigestIndex:
    """Runs of (digest, keep_id, group_size) in one table, bucketed by digest. keep: "largest" or "smallest" identifier of equal texts."""

    def __init__(self, spark: SparkSession, keep: str = "largest"):
        if keep not in ("largest", "smallest"):
            raise ValueError(f"keep must be largest or smallest, not {keep!r}")
        self.spark, self.runs, self.table, self.path = spark, 0, "", ""
        self.best = F.max if keep == "largest" else F.min
        self._renew()

    def _renew(self) -> None:
        self.table, self.path = f"zonalis_digests_{uuid.uuid4().hex}", scratch(self.spark, "digests")

    def _flush(self, entries: DataFrame) -> None:
        writer = entries.withColumn("run", F.lit(self.runs)).write.mode("append").format("parquet").option("path", self.path)
        writer = writer.option("parquet.bloom.filter.enabled#digest", "true").option("parquet.bloom.filter.expected.ndv#digest", "100000")
        writer.bucketBy(partitions(self.spark), "digest").sortBy("digest").saveAsTable(self.table)
        self.runs += 1

    def add(self, batch: DataFrame) -> DataFrame:
        """Flushes a batch of (doc_id, digest) as a run. Returns its hits: digests that it has twice or that an earlier run has.

        An empty batch is an empty run. Partial counts keep a hot digest small before the shuffle.
        """
        own = self.runs
        self._flush(batch.groupBy("digest").agg(self.best("doc_id").cast("long").alias("keep_id"), F.count(F.lit(1)).alias("group_size")))
        run = self.spark.table(self.table).where(F.col("run") == own)
        hits = run.where("group_size > 1").select("digest")
        if own:
            hits = hits.union(self.probe(run, own)).distinct()
        return written(hits, "hits")

    def probe(self, digests: DataFrame, before: int | None = None) -> DataFrame:
        """Those of the column digest, each once, that an earlier run has: before this run, or all runs."""
        earlier = self.spark.table(self.table).where(F.col("run") < (self.runs if before is None else before)).select("digest")
        few = [r[0] for r in digests.select("digest").limit(FEW + 1).collect()]
        if len(few) <= FEW:
            return earlier.where(F.col("digest").isin(few)).distinct()
        return digests.select("digest").join(earlier, "digest", "left_semi").distinct()

    def compact(self) -> DataFrame:
        """Merges all runs to one, which takes their place: (digest, keep_id, group_size). Without any run: none."""
        if not self.runs:
            return self.spark.createDataFrame([], RUN).drop("run")
        old_table, old_path = self.table, self.path
        merged = self.spark.table(old_table).groupBy("digest").agg(self.best("keep_id").alias("keep_id"), F.sum("group_size").alias("group_size"))
        self._renew()
        self.runs = 0
        self._flush(merged)
        self.spark.sql(f"DROP TABLE {old_table}")
        remove_folder(self.spark, old_path)
        return self.spark.read.schema(RUN).parquet(self.path).drop("run")

    def close(self) -> None:
        """Takes the table out of the catalogue; its files stay for results that read them."""
        self.spark.sql(f"DROP TABLE IF EXISTS {self.table}")


def verified(docs: DataFrame, hits: DataFrame) -> int:
    """How many hits' bytes differ from the bytes of the row that stays. A large group is split over salts."""
    texts = keyed(docs.select("doc_id", normal().alias("norm")), F.col("norm"))
    hits = hits.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("__id"), F.col("digest").alias("__digest"), "keep_id", "group_size").distinct()
    texts = written(texts.join(hits, ["__id", "__digest"]), "hit-texts")
    salts = F.ceil(F.col("group_size") / ROWS_A_SALT).cast("int")
    kept = texts.where("doc_id <=> keep_id").dropDuplicates(["__digest"]).select("__digest", F.explode(F.sequence(F.lit(0), salts - 1)).alias("salt"), F.col("norm").alias("kept_norm"))
    others = texts.withColumn("salt", F.pmod(F.monotonically_increasing_id(), salts).cast("int"))
    return others.join(kept, ["__digest", "salt"]).where("norm <> kept_norm").count()


def exact_dedup(docs: DataFrame, keep: str = "largest") -> DataFrame:
    """One row per row of docs: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after lower-casing A-Z; null counts as empty. Repeated rows with one doc_id count
    each in group_size, and all of them are kept if that id is. A null doc_id never wins over another one. Columns
    other than doc_id and text are ignored. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    rows = written(docs.select("doc_id", F.sha2(normal(), 256).alias("digest"), F.pmod(F.spark_partition_id(), F.lit(BATCHES)).alias("batch")), "entries")
    index = DigestIndex(spark, keep)
    found = [index.add(rows.where(F.col("batch") == k)) for k in range(BATCHES)]
    merged = index.compact()
    index.close()
    rows = rows.drop("batch")
    hits = join_groups(rows, merged.join(functools.reduce(DataFrame.union, found).distinct(), "digest", "left_semi"), "digest", "group_size")
    if bad := verified(docs, hits):
        raise RuntimeError(f"{bad} texts have the digest of another text")
    return join_groups(rows, merged, "digest", "group_size").select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), F.col("digest").alias("text_sha256"))


@keeps_columns
def keep_one(docs: DataFrame) -> DataFrame:
    """docs with one row of each different text: the one that exact_dedup keeps.

    Rows without doc_id stay if no row with one has their text, and different texts of one doc_id all stay. Of repeated rows one
    stays; null text counts as empty; an empty table gives an empty result. Columns of any name are kept. A text is in memory whole.
    """
    stay = exact_dedup(docs).where("kept").select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("__id"), F.col("text_sha256").alias("__digest")).distinct()
    return keyed(docs, normal()).dropDuplicates(["__id", "__digest"]).join(stay, ["__id", "__digest"], "left_semi").select(*docs.columns)
