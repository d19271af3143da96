"""What the operators share: tables written between steps, and small column idioms."""

from __future__ import annotations

import contextlib
import functools
import gc
import time
import uuid
from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of anything but the space and the five ASCII controls from tab to carriage return.
SEPARATOR = r"[\x20\x09-\x0D]+"


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder under spark.checkpoint.dir, which driver and executors share; where that is unset, a local one for a local master only."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = "/tmp/zonalis-checkpoints"
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """Writes the rows once and reads them back: later steps start from files, not from the lineage."""
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def keyed(docs: DataFrame, text: Column | None = None) -> DataFrame:
    """docs with __id and __digest, which are never null: doc_id as a string, empty without one, and the SHA-256 of text.

    The two find a row again where doc_id is null or stands for several texts. Null text counts as empty.
    """
    text = F.coalesce("text", F.lit("")) if text is None else text
    return docs.withColumns({"__id": F.coalesce(F.col("doc_id").cast("string"), F.lit("")), "__digest": F.sha2(text, 256)})


#: Columns that functions returning whole rows add for a while.
OWN_NAMES = ("__id", "__digest", "__source", "__copies", "__copy", "__number")


def keeps_columns(function: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    """For functions that return rows of docs: columns of docs that have one of OWN_NAMES stand under another name meanwhile."""

    @functools.wraps(function)
    def run(docs: DataFrame, *args, **named) -> DataFrame:
        taken = [c for c in docs.columns if c.lower() in OWN_NAMES]
        if not taken:
            return function(docs, *args, **named)
        free = [f"__aside_{k}" for k in range(len(docs.columns) + len(taken)) if f"__aside_{k}" not in docs.columns]
        aside = dict(zip(taken, free, strict=False))
        return function(docs.withColumnsRenamed(aside), *args, **named).withColumnsRenamed({v: k for k, v in aside.items()})

    return run


def remove_folder(spark: SparkSession, path: str) -> None:
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def remove_written(df: DataFrame) -> None:
    """Removes the files of written()'s table, once no later step reads it."""
    if files := df.inputFiles():
        remove_folder(df.sparkSession, files[0].rsplit("/", 1)[0])


def drop_shuffles(spark: SparkSession) -> None:
    """Asks for the collections after which Spark deletes the shuffles of steps that are over; by themselves they may come only after the last one.

    Python's goes first: it lets go of the tables that hold them, which reaches the JVM through a thread that looks once a second.
    """
    gc.collect()
    time.sleep(1.5)
    spark._jvm.System.gc()


@contextlib.contextmanager
def dense_files(spark: SparkSession) -> Iterator[None]:
    """Tables written meanwhile take less disk and somewhat more time."""
    name = "spark.sql.parquet.compression.codec"
    before = spark.conf.get(name)
    spark.conf.set(name, "zstd")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def bucketed_copy(df: DataFrame, ids: DataFrame, name: str, key: str, buckets: int) -> tuple[DataFrame, Callable[[], None]]:
    """The rows of df whose key is in ids, one for each key, written in hash buckets of the key: later joins on it leave them in place.

    The second value removes the table and its files, once no later step reads it.
    """
    spark = df.sparkSession
    table, path = f"zonalis_{name}_{uuid.uuid4().hex}", scratch(spark, name)
    rows = df.repartition(buckets, key).join(ids, key, "left_semi").dropDuplicates([key])
    rows.write.bucketBy(buckets, key).option("path", path).format("parquet").saveAsTable(table)

    def remove() -> None:
        spark.sql(f"DROP TABLE IF EXISTS {table}")
        remove_folder(spark, path)

    return spark.table(table), remove


#: A key of more than one in so many rows is a hot one. So there are at most so many, and they can be broadcast.
HOT_KEYS = 10_000
#: Keys of no more rows than this aren't hot.
COOL_ROWS = 4096


def join_groups(rows: DataFrame, groups: DataFrame, key: str, size: str) -> DataFrame:
    """rows with the columns of groups, which has a row for each key and how many rows have it in size.

    The groups of hot keys, at most HOT_KEYS of them, are broadcast, so that no task gets all rows of such a key; the other keys
    are joined by a shuffle.
    """
    total = groups.agg(F.sum(size)).first()[0] or 0
    limit = max(COOL_ROWS, total // HOT_KEYS)
    hot = F.broadcast(groups.where(F.col(size) > limit))
    if hot.isEmpty():
        return rows.join(groups, key)
    cool = rows.join(hot.select(key), key, "left_anti").join(groups.where(F.col(size) <= limit), key)
    return rows.join(hot, key).unionByName(cool)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def narrow(df: DataFrame) -> DataFrame:
    """For shuffled rows of a few ids: a quarter of the partitions, which are sized for rows with texts."""
    return df.coalesce(max(1, partitions(df.sparkSession) // 4))


def small_batches(spark: SparkSession, rows: int = 128) -> None:
    """Whole texts go to Python in small Arrow batches, as single ones can be long."""
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > rows:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def ascii_lower(text: Column) -> Column:
    """A-Z to a-z and nothing else. lower() does that to texts of one byte a character, and is much faster."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.when(F.length(text) == F.octet_length(text), F.lower(text)).otherwise(F.translate(text, upper, upper.lower()))


def let(value: Column, body) -> Column:
    """body(value) with value computed once a row, also where body uses it within lambdas."""
    return F.element_at(F.transform(F.array(value), body), 1)


def words(text: Column) -> Column:
    """The words of a text, in order; null has none."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SEPARATOR), lambda w: w != "")
