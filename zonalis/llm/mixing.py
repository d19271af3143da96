"""Mixing sources to target weights by systematic sampling.

Targets: sources in code point order weigh 1, 2, 3, repeating, and share all words; a source gives at most three times
its size, and the excess is shared again by weight. That fixed point is a water level: sources sorted by limit over
weight reach their limit one after another, so running sums give it in one pass over the table of sources.

Sampling: within a source, document number i of expected copies r covers [u + r i, u + r (i + 1)); it is emitted once
for each integer in it, u being one offset of the source. Documents are numbered by size class, so that each class gives
its share. The numbering is a two-level prefix sum (counts of small cells, then positions within a cell), so that no
task sorts a whole source.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from zonalis.llm.shared import SEPARATOR, keeps_columns, keyed, written

#: A source's size class has 256 cells, by the first byte of doc_id's md5: what one task sorts is a part of a class.


def word_count(text: Column) -> Column:
    """Null has no words."""
    text = F.coalesce(text, F.lit(""))
    edges = F.when(text.rlike(rf"^{SEPARATOR}"), 1).otherwise(0) + F.when(text.rlike(rf"{SEPARATOR}\z"), 1).otherwise(0)
    pieces = F.size(F.split(text, SEPARATOR))
    return F.when(text.rlike(r"[^\x20\x09-\x0D]"), pieces - edges).otherwise(0).cast("long")


def size_class(size: Column) -> Column:
    """Sizes below 64 are classes of their own, others have 32 classes between powers of two."""
    octave = F.floor(F.log2(F.greatest(size, F.lit(1)).cast("double"))).cast("long") - 5
    step = F.pow(F.lit(2.0), octave.cast("double")).cast("long")
    return F.when(size < 64, size).otherwise(octave * 64 + F.floor(size / step).cast("long"))


def targets(sizes: DataFrame, limit: float = 3.0) -> DataFrame:
    """(source, source_size) to (source, source_size, target). One row per source, so one task holds them all."""
    order = W.orderBy(F.col("source").asc_nulls_last())
    weighed = sizes.withColumn("weight", ((F.row_number().over(order) - 1) % 3 + 1).cast("double"))
    room = weighed.withColumn("room", F.col("source_size") * F.lit(limit))
    by_level = W.orderBy(F.col("room") / F.col("weight"), F.col("source").asc_nulls_last())
    every = W.orderBy(F.col("room") / F.col("weight")).rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    full = by_level.rowsBetween(W.unboundedPreceding, -1)
    rest = by_level.rowsBetween(0, W.unboundedFollowing)
    left = room.select(
        "*",
        (F.sum("source_size").over(every) - F.coalesce(F.sum("room").over(full), F.lit(0.0))).alias("left"),
        F.sum("weight").over(rest).alias("left_weight"),
    )
    level = left.withColumn("level", F.col("left") / F.col("left_weight")).withColumn("fits", F.col("level") * F.col("weight") <= F.col("room"))
    ranked = level.withColumn("at", F.row_number().over(by_level))
    first = ranked.withColumn("first", F.min(F.when(F.col("fits"), F.struct("at", "level"))).over(every))
    inside = (F.col("first").isNull()) | (F.col("at") < F.col("first.at"))
    return first.select("source", "source_size", F.when(inside, F.col("room")).otherwise(F.col("first.level") * F.col("weight")).alias("target"))


def offset(source: Column, seed: str) -> Column:
    """A number in [0, 1) from the source's name: the first eight hexadecimal digits of an md5."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(seed), F.coalesce(source, F.lit("(null)")))), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def mix(docs: DataFrame, seed: str = "mix-1", limit: float = 3.0) -> DataFrame:
    """One row per row of docs: doc_id, source, size, source_size, target, copies, taken.

    Null text has no words; a null source is a source of its own, the last. A source without words has target 0 and
    gives nothing. Equal rows get neighbouring numbers, so reruns give each of them the same copies in sum. Columns other
    than doc_id, text and source are ignored; an empty table gives an empty result.
    """
    return _placed(docs, seed, limit).select("doc_id", "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def _placed(docs: DataFrame, seed: str, limit: float, *more: str) -> DataFrame:
    """mix() with the columns named more, which also order rows of one doc_id and size."""
    sized = docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), *more)
    sized = sized.withColumns({"class": size_class(F.col("size")), "cell": F.conv(F.substring(F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 1, 2), 16, 10).cast("int"), "null_source": F.col("source").isNull(), "name": F.coalesce("source", F.lit(""))})
    sized = written(sized, "sizes")  # small, and read several times: the texts are counted once
    key = ["null_source", "name", "class", "cell"]
    cells = sized.groupBy(*key).agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("words"))
    goal = targets(cells.groupBy("null_source", "name").agg(F.sum("words").alias("source_size")).select(F.when(~F.col("null_source"), F.col("name")).alias("source"), "source_size"), limit)
    goal = goal.select(F.col("source").isNull().alias("null_source"), F.coalesce("source", F.lit("")).alias("name"), "source_size", "target", offset(F.col("source"), seed).alias("u"))
    # Two windows: classes within a source, then cells within a class.
    classes = cells.groupBy("null_source", "name", "class").agg(F.sum("n").alias("n"))
    before = W.partitionBy("null_source", "name").orderBy("class").rowsBetween(W.unboundedPreceding, -1)
    classes = classes.select("null_source", "name", "class", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("class_start"))
    within = W.partitionBy("null_source", "name", "class").orderBy("cell").rowsBetween(W.unboundedPreceding, -1)
    starts = cells.select(*key, F.coalesce(F.sum("n").over(within), F.lit(0)).alias("cell_start"))
    starts = starts.join(classes, ["null_source", "name", "class"]).join(goal, ["null_source", "name"])
    number = F.row_number().over(W.partitionBy(*key).orderBy("doc_id", "size", *more)) - 1
    placed = sized.withColumn("number", number).join(starts, key)
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    i = F.col("class_start") + F.col("cell_start") + F.col("number")
    copies = (F.floor(F.col("u") + F.col("rate") * (F.col("i") + 1)) - F.floor(F.col("u") + F.col("rate") * F.col("i"))).cast("long")
    return placed.withColumns({"rate": rate, "i": i}).withColumn("copies", copies)


@keeps_columns
def mixed(docs: DataFrame, seed: str = "mix-1") -> DataFrame:
    """The rows of docs, each as often as mix() says, with or without doc_id.

    Repeated rows of one doc_id, text and source are emitted from one of them. Rows that share only a doc_id are each
    emitted as often as their own number says. Null text has no words, a null source is a source; an empty table gives an empty
    result. Columns of any name are kept. A text is counted whole, and moved once.
    """
    key = ["__id", "__digest", "__source"]
    named = keyed(docs).withColumn("__source", F.coalesce(F.concat(F.lit("="), "source"), F.lit("")))
    times = _placed(named, seed, 3.0, *key).groupBy(*key).agg(F.sum("copies").cast("int").alias("__copies")).where("__copies > 0")
    rows = named.dropDuplicates(key).join(times, key)
    return rows.withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("__copies")))).select(*docs.columns)
