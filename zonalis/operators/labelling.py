"""Tables for labelling by hand: samples of places and days, old labels, progress."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from zonalis.functions.expressions import uniform


def migrate_labels(df: DataFrame, label: str, table: DataFrame) -> tuple[DataFrame, DataFrame]:
    """df with old labels replaced by table (old, new), and one row: migrated, unrecognised, and the unrecognised labels.

    A label that is neither old nor new stays and is listed; NULL and empty ones stay and count for nothing. The table is a
    class list, which is broadcast.
    """
    renamed = F.broadcast(table.select(F.col("old").alias(label), F.col("new").alias("__new")).dropDuplicates([label]))
    known = F.broadcast(table.select(F.col("new").alias(label)).distinct().withColumn("__known", F.lit(True)))
    rows = df.join(renamed, label, "left").join(known, label, "left")
    moved = F.col("__new").isNotNull() & (F.col("__new") != F.col(label))
    strange = F.col("__new").isNull() & F.col("__known").isNull() & (F.col(label) != "")
    report = rows.agg(F.count_if(moved).alias("migrated"), F.count_if(strange).alias("unrecognised"), F.array_sort(F.collect_set(F.when(strange, F.col(label)))).alias("labels"))
    return rows.withColumn(label, F.coalesce("__new", label)).select(*df.columns), report


def drop_subtotals(df: DataFrame, name: str, word: str = "Total") -> tuple[DataFrame, DataFrame]:
    """df without rows named word or containing " - word", and one row with the number of each kind. NULL names stay."""
    whole, part = F.col(name) == word, F.contains(F.col(name), F.lit(f" - {word}"))
    counts = df.agg(F.count_if(whole).alias("totals"), F.count_if(part).alias("subtotals"))
    return df.where(~F.coalesce(whole | part, F.lit(False))), counts


def labelling_table(sample: DataFrame, names: DataFrame, raw_names: DataFrame, order: str) -> DataFrame:
    """point_id (P0001 and so on by order), lon, lat, class, raw class and their names, and three empty columns to fill in.

    A sample to be labelled by hand is small: one task numbers it. A class without a name is class_<code>.
    """
    numbered = sample.withColumn("point_id", F.format_string("P%04d", F.row_number().over(W.orderBy(order))))
    named = numbered.join(F.broadcast(names.select("class", F.col("name").alias("__n"))), "class", "left").join(F.broadcast(raw_names.select(F.col("class").alias("class_raw"), F.col("name").alias("__r"))), "class_raw", "left")
    other = lambda c, n: F.coalesce(n, F.concat(F.lit("class_"), F.col(c).cast("string")))
    empty = [F.lit("").alias(c) for c in ("agreed_label", "confidence", "notes")]
    return named.select("point_id", "lon", "lat", "class", other("class", "__n").alias("class_name"), "class_raw", other("class_raw", "__r").alias("class_raw_name"), *empty)


def random_cells(cells: DataFrame, key: str, n: int, seed: str) -> DataFrame:
    """n cells by a hashed order, the same for every user: point_id (pt_01 and so on) and the cells' columns."""
    drawn = cells.orderBy(uniform(F.col(key), seed), key).limit(n)
    return drawn.withColumn("point_id", F.format_string("pt_%02d", F.row_number().over(W.orderBy(uniform(F.col(key), seed), key)))).select("point_id", *cells.columns)


def labelling_progress(df: DataFrame, label: str, order: str) -> DataFrame:
    """One row: labelled, n, and the first row without a label in order; NULL once all have one."""
    done = F.coalesce(F.col(label), F.lit("")) != ""
    return df.agg(F.count_if(done).alias("labelled"), F.count(F.lit(1)).alias("n"), F.min(F.when(~done, F.col(order))).alias("next"))


def sample_days(readings: DataFrame, at: str, n: int, months: int, seed: str) -> DataFrame:
    """n different days, in order, of the months * 30 - 1 days before the last day of the readings."""
    last = readings.agg(F.max(F.to_date(at)).alias("last")).where("last IS NOT NULL")
    days = last.select(F.explode(F.sequence(F.lit(1), F.lit(months * 30 - 1))).alias("back"), "last").select(F.expr("date_sub(last, back)").alias("day"))
    return days.orderBy(uniform(F.date_format("day", "yyyy-MM-dd"), seed), "day").limit(n).orderBy("day")
