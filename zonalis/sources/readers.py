"""Files to tables, with explicit schemas and checked columns; tables to files."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def require(df: DataFrame, columns: list[str]) -> DataFrame:
    if missing := [c for c in columns if c not in df.columns]:
        raise ValueError(f"missing columns {missing}; there are {df.columns}")
    return df


def read_stations(spark: SparkSession, path: str) -> DataFrame:
    """data.stations[] to station_id, name, lat, lon; fails without any."""
    schema = "data struct<stations: array<struct<id: string, name: string, location: struct<latitude: double, longitude: double>>>>"
    rows = spark.read.schema(schema).json(path, multiLine=True).select(F.explode("data.stations").alias("s"))
    if rows.isEmpty():
        raise ValueError(f"no stations in {path}")
    return rows.select(F.col("s.id").alias("station_id"), "s.name", F.col("s.location.latitude").alias("lat"), F.col("s.location.longitude").alias("lon"))


READINGS = "data struct<readings: array<struct<timestamp: timestamp, data: array<struct<stationId: string, value: double>>>>>"


def flatten_readings(payloads: DataFrame) -> DataFrame:
    batch = payloads.select(F.explode("data.readings").alias("r")).select(F.col("r.timestamp").alias("ts"), F.explode("r.data").alias("d"))
    return batch.select(F.col("d.stationId").alias("station_id"), "ts", F.col("d.value").alias("value"))


def read_readings(spark: SparkSession, path: str) -> DataFrame:
    """data.readings[].data[] to station_id, ts, value; unreadable files give no rows."""
    return flatten_readings(spark.read.schema(READINGS).json(path, multiLine=True))


def read_reading_days(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """read_readings()'s rows with the file they are from, and one row: days (files) that could be read, and days skipped.

    A file that is no JSON, or has no data, is skipped; without any file that has readings this fails.
    """
    raw = spark.read.schema(f"{READINGS}, __corrupt string").option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "__corrupt").json(path, multiLine=True)
    files = raw.select("*", F.col("_metadata.file_path").alias("file"))
    ok = F.col("__corrupt").isNull() & F.col("data.readings").isNotNull()
    days = files.groupBy("file").agg(F.bool_and(ok).alias("ok")).agg(F.count_if("ok").alias("days_ok"), F.count_if(~F.col("ok")).alias("days_skipped"))
    good = files.where(ok).select("file", F.explode("data.readings").alias("r")).select("file", F.col("r.timestamp").alias("ts"), F.explode("r.data").alias("d"))
    rows = good.select(F.col("d.stationId").alias("station_id"), "ts", F.col("d.value").alias("value"), "file")
    if rows.isEmpty():
        raise ValueError(f"no readable readings in {path}")
    return rows, days


def read_population(spark: SparkSession, path: str, fields: list[str]) -> DataFrame:
    """Pages of result.records, all strings; a page with success false fails."""
    schema = f"success boolean, result struct<records: array<struct<{', '.join(f'{f}: string' for f in fields)}>>>"
    pages = spark.read.schema(schema).json(path, multiLine=True)
    checked = pages.withColumn("ok", F.when(F.col("success"), True).otherwise(F.raise_error(F.lit("a page was not successful"))))
    return checked.where("ok").select(F.explode("result.records").alias("r")).select("r.*")


def suppression_report(raw: DataFrame, fields: list[str]) -> DataFrame:
    """(field, suppressed, not_numeric) of text columns: how many values are the mark "-", and how many others are no number; NULL is neither."""
    parts = ", ".join(f"'{f}', CAST(`{f}` AS STRING)" for f in fields)
    long = raw.select(F.expr(f"stack({len(fields)}, {parts}) AS (field, value)"))
    value = F.col("value")
    other = value.isNotNull() & (value != "-") & value.try_cast("double").isNull()
    return long.groupBy("field").agg(F.count_if(value == "-").alias("suppressed"), F.count_if(other).alias("not_numeric"))


def read_zones(spark: SparkSession, path: str, id_property: str) -> tuple[DataFrame, DataFrame]:
    """A GeoJSON collection to zones (zone_id, props) and edges (zone_id, part, ring, x1, y1, x2, y2)."""
    schema = "features array<struct<properties: map<string, string>, geometry: struct<type: string, coordinates: string>>>"
    features = spark.read.schema(schema).json(path, multiLine=True).select(F.explode("features").alias("f"))
    rows = features.select(F.try_element_at("f.properties", F.lit(id_property)).alias("zone_id"), F.transform_keys("f.properties", lambda k, _: F.replace(k, F.lit("."), F.lit("_"))).alias("props"), F.col("f.geometry.type").alias("type"), F.col("f.geometry.coordinates").alias("c"))
    if (head := rows.select("zone_id", F.map_keys("props").alias("names")).head()) is None:
        raise ValueError("no features")
    if head["zone_id"] is None:
        raise ValueError(f"no property {id_property}; there are {head['names']}")
    ring = "array<array<array<double>>>"
    parts = F.when(F.col("type") == "Polygon", F.array(F.from_json("c", ring))).otherwise(F.from_json("c", f"array<{ring}>"))
    rings = rows.select("zone_id", F.posexplode(parts).alias("part", "rings")).select("zone_id", "part", F.posexplode("rings").alias("ring", "points"))
    pairs = F.zip_with(F.slice("points", F.lit(1), F.size("points") - 1), F.slice("points", F.lit(2), F.size("points") - 1), lambda a, b: F.struct(a[0].alias("x1"), a[1].alias("y1"), b[0].alias("x2"), b[1].alias("y2")))
    return rows.select("zone_id", "props"), rings.select("zone_id", "part", "ring", F.explode(pairs).alias("e")).select("zone_id", "part", "ring", "e.*")


def write_points_geojson(points: DataFrame, path: str) -> None:
    """point_id, lon, lat and more columns to one feature a line."""
    props = F.struct(*[c for c in points.columns if c not in ("lon", "lat")])
    feature = F.struct(F.lit("Feature").alias("type"), F.struct(F.lit("Point").alias("type"), F.array("lon", "lat").alias("coordinates")).alias("geometry"), props.alias("properties"))
    points.select(F.to_json(feature).alias("value")).write.text(path)


def read_observations(spark: SparkSession, path: str, sensor: str, start: str, end: str, columns: list[str] | None = None) -> DataFrame:
    """Observations of a sensor from start to end (its first day left out), from a table in partitions of sensor, year and month.

    Years and months are pruned by their folders, so other periods' files aren't read; acquired_at then decides.
    """
    first, last = (F.year(F.lit(d).cast("date")) * 12 + F.month(F.lit(d).cast("date")) for d in (start, end))
    month = F.col("year") * 12 + F.col("month")
    rows = require(spark.read.parquet(path), ["sensor", "year", "month", "acquired_at", *(columns or [])])
    rows = rows.where((F.col("sensor") == sensor) & (month >= first) & (month <= last) & (F.col("acquired_at") >= start) & (F.col("acquired_at") < end))
    return rows.select(*columns) if columns else rows


def write_observations(obs: DataFrame, path: str) -> None:
    """obs (sensor, acquired_at, ...) in partitions of sensor, year and month; rows of one month are brought together first."""
    dated = obs.withColumns({"year": F.year("acquired_at"), "month": F.month("acquired_at")})
    dated.repartition("sensor", "year", "month", F.pmod(F.xxhash64("acquired_at"), F.lit(8))).write.partitionBy("sensor", "year", "month").parquet(path)


def read_grid(spark: SparkSession, path: str) -> DataFrame:
    """One row of a patch grid: patches_per_row, total_patches, affine (six numbers), crs. A grid without an affine fails."""
    schema = "patchesPerRow int, totalPatches int, projection struct<crs: string, affine: struct<doubleMatrix: array<double>>>"
    row = spark.read.schema(schema).json(path, multiLine=True)
    affine = F.col("projection.affine.doubleMatrix")
    checked = F.when(F.coalesce(F.size(affine), F.lit(0)) == 6, affine).otherwise(F.raise_error(F.lit("the grid has no affine of six numbers")))
    return row.select(F.col("patchesPerRow").alias("patches_per_row"), F.col("totalPatches").alias("total_patches"), checked.alias("affine"), F.col("projection.crs").alias("crs"))


def read_zone_table(spark: SparkSession, path: str, schema: str, columns: list[str]) -> DataFrame | None:
    """A CSV with a header, or None if there is no such file; columns must be there."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target):
        return None
    named = require(spark.read.csv(path, header=True), columns).columns
    types = {f.name: f.dataType for f in spark.createDataFrame([], schema).schema}
    return spark.read.csv(path, header=True).select(*[F.col(c).try_cast(types[c]).alias(c) if c in types else F.col(c) for c in named])


def write_table(df: DataFrame, path: str, kind: str = "parquet", by: list[str] = (), overwrite: bool = False) -> None:
    """A stage's output as Parquet, or as CSV with a header; an existing one stays unless overwrite is set."""
    if kind not in ("parquet", "csv"):
        raise ValueError(f"kind must be parquet or csv, not {kind!r}")
    writer = df.write.mode("overwrite" if overwrite else "error").partitionBy(*by)
    writer.parquet(path) if kind == "parquet" else writer.csv(path, header=True)


def materialize(spark: SparkSession, build: Callable[[], DataFrame], path: str, force: bool = False, inputs: list[DataFrame] | None = None) -> DataFrame:
    """What is written at path; built and written first if it isn't there, if the inputs' fingerprint isn't the one stored beside it, or by force.

    A new table is written to a folder beside path first and takes its place once it is whole, with its fingerprint last: after
    an interrupted write the old table stays, or the next call builds again. Without inputs only the path is looked at.
    """
    hadoop = spark._jvm.org.apache.hadoop.fs
    target, fresh, mark = (hadoop.Path(p) for p in (path, f"{path}.new", f"{path}.fingerprint"))
    fs = target.getFileSystem(spark._jsc.hadoopConfiguration())
    now = None if inputs is None else ";".join(",".join(map(str, table_fingerprint(t).first())) for t in inputs)
    known = spark.read.text(mark.toString()).first() if fs.exists(mark) else None
    stale = now is not None and (known is None or known[0] != now)
    if force or stale or not fs.exists(hadoop.Path(target, "_SUCCESS")):
        build().write.mode("overwrite").parquet(fresh.toString())
        fs.delete(mark, True)
        fs.delete(target, True)
        if not fs.rename(fresh, target):
            raise OSError(f"{fresh} can't be moved to {path}")
        if now is not None:
            spark.createDataFrame([(now,)], "value string").coalesce(1).write.mode("overwrite").text(mark.toString())
    return spark.read.parquet(path)


def step(df: DataFrame, name: str) -> tuple[DataFrame, Callable[[], None]]:
    """The rows, written once under spark.checkpoint.dir, which driver and executors share; and what removes them once no later step reads them.

    Where that is unset, a local master takes a local folder.
    """
    spark = df.sparkSession
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    path = f"{(base or '/tmp/zonalis-checkpoints').rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)

    def remove() -> None:
        folder = spark._jvm.org.apache.hadoop.fs.Path(path)
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)

    return spark.read.schema(df.schema).parquet(path), remove


def table_fingerprint(df: DataFrame) -> DataFrame:
    """One row that changes with the table's rows, whatever their order."""
    h = F.xxhash64(*df.columns)
    return df.agg(F.count(F.lit(1)).alias("n"), F.bit_xor(h).alias("x"), F.sum(F.shiftright(h, 16)).alias("s"))
