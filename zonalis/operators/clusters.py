"""K-means over several numbers of clusters and starts at once, and exact silhouettes of many labellings, on rows with a vector.

A row has a key and x, an array of doubles. Vectors aren't taken apart into columns: plans stay as small for 64 features as for 3.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from zonalis.functions.expressions import uniform

#: Rows of a block: two blocks' distances, block by block rows of doubles, are in memory at once. Sums of a block by row and cluster, and bytes of a span of blocks, that a task holds.
BLOCK, SUMS, SPAN = 1000, 1 << 22, 32 << 20
#: Squared distances below this share of the squared length are taken from differences: above it the product has 11 digits or more.
NEAR = 3e-4
ARROW_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"


def vectors(df: DataFrame, key: str, features: list[str]) -> DataFrame:
    """(key, x) of the rows with all features; NaN counts as missing."""
    x = F.array(*[F.col(f).cast("double") for f in features])
    return df.select(F.col(key).alias("key"), x.alias("x")).where(~F.exists("x", lambda v: v.isNull() | F.isnan(v)))


def standardized(rows: DataFrame) -> DataFrame:
    """Each place of x by its mean and population deviation, in one pass over the rows; a constant feature is divided by 1."""
    vector = array_to_vector("x")
    found = rows.agg(Summarizer.metrics("mean", "variance", "count").summary(vector).alias("s"))
    # The summary's variance is a sample's; with one row it is 0.
    count = F.col("s.count").cast("double")
    spread = F.transform(vector_to_array("s.variance"), lambda v: F.sqrt(v * (count - 1) / count))
    stats = found.select(vector_to_array("s.mean").alias("m"), F.transform(spread, lambda v: F.when(v > 0, v).otherwise(1.0)).alias("d"))
    centred = F.zip_with("x", "m", lambda v, m: v - m)
    return rows.crossJoin(F.broadcast(stats)).select("key", F.zip_with(centred, "d", lambda v, d: v / d).alias("x"))  # one row


def squared(x: Column, c: Column) -> Column:
    return F.aggregate(F.zip_with(x, c, lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda t, v: t + v)


def first_centres(rows: DataFrame, ks: range, starts: int, seed: str) -> DataFrame:
    """(k, start, cluster, c): for each start the rows come in another hashed order, and the first k of them are the centres."""
    most = max(ks)
    drawn = None
    for s in range(starts):
        order = [uniform(F.col("key"), f"{seed}-{s}"), F.col("key")]
        chosen = rows.orderBy(*order).limit(most).select(F.lit(s).alias("start"), "x", F.struct(*order).alias("o"))
        drawn = chosen if drawn is None else drawn.unionByName(chosen)
    listed = drawn.groupBy("start").agg(F.transform(F.array_sort(F.collect_list(F.struct("o", "x"))), lambda r: r["x"]).alias("xs"))  # most rows a start
    each = listed.select("start", "xs", F.explode(F.array(*map(F.lit, ks))).alias("k"))
    return each.select("k", "start", F.posexplode(F.slice("xs", F.lit(1), F.col("k"))).alias("cluster", "c"))


def nearest(rows: DataFrame, centres: DataFrame) -> DataFrame:
    """(key, x, k, start, cluster, d2): the nearest centre of each model, the lower cluster of equally near ones. Centres are few."""
    models = centres.groupBy("k", "start").agg(F.array_sort(F.collect_list(F.struct("cluster", "c"))).alias("cs"))
    best = F.array_min(F.transform("cs", lambda c: F.struct(squared(F.col("x"), c["c"]).alias("d2"), c["cluster"].alias("cluster"))))
    return rows.crossJoin(F.broadcast(models)).select("key", "x", "k", "start", best.alias("b")).select("key", "x", "k", "start", "b.cluster", "b.d2")


def cluster_sums(rows: DataFrame, models: dict[tuple[int, int], np.ndarray]) -> DataFrame:
    """(k, start, cluster, n, total): how many rows are nearest to each centre of each model, and their sum. Each task adds up its rows first."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        found = {at: (np.zeros(len(c), int), np.zeros(c.shape)) for at, c in models.items()}
        for batch in batches:
            x = np.array(batch["x"].tolist(), float).reshape(len(batch), -1)
            for at, centres in models.items():
                own = np.stack([((x - c) ** 2).sum(axis=1) for c in centres]).argmin(axis=0)
                count, total = found[at]
                count += np.bincount(own, minlength=len(centres))
                np.add.at(total, own, x)
        yield pd.DataFrame([(*at, c, int(n), t.tolist()) for at, (count, total) in found.items() for c, (n, t) in enumerate(zip(count, total, strict=True)) if n], columns=["k", "start", "cluster", "n", "total"])

    parts = rows.select("x").mapInPandas(run, "k int, start int, cluster int, n long, total array<double>")
    return parts.groupBy("k", "start", "cluster").agg(F.sum("n").alias("n"), vector_to_array(Summarizer.sum(array_to_vector("total"))).alias("total"))


def kmeans(rows: DataFrame, ks: range = range(2, 9), starts: int = 10, rounds: int = 20, seed: str = "kmeans") -> DataFrame:
    """(k, start, cluster, c, inertia): the centres of the best start for each k, after so many of Lloyd's rounds.

    All models take their rounds together: a round is one job, in which the tasks add up the rows of each cluster; a model
    whose centres stay has ended. A cluster without rows keeps its centre. The centres, at most sum(ks) * starts vectors,
    are what goes to the driver and back. rows should be kept or written, as each round reads them. Without rows there are no
    centres; a k above the number of rows has a centre for each row.
    """
    schema = "k int, start int, cluster int, c array<double>"
    models: dict[tuple[int, int], list] = {}
    for r in first_centres(rows, ks, starts, seed).orderBy("cluster").collect():
        models.setdefault((r.k, r.start), []).append(r.c)
    ended, models = {}, {at: np.array(c) for at, c in models.items()}
    for _ in range(rounds):
        if not models:
            break
        moved = {at: c.copy() for at, c in models.items()}
        for r in cluster_sums(rows, models).collect():
            moved[r.k, r.start][r.cluster] = np.array(r.total) / r.n
        ended |= {at: c for at, c in moved.items() if np.array_equal(c, models[at])}
        models = {at: c for at, c in moved.items() if at not in ended}
    found = [(*at, k, c.tolist()) for at, cs in (ended | models).items() for k, c in enumerate(cs)]
    table = rows.sparkSession.createDataFrame(found, schema)
    cost = nearest(rows, table).groupBy("k", "start").agg(F.sum("d2").alias("inertia"))
    best = cost.groupBy("k").agg(F.min(F.struct("inertia", "start")).alias("b")).select("k", "b.start", "b.inertia")
    return table.join(F.broadcast(best), ["k", "start"])  # one row for each k


def distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Euclidean distances of all rows of x to all rows of y, by one product of matrices; of near rows by their differences, so that equal ones are at distance 0."""
    shift = x.mean(axis=0)
    a, b = x - shift, y - shift
    own, other = (a * a).sum(axis=1)[:, None], (b * b).sum(axis=1)[:, None]
    far = np.hstack([-2 * a, own, np.ones_like(own)]) @ np.hstack([b, np.ones_like(other), other]).T
    near = far < NEAR * own
    np.sqrt(np.maximum(far, 0, out=far), out=far)
    for k in np.flatnonzero(near.any(axis=1)):
        far[k, near[k]] = np.sqrt(((x[k] - y[near[k]]) ** 2).sum(axis=1))
    return far


def as_bytes(values: np.ndarray, rows: int) -> pa.Array:
    """So many rows of equal length, each as its bytes."""
    at = np.arange(rows + 1, dtype=np.int32) * (values.nbytes // max(rows, 1))
    return pa.Array.from_buffers(pa.binary(), rows, [None, pa.py_buffer(at), pa.py_buffer(np.ascontiguousarray(values))])


def matrix(rows: pa.ListScalar, kind: type) -> np.ndarray:
    """as_bytes()'s rows, put together."""
    cells = rows.values
    at = np.frombuffer(cells.buffers()[1], np.int32)[cells.offset : cells.offset + len(cells) + 1]
    return np.frombuffer(cells.buffers()[2], np.uint8)[at[0] : at[-1]].view(kind).reshape(len(cells), -1)


def labelled_silhouettes(named: DataFrame, block: int = BLOCK) -> DataFrame:
    """(labelling, n, silhouette) from rows (key, x, own), own being the clusters by labelling: Euclidean, exact at any size.

    Rows are dealt into blocks, which are shuffled once. Each task goes through a span of blocks with each of its own and adds
    up the distances by row and cluster, so that what is shuffled then is a number for each row, cluster and span. The work is
    the square of the rows; memory holds a span of rows and two blocks' distances. Single members count 0; a labelling
    with one cluster has a silhouette of 0 too. Rows without a cluster in some labelling have no part in it. It runs at once;
    labellings and clusters are few. Keys only deal the rows out, and should be unique.
    """
    spark = named.sparkSession
    kinds = named.schema["own"].dataType
    schema = T.StructType([T.StructField("labelling", kinds.keyType), T.StructField("n", T.LongType()), T.StructField("silhouette", T.DoubleType())])
    found = named.select(F.explode("own").alias("labelling", "cluster")).where("cluster IS NOT NULL").groupBy("labelling", "cluster").agg(F.count(F.lit(1)).alias("n"))
    total, width = named.agg(F.count(F.lit(1)), F.max(F.size("x"))).head()
    sizes: dict = {}
    for r in found.orderBy("labelling", "cluster").collect():
        sizes.setdefault(r.labelling, []).append((r.cluster, r.n))
    if not sizes:
        return spark.createDataFrame([], schema)
    clusters = [np.array([c for c, _ in each]) for each in sizes.values()]
    counts = [np.array([n for _, n in each], float) for each in sizes.values()]
    first = np.cumsum([0, *map(len, clusters)])
    columns = int(first[-1])
    block = max(1, min(block, SUMS // columns))
    many = math.ceil(total / block)
    spans = max(1, math.ceil(total * (8 * width + 8 * len(sizes)) / SPAN))
    own = F.array(*[F.try_element_at("own", F.lit(name).cast(kinds.keyType)) for name in sizes])
    at = F.pmod(F.xxhash64("key"), F.lit(many)).cast("int")

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """x, and own as the cluster's place among all clusters of all labellings, -1 without one; as bytes, which move faster than arrays."""
        for batch in batches:
            values = batch.column("own").flatten()
            missing = values.is_null().to_numpy(zero_copy_only=False).reshape(-1, len(clusters))
            values = values.fill_null(0).to_numpy().reshape(-1, len(clusters))
            places = np.stack([np.where(missing[:, j], -1, first[j] + np.searchsorted(c, values[:, j])) for j, c in enumerate(clusters)], axis=1).astype(np.int32)
            columns = [as_bytes(v, batch.num_rows) for v in (batch.column("x").flatten().to_numpy(), places)]
            yield pa.RecordBatch.from_arrays([batch.column("at"), *columns], ["at", "x", "own"])

    packed = named.select(at.alias("at"), "x", own.alias("own")).mapInArrow(pack, "at int, x binary, own binary")
    dealt = packed.repartition(max(spans, math.ceil(many / 2)), "at").groupBy("at").agg(F.collect_list(F.struct("x", "own")).alias("r"))
    blocks = dealt.select("at", "r.x", "r.own")
    others = blocks.coalesce(spans).select(F.col("x").alias("y"), F.col("own").alias("other"))

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([now], pa.int32()), pa.array([mine.tobytes()], pa.binary()), pa.array([sums.tobytes()], pa.binary())], ["at", "own", "sums"])

        now, x, mine, sums = None, None, None, None
        for batch in batches:
            for k, block in enumerate(batch.column("at").to_pylist()):
                if block != now:
                    if now is not None:
                        yield out()
                    now, x = block, matrix(batch.column("x")[k], float)
                    mine = matrix(batch.column("own")[k], np.int32)
                    sums = np.zeros((len(mine), columns))
                other = matrix(batch.column("other")[k], np.int32)
                member = np.zeros((len(other), columns))
                for j in range(len(clusters)):
                    some = np.flatnonzero(other[:, j] >= 0)
                    member[some, other[some, j]] = 1
                sums += distances(x, matrix(batch.column("y")[k], float)) @ member
        if now is not None:
            yield out()

    def close(pdf: pd.DataFrame) -> pd.DataFrame:
        mine = np.frombuffer(pdf["own"].iloc[0], np.int32).reshape(-1, len(clusters))
        sums = sum(np.frombuffer(s, float) for s in pdf["sums"]).reshape(-1, columns)
        out = []
        for j, n in enumerate(counts):
            rows = np.flatnonzero(mine[:, j] >= 0)
            d, k = sums[rows, first[j] : first[j + 1]], mine[rows, j] - first[j]
            each = np.arange(len(rows))
            a = d[each, k] / np.maximum(n[k] - 1, 1)
            means = d / n
            means[each, k] = np.inf
            b, most = means.min(axis=1), np.maximum(a, means.min(axis=1))
            some = (n[k] > 1) & (len(n) > 1) & ~(most == 0)
            out.append((j, len(rows), float(((b[some] - a[some]) / most[some]).sum())))
        return pd.DataFrame(out, columns=["labelling", "n", "total"])

    # A row has two blocks: few go to Python at a time.
    batch = spark.conf.get(ARROW_ROWS)
    spark.conf.set(ARROW_ROWS, "8")
    try:
        pairs = blocks.crossJoin(others.hint("shuffle_replicate_nl"))
        parts = pairs.mapInArrow(add, "at int, own binary, sums binary").groupBy("at").applyInPandas(close, "labelling int, n long, total double")
        sums = parts.groupBy("labelling").agg(F.sum("n").alias("n"), F.sum("total").alias("total")).collect()
    finally:
        spark.conf.set(ARROW_ROWS, batch)
    names = list(sizes)
    return spark.createDataFrame([(names[r.labelling], r.n, r.total / r.n) for r in sums], schema)


def silhouettes(rows: DataFrame, labels: DataFrame, block: int = BLOCK) -> DataFrame:
    """labelled_silhouettes() of rows (key, x) and labels (key, labelling, cluster). Keys must be unique."""
    listed = labels.groupBy("key").agg(F.map_from_entries(F.collect_list(F.struct("labelling", "cluster"))).alias("own"))
    return labelled_silhouettes(rows.join(listed, "key"), block)


def assigned(rows: DataFrame, centres: DataFrame) -> DataFrame:
    """(key, x, own): each row once, with its nearest centre by k, the lower cluster of equally near ones; centres of one start for each k."""
    models = centres.groupBy("k").agg(F.array_sort(F.collect_list(F.struct("cluster", "c"))).alias("cs")).agg(F.array_sort(F.collect_list(F.struct("k", "cs"))).alias("models"))
    best = lambda m: F.array_min(F.transform(m["cs"], lambda c: F.struct(squared(F.col("x"), c["c"]).alias("d2"), c["cluster"].alias("cluster"))))
    own = F.map_from_entries(F.transform("models", lambda m: F.struct(m["k"], best(m)["cluster"])))
    return rows.crossJoin(F.broadcast(models)).select("key", "x", own.alias("own"))  # one row


def spread_out(named: DataFrame) -> DataFrame:
    """(labelling, cluster, x) from rows (x, own)."""
    return named.select("x", F.explode("own").alias("labelling", "cluster"))


def davies_bouldins(labelled: DataFrame) -> DataFrame:
    """(labelling, davies_bouldin) from rows (labelling, cluster, x); NULL with fewer than two clusters. Clusters are few."""
    centres = labelled.groupBy("labelling", "cluster").agg(vector_to_array(Summarizer.mean(array_to_vector("x"))).alias("c"))
    spread = labelled.join(F.broadcast(centres), ["labelling", "cluster"]).groupBy("labelling", "cluster").agg(F.avg(F.sqrt(squared(F.col("x"), F.col("c")))).alias("s"), F.first("c").alias("c"))
    other = spread.select("labelling", F.col("cluster").alias("o"), F.col("s").alias("so"), F.col("c").alias("co"))
    pairs = spread.join(F.broadcast(other), "labelling").where("cluster <> o")
    worst = pairs.groupBy("labelling", "cluster").agg(F.max(F.try_divide(F.col("s") + F.col("so"), F.sqrt(squared(F.col("c"), F.col("co"))))).alias("r"))
    return worst.groupBy("labelling").agg(F.avg("r").alias("davies_bouldin"))


def sweep(rows: DataFrame, ks: range = range(2, 9), starts: int = 10, rounds: int = 20, seed: str = "kmeans", block: int = BLOCK) -> DataFrame:
    """(k, inertia, silhouette, davies_bouldin) for each k that has as many rows, by kmeans(); rows (key, x) with unique keys."""
    rows = rows.persist()
    centres = kmeans(rows, ks, starts, rounds, seed).persist()
    labelled = assigned(rows, centres.select("k", "cluster", "c")).persist()
    labelled.count()
    rows.unpersist()
    near = labelled_silhouettes(labelled, block)
    spread = davies_bouldins(spread_out(labelled))
    found = centres.select(F.col("k").alias("labelling"), "inertia").distinct().join(near, "labelling").join(spread, "labelling", "left")
    out = found.select(F.col("labelling").alias("k"), "inertia", "silhouette", "davies_bouldin").collect()  # a row for each k
    for kept in (labelled, centres):
        kept.unpersist()
    return rows.sparkSession.createDataFrame(out, "k int, inertia double, silhouette double, davies_bouldin double")
