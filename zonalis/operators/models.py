"""Clusters, classifiers and heat models, fitted with Spark ML on tables of zones or cells."""

from __future__ import annotations

import math
from concurrent.futures import ThreadPoolExecutor

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.clustering import GaussianMixture, GaussianMixtureModel, KMeans, KMeansModel
from pyspark.ml.feature import OneHotEncoder, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from zonalis.operators import clusters
from zonalis.operators.raster import neighbourhood_features
from zonalis.operators.sampling import hash_split
from zonalis.operators.scores import redistribute_vegetation

VECTOR = "__features"
#: Mixtures that are fitted at a time.
FITS = 4


def assembled(df: DataFrame, features: list[str]) -> DataFrame:
    """Rows with all features, and these as one vector."""
    return VectorAssembler(inputCols=features, outputCol=VECTOR).transform(df.dropna(subset=features))


def fit_kmeans(df: DataFrame, k: int, seed: int = 42, starts: int = 10) -> KMeansModel:
    """df has VECTOR. The best of several starts by its cost."""
    models = [KMeans(k=k, seed=seed + s, featuresCol=VECTOR, predictionCol="cluster").fit(df) for s in range(starts)]
    return min(models, key=lambda m: m.summary.trainingCost)


def fit_gmm(df: DataFrame, k: int, seed: int = 42, starts: int = 5) -> GaussianMixtureModel:
    models = [GaussianMixture(k=k, seed=seed + s, featuresCol=VECTOR, predictionCol="cluster", probabilityCol="__probability").fit(df) for s in range(starts)]
    return max(models, key=lambda m: m.summary.logLikelihood)


def label_clusters(df: DataFrame, model: KMeansModel | GaussianMixtureModel, name: str) -> DataFrame:
    """df (with VECTOR) with the cluster as name; a mixture adds name_prob_0, name_prob_1 and so on."""
    out = model.transform(df).withColumnRenamed("cluster", name)
    if isinstance(model, GaussianMixtureModel):
        p = vector_to_array("__probability")
        out = out.withColumns({f"{name}_prob_{i}": p[i] for i in range(model.getK())})
    return out.drop("__probability")


def sweep_gmm(rows: DataFrame, ks: range = range(2, 9), seed: int = 42, starts: int = 5) -> DataFrame:
    """A row for each k: bic, aic, silhouette, davies_bouldin of the best of several starts; rows (key, x), standardised, with unique keys."""
    rows = rows.select("key", array_to_vector("x").alias(VECTOR)).persist()
    n, d = rows.count(), len(rows.first()[VECTOR])
    with ThreadPoolExecutor(FITS) as pool:  # jobs are small beside their start: several fits at a time
        models = list(pool.map(lambda k: fit_gmm(rows, k, seed, starts), ks))
    found, labelled = [], rows
    for k, model in zip(ks, models, strict=True):
        free = k - 1 + k * d + k * d * (d + 1) // 2
        likelihood = model.summary.logLikelihood
        found.append((k, free * math.log(n) - 2 * likelihood, 2 * free - 2 * likelihood))
        labelled = model.copy().setPredictionCol(f"__{k}").setProbabilityCol(f"__probability_{k}").transform(labelled)
    own = F.create_map(*[c for k in ks for c in (F.lit(k), F.col(f"__{k}"))])
    labelled = labelled.select("key", vector_to_array(VECTOR).alias("x"), own.alias("own")).persist()
    labelled.count()
    rows.unpersist()
    near = {r.labelling: r.silhouette for r in clusters.labelled_silhouettes(labelled).collect()}
    spread = {r.labelling: r.davies_bouldin for r in clusters.davies_bouldins(clusters.spread_out(labelled)).collect()}
    labelled.unpersist()
    return rows.sparkSession.createDataFrame([(*row, near.get(row[0]), spread.get(row[0])) for row in found], "k int, bic double, aic double, silhouette double, davies_bouldin double")


def select_primary(df: DataFrame, kmeans_silhouette: float, gmm_silhouette: float, kmeans: str = "kmeans_cluster", gmm: str = "gmm_cluster") -> DataFrame:
    """df with primary_cluster: k-means' where its silhouette is at least the mixture's. Both columns stay."""
    return df.withColumn("primary_cluster", F.col(kmeans if kmeans_silhouette >= gmm_silhouette else gmm))


def train_pixel_classifier(cells: DataFrame, label: str, features: list[str], seed: int = 42, trees: int = 200, bag: float = 0.5, depth: int = 12) -> PipelineModel:
    """A random forest of classes 1, 2, ...; cells that lack a feature or the label aren't used."""
    rows = cells.dropna(subset=[label, *features]).withColumn("__y", F.col(label) - 1.0)
    forest = RandomForestClassifier(featuresCol=VECTOR, labelCol="__y", numTrees=trees, subsamplingRate=bag, minInstancesPerNode=1, maxDepth=depth, seed=seed, probabilityCol="__p", rawPredictionCol="__r", predictionCol="__c")
    return Pipeline(stages=[VectorAssembler(inputCols=features, outputCol=VECTOR, handleInvalid="keep"), forest]).fit(rows)


def classify(cells: DataFrame, model: PipelineModel, features: list[str]) -> DataFrame:
    """cells with class, probs (by class, from 1) and valid. A cell that lacks a feature is not valid and has neither."""
    valid = F.lit(True)
    for f in features:
        valid = valid & F.col(f).isNotNull() & ~F.isnan(F.col(f).cast("double"))
    out = model.transform(cells.withColumn("valid", valid))
    return out.select(*cells.columns, F.when(F.col("valid"), (F.col("__c") + 1).cast("int")).alias("class"), F.when(F.col("valid"), vector_to_array("__p")).alias("probs"), "valid")


def with_context(cells: DataFrame, features: list[str], radius: int = 1) -> tuple[DataFrame, list[str]]:
    """cells with mean and deviation of each feature around them, and the names of all features: the second voter's table."""
    return neighbourhood_features(cells, list(features), radius), [*features, *[f"{f}_{k}" for f in features for k in ("mean", "std")]]


def zone_heat_table(heat: DataFrame, clusters: DataFrame, sensitivity: DataFrame, target: str, features: list[str]) -> tuple[DataFrame, DataFrame]:
    """Zones in all three tables with target and features, and one row with the number of zones of heat that were dropped."""
    if missing := [f for f in features if f not in clusters.columns and f not in sensitivity.columns]:
        raise ValueError(f"no table has the features {missing}")
    own = [f for f in features if f in clusters.columns]
    others = [f for f in features if f not in own]
    table = heat.select("zone_id", target).join(clusters.select("zone_id", *own), "zone_id").join(sensitivity.select("zone_id", *others), "zone_id")
    return table, heat.join(table.select("zone_id"), "zone_id", "left_anti").agg(F.count(F.lit(1)).alias("dropped"))


def train_heat_model(df: DataFrame, key: str, target: str, features: list[str], categorical: list[str] = (), seed: str = "split", test: float = 0.2, rounds: int = 300, depth: int = 4, rate: float = 0.05, bag: float = 0.8) -> tuple[PipelineModel, dict[str, float], DataFrame]:
    """Boosted trees over a hashed split: the model, test_rmse, test_r2, n_train and n_test, and (feature, importance), highest first.

    A categorical feature is a number from 0 and enters as one column a value, so that no order is implied.
    """
    rows = hash_split(df.dropna(subset=[target, *features]), key, test, seed)
    plain = [f for f in features if f not in categorical]
    encoder = [OneHotEncoder(inputCols=list(categorical), outputCols=[f"__hot_{c}" for c in categorical], handleInvalid="keep", dropLast=False)] if categorical else []
    trees = GBTRegressor(featuresCol=VECTOR, labelCol=target, predictionCol="predicted", maxIter=rounds, maxDepth=depth, stepSize=rate, subsamplingRate=bag, seed=42)
    model = Pipeline(stages=[*encoder, VectorAssembler(inputCols=[*plain, *[f"__hot_{c}" for c in categorical]], outputCol=VECTOR), trees]).fit(rows.where("is_train"))
    gap = F.col(target) - F.col("predicted")
    tested = model.transform(rows.where("NOT is_train")).agg(F.sqrt(F.avg(gap * gap)).alias("rmse"), (1 - F.try_divide(F.avg(gap * gap), F.var_pop(target))).alias("r2"), F.count(F.lit(1)).alias("n")).head()
    weights = model.stages[-1].featureImportances.toArray().tolist()
    shares = dict(zip(plain, weights, strict=False))
    at = len(plain)
    for i, c in enumerate(categorical):
        width = model.stages[0].categorySizes[i] + 1
        shares[c] = sum(weights[at : at + width])
        at += width
    ranked = sorted(shares.items(), key=lambda kv: (-kv[1], kv[0]))
    report = {"test_rmse": tested["rmse"], "test_r2": tested["r2"], "n_train": rows.where("is_train").count(), "n_test": tested["n"]}
    return model, report, df.sparkSession.createDataFrame(ranked, "feature string, importance double")


def vegetation_edits(zones: DataFrame, deltas: list[float], ndvi: list[str] = ("ndvi_dry", "ndvi_wet"), fitted: str = "ndvi_dry") -> DataFrame:
    """Each zone with each change of vegetation, NDVI moved by the slope of fitted over vegetation in all zones: requested_delta, actual_delta."""
    slope = zones.agg(F.regr_slope(fitted, "fraction_vegetation").alias("__slope"))
    wide = zones.withColumn("requested_delta", F.explode(F.array(*map(F.lit, deltas))))
    edited = redistribute_vegetation(wide, F.col("requested_delta")).crossJoin(F.broadcast(slope))  # one row
    return edited.withColumns({c: F.col(c) + F.col("actual_delta") * F.col("__slope") for c in ndvi if c in zones.columns}).drop("__slope")


def _scored_twice(model: PipelineModel, edited: DataFrame, before: str) -> DataFrame:
    """edited, whose column before holds the features as they were, with original and changed: both predictions, in one pass and without a join."""
    names = [f for f in edited.schema[before].dataType.names if f in edited.columns]
    changed = model.transform(edited).select(*edited.columns, F.col("predicted").alias("changed"))
    plain = changed.withColumns({f: F.col(f"{before}.{f}") for f in names})
    out = model.transform(plain).select("changed", F.col("predicted").alias("original"), *[c for c in edited.columns if c not in (*names, before)], before)
    return out


def counterfactual_zones(model: PipelineModel, zones: DataFrame, deltas: list[float]) -> DataFrame:
    """zone_id, requested_delta, actual_delta, original_lst, counterfactual_lst, delta_lst: all zones and changes in one job."""
    rows = zones.withColumn("__before", F.struct(*[c for c in zones.columns if c != "zone_id"]))
    both = _scored_twice(model, vegetation_edits(rows, deltas), "__before")
    return both.select("zone_id", "requested_delta", "actual_delta", F.col("original").alias("original_lst"), F.col("changed").alias("counterfactual_lst"), (F.col("changed") - F.col("original")).alias("delta_lst"))


def edit_cells(cells: DataFrame, mask: Column, to: int, means: DataFrame, features: list[str], classes: list[int], prefix: str = "class") -> DataFrame:
    """cells with edited and before: those under the mask take the class's mean features and its one-hot columns, the others stay.

    means has a row per class (class, features). A NULL mask is no edit. before holds all columns as they were.
    """
    vector = means.where(F.col("class") == to).select(*[F.col(f).alias(f"__m_{f}") for f in features])
    rows = cells.withColumns({"edited": F.coalesce(mask, F.lit(False)), "before": F.struct(*cells.columns)}).crossJoin(F.broadcast(vector))  # one row
    new = {f: F.when(F.col("edited"), F.col(f"__m_{f}")).otherwise(F.col(f)) for f in features}
    new |= {f"{prefix}_{k}": F.when(F.col("edited"), float(k == to)).otherwise(F.col(f"{prefix}_{k}")) for k in classes}
    return rows.withColumns(new).select(*cells.columns, "edited", "before")


def pixel_heat_table(cells: DataFrame, target: str, classes: list[int], bands: list[str], around: list[str], radius: int = 1) -> tuple[DataFrame, list[str]]:
    """Cells with class and target, and the features of their heat model: bands, one-hot class, and mean and deviation of some bands around them.

    A cell without class or target is left out, but counts in its neighbours' surroundings.
    """
    table, names = with_context(cells, around, radius)
    rows = table.where(F.col("class").isNotNull() & F.col(target).isNotNull())
    return rows, [*bands, *[f"class_{k}" for k in classes], *[n for n in names if n not in around]]


def counterfactual_cells(model: PipelineModel, edited: DataFrame, around: list[str] = (), radius: int = 1) -> tuple[DataFrame, DataFrame]:
    """(gx, gy, edited, delta_lst) of edit_cells()'s rows, and one row: the mean delta of the edited ones, 0 without any, and their number.

    The surroundings of the bands named around are taken anew after the edit. Both predictions are made in one pass.
    """
    if around:
        rows = edited.drop(*[f"{f}_{k}" for f in around for k in ("mean", "std")])
        edited, _ = with_context(rows, around, radius)
    both = _scored_twice(model, edited, "before")
    delta = both.select("before.gx", "before.gy", "edited", (F.col("changed") - F.col("original")).alias("delta_lst"))
    return delta, delta.agg(F.coalesce(F.avg(F.when(F.col("edited"), F.col("delta_lst"))), F.lit(0.0)).alias("mean_delta"), F.count_if("edited").alias("n_edited"))


def downscale_feasibility(cells: DataFrame, key: str, target: str, features: list[str], seed: str = "split", trees: int = 200) -> DataFrame:
    """A row per model (baseline, linear, forest): R2 on 30 % of the cells, n, and whether the gate passes.

    It passes from 30 cells on, when both models beat the mean of the training cells, and the better one has R2 above 0.3.
    """
    rows = assembled(hash_split(cells.dropna(subset=[target]), key, 0.3, seed), features).persist()
    train = rows.where("is_train")
    fits = {"linear": LinearRegression(featuresCol=VECTOR, labelCol=target, predictionCol="p_linear", solver="normal").fit(train)}
    fits["forest"] = RandomForestRegressor(featuresCol=VECTOR, labelCol=target, predictionCol="p_forest", numTrees=trees, maxDepth=6, seed=42).fit(train)
    tested = rows.where("NOT is_train").crossJoin(F.broadcast(train.agg(F.avg(target).alias("p_baseline"))))  # one row
    for model in fits.values():
        tested = model.transform(tested)
    names = ["baseline", *fits]
    r2 = tested.agg(*[(1 - F.try_divide(F.sum(F.pow(F.col(target) - F.col(f"p_{m}"), 2)), F.var_pop(target) * F.count(target))).alias(m) for m in names]).head()
    n = rows.count()
    rows.unpersist()
    ok = n >= 30 and None not in r2 and r2["linear"] > r2["baseline"] and r2["forest"] > r2["baseline"] and max(r2["linear"], r2["forest"]) > 0.3
    return cells.sparkSession.createDataFrame([(m, r2[m], n, ok) for m in names], "model string, r2 double, n long, passed boolean")
