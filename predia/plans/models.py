"""Learned models on Spark ML: random forests and market segments."""

from __future__ import annotations

from functools import reduce

from pyspark.ml import Pipeline
from pyspark.ml.clustering import KMeans
from pyspark.ml.evaluation import ClusteringEvaluator, RegressionEvaluator
from pyspark.ml.feature import OneHotEncoder, StringIndexer, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import RandomForestRegressor
from pyspark.sql import Column, DataFrame, functions as F

from predia import constants as K
from predia.operators.nearest import nearest_join
from predia.operators.silhouette import point_silhouettes
from predia.plans.valuation import NUMERIC
from predia.session import cut

MAX_LISTED_CENTRES = 1000
SEGMENT_FEATURES = ["price_usd", "area_m2", "precio_por_m2", "bedrooms", "bathrooms"]


def forest(trees: int = 200, depth: int = 30, seed: int = K.SEED, embedding: bool = False) -> Pipeline:
    """One-hot zone, numbers and optionally the embedding into a random forest on all features."""
    inputs = ["zona_vec", *NUMERIC] + (["emb_vec"] if embedding else [])
    return Pipeline(stages=[
        StringIndexer(inputCol="corregimiento", outputCol="zona_idx", handleInvalid="keep"),
        OneHotEncoder(inputCols=["zona_idx"], outputCols=["zona_vec"], dropLast=False),
        VectorAssembler(inputCols=inputs, outputCol="features"),
        RandomForestRegressor(
            featuresCol="features", labelCol="price_usd", predictionCol="precio_predicho",
            numTrees=trees, maxDepth=depth, featureSubsetStrategy="all", seed=seed, cacheNodeIds=False,
        ),
    ])


def prepared(df: DataFrame, embedding: bool = False) -> DataFrame:
    kept = ["listing_id", "corregimiento", "price_usd", "es_train", "pliegue", *NUMERIC]
    extra = [array_to_vector(F.col("embedding").cast("array<double>")).alias("emb_vec")] if embedding else []
    return cut(df.select(*kept, *extra))


def forest_report(df: DataFrame, folds: int = 5, embedding: bool = False, **settings) -> DataFrame:
    """MAE on train, test and the mean over folds; df comes from with_split."""
    data = prepared(df, embedding)
    train, test = data.filter("es_train"), data.filter("not es_train")
    evaluator = RegressionEvaluator(labelCol="price_usd", predictionCol="precio_predicho", metricName="mae")
    pipeline = forest(embedding=embedding, **settings)
    errors = []
    for fold in range(folds):
        model = pipeline.fit(train.filter(F.col("pliegue") != fold))
        errors.append(evaluator.evaluate(model.transform(train.filter(F.col("pliegue") == fold))))
    model = pipeline.fit(train)
    at_train = evaluator.evaluate(model.transform(train))
    at_test = evaluator.evaluate(model.transform(test))
    name = "random_forest_embedding" if embedding else "random_forest"
    return df.sparkSession.createDataFrame(
        [(name, sum(errors) / len(errors) if errors else None, at_train, at_test, at_test / at_train)],
        "modelo string, mae_cv double, mae_train double, mae_test double, ratio_sobreajuste double",
    )


def out_of_fold_model(pipeline: Pipeline, data: DataFrame, folds: int = 5) -> DataFrame:
    """Prediction of every training row by a model fitted on the other folds, keyed by fold like
    `valuation.out_of_fold`, so that the same reports read both; data comes from `prepared`."""
    train = data.filter("es_train")
    scored = [
        pipeline.fit(train.filter(F.col("pliegue") != fold)).transform(train.filter(F.col("pliegue") == fold))
        for fold in range(folds)
    ]
    return cut(reduce(DataFrame.unionByName, [_scored(part) for part in scored]))


def held_out_model(pipeline: Pipeline, data: DataFrame) -> DataFrame:
    """Predictions of the test rows by a model fitted on all training rows."""
    return cut(_scored(pipeline.fit(data.filter("es_train")).transform(data.filter("not es_train"))))


def _scored(rows: DataFrame) -> DataFrame:
    return rows.select("listing_id", "pliegue", F.col("corregimiento").alias("zona"), F.col("price_usd").cast("double").alias("precio_real"), "precio_predicho")


def importance_ranking(df: DataFrame, **settings) -> DataFrame:
    """Features by importance, most important first."""
    model = forest(**settings).fit(prepared(df).filter("es_train"))
    labels = model.stages[0].labels + ["__desconocida"]
    names = [f"zona_{z}" for z in labels] + NUMERIC
    values = model.stages[-1].featureImportances.toArray()
    rows = sorted(zip(names, map(float, values)), key=lambda r: (-r[1], r[0]))
    return df.sparkSession.createDataFrame(
        [(i + 1, n, v) for i, (n, v) in enumerate(rows)], "posicion bigint, variable string, importancia double"
    )


def segment_scaling(df: DataFrame, features: list[str] | None = None) -> dict[str, tuple[float, float]]:
    features = features or SEGMENT_FEATURES
    row = df.agg(
        *[F.avg(F.col(c).cast("double")).alias(f"m_{c}") for c in features],
        *[F.stddev_pop(F.col(c).cast("double")).alias(f"s_{c}") for c in features],
    ).first()
    return {c: (row[f"m_{c}"], row[f"s_{c}"] or 1.0) for c in features}


def segment_frame(df: DataFrame, scaling: dict[str, tuple[float, float]]) -> DataFrame:
    """Rows with the standardised features as `features`."""
    scaled = [((F.col(c).cast("double") - m) / s) for c, (m, s) in scaling.items()]
    return df.withColumn("features", array_to_vector(F.array(*scaled)))


def kmeans_sweep(df: DataFrame, ks: range = range(2, 11), seed: int = K.SEED, exact: bool = True) -> DataFrame:
    """Inertia and silhouettes per k; the k of the best Euclidean silhouette is flagged.

    That one is exact and quadratic in the number of distinct rows; with `exact` off only Spark's
    squared-Euclidean form is computed, which is linear, and chosen by.
    """
    scaled = cut(segment_frame(df, segment_scaling(df)).select("features"))
    models = {k: KMeans(k=k, seed=seed, maxIter=30, predictionCol=f"k{k}").fit(scaled) for k in ks}
    labelled = scaled
    for model in models.values():
        labelled = model.transform(labelled)
    labelled = cut(labelled)
    euclidean: dict[str, float] = {}
    if exact:
        width = len(SEGMENT_FEATURES)
        named = labelled.withColumn("v", vector_to_array("features")).select(*[F.col("v")[i].alias(f"x{i}") for i in range(width)], *[f"k{k}" for k in ks])
        points = point_silhouettes(named, [f"x{i}" for i in range(width)], [f"k{k}" for k in ks])
        means = points.groupBy("labelling").agg((F.sum(F.col("s") * F.col("weight")) / F.sum("weight")).alias("m"))
        euclidean = {r.labelling: r.m for r in means.collect()}
    rows = []
    for k, model in models.items():
        squared = ClusteringEvaluator(predictionCol=f"k{k}").evaluate(labelled)
        rows.append((k, float(model.summary.trainingCost), float(squared), euclidean.get(f"k{k}")))
    best = max(rows, key=lambda r: r[3] if exact else r[2])[0]
    return df.sparkSession.createDataFrame(
        [(*r, r[0] == best) for r in rows],
        "k int, inercia double, silueta_cuadrada double, silueta double, elegido boolean",
    )


def fit_segments(df: DataFrame, k: int = 2, seed: int = K.SEED):
    """(scaling, centres): the trained segments as plain numbers, so predicting never refits.

    Centres are ordered by their price so that segment 0 is the cheaper one.
    """
    scaling = segment_scaling(df)
    model = KMeans(k=k, seed=seed, maxIter=30).fit(cut(segment_frame(df, scaling).select("features")))
    centres = sorted((list(map(float, c)) for c in model.clusterCenters()), key=lambda c: c[0])
    return scaling, centres


def assign_segment(scaling: dict[str, tuple[float, float]], centres: list[list[float]]) -> Column:
    """Index of the nearest centre; ties go to the lower index; null features give null."""
    z = [((F.col(c).cast("double") - m) / s) for c, (m, s) in scaling.items()]
    options = [
        F.struct(
            reduce(lambda a, b: a + b, [(x - v) * (x - v) for x, v in zip(z, centre)]).alias("d"),
            F.lit(i).alias("cluster_id"),
        )
        for i, centre in enumerate(centres)
    ]
    complete = reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in scaling])
    return F.when(complete, F.array_min(F.array(*options))["cluster_id"])


def nearest_centre(df: DataFrame, centres: DataFrame, features: list[str], key: str = "listing_id") -> DataFrame:
    """Segment by a centres table (cluster_id and one column per feature); ties go to the lower id.

    A list of centres goes to every row as one array; a table beyond that meets the rows in the
    neighbour join. Rows with a missing feature get null.
    """
    held = centres.select("cluster_id", *[F.col(f).cast("double").alias(f) for f in features])
    if held.count() > MAX_LISTED_CENTRES:
        whole = df.dropna(subset=features)
        found = nearest_join(whole, held, key, "cluster_id", features, 1).select(key, "cluster_id")
        return df.join(found, key, "left")
    listed = held.agg(F.sort_array(F.collect_list(F.struct("cluster_id", *features))).alias("c")).scalar()

    def distance(c: Column) -> Column:
        return reduce(lambda a, b: a + b, [(F.col(f).cast("double") - c[f]) * (F.col(f).cast("double") - c[f]) for f in features])

    options = F.transform("_centres", lambda c: F.struct(distance(c).alias("d"), c["cluster_id"].alias("cluster_id")))
    complete = reduce(lambda a, b: a & b, [F.col(f).isNotNull() for f in features])
    held_by = df.withColumn("_centres", listed)
    return held_by.withColumn("cluster_id", F.when(complete, F.array_min(options)["cluster_id"])).drop("_centres")

