"""Nested leave-one-positive-out evaluation of a logistic regression, and bag pooling."""

from __future__ import annotations

import hashlib
from collections.abc import Sequence
from functools import partial

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import Imputer
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spindrift.functions import stats
from spindrift.operators.examples import split_negatives, stratified_folds
from spindrift.operators.users import vector_means
from spindrift.sources import sinks
from spindrift.sources.stage import Stages

# Fixed values.
COSTS = (0.001, 0.01, 0.1, 1.0, 10.0)
INNER, TEST, SEED = 3, 0.2, 42


def impute_medians(train: DataFrame, df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Nulls and NaN of ``df`` by the exact medians of ``train``; features become doubles."""
    as_double = {c: F.col(c).cast("double") for c in columns}
    model = Imputer(inputCols=list(columns), outputCols=list(columns), strategy="median", relativeError=0.0).fit(train.withColumns(as_double))
    return model.transform(df.withColumns(as_double))


def standardise(train: DataFrame, df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """By mean and population deviation of ``train``; a constant column is only centred."""
    stats_row = train.agg(*[F.avg(c).alias(f"m_{c}") for c in columns], *[F.stddev_pop(c).alias(f"s_{c}") for c in columns])
    out = df.crossJoin(F.broadcast(stats_row))
    out = out.withColumns({c: (F.col(c) - F.col(f"m_{c}")) / F.when(F.col(f"s_{c}") > 0, F.col(f"s_{c}")).otherwise(1.0) for c in columns})
    return out.select(*df.columns)


def standardise_vectors(train: DataFrame, df: DataFrame, vector: str) -> DataFrame:
    """The same, component by component, for an array column; results are floats."""
    cells = train.select(F.posexplode(vector).alias("i", "x")).groupBy("i").agg(F.avg("x").alias("m"), F.stddev_pop("x").alias("s"))
    one = cells.agg(F.array_sort(F.collect_list(F.struct("i", "m", "s"))).alias("_z"))
    out = df.crossJoin(F.broadcast(one))
    scaled = F.zip_with(vector, "_z", lambda x, z: ((x - z["m"]) / F.when(z["s"] > 0, z["s"]).otherwise(1.0)).cast("float"))
    return out.withColumn(vector, scaled).select(*df.columns)


def fit_logistic(train: DataFrame, features: str, label: str, cost: float):
    """Balanced classes; cost C as regParam 1 / (C * sum of weights)."""
    n = train.count()
    rows = train.withColumn("_v", array_to_vector(F.col(features).cast("array<double>"))).withColumn("_y", F.col(label).cast("double"))
    sizes = {r["_y"]: r["count"] for r in rows.groupBy("_y").count().collect()}
    weight = F.when(F.col("_y") == 1, n / (2.0 * max(1, sizes.get(1.0, 0)))).otherwise(n / (2.0 * max(1, sizes.get(0.0, 0))))
    model = LogisticRegression(featuresCol="_v", labelCol="_y", weightCol="_w", regParam=1.0 / (cost * n), standardization=False, maxIter=100)
    return model.fit(rows.withColumn("_w", weight))


def predict(model, df: DataFrame, features: str) -> DataFrame:
    rows = df.withColumn("_v", array_to_vector(F.col(features).cast("array<double>")))
    out = model.transform(rows).withColumn("y_score", vector_to_array("probability")[1])
    return out.drop("_v", "rawPrediction", "probability", "prediction")


def best_cost(train: DataFrame, features: str, label: str, key: str, costs: Sequence[float] = COSTS) -> float:
    """The cost with the best mean average precision over inner stratified folds."""
    folds = stratified_folds(train, label, key, INNER, SEED).cache()
    scores = {}
    for c in costs:
        got = []
        for k in range(INNER):
            model = fit_logistic(folds.where(F.col("fold") != k), features, label, c)
            got.append(stats.average_precision(predict(model, folds.where(F.col("fold") == k), features), "y_score", label).first()["average_precision"] or 0.0)
        scores[c] = sum(got) / len(got)
    folds.unpersist()
    return max(sorted(scores), key=lambda c: scores[c])


def nested_evaluation(df: DataFrame, features: str, label: str, key: str, costs: Sequence[float] = COSTS, limit_positives: int | None = None, path: str | None = None) -> DataFrame:
    """Each positive held out once, with a fixed share of the negatives: (key, y_true, y_score).

    A held-out negative's score is its mean over the outer folds.  Each fold's predictions are a
    table; under ``path`` a later call goes on behind the folds that are there (made under the same
    parameters).  ``limit_positives`` is for trial runs: the first so many positives by key.
    """
    parts = split_negatives(df, label, key, TEST, SEED).cache()
    positives = parts.where(F.col(label)).select(key).orderBy(key)
    positives = [r[0] for r in (positives.limit(limit_positives) if limit_positives else positives).collect()]
    held = parts.where("part = 'test'")
    stages, out = Stages(df.sparkSession, "folds"), None

    def fold(p) -> DataFrame:
        train = parts.where((F.col("part") == "train") | (F.col(label) & (F.col(key) != p)))
        model = fit_logistic(train, features, label, best_cost(train, features, label, key, costs))
        return predict(model, held.unionByName(parts.where(F.col(key) == p)), features).select(key, F.col(label).cast("int").alias("y_true"), "y_score")

    for p in positives:
        if path:
            config = {"positive": str(p), "features": features, "label": label, "costs": list(costs)}
            got = sinks.resume_stage(df.sparkSession, f"{path}/{hashlib.sha256(str(p).encode()).hexdigest()[:24]}", config, partial(fold, p))
        else:
            got = stages.save(fold(p), "fold")
        out = got if out is None else out.unionByName(got)
    parts.unpersist()
    if out is None:
        return held.limit(0).select(key, F.col(label).cast("int").alias("y_true"), F.lit(0.0).alias("y_score"))
    return out.groupBy(key, "y_true").agg(F.avg("y_score").alias("y_score"))


def pool_bags(instances: DataFrame, key: str = "user_url", vector: str = "vector") -> DataFrame:
    """A bag's vector is the exact mean of its instances', whatever the chunks they are read in."""
    return vector_means(instances, key, vector)


def bag_classifier(bags: DataFrame, labels: DataFrame, label: str, k: int = 5, cost: float = 1.0, key: str = "user_url") -> DataFrame:
    """Out-of-fold scores of pooled bags: (key, fold, y_true, y_score)."""
    rows = stratified_folds(bags.join(labels.select(key, label), key), label, key, k, SEED).cache()
    out = None
    for f in range(k):
        model = fit_logistic(rows.where(F.col("fold") != f), "mean", label, cost)
        got = predict(model, rows.where(F.col("fold") == f), "mean").select(key, "fold", F.col(label).cast("int").alias("y_true"), "y_score")
        out = got if out is None else out.unionByName(got)
    return out
