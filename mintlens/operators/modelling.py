"""Training, comparing and applying classifiers of the damaged label with pyspark.ml."""

from __future__ import annotations

from collections.abc import Sequence
from concurrent.futures import ThreadPoolExecutor
from functools import reduce

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import Imputer, StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .profiling import binary_metrics, confusion, ranked_models, stratified, validated


def balanced(df: DataFrame, target: str, weight: str = "weight") -> DataFrame:
    """``df`` with a weight that gives both classes the same total; one row of counts a class is broadcast."""
    n = df.groupBy(target).agg(F.count(F.lit(1)).alias("__n"))
    total = n.agg(F.sum("__n").alias("__all"), F.count(F.lit(1)).alias("__k"))
    sized = n.join(F.broadcast(total)).select(target, (F.col("__all") / (F.col("__k") * F.col("__n"))).alias(weight))
    return df.join(F.broadcast(sized), target)


def pipeline(kind: str, features: Sequence[str], target: str = "target_damaged", weight: str | None = None, seed: int = 42, **options) -> Pipeline:
    """Median imputation and one of three classifiers: "linear" (scaled), "forest" or "boosting".  ``options`` override its parameters."""
    filled = [f"__f_{k}" for k in range(len(features))]
    steps = [Imputer(strategy="median", inputCols=list(features), outputCols=filled), VectorAssembler(inputCols=filled, outputCol="__x", handleInvalid="keep")]
    common = {"labelCol": target} | ({"weightCol": weight} if weight else {})
    if kind == "linear":
        steps.append(StandardScaler(withMean=True, inputCol="__x", outputCol="__z"))
        steps.append(LogisticRegression(featuresCol="__z", **(common | {"maxIter": 200} | options)))
    elif kind == "forest":
        steps.append(RandomForestClassifier(featuresCol="__x", seed=seed, **(common | {"numTrees": 400, "minInstancesPerNode": 2, "maxDepth": 12} | options)))
    elif kind == "boosting":
        steps.append(GBTClassifier(featuresCol="__x", seed=seed, **(common | {"stepSize": 0.05, "maxDepth": 6, "maxIter": 300, "minInstancesPerNode": 20} | options)))
    else:
        raise ValueError(f"no such model: {kind}")
    return Pipeline(stages=steps)


def predict(model: PipelineModel, df: DataFrame, target: str = "target_damaged") -> DataFrame:
    """``df`` with y_pred, y_prob_damaged, confidence (of the class predicted) and label."""
    p = vector_to_array("probability")
    out = model.transform(df).select(*df.columns, F.col("prediction").cast("int").alias("y_pred"), p[1].alias("y_prob_damaged"), F.greatest(p[0], p[1]).alias("confidence"))
    return out.withColumn("label", F.when(F.col("y_pred") == 1, "damaged").otherwise("undamaged"))


def evaluate(predictions: DataFrame, target: str = "target_damaged") -> DataFrame:
    """One row of the five metrics."""
    return binary_metrics(confusion(predictions, target))


def cross_validated(df: DataFrame, key: str, features: Sequence[str], models: dict[str, dict], target: str = "target_damaged", folds: int = 5, at_once: int = 4) -> DataFrame:
    """rank, model and the mean over stratified folds of the five metrics, the best first: by f1, recall, balanced accuracy.

    ``at_once`` fits run side by side.  The predictions of all models and folds are one table, from which one aggregate
    takes all metrics.
    """
    d = stratified(df, key, target, folds=folds).persist()

    def predicted(name: str, k: int) -> DataFrame:
        options = models[name]
        fitted = pipeline(options.get("kind", name), features, target, **{x: y for x, y in options.items() if x != "kind"}).fit(d.where(F.col("fold") != k))
        return predict(fitted, d.where(F.col("fold") == k), target).select(F.lit(name).alias("model"), F.lit(k).alias("fold"), F.col(target).alias("target"), "y_pred")

    with ThreadPoolExecutor(at_once) as pool:
        made = list(pool.map(lambda x: predicted(*x), [(name, k) for name in models for k in range(folds)]))
    table = ranked_models(validated(reduce(DataFrame.unionByName, made))).orderBy("rank").persist()
    table.count()
    d.unpersist()
    return table


def train_best(df: DataFrame, key: str, features: Sequence[str], models: dict[str, dict], path: str, target: str = "target_damaged", folds: int = 5) -> DataFrame:
    """The table of ``cross_validated``; the model at its head is fitted on all rows and saved with it below ``path``."""
    table = cross_validated(df, key, features, models, target, folds)
    name = table.first()["model"]
    options = dict(models[name])
    save(pipeline(options.pop("kind", name), features, target, **options).fit(df), table, features, path)
    return table


def predict_if_available(df: DataFrame, path: str, target: str = "target_damaged") -> DataFrame:
    """``df`` with the columns of ``predict`` by the model saved below ``path``, and available and reason.

    Where no model can be read, available is false, reason says why, and the predictions are null.
    """
    try:
        model, features = load(df.sparkSession, path)
    except Exception as e:  # whatever keeps a model from loading is the reason
        empty = {"y_pred": "int", "y_prob_damaged": "double", "confidence": "double", "label": "string"}
        return df.withColumns({c: F.lit(None).cast(t) for c, t in empty.items()} | {"available": F.lit(False), "reason": F.lit(f"{type(e).__name__}: {str(e).splitlines()[0]}")})
    missing = [c for c in features if c not in df.columns]
    full = df.withColumns({c: F.lit(0.0) for c in missing})
    return predict(model, full, target).drop(*missing).withColumns({"available": F.lit(True), "reason": F.lit(None).cast("string")})


def save(model: PipelineModel, metrics: DataFrame, features: Sequence[str], path: str) -> None:
    """The model, its metrics and the names of its inputs, in three folders below ``path``."""
    spark = metrics.sparkSession
    model.write().overwrite().save(f"{path}/model")
    metrics.write.mode("overwrite").json(f"{path}/metrics")
    spark.createDataFrame([(k, n) for k, n in enumerate(features)], "position int, name string").coalesce(1).write.mode("overwrite").json(f"{path}/features")


def load(spark, path: str) -> tuple[PipelineModel, list[str]]:
    names = spark.read.schema("position int, name string").json(f"{path}/features").orderBy("position").collect()
    return PipelineModel.load(f"{path}/model"), [r.name for r in names]
