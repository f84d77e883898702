"""The trained classifier: fit, score, evaluate, save and load."""

from __future__ import annotations

from pyspark.ml import Estimator, Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import StandardScaler, StringIndexer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def class_weights(rows: DataFrame, label: str = "label") -> DataFrame:
    """Balanced weights n / (k * n_c) of each class."""
    counts = rows.groupBy(label).agg(F.count("*").alias("n_class"))
    totals = counts.agg(F.sum("n_class").alias("n"), F.count("*").alias("k"))
    return counts.crossJoin(totals).select(label, "n_class", F.round(F.col("n") / (F.col("k") * F.col("n_class")), 9).alias("class_weight"))  # totals is one row


def fit_classifier(rows: DataFrame, estimator: Estimator | None = None, label: str = "label", features: str = "features") -> PipelineModel:
    """Standardise, then multinomial logistic regression with balanced classes; or an estimator of the caller's.

    Rows need a label and features; fewer than two classes are refused.
    """
    rows = rows.where(F.col(label).isNotNull() & F.col(features).isNotNull())
    weights = class_weights(rows, label)
    n, k = weights.agg(F.sum("n_class"), F.count("*")).first()
    if (k or 0) < 2:
        raise ValueError("at least two classes are needed")
    rows = rows.join(F.broadcast(weights.select(label, "class_weight")), label)  # one row per class
    last = estimator or LogisticRegression(family="multinomial", featuresCol="scaled", labelCol="label_index", weightCol="class_weight", maxIter=1000, standardization=False, regParam=1 / n)
    stages = [StringIndexer(inputCol=label, outputCol="label_index", stringOrderType="alphabetAsc"), StandardScaler(inputCol=features, outputCol="scaled", withMean=True), last]
    rows = rows.cache()
    try:
        return Pipeline(stages=stages).fit(rows)
    finally:
        rows.unpersist()


def classes_of(model: PipelineModel) -> list[str]:
    return list(model.stages[0].labels)


def score_classifier(rows: DataFrame, model: PipelineModel) -> DataFrame:
    """rows with predicted type, confidence and the classes' probabilities of 4 decimals; the first of equals wins."""
    labels = F.array(*map(F.lit, classes_of(model)))
    scaled = PipelineModel(model.stages[1:]).transform(rows)
    p = F.transform(vector_to_array("probability"), lambda x: F.bround(x, 4))
    got = scaled.withColumn("_p", p).withColumn("notification_type", F.element_at(labels, F.array_position("_p", F.array_max("_p")).cast("int")))
    got = got.withColumn("confidence", F.array_max("_p")).withColumn("all_probabilities", F.map_from_arrays(labels, F.col("_p")))
    return got.drop("_p", "scaled", "rawPrediction", "probability", "prediction")


def certificate(rows: DataFrame, model: PipelineModel, label: str = "label", features: str = "features") -> DataFrame:
    """(label, feature, gradient, n) of a model of fit_classifier over the rows it was fitted on: zero everywhere at the optimum.

    The mean loss of balanced classes plus the penalty, differentiated by each coefficient;
    probabilities are computed anew from coefficients and standardised features, in
    expressions, and summed in one aggregate. n is the number of rows of the class.
    """
    rows = rows.where(F.col(label).isNotNull() & F.col(features).isNotNull())
    weights = class_weights(rows, label)
    n = weights.agg(F.sum("n_class")).first()[0]
    last, names = model.stages[2], classes_of(model)
    scaled = vector_to_array(F.col("scaled"))
    rows = model.stages[1].transform(rows).join(F.broadcast(weights.select(label, "class_weight")), label).select(label, "class_weight", scaled.alias("x"))  # a row for each class
    margin = [F.aggregate(F.zip_with("x", F.array(*map(F.lit, last.coefficientMatrix.toArray()[k].tolist())), lambda a, b: a * b), F.lit(float(last.interceptVector[k])), lambda s, v: s + v) for k in range(len(names))]
    rows = rows.withColumn("m", F.array(*margin))
    rows = rows.withColumn("e", F.transform("m", lambda v: F.exp(v - F.array_max("m")))).withColumn("all", F.aggregate("e", F.lit(0.0), lambda s, v: s + v))
    width = len(last.coefficientMatrix.toArray()[0])
    off = lambda k: F.col("class_weight") * (F.col("e")[k] / F.col("all") - (F.col(label) == names[k]).cast("double"))
    sums = rows.agg(F.sum("class_weight").alias("w"), *(F.sum(off(k) * F.col("x")[j]).alias(f"g{k}_{j}") for k in range(len(names)) for j in range(width)), *(F.count_if(F.col(label) == name).alias(f"n{k}") for k, name in enumerate(names)))
    penalty = lambda k, j: F.lit(float(last.coefficientMatrix.toArray()[k][j]) / n)  # noqa: E731  regParam is 1 / n
    cells = F.array(*(F.struct(F.lit(names[k]).alias("label"), F.lit(j).cast("long").alias("feature"), (F.col(f"g{k}_{j}") / F.col("w") + penalty(k, j)).alias("gradient"), F.col(f"n{k}").alias("n")) for k in range(len(names)) for j in range(width)))
    return sums.select(F.inline(cells))


def sensitivity(rows: DataFrame, predicted: str, actual: str) -> DataFrame:
    """Sensitivity with its normal 95 % interval, of boolean columns."""
    hits, all_ = F.count_if(F.col(predicted) & F.col(actual)), F.count_if(F.col(actual))
    got = rows.agg(hits.alias("true_positives"), all_.alias("positives"))
    p = F.try_divide(F.col("true_positives"), F.col("positives"))
    half = 1.96 * F.sqrt(F.try_divide(p * (1 - p), F.col("positives")))
    return got.select("true_positives", "positives", F.round(p, 6).alias("sensitivity"), F.round(p - half, 6).alias("ci_low"), F.round(p + half, 6).alias("ci_high"))


def save(model: PipelineModel, path: str, uses_embedding: bool = False) -> None:
    """The model and, beside it, a row of metadata."""
    model.write().overwrite().save(f"{path}/model")
    SparkSession.active().createDataFrame([(classes_of(model), uses_embedding)], "classes array<string>, uses_embedding boolean").coalesce(1).write.mode("overwrite").json(f"{path}/metadata")


def load(spark, path: str) -> tuple[PipelineModel, dict]:
    return PipelineModel.load(f"{path}/model"), spark.read.schema("classes array<string>, uses_embedding boolean").json(f"{path}/metadata").first().asDict()
