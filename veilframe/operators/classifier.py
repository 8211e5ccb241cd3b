"""A tabular classifier: one-hot categories and standardised numbers into a logistic regression."""

from __future__ import annotations

from pyspark.ml import Pipeline
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import OneHotEncoder, StandardScaler, StringIndexer, VectorAssembler
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilframe.functions.hashing import below


def census_classifier(df: DataFrame, categories: list[str], numbers: list[str], label: str, seed: int = 333, test_share: float = 0.3) -> DataFrame:
    """(kind, name, value): accuracy and precision on held-out rows, and a coefficient for each feature."""
    spark = df.sparkSession
    rows = df.select(*categories, *[F.col(n).cast("double").alias(n) for n in numbers], F.col(label).cast("double").alias("label")).na.drop()
    keyed = rows.withColumn("_test", below(seed, "classifier", test_share, *[F.col(c) for c in rows.columns]))
    stages = [StringIndexer(inputCol=c, outputCol=f"{c}_i", handleInvalid="keep", stringOrderType="alphabetAsc") for c in categories]
    stages += [OneHotEncoder(inputCols=[f"{c}_i" for c in categories], outputCols=[f"{c}_v" for c in categories], dropLast=False)]
    stages += [VectorAssembler(inputCols=numbers, outputCol="_n"), StandardScaler(inputCol="_n", outputCol="_s", withMean=True)]
    stages += [VectorAssembler(inputCols=[f"{c}_v" for c in categories] + ["_s"], outputCol="features"), LogisticRegression(regParam=0.01)]
    model = Pipeline(stages=stages).fit(keyed.where("NOT _test"))
    got = model.transform(keyed.where("_test")).select("label", "prediction")
    hit = F.col("label") == F.col("prediction")
    accuracy, right, said = got.agg(F.avg(hit.cast("double")), F.sum((hit & (F.col("prediction") == 1)).cast("int")), F.sum((F.col("prediction") == 1).cast("int"))).first()
    names = [f"{c}={v}" for c, m in zip(categories, model.stages, strict=False) for v in [*m.labels, "?"]] + numbers
    rows_ = [("metric", "accuracy", accuracy), ("metric", "precision", right / said if said else 0.0)]
    rows_ += [("coefficient", n, float(w)) for n, w in zip(names, model.stages[-1].coefficients.toArray(), strict=False)]
    return spark.createDataFrame(rows_, "kind string, name string, value double")
