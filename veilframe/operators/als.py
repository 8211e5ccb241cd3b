"""Matrix factorisation, and what item factors say about privacy."""

from __future__ import annotations

from pyspark.ml.recommendation import ALS
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilframe.functions.features import clipped, prefix_sums
from veilframe.operators.bias import BiasModel, evaluate, fit_bias, predict_bias
from veilframe.operators.item_knn import collapsed, residuals
from veilframe.session import checkpoint_folder


def als_model(rows: DataFrame, value: str, rank: int = 40, iterations: int = 10, reg: float = 0.1, seed: int = 333):
    """Item factors are written to the checkpoint folder at every iteration, which then deletes what it shuffled: an iteration sends each
    factor to every block that needs it, many times the ratings, and the files of all iterations would pile up otherwise."""
    checkpoint_folder(rows.sparkSession)
    return ALS(
        userCol="customer_id", itemCol="movie_id", ratingCol=value, rank=rank, maxIter=iterations, regParam=reg, seed=seed, nonnegative=False, coldStartStrategy="nan",
        checkpointInterval=1,
    ).fit(rows.select(F.col("customer_id").cast("int"), F.col("movie_id").cast("int"), F.col(value).cast("float").alias(value)))


def fit_als(train: DataFrame, baseline: BiasModel, **options):
    """Factors of the residuals of a baseline."""
    return als_model(residuals(train, baseline), "res", **options)


def predict_als(model, baseline: BiasModel, pairs: DataFrame) -> DataFrame:
    """pairs with prediction; unknown users and items, and values that aren't finite, add nothing to the baseline."""
    base = predict_bias(baseline, pairs, "_base")
    asked = pairs.select(F.col("customer_id").cast("int"), F.col("movie_id").cast("int")).distinct()
    got = model.transform(asked).select("customer_id", "movie_id", F.when(~F.isnan("prediction"), F.col("prediction").cast("double")).alias("_res"))
    joined = base.join(got, ["customer_id", "movie_id"], "left")
    return joined.withColumn("prediction", clipped(F.col("_base") + F.coalesce("_res", F.lit(0.0)))).drop("_base", "_res")


def als_fit_predict(rank: int = 40, iterations: int = 10, reg: float = 0.1, epochs: int = 6):
    def run(train: DataFrame, test: DataFrame) -> DataFrame:
        baseline = fit_bias(train, "rating", epochs)
        return predict_als(fit_als(train, baseline, rank=rank, iterations=iterations, reg=reg), baseline, test)

    return run


def raw_als_metrics(train: DataFrame, test: DataFrame, rank: int = 32, iterations: int = 10, reg: float = 0.08) -> DataFrame:
    """Errors of factors of the ratings themselves; pairs that the model doesn't know leave the test set."""
    model = als_model(collapsed(train), "rating", rank, iterations, reg)
    got = model.transform(test.select(F.col("customer_id").cast("int"), F.col("movie_id").cast("int"), "rating"))
    return evaluate(got.where(~F.isnan("prediction")).withColumn("prediction", clipped(F.col("prediction").cast("double"))))


def average_rank_share(df: DataFrame, column: str, name: str) -> DataFrame:
    """Add the average rank of a value over the number of rows (ties share the mean of their ranks)."""
    sizes = df.groupBy(column).agg(F.count(F.lit(1)).alias("_n"))
    total = sizes.agg(F.sum("_n").alias("_all"))
    ranks = prefix_sums(sizes, column, "_n", "_upto").join(F.broadcast(total))
    share = (F.col("_upto") - (F.col("_n") - 1) / 2.0) / F.col("_all")
    return df.join(ranks.select(column, share.alias(name)), column)


def privacy_weights(leverage: DataFrame) -> DataFrame:
    """(movie_id, leverage_pct, popularity_pct, privacy_weight). leverage: movie_id, norm, count."""
    latent = leverage.withColumn("latent_leverage", F.col("norm") / F.sqrt(F.greatest(F.col("count"), F.lit(1)).cast("double")))
    ranked = average_rank_share(average_rank_share(latent, "latent_leverage", "leverage_pct"), "count", "popularity_pct")
    return ranked.withColumn("privacy_weight", 0.65 * F.col("leverage_pct") + 0.35 * (1 - F.col("popularity_pct")))


def factor_diagnostics(model, ratings: DataFrame, titles: DataFrame | None = None) -> DataFrame:
    """Item factors' norm, leverage, counts, mean ratings, privacy weight and (with titles) names."""
    norm = F.sqrt(F.aggregate(F.transform("features", lambda x: x.cast("double") * x.cast("double")), F.lit(0.0), lambda a, x: a + x))
    factors = model.itemFactors.select(F.col("id").alias("movie_id"), norm.alias("norm"))
    counts = ratings.groupBy(F.col("movie_id").cast("int").alias("movie_id")).agg(F.count(F.lit(1)).alias("count"), F.avg("rating").alias("mean_rating"))
    out = privacy_weights(factors.join(counts, "movie_id"))
    return out.join(titles.select(F.col("movie_id").cast("int").alias("movie_id"), "title", "year"), "movie_id", "left") if titles is not None else out


def tune(train: DataFrame, ranks=(10, 40, 70), regs=(0.05, 0.1, 0.15), iterations=(5, 10), train_share: float = 0.8, seed: int = 333):
    """The best model of a grid, by RMSE on a held-out share."""
    from pyspark.ml.evaluation import RegressionEvaluator
    from pyspark.ml.tuning import ParamGridBuilder, TrainValidationSplit

    als = ALS(userCol="customer_id", itemCol="movie_id", ratingCol="rating", seed=seed, coldStartStrategy="drop")
    grid = ParamGridBuilder().addGrid(als.rank, list(ranks)).addGrid(als.regParam, list(regs)).addGrid(als.maxIter, list(iterations)).build()
    judge = RegressionEvaluator(metricName="rmse", labelCol="rating", predictionCol="prediction")
    rows = collapsed(train).select(F.col("customer_id").cast("int"), F.col("movie_id").cast("int"), F.col("rating").cast("float"))
    return TrainValidationSplit(estimator=als, estimatorParamMaps=grid, evaluator=judge, trainRatio=train_share, seed=seed).fit(rows)
