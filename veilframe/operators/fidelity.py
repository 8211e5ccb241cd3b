"""Profiles of tables, histograms and their divergence, and checks of synthetic rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilframe.session import shuffles_deleted


def dataset_profile(df: DataFrame) -> DataFrame:
    """One row: rows, users, movies, months, mean_rating, median_history, median_popularity."""
    per_user = df.groupBy("customer_id").agg(F.count(F.lit(1)).alias("n")).agg(F.median("n").alias("median_history"))
    per_movie = df.groupBy("movie_id").agg(F.countDistinct("customer_id").alias("n")).agg(F.median("n").alias("median_popularity"))
    whole = df.agg(
        F.count(F.lit(1)).alias("rows"),
        F.countDistinct("customer_id").alias("users"),
        F.countDistinct("movie_id").alias("movies"),
        F.countDistinct("month").alias("months"),
        F.avg("rating").alias("mean_rating"),
    )
    return whole.join(F.broadcast(per_user)).join(F.broadcast(per_movie))


def histogram(df: DataFrame, column: str) -> DataFrame:
    """(value, share), nulls being a value."""
    total = df.agg(F.count(F.lit(1)).alias("_all"))
    return df.groupBy(F.col(column).alias("value")).agg(F.count(F.lit(1)).alias("_n")).join(F.broadcast(total)).select("value", (F.col("_n") / F.col("_all")).alias("share"))


def js_divergence(a: DataFrame, b: DataFrame, column: str) -> DataFrame:
    """One row: the Jensen-Shannon divergence, in bits, of the two histograms."""
    eps = 1e-12
    p, q = histogram(a, column).withColumnRenamed("share", "p"), histogram(b, column).select(F.col("value").alias("_v"), F.col("share").alias("q"))
    both = p.join(q, F.col("value").eqNullSafe(F.col("_v")), "full_outer").select(F.coalesce("p", F.lit(0.0)).alias("p"), F.coalesce("q", F.lit(0.0)).alias("q"))
    mid = (F.col("p") + F.col("q")) / 2
    part: list[Column] = [F.col(x) * F.log2((F.col(x) + eps) / (mid + eps)) for x in ("p", "q")]
    return both.agg((0.5 * F.sum(part[0]) + 0.5 * F.sum(part[1])).alias("js_divergence"))


def clipped_histories(df: DataFrame, top: float | None = 0.99, fixed: int | None = None) -> DataFrame:
    """(customer_id, history): rows of each user, cut off at a percentile or a fixed number."""
    sizes = df.groupBy("customer_id").agg(F.count(F.lit(1)).alias("history"))
    if fixed is not None:
        return sizes.withColumn("history", F.least("history", F.lit(fixed)))
    edge = sizes.agg(F.percentile("history", F.lit(top)).alias("_edge"))
    return sizes.join(F.broadcast(edge)).select("customer_id", F.least(F.col("history").cast("double"), "_edge").alias("history"))


def synthetic_checks(synthetic: DataFrame, real: DataFrame, categorical=("movie_id", "month"), numeric=("rating",), key: str | None = None) -> DataFrame:
    """(check, column, share): values in range, values that the real table has, and keys that occur once."""
    spark, rows = real.sparkSession, []
    with shuffles_deleted(spark):
        n = max(1, synthetic.count())
        for c in numeric:
            lo, hi = real.agg(F.min(c), F.max(c)).first()
            rows.append(("in_range", c, synthetic.where(F.col(c).between(lo, hi)).count() / n))
        for c in categorical:  # values meet, not rows
            sizes = synthetic.groupBy(c).agg(F.count(F.lit(1)).alias("_n"))
            rows.append(("known_value", c, (sizes.join(real.select(c).distinct(), c, "left_semi").agg(F.sum("_n")).first()[0] or 0) / n))
        if key:
            rows.append(("unique_key", key, synthetic.groupBy(key).count().where("count = 1").count() / n))
    return spark.createDataFrame(rows, "check string, column string, share double")
