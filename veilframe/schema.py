"""Schemas, and checks that run when a plan is built rather than when it runs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

RATINGS = T.StructType(
    [
        T.StructField("movie_id", T.IntegerType()),
        T.StructField("customer_id", T.IntegerType()),
        T.StructField("rating", T.ByteType()),
        T.StructField("date", T.StringType()),
    ]
)
PAIRS = T.StructType([T.StructField("movie_id", T.IntegerType()), T.StructField("customer_id", T.IntegerType())])
TITLES = T.StructType(
    [T.StructField("movie_id", T.IntegerType()), T.StructField("year", T.IntegerType()), T.StructField("title", T.StringType())]
)
PROFILE = T.StructType(
    [
        T.StructField("title", T.StringType()),
        T.StructField("year", T.IntegerType()),
        T.StructField("user", T.StringType()),
        T.StructField("rating", T.DoubleType()),
    ]
)


class MissingColumns(ValueError):
    """A table lacks columns that an operator reads."""


def require_columns(df: DataFrame, *names: str) -> DataFrame:
    if missing := [n for n in names if n not in df.columns]:
        raise MissingColumns(f"columns {missing} are missing; there are {df.columns}")
    return df


def normalized_ratings(df: DataFrame, *more: str) -> DataFrame:
    """user_id becomes customer_id where that is absent; NaN becomes null, as Spark orders NaN above every number."""
    if "customer_id" not in df.columns and "user_id" in df.columns:
        df = df.withColumnRenamed("user_id", "customer_id")
    require_columns(df, "customer_id", "movie_id", "rating", *more)
    for f in df.schema.fields:
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            df = df.withColumn(f.name, F.when(~F.isnan(f.name), F.col(f.name)))
    return df


def normalized_titles(df: DataFrame) -> DataFrame:
    if "movie_id" not in df.columns and "id" in df.columns:
        df = df.withColumnRenamed("id", "movie_id")
    return require_columns(df, "movie_id", "title", "year")
