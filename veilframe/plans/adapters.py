"""The test tables read as ratings, titles, profiles and people; the same in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ratings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """customer_id, movie_id, rating, date, row_key: a line of an order is a rating."""
    line, order = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    day = F.col("l_shipdate").cast("date")
    return line.join(order, F.col("l_orderkey") == F.col("o_orderkey")).select(
        F.col("o_custkey").cast("bigint").alias("customer_id"),
        F.col("l_partkey").cast("bigint").alias("movie_id"),
        F.least(F.lit(5), F.greatest(F.lit(1), F.ceil(F.col("l_quantity") / 10))).cast("int").alias("rating"),
        day.alias("date"),
        # the five columns that tell rows apart
        F.concat_ws("|", "l_orderkey", "l_linenumber", "l_partkey", day.cast("string"), (F.col("l_quantity") * 100).cast("bigint")).alias("row_key"),
    )


RATINGS = """ratings AS (
  SELECT CAST(o_custkey AS BIGINT) AS customer_id, CAST(l_partkey AS BIGINT) AS movie_id,
         CAST(LEAST(5, GREATEST(1, CEIL(l_quantity / 10))) AS INT) AS rating, CAST(l_shipdate AS DATE) AS date,
         l_orderkey || '|' || l_linenumber || '|' || l_partkey || '|' || CAST(CAST(l_shipdate AS DATE) AS VARCHAR) || '|'
           || CAST(CAST(l_quantity * 100 AS BIGINT) AS VARCHAR) AS row_key
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
base AS (
  SELECT *, strftime(date, '%Y-%m') AS month, CAST(year(date) AS INT) AS year,
         CASE WHEN rating <= 2 THEN 'disliked' WHEN rating >= 4 THEN 'liked' ELSE 'neutral' END AS rating_bucket,
         CASE WHEN rating <= 2 THEN 1.5E0 WHEN rating >= 4 THEN 4.5E0 ELSE 3.0E0 END AS rating_bucket_midpoint
  FROM ratings)"""


def titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part")
    return part.select(
        F.col("p_partkey").cast("bigint").alias("movie_id"), F.concat("p_name", F.lit(" "), "p_brand").alias("title"), (1950 + F.col("p_size")).cast("int").alias("year")
    )


TITLES = """titles AS (
  SELECT CAST(p_partkey AS BIGINT) AS movie_id, p_name || ' ' || p_brand AS title, CAST(1950 + p_size AS INT) AS year FROM part)"""

#: Whose ratings serve as the public profile.
PERSON = 7


def profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = ratings(spark, sf_dir).where(F.col("customer_id") == PERSON)
    return own.join(titles(spark, sf_dir), "movie_id").select(
        F.concat(F.lit("The "), "title").alias("title"), "year", F.concat(F.lit("user"), F.col("customer_id").cast("string")).alias("user"), (2.0 * F.col("rating")).alias("rating")
    )


PROFILE = f"""profile AS (
  SELECT 'The ' || t.title AS title, t.year, 'user' || r.customer_id AS user, 2.0E0 * r.rating AS rating
  FROM ratings r JOIN titles t USING (movie_id) WHERE r.customer_id = {PERSON})"""


def people(spark: SparkSession, sf_dir: str) -> DataFrame:
    """c_name, nation, segment, balance band."""
    c = table(spark, sf_dir, "customer")
    return c.select("c_name", F.col("c_nationkey").alias("nation"), F.col("c_mktsegment").alias("segment"), F.floor(F.col("c_acctbal") / 100).cast("bigint").alias("band"), "c_acctbal")


PEOPLE = """people AS (
  SELECT c_name, c_nationkey AS nation, c_mktsegment AS segment, CAST(FLOOR(c_acctbal / 100) AS BIGINT) AS band, c_acctbal FROM customer)"""


def draw(seed: int, purpose: str, *key: str) -> str:
    """SQL of hashing.draw."""
    text = " || '|' || ".join([f"'{seed}|{purpose}'", *[f"CAST({k} AS VARCHAR)" for k in key]])
    return f"CAST('0x' || substr(md5({text}), 1, 8) AS BIGINT)"
