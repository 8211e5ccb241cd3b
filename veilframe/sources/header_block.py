"""Header-block files: a line `<item>:` gives the item of the lines that follow it in the same file.

Lines are read in splits. Inside a split the item is the last header before a line; lines before a split's first header take the last
header of the splits before it in the same file, found in a table with one row for each split. So a split is the largest
unit of work, not a file.
"""

from __future__ import annotations

import os
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from veilframe.schema import PAIRS, RATINGS


def _lines(spark: SparkSession, files: list[str]) -> DataFrame:
    """(line, file, split, at) of all lines that aren't blank; file: (place in the list, path), so that folders work too."""
    places = [F.lit(x) for i, f in enumerate(files) for x in (os.path.basename(f.rstrip("/")), i)]
    name = F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1)
    lines = spark.read.text(files).select(
        F.trim(F.regexp_replace("value", "\r", "")).alias("line"),
        F.struct(F.coalesce(F.create_map(*places)[F.url_decode(name)], F.lit(0)).alias("place"), F.col("_metadata.file_path").alias("path")).alias("file"),
        F.col("_metadata.file_block_start").alias("split"),
        F.monotonically_increasing_id().alias("at"),
    )
    return lines.where("line <> ''")


def _with_items(lines: DataFrame) -> DataFrame:
    """Add item; headers and lines without one go."""
    header = F.when(F.rlike("line", F.lit("^[0-9]+:$")), F.regexp_extract("line", "^([0-9]+):$", 1).cast("int"))
    marked = lines.withColumn("header", header)
    inside = Window.partitionBy("file", "split").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    filled = marked.withColumn("own", F.last("header", True).over(inside))
    last = marked.groupBy("file", "split").agg(F.max_by("header", F.when(F.col("header").isNotNull(), F.col("at"))).alias("final"))
    before = Window.partitionBy("file").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)
    carried = last.select("file", "split", F.last("final", True).over(before).alias("carried"))
    joined = filled.join(carried, ["file", "split"]).withColumn("item", F.coalesce("own", "carried"))
    return joined.where(F.col("header").isNull() & F.col("item").isNotNull()).select("item", "line", "file", "split", "at")


def _field(k: int) -> Column:
    return F.get(F.split("line", ",", 3), F.lit(k))


def _first(rows: DataFrame, n: int) -> DataFrame:
    """The first n rows in file order: whole splits as far as they go, and the first rows of one more."""
    sizes = rows.groupBy("file", "split").agg(F.count(F.lit(1)).alias("_n"))
    upto = F.sum("_n").over(Window.orderBy("file", "split").rowsBetween(Window.unboundedPreceding, 0))  # a row for each split
    taken = sizes.select("file", "split", "_n", (F.lit(n) - upto + F.col("_n")).alias("_left")).where("_left > 0")
    held = rows.join(taken, ["file", "split"])
    rank = F.row_number().over(Window.partitionBy("file", "split").orderBy("at"))
    cut = held.where("_n > _left").withColumn("_rank", rank).where("_rank <= _left").drop("_rank")
    return held.where("_n <= _left").union(cut).drop("_n", "_left")


def read_ratings(
    spark: SparkSession,
    files: list[str] | str,
    movie_ids: Iterable[int] | None = None,
    exclude_pairs: DataFrame | None = None,
    max_rows: int | None = None,
    include_date: bool = True,
) -> DataFrame:
    """movie_id, customer_id, rating and (by default) date. max_rows counts what passes the filters, in file order."""
    files = [files] if isinstance(files, str) else list(files)
    rows = _with_items(_lines(spark, files)).select(
        F.col("item").alias("movie_id"),
        _field(0).try_cast("int").alias("customer_id"),
        _field(1).try_cast("tinyint").alias("rating"),
        _field(2).alias("date"),
        "file",
        "split",
        "at",
    )
    rows = rows.where(F.col("customer_id").isNotNull())
    if movie_ids is not None:
        rows = rows.where(F.col("movie_id").isin(*movie_ids))
    if exclude_pairs is not None:
        rows = rows.join(exclude_pairs.select("movie_id", "customer_id"), ["movie_id", "customer_id"], "left_anti")
    if max_rows is not None:
        rows = _first(rows, max_rows)
    names = [f.name for f in RATINGS if include_date or f.name != "date"]
    return rows.select(*names)


def read_pairs(spark: SparkSession, files: list[str] | str, max_rows: int | None = None) -> DataFrame:
    """movie_id, customer_id of a file with bare customers under the headers."""
    files = [files] if isinstance(files, str) else list(files)
    rows = _with_items(_lines(spark, files)).select(F.col("item").alias("movie_id"), _field(0).try_cast("int").alias("customer_id"), "file", "split", "at")
    rows = rows.where(F.col("customer_id").isNotNull())
    if max_rows is not None:
        rows = _first(rows, max_rows)
    return rows.select(*PAIRS.names)


def export_ratings(ratings: DataFrame, movies: DataFrame, path: str) -> None:
    """CSV of the ratings of some movies."""
    ratings.join(movies.select("movie_id").distinct(), "movie_id", "left_semi").write.mode("overwrite").csv(path, header=True)
