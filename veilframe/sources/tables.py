"""Titles, public profiles and census-style tables."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veilframe.functions.features import parse_year
from veilframe.schema import TITLES, require_columns


def _whole_lines(spark: SparkSession, path: str, encoding: str = "ISO-8859-1") -> DataFrame:
    return spark.read.schema("line string").csv(path, encoding=encoding, sep="\u0001", quote="", escape="")


def read_titles(spark: SparkSession, path: str) -> DataFrame:
    """movie_id, year (null if not a number), title with its commas. Blank lines, the heading and lines of fewer than three parts
    are left out."""
    part = lambda k: F.regexp_extract("line", "^([^,]*),([^,]*),(.*)$", k)
    rows = _whole_lines(spark, path).where(F.rlike("line", F.lit("^[^,]*,[^,]*,"))).where(F.trim(part(1)).try_cast("int").isNotNull())
    return rows.select(
        F.trim(part(1)).cast("int").alias("movie_id"),
        F.when(F.rlike(F.trim(part(2)), F.lit("^[0-9]+$")), F.trim(part(2))).try_cast("int").alias("year"),
        F.trim(part(3)).alias("title"),
    ).to(TITLES)


def read_profile(spark: SparkSession, path: str) -> DataFrame:
    """title, year, user, rating of a ten-star profile; index columns go, rows without title, user or rating too."""
    raw = spark.read.csv(path, header=True, quote='"', escape='"', multiLine=True)
    raw = raw.select(*[c for c in raw.columns if not c.startswith(("Unnamed", "_c"))])
    require_columns(raw, "title", "year", "user", "rating")
    rows = raw.select("title", parse_year(F.col("year")).alias("year"), "user", F.trim("rating").try_cast("double").alias("rating"))
    return rows.na.drop(subset=["title", "user", "rating"])


def names_schema(text: str) -> T.StructType:
    """The columns that a `.names` file lists as `name: continuous.` or `name: a, b, c.`, with a label at the end."""
    fields = []
    for name, kind in re.findall(r"(?m)^([A-Za-z][\w-]*):\s*(.+?)\.?\s*$", text):
        fields.append(T.StructField(name, T.DoubleType() if kind == "continuous" else T.StringType()))
    return T.StructType([*fields, T.StructField("label", T.StringType())])


def read_census(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """CSV with blanks after commas; `?` is null; labels lose a full stop at the end."""
    rows = spark.read.schema(schema).csv(path, ignoreLeadingWhiteSpace=True, ignoreTrailingWhiteSpace=True, nullValue="?", comment="|")
    label = schema.fieldNames()[-1]
    return rows.where(F.col(label).isNotNull()).withColumn(label, F.rtrim(F.col(label), F.lit(".")))


def read_people(spark: SparkSession, path: str, text_columns=("Zip",)) -> DataFrame:
    """CSV in which the named columns stay text, so that leading zeros survive."""
    head = spark.read.csv(path, header=True).columns
    typed = spark.read.csv(path, header=True, inferSchema=True).schema
    fields = [T.StructField(c, T.StringType() if c in text_columns else typed[c].dataType) for c in head]
    return spark.read.schema(T.StructType(fields)).csv(path, header=True)
