"""Scalar functions and derived columns of ratings, titles and profiles."""

from __future__ import annotations

import re
import unicodedata

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veilframe.schema import normalized_ratings

UNKNOWN = "unknown"


def rating_bucket(rating: Column) -> Column:
    """Up to 2 disliked, from 4 liked, else (null too) neutral."""
    return F.when(rating <= 2, "disliked").when(rating >= 4, "liked").otherwise("neutral")


def bucket_midpoint(rating: Column) -> Column:
    return F.when(rating <= 2, 1.5).when(rating >= 4, 4.5).otherwise(3.0)


def with_features(df: DataFrame) -> DataFrame:
    """Add month, year, rating_bucket and rating_bucket_midpoint.

    With a date, month and year follow it (null where it isn't a date). With a month only, null becomes 'unknown' and the year is
    read from it. With neither, month is 'unknown' and year null.
    """
    df = normalized_ratings(df)
    if "date" in df.columns:
        date = F.expr("try_to_date(cast(date as string))")
        df = df.withColumn("month", F.date_format(date, "yyyy-MM")).withColumn("year", F.year(date))
    elif "month" in df.columns:
        df = df.withColumn("month", F.coalesce(F.col("month").cast("string"), F.lit(UNKNOWN)))
        df = df.withColumn("year", F.year(F.expr("try_to_date(concat(month, '-01'))")))
    else:
        df = df.withColumn("month", F.lit(UNKNOWN)).withColumn("year", F.lit(None).cast("int"))
    return df.withColumn("rating_bucket", rating_bucket(F.col("rating"))).withColumn(
        "rating_bucket_midpoint", bucket_midpoint(F.col("rating"))
    )


def clipped(value: Column, low: float = 1.0, high: float = 5.0) -> Column:
    """least and greatest skip nulls, so a null is kept apart."""
    return F.when(value.isNotNull(), F.greatest(F.lit(low), F.least(F.lit(high), value)))


def expected_stars(ten: Column) -> Column:
    """A ten-star rating on the five-star scale."""
    return clipped(ten / 2)


def star_bounds(ten: Column) -> tuple[Column, Column]:
    e = expected_stars(ten)
    return F.greatest(F.floor(e), F.lit(1)).cast("int"), F.least(F.ceil(e), F.lit(5)).cast("int")


def legacy_star_bounds(ten: Column) -> tuple[Column, Column]:
    """Halves rounded down and up, without clipping."""
    whole = F.floor(ten / 2).cast("int")
    return whole, whole + F.when(ten % 2 != 0, 1).otherwise(0)


def parse_year(text: Column) -> Column:
    """The first four digits in a row."""
    return F.nullif(F.regexp_extract(text.cast("string"), r"([0-9]{4})", 1), F.lit("")).try_cast("int")


_TOKEN = re.compile("[a-z0-9]+")
_ARTICLES = ("a", "an", "the")


def normalize_title_text(title: str | None) -> str:
    plain = unicodedata.normalize("NFKD", title or "").encode("ascii", "ignore").decode().lower().replace("&", " and ")
    tokens = _TOKEN.findall(plain)
    return " ".join(tokens[1:] if tokens and tokens[0] in _ARTICLES else tokens)


def normalize_title(title: Column) -> Column:
    """Lower-case ASCII tokens without one leading article. Plain ASCII titles stay in the JVM; others go through Arrow."""
    tokens = F.regexp_extract_all(F.replace(F.lower(title), F.lit("&"), F.lit(" and ")), F.lit("[a-z0-9]+"), F.lit(0))
    short = F.when(F.get(tokens, F.lit(0)).isin(*_ARTICLES), F.slice(tokens, F.lit(2), F.greatest(F.size(tokens) - 1, F.lit(0)))).otherwise(tokens)
    wide = F.pandas_udf(lambda s: s.map(normalize_title_text), "string")
    return F.when(title.isNull(), "").when(F.rlike(title, F.lit(r"^[\x00-\x7F]*$")), F.array_join(short, " ")).otherwise(wide(title))


def user_equals(column: str, name: str) -> Column:
    return F.lower(F.col(column)) == name.lower()


def user_contains(column: str, part: str) -> Column:
    return F.coalesce(F.contains(F.col(column), F.lit(part)), F.lit(False))


def label_bit(text: Column) -> Column:
    """0 for labels that begin with '<', else 1."""
    return F.when(F.startswith(F.trim(text), F.lit("<")), 0).otherwise(1)


def mapped(column: Column, names: dict) -> Column:
    """Relabel by a dictionary; values that it lacks stay."""
    pairs = [F.lit(x) for kv in names.items() for x in kv]
    return F.coalesce(F.create_map(*pairs)[column], column)


def _cuts(values: DataFrame, column: str, parts: int) -> list:
    """Bounds that cut a numeric column into at most `parts` runs of near-equal numbers of rows."""
    at = values.agg(F.percentile_approx(column, [k / parts for k in range(1, parts)], 10_000).alias("at")).first()["at"]
    return sorted(set(at or []))


def prefix_sums(values: DataFrame, column: str, weight: str, name: str, parts: int = 256) -> DataFrame:
    """Add the sum of `weight` over all rows up to and with this one, in order of a numeric column of distinct values: sums inside
    cuts, plus offsets of at most `parts` cuts."""
    bounds = F.array(*[F.lit(b) for b in _cuts(values, column, parts)])
    if not isinstance(values.schema[column].dataType, T.NumericType):
        raise TypeError(f"{column} must be numeric")
    cut = values.withColumn("_cut", F.size(F.filter(bounds.cast(T.ArrayType(values.schema[column].dataType)), lambda b: b < F.col(column))))
    sizes = cut.groupBy("_cut").agg(F.sum(weight).alias("_n"))
    upto = Window.orderBy("_cut").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("_cut", F.coalesce(F.sum("_n").over(upto), F.lit(0)).alias("_before"))
    inside = F.sum(weight).over(Window.partitionBy("_cut").orderBy(column))
    return cut.withColumn("_inside", inside).join(F.broadcast(offsets), "_cut").withColumn(name, F.col("_before") + F.col("_inside")).drop("_cut", "_inside", "_before")


def least_rows(df: DataFrame, n: int, draw: Column, tie: Column) -> Column:
    """A condition that holds for the n rows of least (draw, tie), and for rows that equal the last of these. draw: whole numbers from 0
    below 2**32. The edge is found from two histograms of 65,536 cells; only rows with the very draw of the edge are sorted."""
    marked = df.select(draw.alias("_h"), tie.alias("_k"))
    low, left = 0, n
    for shift in (16, 0):
        inside = marked if shift else marked.where(F.col("_h").between(low, low + (1 << 16) - 1))
        cells = inside.groupBy(F.expr(f"_h >> {shift}").alias("c")).agg(F.count(F.lit(1)).alias("n")).collect()  # 65,536 rows at most
        for cell in sorted(cells, key=lambda r: r["c"]):
            if cell["n"] >= left:
                low = cell["c"] << shift
                break
            left -= cell["n"]
        else:
            return F.lit(True)
    edge = marked.where(F.col("_h") == low).orderBy("_k").limit(left).agg(F.max("_k")).first()[0]
    return (draw < low) | ((draw == low) & (tie <= F.lit(edge)))


def dense_codes(df: DataFrame, column: str, name: str = "code") -> DataFrame:
    """(column, code): codes from 0 in order of value, without one task for all values."""
    values = df.select(column).where(F.col(column).isNotNull()).distinct()
    return dense_index(values, column, name)


def dense_index(values: DataFrame, column: str, name: str, buckets: int = 1024) -> DataFrame:
    """Positions from 0 in order of a whole-number column of distinct values: ranks inside even cuts of its span, plus offsets
    of at most `buckets` cuts."""
    ends = values.agg(F.min(column).alias("_lo"), F.max(column).alias("_hi"))
    cut = values.join(F.broadcast(ends)).withColumn(
        "_cut", F.floor((F.col(column) - F.col("_lo")).cast("double") * buckets / (F.col("_hi") - F.col("_lo") + 1)).cast("int")
    )
    sizes = cut.groupBy("_cut").agg(F.count(F.lit(1)).alias("_n"))
    upto = Window.orderBy("_cut").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("_cut", F.coalesce(F.sum("_n").over(upto), F.lit(0)).alias("_before"))
    rank = F.row_number().over(Window.partitionBy("_cut").orderBy(column)) - 1
    return (
        cut.withColumn("_rank", rank)
        .join(F.broadcast(offsets), "_cut")
        .withColumn(name, F.col("_before") + F.col("_rank"))
        .drop("_cut", "_lo", "_hi", "_rank", "_before")
    )
