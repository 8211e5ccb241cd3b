"""Equivalence classes and quasi-identifiers."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilframe.operators.releases import Release, class_sizes


def fact_k_anonymity(df: DataFrame, cols, user: str = "customer_id") -> DataFrame:
    """One row: fact_count, min_k, median_k, mean_k, pct_unique_facts (nulls for the last four on an empty table)."""
    k = F.col("k")
    return class_sizes(df, list(cols), user).agg(
        F.count(F.lit(1)).alias("fact_count"),
        F.min(k).alias("min_k"),
        F.median(k).alias("median_k"),
        F.avg(k).alias("mean_k"),
        (F.avg(F.when(k == 1, 1.0).otherwise(0.0)) * 100).alias("pct_unique_facts"),
    )


def release_k_anonymity(release: Release) -> DataFrame:
    rows = release.data.agg(F.count(F.lit(1)).alias("rows_released"))
    return fact_k_anonymity(release.data, release.knowledge_cols).join(F.broadcast(rows)).select(
        F.lit(release.name).alias("release_name"),
        F.lit(" + ".join(release.knowledge_cols)).alias("knowledge_cols"),
        "rows_released",
        F.lit(release.rating_col).alias("rating_col"),
        F.lit(release.description).alias("description"),
        "fact_count",
        "min_k",
        "median_k",
        "mean_k",
        "pct_unique_facts",
    )


def fact_index(df: DataFrame, cols, user: str = "customer_id") -> DataFrame:
    """(cols, user), each once: the inverted index as a table."""
    return df.select(*cols, user).distinct()


def full_row_classes(df: DataFrame, cols) -> DataFrame:
    """One row: classes, max, min and mean size of groups of equal rows."""
    sizes = df.groupBy(*cols).agg(F.count(F.lit(1)).alias("n"))
    return sizes.agg(
        F.count(F.lit(1)).alias("classes"), F.max("n").alias("max_size"), F.min("n").alias("min_size"), F.avg("n").alias("mean_size")
    )


def qi_join(left: DataFrame, right: DataFrame, cols) -> DataFrame:
    """Linking by quasi-identifiers; nulls match nothing. Columns of both sides that clash get the suffix _right."""
    named = right.select(*[F.col(c).alias(c if c in cols or c not in left.columns else f"{c}_right") for c in right.columns])
    return left.join(named, list(cols))


def match_count_histogram(people: DataFrame, table: DataFrame, cols) -> DataFrame:
    """(matches, people): how many people have how many matching rows, none included."""
    sizes = table.groupBy(*cols).agg(F.count(F.lit(1)).alias("_n"))
    found = people.join(sizes, list(cols), "left").select(F.coalesce("_n", F.lit(0)).alias("matches"))
    return found.groupBy("matches").agg(F.count(F.lit(1)).alias("people"))


def powerset_reidentification(df: DataFrame, cols) -> DataFrame:
    """(columns, reidentified): for each set of quasi-identifiers, the share of rows that no other row equals, in one CUBE."""
    cols = list(cols)
    total = df.agg(F.count(F.lit(1)).alias("_rows"))
    marks = [F.when(F.grouping(c) == 0, F.when(F.col(c).isNull(), 1).otherwise(0)).otherwise(0) for c in cols]
    cube = df.cube(*cols).agg(
        F.count(F.lit(1)).alias("_n"), F.grouping_id().alias("_set"), reduce(lambda a, b: a + b, marks).alias("_nulls")
    )
    width = len(cols)
    names = F.array_join(F.array_compact(F.array(*[F.when(F.expr(f"(_set & {1 << (width - 1 - i)}) = 0"), F.lit(c)) for i, c in enumerate(cols)])), "+")
    single = F.when((F.col("_n") == 1) & (F.col("_nulls") == 0), 1).otherwise(0)
    return (
        cube.where(F.col("_set") != (1 << width) - 1)
        .groupBy("_set")
        .agg(F.sum(single).alias("_single"))
        .join(F.broadcast(total))
        .select(names.alias("columns"), (F.col("_single") / F.col("_rows")).alias("reidentified"))
    )


def group_means(df: DataFrame, keys, value: str) -> DataFrame:
    """(keys, people, mean, exposed): a group of one gives its member's value away."""
    return (
        df.groupBy(*keys)
        .agg(F.count(F.lit(1)).alias("people"), F.avg(value).alias("mean"))
        .withColumn("exposed", F.col("people") == 1)
    )


def differencing_attack(df: DataFrame, target, value: str) -> DataFrame:
    """One row: sum over all, sum over all but the target, and their difference."""
    return df.agg(
        F.sum(value).alias("sum_all"), F.sum(F.when(target, 0).otherwise(F.col(value))).alias("sum_without")
    ).withColumn("revealed", F.col("sum_all") - F.col("sum_without"))


def inferred_share(people: DataFrame, table: DataFrame, cols, label) -> DataFrame:
    """(cols of people, matches, share): how likely the label is for someone known only by the columns. Both sides are counted before they
    meet, so no pair of a person and a row is made; equal rows of people are one, with the matches of all."""
    own = people.groupBy(*people.columns).agg(F.count(F.lit(1)).alias("_same"))
    sizes = table.groupBy(*cols).agg(F.count(F.lit(1)).alias("_n"), F.avg(label.cast("double")).alias("share"))
    return own.join(sizes, list(cols)).select(*people.columns, (F.col("_same") * F.col("_n")).alias("matches"), "share")


def deidentified(df: DataFrame, names) -> DataFrame:
    return df.drop(*names)


def summary_statistics(df: DataFrame, cols) -> DataFrame:
    return df.select(*cols).summary("count", "mean", "stddev", "min", "50%", "max")
