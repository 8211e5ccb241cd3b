"""Synthetic ratings from a Gaussian copula over categorical codes."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from veilframe.functions.features import clipped, prefix_sums
from veilframe.functions.hashing import TOP, draw
from veilframe.session import checkpointed, discarded, shuffles_deleted

FIRST_USER = 900_000_000
LONGEST = 150
#: Tables of up to this many cells (rows times columns) are broadcast; larger ones are joined by a shuffle.
BROADCAST_CELLS = 4_000_000


def _small(table: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(table) if rows * len(table.columns) <= BROADCAST_CELLS else table


def _intervals(df: DataFrame, column: str) -> DataFrame:
    """(value, low, high, z): values by falling frequency as intervals of [0, 1], and the normal score of the middle."""
    sizes = df.groupBy(column).agg(F.count(F.lit(1)).alias("_n"))
    # values of one frequency are added up by themselves, after all more frequent ones
    levels = sizes.groupBy("_n").agg((F.col("_n") * F.count(F.lit(1))).alias("_level")).withColumn("_key", -F.col("_n"))
    above = prefix_sums(levels, "_key", "_level", "_upto").select("_n", (F.col("_upto") - F.col("_level")).alias("_above"))
    own = F.sum("_n").over(Window.partitionBy("_n").orderBy(column).rowsBetween(Window.unboundedPreceding, 0))
    total = sizes.agg(F.sum("_n").alias("_all"))
    held = sizes.withColumn("_own", own).join(above, "_n").join(F.broadcast(total)).select(F.col(column).alias("value"), (F.col("_above") + F.col("_own")).alias("_up"), "_n", "_all")
    normal = F.pandas_udf(lambda s: s.clip(1e-9, 1 - 1e-9).map(NormalDist().inv_cdf), "double")  # once for each distinct value
    low, high = (F.col("_up") - F.col("_n")) / F.col("_all"), F.col("_up") / F.col("_all")
    return held.select("value", low.alias("low"), high.alias("high"), normal((low + high) / 2).alias("z"))


def gaussian_copula(df: DataFrame, columns=("movie_id", "rating", "month"), rows: int | None = None, seed: int = 333, cells: int = 4096) -> DataFrame:
    """`rows` synthetic rows (as many as df by default) with df's marginals and rank correlations. Draws depend on a row's number
    alone. A column's map of values is written once and broadcast where it is small, so that rows are not shuffled for it."""
    spark, columns = df.sparkSession, list(columns)
    maps = {c: checkpointed(_intervals(df.where(F.col(c).isNotNull()), c)) for c in columns}
    sizes = {c: maps[c].count() for c in columns}
    coded = df.select(*columns)
    for c in sorted(columns, key=sizes.get):
        coded = coded.join(_small(maps[c].select(F.col("value").alias(c), F.col("z").alias(f"_z_{c}")), sizes[c]), c)
    pairs = [(i, j) for i in range(len(columns)) for j in range(i)]

    def alike(a: str, b: str):  # null for a column of one value
        return F.try_divide(F.covar_pop(a, b), F.stddev_pop(a) * F.stddev_pop(b))

    with shuffles_deleted(spark):
        corr = coded.agg(*[alike(f"_z_{columns[i]}", f"_z_{columns[j]}") for i, j in pairs]).first() if pairs else []
    matrix = np.eye(len(columns))
    for (i, j), x in zip(pairs, corr, strict=True):
        matrix[i, j] = matrix[j, i] = 0.0 if x is None or x != x else x
    lower = np.linalg.cholesky(matrix + 1e-9 * np.eye(len(columns)))
    n = df.count() if rows is None else rows
    base = spark.range(n).select("id", *[(draw(seed, f"copula-{c}", "id") + 0.5).alias(f"_h{k}") for k, c in enumerate(columns)])

    def normal(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        dist, cdf = NormalDist(), np.vectorize(NormalDist().cdf)
        inv = np.vectorize(dist.inv_cdf)
        for b in batches:
            g = inv(b.iloc[:, 1:].to_numpy(float) / TOP) @ lower.T
            u = np.clip(cdf(g), 0, 1 - 1e-12)
            yield pd.DataFrame({"id": b["id"], **{f"_u{k}": u[:, k] for k in range(len(columns))}})

    drawn = base.mapInPandas(normal, "id long, " + ", ".join(f"_u{k} double" for k in range(len(columns))))
    for k, c in sorted(enumerate(columns), key=lambda x: sizes[x[1]]):
        n_cells = max(cells, sizes[c])  # a few values in each, however many there are
        at = maps[c].withColumn("_cell", F.explode(F.expr(f"sequence(cast(floor(low * {n_cells}) as int), cast(floor(least(high, 0.9999999999) * {n_cells}) as int))")))
        at = _small(at.select("_cell", F.col("value").alias(c), F.col("low").alias("_lo"), F.col("high").alias("_hi")), sizes[c] + n_cells)
        mine = drawn.withColumn("_cell", F.floor(F.col(f"_u{k}") * n_cells).cast("int"))
        on = (mine["_cell"] == at["_cell"]) & (mine[f"_u{k}"] >= at["_lo"]) & (mine[f"_u{k}"] < at["_hi"])
        drawn = mine.join(at, on).drop("_cell", "_lo", "_hi", f"_u{k}")
    return drawn.select("id", *columns)


def assign_users(synthetic: DataFrame, real: DataFrame, seed: int = 333, longest: int = LONGEST) -> DataFrame:
    """Consecutive rows get one user each time, with as many rows as a real user drawn at random has (cut off at `longest`); ids
    count from 900,000,000. synthetic: has id from 0; it is read more than once. Users are runs of ids, which rows look up."""
    spark = real.sparkSession
    lengths = real.groupBy("customer_id").agg(F.least(F.count(F.lit(1)), F.lit(longest)).alias("_len")).groupBy("_len").agg(F.count(F.lit(1)).alias("_users"))
    ranges = lengths.withColumn("_high", F.sum("_users").over(Window.orderBy("_len"))).withColumn("_low", F.col("_high") - F.col("_users"))
    total = lengths.agg(F.sum("_users").alias("_total"), F.min("_len").alias("_least")).first()
    count, last = synthetic.agg(F.count(F.lit(1)), F.max("id")).first()
    need = count // max(1, total["_least"] or 1) + 1
    drawn = spark.range(need).withColumn("_x", draw(seed, "history", "id") % F.lit(total["_total"] or 1))
    # at most `longest` intervals
    sized = drawn.join(F.broadcast(ranges), (F.col("_x") >= F.col("_low")) & (F.col("_x") < F.col("_high"))).select("id", "_len")
    block, cell = 4096, 256
    sums = sized.groupBy(F.expr(f"id div {block}").alias("_b")).agg(F.sum("_len").alias("_s"))
    offsets = sums.select("_b", F.coalesce(F.sum("_s").over(Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    reached = offsets.where(F.col("_before") <= F.lit(-1 if last is None else last))  # users beyond the last row have none
    inside = Window.partitionBy("_b").orderBy("id").rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        sized.withColumn("_b", F.expr(f"id div {block}"))
        .join(F.broadcast(reached), "_b")
        .withColumn("_in", F.coalesce(F.sum("_len").over(inside), F.lit(0)))
        .select((F.lit(FIRST_USER) + F.col("id")).alias("customer_id"), (F.col("_before") + F.col("_in")).alias("_start"), "_len")
    )
    runs = starts.select("customer_id", "_start", (F.col("_start") + F.col("_len")).alias("_end"), F.explode(F.expr(f"sequence(_start div {cell}, (_start + _len - 1) div {cell})")).alias("_cell"))
    runs = checkpointed(runs)
    cols = ["id", *[c for c in synthetic.columns if c != "id"], "customer_id"]
    own = (F.col("id") >= F.col("_start")) & (F.col("id") < F.col("_end"))
    return synthetic.withColumn("_cell", F.expr(f"id div {cell}")).join(_small(runs, runs.count()), "_cell").where(own).select(*cols)


def post_processed(synthetic: DataFrame, movies: DataFrame) -> DataFrame:
    """Numbers from text, rounded and clipped; only movies that exist; a date in the middle of the month."""
    number = lambda c: F.round(F.col(c).cast("string").try_cast("double")).cast("int")
    held = synthetic.withColumn("rating", clipped(number("rating"), 1, 5).cast("int")).withColumn("movie_id", number("movie_id"))
    held = held.where(F.col("rating").isNotNull() & F.col("movie_id").isNotNull())
    known = checkpointed(movies.select("movie_id").distinct())
    return held.join(_small(known, known.count()), "movie_id", "left_semi").withColumn("date", F.concat("month", F.lit("-15")))


def synthetic_release(df: DataFrame, rows: int | None = None, seed: int = 333) -> DataFrame:
    """id, customer_id, movie_id, rating, month, date. The columns that are read and the rows that are drawn are written once."""
    held = checkpointed(df.select("customer_id", "movie_id", "rating", "month"))
    drawn = checkpointed(post_processed(gaussian_copula(held, rows=rows, seed=seed), held))
    out = assign_users(drawn, held, seed)
    discarded(held)
    return out


def train_on_synthetic(synthetic: DataFrame, real_train: DataFrame, real_test: DataFrame, epochs: int = 6) -> DataFrame:
    """(trained_on, errors): a model of synthetic rows and one of real rows, both tested on real rows."""
    from veilframe.operators.bias import evaluate, fit_bias, predict_bias

    parts = [evaluate(predict_bias(fit_bias(d, "rating", epochs), real_test)).withColumn("trained_on", F.lit(n)) for n, d in (("synthetic", synthetic), ("real", real_train))]
    return reduce(DataFrame.unionByName, parts)
