"""Anonymized releases of ratings. Each is a lazy table over one featured base."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilframe.functions.features import clipped, dense_index, prefix_sums, with_features
from veilframe.functions.hashing import TOP, below, draw
from veilframe.session import checkpointed

ROW = "row_key"
#: Pools of up to this many values (two numbers each) are broadcast; larger ones are joined by a shuffle.
BROADCAST_VALUES = 500_000


@dataclass(frozen=True)
class Release:
    """A table, the columns that an attacker may know of a row, and the column that stands for the rating (if any)."""

    name: str
    data: DataFrame
    knowledge_cols: tuple[str, ...]
    rating_col: str | None
    description: str


def row_key(df: DataFrame) -> Column:
    """What random draws depend on: a key column of the table, else all its rating columns (equal rows then draw alike)."""
    if ROW in df.columns:
        return F.col(ROW)
    parts = [c for c in ("customer_id", "movie_id", "rating", "date", "month") if c in df.columns]
    return F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("~")) for c in parts])


def _share(p: float, name: str = "p") -> float:
    if not 0 <= p <= 1:
        raise ValueError(f"{name} must be from 0 to 1")
    return p


def add_rating_noise(df: DataFrame, seed: int = 333, p: float = 0.25) -> DataFrame:
    """One star down or up, each with probability p / 2, clipped to 1..5."""
    _share(p)
    h, edge = draw(seed, "rating-noise", row_key(df)), int(p / 2 * TOP)
    step = F.when(h < edge, -1).when(h >= TOP - edge, 1).otherwise(0)
    return df.withColumn("rating", clipped(F.col("rating") + step, 1, 5).cast("int"))


def null_safe(left: DataFrame, right: DataFrame, cols: list[str], how: str = "inner") -> DataFrame:
    """Equi-join in which nulls match nulls; the columns come from the left."""
    named = right.select(*[F.col(c).alias(f"_r_{c}") for c in cols], *[c for c in right.columns if c not in cols])
    on = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_r_{c}")) for c in cols])
    joined = left.join(named, on, how)
    return joined if how in ("left_semi", "left_anti") else joined.drop(*[f"_r_{c}" for c in cols])


def class_sizes(df: DataFrame, cols: list[str], user: str = "customer_id") -> DataFrame:
    """(cols, k): distinct users of each combination, nulls being values."""
    return df.groupBy(*cols).agg(F.countDistinct(user).alias("k"))


def suppress_low_k(df: DataFrame, cols: list[str], k: int, user: str = "customer_id") -> DataFrame:
    """The rows whose combination at least k users share; repeated rows stay repeated."""
    return null_safe(df, class_sizes(df, cols, user).where(F.col("k") >= k).drop("k"), cols, "left_semi")


def remove_rare_items(df: DataFrame, least: int) -> DataFrame:
    common = df.groupBy("movie_id").agg(F.countDistinct("customer_id").alias("_n")).where(F.col("_n") >= least)
    return df.join(common.select("movie_id"), "movie_id", "left_semi")


def make_releases(df: DataFrame, seed: int = 333, rare_min: int = 500, k: int = 5, suppress_cols=("movie_id", "rating", "month")) -> list[Release]:
    """The nine fixed releases, in order."""
    base = with_features(df)
    full, plain = ("movie_id", "rating", "month"), "rating"
    noisy = add_rating_noise(base, seed)
    return [
        Release("original_movie_rating_month", base, full, plain, "movie, rating and month as they are"),
        Release("remove_month", base, ("movie_id", "rating"), plain, "no month"),
        Release("year_only", base, ("movie_id", "rating", "year"), plain, "year in place of month"),
        Release("coarsen_rating", base, ("movie_id", "rating_bucket", "month"), "rating_bucket_midpoint", "three rating buckets"),
        Release("remove_month_and_coarsen_rating", base, ("movie_id", "rating_bucket"), "rating_bucket_midpoint", "buckets, no month"),
        Release("add_rating_noise", noisy, full, plain, "a quarter of the ratings moved by one star"),
        Release(f"remove_rare_movies_min_{rare_min}", remove_rare_items(base, rare_min), full, plain, f"movies with {rare_min} users or more"),
        Release(
            f"k_suppress_movie_rating_month_k{k}", suppress_low_k(base, list(suppress_cols), k), full, plain, f"facts that {k} users or more share"
        ),
        Release("movie_only", base, ("movie_id",), None, "no rating, no time"),
    ]


def release_values(df: DataFrame, seed: int = 333, rare_min: int = 500, k: int = 5, suppress_cols=("movie_id", "rating", "month")) -> tuple[list[tuple], DataFrame]:
    """make_releases in one table, for what needs users, movies and ratings alone: (name, rating column, its value's column, its rows' column) of
    each release, and (customer_id, movie_id, values, rows). A value is null, and a row's column false, where the release lacks the row."""
    base = with_features(df)
    keys = list(dict.fromkeys(["customer_id", "movie_id", "rating", "rating_bucket_midpoint", *suppress_cols]))
    noisy = add_rating_noise(base.withColumn("_plain", F.col("rating")), seed).withColumnRenamed("rating", "_noisy").withColumnRenamed("_plain", "rating")
    held = checkpointed(noisy.select(*keys, "_noisy"))
    common = checkpointed(held.groupBy("movie_id").agg(F.countDistinct("customer_id").alias("_n")).where(F.col("_n") >= rare_min).select("movie_id"))
    shared = checkpointed(class_sizes(held, list(suppress_cols)).where(F.col("k") >= k).drop("k"))
    small = lambda x: F.broadcast(x) if x.count() <= BROADCAST_VALUES else x
    marked = held.join(small(common.withColumn("_common", F.lit(True))), "movie_id", "left")
    marked = null_safe(marked, small(shared.withColumn("_shared", F.lit(True))), list(suppress_cols), "left")
    rating, mid = F.col("rating").cast("double"), F.col("rating_bucket_midpoint").cast("double")
    rare, low = F.coalesce("_common", F.lit(False)), F.coalesce("_shared", F.lit(False))
    values = [rating.alias("v0"), mid.alias("v1"), F.col("_noisy").cast("double").alias("v2"), F.when(rare, rating).alias("v3"), F.when(low, rating).alias("v4")]
    table = marked.select("customer_id", "movie_id", *values, F.lit(True).alias("in0"), rare.alias("in1"), low.alias("in2"))
    at = {"add_rating_noise": ("v2", "in0"), f"remove_rare_movies_min_{rare_min}": ("v3", "in1"), f"k_suppress_movie_rating_month_k{k}": ("v4", "in2")}
    of = lambda r: at.get(r.name, ({"rating": "v0", "rating_bucket_midpoint": "v1", None: None}[r.rating_col], "in0"))
    return [(r.name, r.rating_col, *of(r)) for r in make_releases(df, seed, rare_min, k, suppress_cols)], table


def six_releases(df: DataFrame, seed: int = 333) -> list[Release]:
    """The shorter list, with its own names, of the exploratory study."""
    names = {
        "original_movie_rating_month": None,
        "remove_month": None,
        "year_only": None,
        "coarsen_rating": "coarsen_rating_to_preference",
        "remove_rare_movies_min_500": "remove_rare_movies_min_500_users",
        "movie_only": None,
    }
    return [
        Release(names[r.name] or r.name, r.data, r.knowledge_cols, r.rating_col, r.description)
        for r in make_releases(df, seed)
        if r.name in names
    ]


def other_value(index: Column, h: Column, n: Column) -> Column:
    """A uniform draw among the other n - 1 positions: what drawing until the value differs leads to. n <= 1: as it was."""
    return F.when(n <= 1, index).otherwise((index + 1 + h % F.greatest(n - 1, F.lit(1))) % n)


def _masked(held: DataFrame, values: DataFrame, key: Column, name: str) -> DataFrame:
    """Left join of the rows with _mask to values by key = name. The other rows meet nothing; where they are shuffled at all it is by
    their draw, so that they spread evenly."""
    right = values.withColumnRenamed(name, "_v").withColumn("_m", F.lit(True))
    mine = held.withColumn("_meet", F.when(F.col("_mask"), key.cast("bigint")).otherwise(F.col("_h")))
    return mine.join(right, (F.col("_mask") == F.col("_m")) & (F.col("_meet") == F.col("_v").cast("bigint")), "left").drop("_v", "_m", "_meet")


def _resampled(df: DataFrame, column: str, pool: DataFrame, mask: Column, h: Column, weighted: bool, pools: dict) -> DataFrame:
    """Replace `column` where mask holds. pool: (column, _n rows) of each value; pools: what was made of it before."""
    if not weighted:
        if column not in pools:
            coded = checkpointed(dense_index(pool.select(column), column, "_i"))
            pools[column] = coded, coded.count()
        coded, n = pools[column]
        small = F.broadcast if n <= BROADCAST_VALUES else (lambda x: x)
        held = df.withColumn("_mask", mask).withColumn("_h", h)
        own = _masked(held, small(coded), F.col(column), column)
        moved = own.withColumn("_j", F.when(F.col("_mask"), other_value(F.col("_i"), F.col("_h"), F.lit(n)))).drop("_i")
        back = small(coded.select(F.col("_i").alias("_j0"), F.col(column).alias("_new")))
        return _masked(moved, back, F.col("_j"), "_j0").withColumn(column, F.coalesce("_new", column)).drop("_mask", "_h", "_j", "_new")
    # counts as whole-number intervals; the own interval is cut out of the line, then the draw is looked up
    line = checkpointed(prefix_sums(pool, column, "_n", "_high").withColumn("_low", F.col("_high") - F.col("_n")))
    total = pool.agg(F.sum("_n").alias("_total"))
    held = _masked(df.withColumn("_mask", mask).withColumn("_h", h), line, F.col(column), column).join(F.broadcast(total))
    x = F.expr(f"(_h * (_total - _n)) div {TOP}")
    held = held.withColumn("_x", F.when(F.col("_mask") & (F.col("_total") > F.col("_n")), x + F.when(x >= F.col("_low"), F.col("_n")).otherwise(0)))
    step = F.expr("1 + _total div 4096")  # cells of the line, so that the lookup is an equi-join
    cells = (
        line.join(F.broadcast(total))
        .withColumn("_cell", F.explode(F.expr("sequence(_low div (1 + _total div 4096), (_high - 1) div (1 + _total div 4096))")))
        .select(F.col(column).alias("_new"), F.col("_low").alias("_a"), F.col("_high").alias("_b"), "_cell")
    )
    held = held.withColumn("_cell", F.floor(F.col("_x") / step))
    near = (cells["_cell"] == held["_cell"]) & (held["_x"] >= cells["_a"]) & (held["_x"] < cells["_b"])
    found = held.join(cells, near, "left")
    return found.withColumn(column, F.coalesce("_new", column)).select(*df.columns)


def make_noisy_release(
    df: DataFrame, rating_p: float = 0.0, movie_p: float = 0.0, user_p: float = 0.0, seed: int = 333, weighted: bool = False, pools: dict | None = None
) -> DataFrame:
    """Row noise: each of rating, movie and user is replaced by another value with its own probability. Ratings come from 1..5,
    movies and users from those of the table; weighted draws follow how often values occur. User noise is by row, not a new
    pseudonym for the user. pools: a dictionary that keeps the values of df for further releases of it."""
    spark, out, pools = df.sparkSession, df.withColumn("_key", row_key(df)), {} if pools is None else pools
    for column, p in (("rating", rating_p), ("movie_id", movie_p), ("customer_id", user_p)):
        _share(p, column)
        if p == 0:
            continue
        counts = df.groupBy(column).agg(F.count(F.lit(1)).alias("_n"))
        if column == "rating" and not weighted:
            counts = spark.range(1, 6).select(F.col("id").cast(df.schema["rating"].dataType).alias("rating"), F.lit(1).alias("_n"))
        mask, h = below(seed, f"mask-{column}", p, "_key"), draw(seed, f"value-{column}", "_key")
        out = _resampled(out, column, counts, mask, h, weighted, pools)
    return out.select(*df.columns)


SCENARIOS = ("rating", "movie", "user_id", "all_three")
SHARES = (0.0, 0.01, 0.02, 0.05, 0.1, 0.2)


def noise_grid(df: DataFrame, shares=SHARES, scenarios=SCENARIOS, seed: int = 333, weighted: bool = False) -> list[tuple[str, float, DataFrame]]:
    """(scenario, p, release) of the whole grid."""
    on = {"rating": (1, 0, 0), "movie": (0, 1, 0), "user_id": (0, 0, 1), "all_three": (1, 1, 1)}
    pools: dict = {}
    return [(s, p, make_noisy_release(df, *[p * x for x in on[s]], seed=seed, weighted=weighted, pools=pools)) for s in scenarios for p in shares]


def noise_cases(df: DataFrame, shares=SHARES, scenarios=SCENARIOS, seed: int = 333, weighted: bool = False) -> tuple[list[tuple[str, float, int]], DataFrame]:
    """noise_grid in one table: (scenario, p, number of the variant) of the grid, and df's columns with _in, whose bit k tells that variant k
    has the row. Points without noise share variant 0. What a draw puts in a value's place doesn't depend on p, so a row has at
    most eight cases, whatever the grid, and is drawn once."""
    on = {"rating": (1, 0, 0), "movie": (0, 1, 0), "user_id": (0, 0, 1), "all_three": (1, 1, 1)}
    points, variants = [], [(0.0, 0.0, 0.0)]
    for s in scenarios:
        for p in shares:
            if _share(p):
                variants.append(tuple(p * x for x in on[s]))
            points.append((s, p, len(variants) - 1 if p else 0))
    if len(variants) > 62:
        raise ValueError("a table has 62 variants at most")
    spark, out, every = df.sparkSession, df.withColumn("_key", row_key(df)), F.lit((1 << len(variants)) - 1).cast("long")
    cols = ("rating", "movie_id", "customer_id")
    for k, column in enumerate(cols):
        top = max(v[k] for v in variants)
        out = out.withColumn(f"_old{k}", F.col(column)).withColumn(f"_at{k}", draw(seed, f"mask-{column}", "_key"))
        if top:
            counts = df.groupBy(column).agg(F.count(F.lit(1)).alias("_n"))
            if column == "rating" and not weighted:
                counts = spark.range(1, 6).select(F.col("id").cast(df.schema["rating"].dataType).alias("rating"), F.lit(1).alias("_n"))
            out = _resampled(out, column, counts, F.col(f"_at{k}") < int(top * TOP), draw(seed, f"value-{column}", "_key"), weighted, {})
        out = out.withColumnRenamed(column, f"_new{k}")
    for k in range(3):  # the variants that replace the column
        bits = [F.when(F.col(f"_at{k}") < int(v[k] * TOP), F.lit(1 << n).cast("long")).otherwise(F.lit(0).cast("long")) for n, v in enumerate(variants) if v[k]]
        out = out.withColumn(f"_by{k}", reduce(lambda a, b: a.bitwiseOR(b), bits, F.lit(0).cast("long")))
    cases = []
    for case in range(8):
        moved = [case >> k & 1 for k in range(3)]
        where = reduce(lambda a, b: a.bitwiseAND(b), [F.col(f"_by{k}") if m else every.bitwiseXOR(F.col(f"_by{k}")) for k, m in enumerate(moved)])
        cases.append(F.struct(*[F.col(f"_{'new' if m else 'old'}{k}").alias(c) for (k, c), m in zip(enumerate(cols), moved, strict=True)], where.alias("_in")))
    out = out.withColumn("_case", F.explode(F.filter(F.array(*cases), lambda x: x["_in"] != 0)))
    return points, out.select(*[F.col(f"_case.{c}").alias(c) if c in cols else F.col(c) for c in df.columns], F.col("_case._in").alias("_in"))


def latent_sensitive(df: DataFrame, weights: DataFrame, seed: int = 333) -> DataFrame:
    """Noise that grows with a movie's privacy weight (0.5 where unknown), and years in place of months from the 85th
    percentile of the movies' weights on. weights: movie_id, privacy_weight."""
    base = with_features(df)
    edge = weights.agg(F.percentile("privacy_weight", F.lit(0.85)).alias("_edge"))
    held = base.join(weights.select("movie_id", "privacy_weight"), "movie_id", "left").join(F.broadcast(edge))
    weight = F.coalesce("privacy_weight", F.lit(0.5))
    flip = draw(seed, "latent-flip", row_key(df)) < (F.lit(0.08) + 0.47 * clipped(weight, 0.0, 1.0)) * TOP
    step = F.when(draw(seed, "latent-sign", row_key(df)) < TOP // 2, -1).otherwise(1)
    return (
        held.withColumn("privacy_weight", weight)
        .withColumn("rating", F.when(flip, clipped(F.col("rating") + step, 1, 5).cast("int")).otherwise(F.col("rating")))
        .withColumn("month", F.when(F.col("privacy_weight") >= F.col("_edge"), F.col("year").cast("string")).otherwise(F.col("month")))
        .drop("_edge")
    )
