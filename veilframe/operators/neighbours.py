"""Nearest-neighbour and membership audits on sparse profiles."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from veilframe.functions.hashing import draw
from veilframe.operators.bias import holdout_users, stratified_split
from veilframe.operators.releases import Release, row_key
from veilframe.session import checkpointed, discarded

CENTRE = 3.0
#: Movies of profiles, and candidates, up to this many are broadcast; more are joined by a shuffle.
BROADCAST_KEYS = 1_000_000


def sample_profiles(df: DataFrame, n_users: int, n_facts: int, seed: int = 333) -> DataFrame:
    """n_facts rows of each of n_users users who have that many, by least hash."""
    keyed = df.withColumn("_key", row_key(df))
    fit = df.groupBy("customer_id").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= n_facts)
    users = fit.orderBy(draw(seed, "profile-user", "customer_id"), "customer_id").limit(n_users).select("customer_id")
    order = Window.partitionBy("customer_id").orderBy(draw(seed, "profile-fact", "_key"), "_key")
    # n_users rows
    return keyed.join(F.broadcast(users), "customer_id").withColumn("_rank", F.row_number().over(order)).where(F.col("_rank") <= n_facts).drop("_rank", "_key")


def _vectors(df: DataFrame, rating_col: str, user: str) -> DataFrame:
    """(user, movie_id, x): mean centred rating of each pair."""
    return df.where(F.col(rating_col).isNotNull()).groupBy(F.col("customer_id").alias(user), "movie_id").agg((F.avg(F.col(rating_col).cast("double")) - CENTRE).alias("x"))


def _only(df: DataFrame, keys: DataFrame) -> DataFrame:
    """The rows of df with one of the (written) keys."""
    return df.join(F.broadcast(keys) if keys.count() <= BROADCAST_KEYS else keys, keys.columns[0], "left_semi")


def nearest_users(profiles: DataFrame, release: DataFrame, top_k: int = 10, rating_col: str = "rating") -> DataFrame:
    """(profile, candidate, sim, rank): the top_k users of the release by cosine, for each profile. Profiles without a movie of the
    release have no row. Of the release, only rows of the profiles' movies are compared, and only rows of users who have one of
    these are added up for norms: all others are left where they are."""
    p = _vectors(profiles, "rating", "profile")
    movies = checkpointed(p.select("movie_id").distinct())
    near = checkpointed(_only(release.where(F.col(rating_col).isNotNull()), movies).select("customer_id", "movie_id", rating_col))
    users = checkpointed(near.select("customer_id").distinct())
    whole = _only(release.select("customer_id", "movie_id", rating_col), users)
    r, every = _vectors(near, rating_col, "candidate"), _vectors(whole, rating_col, "candidate")
    dots = p.withColumnRenamed("x", "px").join(r, "movie_id").groupBy("profile", "candidate").agg(F.sum(F.col("px") * F.col("x")).alias("_dot"))
    pn = p.groupBy("profile").agg(F.sqrt(F.sum(F.col("x") * F.col("x"))).alias("_pn"))
    rn = every.groupBy("candidate").agg(F.sqrt(F.sum(F.col("x") * F.col("x"))).alias("_rn"))
    sims = dots.join(pn, "profile").join(rn, "candidate").select("profile", "candidate", F.coalesce(F.try_divide(F.col("_dot"), F.col("_pn") * F.col("_rn")), F.lit(0.0)).alias("sim"))
    order = Window.partitionBy("profile").orderBy(F.round("sim", 9).desc(), "candidate")
    return sims.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top_k)


def nearest_neighbor_attack(profiles: DataFrame, release: DataFrame, top_k: int = 10, rating_col: str = "rating") -> DataFrame:
    """One row for each profile: top1_hit, topk_hit, best_similarity."""
    near = nearest_users(profiles, release, top_k, rating_col)
    own = F.col("candidate") == F.col("profile")
    found = near.groupBy("profile").agg(
        F.max((own & (F.col("rank") == 1)).cast("int")).alias("_one"), F.max(own.cast("int")).alias("_any"), F.max("sim").alias("best_similarity")
    )
    every = profiles.select(F.col("customer_id").alias("profile")).distinct()
    return every.join(found, "profile", "left").select(
        "profile", (F.coalesce("_one", F.lit(0)) == 1).alias("top1_hit"), (F.coalesce("_any", F.lit(0)) == 1).alias("topk_hit"), F.coalesce("best_similarity", F.lit(0.0)).alias("best_similarity")
    )


def membership_features(profiles: DataFrame, release: DataFrame, top_k: int = 5, rating_col: str = "rating") -> DataFrame:
    """One row for each profile: best_similarity, gap_to_second, mean_top5, known_movies (of the release)."""
    near = nearest_users(profiles, release, top_k, rating_col).groupBy("profile").agg(
        F.max(F.when(F.col("rank") == 1, F.col("sim"))).alias("_1"), F.max(F.when(F.col("rank") == 2, F.col("sim"))).alias("_2"), F.sum("sim").alias("_sum")
    )
    movies = profiles.select(F.col("customer_id").alias("profile"), "movie_id").distinct().join(release.select("movie_id").distinct(), "movie_id", "left_semi")
    known = movies.groupBy("profile").agg(F.count(F.lit(1)).alias("_known"))
    every = profiles.select(F.col("customer_id").alias("profile")).distinct().join(near, "profile", "left").join(known, "profile", "left")
    first, second = F.coalesce("_1", F.lit(0.0)), F.coalesce("_2", F.lit(0.0))
    return every.select(
        "profile",
        first.alias("best_similarity"),
        (first - second).alias("gap_to_second"),
        (F.coalesce("_sum", F.lit(0.0)) / top_k).alias("mean_top5"),
        F.coalesce("_known", F.lit(0)).alias("known_movies"),
    )


FEATURES = ["best_similarity", "gap_to_second", "mean_top5", "known_movies"]


def membership_sets(df: DataFrame, n_users: int = 100, n_facts: int = 6, share: float = 0.25, seed: int = 333) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(released rows, profiles of members, profiles of users held out)."""
    out = holdout_users(df, share, seed)
    inside, outside = df.join(out, "customer_id", "left_anti"), df.join(out, "customer_id", "left_semi")
    return inside, sample_profiles(inside, n_users, n_facts, seed), sample_profiles(outside, n_users, n_facts, seed + 1)


def membership_auc(members: DataFrame, others: DataFrame, release: DataFrame, rating_col: str = "rating", seed: int = 333) -> DataFrame:
    """One row: auc, accuracy at 0.5 and the features by weight, of a logistic regression on 70 % of the profiles. Null with one class or
    fewer than ten rows."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.evaluation import BinaryClassificationEvaluator
    from pyspark.ml.feature import VectorAssembler

    spark = release.sparkSession
    parts = [membership_features(p, release, rating_col=rating_col).withColumn("label", F.lit(float(y))) for p, y in ((members, 1), (others, 0))]
    rows = VectorAssembler(inputCols=FEATURES, outputCol="features").transform(checkpointed(reduce(DataFrame.unionByName, parts))).cache()
    schema = "auc double, accuracy double, rows long, coefficients string"
    n, classes = rows.agg(F.count(F.lit(1)), F.countDistinct("label")).first()
    if n < 10 or classes < 2:
        return spark.createDataFrame([(None, None, n, None)], schema)
    train, test = stratified_split(rows, "label", "profile", 0.7, seed)
    size = train.count()
    model = LogisticRegression(regParam=1.0 / max(1, size), standardization=False).fit(train)
    scored = model.transform(test).cache()
    both = scored.select("label").distinct().count() > 1
    auc = BinaryClassificationEvaluator(labelCol="label").evaluate(scored) if both else None
    accuracy = scored.agg(F.avg((F.col("prediction") == F.col("label")).cast("double"))).first()[0]
    ranked = sorted(zip(FEATURES, model.coefficients.toArray(), strict=True), key=lambda x: -abs(x[1]))
    rows.unpersist()
    scored.unpersist()
    return spark.createDataFrame([(auc, accuracy, n, ", ".join(f"{k} {v:.4f}" for k, v in ranked))], schema)


def release_membership(releases: list[Release], members: DataFrame, others: DataFrame) -> DataFrame:
    """membership_auc for each release that has ratings. Releases with the same table and label share one."""
    rows, found = [], {}
    for r in releases:
        if r.rating_col is None:
            continue
        key = (id(r.data), r.rating_col)
        if key not in found:
            held = checkpointed(r.data.select("customer_id", "movie_id", r.rating_col))
            found[key] = membership_auc(members, others, held, r.rating_col)
            discarded(held)
        rows.append(found[key].withColumn("release_name", F.lit(r.name)))
    return reduce(DataFrame.unionByName, rows)
