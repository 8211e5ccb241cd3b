"""Sampled candidate-set attacks, all trials in one job."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veilframe.functions.features import dense_index, prefix_sums
from veilframe.functions.hashing import draw
from veilframe.operators.releases import Release, null_safe, row_key
from veilframe.session import checkpointed

#: Known facts up to this many are broadcast; more are joined by a shuffle.
BROADCAST_FACTS = 500_000


def sampled_facts(knowledge: DataFrame, n_known=(1, 2, 3), trials: int = 300, seed: int = 333, user: str = "customer_id") -> DataFrame:
    """knowledge rows with n_known, trial, target_user: for each n and trial, n rows of one user who has n rows or more."""
    spark = knowledge.sparkSession
    rows = knowledge.withColumn("_key", row_key(knowledge))
    histories = checkpointed(rows.groupBy(user).agg(F.count(F.lit(1)).alias("_rows")))  # read for each n
    drawn = []
    for n in n_known:
        coded = dense_index(histories.where(F.col("_rows") >= n).select(user), user, "_i")
        size = coded.agg(F.count(F.lit(1)).alias("_size"))
        each = spark.range(trials).select(F.col("id").cast("int").alias("trial"), F.lit(n).alias("n_known"))
        each = each.join(F.broadcast(size)).where("_size > 0").withColumn("_i", draw(seed, "target", "n_known", "trial") % F.col("_size"))
        drawn.append(coded.join(F.broadcast(each) if trials <= BROADCAST_FACTS else each, "_i").select("trial", "n_known", F.col(user).alias("target_user")))
    targets = reduce(DataFrame.unionByName, drawn)
    few = trials * len(n_known) <= BROADCAST_FACTS  # targets has so many rows
    facts = rows.join(F.broadcast(targets) if few else targets, rows[user] == targets["target_user"])
    order = Window.partitionBy("n_known", "trial").orderBy(draw(seed, "fact", "n_known", "trial", "_key"), "_key")
    return facts.withColumn("_rank", F.row_number().over(order)).where(F.col("_rank") <= F.col("n_known")).drop("_rank", "_key")


def candidates(facts: DataFrame, index: DataFrame, cols, user: str = "customer_id", bounded: bool = True) -> DataFrame:
    """(n_known, trial, candidate): the users who have every fact of a trial. Nulls match nulls; a fact known twice counts once."""
    keys = facts.select("n_known", "trial", *cols).distinct()
    wanted = keys.groupBy("n_known", "trial").agg(F.count(F.lit(1)).alias("_wanted"))
    known = F.broadcast(keys) if bounded else keys
    met = null_safe(index.select(*cols, F.col(user).alias("candidate")), known, list(cols))
    had = met.distinct().groupBy("n_known", "trial", "candidate").agg(F.count(F.lit(1)).alias("_had"))
    return had.join(F.broadcast(wanted) if bounded else wanted, ["n_known", "trial"]).where("_had = _wanted").select("n_known", "trial", "candidate")


def attack_trials(knowledge: DataFrame, index: DataFrame, cols, n_known=(1, 2, 3), trials: int = 300, seed: int = 333, facts: DataFrame | None = None) -> DataFrame:
    """One row for each trial: candidate_count, true_user_in_candidates, unique, surety_pct. What is known comes from `knowledge`,
    what it is looked up in is `index`; they are the same table unless noise lies between them. facts: those of `knowledge`, where they
    were drawn before."""
    cols = list(cols)
    if facts is None:
        facts = sampled_facts(knowledge, n_known, trials, seed)
    bounded = trials * sum(n_known) <= BROADCAST_FACTS
    found = candidates(facts, index, cols, bounded=bounded)
    targets = facts.select("n_known", "trial", "target_user").distinct()
    held = targets.join(found, ["n_known", "trial"], "left").groupBy("n_known", "trial", "target_user")
    counted = held.agg(
        F.count("candidate").alias("candidate_count"),
        F.coalesce(F.max((F.col("candidate") == F.col("target_user")).cast("int")), F.lit(0)).alias("_true"),
    )
    k = F.col("candidate_count")
    return counted.select(
        F.lit(" + ".join(cols)).alias("knowledge_cols"),
        "n_known",
        "trial",
        "target_user",
        "candidate_count",
        (F.col("_true") == 1).alias("true_user_in_candidates"),
        (k == 1).alias("unique"),
        F.when(k > 0, 100.0 / F.greatest(k, F.lit(1))).otherwise(0.0).alias("surety_pct"),
    )


def _pct(flag: Column) -> Column:
    return F.avg(F.when(flag, 1.0).otherwise(0.0)) * 100


def attack_summary(trials: DataFrame, keys=("knowledge_cols", "n_known")) -> DataFrame:
    k = F.col("candidate_count")
    return trials.groupBy(*keys).agg(
        F.avg(k).alias("avg_candidate_size"),
        F.median(k).alias("median_candidate_size"),
        _pct(F.col("unique")).alias("pct_unique"),
        _pct(k <= 5).alias("pct_5_or_less"),
        _pct(k <= 10).alias("pct_10_or_less"),
        F.avg("surety_pct").alias("avg_surety_pct"),
        F.median("surety_pct").alias("median_surety_pct"),
        F.count(F.lit(1)).alias("trials"),
    )


def release_trials(release: Release, n_known=(1, 2, 3), trials: int = 300, seed: int = 333) -> DataFrame:
    """The attacker knows rows as they were released."""
    return attack_trials(release.data, release.data, release.knowledge_cols, n_known, trials, seed).withColumn("release_name", F.lit(release.name))


def evaluate_releases(releases: list[Release], n_known=(1, 2, 3), trials: int = 300, seed: int = 333) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(k-anonymity, trials, summary) of all releases."""
    from veilframe.operators.k_anonymity import release_k_anonymity

    k = reduce(DataFrame.unionByName, [release_k_anonymity(r) for r in releases])
    every = reduce(DataFrame.unionByName, [release_trials(r, n_known, trials, seed) for r in releases])
    summary = attack_summary(every, ("release_name", "knowledge_cols", "n_known"))
    return k, every, summary.orderBy("n_known", "median_candidate_size", "avg_candidate_size", "release_name")


MODES = {
    "movie_only": ("movie_id",),
    "movie_rating": ("movie_id", "rating"),
    "movie_month": ("movie_id", "month"),
    "movie_rating_month": ("movie_id", "rating", "month"),
    "movie_preference_month": ("movie_id", "rating_bucket", "month"),
    "movie_date": ("movie_id", "date"),
    "movie_rating_date": ("movie_id", "rating", "date"),
}


def evaluate_modes(df: DataFrame, modes=MODES, n_known=(1, 2, 3), trials: int = 300, seed: int = 333) -> DataFrame:
    """Summary for each kind of knowledge of one featured table."""
    facts = checkpointed(sampled_facts(df, n_known, trials, seed))  # the same for all kinds
    parts = [attack_trials(df, df, cols, n_known, trials, seed, facts).withColumn("mode", F.lit(m)) for m, cols in modes.items()]
    return attack_summary(reduce(DataFrame.unionByName, parts), ("mode", "knowledge_cols", "n_known"))


def noisy_trials(
    clean: DataFrame, noisy: DataFrame, cols, n_known=(1, 2, 3, 4), trials: int = 300, seed: int = 333, cutoff: int = 5, facts: DataFrame | None = None
) -> DataFrame:
    """Known rows from the clean table, looked up in the noisy one; small and unique sets told apart by whether they hold the
    true user. A small set has from 1 to cutoff - 1 users."""
    return _flagged(attack_trials(clean, noisy, cols, n_known, trials, seed, facts), cutoff)


def _flagged(t: DataFrame, cutoff: int, *more: str) -> DataFrame:
    small, true = F.col("candidate_count").between(1, cutoff - 1), F.col("true_user_in_candidates")
    return t.select(
        *more,
        "knowledge_cols",
        "n_known",
        "trial",
        "target_user",
        "candidate_count",
        "true_user_in_candidates",
        small.alias(f"less_than_{cutoff}_candidates"),
        (small & true).alias(f"less_than_{cutoff}_correct"),
        (small & ~true).alias(f"less_than_{cutoff}_wrong"),
        "unique",
        (F.col("unique") & true).alias("unique_correct"),
        (F.col("unique") & ~true).alias("unique_wrong"),
        (F.col("candidate_count") == 0).alias("no_match"),
    )


def variant_trials(
    facts: DataFrame, cases: DataFrame, points: list[tuple[str, float, int]], cols, n_known=(1, 2, 3), trials: int = 300, cutoff: int = 5, user: str = "customer_id"
) -> DataFrame:
    """noisy_trials for each point of a grid, with scenario and p. facts: of the clean table; cases: the rows of all variants (see
    releases.noise_cases), which meet the facts once; only rows that meet one are told apart by variant."""
    spark, cols, bounded = cases.sparkSession, list(cols), trials * sum(n_known) <= BROADCAST_FACTS
    small_side = F.broadcast if bounded else (lambda x: x)
    keys = facts.select("n_known", "trial", *cols).distinct()
    wanted = keys.groupBy("n_known", "trial").agg(F.count(F.lit(1)).alias("_wanted"))
    met = null_safe(cases.select(*cols, F.col(user).alias("candidate"), "_in"), small_side(keys), cols)
    numbers = F.array(*[F.lit(v) for v in sorted({v for *_, v in points})])
    each = met.withColumn("_v", F.explode(F.filter(numbers, lambda v: F.expr("_in").bitwiseAND(F.call_function("shiftleft", F.lit(1).cast("long"), v)) != 0))).drop("_in")
    had = each.distinct().groupBy("_v", "n_known", "trial", "candidate").agg(F.count(F.lit(1)).alias("_had"))
    found = had.join(small_side(wanted), ["n_known", "trial"]).where("_had = _wanted").select("_v", "n_known", "trial", "candidate")
    asked = facts.select("n_known", "trial", "target_user").distinct().withColumn("_v", F.explode(numbers))
    held = asked.join(found, ["_v", "n_known", "trial"], "left").groupBy("_v", "n_known", "trial", "target_user").agg(
        F.count("candidate").alias("candidate_count"), F.coalesce(F.max((F.col("candidate") == F.col("target_user")).cast("int")), F.lit(0)).alias("_true")
    )
    named = held.join(F.broadcast(spark.createDataFrame([(s, float(p), v) for s, p, v in points], "scenario string, p double, _v int")), "_v")
    k, true = F.col("candidate_count"), F.col("_true") == 1
    return _flagged(named.select("scenario", "p", F.lit(" + ".join(cols)).alias("knowledge_cols"), "n_known", "trial", "target_user", "candidate_count",
                                 true.alias("true_user_in_candidates"), (k == 1).alias("unique")), cutoff, "scenario", "p")


def noisy_summary(trials: DataFrame, keys=("knowledge_cols", "n_known"), cutoff: int = 5) -> DataFrame:
    small = f"less_than_{cutoff}"
    count = lambda c: F.sum(F.col(c).cast("int"))
    rate = lambda a, b: F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))
    return trials.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("trials"),
        F.avg("candidate_count").alias("avg_candidate_size"),
        F.median("candidate_count").alias("median_candidate_size"),
        *[_pct(F.col(c)).alias(f"pct_{c}") for c in ("unique", "unique_correct", "unique_wrong", f"{small}_candidates", f"{small}_correct", f"{small}_wrong", "no_match")],
        count("unique").alias("unique_count"),
        count(f"{small}_candidates").alias(f"{small}_count"),
        rate(count("unique_wrong"), count("unique")).alias("unique_false_positive_rate"),
        rate(count(f"{small}_wrong"), count(f"{small}_candidates")).alias(f"{small}_false_positive_rate"),
    )


def popularity_buckets(df: DataFrame) -> DataFrame:
    """(movie_id, popularity, bucket): quartiles of the rank by (users, movie_id), cut at 1 + (n - 1) q, closed on the right."""
    pop = df.groupBy("movie_id").agg(F.countDistinct("customer_id").alias("popularity"))
    n = pop.agg(F.count(F.lit(1)).alias("_n"))
    # items of one popularity are ranked by themselves, after all less popular ones
    sizes = pop.groupBy("popularity").agg(F.count(F.lit(1)).alias("_same"))
    upto = prefix_sums(sizes, "popularity", "_same", "_upto").select("popularity", (F.col("_upto") - F.col("_same")).alias("_below"))
    own = F.row_number().over(Window.partitionBy("popularity").orderBy("movie_id"))
    ranked = pop.withColumn("_own", own).join(upto, "popularity").withColumn("_rank", F.col("_below") + F.col("_own")).join(F.broadcast(n))
    edge = lambda q: 1 + (F.col("_n") - 1) * q
    bucket = (
        F.when(F.col("_rank") <= edge(0.25), "rare").when(F.col("_rank") <= edge(0.5), "less_common").when(F.col("_rank") <= edge(0.75), "common")
    ).otherwise("popular")
    return ranked.select("movie_id", "popularity", bucket.alias("bucket"))


BUCKETS = {"rare": 1, "less_common": 2, "common": 3, "popular": 4}


def trials_with_features(df: DataFrame, cols, n_known=(1, 2, 3), trials: int = 300, seed: int = 333) -> DataFrame:
    """Trials with avg_popularity, min_popularity, rarest_bucket, avg_rating, has_low_rating, has_high_rating of what is known."""
    drawn = checkpointed(sampled_facts(df, n_known, trials, seed))
    about = drawn.join(popularity_buckets(df), "movie_id").groupBy("n_known", "trial").agg(
        F.avg("popularity").alias("avg_popularity"),
        F.min("popularity").alias("min_popularity"),
        F.min_by("bucket", F.struct("popularity", "movie_id")).alias("rarest_bucket"),
        F.avg("rating").alias("avg_rating"),
        F.max((F.col("rating") <= 2).cast("int")).cast("boolean").alias("has_low_rating"),
        F.max((F.col("rating") >= 4).cast("int")).cast("boolean").alias("has_high_rating"),
    )
    return attack_trials(df, df, cols, n_known, trials, seed, drawn).join(about, ["n_known", "trial"])


def risk_by(trials: DataFrame, column: str) -> DataFrame:
    k = F.col("candidate_count")
    return trials.groupBy(column, "n_known").agg(
        F.count(F.lit(1)).alias("trials"), F.avg(k).alias("avg_candidate_size"), _pct(F.col("unique")).alias("pct_unique"), F.avg("surety_pct").alias("avg_surety_pct")
    )
