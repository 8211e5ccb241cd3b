"""Probabilistic linkage of a public profile to customers: title matching, facts, candidate scores."""

from __future__ import annotations

import difflib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veilframe.functions.features import expected_stars, normalize_title, rating_bucket, star_bounds, user_equals
from veilframe.schema import normalized_titles, require_columns


@dataclass(frozen=True)
class MatchConfig:
    fuzzy_threshold: float = 0.93
    fuzzy_margin: float = 0.03
    unique_title: bool = True
    fuzzy: bool = True


@dataclass(frozen=True)
class LinkageConfig:
    sigma: float = 0.75
    missing_penalty: float = -0.75
    min_matches: int = 2
    top_n: int = 50


def title_ratio(a: str, b: str) -> float:
    """Likeness of matching blocks; it depends on which side is first."""
    return difflib.SequenceMatcher(None, a, b).ratio()


def _two_best(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Of pairs (_q, _norm, ...) those that may be among the two most alike of their _q and year, with the likeness _s. The share of
    letters that lengths allow, and then that common letters allow, bounds it from above; most pairs end there."""
    best: dict[tuple, list[float]] = {}
    letters: dict[str, Counter] = {}

    def counted(text: str) -> Counter:
        if len(letters) > 200_000:  # bounds a task's memory
            letters.clear()
        if text not in letters:
            letters[text] = Counter(text)
        return letters[text]

    for b in batches:
        keep, scores = [], []
        for k, (q, y, t) in enumerate(zip(b["_q"], b["_qy"], b["_norm"], strict=True)):
            two = best.setdefault((q, None if y != y else y), [-1.0, -1.0])
            total = len(q) + len(t)
            if 2 * min(len(q), len(t)) / total < two[1] or 2 * (counted(q) & counted(t)).total() / total < two[1]:
                continue
            s = title_ratio(q, t)
            if s >= two[1]:
                keep.append(k)
                scores.append(s)
                two[:] = sorted([*two, s], reverse=True)[:2]
        yield b.iloc[keep].assign(_s=scores)


def match_titles(external: DataFrame, titles: DataFrame, config: MatchConfig = MatchConfig()) -> DataFrame:
    """Every external row with its match: same title and year, else a title that only one movie has, else the most alike title of
    the same year (of any year where the row has none), if it is alike enough and clearly ahead of the second. Rows that stay
    unmatched report the best score. Empty normalised titles match nothing."""
    require_columns(external, "title", "year", "user", "rating")
    catalogue = normalized_titles(titles).select(
        F.col("movie_id").alias("netflix_movie_id"), F.col("title").alias("netflix_title"), F.col("year").alias("netflix_year"), normalize_title(F.col("title")).alias("_norm")
    )
    rows = external.select("user", "title", "year", "rating").withColumn("_norm", normalize_title(F.col("title"))).withColumn(
        "_row", F.xxhash64("user", "title", "year", "rating")
    )
    asked = rows.select(F.col("_norm").alias("_q"), F.col("year").alias("_qy")).distinct()
    named = asked.where(F.col("_q") != "")
    exact = (
        named.join(catalogue, (F.col("_q") == F.col("_norm")) & (F.col("_qy") == F.col("netflix_year")))
        .groupBy("_q", "_qy")
        .agg(F.max("netflix_movie_id").alias("exact_id"))
    )
    alone = catalogue.where(F.col("_norm") != "").groupBy("_norm").agg(F.countDistinct("netflix_movie_id").alias("_n"), F.max("netflix_movie_id").alias("unique_id"))
    alone = alone.where("_n = 1").select(F.col("_norm").alias("_q"), "unique_id")
    exact = exact.withColumnsRenamed({"_q": "_eq", "_qy": "_ey"})
    same = F.col("_q").eqNullSafe(F.col("_eq")) & F.col("_qy").eqNullSafe(F.col("_ey"))
    found = asked.join(exact, same, "left").select("_q", "_qy", "exact_id")
    found = found.join(alone, "_q", "left")
    if not config.unique_title:
        found = found.withColumn("unique_id", F.lit(None).cast("long"))
    left = found.where(F.col("exact_id").isNull() & F.col("unique_id").isNull() & (F.col("_q") != "")).select("_q", "_qy")
    best = _fuzzy(left, catalogue, config) if config.fuzzy else left.select("_q", "_qy", F.lit(None).cast("long").alias("fuzzy_id"), F.lit(0.0).alias("best_score"))
    joined = found.join(best.withColumnRenamed("_q", "_fq").withColumnRenamed("_qy", "_fy"), F.col("_q").eqNullSafe(F.col("_fq")) & F.col("_qy").eqNullSafe(F.col("_fy")), "left")
    method = (
        F.when(F.col("exact_id").isNotNull(), "exact_title_year").when(F.col("unique_id").isNotNull(), "unique_title").when(F.col("fuzzy_id").isNotNull(), "fuzzy_title").otherwise("unmatched")
    )
    score = F.when(F.col("exact_id").isNotNull() | F.col("unique_id").isNotNull(), 1.0).otherwise(F.coalesce("best_score", F.lit(0.0)))
    chosen = joined.select("_q", "_qy", F.coalesce("exact_id", "unique_id", "fuzzy_id").alias("_id"), method.alias("match_method"), score.alias("match_score"))
    out = rows.join(chosen, (rows["_norm"] == chosen["_q"]) & rows["year"].eqNullSafe(chosen["_qy"]), "left")
    out = out.join(catalogue.drop("_norm"), F.col("_id") == F.col("netflix_movie_id"), "left")
    low, high = star_bounds(F.col("rating"))
    return out.select(
        "user",
        F.col("title").alias("imdb_title"),
        F.col("year").alias("imdb_year"),
        F.col("rating").alias("imdb_rating"),
        "netflix_movie_id",
        "netflix_title",
        "netflix_year",
        "match_method",
        "match_score",
        expected_stars(F.col("rating")).alias("expected_netflix_rating"),
        low.alias("rating_low"),
        high.alias("rating_high"),
        rating_bucket((low + high) / 2).alias("preference"),
    )


def _fuzzy(left: DataFrame, catalogue: DataFrame, config: MatchConfig) -> DataFrame:
    """(_q, _qy, fuzzy_id, best_score). Rows with a year meet the movies of that year; rows without meet all movies, in a branch
    of their own so that the others keep an equi-join."""
    pool = catalogue.where(F.col("_norm") != "").select("netflix_movie_id", "netflix_year", "_norm")
    dated = left.where(F.col("_qy").isNotNull()).join(pool, F.col("_qy") == F.col("netflix_year"))
    # titles without a year are asked of every part of the catalogue
    parts = max(1, int(left.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    asked = left.where(F.col("_qy").isNull()).withColumn("_part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    undated = asked.join(pool.withColumn("_part", F.expr(f"cast(pmod(xxhash64(netflix_movie_id), {parts}) as int)")), "_part").drop("_part")
    both = dated.unionByName(undated)
    pairs = both.mapInPandas(_two_best, T.StructType([*both.schema.fields, T.StructField("_s", T.DoubleType())]))
    order = Window.partitionBy("_q", "_qy").orderBy(F.col("_s").desc(), F.col("netflix_movie_id").desc())
    two = pairs.withColumn("_rank", F.row_number().over(order)).where("_rank <= 2").groupBy("_q", "_qy")
    top = two.agg(
        F.max(F.when(F.col("_rank") == 1, F.col("netflix_movie_id"))).alias("_id"),
        F.max(F.when(F.col("_rank") == 1, F.col("_s"))).alias("best_score"),
        F.coalesce(F.max(F.when(F.col("_rank") == 2, F.col("_s"))), F.lit(0.0)).alias("_next"),
    )
    good = (F.col("best_score") >= config.fuzzy_threshold) & (F.col("best_score") - F.col("_next") >= config.fuzzy_margin)
    return top.select("_q", "_qy", F.when(good, F.col("_id")).alias("fuzzy_id"), "best_score")


def linkage_facts(matched: DataFrame) -> DataFrame:
    """One fact for each matched movie: names and method of its best match, mean ratings, widest bounds."""
    order = F.struct(F.col("match_score"), F.col("imdb_title"), F.col("netflix_title"))
    return matched.where(F.col("netflix_movie_id").isNotNull()).groupBy("netflix_movie_id").agg(
        F.max_by("imdb_title", order).alias("imdb_title"),
        F.max_by("netflix_title", order).alias("netflix_title"),
        F.avg("imdb_rating").alias("imdb_rating"),
        F.avg("expected_netflix_rating").alias("expected_netflix_rating"),
        F.min("rating_low").alias("rating_low"),
        F.max("rating_high").alias("rating_high"),
        F.max_by("match_method", order).alias("match_method"),
        F.max("match_score").alias("match_score"),
    )


def score_candidates(ratings: DataFrame, facts: DataFrame, config: LinkageConfig = LinkageConfig()) -> DataFrame:
    """The best customers, ranked. One pass: ratings of the facts' movies, one shuffle on customer."""
    few = facts.select(F.col("netflix_movie_id").alias("movie_id"), F.col("expected_netflix_rating").alias("_e"), F.col("rating_low").alias("_lo"), F.col("rating_high").alias("_hi"))
    total = facts.agg(F.count(F.lit(1)).alias("total_facts"))
    # a fact for each movie of one profile at most; Spark broadcasts it by its size
    diff = F.col("rating") - F.col("_e")
    sums = (
        ratings.join(few, "movie_id")
        .groupBy("customer_id")
        .agg(
            F.sum(-0.5 * F.pow(diff / config.sigma, F.lit(2.0))).alias("_score"),
            F.sum(diff * diff).alias("_sq"),
            F.sum(F.abs(diff)).alias("_abs"),
            F.count(F.lit(1)).alias("matched_facts"),
            F.sum(F.when(F.col("rating").between(F.col("_lo"), F.col("_hi")), 1).otherwise(0)).alias("exact_rating_matches"),
        )
    )
    n = F.col("matched_facts")
    made = (
        sums.where(n >= config.min_matches)
        .join(F.broadcast(total))
        .select(
            "customer_id",
            (F.col("_score") + (F.col("total_facts") - n) * config.missing_penalty).alias("log_score"),
            "matched_facts",
            "total_facts",
            (n / F.col("total_facts")).alias("coverage"),
            "exact_rating_matches",
            (F.col("exact_rating_matches") / n).alias("exact_rating_rate"),
            (F.col("_abs") / n).alias("mean_abs_error"),
            F.sqrt(F.col("_sq") / n).alias("rmse_to_imdb_profile"),
        )
    )
    order = [F.round("log_score", 9).desc(), F.col("matched_facts").desc(), F.col("exact_rating_rate").desc(), F.col("customer_id")]
    top = made.orderBy(*order).limit(config.top_n)
    return top.select(F.row_number().over(Window.orderBy(*order)).alias("rank"), *made.columns)


def linkage_attack(
    external: DataFrame, titles: DataFrame, ratings: DataFrame, user: str | None = None, match: MatchConfig = MatchConfig(), link: LinkageConfig = LinkageConfig()
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(matched, facts, candidates). Without a user, all profiles count as one."""
    if user is not None:
        external = external.where(user_equals("user", user))
        if external.isEmpty():
            raise ValueError(f"no external ratings of {user}")
    matched = match_titles(external, titles, match)
    facts = linkage_facts(matched)
    return matched, facts.orderBy(F.col("match_score").desc(), "netflix_movie_id"), score_candidates(ratings, facts, link)
