import math

import pytest
from pyspark.sql import functions as F

from veilframe.functions import features as fx
from veilframe.operators import attack, bias, fidelity, item_knn, k_anonymity, linkage, neighbours, releases
from veilframe.operators.als import average_rank_share
from veilframe.schema import MissingColumns, normalized_ratings


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_features_of_dates_months_and_nothing(spark):
    df = spark.createDataFrame([(1, 1, 5, "2005-03-04"), (1, 2, None, "bad"), (1, 3, 1, None)], "movie_id int, user_id int, rating int, date string")
    got = fx.with_features(df).orderBy("customer_id").select("month", "year", "rating_bucket", "rating_bucket_midpoint").collect()
    assert [tuple(r) for r in got] == [("2005-03", 2005, "liked", 4.5), (None, None, "neutral", 3.0), (None, None, "disliked", 1.5)]
    month = spark.createDataFrame([(1, 1, 3, "2005-06"), (1, 2, 3, None)], "movie_id int, customer_id int, rating int, month string")
    assert rows(fx.with_features(month).select("month", "year"))[0] == ("2005-06", 2005)
    assert fx.with_features(month).where("customer_id = 2").select("month", "year").first() == ("unknown", None)
    assert fx.with_features(month.drop("month")).select("month", "year").first() == ("unknown", None)
    with pytest.raises(MissingColumns):
        normalized_ratings(month.drop("rating"))


def test_nan_is_null(spark):
    df = spark.createDataFrame([(1, 1, float("nan"))], "movie_id int, customer_id int, rating double")
    assert fx.with_features(df).first().rating_bucket == "neutral"


def test_titles_normalise(spark):
    said = ["The Café & Bar", None, "A", "An  Éclair!", "the the", "日本"]
    df = spark.createDataFrame([(t,) for t in said], "t string")
    got = [r[0] for r in df.select(fx.normalize_title(F.col("t"))).collect()]
    assert got == ["cafe and bar", "", "", "eclair", "the", ""]
    plain = ["The Big & Small", "a b", "x"]
    df = spark.createDataFrame([(t,) for t in plain], "t string")
    assert [r[0] for r in df.select(fx.normalize_title(F.col("t"))).collect()] == [fx.normalize_title_text(t) for t in plain]


def test_scales(spark):
    df = spark.createDataFrame([(7.0,), (10.0,), (1.0,), (None,)], "r double")
    low, high = fx.star_bounds(F.col("r"))
    got = [tuple(r) for r in df.select(fx.expected_stars(F.col("r")), low, high).collect()]
    assert got[:3] == [(3.5, 3, 4), (5.0, 5, 5), (1.0, 1, 1)] and got[3][0] is None
    assert tuple(df.select(*fx.legacy_star_bounds(F.col("r"))).first()) == (3, 4)


def test_null_keys_are_a_class(spark):
    df = spark.createDataFrame([(1, 1, None), (1, 2, None), (1, 3, "x"), (1, 3, "x")], "movie_id int, customer_id int, month string")
    assert rows(releases.class_sizes(df, ["movie_id", "month"]).select("k")) == [(1,), (2,)]
    assert releases.suppress_low_k(df, ["movie_id", "month"], 2).count() == 2
    assert releases.suppress_low_k(df, ["movie_id", "month"], 1).count() == 4  # repeated rows stay


def test_k_anonymity_of_nothing(spark, ratings):
    none = k_anonymity.fact_k_anonymity(ratings.where("false"), ["movie_id"]).first()
    assert none.fact_count == 0 and none.min_k is None
    got = k_anonymity.fact_k_anonymity(ratings, ["movie_id"]).first()
    assert (got.fact_count, got.min_k, got.median_k, got.pct_unique_facts) == (3, 2, 3.0, 0.0)


def test_suppression_bounds_k(ratings):
    kept = releases.suppress_low_k(fx.with_features(ratings), ["movie_id"], 3)
    got = k_anonymity.fact_k_anonymity(kept, ["movie_id"]).first()
    assert got.min_k >= 3 and got.pct_unique_facts == 0


def test_noise(spark, ratings):
    for p in (-0.1, 1.5):
        with pytest.raises(ValueError):
            releases.add_rating_noise(ratings, 1, p)
        with pytest.raises(ValueError):
            releases.make_noisy_release(ratings, rating_p=p)
    assert rows(releases.add_rating_noise(ratings, 1, 0.0)) == rows(ratings)
    assert rows(releases.make_noisy_release(ratings)) == rows(ratings)
    for weighted in (False, True):
        keyed = ratings.withColumn("row_key", F.concat_ws("|", *ratings.columns))
        got = releases.make_noisy_release(keyed, 1.0, 1.0, 1.0, 5, weighted).join(keyed.select("row_key", *[F.col(c).alias(f"o_{c}") for c in ("rating", "movie_id", "customer_id")]), "row_key")
        assert got.count() == 8
        assert got.where("rating = o_rating or movie_id = o_movie_id or customer_id = o_customer_id").count() == 0
        assert got.where("rating not between 1 and 5 or movie_id not in (1, 2, 3) or customer_id not in (10, 20, 30)").count() == 0


def test_weighted_draws_follow_frequency(spark):
    df = spark.range(6000).select(F.col("id").cast("string").alias("row_key"), F.when(F.col("id") % 10 < 7, 1).when(F.col("id") % 10 < 9, 2).otherwise(3).cast("int").alias("rating"), F.lit(1).alias("movie_id"), F.lit(1).alias("customer_id"))
    got = releases.make_noisy_release(df, rating_p=1.0, seed=3, weighted=True).join(df.select("row_key", F.col("rating").alias("was")), "row_key")
    share = {(r.was, r.rating): r["count"] for r in got.groupBy("was", "rating").count().collect()}
    assert abs(share[1, 2] / (share[1, 2] + share[1, 3]) - 2 / 3) < 0.03
    assert abs(share[3, 1] / (share[3, 1] + share[3, 2]) - 7 / 9) < 0.06


def test_nine_releases(ratings):
    got = releases.make_releases(ratings, rare_min=3, k=2)
    assert [r.name for r in got][:4] == ["original_movie_rating_month", "remove_month", "year_only", "coarsen_rating"]
    assert len(got) == 9 and got[-1].rating_col is None and got[6].data.count() == 6
    assert [r.name for r in releases.six_releases(ratings)][3] == "coarsen_rating_to_preference"


def test_latent_noise(spark, ratings):
    weights = spark.createDataFrame([(1, 1.0), (2, 0.0)], "movie_id int, privacy_weight double")
    got = releases.latent_sensitive(ratings, weights)
    assert got.count() == 8 and {r.month for r in got.where("movie_id = 1").collect()} == {"2005"}


def test_candidates_need_every_distinct_fact(spark):
    facts = spark.createDataFrame([(2, 0, 1, 5), (2, 0, 1, 5), (2, 1, 1, None), (2, 1, 2, 3)], "n_known int, trial int, movie_id int, rating int")
    index = spark.createDataFrame([(1, 5, 10), (1, 5, 11), (1, None, 10), (2, 3, 10), (2, 3, 12)], "movie_id int, rating int, customer_id int")
    assert rows(attack.candidates(facts, index, ["movie_id", "rating"])) == [(2, 0, 10), (2, 0, 11), (2, 1, 10)]


def test_own_release_always_holds_the_target(ratings):
    base = fx.with_features(ratings)
    t = attack.attack_trials(base, base, ["movie_id", "rating"], (1, 2, 3), 20, 7)
    assert t.where("n_known = 3").count() == 20 and t.where("NOT true_user_in_candidates or candidate_count < 1").count() == 0
    s = attack.noisy_summary(attack.noisy_trials(base, base, ["movie_id", "rating"], (1, 2), 20, 7)).collect()
    assert all(r.unique_false_positive_rate == 0 and r.pct_no_match == 0 for r in s)
    same = attack.attack_trials(base.repartition(7), base, ["movie_id", "rating"], (1, 2, 3), 20, 7)
    assert rows(t) == rows(same)


def test_evaluation_of_releases(ratings):
    k, trials, summary = attack.evaluate_releases(releases.make_releases(ratings, rare_min=3, k=1)[:3], (1,), 5)
    assert k.count() == 3 and trials.count() == 15 and "remove_month" in {r.release_name for r in summary.collect()}


def test_popularity_quartiles_are_not_ntile(spark):
    df = spark.createDataFrame([(m, c) for m in range(10) for c in range(m + 1)], "movie_id int, customer_id int")
    got = {r.bucket: r["count"] for r in attack.popularity_buckets(df).groupBy("bucket").count().collect()}
    assert got == {"rare": 3, "less_common": 2, "common": 2, "popular": 3}


def test_average_rank(spark):
    df = spark.createDataFrame([(1,), (1,), (2,), (5,)], "v int")
    assert rows(average_rank_share(df, "v", "s").select("v", "s")) == [(1, 0.375), (1, 0.375), (2, 0.75), (5, 1.0)]


def test_matching(spark, titles):
    said = [("The Night Train", 1999, "u", 10.0), ("Small Drama", 1987, "u", 4.0), ("Movie with Commas", 2001, "u", 6.0), ("Nothing like it", None, "u", 5.0), ("日本", 1999, "u", 1.0)]
    ext = spark.createDataFrame(said, "title string, year int, user string, rating double")
    got = {r.imdb_title: (r.netflix_movie_id, r.match_method) for r in linkage.match_titles(ext, titles).collect()}
    assert got["The Night Train"] == (1, "exact_title_year") and got["Small Drama"] == (2, "unique_title")
    assert got["Movie with Commas"] == (3, "fuzzy_title")
    assert got["Nothing like it"] == (None, "unmatched") and got["日本"] == (None, "unmatched")
    off = linkage.match_titles(ext, titles, linkage.MatchConfig(unique_title=False, fuzzy=False))
    assert {r.match_method for r in off.collect()} == {"exact_title_year", "unmatched"}


def test_linkage_by_hand(spark, ratings, titles):
    ext = spark.createDataFrame([("Night Train", 1999, "Ann", 10.0), ("Small Drama", 2000, "Ann", 4.0)], "title string, year int, user string, rating double")
    matched, facts, found = linkage.linkage_attack(ext, titles, ratings, "ann")
    assert facts.count() == 2
    got = [(r["rank"], r.customer_id, round(r.log_score, 6), r.exact_rating_matches) for r in found.orderBy("rank").collect()]
    assert got == [(1, 10, 0.0, 2), (2, 30, -0.888889, 1), (3, 20, -22.222222, 0)]
    for r in found.collect():
        want = -r.matched_facts * r.rmse_to_imdb_profile**2 / (2 * 0.75**2) + (r.total_facts - r.matched_facts) * -0.75
        assert math.isclose(r.log_score, want, abs_tol=1e-9)
    with pytest.raises(ValueError):
        linkage.linkage_attack(ext, titles, ratings, "bob")


def test_bias_model(spark, ratings):
    with pytest.raises(ValueError):
        bias.fit_bias(ratings.where("false"))
    model = bias.fit_bias(ratings, epochs=3)
    new = spark.createDataFrame([(99, 99, 3), (1, 10, 5)], "movie_id int, customer_id int, rating int")
    got = {r.customer_id: r.prediction for r in bias.predict_bias(model, new).collect()}
    assert math.isclose(got[99], 27 / 8) and 1 <= got[10] <= 5
    mean, bu, bi = 27 / 8, {}, {m: 0.0 for m in (1, 2, 3)}
    data = [(r.customer_id, r.movie_id, r.rating) for r in ratings.collect()]
    for _ in range(3):
        bu = {u: sum(r - mean - bi[m] for c, m, r in data if c == u) / (sum(c == u for c, _, _ in data) + 10) for u in (10, 20, 30)}
        bi = {i: sum(r - mean - bu[c] for c, m, r in data if m == i) / (sum(m == i for _, m, _ in data) + 10) for i in (1, 2, 3)}
    assert math.isclose(got[10], min(5, max(1, mean + bu[10] + bi[1])), rel_tol=1e-9)


def test_splits(ratings):
    with pytest.raises(ValueError):
        bias.split(ratings, 1.0)
    train, test = bias.split(ratings, 0.4, 1, check=False)
    assert rows(train.union(test)) == rows(ratings)
    train, test = bias.exact_split(ratings, 0.75)
    assert train.count() == 6 and test.count() == 2
    pairs = ratings.where("movie_id = 1").select("movie_id", "customer_id")
    train, test = bias.official_holdout(ratings, pairs, max_test=2)
    assert train.count() == 5 and test.count() == 2
    assert bias.holdout_users(ratings, 0.01).count() == 1


def test_release_comparison(ratings):
    got = bias.compare_releases(ratings, ratings, epochs=1, rare_min=3, k=50).collect()
    by = {r.release_name: r for r in got}
    assert by["movie_only"].status == "skipped_no_rating_labels" and by["k_suppress_movie_rating_month_k50"].status == "skipped_empty_training_set"
    assert by["original_movie_rating_month"].rmse == by["remove_month"].rmse == by["year_only"].rmse >= 0


def test_item_neighbours_and_predictions(ratings):
    model = bias.fit_bias(ratings, epochs=1)
    res = item_knn.residuals(ratings, model)
    near = item_knn.item_neighbours(res, 2, -1.0)
    assert near.where("movie_id = neighbour").count() == 0
    got = item_knn.predict_item_knn(model, res, near, ratings)
    assert got.count() == 8 and got.where("prediction not between 1 and 5").count() == 0


def test_nearest_neighbours(ratings):
    profiles = neighbours.sample_profiles(ratings, 3, 2)
    got = neighbours.nearest_neighbor_attack(ratings, ratings)
    assert got.where("top1_hit").count() >= 2 and got.where("best_similarity > 1.0000001").count() == 0
    assert profiles.groupBy("customer_id").count().where("count <> 2").count() == 0
    assert neighbours.membership_features(profiles, ratings).count() == profiles.select("customer_id").distinct().count()
    few = neighbours.membership_auc(profiles, profiles, ratings).first()
    assert few.auc is None


def test_quasi_identifiers(spark):
    df = spark.createDataFrame([("a", "1", 10.0), ("a", "2", 20.0), ("b", "2", 30.0), (None, "2", 40.0)], "x string, y string, v double")
    got = {r.columns: r.reidentified for r in k_anonymity.powerset_reidentification(df, ["x", "y"]).collect()}
    assert got == {"x": 0.25, "y": 0.25, "x+y": 0.75}
    assert k_anonymity.qi_join(df, df, ["x"]).count() == 5
    gone = k_anonymity.differencing_attack(df, F.col("y") == "1", "v").first()
    assert gone.revealed == 10.0
    means = {r.x: (r.people, r.exposed) for r in k_anonymity.group_means(df, ["x"], "v").collect()}
    assert means["a"] == (2, False) and means["b"] == (1, True)
    hist = {r.matches: r.people for r in k_anonymity.match_count_histogram(df, df, ["x"]).collect()}
    assert hist == {2: 2, 1: 1, 0: 1}


def test_divergence(spark, ratings):
    assert fidelity.js_divergence(ratings, ratings, "rating").first()[0] == 0
    other = ratings.withColumn("rating", F.col("rating") + 10)
    there = fidelity.js_divergence(ratings, other, "rating").first()[0]
    back = fidelity.js_divergence(other, ratings, "rating").first()[0]
    assert math.isclose(there, back) and math.isclose(there, 1.0, abs_tol=1e-6)


def test_synthetic_rows(spark, ratings):
    from veilframe.operators.synthetic import synthetic_release

    base = fx.with_features(ratings.drop("date").withColumn("month", F.lit("2005-01")))
    got = synthetic_release(base, 200)
    assert got.count() == 200 and got.where("customer_id < 900000000 or rating not between 1 and 5").count() == 0
    checks = fidelity.synthetic_checks(got, base, numeric=("rating",), key="id")
    assert all(r.share == 1.0 for r in checks.collect())


def test_entry_without_training_operators():
    import __spark_entry__ as e

    held, sql = e.queries(), e.oracle_sql()
    assert len(held) > 60 and set(sql) <= set(held)


def test_stream_of_classes(spark, tmp_path):
    from veilframe.streaming.monitor import class_counts

    df = spark.createDataFrame([("2024-01-01 00:00:00", "a", 1), ("2024-01-01 01:00:00", "a", 2), ("2024-01-03 00:00:00", "a", 1)], "t string, c string, u int")
    df.select(F.to_timestamp("t").alias("t"), "c", "u").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("t timestamp, c string, u int").parquet(str(tmp_path / "in"))
    query = class_counts(stream, ["c"], "t", "u").writeStream.format("memory").queryName("classes").outputMode("complete").start()
    query.processAllAvailable()
    query.stop()
    assert sorted(r.k for r in spark.table("classes").collect()) == [1, 2]


def test_grid_of_factor_models(spark):
    from veilframe.operators.als import tune

    rows = spark.createDataFrame([(u, m, float(1 + (u * m) % 5)) for u in range(1, 13) for m in range(1, 9) if (u + m) % 4], "customer_id int, movie_id int, rating double")
    found = tune(rows, ranks=(2, 3), regs=(0.1,), iterations=(2,))
    assert len(found.validationMetrics) == 2 and found.bestModel.rank in (2, 3)


def test_one_fit_for_a_grid_agrees_with_a_fit_for_each_point(spark):
    rows = spark.createDataFrame([(u, m, 1 + (u * 7 + m * 3) % 5, f"{u}-{m}") for u in range(1, 30) for m in range(1, 20) if (u * m) % 3], "customer_id long, movie_id long, rating int, row_key string")
    train, test = bias.split(rows, 0.25)
    grid = releases.noise_grid(train, (0.0, 0.3), ("rating", "movie"))
    one = bias.bias_sweep(train, test, grid, 3).collect()
    each = bias.utility_sweep(train, test, grid, bias.bias_fit_predict(3)).collect()
    for a, b in zip(one, each, strict=True):
        assert a[:3] == b[:3] and all(x == y or math.isclose(x, y, rel_tol=1e-9, abs_tol=1e-9) for x, y in zip(a[3:], b[3:], strict=True))


def test_least_rows_and_prefix_sums(spark):
    df = spark.range(500).select("id", (F.col("id") % 7).alias("w"), (F.xxhash64("id") / 1e9).alias("x"))
    h = F.when(F.col("id") < 50, 5).otherwise(F.expr("pmod(xxhash64(id), 4294967296)")).cast("bigint")
    for n in (1, 30, 50, 51, 400, 500, 900):
        want = {r.id for r in df.orderBy(h, "id").limit(n).collect()}
        assert {r.id for r in df.where(fx.least_rows(df, n, h, F.col("id"))).collect()} == want
    for column in ("id", "x"):
        rows = sorted(fx.prefix_sums(df, column, "w", "upto", 16).collect(), key=lambda r: r[column])
        total = 0
        for r in rows:
            total += r.w
            assert r.upto == total


def test_fuzzy_titles_by_all_pairs(spark):
    from veilframe.operators import linkage

    names = ["night train", "night trains", "the long road", "long roads", "silver river", "river of silver", "quiet garden", "a garden quiet"]
    titles = spark.createDataFrame([(k, 2000 + k % 2, n) for k, n in enumerate(names)], "movie_id int, year int, title string")
    asked = [("night trian", 2000), ("long rode", 2001), ("silvre river", None), ("garden", 2000), ("quiet gardens", None)]
    external = spark.createDataFrame([(t, y, "u", 8.0) for t, y in asked], "title string, year int, user string, rating double")
    got = {r.imdb_title: r for r in linkage.match_titles(external, titles, linkage.MatchConfig(0.8, 0.02)).collect()}
    for t, y in asked:
        q = fx.normalize_title_text(t)
        pool = [(linkage.title_ratio(q, fx.normalize_title_text(n)), k) for k, n in enumerate(names) if y is None or 2000 + k % 2 == y]
        best = sorted(pool, reverse=True)
        good = best[0][0] >= 0.8 and best[0][0] - best[1][0] >= 0.02
        assert got[t].netflix_movie_id == (best[0][1] if good else None)
        assert math.isclose(got[t].match_score, best[0][0])
