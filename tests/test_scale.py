"""Results of queries that grew too fast, and what keeps them from it."""

import pytest
from pyspark.sql import functions as F

from veilframe.operators import attack, bias, k_anonymity, releases


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_inferred_share_counts_before_it_joins(spark):
    people = spark.createDataFrame([("a", 1), ("a", 1), ("b", 1), ("c", 2), ("d", None), ("e", 9)], "name string, k int")
    table = spark.createDataFrame([(1, True), (1, False), (1, None), (2, None), (None, True)], "k int, debt boolean")
    got = k_anonymity.inferred_share(people, table, ["k"], F.col("debt"))
    assert rows(got) == [("a", 1, 6, 0.5), ("b", 1, 3, 0.5), ("c", 2, 1, None)]
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Join") < plan.index("Aggregate")


def _random_ratings(spark, n=400):
    import random

    rng = random.Random(3)
    made = [(k, rng.randrange(20), rng.randrange(15), rng.randrange(1, 6)) for k in range(n)]
    return spark.createDataFrame([(f"r{k}", u, m, r) for k, u, m, r in made], "row_key string, customer_id long, movie_id long, rating int")


def test_cases_of_a_grid_are_its_releases(spark):
    df = _random_ratings(spark)
    shares, scenarios = (0.0, 0.3), ("rating", "all_three")
    points, cases = releases.noise_cases(df, shares, scenarios)
    grid = releases.noise_grid(df, shares, scenarios)
    assert [x[:2] for x in points] == [x[:2] for x in grid]
    for (_, _, v), (_, _, made) in zip(points, grid, strict=True):
        assert rows(cases.where(F.col("_in").bitwiseAND(1 << v) != 0).select(*made.columns)) == rows(made)
    assert cases.count() < 2 * df.count()  # not a row for each row and point
    a, b = (bias.bias_sweep(df, df, g, 2, cases=c).na.fill(-1.0) for g, c in ((points, cases), (grid, None)))
    for x, y in zip(rows(a), rows(b), strict=True):
        assert x[:2] == y[:2] and x[2:] == pytest.approx(y[2:])


def test_a_grid_is_attacked_at_once(spark):
    df = _random_ratings(spark)
    points, cases = releases.noise_cases(df, (0.0, 0.3), ("movie", "user_id"))
    facts = attack.sampled_facts(df, (1, 2), 20)
    got = attack.variant_trials(facts, cases, points, ("movie_id", "rating"), (1, 2), 20)
    for s, p, made in releases.noise_grid(df, (0.0, 0.3), ("movie", "user_id")):
        one = attack.noisy_trials(df, made, ("movie_id", "rating"), (1, 2), 20, facts=facts)
        assert rows(got.where((F.col("scenario") == s) & (F.col("p") == p)).select(*one.columns)) == rows(one)


def test_neighbours_and_predictions_part_by_part(spark, monkeypatch):
    from veilframe.operators import item_knn

    df = _random_ratings(spark)
    model = bias.fit_bias(df, epochs=2)
    res = item_knn.residuals(df, model)
    whole = item_knn.item_neighbours(res, 4)
    flat = lambda x: [tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in rows(x)]
    asked = df.select("customer_id", "movie_id").distinct()
    said = flat(item_knn.predict_item_knn(model, res, whole, asked))
    monkeypatch.setattr(item_knn, "HISTORY", 4)  # histories of several blocks
    assert flat(item_knn.item_neighbours(res, 4, pairs=300)) == flat(whole)
    assert flat(item_knn.predict_item_knn(model, res, whole, asked, rows=100)) == said
    kept = {(r.customer_id, r.movie_id): r.res for r in res.collect()}
    items = sorted({m for _, m in kept})
    norm = {m: sum(x * x for (_, n), x in kept.items() if n == m) ** 0.5 for m in items}
    dot = lambda a, b: sum(x * kept.get((u, b), 0) for (u, m), x in kept.items() if m == a)
    for a in items:
        best = sorted((-round(s, 9), b) for b in items if a != b and (s := dot(a, b) / (norm[a] * norm[b])) > 0 and round(s, 9) >= 0.05)[:4]
        assert [b for _, b in best] == [r[0] for r in whole.where(F.col("movie_id") == a).orderBy("rank").select("neighbour").collect()]


def test_factors_are_checkpointed_at_every_iteration(spark, monkeypatch):
    from veilframe.operators import als

    made = []
    monkeypatch.setattr(als, "ALS", lambda **options: made.append(options) or als_class(**options))
    from pyspark.ml.recommendation import ALS as als_class

    model = als.als_model(_random_ratings(spark), "rating", 2, 2)
    assert model.itemFactors.count() == 15
    assert made[0]["checkpointInterval"] == 1  # shuffles of an iteration go with its checkpoint
    assert spark.sparkContext._jsc.sc().getCheckpointDir().isDefined()


def test_synthetic_rows_look_up_their_users(spark):
    from veilframe.operators import synthetic

    real = spark.createDataFrame([(u, m) for u in range(6) for m in range(40 * u + 3)], "customer_id long, movie_id long")
    made = spark.range(3000)
    got = {r.id: r.customer_id for r in synthetic.assign_users(made, real, 5).collect()}
    assert sorted(got) == list(range(3000))
    owners = [got[i] for i in range(3000)]
    assert owners == sorted(owners) and owners[0] == synthetic.FIRST_USER
    lengths = {min(40 * u + 3, synthetic.LONGEST) for u in range(6)}
    runs = [owners.count(u) for u in sorted(set(owners))]
    assert set(runs[:-1]) <= lengths and len(set(owners)) == owners[-1] - owners[0] + 1
    # runs of users meet the rows: neither is shuffled by id
    plan = synthetic.assign_users(made, real, 5)._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(id" not in plan and "BroadcastHashJoin" in plan


def test_copula_shuffles_no_rows_for_small_maps(spark):
    from veilframe.operators import synthetic

    df = _random_ratings(spark).withColumn("month", F.lit("2001-01"))
    plan = synthetic.gaussian_copula(df, rows=100)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("BroadcastHashJoin") == 3 and "SortMergeJoin" not in plan and "hashpartitioning" not in plan


def test_membership_reads_what_profiles_meet(spark, monkeypatch):
    from veilframe.operators import neighbours

    df = _random_ratings(spark)
    profiles = neighbours.sample_profiles(df, 5, 3)
    kept, plain = [], neighbours.checkpointed

    def checkpointed(x):
        out = plain(x)
        kept.append(out)
        return out

    monkeypatch.setattr(neighbours, "checkpointed", checkpointed)
    got = {(r.profile, r.candidate): r.sim for r in neighbours.nearest_users(profiles, df, 50).collect()}
    movies = {r.movie_id for r in profiles.collect()}
    assert all({r.movie_id for r in x.collect()} <= movies for x in kept if "movie_id" in x.columns)
    vectors: dict = {}
    for side, table in (("p", profiles), ("r", df)):
        for r in neighbours._vectors(table, "rating", "user").collect():
            vectors.setdefault((side, r.user), {})[r.movie_id] = r.x
    size = lambda v: sum(x * x for x in v.values()) ** 0.5
    for (p, c), sim in got.items():
        a, b = vectors["p", p], vectors["r", c]
        dot = sum(x * b[m] for m, x in a.items() if m in b)
        assert sim == pytest.approx(dot / (size(a) * size(b)) if size(a) * size(b) else 0.0)
    assert set(got) == {(p, c) for s, p in vectors if s == "p" for t, c in vectors if t == "r" and set(vectors["p", p]) & set(vectors["r", c])}
    asked = []
    auc = lambda m, o, release, col: asked.append(col) or release.sparkSession.createDataFrame([(1.0,)], "auc double")
    monkeypatch.setattr(neighbours, "membership_auc", auc)
    made = releases.make_releases(df, 333, 2, 2, ("movie_id", "rating"))
    assert neighbours.release_membership(made, profiles, profiles).count() == 8 and len(asked) == 5


def test_fixed_releases_are_fitted_together(spark, monkeypatch):
    df = _random_ratings(spark)
    options = dict(seed=333, rare_min=16, k=4, suppress_cols=("movie_id", "rating"))
    apart = bias.compare_releases(df, df, releases.make_releases(df, **options), 3).collect()
    fits = []
    monkeypatch.setattr(bias, "fit_bias", lambda *x, **y: fits.append(x))
    together = bias.compare_releases(df, df, epochs=3, **options).collect()
    assert not fits and len(together) == 9
    assert len({r.train_rows for r in together}) == 3  # the rare and the suppressed ones are smaller
    by_name = lambda x: sorted((tuple(r) for r in x), key=lambda r: r[0])
    for a, b in zip(by_name(apart), by_name(together), strict=True):
        assert a[:4] + a[7:] == b[:4] + b[7:]
        assert [x or 0 for x in a[4:7]] == pytest.approx([x or 0 for x in b[4:7]])


def test_scorecard_attacks_a_shared_release_once(spark, monkeypatch):
    from veilframe.plans import catalog_more

    asked = []
    made = "top1_hit boolean, topk_hit boolean"
    monkeypatch.setattr(catalog_more.neighbours, "nearest_neighbor_attack", lambda p, x, rating_col: asked.append(rating_col) or spark.createDataFrame([(True, True)], made))
    got = catalog_more.neighbour_risk(_random_ratings(spark))
    assert got.count() == 8 and len(asked) == 5


def test_a_model_of_neighbours_leaves_what_its_predictions_read(spark):
    import os
    from urllib.parse import unquote, urlparse

    from veilframe.operators import item_knn
    from veilframe.session import checkpoint_folder

    df = bias.checkpointed(_random_ratings(spark))
    folder = urlparse(checkpoint_folder(spark)).path
    held = lambda: {x for x in os.listdir(folder) if x.startswith("held")}
    before = held()
    got = item_knn.knn_fit_predict(4, epochs=1)(df, df)
    read = {unquote(f).rsplit("/", 2)[1] for f in got.inputFiles()}
    assert held() - before <= read and got.count() == 400  # neighbours and residuals are gone


def test_a_sweep_of_models_fits_each_release_once(spark, monkeypatch):
    from veilframe.operators import item_knn

    df = _random_ratings(spark)
    train, test = bias.split(df, 0.3, once=True)
    plain = bias.split(df, 0.3)
    assert [rows(x) for x in (train, test)] == [rows(x) for x in plain]
    grid = releases.noise_grid(train, (0.0, 0.4), ("rating",))
    fits, fit_bias = [], bias.fit_bias
    monkeypatch.setattr(bias, "fit_bias", lambda *x, **y: fits.append(x) or fit_bias(*x, **y))
    fit = bias.SharedFits()
    models = {"bias": bias.bias_fit_predict(1, fit=fit), "item_knn": item_knn.knn_fit_predict(4, epochs=1, fit=fit)}
    got = rows(bias.multi_model_sweep(train, test, grid, models).na.fill(-1.0))
    assert len(got) == 4 and len(fits) == 2  # of each table, not of each model and table
    fit.discard()

    def plainly(release, asked):  # with neighbours as a table
        base = fit_bias(release, epochs=1)
        res = item_knn.residuals(release, base)
        return item_knn.predict_item_knn(base, res, item_knn.item_neighbours(res, 4), asked)

    want = rows(bias.utility_sweep(train, test, grid, plainly, "item_knn").na.fill(-1.0))
    for x, y in zip(got[2:], want, strict=True):
        assert x[:3] == y[:3] and x[3:] == pytest.approx(y[3:])


def test_shifts_of_asked_pairs_in_parts(spark, monkeypatch):
    from veilframe.operators import item_knn

    far = 1 << 60  # ids too far apart for sums of pairs by id, customers that are null, pairs that nobody knows
    df = _random_ratings(spark, 250).select(F.when(F.col("customer_id") > 0, F.col("customer_id")).alias("customer_id"), ((F.col("movie_id") - 7) * far).alias("movie_id"), "rating")
    base = bias.fit_bias(df, epochs=1, keep=True)
    res = item_knn.fitted_residuals(base)
    asked = df.select("customer_id", "movie_id").union(spark.createDataFrame([(1, 5), (999, far), (None, far), (None, None)], "customer_id long, movie_id long"))
    near = item_knn.item_neighbours(item_knn.residuals(df, base), 3)
    want = {r[:2]: r.prediction for r in item_knn.predict_item_knn(base, res, near, asked).collect()}
    got = item_knn.shifted(bias.predict_bias(base, asked, "_base"), item_knn.item_knn_shifts(res, asked, 3, pairs=1200)).collect()
    assert {r[:2] for r in got} == set(want) and len(got) == asked.count()
    for r in got:
        assert r.prediction == pytest.approx(want[r[:2]])


def test_sums_of_pairs_by_either_sort():
    import numpy as np

    from veilframe.operators import item_knn

    rng = np.random.default_rng(2)
    keys, values = rng.integers(0, 50, 400), rng.normal(size=400)
    for top in (50, 1 << 62):
        got, sums = item_knn._added(keys, values, top)
        assert list(got) == sorted(set(keys)) and sums == pytest.approx([values[keys == k].sum() for k in got])
    part = item_knn._Part(100, 7)  # a hot part adds up as it goes
    part.most = 50
    n, own = np.full(40, 5, "i4"), np.ones(40, "i4")
    others, c = rng.integers(0, 100, 200).astype("i4"), rng.integers(0, 14, 40).astype("i4")
    x, theirs = rng.normal(size=40), rng.normal(size=200)
    part.add(n, own, c, x, others, theirs)
    keys, sums = part.added()
    flat = np.repeat(c, 5) * 100 + others
    assert list(keys) == sorted(set(flat)) and sums == pytest.approx([(np.repeat(x, 5) * theirs)[flat == k].sum() for k in keys])
